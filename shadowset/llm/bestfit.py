"""Best-fit packing by bin completion: branch and bound over fillings of the largest piece's sequence.

1. Documents are tokenised and cut only where they are longer than the window; a piece gets its rank among those of its length
   within the task, as in packing.py. The histogram of lengths (``window`` bins at most) goes to the driver, whatever the tables' size.
2. *Incumbent.* Best-fit decreasing over the histogram, all pieces of one length at a time: of the sequences with room, the
   fullest take as many as they can hold.
3. *Bin completion.* A node takes the longest piece left and enumerates what can fill its sequence: sets of up to three further
   lengths, topped up with the longest that fits. A filling goes if its pieces fit into those of another one (it is dominated).
   Fillings are tried by waste, each as often as counts allow, and once, so that one length may have several fillings.
4. *Bounds.* A node is left when the waste so far, or the lower bound of what is left (Martello and Toth's L2, by large, middle
   and small pieces), cannot beat the incumbent. At every node best-fit decreasing of the rest may give a better one. The search ends
   at the root's lower bound (then no packing has fewer sequences) or after NODES nodes; whatever it ends with holds all pieces.
5. Ranks become global and find their place in the plan as in packing.py; the plan has a row for each kind of sequence and place.

Defined results: null texts are empty and give one piece, the end token; every input row gives pieces, repeated rows too; a null
doc_id stays null; a text of any length is handled whole; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import stored
from shadowset.llm.packing import pieces, placed, tokenizer_path

WINDOW = 2048
#: Nodes of the search, and fillings tried at each.
NODES, WIDTH = 400, 12

Plan = list[tuple[tuple[int, ...], int]]


def best_fit(left: np.ndarray, window: int) -> Plan:
    """Best-fit decreasing, all pieces of a length at a time."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []  # the rooms that sequences have left, ascending

    def put(space: int, parts: tuple[int, ...], times: int) -> None:
        if space not in room:
            bisect.insort(order, space)
            room[space] = []
        room[space].append((parts, times))

    for n in np.flatnonzero(left)[::-1].tolist():
        many = int(left[n])
        while many:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                fits = window // n
                if many >= fits:
                    put(window - fits * n, (n,) * fits, many // fits)
                if many % fits:
                    put(window - many % fits * n, (n,) * (many % fits), 1)
                break
            space = order.pop(at)
            fits = space // n
            for parts, times in room.pop(space):
                full = min(times, many // fits)
                many -= full * fits
                if full:
                    put(space - fits * n, parts + (n,) * fits, full)
                if times > full and many:  # fewer are left than one sequence holds
                    put(space - many * n, parts + (n,) * many, 1)
                    full, many = full + 1, 0
                if times > full:
                    put(space, parts, times - full)
    return [x for space in order for x in room[space]]


def least_sequences(left: np.ndarray, window: int) -> int:
    """L2: no packing has fewer sequences."""
    size = np.arange(window + 1)
    count, total, half = np.cumsum(left), np.cumsum(left * size), window // 2
    a = np.arange(half + 1)
    large, middle = count[-1] - count[window - a], count[window - a] - count[half]
    spare = middle * window - (total[window - a] - total[half])
    small = total[half] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    return int((large + middle + np.maximum(0, -(-(small - spare) // window))).max())


def fits_in(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the pieces of one set, descending, can be dealt out over those of another."""
    if not small:
        return True
    for k, n in enumerate(large):
        if n >= small[0] and n not in large[:k] and fits_in(small[1:], tuple(sorted((*large[:k], n - small[0], *large[k + 1 :]), reverse=True))):
            return True
    return False


def fillings(left: np.ndarray, space: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Sets of lengths (descending) that fit into space, none fitting into another; the fullest first, ``width`` at most."""
    have = np.flatnonzero(left[: space + 1])
    if not len(have):
        return [()]
    found: list[tuple[int, ...]] = [(int(have[-1]),)]

    def below(most: np.ndarray) -> np.ndarray:
        """The largest length of at most ``most``, or 0."""
        at = np.searchsorted(have, most, "right") - 1
        return np.where(at >= 0, have[np.maximum(at, 0)], 0)

    def lower(x: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """x, where a further piece of it is left; else the next smaller length."""
        return np.where((x > 0) & (left[x] <= taken), below(x - 1), x)

    x = have
    y = lower(below(np.minimum(x, space - x)), np.ones(len(x), int) * (below(np.minimum(x, space - x)) == x))
    found += [(int(a), int(b)) for a, b in zip(x, y, strict=True) if b]
    tops: list[tuple[int, int, int, int]] = []
    for b in have[::-1]:  # the middle one of three
        first = have[(have >= b) & (have <= space - b - have[0])]
        if b == have[-1] or len(first):
            first = first[(first > b) | (left[b] >= 2)]
            third = below(np.minimum(b, space - b - first))
            third = lower(third, (third == b).astype(int) * (1 + (first == b)))
            good = np.flatnonzero(third > 0)
            if len(good):
                rest = space - first[good] - b - third[good]
                best = good[np.argsort(rest, kind="stable")[:2]]
                tops += [(int(space - first[g] - b - third[g]), int(first[g]), int(b), int(third[g])) for g in best]
        if len(tops) > 4 * width:
            tops = sorted(tops)[: 2 * width]
    found += [t[1:] for t in sorted(tops)[: 2 * width]]
    found = sorted(set(found), key=lambda f: (space - sum(f), len(f), f))[: 4 * width]
    out: list[tuple[int, ...]] = []
    for f in found:
        parts, rest = list(f), space - sum(f)
        while rest >= have[0]:
            more = [int(n) for n in have[: np.searchsorted(have, rest, "right")][::-1] if left[n] > parts.count(int(n))][:1]
            if not more:
                break
            parts += more
            rest -= more[0]
        out.append(tuple(sorted(parts, reverse=True)))
    out = sorted(set(out), key=lambda f: (space - sum(f), len(f), [-n for n in f]))
    kept: list[tuple[int, ...]] = []
    for f in out:
        if not any(fits_in(f, g) for g in kept):
            kept = [g for g in kept if not fits_in(g, f)] + [f]
    return kept[:width]


def complete(hist: np.ndarray, window: int = WINDOW, nodes: int = NODES, width: int = WIDTH) -> Plan:
    """(lengths of a sequence's pieces, how many such sequences): every piece of the histogram exactly once, in few sequences."""
    left = hist.astype(np.int64).copy()
    whole: Plan = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    if not left.any():
        return whole
    best = best_fit(left, window)
    fewest, least = sum(t for _, t in best), least_sequences(left, window)
    total = int((left * np.arange(window + 1)).sum())
    #: rest, plan so far, its sequences and waste, fillings not yet tried (None: all)
    stack: list[tuple[np.ndarray, Plan, int, int, list | None]] = [(left, [], 0, 0, None)]
    seen: dict[bytes, int] = {}
    while stack and fewest > least and nodes:
        rest, done, used, waste, todo = stack.pop()
        longest = int(np.flatnonzero(rest)[-1])
        if todo is None:
            nodes -= 1
            spare = rest.copy()
            spare[longest] -= 1
            todo = []
            for f in fillings(spare, window - longest, width):
                times = min(int(rest[n]) // (longest, *f).count(n) for n in {longest, *f})
                todo += [(f, times)] + [(f, 1)] * (times > 1)
        if not todo:
            continue
        (f, times), later = todo[0], todo[1:]
        if later:
            stack.append((rest, done, used, waste, later))
        parts = (longest, *f)
        after = rest.copy()
        for n in parts:
            after[n] -= times
        used, waste = used + times, waste + times * (window - sum(parts))
        if waste > (fewest - 1) * window - total or used + least_sequences(after, window) >= fewest:
            continue
        done = [*done, (parts, times)]
        mark = after.tobytes()
        if seen.get(mark, fewest) <= used:
            continue
        seen[mark] = used
        tail = best_fit(after, window)
        if (n := used + sum(t for _, t in tail)) < fewest:
            fewest, best = n, [*done, *tail]
        if after.any():
            stack.append((after, done, used, waste, None))
    return whole + best


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (with_ids: and ids), sequence_id, offset."""
    cut, _ = stored(pieces(docs, window, tokenizer or tokenizer_path("word_bpe_49k.json"), end, with_ids), "pieces")
    cut = cut.withColumn("piece", (F.col("start") / window).cast("int"))
    return placed(cut, window, complete, ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
