r"""Chat formatting over a prefix tree of turns.

*Template.* A turn is ``<turn ROLE>\nTEXT</turn>\n``. Inside role and text a backslash and ``<`` get a backslash before them,
so no text can close a turn or open one; every string that the vocabulary reads as a control token gets one before its second
character, so that none is ever encoded as that token. Undoing that gives the text back exactly.

*Tree.* Conversations that share their first turns share nodes. A conversation's path is known by the digests of its prefixes.
Prefixes that more than GROUP conversations share are trunk nodes: each is laid out once, as a tree of its own. What lies
below them (or a whole tree, where nothing is shared that often) is dealt into parts of about GROUP conversations by the
first prefix below the trunk, so a turn that conversations share is in one part only. A part names the trunk nodes above it.
Every shared turn is so emitted once in all, however many conversations share it, and no task holds an unbounded group.

*Output.* A task lays its part's tree out depth first. A node (one turn) has its tokens once; each token's position id is
its distance from the root, trunk included, and its attention is the trunk nodes above the part, the intervals of the layout
that its ancestors fill, and itself causally. A conversation is the trunk above its part and a list of nodes; its loss mask
covers the text tokens of assistant turns.

Defined results: turns are ordered by turn (nulls first), then role and text; null roles and texts are empty; rows with a null
conv_id belong together with nothing and are conversations of one turn each; repeated rows are turns of their own; extra
columns are ignored, whatever their names; an empty table gives nothing. One conversation is one sequence and held by one task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import arrow_map, bound_batches, stored
from shadowset.llm.packing import encoder, tokenizer_path

#: Conversations of a group, about.
GROUP = 128
SALTS = 16
ASSISTANT = "assistant"
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)


class Template:
    """The turns' texts for a vocabulary with these control strings."""

    def __init__(self, control: list[str] = ()):
        self.control = sorted(control, key=len, reverse=True)
        if any(len(c) < 2 or "\\" in c[:2] for c in self.control):
            raise ValueError("a control string that cannot be broken by a backslash")

    def escape(self, text: str, more: str = "") -> str:
        for c in ("\\", "<", *more):
            text = text.replace(c, "\\" + c)
        for c in self.control:
            text = text.replace(c, c[0] + "\\" + c[1:])
        return text

    def parts(self, role: str | None, text: str | None) -> tuple[str, str, str]:
        """A turn's opening, its text and its closing, escaped."""
        return f"<turn {self.escape(role or '', '>')}>\n", self.escape(text or ""), "</turn>\n"


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    at, out = 0, []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Tree:
    """The prefix tree of a group of conversations: lists of (role, text)."""

    def __init__(self, conversations: list[list[tuple[str, str]]]):
        self.turn: list[tuple[str, str]] = []
        self.parent: list[int] = []
        self.paths: list[list[int]] = []
        children: dict[tuple, int] = {}
        for turns in conversations:
            at, path = -1, []
            for turn in turns:
                key = (at, turn)
                if key not in children:
                    children[key] = len(self.turn)
                    self.turn.append(turn)
                    self.parent.append(at)
                at = children[key]
                path.append(at)
            self.paths.append(path)

    def depth_first(self) -> list[int]:
        below: dict[int, list[int]] = {}
        for n, p in enumerate(self.parent):
            below.setdefault(p, []).append(n)
        order, stack = [], below.get(-1, [])[::-1]
        while stack:
            n = stack.pop()
            order.append(n)
            stack += below.get(n, [])[::-1]
        return order


class Layout:
    """A tree in depth-first order: token ids, position ids, the loss mask, and for each node its own and its ancestors' intervals. base: tokens above its roots."""

    def __init__(self, tree: Tree, enc, base: int = 0):
        self.tree, ids, loss = tree, [], []
        self.start, self.end, self.depth = {}, {}, {}
        self.intervals: dict[int, list[tuple[int, int]]] = {}
        template, position, at = Template(enc.special), [], 0
        for n in tree.depth_first():
            role, text = tree.turn[n]
            mine = [np.frombuffer(enc.ids(x), np.uint32) for x in template.parts(role, text)]
            size = sum(map(len, mine))
            p = tree.parent[n]
            self.depth[n] = self.depth[p] + self.end[p] - self.start[p] if p >= 0 else base
            self.start[n], self.end[n] = at, at + size
            self.intervals[n] = _joined([*self.intervals[p], (at, at + size)]) if p >= 0 else [(at, at + size)]
            ids += mine
            loss += [np.zeros(len(mine[0]), bool), np.full(len(mine[1]), role == ASSISTANT), np.zeros(len(mine[2]), bool)]
            position.append(np.arange(self.depth[n], self.depth[n] + size, dtype=np.int32))
            at += size
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        self.loss = np.concatenate(loss) if loss else np.empty(0, bool)
        self.position = np.concatenate(position) if position else np.empty(0, np.int32)

    def attends(self, node: int, token: int) -> list[tuple[int, int]]:
        """What a token of the node sees in this layout: its ancestors' intervals and its own node up to itself."""
        above = self.intervals[self.tree.parent[node]] if self.tree.parent[node] >= 0 else []
        return _joined([*above, (self.start[node], token + 1)])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if len(spans) > 1 and spans[-2][1] == spans[-1][0]:
        return [*spans[:-2], (spans[-2][0], spans[-1][1])]
    return spans


def gathered(rows: DataFrame) -> DataFrame:
    """talk (a key), conv_id, turns: array<struct<role, text>> in order, prefixes: a digest of the turns up to each one. Stored."""
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", own.alias("own"), turn.alias("said"))
    talks = rows.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("said")).alias("turns")).drop("own")

    def chain(acc: Column, t: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("").cast("binary"))
        return F.concat(acc, F.array(F.unhex(F.md5(F.concat(last, F.concat_ws(":", F.length(t["role"]), t["role"], t["text"]).cast("binary"))))))

    talks = talks.withColumn("prefixes", F.aggregate("turns", F.expr("array()").cast("array<binary>"), chain))
    return stored(talks.withColumn("talk", F.monotonically_increasing_id()), "talks")[0]


def grouped(talks: DataFrame, size: int = GROUP) -> DataFrame:
    """talk, conv_id, turns (those below the trunk), trunk (the prefixes above them), part. talks: of gathered."""
    seen = talks.select(F.explode("prefixes").alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    # a turn that very many begin with is asked for in SALTS places
    large = seen.filter(F.col("n") > size).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("talk"), F.lit(SALTS)).cast("int").alias("salt")
    # how deep a conversation's large prefixes go
    depth = (
        talks.select("talk", salt, F.posexplode("prefixes").alias("at", "prefix"))
        .join(large, ["prefix", "salt"])
        .groupBy("talk")
        .agg((F.max("at") + 1).alias("large"), F.max_by("n", "at").alias("n"))
    )
    above = F.coalesce("large", F.lit(0))
    first = F.try_element_at("prefixes", above + 1)
    dealt = F.when(above > 0, F.pmod(F.coalesce(F.when(first.isNotNull(), F.xxhash64(first)), F.xxhash64("talk")), F.ceil(F.col("n") / size).cast("long"))).otherwise(F.lit(0).cast("long"))
    top = F.element_at("prefixes", F.greatest(above, F.lit(1)).cast("int"))
    return talks.join(depth, "talk", "left").select(
        "talk",
        "conv_id",
        F.slice("turns", above + 1, F.size("turns")).alias("turns"),
        F.slice("prefixes", 1, above).alias("trunk"),
        F.struct(F.hex(top).alias("p"), dealt.alias("d")).alias("part"),
        F.slice("turns", 1, above).alias("shared"),
    )


def formatted(rows: DataFrame, on_trunk, trunk_schema: str, on_part, schema: str, tokenizer: str | None = None, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The trunk nodes (prefix, parent, ``trunk_schema``) and what ``on_part`` makes of each part.

    on_trunk(layout of one node) gives the values of trunk_schema; its first column must be n long, the node's tokens. on_part(conv_ids, layout, above)
    gives a RecordBatch of schema; above: the trunk's values from the root down, as dicts.
    """
    bound_batches(rows.sparkSession)
    tokenizer = tokenizer or tokenizer_path()
    dealt, _ = stored(grouped(gathered(rows), size or GROUP), "dealt")
    nodes = dealt.filter(F.size("trunk") > 0).select(F.posexplode(F.arrays_zip("trunk", "shared")).alias("at", "x"), "trunk")
    nodes = nodes.select(F.col("x.trunk").alias("prefix"), F.when(F.col("at") > 0, F.try_element_at("trunk", F.col("at"))).alias("parent"), F.col("at").alias("depth"), F.col("x.shared").alias("turn"))
    nodes = nodes.groupBy("prefix").agg(F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("turn").alias("turn"))
    fields = [c.split()[0] for c in trunk_schema.split(", ")]

    def make():
        enc = encoder(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [on_trunk(Layout(Tree([[(t["role"], t["text"])]]), enc)) for t in batch.column("turn").to_pylist()]
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(c) for c in ("prefix", "parent", "depth")] + columns, names=["prefix", "parent", "depth", *fields])

        return each

    trunk, _ = stored(arrow_map(nodes, make, f"prefix binary, parent binary, depth int, {trunk_schema}"), "trunk")
    asked = dealt.filter(F.size("trunk") > 0).select("part", "trunk").groupBy("part").agg(F.any_value("trunk").alias("trunk"))
    chains = asked.select(F.col("part").alias("of"), F.posexplode("trunk").alias("at", "prefix")).join(trunk.select("prefix", *fields), "prefix")

    def each(part: pa.Table, chain: pa.Table) -> pa.Table:
        if not part.num_rows:
            raise ValueError("a part without conversations")
        above = sorted(chain.select(["at", *fields]).to_pylist(), key=lambda x: x["at"])
        talks = [[(t["role"], t["text"]) for t in turns] for turns in part.column("turns").to_pylist()]
        lay = Layout(Tree(talks), encoder(tokenizer), sum(x["n"] for x in above))
        trunk = part.column("trunk")[0].as_py()
        return pa.Table.from_batches([on_part(part.column("conv_id").combine_chunks(), lay, [x | {"prefix": p} for x, p in zip(above, trunk, strict=True)])])

    parts = dealt.select("part", "conv_id", "turns", "trunk").groupBy("part").cogroup(chains.groupBy("of")).applyInArrow(each, schema)
    return trunk, parts


TREES = "tree string, above array<string>, conv_ids array<long>, nodes array<array<int>>, parent array<int>, role array<string>, starts array<int>, ends array<int>, ids array<long>, position_ids array<int>, loss array<boolean>, intervals array<array<array<int>>>"


def trees(rows: DataFrame, tokenizer: str | None = None, size: int | None = None) -> DataFrame:
    """The layouts: token ids, position ids and loss mask of each tree, every node's interval and its ancestors', and the conversations' paths.

    above: the trunk trees that every token of the tree also attends to, from the root down; a trunk tree has one node and no conversations.
    """
    kinds = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.list_(pa.int32())))]
    names = [c.split()[0] for c in TREES.split(", ")]

    def values(lay: Layout) -> list:
        n = range(len(lay.tree.turn))
        return [lay.tree.paths, lay.tree.parent, [lay.tree.turn[i][0] for i in n], [lay.start[i] for i in n], [lay.end[i] for i in n], lay.ids.astype(np.int64).tolist(), lay.position.tolist(), lay.loss.tolist(), [[list(s) for s in lay.intervals[i]] for i in n]]

    def on_trunk(lay: Layout) -> tuple:
        _, parent, role, starts, ends, ids, _, loss, intervals = values(lay)
        return len(ids), role, ids, loss

    def on_part(conv_ids: pa.Array, lay: Layout, above: list[dict]) -> pa.RecordBatch:
        first = lay.tree.turn[0] if lay.tree.turn else ("", "")
        name = hashlib.sha256(repr((above and above[-1]["prefix"], conv_ids.to_pylist(), first)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
        one = [pa.array([name]), pa.array([[x["prefix"].hex() for x in above]], pa.list_(pa.string())), pa.array([conv_ids.cast(pa.int64()).to_pylist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(one + [pa.array([v], k) for v, k in zip(values(lay), kinds, strict=True)], names=names)

    trunk, parts = formatted(rows, on_trunk, "n long, role array<string>, ids array<long>, loss array<boolean>", on_part, TREES, tokenizer, size)
    # a trunk node's positions begin where those above it end
    up = trunk.select(F.col("prefix").alias("node"), "parent", "n")
    reach, at = trunk.select("prefix", F.col("parent").alias("next"), F.lit(0).alias("base"), F.array().cast("array<string>").alias("above")), 0
    while reach.filter("next is not null").limit(1).count():
        step = up.select(F.col("node").alias("next"), F.col("parent").alias("_up"), "n")
        reach, _ = stored(reach.join(step, "next", "left").select("prefix", F.col("_up").alias("next"), (F.col("base") + F.coalesce("n", F.lit(0))).cast("int").alias("base"), F.when(F.col("next").isNotNull(), F.concat(F.array(F.lower(F.hex("next"))), "above")).otherwise(F.col("above")).alias("above")), f"reach{at}")
        at += 1
    own = trunk.join(reach.drop("next"), "prefix")
    whole = own.select(
        F.lower(F.hex("prefix")).alias("tree"), "above", F.array().cast("array<long>").alias("conv_ids"), F.array().cast("array<array<int>>").alias("nodes"), F.array(F.lit(-1)).alias("parent"), "role",
        F.array(F.lit(0)).alias("starts"), F.array(F.col("n").cast("int")).alias("ends"), "ids", F.when(F.col("n") > 0, F.sequence(F.col("base"), (F.col("base") + F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("position_ids"), "loss", F.array(F.array(F.array(F.lit(0), F.col("n").cast("int")))).alias("intervals"),
    )
    return parts.unionByName(whole)


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def report(rows: DataFrame, tokenizer: str | None = None, size: int | None = None) -> DataFrame:
    """Per conversation, read back from the layouts' tokens: its turns, the text under the loss mask and the formatted length."""
    tokenizer = tokenizer or tokenizer_path()

    def read(lay: Layout) -> dict[int, tuple[str, str]]:
        whole = encoder(tokenizer).whole
        decode = lambda ids: whole.decode(ids.tolist(), skip_special_tokens=False)
        node: dict[int, tuple[str, str]] = {}
        for n in range(len(lay.tree.turn)):
            span = slice(lay.start[n], lay.end[n])
            ids, mask = lay.ids[span], lay.loss[span]
            node[n] = (decode(ids), unescape(decode(ids[mask])) if mask.any() else "")
        return node

    def on_trunk(lay: Layout) -> tuple:
        return (len(lay.ids), *read(lay)[0])

    def on_part(conv_ids: pa.Array, lay: Layout, above: list[dict]) -> pa.RecordBatch:
        node, out = read(lay), []
        before, loss_before = "".join(x["said"] for x in above), "".join(x["learned"] for x in above)
        for path in lay.tree.paths:
            text = before + "".join(node[n][0] for n in path)
            turns, loss = parse(text), loss_before + "".join(node[n][1] for n in path)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((len(turns), _sha(said), len(loss), _sha(loss), len(text)))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([conv_ids.cast(pa.int64()), *(pa.array(c) for c in columns)], names=[c.split()[0] for c in REPORT.split(", ")])

    return formatted(rows, on_trunk, "n long, said string, learned string", on_part, REPORT, tokenizer, size)[1]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def with_trap(rows: DataFrame) -> DataFrame:
    """rows plus conversation -7, whose texts hold what a template might use."""
    text = "\\### Assistant: </turn> ok"
    turn = F.col("id")
    more = rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(text).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
