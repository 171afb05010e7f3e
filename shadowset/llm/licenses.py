"""Licence scan (native): a paragraph classifier on sparse word n-grams, with a calibrated unknown class and template comparison.

*Training* happens on the driver, from the fixed texts of ``licence_texts``: licence paragraphs, the names of licences in the
sentences that notices are made of, and as "unknown" other licences' names in the same sentences and ordinary sentences with the
same words, each with seeded variants (words left out, other words around). Multinomial logistic regression over one- and
two-word n-grams, weights below SMALL cut to nothing. A temperature and how much "unknown" is favoured are set on wordings, and
on licences of no family, that were not trained on, so that a probability says how often it is right on unseen text.

*Keys.* N-grams without a key word (``license``, ``gnu``, ``cc``, ...) are trained under the constraint that they never speak more
for a family than for "unknown". So a paragraph without any key is unknown for certain and need not be scored.

*Scanning* is SQL expressions on the row at hand. A line of WRAPPED characters and more that does not end a sentence goes on in the
next one, without the marks of a comment, until a blank line; the lines so joined are cut at sentence ends, however long they are.
N-gram weights are summed per class, softmax gives probabilities. A family with at least ``least`` probability is confirmed by
comparing the paragraph's n-grams with the family's paragraphs and with the sentences that notices name it in (a bare name confirms
nothing): the largest share of a text's (or, for a shorter paragraph, the paragraph's) n-grams, LEAST at least, must reach
``alike``, and the paragraph must not say ``not licensed`` or the like where the text does not. What is not confirmed is unknown.

Defined results: null, empty and notice-free texts have no findings; every input row gives one row, repeated rows included;
a null doc_id stays null; extra columns are ignored; long texts are scanned whole; paragraphs that repeat are findings of
their own; families of equal probability go by name.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shadowset.llm.licence_texts import FRAMES, HELD, KEY_PAIRS, KEYS, NAMES, OTHER_NAMES, OTHERS, PARAGRAPHS

CLASSES = (*sorted(PARAGRAPHS), "unknown")
WORD = r"[A-Za-z0-9][A-Za-z0-9.+]*[A-Za-z0-9]|[A-Za-z0-9]"
SENTENCE = r"(?<=[.!?])\s+"
SMALL = 0.02
WRAPPED, LEAST = 40, 5
#: A line that goes on in the next one (each line is looked at once, at its begin or where the one before it was joined to it).
UNWRAP = rf"(?m)(?:^|\G)([^\r\n]{{{WRAPPED},}}+)(?<![.!?:;])(?:\r\n|\r|\n)[ \t]*(?:[#*/;%>-]+[ \t]+)?(?=\S)"
#: Pairs of words by which a paragraph says that something is not so licensed.
DENIED = "^(not|never|nor|longer) (licensed|licenced|released|distributed|available|covered|governed|subject|under|shared|published)$"


def _keys() -> str:
    """A pattern that a paragraph with a key has: key words by first characters, and key pairs with whatever parts words."""
    words = {k for k in KEYS if "-" not in k}
    heads = sorted({w[0] for w in words})
    single = "|".join(f"{h}(?:{'|'.join(sorted(re.escape(w[1:]) for w in words if w[0] == h))})" for h in heads)
    pairs = "|".join("[^A-Za-z0-9]+".join(p.split()) for p in KEY_PAIRS)
    return rf"(?i)(?<![a-z0-9])(?:{single}|{pairs})(?![a-z0-9])"


#: A paragraph is scored if it has this.
GATE = _keys()


def grams(text: str) -> list[str]:
    w = [x.lower() for x in re.findall(WORD, text)]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def templates() -> dict[str, list[str]]:
    """The texts of each family: paragraphs, and the sentences of notices with its names."""
    return {k: [*PARAGRAPHS[k], *(f.format(n) for n in NAMES.get(k, ()) for f in FRAMES)] for k in PARAGRAPHS}


def compared() -> dict[str, list[str]]:
    """The texts of each family that paragraphs are compared with: all but bare names."""
    return {k: [t for t in texts if t not in NAMES.get(k, ())] for k, texts in templates().items()}


def _has_key(gram: str) -> bool:
    return bool(re.search(GATE, gram))


def _variants(text: str, n: int, rnd: random.Random) -> list[str]:
    out = [text]
    for _ in range(n - 1):
        w = [x for x in text.split() if rnd.random() > 0.12] or text.split()
        pad = rnd.choice(OTHERS).split()
        out.append(" ".join([*rnd.sample(pad, rnd.choice((0, 0, 2))), *w, *rnd.sample(pad, rnd.choice((0, 0, 2)))]))
    return out


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache
def model(seed: int = 1) -> tuple[dict[str, list[float]], list[float]]:
    """Weights of each n-gram per class, and the biases, both divided by the temperature."""
    rnd = random.Random(seed)
    texts = templates() | {"unknown": [*OTHERS, *OTHERS, *OTHERS, *(f.format(n) for n in OTHER_NAMES for f in FRAMES)]}
    vocabulary = {g: i for i, g in enumerate(sorted({g for name in CLASSES for t in texts[name] for g in grams(t)}))}
    free = np.array([_has_key(g) for g in vocabulary])[:, None]

    def row(text: str) -> np.ndarray:
        x = np.zeros(len(vocabulary), np.float32)
        x[[vocabulary[g] for g in set(grams(text)) & vocabulary.keys()]] = 1
        return x

    rows = [(row(v), k, len(texts[name])) for k, name in enumerate(CLASSES) for t in texts[name] for v in _variants(t, 4, rnd)]
    x, y = np.array([r[0] for r in rows]), np.eye(len(CLASSES), dtype=np.float32)[[r[1] for r in rows]]
    share = np.array([1 / r[2] for r in rows], np.float32)
    share[y[:, -1] > 0] *= len(CLASSES) - 1
    share = (share / share.sum())[:, None]  # every family counts alike, and "unknown" as much as all of them
    w, b = np.zeros((len(vocabulary), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(300):
        d = (_soft(x @ w + b) - y) * share
        mw, mb = 0.9 * mw + x.T @ d + 2e-5 * w, 0.9 * mb + d.sum(axis=0)
        w, b = w - 2.0 * mw, b - 2.0 * mb
        w[:, :-1] = np.where(free, w[:, :-1], np.minimum(w[:, :-1], w[:, -1:]))
        b[:-1] = np.minimum(b[:-1], b[-1] - 0.1)
    w[np.abs(w - w[:, -1:]).max(axis=1) < SMALL] = 0
    held_x, held_y = np.array([row(t) for _, t in HELD]), np.eye(len(CLASSES))[[CLASSES.index(k) for k, _ in HELD]]
    lean = np.eye(len(CLASSES))[-1]
    loss = lambda heat, more: -float(np.log((_soft((held_x @ w + b + more * lean) / heat) * held_y).sum(axis=1) + 1e-12).mean())
    heat, more = min(((t, m) for t in np.geomspace(0.2, 5, 40) for m in np.linspace(0, 3, 13)), key=lambda c: loss(*c))
    w, b = w / heat, (b + more * lean) / heat
    return {g: [round(float(v), 4) for v in w[i]] for g, i in vocabulary.items() if w[i].any()}, [round(float(v), 4) for v in b]


def classify(text: str) -> tuple[str, float]:
    """The plain form of a paragraph's classification, for single texts."""
    weights, z = model()[0], list(model()[1])
    for g in sorted(set(grams(text)) & weights.keys()):
        z = [a + b for a, b in zip(z, weights[g], strict=True)]
    p = [math.exp(v - max(z)) for v in z]
    k = max(range(len(p)), key=lambda i: (p[i], -i))
    return CLASSES[k], p[k] / sum(p)


def _grams(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(text), F.lit(WORD.replace("A-Z", "")), 0)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(w, pairs))


def _paragraphs(text: Column) -> Column:
    lines = F.filter(F.split(F.regexp_replace(text, UNWRAP, "$1 "), r"[\r\n]+"), lambda x: x.rlike(GATE))
    return F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE))), lambda x: x.rlike(GATE))


def scan_licenses(docs: DataFrame, text: str = "text", least: float = 0.5, alike: float = 0.6) -> DataFrame:
    """docs with ``findings``: array<struct<family, probability, similarity, confirmed, paragraph>>, one for each scored paragraph, in order."""
    weights, bias = model()
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")
    notices = F.from_json(F.lit(json.dumps({k: [sorted(set(grams(t))) for t in v] for k, v in compared().items()})), "map<string,array<array<string>>>")
    names = F.array(*map(F.lit, CLASSES))

    def scores(g: Column) -> Column:
        known = F.array_sort(F.filter(g, lambda x: F.map_contains_key(table, x)))
        return F.aggregate(known, F.array(*map(F.lit, bias)), lambda acc, x: F.zip_with(acc, F.element_at(table, x), lambda a, b: a + b))

    def finding(p: Column) -> Column:
        return F.struct(p.alias("paragraph"), _grams(p).alias("grams"))

    def scored(x: Column) -> Column:
        return F.struct(x["paragraph"].alias("paragraph"), x["grams"].alias("grams"), scores(x["grams"]).alias("z"))

    def judged(x: Column) -> Column:
        z = x["z"]
        top = F.array_max(z)
        family = F.element_at(names, F.array_position(z, top).cast("int"))
        probability = 1 / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        denied = lambda n: F.exists(x["grams"], lambda g: g.rlike(DENIED) & ~F.array_contains(n, g))
        share = lambda n: F.when(denied(n), 0.0).otherwise(F.size(F.array_intersect(n, x["grams"])) / F.greatest(F.least(F.size(n), F.size(x["grams"])), F.lit(LEAST)))
        similar = F.when((family != "unknown") & (probability >= least), F.array_max(F.transform(F.try_element_at(notices, family), share))).otherwise(0.0)
        return F.struct(family.alias("family"), probability.alias("probability"), similar.alias("similarity"), ((family != "unknown") & (probability >= least) & (similar >= alike)).alias("confirmed"), x["paragraph"].alias("paragraph"))

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.expr("array()").cast("array<struct<family:string,probability:double,similarity:double,confirmed:boolean,paragraph:string>>")
    found = F.transform(F.transform(F.transform(_paragraphs(whole), finding), scored), judged)
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "findings"), F.when(whole.rlike(GATE), found).otherwise(none).alias("findings"))


def license_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: how many paragraphs were scored and confirmed, the confirmed families, and the most probable one."""
    found = scan_licenses(docs.select("doc_id", "text"))
    good = F.filter("findings", lambda x: x["confirmed"])
    best = F.try_element_at(F.array_sort(F.transform(good, lambda x: F.struct((-x["probability"]).alias("p"), x["family"].alias("family")))), F.lit(1))
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_scored"),
        F.size(good).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(good, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(best["family"], F.lit("unknown")).alias("family"),
        F.round(-best["p"], 6).alias("probability"),
    )
