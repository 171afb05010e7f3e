"""Secret scan (native): fixed patterns, plus sliding-window Shannon entropy over candidate strings.

All of it is SQL expressions on the row at hand: no shuffle, no Python on the executors.

*Patterns.* ``split`` by a pattern gives the text between its matches and ``regexp_extract_all`` the matches; the running
sum of both lengths gives code-point positions.

*Entropy.* A candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` of at least ``window`` characters. Its character class is
hex, alphanumeric or base64. A window slides over it; counts per character are kept incrementally: the entering character's
count goes up, the leaving one's down, and the sum of c*log2(c) is corrected by those two terms alone. Windows whose entropy
reaches the class's threshold are joined to spans. The allow-list suppresses candidates that are no secrets (no digit or no
letter, all words joined by separators, UUIDs) and windows with a placeholder word or a repeated character in them. It only
touches spans of the entropy method; pattern spans stay.

Defined results: a null or empty text has no spans; every input row gives one row, repeated rows included; extra columns
are ignored; a null doc_id stays null; an empty table gives no rows. Texts and runs of any length are handled whole, in time that
grows with the length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import unused

#: Fixed patterns, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Items of a text that are handled together, so that a text of many matches costs little more than its length.
BLOCK = 512
#: Characters of a stretch that masked texts are cut from.
PIECE = 1024


@dataclass(frozen=True)
class EntropyRule:
    """window: characters in a window; hex, alnum, base64: bits per character from which a window of that class is a secret; runs of words (or numbers like years) with joints between them are none."""

    window: int = 20
    hex: float = 3.0
    alnum: float = 3.6
    base64: float = 3.8
    placeholder: str = r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|(.)\1{7,}"
    uuid: str = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    word: str = r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4}"
    joint: str = "[-_/=+]+"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once: in lambdas an expression from outside would be computed anew at every step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _gathered(items: Column, zero: Column, step: Callable[[Column, Column], Column], last: Callable[[Column], Column], kind: str) -> Column:
    """array<kind>: what the steps over items add, in order. step(state, item) gives a struct of the next state v and an array a to add, last(state) the array at the end.

    Arrays grow within a block of BLOCK items and blocks are put together at the end, so that time grows with the number of items.
    """
    none = F.expr("array()").cast(f"array<{kind}>")

    def next_(acc: Column, x: Column) -> Column:
        return _bound(step(acc["v"], x), lambda y: F.struct(y["v"].alias("v"), F.when(F.size(y["a"]) > 0, F.concat(acc["a"], y["a"])).otherwise(acc["a"]).alias("a")))

    def block(acc: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(items, i * BLOCK + 1, BLOCK), F.struct(acc["v"].alias("v"), none.alias("a")), next_)
        return _bound(own, lambda x: F.struct(x["v"].alias("v"), F.when(F.size(x["a"]) > 0, F.concat(acc["a"], F.array(x["a"]))).otherwise(acc["a"]).alias("a")))

    count = F.greatest(F.ceil(F.size(items) / BLOCK).cast("int"), F.lit(1))
    start = F.struct(zero.alias("v"), F.expr("array()").cast(f"array<array<{kind}>>").alias("a"))
    return F.aggregate(F.sequence(F.lit(0), count - 1), start, block, lambda acc: F.flatten(F.concat(acc["a"], F.array(last(acc["v"])))))


def _located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches of pattern, by start."""
    kind = "struct<s:int,e:int,m:string>"
    none = F.expr("array()").cast(f"array<{kind}>")

    def step(at: Column, x: Column) -> Column:
        s, e = at + x["g"], at + x["g"] + x["n"]
        return F.struct(e.alias("v"), F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("a"))

    def places(pair: Column) -> Column:
        zipped = F.zip_with(F.slice(pair["gaps"], 1, F.size(pair["found"])), pair["found"], lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
        return _bound(zipped, lambda z: _gathered(z, F.lit(0), step, lambda at: none, kind))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    return F.when(text.rlike(pattern), _bound(both, places)).otherwise(none)


def _windows(word: Column, window: int, least: Column, quiet: str) -> Column:
    """array<struct<s, e>>: joined windows of word whose entropy is at least ``least`` bits, by incremental counts, but those that have ``quiet`` in them."""

    def flog(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(F.lit(0.0))

    def slid(x: Column) -> Column:
        chars, which, enough = x["chars"], x["which"], x["least"]
        none = F.expr("array()").cast("array<struct<s:int,e:int>>")
        #: counts, the sum of c * log2(c), and the span that may still grow; s is -1 where there is none
        zero = F.struct(F.array_repeat(F.lit(0), F.array_max(which).cast("int")).alias("n"), F.lit(0.0).alias("t"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))

        def step(v: Column, i: Column) -> Column:
            came = F.element_at(which, i)
            went = F.when(i > window, F.element_at(which, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            up = F.element_at(v["n"], came)
            down = F.when(went > 0, F.element_at(v["n"], F.greatest(went, F.lit(1)))).otherwise(F.lit(0))
            total = F.when(came == went, v["t"]).otherwise(v["t"] + flog(up + 1) - flog(up) + F.when(went > 0, flog(down - 1) - flog(down)).otherwise(F.lit(0.0)))
            counts = F.when(came == went, v["n"]).otherwise(F.transform(v["n"], lambda c, j: c + F.when(j + 1 == came, 1).otherwise(0) - F.when(j + 1 == went, 1).otherwise(0)))
            said = F.array_join(F.slice(chars, F.greatest(i - window + 1, F.lit(1)), F.lit(window)), "")

            def judged(y: Column) -> Column:
                hot = F.when((i >= window) & (F.log2(F.lit(float(window))) - y["t"] / window >= enough), ~said.rlike(quiet)).otherwise(F.lit(False))
                return F.struct(y["n"].alias("n"), y["t"].alias("t"), hot.alias("hot"))

            def grown(y: Column) -> Column:
                opens = y["hot"] & (v["e"] < i - window)
                own = F.struct(y["n"].alias("n"), y["t"].alias("t"), F.when(opens, (i - window).cast("int")).otherwise(v["s"]).alias("s"), F.when(y["hot"], i.cast("int")).otherwise(v["e"]).alias("e"))
                return F.struct(own.alias("v"), F.when(opens & (v["s"] >= 0), F.array(F.struct(v["s"].alias("s"), v["e"].alias("e")))).otherwise(none).alias("a"))

            return _bound(F.struct(counts.alias("n"), total.alias("t")), lambda y: _bound(judged(y), grown))

        def last(v: Column) -> Column:
            return F.when(v["s"] >= 0, F.array(F.struct(v["s"].alias("s"), v["e"].alias("e")))).otherwise(none)

        return _bound(F.sequence(F.lit(1), F.size(chars)), lambda places: _gathered(places, zero, step, last, "struct<s:int,e:int>"))

    known = F.transform(F.array(F.split(word, "")), lambda c: F.struct(c.alias("chars"), F.array_distinct(c).alias("kinds")))
    numbered = F.transform(known, lambda x: F.struct(x["chars"].alias("chars"), F.transform(x["chars"], lambda c: F.array_position(x["kinds"], c).cast("int")).alias("which"), least.alias("least")))
    return F.flatten(F.transform(numbered, slid))


def _entropy_spans(text: Column, rule: EntropyRule) -> Column:
    def spans(c: Column) -> Column:
        word = c["m"]
        kind = F.when(word.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "entropy_hex").when(word.rlike("^[A-Za-z0-9]+$"), "entropy_alnum").otherwise("entropy_base64")
        least = F.when(kind == "entropy_hex", rule.hex).when(kind == "entropy_alnum", rule.alnum).otherwise(rule.base64)
        return F.transform(_windows(word, rule.window, least, rule.placeholder), lambda w: F.struct(kind.alias("kind"), (c["s"] + w["s"]).alias("s"), (c["s"] + w["e"]).alias("e")))

    def suspect(c: Column) -> Column:
        word = c["m"]
        # by parts: Java's regular expressions walk a repeated group by recursion, which a long run takes beyond the stack
        joined = _bound(F.split(word, rule.joint, -1), lambda parts: F.forall(parts, lambda x: x.rlike(f"^({rule.word})$") | (x == "")) & (F.element_at(parts, 1) != ""))
        return word.rlike("[0-9]") & word.rlike("[A-Za-z]") & ~joined & ~word.rlike(rule.uuid)

    pattern = CANDIDATE % rule.window
    none = F.expr("array()").cast("array<struct<kind:string,s:int,e:int>>")
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.filter(_located(text, pattern), suspect), spans))).otherwise(none)


def _base_spans(text: Column) -> Column:
    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    assign = F.filter(_located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
    return F.concat(of("assign", assign), of("access", _located(text, ACCESS)), of("hex", _located(text, HEX)))


def _written(spans: Column) -> Column:
    """kind:start:end by start, then by the order of the kinds."""
    order = F.array(*map(F.lit, KINDS))
    by = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.array_position(order, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(by, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", rule: EntropyRule = EntropyRule(), base: str = "base", found: str = "found") -> DataFrame:
    """docs with two columns (array<struct<kind, s, e>>; end exclusive, in code points): pattern spans, and all spans. Columns of docs that have these names give way."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (base, found)]
    with_base = docs.select(*kept, _base_spans(whole).alias(base))
    return with_base.withColumn(found, F.concat(base, _entropy_spans(whole, rule)))


def secret_report(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """One row per row of docs: counts by kind, a digest of the pattern spans and all spans as text."""
    found = scan_secrets(docs.select("doc_id", "text"), "text", rule)
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """docs with every found span (overlapping ones joined) replaced by mask; n_chars, where there is such a column, follows.

    Texts without a span stay as they are, null and empty ones too; every row gives one row, repeated ones and those with a null id
    included; an empty table gives no rows. Columns with the names of helpers are kept.
    """
    base, all_ = unused(docs, "_base_spans"), unused(docs, "_found_spans")
    found = scan_secrets(docs, "text", rule, base, all_)
    spans = F.array_sort(F.transform(all_, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    def masked(pieces: Column) -> Column:
        """pieces: the text in stretches of PIECE characters, so that a cut costs its own length and not its place."""

        def cut(at: Column, to: Column) -> Column:
            first = F.floor(at / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor(to / PIECE).cast("int") - first + 1), "")
            return F.substring(some, at - first * PIECE + 1, F.greatest(to - at, F.lit(0)))

        def step(at: Column, x: Column) -> Column:
            piece = F.when(x["s"] >= at, F.array(cut(at, x["s"]), F.lit(mask))).otherwise(F.expr("array()").cast("array<string>"))
            return F.struct(F.greatest(at, x["e"]).alias("v"), piece.alias("a"))

        return F.array_join(_bound(spans, lambda each: _gathered(each, F.lit(0), step, lambda at: F.array(cut(at, F.size(pieces) * PIECE)), "string")), "")

    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PIECE}}}"), 0)
    text = F.when(F.size(all_) > 0, F.element_at(F.transform(F.array(pieces), masked), 1)).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(all_) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))
