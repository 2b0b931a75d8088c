"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97 for account numbers, ranges for
addresses), and words in the neighbourhood raise or lower a span's score. Base kinds keep every confirmed span whatever its
score, which stands beside it; the further kinds keep spans that score at least ``KEEP``. Positions are code points: a text is split at the
matches, and lengths of gaps and matches add up, in blocks of ``BLOCK`` so that many matches in a text take time in proportion. The patterns start only where a match can start and repeat possessively, so they take time in
proportion to the text, however long.

Defined results: a null text counts as empty and has no spans; repeated rows and null ids are returned each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table

KEEP, NEAR, BLOCK = 0.6, 40, 256
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(v: Column) -> Column:
    d = F.translate(v, " -", "")
    return F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))


def _mod97(v: Column) -> Column:
    s = F.translate(v, " ", "")
    turned = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(1, 4))
    number = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(number, F.lit(0), lambda a, n: ((a * F.when(n > 9, 100).otherwise(10) + n) % 97).cast("int")) == 1


@dataclass(frozen=True)
class Kind:
    """near: words around a span that add to its score; against: words that take from it."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    base: bool
    prior: float
    near: str
    against: str


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), True, 0.9, "mail|contact|write", "example|noreply|invalid"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), True, 0.6, r"\bip\b|address|host|server", r"version|release|\bsection\b|\bv\.?\s?$"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, True, 0.8, "card|visa|credit|pay", "order|invoice|serial|isbn|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), True, 0.7, "phone|call|tel|mobile|fax", "order|invoice|serial"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _mod97, False, 0.8, "iban|account|bank|konto|compte|cuenta", "serial|part no|order|invoice"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda v: F.lit(True), False, 0.4, "ssn|social|security", "order|invoice|part no|serial"),
)


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x computed once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _blocks(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))


def _totals(sizes: Column) -> Column:
    """Sum of what stands before each of the sizes; block by block, and the blocks' sums alike."""
    none = F.array().cast("array<int>")
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    running = lambda v, start: F.aggregate(v, F.struct(start.alias("sum"), none.alias("out")), step, lambda acc: acc["out"])
    sums = lambda b: F.transform(b, lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x))
    return _let(sizes, lambda v: _let(_blocks(v), lambda b: F.flatten(F.zip_with(b, running(sums(b), F.lit(0)), running))))


def _spans(text: Column, values: Column, kind: Kind) -> Column:
    """array<struct(kind, start, end, score, value)> of the confirmed matches ``values``."""
    shape = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"

    def one(x: Column) -> Column:
        start = x["before"] + F.length(x["gap"])
        around = F.lower(F.concat(F.right(x["gap"], F.lit(NEAR)), F.lit(" "), F.left(x["next"], F.lit(NEAR))))
        score = F.lit(kind.prior) + F.when(around.rlike(kind.near), 0.3).otherwise(0.0) - F.when(around.rlike(kind.against), 0.3).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(x["value"])).alias("end"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"), x["value"].alias("value"))

    def found(gaps: Column) -> Column:
        n = F.size(values)
        rows = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), values.alias("value"), F.slice(gaps, F.lit(2), n).alias("next"))
        placed = _let(rows, lambda r: F.zip_with(r, _totals(F.transform(r, lambda x: F.length(x["gap"]) + F.length(x["value"]))), lambda x, t: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), x["next"].alias("next"), t.alias("before"))))
        valid = F.filter(placed, lambda x: F.coalesce(kind.valid(x["value"]), F.lit(False)))
        every = F.transform(valid, one)
        return (every if kind.base else F.filter(every, lambda x: x["score"] >= KEEP)).cast(shape)

    return F.when(F.size(values) > 0, _let(F.split(text, kind.pattern, -1), found)).otherwise(F.array().cast(shape))


def with_spans(docs: DataFrame, text_col: str = "text", to: str = "pii_spans") -> DataFrame:
    """Adds the spans of all kinds, by kind and then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    names = fresh(docs, *[k.name for k in KINDS])
    matches = {n: F.when(hint.get(k.name, F.lit(True)), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, n in zip(KINDS, names, strict=True)}
    return docs.withColumns(matches).withColumn(to, F.concat(*[_spans(text, F.col(n), k) for k, n in zip(KINDS, names, strict=True)])).drop(*names)


def redacted(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """Replaces spans in the text by ``<KIND>``; of spans that overlap the one that starts first (the longer at a tie) names the place, and its replacement covers them all.

    A span opens a place if it starts at or after the greatest end before it; the text between two places stays. Blocks keep the running
    maximum linear as they do the sums above.
    """
    order = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    spans, reach = fresh(docs, "pii_order", "pii_reach")
    text = F.col(text_col)

    # Places in a text are found by counting from its start, so the text is cut into parts of about the root of its length, and a span's gap is read from two of them.
    size = F.greatest(F.lit(1024), F.ceil(F.sqrt(F.length(text)) * 4)).cast("int")
    parts = lambda size: F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int")), lambda k: text.substr(k * size + 1, size))

    def joined(parts: Column, size: Column) -> Column:
        def piece(s: Column, before: Column) -> Column:
            k, gap = F.floor(before / size).cast("int"), s["start"] - before
            two = F.concat(F.get(parts, k), F.coalesce(F.get(parts, k + 1), F.lit("")))
            kept = F.when(gap > size, text.substr(before + 1, gap)).otherwise(two.substr(before - k * size + 1, gap))
            return F.when(gap >= 0, F.concat(kept, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))

        return F.array_join(F.zip_with(spans, reach, piece), "")

    some = F.size(spans_col) > 0
    ends = _running_max(F.transform(spans, lambda s: -s["end"]))
    new = F.concat(_let(size, lambda n: _let(parts(n), lambda p: joined(p, n))), text.substr(F.array_max(F.transform(spans, lambda s: -s["end"])) + 1, F.length(text)))
    rows = docs.withColumn(spans, F.when(some, order)).withColumn(reach, F.when(some, ends))
    return rows.withColumn(text_col, F.when(F.col(spans).isNotNull(), new).otherwise(text)).drop(spans, reach)


def _running_max(ends: Column) -> Column:
    """Greatest of what stands before each of the ends, 0 at first."""
    none = F.array().cast("array<int>")
    step = lambda acc, x: F.struct(F.greatest(acc["top"], x).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out"))
    running = lambda v, start: F.aggregate(v, F.struct(start.alias("top"), none.alias("out")), step, lambda acc: acc["out"])
    return _let(ends, lambda v: _let(_blocks(v), lambda b: F.flatten(F.zip_with(b, running(F.transform(b, F.array_max), F.lit(0)), running))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    base = [k.name for k in KINDS if k.base]
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, base), F.sha2(_listed(F.filter("pii_spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"), scores.alias("scores"))


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
