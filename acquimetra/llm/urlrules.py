"""URL filtering: curated host-and-path rules first, association rules mined from labelled URLs for the rest.

A URL becomes a set of tokens (host labels and their words, path segments with numbers folded, extension, query keys,
scheme). Spark's FP-growth mines token sets that occur with a label; rules below the least support or confidence are pruned.
Tokens that always occur together stand for each other, and a token whose rows all have one label is a rule by itself that no longer one can better, so it stays
out of the baskets; all others are mined, whatever the length of a URL. Sets still multiply where URLs share many tokens that often, but not always, occur
together; a caller may then cut baskets to their ``most`` telling tokens, which the query doesn't. A rule with a part that leads to the same verdict at no less confidence is pruned. Matching goes through an inverted index: rules stand under their
rarest token and are met there by the distinct token sets of the URLs, so a hot host is met once. The rule with the highest confidence (then support, size, tokens) decides.

Defined results: of tokens that always occur together the first in order stands in the rules; a null URL or one without ``://`` has empty host and path, no rule, and the default verdict; repeated rows are
each judged; where nothing is labelled, all get the default; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop, table

MOST = 10  # tokens of a basket, for callers who want a bound
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The curated rules (host/path, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict) to rows with host and path; rules: (rule, verdict). The longest fitting rule wins.

    Distinct hosts meet the rules by their suffixes; each row then picks among its host's rules.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = rules.select(F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("under"), "rule", "verdict")
    fits = pages.where("host <> ''").select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(known, "suffix")
    of_host = fits.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "verdict", "under")).alias("fits"))
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["under"])))
    return pages.join(of_host, "host", "left").withColumn("best", best).withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.verdict")}).drop("fits", "best")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    tag = lambda k, a: F.transform(a, lambda x: F.concat(F.lit(k), x))
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    folded = F.transform(segments, lambda x: F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""), "[0-9]+", "#"))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,6})$", 1)
    every = F.concat(
        tag("h:", labels), tag("w:", F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))), tag("p:", folded), tag("q:", keys),
        F.when(extension != "", F.array(F.concat(F.lit("x:"), extension))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def baskets(labelled: DataFrame, share: float, most: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """labelled: (key, tokens, label, n), a row for each distinct token set and label with the number of its rows.

    Returns (tokens, label, n) of all rows with the tokens that occur with more than one label, (token, total, only) of the tokens in the share ``share`` of the rows,
    ``only`` being the label of a token that has but one, and the number of labelled rows. Of tokens in the very same sets the first stays. With ``most``, baskets keep so
    many tokens whose rows' labels differ most from all rows' labels, weighed by their number.
    """
    rows = labelled.where("label is not null and size(tokens) > 0")
    labels = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # verdicts: a handful
    n = sum(labels.values())
    if not n:
        return rows.select("tokens", "label", "n").limit(0), rows.select(F.explode("tokens").alias("token"), F.lit(0).cast("long").alias("total"), F.col("label").alias("only")).limit(0), 0
    each = rows.select("key", "label", "n", F.explode("tokens").alias("token"))
    tell = sum((F.abs(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) - F.sum("n") * (m / n)) for k, m in labels.items()), F.lit(0.0))
    stats = each.groupBy("token").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets"), F.bit_xor(F.xxhash64("key", "label")).alias("mark"), F.when(F.min("label") == F.max("label"), F.min("label")).alias("only"), tell.alias("tell")).where(F.col("total") >= share * n)
    known = stats.groupBy("total", "sets", "mark").agg(F.min("token").alias("token"), F.max("tell").alias("tell"), F.min("only").alias("only"))
    known, _ = cut(known.select("token", "total", "tell", "only"), "url-tokens")
    met = each.join(known.where("only is null"), "token").groupBy("key", "label").agg(F.array_sort(F.collect_list(F.struct((-F.col("tell")).alias("tell"), "token"))).alias("all"))
    kept = F.coalesce((F.col("all") if most is None else F.slice("all", 1, most))["token"], F.array().cast("array<string>"))
    return rows.join(met, ["key", "label"], "left").select(F.array_sort(kept).alias("tokens"), "label", "n"), known.select("token", "total", "only"), n


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, least: int = 20, most: int | None = None) -> DataFrame:
    """labelled: (key, tokens, label, n) as for ``baskets``. Returns rules (rule_id, tokens, verdict, confidence, support, rare) that lead to a label.

    A rule's tokens have to occur with its label in the share ``min_support`` of the labelled rows and ``least`` times; rare is the one with the fewest rows. most: as for ``baskets``.
    """
    shape = "rule_id string, tokens array<string>, verdict string, confidence double, support double, rare string"
    kept, known, n = baskets(labelled, min_support, most)
    if not n:
        return labelled.sparkSession.createDataFrame([], shape)
    # FP-growth counts rows, so each basket stands there once a row.
    items = kept.select(F.concat("tokens", F.array(F.concat(F.lit("label="), "label"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")
    support = min(1.0, max(min_support, least / n))
    model = FPGrowth(itemsCol="items", minSupport=support).fit(items)
    sets, path = cut(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_label = sets.select(F.filter("items", lambda x: ~x.startswith("label=")).alias("tokens"), F.expr("substring(get(filter(items, x -> startswith(x, 'label=')), 0), 7)").alias("verdict"), F.col("freq").alias("both"))
    rules = (
        with_label.where("verdict is not null and size(tokens) > 0")
        .join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens")
        .select(F.array_join("tokens", " ").alias("rule_id"), "tokens", "verdict", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / F.lit(float(n))).alias("support"))
        .where(F.col("confidence") >= min_confidence)
    )
    sure = known.where(F.col("only").isNotNull() & (F.col("total") >= math.ceil(support * n)))
    rules = rules.union(sure.select(F.col("token").alias("rule_id"), F.array("token").alias("tokens"), F.col("only").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("total") / F.lit(float(n))).alias("support")))
    parts = rules.select("rule_id", "verdict", "confidence", F.explode(F.transform("tokens", lambda x: F.array_join(F.array_remove("tokens", x), " "))).alias("part"))
    less = rules.select(F.col("rule_id").alias("part"), "verdict", F.col("confidence").alias("known"))
    needless = parts.join(less, ["part", "verdict"]).where("known >= confidence").select("rule_id", "verdict").distinct()
    rare = rules.select("rule_id", F.explode("tokens").alias("token")).join(known, "token").groupBy("rule_id").agg(F.min(F.struct("total", "token"))["token"].alias("rare"))
    out, _ = cut(rules.join(needless, ["rule_id", "verdict"], "left_anti").join(rare, "rule_id").select(*[c.split()[0] for c in shape.split(", ")]), "url-rules")
    drop(labelled.sparkSession, path)
    return out


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets: distinct (key, tokens). Returns (key, mined, confidence, verdict) of the best rule each, by inverted index."""
    index = rules.select(F.col("rare").alias("token"), "rule_id", F.col("tokens").alias("asked"), "verdict", "confidence", "support")
    hits = sets.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("asked", "tokens")) == 0)
    best = hits.groupBy("key").agg(F.max(F.struct("confidence", "support", F.size("asked").alias("n"), "rule_id", "verdict")).alias("b"))
    return best.select("key", F.col("b.rule_id").alias("mined"), F.col("b.confidence").alias("confidence"), F.col("b.verdict").alias("mined_verdict"))


def judge(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None, min_support: float = 0.01, min_confidence: float = 0.8, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every row. labels: (url, label), each URL once; without it the URLs that a curated rule judges are the labelled ones."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = curated(rows, rules).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("key", F.xxhash64("tokens"))
    rows, _ = cut(rows.join(labels.select("url", "label"), "url", "left") if labels is not None else rows.withColumn("label", F.col("ruled")), "urls")
    seen = rows.groupBy("key", "label", F.col("rule").isNull().alias("open")).agg(F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    mined = mine(seen.groupBy("key", "label").agg(F.any_value("tokens").alias("tokens"), F.sum("n").alias("n")), min_support, min_confidence, most=most)
    sets = seen.where("open").groupBy("key").agg(F.any_value("tokens").alias("tokens"))
    return rows.join(matched(sets, mined), "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "mined_verdict", F.lit(default)).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence")
    )


def op4_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


QUERIES = {"op4_urlrules": op4_urlrules}
ORACLES: dict[str, str] = {}
