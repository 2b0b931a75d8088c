"""Records of one act in several systems, found by eight keys of falling worth.

All keys of all records meet in one join; before it, records of a system that share a key become one row, so that a key with many records on both sides does not multiply them.
Only keys and names of records go through it; what the few matches are compared by is fetched afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acquimetra.functions.text import digits_only

# Keys in order with their scores, the system that is preferred, a control number's form, and how far values may lie apart.
RULES = (
    ("pncp_number_exact", 1.0), ("process_number_orgao_cnpj", 0.95), ("process_number_year_modalidade", 0.90), ("contract_number_orgao_cnpj", 0.88),
    ("edital_number_year_orgao_cnpj", 0.85), ("edital_number_year_orgao_name", 0.80), ("compras_sc_id_crosswalk", 0.92), ("deterministic_hash", 0.75),
)
PREFERRED, CONTROL, APART, APART_SHARE = "pncp", r"\b[0-9]{14}-[0-9]{1,2}-[0-9]{1,7}/[0-9]{4}\b", 1.0, 0.01
FIELDS = ("pncp_number", "process_number", "contract_number", "edital_number", "year", "modality", "agency_cnpj", "agency_name", "sc_id")
COMPARED = ("status", "published", "value", "agency_cnpj")


def _joined(*parts: str) -> Column:
    """The parts joined; null if one is null or empty."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & (F.coalesce(F.col(p).cast("string"), F.lit("")) != "")
    return F.when(whole, F.concat_ws("|", *[F.col(p).cast("string") for p in parts]))


def keys(probe: bool) -> list[Column]:
    """The eight keys; as a probe a record with a tax id is not looked for by its agency's name."""
    name = _joined("edital_number", "year", "agency_name")
    whole = _joined("agency_cnpj", "process_number", "year", "modality")
    hashed = F.concat_ws("|", digits_only(F.col("agency_cnpj")), "process_number", F.col("year").cast("string"), "modality")  # as it is: it is shorter than its hash
    return [
        F.when(F.col("pncp_number").rlike(CONTROL) & ~F.lower(F.trim("pncp_number")).startswith("sc-"), F.col("pncp_number")), _joined("process_number", "agency_cnpj"), _joined("process_number", "year", "modality"), _joined("contract_number", "agency_cnpj"),
        _joined("edital_number", "year", "agency_cnpj"), F.when(F.coalesce(F.col("agency_cnpj"), F.lit("")) == "", name) if probe else name, _joined("sc_id"), F.when(whole.isNotNull(), hashed),
    ]


def _keyed(records: DataFrame, probe: bool, *cols: Column | str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("rule"), k.alias("key")) for i, k in enumerate(keys(probe))])
    return records.select(*cols, F.explode(F.filter(each, lambda x: x["key"].isNotNull())).alias("_k")).select("*", "_k.rule", "_k.key").drop("_k")


def conflicts(a: Column, b: Column) -> Column:
    """Kinds of what two records (structs of ``COMPARED``) disagree on, where both say something."""
    va, vb = a["value"].cast("double"), b["value"].cast("double")
    far = (F.abs(va - vb) > APART) & (F.abs(va - vb) / F.greatest(F.abs(va), F.abs(vb), F.lit(1e-9)) > APART_SHARE)
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    ca, cb = a["agency_cnpj"], b["agency_cnpj"]
    found = F.array(
        F.when(some(a["status"]) & some(b["status"]) & (a["status"] != b["status"]), "status_divergence"), F.when(a["published"] != b["published"], "date_divergence"), F.when(far, "value_divergence"),
        F.when(some(ca) & some(cb) & (F.left(ca, F.lit(8)) != F.left(cb, F.lit(8))), "cnpj_conflict"),
    )
    return F.array_compact(found)


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, rule, score, match, match_system, candidates, conflicts, review) of every record of ``left``; null where nothing is found.

    Records: (id, system, ``FIELDS``, ``COMPARED``). Candidates are records of other systems; the first key that has any decides, and of these a record of ``PREFERRED`` and then the
    least id is the match. Several candidates, serious conflicts, or two of any kind, ask for review. Repeated ids of ``right`` count once, by the least of their rows; so do those of ``left`` for conflicts.
    """
    body = F.struct(*COMPARED)
    one = right.groupBy("id", "system").agg(F.min(F.struct(*[F.col(c) for c in dict.fromkeys((*FIELDS, *COMPARED))])).alias("r")).select("id", "system", "r.*")
    held = _keyed(one, False, "id", "system").groupBy("rule", "key", "system").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    probes = _keyed(left, True, "id", F.col("system").alias("own"))
    met = probes.join(held, ["rule", "key"]).where("system <> own")
    place = F.struct((F.col("system") != PREFERRED).alias("other"), F.col("least").alias("id"), "system")
    found = met.select("id", "rule", "n", place.alias("place")).repartition("id").groupBy("id", "rule").agg(F.sum("n").alias("candidates"), F.min("place").alias("first"))
    best = found.groupBy("id").agg(F.min_by(F.struct("rule", "candidates", "first"), "rule").alias("m")).select(F.col("id").alias("_id"), "m.*")
    bodies = one.select(F.col("id").alias("_rid"), F.col("system").alias("_rsystem"), body.alias("b"))
    best = best.join(bodies, (F.col("first.id") == F.col("_rid")) & (F.col("first.system") == F.col("_rsystem"))).drop("_rid", "_rsystem")
    names, scores = F.array(*[F.lit(n) for n, _ in RULES]), F.array(*[F.lit(s) for _, s in RULES])
    kinds = F.concat(conflicts(F.col("a"), F.col("b")), F.when(F.col("candidates") > 1, F.array(F.lit("ambiguous_match"))).otherwise(F.array().cast("array<string>")))
    serious = F.exists("conflicts", lambda c: c.isin("cnpj_conflict", "value_divergence", "status_divergence", "ambiguous_match")) | (F.size("conflicts") >= 2)
    rows = left.groupBy("id").agg(F.min(body).alias("a")).join(best, F.col("id") == F.col("_id"), "left")
    rows = rows.select("id", F.get(names, "rule").alias("rule"), F.get(scores, "rule").alias("score"), F.col("first.id").alias("match"), F.col("first.system").alias("match_system"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("rule").isNotNull(), kinds).alias("conflicts"))
    return rows.withColumn("review", F.when(F.col("rule").isNotNull(), serious))
