"""What a firm's contracts say about a notice, how notices hang together, and what becomes of returns if things go otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acquimetra.functions.text import tokens
from acquimetra.sources.tables import checkpointed

# Least similarity of the tiers, words that a beginning has, contracts shown.
HIGH, MIDDLE, BEGINNING, SHOWN = 0.50, 0.30, 4, 5
# Dimensions of a risk with the weight that stands for an absent one, scores that recommend, ceilings of gates, and how far a weight is moved.
DIMENSIONS, USUAL, PARTICIPATE, ASSESS, MOVE = ("hab", "fin", "geo", "prazo", "comp"), 0.2, 60, 30, 0.10
CEILINGS = (("prazo", 20), ("financeiro", 25), ("habilitacao", 30))


def _sets(df: DataFrame, id_col: str, owner: str, text_col: str) -> DataFrame:
    """(owner, words, begin, n, ids): different texts of an owner by word set and beginning, how many rows have each, and the least five ids."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    begin = F.when(F.size(parts) >= BEGINNING, F.array_join(F.slice(parts, 1, BEGINNING), " "))
    rows = df.where(F.trim(text) != "").select(F.col(owner).alias("owner"), F.col(id_col).alias("id"), F.array_sort(tokens(text)).alias("words"), begin.alias("begin"))
    ranked = rows.withColumn("at", F.row_number().over(W.partitionBy("owner", "words", "begin").orderBy("id")))  # only ids are kept, and of them the first few
    few = ranked.where(F.col("at") <= SHOWN).groupBy("owner", "words", "begin").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    counts = rows.groupBy("owner", "words", "begin").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("c.owner").eqNullSafe(F.col("f.owner")) & (F.col("c.words") == F.col("f.words")) & F.col("c.begin").eqNullSafe(F.col("f.begin"))
    return counts.alias("c").join(few.alias("f"), same).select("c.owner", "c.words", "c.begin", "c.n", "f.ids")


def similar_contracts(notices: DataFrame, contracts: DataFrame, id_col: str, contract_id: str, owner: str, text_col: str) -> DataFrame:
    """(id, status, n_high, n_middle, best) of every notice, against the contracts of the same owner.

    A pair is high at a Jaccard similarity of ``HIGH`` of its words, or if both begin with the same ``BEGINNING`` words, middle at ``MIDDLE``. best lists
    the five most alike contracts (similarity of two digits, a shared beginning counting as ``HIGH`` at least; ties by id). Only different texts are compared: sets so alike share one of their
    rarer words, or a beginning. Notices or contracts without text, and those of an unknown owner, are like none.
    """
    left = checkpointed(_sets(notices.where(F.col(owner).isNotNull()), id_col, owner, text_col).withColumn("l", F.monotonically_increasing_id()))
    right = checkpointed(_sets(contracts.where(F.col(owner).isNotNull()), contract_id, owner, text_col).withColumn("r", F.monotonically_increasing_id()))
    word = lambda df, k: df.select("owner", F.col(k).alias("k"), F.size("words").alias("size"), F.explode("words").alias("w"))
    both = word(left, "l").select("owner", "w").union(word(right, "r").select("owner", "w"))
    rarity = both.groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def probes(df: DataFrame, k: str) -> DataFrame:
        o = word(df, k).join(rarity, "w").groupBy("owner", "k", "size").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
        return o.select("owner", F.col("k").alias(k), F.explode(F.slice("o.w", F.lit(1), (F.col("size") - F.ceil(F.col("size") * MIDDLE - 1e-9) + 1).cast("int"))).alias("w"))

    by_word = probes(left, "l").join(probes(right, "r"), ["owner", "w"]).select("l", "r")
    begun = lambda df, k: df.where("begin is not null").select("owner", "begin", k)
    pairs = by_word.union(begun(left, "l").join(begun(right, "r"), ["owner", "begin"]).select("l", "r")).distinct()
    x = left.select("l", F.col("words").alias("lw"), F.col("begin").alias("lb"))
    y = right.select("r", F.col("words").alias("rw"), F.col("begin").alias("rb"), F.col("n").alias("m"), F.col("ids").alias("of"))
    met = pairs.join(x, "l").join(y, "r")
    shared, all_ = F.size(F.array_intersect("lw", "rw")), F.size(F.array_union("lw", "rw"))
    sim = F.when(F.least(F.size("lw"), F.size("rw")) == 0, 0.0).otherwise(shared / F.greatest(all_, F.lit(1)))
    alike = F.coalesce(F.col("lb") == F.col("rb"), F.lit(False))
    met = met.select("l", "m", "of", sim.alias("sim"), alike.alias("alike")).withColumn("high", F.col("alike") | (F.col("sim") >= HIGH)).where(F.col("high") | (F.col("sim") >= MIDDLE))
    shown = F.round(F.when(F.col("alike"), F.greatest("sim", F.lit(HIGH))).otherwise(F.col("sim")), 2)
    each = met.select("l", shown.alias("similarity"), F.explode("of").alias("contract"))
    top = each.withColumn("at", F.row_number().over(W.partitionBy("l").orderBy(F.desc("similarity"), "contract"))).where(F.col("at") <= SHOWN)
    best = top.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("at", "contract", "similarity"))).alias("best"))
    sums = met.groupBy("l").agg(F.sum(F.when(F.col("high"), F.col("m")).otherwise(0)).alias("n_high"), F.sum(F.when(F.col("high"), 0).otherwise(F.col("m"))).alias("n_middle"))
    found = left.select("l", "owner", "words", "begin").join(sums, "l").join(best, "l").drop("l")
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    keyed = notices.select(F.col(id_col).alias("id"), F.col(owner).alias("_owner"), F.array_sort(tokens(text)).alias("_words"), F.when(F.size(parts) >= BEGINNING, F.array_join(F.slice(parts, 1, BEGINNING), " ")).alias("_begin"), (F.trim(text) != "").alias("_some"))
    out = keyed.join(found, F.col("_some") & (F.col("_owner") == F.col("owner")) & (F.col("_words") == F.col("words")) & F.col("_begin").eqNullSafe(F.col("begin")), "left")
    high, middle = F.coalesce("n_high", F.lit(0)), F.coalesce("n_middle", F.lit(0))
    shown_best = F.coalesce(F.transform("best", lambda b: F.struct(b["contract"].alias("contract"), b["similarity"].alias("similarity"))), F.array().cast(f"array<struct<contract:{contracts.schema[contract_id].dataType.simpleString()},similarity:double>>"))
    return out.select("id", F.when(high > 0, "CONFIRMADO").when(middle > 0, "PARCIAL").otherwise("NAO_VERIFICADO").alias("status"), high.alias("n_high"), middle.alias("n_middle"), shown_best.alias("best"))


def correlation_groups(notices: DataFrame, portfolio: str, agency: str, town: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Groups (portfolio, agency, town, n, exposure, share) of two notices or more of one agency in one town, and per portfolio (n, n_groups, n_independent, diversification, most_exposed).

    Null agencies and towns are ``N/I``; exposure sums values, share is of the portfolio's; diversification is 1 less the largest group's part of all notices.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/I"))
    g = notices.select(F.col(portfolio).alias("portfolio"), named(agency).alias("agency"), named(town).alias("town"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    g = g.groupBy("portfolio", "agency", "town").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("exposure"))
    whole = g.groupBy("portfolio").agg(
        F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("n_groups"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n_independent"),
        F.round(1 - F.max("n") / F.sum("n"), 3).alias("diversification"), F.sum("exposure").alias("total"), F.max("exposure").alias("most_exposed"),
    )
    share = F.col("exposure") / F.nullif(F.col("total"), F.lit(0.0))
    of = g.where("n > 1").alias("g").join(whole.select(F.col("portfolio").alias("_p"), "total"), F.col("portfolio").eqNullSafe(F.col("_p")))
    return of.select("portfolio", "agency", "town", "n", "exposure", share.alias("share")), whole.drop("total")


def scenarios(df: DataFrame, probability: str, value: str, suppliers: str, bonus: str, top_share: str, margin_min: str, margin_max: str, cost: str) -> DataFrame:
    """``df`` once for each of the scenarios base, optimistic and pessimistic, with scenario, prob, roi_min, roi_max and trigger.

    Without a probability or a value above 0 all are 0. Fewer suppliers, or having supplied before, raise the probability; many suppliers, or one that has
    most, lower it, to 0.001 at the least. Returns are value x probability x margin - cost, whole.
    """
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    p, v, n = num(probability), num(value), num(suppliers)
    good = (
        F.when((n > 0) & (n <= 3), F.struct(F.least(p * 2.5, F.lit(0.5)).alias("p"), F.lit("few_suppliers").alias("t")))
        .when(num(bonus) > 0, F.struct(F.least(p + 0.10, F.lit(0.5)).alias("p"), F.lit("recurring_supplier").alias("t")))
        .otherwise(F.struct(F.least(p * 1.8, F.lit(0.4)).alias("p"), F.lit("less_competition").alias("t")))
    )
    bad = (
        F.when(n > 10, F.struct((p * 0.4).alias("p"), F.lit("many_suppliers").alias("t"))).when(num(top_share) > 0.3, F.struct((p * 0.3).alias("p"), F.lit("strong_supplier").alias("t")))
        .otherwise(F.struct((p * 0.5).alias("p"), F.lit("more_competition").alias("t")))
    )
    known = (p > 0) & (v > 0)
    roi = lambda q, m: F.when(known, F.round(v * q * num(m) - num(cost))).otherwise(0.0).cast("long")

    def case(name: str, q: Column, trigger: Column) -> Column:
        return F.struct(F.lit(name).alias("scenario"), F.when(known, F.round(q, 4)).otherwise(0.0).alias("prob"), roi(q, margin_min).alias("roi_min"), roi(q, margin_max).alias("roi_max"), F.when(known, trigger).otherwise("insufficient_data").alias("trigger"))

    cases = F.array(case("base", p, F.lit("as_is")), case("optimistic", good["p"], good["t"]), case("pessimistic", F.greatest(bad["p"], F.lit(0.001)), bad["t"]))
    return df.select("*", F.explode(cases).alias("_s")).select(*df.columns, "_s.*")


def recommendation(score: Column) -> Column:
    return F.when(score >= PARTICIPATE, "PARTICIPAR").when(score >= ASSESS, "AVALIAR").otherwise("NAO_RECOMENDADO")


def sensitivity(df: DataFrame, scores: dict[str, Column], weights: dict[str, Column], total: Column, gate: Column | None = None) -> DataFrame:
    """``df`` with stability, sensitive_to, least and most: each weight is moved by a tenth up and down, the others share the rest in proportion.

    sensitive_to is the first dimension whose move changes the recommendation of ``total`` (FRAGIL), null if none does (ROBUSTA). ``gate`` names ceilings that
    were applied to the total and hold for the moved ones too. Null weights count as ``USUAL``; one of 0 or less is not moved; without any other weight there is nothing to share.
    """
    w = {d: F.coalesce(weights[d].cast("double"), F.lit(USUAL)) for d in DIMENSIONS}
    s = {d: F.coalesce(scores[d].cast("double"), F.lit(50.0)) for d in DIMENSIONS}
    moves = []
    for d in DIMENSIONS:
        others = sum((w[k] for k in DIMENSIONS if k != d), F.lit(0.0))
        for by in (MOVE, -MOVE):
            new = w[d] * (1 + by)
            moved = s[d] * new + sum((s[k] * w[k] for k in DIMENSIONS if k != d), F.lit(0.0)) * ((1 - new) / others)
            for word, most in CEILINGS if gate is not None else ():
                moved = F.when(F.coalesce(F.contains(gate, F.lit(word)), F.lit(False)), F.least(moved, F.lit(float(most)))).otherwise(moved)
            moves.append(F.when((w[d] > 0) & (others > 0), F.struct(F.bround(moved, 0).alias("score"), F.lit(d).alias("dimension"))))
    out = df.withColumn("_moves", F.array_compact(F.array(*moves)))
    points = F.transform("_moves", lambda m: m["score"])
    changed = F.filter("_moves", lambda m: recommendation(m["score"]) != recommendation(total))
    first = F.get(changed, F.lit(0))["dimension"]
    return out.select(*df.columns, F.when(first.isNotNull(), "FRAGIL").otherwise("ROBUSTA").alias("stability"), first.alias("sensitive_to"), F.coalesce(F.array_min(points), total.cast("double")).alias("least"), F.coalesce(F.array_max(points), total.cast("double")).alias("most"))
