"""Bids: a simulation from an agency's discounts, how well a notice fits what a firm has won, and which competitors count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acquimetra.functions.brackets import TOWN_SIZES, bracket
from acquimetra.functions.text import digits_only, tokens
from acquimetra.operators.scoring import rivals, value_fit, win_probability

# Least margin, target margin and reference surcharge of sectors; rivals that a label of competition stands for.
SECTORS = {"engenharia_obras": (0.05, 0.12, 0.25), "ti_software": (0.10, 0.20, 0.30), "consultoria": (0.15, 0.25, 0.35), "avaliacao": (0.10, 0.20, 0.30), "saude": (0.08, 0.15, 0.28), "default": (0.08, 0.15, 0.25)}
ACTIVITIES = {"41": "engenharia_obras", "42": "engenharia_obras", "43": "engenharia_obras", "71": "engenharia_obras", "62": "ti_software", "63": "ti_software", "69": "consultoria", "70": "consultoria", "86": "saude", "87": "saude"}
# Contracts that a simulation and a profile take at least, weights of a fit, words of a profile, how often a word has to occur.
LEAST, WEIGHTS, WORDS, OFTEN = 3, (0.30, 0.25, 0.15, 0.15, 0.15), 50, 2
# Fixed value: parts that the rows of an owner are dealt into.
DEALT = 4
# Competitors wanted, contracts that one has at least, days in which a notice is recent.
WANTED, LEAST_CONTRACTS, RECENT_DAYS = 15, 1, 90


def sector(activity: Column) -> Column:
    """The sector of an activity code, by its first two digits."""
    names = F.create_map(*[F.lit(x) for kv in ACTIVITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.left(activity.cast("string"), F.lit(2))), F.lit("default"))


def simulate(value: Column, hhi: Column, n: Column, median: Column, p25: Column, p75: Column, sd: Column, activity: Column, fallback: Column | None = None) -> Column:
    """A struct of bid, aggressive, careful, discount, p_win, margin, expected, rivals and confidence.

    The bid lies a little above the median discount, the aggressive one above the upper quartile, the careful one at the lower quartile or the target margin, all within the sector's least
    margin and in this order. Without a value, or with fewer than ``LEAST`` contracts, the bids are the value, the rest 0 and confidence INSUFICIENTE.
    """
    kind = sector(activity)
    of = lambda i: F.try_element_at(F.create_map(*[x for k, m in SECTORS.items() for x in (F.lit(k), F.lit(m[i]))]), kind)
    num = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    v, mid, low, high, spread, count = num(value), num(median), num(p25), num(p75), num(sd), num(n)
    most, some = 1 - of(0), (num(value) > 0) & (count >= LEAST)
    bid = F.least(mid + spread * 0.3, most)
    careful, bold = F.greatest(low, of(1)), F.least(high + spread * 0.5, most)
    careful, bold = F.when(careful > bid, bid * 0.85).otherwise(careful), F.when(bold < bid, F.least(bid * 1.15, most)).otherwise(bold)
    others = rivals(hhi, fallback)
    p, margin = win_probability(bid, mid, spread, others), of(2) - bid
    sure = F.when((count >= 10) & (spread > 0), "ALTA").when(count >= 5, "MEDIA").otherwise("BAIXA")
    made = F.struct((v * (1 - bid)).alias("bid"), (v * (1 - bold)).alias("aggressive"), (v * (1 - careful)).alias("careful"), bid.alias("discount"), p.alias("p_win"), margin.alias("margin"), (p * margin * v).alias("expected"), others.alias("rivals"), sure.alias("confidence"))
    zero = lambda name: F.lit(0.0).alias(name)
    none = F.struct(v.alias("bid"), v.alias("aggressive"), v.alias("careful"), zero("discount"), zero("p_win"), zero("margin"), zero("expected"), others.alias("rivals"), F.lit("INSUFICIENTE").alias("confidence"))
    return F.when(some, made).otherwise(none)


def profiles(contracts: DataFrame, apart: Sequence[str] = ("value", "km", "subject")) -> DataFrame:
    """(owner, n, mean, sd, most, modalities, sizes, words, km, states) of what owners have won.

    contracts: (owner, value, modality, population, subject, km, state). Values, distances and codes that are null or not above 0 don't count; sd is that of all contracts.
    Maps hold shares: of modalities, town sizes and states among those known, of the ``WORDS`` most frequent words (ties by the word) that occur ``OFTEN`` times or more in all contracts.
    Rows meet once, by owner and a hash of the columns in ``apart`` that deals an owner's rows into ``DEALT`` parts. All counts are added up there in one pass; only the counts meet by owner.
    """
    c = F.col
    dealt = contracts.select("owner", "value", "km", "modality", "state", "population", "subject", F.pmod(F.xxhash64(*apart), F.lit(DEALT)).cast("int").alias("_deal")).repartition("owner", "_deal")
    v, far, none = F.when(c("value") > 0, c("value").cast("double")), F.when(c("km") > 0, c("km").cast("double")), F.lit(None).cast("double")
    cell = lambda kind, k, v=none, far=none: F.struct(F.lit(kind).alias("kind"), k.cast("string").alias("k"), v.alias("v"), far.alias("far"))
    of = {"modalities": c("modality"), "sizes": bracket(F.when(c("population") > 0, c("population")), TOWN_SIZES), "states": c("state")}
    each = F.concat(F.array(cell("all", F.lit("all"), v, far), *[cell(kind, k) for kind, k in of.items()]), F.transform(tokens(F.coalesce("subject", F.lit(""))), lambda w: cell("words", w)))
    # inline_outer, though no array is empty: for inline Spark would test the arrays' size before the rows are dealt, and make them twice
    cells = dealt.select("owner", each.alias("each")).select("owner", F.inline_outer("each")).where("k is not null and k <> ''").groupBy("owner", "kind", "k")
    cells = cells.agg(F.count(F.lit(1)).alias("c"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max("v").alias("most"), F.avg("far").alias("far"))
    top = cells.repartition("owner").withColumn("at", F.row_number().over(W.partitionBy("owner", "kind").orderBy(F.desc("c"), "k"))).where((c("kind") != "words") | (c("at") <= WORDS) & (c("c") >= OFTEN))

    whole = lambda name: F.max(F.when(c("kind") == "all", c(name)))
    counts = lambda kind: F.map_from_entries(F.collect_list(F.when(c("kind") == kind, F.struct("k", "c"))))
    out = top.groupBy("owner").agg(whole("c").alias("n"), *[whole(k).alias(k) for k in ("mean", "sd", "most")], whole("far").alias("km"), *[counts(k).alias(k) for k in (*of, "words")], *[F.sum(F.when(c("kind") == k, c("c"))).alias(f"_{k}") for k in of])
    share = lambda k, total: F.when(F.size(k) > 0, F.transform_values(k, lambda _, x: x / c(total))).alias(k)
    return out.select("owner", "n", "mean", "sd", "most", "km", *[share(k, f"_{k}") for k in of], share("words", "n"))


def fit(notices: DataFrame, known: DataFrame) -> DataFrame:
    """``notices`` (owner, value, modality, population, subject, km, state) with fit, from 0 to 1, and its five parts.

    Parts: value, words, modality, place, town size, weighed by ``WEIGHTS``; what a profile or a notice doesn't say is neutral. Owners with fewer than ``LEAST`` contracts have 0.5 and no parts.
    """
    x = notices.join(known.select(F.col("owner").alias("_o"), *[F.col(k).alias(f"_{k}") for k in known.columns if k != "owner"]), F.col("owner") == F.col("_o"), "left")
    v = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    worth = F.when(F.coalesce(F.col("_mean"), F.lit(0.0)) * v <= 0, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("_sd") > 0, value_fit(v, F.col("_mean"), F.col("_sd"), F.col("_most"))).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(1 - v / F.col("_mean"))) * F.when(v > F.col("_most") * 3, 0.3).otherwise(1.0)))))
    own = tokens(F.coalesce("subject", F.lit("")))
    met = F.aggregate(own, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at("_words", w), F.lit(0.0)))
    words = F.when(F.coalesce(F.size("_words"), F.lit(0)) <= 0, 0.5).when(F.size(own) == 0, 0.3).otherwise(F.least(F.lit(1.0), met / F.greatest(F.size(own), F.lit(1)) * 3))
    modality = F.when(F.col("_modalities").isNull() | F.col("modality").isNull(), 0.5).otherwise(F.coalesce(F.try_element_at("_modalities", F.col("modality").cast("string")), F.lit(0.1)))
    state = F.when(F.col("_states").isNull(), 0.5).otherwise(0.5 + 0.5 * F.coalesce(F.try_element_at("_states", F.col("state").cast("string")), F.lit(0.0)))
    ratio = F.col("km") / F.col("_km")
    road = F.when(F.coalesce(F.col("km"), F.lit(0)) <= 0, 1.0).when(F.col("_km") > 0, F.when(ratio > 2, F.greatest(F.lit(0.3), 1 - (ratio - 2) * 0.2)).otherwise(1.0)).when(F.col("km") > 500, 0.7).when(F.col("km") > 300, 0.85).otherwise(1.0)
    size = bracket(F.when(F.col("population") > 0, F.col("population")), TOWN_SIZES)
    town = F.when(F.col("_sizes").isNull(), 0.5).when(size.isNull(), 0.4).otherwise(F.greatest(F.lit(0.1), F.coalesce(F.try_element_at("_sizes", size), F.lit(0.1))))
    parts = {"fit_value": worth, "fit_words": words, "fit_modality": modality, "fit_place": F.least(F.lit(1.0), state * road), "fit_town": town}
    enough = F.coalesce(F.col("_n") >= LEAST, F.lit(False))
    x = x.withColumns({k: F.when(enough, p) for k, p in parts.items()})
    whole = sum((F.col(k) * w for k, w in zip(parts, WEIGHTS, strict=True)), F.lit(0.0))
    return x.select(*notices.columns, F.when(enough, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), whole)), 4)).otherwise(0.5).alias("fit"), *parts)


def competitors(candidates: DataFrame, group: str, state: str | None = None, wanted: int = WANTED, least: int = LEAST_CONTRACTS) -> tuple[DataFrame, DataFrame]:
    """(group, rank, tax_id, n, total, ticket) of the best candidates of each group, and (group, valid, status): OK, or INSUFFICIENT where fewer than ``wanted`` are valid; nobody is put in to fill up.

    candidates: (group, tax_id, n, total, states). Valid are those with 14 digits of a tax id, ``least`` contracts and, where they name states, ``state`` among them. The order is contracts, total, tax id.
    """
    n, total = F.coalesce("n", F.lit(0)), F.coalesce(F.col("total").cast("double"), F.lit(0.0))
    there = F.lit(True) if state is None else F.coalesce(F.size("states"), F.lit(0)).isin(0, -1) | F.array_contains("states", state)
    ok = candidates.withColumns({"tax_id": digits_only(F.col("tax_id").cast("string")), "n": n, "total": total}).where((F.length("tax_id") == 14) & (F.col("n") >= least) & F.coalesce(there, F.lit(True)))
    ranked = ok.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), F.desc("total"), "tax_id"))).where(F.col("rank") <= wanted)
    counts = candidates.select(group).distinct().alias("g").join(ok.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("c")), F.col(f"g.{group}").eqNullSafe(F.col("_g")), "left")
    valid = F.least(F.coalesce("c", F.lit(0)), F.lit(wanted))
    return ranked.select(group, "rank", "tax_id", "n", F.round("total", 2).alias("total"), (F.col("total") / F.greatest(F.col("n"), F.lit(1))).alias("ticket")), counts.select(group, valid.alias("valid"), F.when(valid >= wanted, "OK").otherwise("INSUFFICIENT").alias("status"))


def unmatched(notices: DataFrame, as_of: Column) -> DataFrame:
    """Notices without an entity that name an agency by tax id or name, with match_opportunity (has_cnpj, name_only) and recency (recent, historical; an unknown day is historical)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    out = notices.where(F.col("entity").isNull() & (said("agency_cnpj") | said("agency_name")))
    return out.withColumns({"match_opportunity": F.when(said("agency_cnpj"), "has_cnpj").otherwise("name_only"), "recency": F.when(F.col("published") >= F.date_sub(as_of, RECENT_DAYS), "recent").otherwise("historical")})
