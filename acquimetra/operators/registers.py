"""Registers: sources and their capabilities, aliases, keyed duplicates, what was seen when, runs, snapshots, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acquimetra.functions.text import digits_only
from acquimetra.sources.tables import checkpointed

# Digits by which a tax id's two check digits are weighed.
TAX_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
# The federation's states.
STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
# Parts of words of engineering firms, in lower case; how names of public bodies begin; foundations that are public; and the legal forms of firms, as parts of a name and as its beginning.
FIRM_WORDS = (
    "engenh", "constru", "obra", "edific", "paviment", "saneamento", "infraestrutura", "incorporadora", "empreiteira", "construtora", "terraplenagem", "fundacao", "estrutura", "predial", "rodovi", "drenagem", "asfalto", "concreto", "reforma", "arquitet",
)
PUBLIC_PREFIXES = (
    "MUNICIPIO DE", "MUNICÍPIO DE", "PREFEITURA", "SECRETARIA", "CAMARA MUNICIPAL", "CÂMARA MUNICIPAL", "GOVERNO", "MINISTERIO", "MINISTÉRIO", "TRIBUNAL", "ASSEMBLEIA", "ASSEMBLÉIA", "DEFENSORIA", "PROCURADORIA", "POLICIA", "POLÍCIA",
    "FUNDO MUNICIPAL", "DEPARTAMENTO DE", "SERVICO AUTONOMO", "SERVIÇO AUTÔNOMO", "SERVICO MUNICIPAL", "SERVIÇO MUNICIPAL", "AUTARQUIA", "AGENCIA REGULADORA", "AGÊNCIA REGULADORA", "INSTITUTO MUNICIPAL", "INSTITUTO ESTADUAL",
    "CONSELHO REGIONAL", "CONSELHO MUNICIPAL", "CORPO DE BOMBEIROS", "ESTADO DE", "SENADO FEDERAL", "UNIAO FEDERAL", "SUPERINTENDENCIA", "COORDENADORIA", "COMANDO", "DELEGACIA", "FUNDO ESTADUAL", "FUNDO NACIONAL",
)
PUBLIC_FOUNDATIONS = ("FUNDACAO MUNICIPAL", "FUNDACAO ESTADUAL", "FUNDAÇÃO MUNICIPAL", "FUNDAÇÃO ESTADUAL")
LEGAL_PARTS = ("LTDA", "S.A.", "S/A", "EIRELI", "ME ", "MEI", "- ME")
LEGAL_STARTS = ("FUNDACAO", "FUNDAÇÃO", "INSTITUTO", "COOPERATIVA")
# Categories of notices that a portfolio may hold, and what a correlated one's efficiency is worth.
ELIGIBLE, CORRELATED = ("QUICK_WIN", "OPORTUNIDADE", "INVESTIMENTO"), 0.7
# Share of the median discount that a bid leans on, share of the careful bid, cost as a share of the estimate, rows for a benchmark and for high confidence.
LEAN, CAREFUL, COST, LEAST_ROWS, SURE_ROWS = 0.85, 0.5, 0.80, 3, 5
# Words that say nothing in notices.
NOTICE_STOPWORDS = ("de", "da", "do", "das", "dos", "para", "com", "por", "em", "no", "na", "nos", "nas", "ao", "aos", "a", "o", "as", "os", "e", "ou")


def capable(sources: DataFrame, capability: str) -> DataFrame:
    """Sources of a register (source, enabled, capabilities) that are enabled and have the capability."""
    return sources.where(F.col("enabled") & F.array_contains("capabilities", capability)).select("source")


def resolved(df: DataFrame, aliases: DataFrame, key: str, to: str = "resolved") -> DataFrame:
    """Adds the entity that a key publishes for: its alias (alias, target), or itself without one; of several targets the least."""
    known = aliases.groupBy(F.col("alias").alias(key)).agg(F.min("target").alias("_target"))
    return df.join(known, key, "left").withColumn(to, F.coalesce("_target", key)).withColumn("via_alias", F.col("_target").isNotNull()).drop("_target")


def prefix_join(left: DataFrame, right: DataFrame, code: str, prefix: str, length: int = 8) -> DataFrame:
    """Rows of left whose code begins with a prefix of right. Prefixes of that length meet by equality; others, which are few or none, by all their own lengths."""
    lengths = F.array_distinct(F.collect_list(F.length(prefix)))
    sizes = right.where(F.length(prefix) != length).agg(lengths.alias("l")).first()["l"]
    keys = F.array_distinct(F.array(*[F.left(F.col(code), F.lit(n)) for n in sorted({length, *sizes})]))
    return left.withColumn("_key", F.explode(keys)).join(right.withColumn("_key", F.col(prefix)), "_key").where(F.startswith(F.col(code), F.col(prefix))).drop("_key")


def keyed_duplicates(df: DataFrame, id_col: str, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """(id, keeper, level): the first of the keys that is not null and held by several rows names the group, its first row by ``order``, then id, the keeper.

    Keys are counted before they are joined back, so rows of a hot key meet only its count. Rows without a shared key keep themselves at level 0.
    """
    at = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.col(id_col).alias("id"))
    each = F.array(*[F.struct(F.lit(i).alias("level"), k.cast("string").alias("key")) for i, k in enumerate(keys)])
    rows = df.select(at.alias("_at"), F.explode(F.filter(each, lambda x: x["key"].isNotNull())).alias("_k")).select("_at", F.col("_k.level").alias("_level"), F.col("_k.key").alias("_key"))
    # Spark sorts to find the least of structs: dealt by key and a part of it first, a task sorts a share of its rows, and a hot key's are in many tasks.
    parts = rows.select("_level", "_key", "_at", F.pmod(F.xxhash64("_at.id"), F.lit(16)).alias("_part")).repartition("_level", "_key", "_part")
    some = parts.groupBy("_level", "_key", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    shared = some.groupBy("_level", "_key").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1").select("_level", "_key", F.col("first.id").alias("keeper"))
    met = rows.select("_level", "_key", F.col("_at.id").alias("_id")).join(shared, ["_level", "_key"])
    # The level decides, and a row has one keeper a level: a number for each level keeps the aggregate free of structs.
    best = met.groupBy("_id").agg(F.min("_level").alias("_level"), *[F.min(F.when(F.col("_level") == i, F.col("keeper"))).alias(f"_k{i}") for i in range(len(keys))])
    keeper = F.coalesce(*[f"_k{i}" for i in range(len(keys))], F.col(id_col))
    return df.select(id_col).distinct().join(best, F.col(id_col) == F.col("_id"), "left").select(id_col, keeper.alias("keeper"), (F.coalesce("_level", F.lit(-1)) + 1).alias("level"))


def merged_fields(df: DataFrame, group: str, order: Sequence[Column], fields: Sequence[str], origin: str) -> DataFrame:
    """One row a group: of each field the first value that is not null, and whose it is (``field_from``)."""
    one = F.struct(*[F.col(f"_o{i}") for i in range(len(order))], F.col(origin).alias("origin"))
    rows = df.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    aggs = []
    for f in fields:
        best = F.min(F.when(F.col(f).isNotNull(), F.struct(one.alias("at"), F.col(f).alias("value"))))
        aggs += [best["value"].alias(f), best["at"]["origin"].alias(f"{f}_from")]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("merged"), *aggs)


def seen_state(state: DataFrame, batch: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first_seen, last_seen, times) after a batch of (key, at): what was known goes on, what is new begins."""
    new = batch.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("times"))
    return state.select(key, "first_seen", "last_seen", "times").unionByName(new).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times").alias("times"))


def run_health(runs: DataFrame, started: str, finished: str, as_of: Column, minutes: int = 60) -> DataFrame:
    """Adds ``health``: finished, running, or stalled once it has run for longer than that without an end."""
    age = (as_of.cast("timestamp").cast("double") - F.col(started).cast("timestamp").cast("double")) / 60
    return runs.withColumn("health", F.when(F.col(finished).isNotNull(), "finished").when(age > minutes, "stalled").otherwise("running"))


def with_snapshot(history: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The history and those rows of the current snapshot whose keys it doesn't hold yet: a second run adds nothing."""
    return history.unionByName(current.join(history.select(*keys).distinct(), list(keys), "left_anti"))


def valid_tax_id(c: Column) -> Column:
    """Whether a text holds 14 digits, not all alike, whose last two check."""
    d = digits_only(c)
    digit = lambda i: F.substring(d, i + 1, 1).cast("int")
    ok = (F.length(d) == 14) & ~d.rlike(r"^(.)\1{13}$")
    for k, weights in enumerate(TAX_WEIGHTS):
        rest = sum((digit(i) * w for i, w in enumerate(weights)), F.lit(0)) % 11
        ok = ok & (digit(12 + k) == F.when(rest < 2, 0).otherwise(11 - rest))
    return F.coalesce(ok, F.lit(False))


def valid_state(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).isin(STATES), F.lit(False))


def valid_range(begin: Column, end: Column, most_days: int = 365) -> Column:
    return F.coalesce((begin <= end) & (F.datediff(end, begin) <= most_days), F.lit(False))


def is_engineering_firm(name: Column) -> Column:
    """By a word of the trade and a legal form, and not a public body; null is none."""
    low, up = F.lower(name), F.upper(name)
    some = lambda tests: F.greatest(*tests)
    trade = some([F.contains(low, F.lit(w)) for w in FIRM_WORDS])
    public = some([F.startswith(up, F.lit(p)) for p in (*PUBLIC_PREFIXES, *PUBLIC_FOUNDATIONS)])
    form = some([*[F.contains(up, F.lit(p)) for p in LEGAL_PARTS], *[F.startswith(up, F.lit(p)) for p in LEGAL_STARTS]])
    return F.coalesce(trade & ~public & form, F.lit(False))


def chosen(df: DataFrame, group: str, id_col: str, most: int = 5, most_value: float = 0.0, default_cost: float = 1.0) -> DataFrame:
    """(group, id, pick, value, roi_expected, roi_cumulative, correlated): the best notices of each group until a count or a total value is reached.

    df: (group, id, category, value, cost, roi_min, roi_max, cluster). Notices of other than ``ELIGIBLE`` categories take no part; the order is return over cost,
    ties by id; the notice that would bring the total over ``most_value`` (0: no bound) ends the choice. correlated marks
    notices of a cluster that one was chosen from before; it only tells, at ``CORRELATED`` of its efficiency. Null numbers are 0.
    """
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cost = F.when(num("cost") > 0, num("cost")).otherwise(default_cost)
    best, worst = num("roi_max"), num("roi_min")
    x = df.where(F.col("category").isin(*ELIGIBLE)).select(
        group, id_col, "cluster", num("value").alias("value"), (F.when(best > 0, best).otherwise(worst) / cost).alias("efficiency"), F.when(worst != 0, (best + worst) / 2).otherwise(best).alias("roi_expected")
    )
    order = W.partitionBy(group).orderBy(F.desc("efficiency"), id_col)
    first = x.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= most)  # at most so many rows a group from here on
    run = W.partitionBy(group).orderBy("pick").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("value").over(run)
    kept = first.withColumn("_total", total).withColumn("_over", F.max(F.col("_total")).over(run))
    kept = kept.where(F.col("_over") <= most_value) if most_value > 0 else kept
    seen = F.count(F.lit(1)).over(W.partitionBy(group, "cluster").orderBy("pick").rowsBetween(W.unboundedPreceding, 0)) > 1
    return kept.select(group, id_col, "pick", "value", "roi_expected", F.sum("roi_expected").over(run).alias("roi_cumulative"), (F.col("cluster").isNotNull() & seen).alias("correlated"))


def discount_benchmark(values: DataFrame, keys: Sequence[str], estimate: str, value: str) -> DataFrame:
    """(keys, n, mean, p25, p50, p75, sample) of the discounts (1 - value / estimate) of each group that lie between -1 and 1, four digits; with fewer than ``LEAST_ROWS`` they are null."""
    from .relational import quantiles

    x = 1 - F.col(value).cast("double") / F.col(estimate).cast("double")
    rows = values.where((F.col(estimate) > 0) & (F.col(value) > 0)).select(*keys, x.alias("discount")).where("discount between -1 and 1")
    g = quantiles(rows, list(keys), "discount", (0.25, 0.5, 0.75))
    mean = rows.groupBy(*keys).agg(F.avg("discount").alias("mean"))
    enough = F.col("n") >= LEAST_ROWS
    return g.join(mean, list(keys)).select(*keys, "n", *[F.when(enough, F.round(c, 4)).alias(c) for c in ("mean", "p25", "p50", "p75")], F.when(enough, "OK").otherwise("INSUFFICIENT").alias("sample"))


def suggested_bid(tenders: DataFrame, benchmark: DataFrame, keys: Sequence[str], estimate: str) -> DataFrame:
    """``tenders`` with the range that an agency's discounts suggest and a bid within it.

    least and most are the estimate at the upper and lower quartile; bid leans on ``LEAN`` of the median discount, aggressive on all of it, careful on
    ``CAREFUL``; margin is what the bid leaves over a cost of ``COST``, in percent. Without a benchmark, an estimate or a median they are null.
    """
    b = benchmark.where("sample = 'OK'").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_n"), F.col("p25").alias("_p25"), F.col("p50").alias("_p50"), F.col("p75").alias("_p75"))
    x = tenders.join(b, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    # Money is reckoned in decimals, so that half a cent is rounded up everywhere.
    share = lambda c: F.col(c).cast("decimal(10,6)")
    v, p50 = F.when(F.col(estimate) > 0, F.col(estimate).cast("decimal(18,2)")), F.when(F.col("_p50") != 0, share("_p50"))
    of = lambda discount, part=1: (discount * F.lit(part).cast("decimal(4,2)")).cast("decimal(12,6)")
    at = lambda discount: F.round(v * (F.lit(1) - discount), 2).cast("double")
    lean = of(p50, LEAN)
    margin = ((F.lit(1) - lean) / F.lit(COST).cast("decimal(4,2)") - 1) * 100
    x = x.withColumns({
        "least": at(share("_p75")), "most": at(share("_p25")), "bid": at(lean), "discount_pct": F.when(v.isNotNull(), F.round(lean * 100, 1).cast("double")), "aggressive": at(p50), "careful": at(of(p50, CAREFUL)),
        "margin_pct": F.when(v.isNotNull(), F.round(margin, 1).cast("double")), "confidence": F.when(v.isNotNull() & p50.isNotNull(), F.when(F.col("_n") >= SURE_ROWS, "ALTA").otherwise("MEDIA")),
    })
    return x.drop("_n", "_p25", "_p50", "_p75", *[f"_{k}" for k in keys])


def failed_checks(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """(id, check) of every check that a row fails; a check without an answer fails."""
    return df.select(id_col, F.explode(F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("check"))


def calibration(outcomes: DataFrame, group: str) -> DataFrame:
    """(group, total, wins, losses, no_bids, win_rate, score_wins, score_losses, threshold, proposed, won, recovery) of what came of bids.

    outcomes: (group, outcome: win, loss or no_bid, score, proposed, won). Scores that are null or 0 don't count; the threshold lies midway between the mean scores of
    wins and losses, at nine tenths of the least score of wins where no loss has one, and at 0.45 where no win has one. recovery is the value won over the value proposed in wins.
    """
    is_ = lambda kind: F.col("outcome") == kind
    score = lambda kind: F.when(is_(kind) & (F.col("score") != 0), F.col("score").cast("double"))
    money = lambda c: F.coalesce(F.sum(F.when(is_("win"), F.col(c).cast("double"))), F.lit(0.0))
    g = outcomes.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_("win")).alias("wins"), F.count_if(is_("loss")).alias("losses"), F.count_if(is_("no_bid")).alias("no_bids"),
        F.avg(score("win")).alias("_w"), F.avg(score("loss")).alias("_l"), F.min(score("win")).alias("_least"), money("proposed").alias("proposed"), money("won").alias("won"),
    )
    threshold = F.when(F.col("_w").isNotNull() & F.col("_l").isNotNull(), F.round((F.col("_w") + F.col("_l")) / 2, 3)).when(F.col("_w").isNotNull(), F.round(F.col("_least") * 0.9, 3)).otherwise(0.45)
    return g.select(
        group, "total", "wins", "losses", "no_bids", F.round(F.col("wins") / F.greatest(F.lit(1), F.col("wins") + F.col("losses")), 3).alias("win_rate"), F.round(F.coalesce("_w", F.lit(0.0)), 3).alias("score_wins"),
        F.round(F.coalesce("_l", F.lit(0.0)), 3).alias("score_losses"), threshold.alias("threshold"), "proposed", "won", (F.col("won") / F.nullif(F.col("proposed"), F.lit(0.0))).alias("recovery"),
    )


def notice_words(c: Column) -> Column:
    """Different words of a notice in lower case, of two letters or more, without those that say nothing."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*NOTICE_STOPWORDS)))


def _alike(df: DataFrame, at: Column, keys: Sequence[str], value: str, text: str, spread: float, overlap: float) -> tuple[DataFrame, DataFrame]:
    """Members (at, rep: the first with its keys, value and words) and links (ra, rb, overlap), ra before rb, of what is alike.

    Rows of equal words and values are one set. Sets meet by a rare word of theirs: sets so alike share one of their few rarest
    words within a value band, so that neither an agency's rows nor those with a common word all meet.
    """
    from .matching import _rarest_first

    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    step = F.log(F.lit(1 / (1 - spread)))
    band = F.when(v > 0, F.floor(F.log(v) / step).cast("long")).otherwise(F.lit(-(1 << 40)))
    rows = df.where(" and ".join(f"{k} is not null" for k in keys)).select(at.alias("at"), F.struct(*keys).alias("k"), F.when(v > 0, v).otherwise(F.lit(0.0)).alias("v"), F.array_sort(notice_words(F.col(text))).alias("w"), band.alias("band")).where(F.size("w") > 0)
    sets = checkpointed(rows.groupBy("k", "band", "v", "w").agg(F.min("at").alias("rep")))
    hashed = sets.select("rep", "k", "band", F.transform("w", lambda w: F.xxhash64(w)).alias("t"))
    n = F.size("t")
    prefix = (n - F.ceil(n * overlap - 1e-9) + 1).cast("int")
    first = hashed.select("rep", "k", "band", F.slice(_rarest_first(hashed)("t"), F.lit(1), prefix).alias("t")).select("rep", "k", "band", F.explode("t").alias("word"))
    # Only hashes of keys, band and word meet; what they let in is compared as it stands. Of neighbouring bands the lower one reaches up.
    left = first.select(F.col("rep").alias("ra"), "k", "word", F.posexplode(F.array("band", F.col("band") + 1)).alias("up", "band")).select("ra", "up", F.xxhash64("k", "band", "word").alias("key"))
    right = first.select(F.col("rep").alias("rb"), F.xxhash64("k", "band", "word").alias("key"))
    met = left.join(right, "key").where((F.col("ra") < F.col("rb")) | ((F.col("up") == 1) & (F.col("ra") != F.col("rb")))).select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).distinct()
    of = lambda side: sets.select(F.col("rep").alias(f"r{side}"), F.col("k").alias(f"k{side}"), F.col("v").alias(f"v{side}"), F.col("w").alias(f"w{side}"))
    full = met.join(of("a"), "ra").join(of("b"), "rb").where("ka = kb")
    shared = F.size(F.array_intersect("wa", "wb"))
    near = F.when((F.col("va") > 0) & (F.col("vb") > 0), F.least("va", "vb") / F.greatest("va", "vb") >= 1 - spread).otherwise(F.col("va") == F.col("vb"))
    links = full.where(near).select("ra", "rb", (shared / (F.size("wa") + F.size("wb") - shared)).alias("overlap")).where(F.col("overlap") > overlap)
    return rows.join(sets, ["k", "band", "v", "w"]).select("at", "rep"), links


def similar_notices(df: DataFrame, id_col: str, keys: Sequence[str], value: str, text: str, spread: float = 0.15, overlap: float = 0.8) -> DataFrame:
    """(a, b, overlap), a < b: rows alike in all ``keys`` (agency, state) whose values lie within ``spread`` of each other, or are both nothing, and whose words
    are alike: shared ones over all of both, above ``overlap``. Rows with a null key, or without words, are alike to none. All pairs of equal rows are given.
    """
    members, links = _alike(df, F.col(id_col), keys, value, text, spread, overlap)
    a, b = members.select(F.col("rep").alias("ra"), F.col("at").alias("ia")), members.select(F.col("rep").alias("rb"), F.col("at").alias("ib"))
    across = links.join(a, "ra").join(b, "rb").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "overlap")
    within = a.join(b.withColumnRenamed("rb", "ra"), "ra").where("ia < ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"), F.lit(1.0).alias("overlap"))
    return across.unionByName(within)


def without_similar(df: DataFrame, id_col: str, keys: Sequence[str], value: str, text: str, published: str, spread: float = 0.15, overlap: float = 0.8) -> DataFrame:
    """(id, dropped_for): in the order of publication (unknown days last, ties by id) a notice goes if one kept before it is alike, and names the first such. Equal notices count as one, so many copies cost no more than a few."""
    from .matching import settled

    at = F.struct(F.coalesce(F.col(published).cast("date"), F.lit("9999-12-31").cast("date")).alias("day"), F.col(id_col).alias("id"))
    members, found = _alike(df, at, keys, value, text, spread, overlap)
    links = checkpointed(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    gone = settled(links)
    fell = links.join(gone, "b", "left_semi").join(gone.select(F.col("b").alias("a")), "a", "left_anti").groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("to"))
    named = members.join(fell, "rep", "left").select(F.col("at.id").alias("_id"), F.coalesce(F.col("to.id"), F.when(F.col("at") != F.col("rep"), F.col("rep.id"))).alias("dropped_for"))
    return df.select(id_col).join(named, F.col(id_col) == F.col("_id"), "left").select(id_col, "dropped_for")
