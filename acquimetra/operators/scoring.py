"""Explainable scores as Column expressions; every date is relative to an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acquimetra.functions.text import fold

# Portal statuses, without accents, and what they mean.
STATUS_WORDS = {
    "recebendo proposta": "open", "aberto": "open", "aberta": "open", "abertos": "open", "abertas": "open", "em aberto": "open", "em andamento": "open", "em analise": "open", "publicado": "open", "publicada": "open",
    "agendado": "upcoming", "agendada": "upcoming", "divulgado": "upcoming", "divulgada": "upcoming", "previsto": "upcoming",
    "encerrado": "closed", "encerrada": "closed", "concluido": "closed", "concluida": "closed", "finalizado": "closed", "finalizada": "closed", "homologado": "closed", "homologada": "closed", "adjudicada": "closed",
    "suspenso": "suspended", "suspensa": "suspended", "revogado": "revoked", "revogada": "revoked", "cancelado": "revoked", "cancelada": "revoked", "anulado": "annulled", "anulada": "annulled",
    "deserto": "failed", "deserta": "failed", "fracassado": "failed", "fracassada": "failed", "frustrado": "failed", "frustrada": "failed",
}
# The same for the official gazette, whose words go before the others.
GAZETTE_WORDS = {
    "publicado": "open", "autopublicacao nova": "open", "autopublicacao assinada": "open", "autopublicacao publicada": "open", "acervo publico": "unknown", "cancelado": "revoked", "publicado equivocadamente": "revoked", "acervo removido": "revoked",
}
# Weights of the ranking.
RANK = {"open": 30, "upcoming": 21, "opens_30d": 15, "agency": 10, "value": 10, "competitive": 10, "notice_and_files": 15, "notice": 7, "radius": 15, "trusted": 5, "complete": 10}
PENALTY = {"unknown": -20, "no_opening": -15, "no_deadline": -10, "no_value": -10, "no_notice": -10, "untrusted": -10, "not_competitive": -10, "missing_3": -15, "old": -5, "no_town": -5}
# Least, wanted and full margins of each sector.
MARGINS = {"engineering": (0.05, 0.12, 0.25), "software": (0.10, 0.20, 0.30), "consulting": (0.15, 0.25, 0.35), "valuation": (0.10, 0.20, 0.30), "health": (0.08, 0.15, 0.28), "default": (0.08, 0.15, 0.25)}


def _days(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def status_word(status: Column, gazette: Column | None = None) -> Column:
    """What a portal's status word means; null for an unknown one. gazette: whether the row comes from the official gazette."""
    known = lambda words: F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(v))])[fold(F.trim(status))]
    return known(STATUS_WORDS) if gazette is None else F.coalesce(F.when(gazette, known(GAZETTE_WORDS)), known(STATUS_WORDS))


def canonical_status(status: Column, opening: Column, deadline: Column, published: Column, text: Column, as_of: Column) -> Column:
    """The source's word, else the dates, else the age; null dates fall through to the next rule."""
    word = status_word(status)
    by_deadline = F.when(opening.isNotNull(), F.when((deadline > as_of) & (opening <= as_of), "open").when(deadline <= as_of, "closed").when(opening > as_of, "upcoming")).otherwise(F.when(deadline > as_of, "open").otherwise("closed"))
    age = _days(as_of, published)
    opened = F.when(opening > as_of, "upcoming").when(published.isNull(), "unknown").when(age <= 90, "open").when(age <= 365, "unknown").otherwise("closed")
    aged = F.when(age > 365, "closed").when((age > 90) & F.contains(F.lower(text), F.lit("pregao")), "closed").otherwise("unknown")
    return F.coalesce(word, F.when(deadline.isNotNull(), by_deadline), F.when(opening.isNotNull(), opened).otherwise(aged))


def missing_fields(*cols: Column) -> Column:
    return sum((F.when(c.isNull(), 1).otherwise(0) for c in cols), F.lit(0))


def ranking(c: dict[str, Column], as_of: Column) -> tuple[Column, Column]:
    """(score, tier). c: status, agency, subject, value, opening, deadline, published, town, notice, files, in_radius, trusted, competitive, profile_complete.

    A block gives 0 and NO_GO; else 50 plus the weights of what holds, within 0 and 100; from 70 GO, from 40 REVIEW.
    """
    yes = lambda x: F.coalesce(x, F.lit(False))
    blocked = (
        c["status"].isin("revoked", "annulled", "failed", "closed") | yes(F.trim(c["subject"]) == "") | c["subject"].isNull() | c["agency"].isNull() | yes(c["value"] < 0) | yes((c["deadline"] <= as_of) & (c["status"] != "open"))
    )
    gaps = missing_fields(c["agency"], c["subject"], c["value"], c["opening"], c["deadline"], c["town"])
    w = lambda cond, n: F.when(yes(cond), n).otherwise(0)
    has_notice = c["notice"].isNotNull()
    score = (
        F.lit(50) + w(c["status"] == "open", RANK["open"]) + w(c["status"] == "upcoming", RANK["upcoming"]) + w((c["opening"] > as_of) & (_days(c["opening"], as_of) <= 30), RANK["opens_30d"])
        + w(c["agency"].isNotNull(), RANK["agency"]) + w(c["value"].between(10_000, 50_000_000), RANK["value"]) + w(c["competitive"], RANK["competitive"])
        + F.when(has_notice & yes(c["files"]), RANK["notice_and_files"]).when(has_notice, RANK["notice"]).otherwise(0) + w(c["in_radius"], RANK["radius"]) + w(c["trusted"], RANK["trusted"]) + w(gaps == 0, RANK["complete"])
        + w(c["status"] == "unknown", PENALTY["unknown"]) + w(c["opening"].isNull(), PENALTY["no_opening"]) + w(c["deadline"].isNull(), PENALTY["no_deadline"]) + w(c["value"].isNull(), PENALTY["no_value"])
        + w(~has_notice, PENALTY["no_notice"]) + w(~yes(c["trusted"]), PENALTY["untrusted"]) + w(~yes(c["competitive"]), PENALTY["not_competitive"]) + w(gaps >= 3, PENALTY["missing_3"]) + w(_days(as_of, c["published"]) > 60, PENALTY["old"]) + w(c["town"].isNull(), PENALTY["no_town"])
    )
    clamped = F.least(F.lit(100), F.greatest(F.lit(0), score))
    go = (clamped >= 70) & ~blocked
    demoted = go & ~yes(c["profile_complete"])
    final = F.when(blocked, 0).when(demoted, F.least(clamped, F.lit(69))).otherwise(clamped)
    tier = F.when(blocked, "NO_GO").when(go & ~demoted, "GO").when(clamped >= 40, "REVIEW").otherwise("NO_GO")
    return final.cast("int"), tier


def backfill_ranking(is_open: Column, deadline: Column, published: Column, competitive: Column, value: Column, subject: Column, as_of: Column) -> tuple[Column, Column]:
    w = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    due = F.when(F.coalesce(deadline >= as_of, F.lit(False)), 15).when(deadline.isNull() & F.coalesce(_days(as_of, published) <= 30, F.lit(False)), 10).otherwise(0)
    score = w(is_open, 30) + due + w(competitive, 10) + w(value > 0, 10) + w(subject != "", 5)
    return score.cast("int"), F.when(score >= 50, "GO").when(score >= 25, "REVIEW").otherwise("NO_GO")


def proximity_points(km: Column) -> Column:
    return F.when(km.isNull(), 2).when(km <= 50, 10).when(km <= 100, 7).when(km <= 150, 5).when(km <= 200, 3).otherwise(1)


def buyer_score(m: dict[str, Column], top: dict[str, Column]) -> tuple[Column, Column]:
    """(score, class) of a buyer. m: aec, total, value, per_year, ticket, km, open, exp90, hhi; top: the greatest total, value, per_year, open and exp90 of all, or 1."""
    share = m["aec"] / F.greatest(m["total"], F.lit(1.0))
    part = lambda x, k, n: F.least(F.lit(float(n)), x / k * n)
    score = (
        F.least(F.lit(25.0), share / 0.30 * 20 + F.when(share > 0.5, 5.0).otherwise(0.0)) + part(m["total"], top["total"], 10) + part(m["value"], top["value"], 10) + part(m["per_year"], top["per_year"], 15)
        + F.least(F.lit(10.0), m["ticket"] / 500_000 * 10) + proximity_points(m["km"]) + part(m["open"], top["open"], 10) + part(m["exp90"], top["exp90"], 5) + F.when(m["hhi"] <= 1500, 5).when(m["hhi"] <= 2500, 3).otherwise(1)
    )
    return score, F.when(score >= 60, "PRIORITARIO").when(score >= 40, "ATIVO").when(score >= 20, "REVIEW").otherwise("BAIXA")


def discount_percent(estimate: Column, contracted: Column) -> Column:
    """Percent below the estimate; null without a positive estimate."""
    return F.when(estimate > 0, (estimate - contracted) / estimate * 100)


def rivals(hhi: Column, fallback: Column | None = None) -> Column:
    """Expected bidders from concentration (0 to 1), from 2 to 20."""
    n = F.when(hhi > 0, F.least(F.lit(20.0), F.greatest(F.lit(2.0), F.round(F.lit(1.5) / hhi))))
    return F.coalesce(n, fallback if fallback is not None else F.lit(5.0))


def win_probability(suggested: Column, median: Column, sd: Column, n: Column) -> Column:
    z = (suggested - median) / F.when(sd > 0, sd).otherwise(0.05)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.02), F.pow(F.lit(1.0) / (F.lit(1.0) + F.exp(z * -1.7)), F.greatest(F.lit(1.0), n - 1))))


def suggested_discount(median: Column, sd: Column, sector: str) -> Column:
    least = MARGINS.get(sector, MARGINS["default"])[0]
    return F.least(median + sd * 0.3, F.lit(1.0 - least))


def value_fit(value: Column, mean: Column, sd: Column, most: Column) -> Column:
    """How usual a value is for a supplier: a bell around the mean, damped far above the greatest."""
    z = (value - mean) / F.nullif(sd, F.lit(0.0))
    bell = F.exp(-z * z / 2) * F.when(value > most * 3, 0.3).otherwise(1.0)
    flat = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.lit(1.0) - value / F.nullif(mean, F.lit(0.0))))
    return F.coalesce(bell, flat, F.lit(0.5))


def radar(c: dict[str, Column], weights: dict[str, int]) -> tuple[Column, Column, Column]:
    """(data, fit, action). c: booleans official, status_known, future_deadline, url, matched, fresh; missing, hits, km, near_km, modality_ok, documents, object_ok, blocked."""
    w = lambda cond, k: F.when(F.coalesce(cond, F.lit(False)), weights[k]).otherwise(0)
    data = sum((w(c[k], k) for k in ("official", "status_known", "future_deadline", "url", "matched", "fresh")), F.lit(0)) + F.round(F.lit(float(weights["completeness"])) * (7 - c["missing"]) / 7).cast("int")
    words = F.least(F.lit(weights["words"]), c["hits"] * max(1, weights["words"] // 3))
    near = F.when(c["km"].isNotNull(), F.round(weights["distance"] * (0.5 + 0.5 * F.greatest(F.lit(0.0), 1 - c["km"] / c["near_km"]))).cast("int"))
    fit = w(c["object_ok"], "object") + words + F.coalesce(near, F.lit(0)) + w(c["modality_ok"], "modality") + w(c["future_deadline"], "deadline") + w(c["documents"], "documents")
    action = F.when(c["blocked"] | (fit <= 20), "DESCARTAR").when((data >= 70) & (fit >= 55), "PRIORITARIA").otherwise("REVISAR")
    return data, fit, action


def bid_score(c: dict[str, Column]) -> tuple[Column, Column]:
    """(score, decision). c: fit, value, capital, roi, p_win (percent), km, urgency, competition."""
    finance = F.when(c["value"] / c["capital"] <= 1, 1.0).when(c["value"] / c["capital"] <= 3, 0.7).when(c["value"] / c["capital"] <= 5, 0.4).when(c["value"] / c["capital"] <= 10, 0.2).otherwise(0.05)
    roi = F.when(c["roi"] >= 5, 1.0).when(c["roi"] >= 3, 0.7).when(c["roi"] >= 1.5, 0.4).when(c["roi"] > 0, 0.1).otherwise(0.0)
    road = F.when(c["km"] <= 100, 1.0).when(c["km"] <= 300, 0.7).when(c["km"] <= 600, 0.4).otherwise(0.2)
    time = F.when(c["urgency"] == "URGENTE", 0.3).when(c["urgency"] == "IMINENTE", 0.6).when(c["urgency"] == "PLANEJAVEL", 1.0).otherwise(0.4)
    rivalry = F.when(c["competition"] == "BAIXA", 1.0).when(c["competition"] == "MEDIA", 0.7).when(c["competition"] == "ALTA", 0.4).when(c["competition"] == "MUITO_ALTA", 0.2).otherwise(0.5)
    score = c["fit"] * 0.20 + finance * 0.15 + roi * 0.15 + F.least(F.lit(1.0), c["p_win"] / 60) * 0.15 + road * 0.10 + time * 0.10 + rivalry * 0.15
    return score, F.when(score >= 0.45, "PARTICIPAR").otherwise("NAO_PARTICIPAR")


def expected_roi(value: Column, margin: Column, fiscal: Column, cost: Column, p: Column) -> tuple[Column, Column]:
    """(expected return, class): what a win brings after the cost, weighed by its chance."""
    win = value * margin * fiscal - cost
    expected = win * p
    return expected, F.when(win <= 0, "INVIAVEL").when(expected - cost > 0, "OPORTUNIDADE").otherwise("INVESTIMENTO_ESTRATEGICO")


# Categories of engineering works and services, and the terms that name them.
WORKS = {
    "CONSTRUCAO_NOVA": ("construcao", "construir", "implantacao", "edificacao nova"),
    "REFORMA": ("reforma", "reformar", "revitalizacao", "restauracao", "recuperacao"),
    "AMPLIACAO": ("ampliacao", "expansao", "acrescimo"),
    "MANUTENCAO_PREDIAL": ("manutencao predial", "manutencao preventiva", "manutencao corretiva"),
    "INFRAESTRUTURA_URBANA": ("infraestrutura urbana", "urbanizacao", "calcada", "acessibilidade"),
    "INFRAESTRUTURA_RODOVIARIA": ("rodovia", "estrada", "sinalizacao viaria", "infraestrutura viaria"),
    "PAVIMENTACAO": ("pavimentacao", "asfalto", "paver", "recapeamento"),
    "DRENAGEM": ("drenagem", "drenagem pluvial", "galeria pluvial"),
    "SANEAMENTO": ("saneamento",),
    "ABASTECIMENTO_DE_AGUA": ("rede de agua", "abastecimento de agua"),
    "ESGOTAMENTO_SANITARIO": ("rede de esgoto", "esgotamento sanitario"),
    "PONTES_E_OBRAS_DE_ARTE": ("ponte", "viaduto", "passarela", "obra de arte"),
    "CONTENCAO_E_GEOTECNIA": ("contencao", "muro de arrimo", "gabiao", "estabilizacao de encosta"),
    "TERRAPLENAGEM": ("terraplenagem",),
    "EDIFICACOES_PUBLICAS": ("escola", "hospital", "unidade de saude", "creche", "ginasio", "praca"),
    "INSTALACOES_ELETRICAS": ("instalacao eletrica", "iluminacao publica", "subestacao", "spda"),
    "INSTALACOES_HIDROSSANITARIAS": ("instalacao hidraulica", "hidrossanitario"),
    "CLIMATIZACAO": ("climatizacao", "ar condicionado", "hvac"),
    "PREVENCAO_CONTRA_INCENDIO": ("ppci", "preventivo contra incendio", "combate a incendio"),
    "PROJETOS_DE_ENGENHARIA": ("projeto executivo", "projeto basico", "projeto estrutural", "servicos de engenharia"),
    "FISCALIZACAO_E_SUPERVISAO": ("fiscalizacao de obra", "supervisao de obra", "gerenciamento de obra"),
    "LAUDOS_E_PERICIAS": ("laudo", "pericia"),
    "TOPOGRAFIA": ("topografia", "levantamento planialtimetrico"),
    "SONDAGEM": ("sondagem",),
    "ENGENHARIA_AMBIENTAL": ("engenharia ambiental", "licenciamento ambiental"),
    "OUTROS_SERVICOS_DE_ENGENHARIA_CIVIL": ("engenharia civil", "obra", "obras"),
}
# Terms that weigh more, terms of other trades and what they are, materials, words of works and services.
STRONG = (
    "obra", "obras", "construcao", "reforma", "ampliacao", "pavimentacao", "drenagem", "terraplenagem", "ponte", "rede de agua", "rede de esgoto",
    "engenharia civil", "servicos de engenharia", "projeto executivo", "fiscalizacao de obra",
)
OTHER_TRADES = {
    "engenharia de software": "software_only", "engenharia de dados": "software_only", "engenharia social": "software_only", "engenharia reversa de software": "software_only", "licenca de software": "software_only",
    "desenvolvimento de sistemas": "software_only", "sistema informatizado": "software_only", "manutencao de veiculos": "vehicle_only", "equipamento medico": "equipment_only",
}
MATERIALS = ("cimento", "brita", "areia", "tinta", "tubos", "cabos", "blocos")
SERVICES = ("execucao", "fornecimento de material e mao de obra", "mao de obra", "prestacao de servicos", "instalacao", "obra", "reforma", "construcao")
# Modalities of procurement that score.
SCORED_MODALITIES = (4, 5, 6, 7, 8, 9, 11, 12)


def engineering_class(text: Column, value: Column, modality: Column | None = None, has_items: Column | None = None, has_documents: Column | None = None) -> dict[str, Column]:
    """score (0 to 100), confidence, engineering, categories (sorted) and exclusion of a notice, from all its texts joined by blanks.

    A category scores 20 where the first of its terms found is a strong one, else 12; up to three strong terms score 12 each; phrases, items, documents,
    modality and value add to it. A term of another trade without a word of works or services ends it; materials without one reach 25 at most.
    """
    terms = sorted({t for ws in (*WORKS.values(), STRONG, OTHER_TRADES, MATERIALS, SERVICES, ("empresa especializada", "prestacao de servicos", "fornecimento de material e mao de obra")) for t in ws})
    # Through arrays of one, so that a row's text is folded once, searched once for each term, and its points are counted once.
    once = lambda c, then: F.get(F.transform(F.array(c), then), F.lit(0))
    found = lambda x: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t))
    counted = lambda met: once(_points(met, value, modality, has_items, has_documents), _judged)
    made = once(fold(F.coalesce(text, F.lit(""))), lambda x: once(found(x), counted))
    return {k: made[k] for k in ("score", "confidence", "engineering", "categories", "exclusion")}


def _points(met: Column, value: Column, modality: Column | None, has_items: Column | None, has_documents: Column | None) -> Column:
    """What the terms that a text holds (``met``) count for: score, trade, rescued, vetoed, material, categories, matched."""
    has = lambda w: F.array_contains(met, w)
    names = lambda ws: F.array(*map(F.lit, ws))
    points = lambda c, k: F.when(F.coalesce(c, F.lit(False)), k).otherwise(0) if c is not None else F.lit(0)
    trade = F.coalesce(*[F.when(has(w), F.lit(r)) for w, r in reversed(OTHER_TRADES.items())])  # the last one found names it
    rescued = F.arrays_overlap(met, names(SERVICES))
    hits = {c: F.coalesce(*[F.when(has(t), F.lit(20 if t in STRONG else 12)) for t in terms], F.lit(0)) for c, terms in WORKS.items()}
    strong = F.size(F.array_intersect(met, names(STRONG)))
    score = sum(hits.values(), F.least(F.lit(36), strong * 12))
    score = score + points(has("empresa especializada") & (strong > 0), 12) + points((has("execucao") | has("prestacao de servicos")) & (strong > 0), 10) + points(has("fornecimento de material e mao de obra"), 8)
    score = score + points(has_items, 12) + points(has_documents, 4) + points(modality.isin(*SCORED_MODALITIES) if modality is not None else None, 4)
    score = score + F.when(value >= 1_000_000, 8).when(value >= 100_000, 4).otherwise(0)
    categories = F.filter(F.array(*[F.when(F.arrays_overlap(met, names(WORKS[c])), F.lit(c)) for c in sorted(WORKS)]), lambda c: c.isNotNull())
    matched = F.size(F.array_intersect(met, names(sorted({t for ts in WORKS.values() for t in ts}))))
    return F.struct(score.alias("score"), trade.alias("trade"), rescued.alias("rescued"), (trade.isNotNull() & ~rescued).alias("vetoed"), F.arrays_overlap(met, names(MATERIALS)).alias("material"), categories.alias("categories"), matched.alias("matched"))


def _judged(p: Column) -> Column:
    vetoed, bare = p["vetoed"], p["material"] & ~p["rescued"] & (p["score"] < 60)
    final = F.when(vetoed, 0).otherwise(F.least(F.lit(100), F.when(bare, F.least(p["score"], F.lit(25))).otherwise(p["score"])))
    categories = F.when(vetoed, F.array().cast("array<string>")).otherwise(p["categories"])
    any_ = F.size(categories) > 0
    confidence = (
        F.when((final >= 80) & any_ & (p["matched"] >= 2), "engenharia_confirmada").when((final >= 60) & any_, "engenharia_provavel").when((final >= 40) & any_, "revisao_necessaria").otherwise("nao_relacionado")
    )
    exclusion = F.when(~vetoed & bare, "material_isolado").otherwise(p["trade"])
    return F.struct(final.cast("int").alias("score"), confidence.alias("confidence"), ((final >= 60) & any_).alias("engineering"), categories.alias("categories"), exclusion.alias("exclusion"))
