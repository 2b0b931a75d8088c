"""Judgements on records as Column expressions: commercial status, reliability of data, percentages that may be published, fit to a sector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acquimetra.functions.text import fold

# Categories of acts by what they mean.
OPPORTUNITY = ("aviso_licitacao", "edital", "dispensa", "inexigibilidade", "chamamento_publico", "credenciamento", "intencao_registro_precos", "reabertura", "consulta_publica")
RESULT, CONTRACT, AMENDMENT = ("homologacao", "adjudicacao", "resultado"), ("extrato_contrato", "ata_registro_precos", "rescisao"), ("termo_aditivo", "apostilamento")
SUSPENDED, SECONDARY = ("suspensao", "revogacao", "anulacao"), ("retificacao", "errata", "outros_atos_contratacao")
# What official states say, without accents.
OPEN_STATE = r"\b(em +recebimento +de +proposta|recebendo +proposta|aguardando +abertura( +da +sessao)?|em +sessao|fase +de +lance|em +andamento +(de +)?(proposta|lance|sessao))\b"
RESULT_STATE = r"\b(resultado|publicad[oa] +resultado|divulgacao +do +resultado|homologad[oa]|adjudicad[oa]|aguardando +homologa)\b"
CLOSED_STATE = r"\b(homologad[oa]|finalizad[oa]|encerrad[oa]|concluid[oa]|adjudicad[oa]|fracassad[oa]|deserto|revogad[oa]|anulad[oa]|cancelad[oa]|licitacao +finalizada|aguardando +homologa|resultado +da +licita|publicad[oa] +resultado)\b"
SUSPENDED_STATE, REVOKED_STATE = r"\b(suspens[oa]|sine[- ]?die|interromp|paralisad)\b", r"\b(revogad|anulad|cancelad)\b"
SIGNAL, WEAK_SIGNAL = r"\b(edital|aviso +de +licita|pregao|concorrencia|dispensa|inexigib)\b", r"\blicita|contrato|edital|preg"
# Hours until data is late and until it is of no use; states of sources.
LATE_HOURS, DEAD_HOURS = 24.0, 168.0
BROKEN, WEAKENED, WELL = ("down", "error", "failed", "unhealthy", "broken"), ("degraded", "partial", "stale"), ("ok", "healthy", "up", "green")


def commercial_status(category: Column, title: Column, text: Column, state: Column, opens: Column, closes: Column, published: Column, as_of: Column, recent_days: int = 30) -> Column:
    """A struct of status, rule, confidence and review: what a record means to somebody who wants to bid.

    A null or blank category is none; of title and text the first 2,000 and 4,000 characters are read. rule names what decided.
    """
    empty = F.lit("")
    cat = F.lower(F.trim(F.coalesce(category, empty)))
    said = F.trim(fold(F.coalesce(state, empty)))
    blob = F.concat_ws("\n", F.left(F.coalesce(title, empty), F.lit(2000)), F.left(F.coalesce(text, empty), F.lit(4000)), F.coalesce(state, empty))
    blob = F.regexp_replace(fold(blob), r"\s", " ")
    is_ = lambda kinds: cat.isin(*kinds)
    say = lambda pattern: said.rlike(pattern)
    out = lambda status, rule, confidence, review=False: F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), F.lit(rule).alias("rule"), F.lit(confidence).cast("double").alias("confidence"), (review if isinstance(review, Column) else F.lit(review)).alias("review"))
    age = F.datediff(as_of, published)
    revoked = is_(("revogacao", "anulacao")) | say(REVOKED_STATE)
    opportunity = is_(OPPORTUNITY) | blob.rlike(SIGNAL)
    default = F.when(is_(("", "outros")) & ~blob.rlike(WEAK_SIGNAL), "NOT_RELEVANT").otherwise("OTHER_PROCUREMENT_ACT")
    return (
        F.when(cat == "nao_relacionado", out("NOT_RELEVANT", "unrelated_act", 0.95))
        .when(is_(SUSPENDED) | say(SUSPENDED_STATE) | say(REVOKED_STATE), out(F.when(revoked, "CLOSED").otherwise("SUSPENDED"), "suspend_or_revoke", 0.9))
        .when(is_(CONTRACT), out("CONTRACT", "contract_act", 0.92)).when(is_(AMENDMENT), out("AMENDMENT", "amendment_act", 0.92)).when(is_(RESULT), out("RESULT", "result_act", 0.9))
        .when(say(RESULT_STATE), out("RESULT", "result_state", 0.9))
        .when(say(CLOSED_STATE) & ~say(OPEN_STATE), out(F.when(said.rlike("homolog|adjudic|finaliz|conclu|resultado"), "RESULT").otherwise("CLOSED"), "closed_state", 0.88))
        .when(closes < as_of, out("CLOSED", "deadline_passed", 0.93)).when(closes.isNotNull() & (opens > as_of), out("UPCOMING_OPPORTUNITY", "opens_in_future", 0.9)).when(closes.isNotNull(), out("OPEN_OPPORTUNITY", "deadline_open", 0.92))
        .when(say(OPEN_STATE), out("OPEN_OPPORTUNITY", "open_state", 0.85, True))
        .when(opportunity & age.between(0, recent_days), out("RECENT_NOTICE", "recent_notice", 0.75, True)).when(opportunity, out("OTHER_PROCUREMENT_ACT", "opportunity_without_deadline", 0.65, True))
        .when(is_(SECONDARY), out("OTHER_PROCUREMENT_ACT", "secondary_act", 0.7))
        .otherwise(F.struct(default.alias("status"), F.lit("no_signal").alias("rule"), F.when(is_(("", "outros")), 0.4).otherwise(0.55).alias("confidence"), F.lit(True).alias("review")))
    )


def reliability(age_hours: Column, required: list[Column], provenance: Column, health: Column, sample: Column, query_valid: Column, least_sample: int = 1) -> Column:
    """A struct of level and signals: whether data may carry a decision. The worst sign decides, and TRUSTED takes three good ones.

    ``required`` are conditions that hold where a field is there; what is null is no sign, good or bad.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    state = F.lower(F.trim(F.coalesce(health, F.lit(""))))
    lacking = sum(((~yes(c)).cast("int") for c in required), F.lit(0))
    good = sum((yes(c).cast("int") for c in (age_hours <= LATE_HOURS, provenance, query_valid, state.isin(*WELL), F.lit(bool(required)) & (lacking == 0), sample >= least_sample)), F.lit(0))
    bad = yes(~query_valid) | yes(~provenance) | state.isin(*BROKEN) | yes(age_hours > DEAD_HOURS) | (yes(sample <= 0) & F.lit(least_sample > 0)) | (F.lit(bool(required)) & (lacking == len(required)))
    weak = (lacking > 0) | state.isin(*WEAKENED) | yes(age_hours > LATE_HOURS) | yes(sample < least_sample)
    level = F.when(bad, "UNTRUSTED").when(weak, "DEGRADED").when(good >= 3, "TRUSTED").when(good > 0, "DEGRADED").otherwise("UNKNOWN")
    return F.struct(level.alias("level"), good.alias("signals"))


def bare_percentage(percentage: Column, denominator: Column, limitations: Column) -> Column:
    """Why a percentage may not be published, null if it may: it needs a denominator above 0 and a limitation (of an array of texts) that says something."""
    said = F.coalesce(F.size(F.filter(limitations, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")), F.lit(0)) > 0
    no_n = F.when(denominator.isNull() | (denominator < 0), "no_denominator").when(denominator == 0, "empty_denominator")
    return F.when(percentage.isNotNull(), F.nullif(F.concat_ws(",", no_n, F.when(~said, "no_limitations")), F.lit("")))


def sector_fit(text: Column, strong: str | None, weak: str | None, against: str | None) -> Column:
    """COMPATIVEL, INCOMPATIVEL or NEEDS_REVIEW by a sector's patterns on the text in lower case; strong ones against each other leave it open, a weak one counts unless something is against."""
    x = F.lower(F.coalesce(text, F.lit("")))
    has = lambda p: x.rlike(p) if p else F.lit(False)
    return F.when(has(strong) & ~has(against), "COMPATIVEL").when(has(against) & ~has(strong), "INCOMPATIVEL").when(has(weak) & ~has(against), "COMPATIVEL").otherwise("NEEDS_REVIEW")
