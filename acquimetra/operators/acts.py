"""Kinds of procurement acts, from weighted text fields by rules of falling priority.

Every rule is looked for in every field of a row, all as Column expressions in one pass without a shuffle. The rule of the
least priority that fires anywhere decides the category and, of the fields it fires in, the weightiest one the
confidence; numbers that look like those of procedures raise it, a rival category of near priority lowers it.

Patterns are matched on text without accents and with single blanks, so they are written that way; a word meets its pattern
with or without its accents. Null and empty fields take no part; a row of such fields only is ``outros``. Repeated rows are classified each.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acquimetra.functions import text as T

# Fields in falling weight, and the order in which their terms are listed.
FIELDS = (("title", 1.0), ("official_type", 0.95), ("subject", 0.85), ("category", 0.8), ("text", 0.75), ("secondary", 0.65))
LISTED = ("text", "secondary", "title", "subject", "official_type", "category")
# A match's score, least scores of the labels, least score without review, distance of rival priorities, length of evidence around a match.
MATCH, HIGH, MEDIUM, REVIEW, RIVAL, AROUND = 0.72, 0.8, 0.55, 0.7, 15, 24
_N = r"n[o°.]* ?[0-9]+"
# Category, priority, whether the row has to speak of procurement, pattern.
RULES = (
    ("termo_aditivo", 10, False, r"\b(termo aditiv|aditivo (ao|do|de) contrato|aditamento (contratual|de contrato|ao contrato)|extrato (do )?(termo )?aditiv)"),
    ("apostilamento", 11, False, r"\b(apostilamento|termo de apostila|apostila (ao|do|de) contrato)"),
    ("rescisao", 12, False, r"\b(rescisao (do |de |contratual)?|distrato (contratual|do contrato)?)"),
    (
        "outros_atos_contratacao", 13, False,
        r"\b(prorrogacao (de )?(prazo|vigencia|contrato)|reequilibrio economico|reajuste (de )?(preco|contratual)|ordem de servico|empenho (de despesa|n[o°.])|ratificacao (da )?(dispensa|inexigib|contrata)"
        r"|autorizacao de contratacao|comissao (permanente de )?licita|parecer juridico (da )?licita|designacao (d[eo] )?pregoeiro|equipe de apoio (do )?pregao)\b",
    ),
    ("extrato_contrato", 14, False, rf"\b(extrato (d[eo] )?contrato|celebracao de contrato|assinatura de contrato|contrato administrativo {_N}|^contrato {_N})"),
    ("ata_registro_precos", 15, False, r"\b(ata (de )?registro de precos?|arp n[o°.]*|registro de precos? n[o°.]*)"),
    ("intencao_registro_precos", 16, False, r"\b(intencao (de )?registro de precos?|irp\b|adesao a (ata de )?registro de precos?)"),
    ("homologacao", 20, False, r"\b(homologacao|homologa(r|do|da)?)\b"),
    ("adjudicacao", 21, False, r"\b(adjudicacao|adjudica(r|do|da)?)\b"),
    ("resultado", 22, False, r"\b(resultado (d[aoe] )?(licitacao|pregao|certame|concorrencia|dispensa)|resultado final d[ao] (certame|licita)|julgamento (d[aoe] )?(proposta|licita|habilita))"),
    ("revogacao", 30, True, r"\b(revogacao|revoga(r|do|da)?)\b"),
    ("anulacao", 31, True, r"\b(anulacao|anula(r|do|da)?)\b"),
    ("suspensao", 32, True, r"\b(suspensao|suspende(r|u)?|suspenso)\b"),
    ("reabertura", 33, True, r"\b(reabertura|reabre|republicacao para reabertura)\b"),
    ("errata", 40, False, r"\b(errata|retificacao de errata)\b"),
    ("retificacao", 41, True, r"\b(retificacao|retifica(r|do|da)?|republicacao)\b"),
    ("dispensa", 50, False, r"\b(dispensa (de )?licitacao|licitacao dispensada|dispensa eletronica|aviso de dispensa)\b"),
    ("inexigibilidade", 51, False, r"\b(inexigibilidade|inexigivel|contratacao direta por inexigib)"),
    ("credenciamento", 52, False, r"\b(credenciamento|chamamento para credenciamento|aviso de credenciamento)\b"),
    ("chamamento_publico", 53, False, r"\b(chamamento publico|chamada publica)\b"),
    ("consulta_publica", 54, False, r"\b(consulta publica|audiencia publica (de )?(licita|edital|contrata))\b"),
    ("edital", 60, False, rf"\b(edital de licitacao|edital de pregao|aviso de edital|publicacao (do )?edital|edital {_N})\b"),
    (
        "aviso_licitacao", 62, False,
        r"\b(aviso de licitacao|aviso de pregao|pregao (eletronico|presencial)|concorrencia (publica|eletronica|n[o°.])|tomada de precos?|convite n[o°.]"
        rf"|licitacao {_N}|abertura (de )?(licitacao|pregao|certame|sessao publica))\b",
    ),
)
#: Parts of words of which every match of a rule holds one; looking for them is far cheaper than the pattern.
STEMS = {
    "termo_aditivo": ("aditiv", "aditament"), "apostilamento": ("apostila",), "rescisao": ("rescisao", "distrato"),
    "outros_atos_contratacao": ("prorrogacao", "reequilibrio", "reajuste", "ordem de servico", "empenho", "ratificacao", "autorizacao", "comissao", "parecer", "designacao", "equipe de apoio"),
    "extrato_contrato": ("contrato",), "ata_registro_precos": ("registro de preco", "arp n"), "intencao_registro_precos": ("registro de preco", "irp"), "homologacao": ("homologa",), "adjudicacao": ("adjudica",), "resultado": ("resultado", "julgamento"),
    "revogacao": ("revoga",), "anulacao": ("anula",), "suspensao": ("suspen",), "reabertura": ("reabertura", "reabre", "republicacao"), "errata": ("errata",), "retificacao": ("retifica", "republicacao"), "dispensa": ("dispensa",), "inexigibilidade": ("inexig",),
    "credenciamento": ("credenciamento",), "chamamento_publico": ("chamamento", "chamada"), "consulta_publica": ("consulta", "audiencia"), "edital": ("edital",), "aviso_licitacao": ("aviso", "pregao", "concorrencia", "tomada", "convite", "licitacao", "abertura"),
}
# What speaks against procurement.
UNRELATED = (
    ("nomeacao_servidor", r"\b(nomeacao|nomear|nomeado[as]?)\b.*\b(servidor|cargo|funcao|comissionad)"),
    ("nomeacao_servidor_inv", r"\b(servidor|cargo|funcao)\b.*\b(nomeacao|nomeado)"),
    ("exoneracao", r"\b(exoneracao|exonerar|exonerado[as]?)\b"),
    ("aposentadoria", r"\b(aposentadoria|aposentar|aposentado[as]?)\b"),
    ("ferias", r"\b(ferias (coletivas|reglamentares|do servidor)|escala de ferias)\b"),
    ("licenca_servidor", r"\b(licenca[- ](premio|medica|gestante|paternidade|capacitacao))\b"),
    ("diario_ponto", r"\b(ponto facultativo|recesso administrativo|feriado (municipal|estadual|nacional))\b"),
    ("diarias", r"\b(diarias? (de viagem|a servidor)|indenizacao de transporte)\b"),
    ("portaria_rh", r"\b(portaria de (designacao|nomeacao|exoneracao)|lotacao)\b"),
    ("concurso_pessoal", r"\b(concurso publico|processo seletivo (simplificado|de pessoal)|edital de concurso publico)\b"),
    ("vacancia", r"\b(declaracao de vacancia|vacancia de cargo)\b"),
    ("posse", r"\b(posse (em|no|de) cargo|tomar posse)\b"),
    ("lei_organica", r"\b(lei organica|emenda a lei organica)\b"),
    ("comunicado_interno", r"\b(comunicado interno|aviso interno de ferias)\b"),
    ("saude_educacao_admin", r"\b(calendario escolar|matricula de vacinacao|campanha de vacinacao)\b"),
)
# Numbers of procedures.
NUMBERS = (
    ("num_pregao", rf"\bpregao (eletronico |presencial )?{_N}"),
    ("num_edital", rf"\bedital {_N}"),
    ("num_contrato", rf"\bcontrato {_N}"),
    ("num_processo", r"\b(processo|proc\.?) ?(administrativo )?n[o°.]* ?[0-9./-]+"),
    ("num_dispensa", rf"\bdispensa {_N}"),
    ("num_inexig", rf"\binexigibilidade {_N}"),
    ("num_arp", rf"\b(arp|ata) {_N}"),
    ("num_pe", r"\bpe ?n[o°.]* ?[0-9]+/[0-9]{2,4}\b"),
    ("num_concorrencia", rf"\bconcorrencia {_N}"),
    ("num_sei", r"\bsei ?n[o°.]* ?[0-9./-]+"),
)
# Words of procurement, whole as they stand here.
CONTEXT = (
    r"\b(licitacao|licitatori[oa]|certame|edital|pregao|concorrencia|tomada de precos?|convite|dispensa|inexigib|credenciament|chamamento|consulta publica|contrato|aditiv|apostilament|registro de precos?"
    r"|homologa|adjudica|arp|irp|sessao publica|comissao de licita|processo licitat)\b"
)


def _found(folded: Column, plain: Column, pattern: str) -> tuple[Column, Column]:
    """Place (from 1) and text, as written, of the first match; call only where there is one."""
    at = F.regexp_instr(folded, F.lit(pattern))
    return at, F.substr(plain, at, F.length(F.regexp_extract(folded, pattern, 0)))


def _named(folded: Column, plain: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Name and first match of every pattern that matches."""
    made = [F.when(folded.rlike(p), F.struct(F.lit(name).alias("name"), _found(folded, plain, p)[1].alias("term"))) for name, p in patterns]
    return F.array_compact(F.array(*made))


def _hits(parts: Column, context: Column, rule: tuple[str, int, bool, str]) -> Column:
    """The fields that a rule fires in, in the order in which terms are listed."""
    name, priority, needs_context, pattern = rule

    def hit(f: Column) -> Column:
        at, term = _found(f["folded"], f["plain"], pattern)
        made = F.struct(F.lit(name).alias("category"), F.lit(priority).alias("priority"), f["field"].alias("field"), f["weight"].alias("weight"), f["plain"].alias("plain"), term.alias("term"), at.alias("at"))
        may = reduce(or_, [F.contains(f["folded"], F.lit(stem)) for stem in STEMS[name]])
        return F.when(may & f["folded"].rlike(pattern), made)

    all_hits = F.array_compact(F.transform(parts, hit))
    return F.when(context != "", all_hits).otherwise(F.array().cast("array<struct<category:string,priority:int,field:string,weight:double,plain:string,term:string,at:int>>")) if needs_context else all_hits


def _joined(start: str, names: Column) -> Column:
    return F.concat(F.lit(start), F.array_join(names, ", "))


def classify(df: DataFrame, fields: dict[str, str], to: str = "act") -> DataFrame:
    """``df`` with a struct ``to``; ``fields`` maps names of ``FIELDS`` to columns.

    The struct has category, confidence, confidence_label, rules_fired, terms_found, reason, needs_human_review, matched_rule (a rule's name) and evidence.
    """
    used = [(name, w) for name, w in FIELDS if name in fields]
    work, rest = "_act", F.lit(None).cast("string")
    field = lambda name, w: F.struct(F.lit(name).alias("field"), F.lit(w).alias("weight"), T.collapse(F.col(fields[name]).cast("string")).alias("plain"))
    out = df.withColumn(work, F.filter(F.array(*[field(*f) for f in used]), lambda f: f["plain"] != ""))
    out = out.withColumn(work, F.struct(F.transform(work, lambda f: F.struct(f["field"], f["weight"], f["plain"], T.fold_in_place(f["plain"]).alias("folded"))).alias("parts"), F.array_join(F.transform(work, lambda f: f["plain"]), " ").alias("blob")))
    w = F.col(work)
    order = F.create_map(*[x for i, name in enumerate(LISTED) for x in (F.lit(name), F.lit(i))])
    listed = F.array_sort(w["parts"], lambda a, b: order[a["field"]] - order[b["field"]])
    out = out.withColumn(work, w.withField("folded", T.fold_in_place(w["blob"])).withField("listed", listed))
    out = out.withColumn(work, w.withField("context", F.regexp_extract(w["folded"], CONTEXT, 0)).withField("numbers", F.transform(_named(w["folded"], w["blob"], NUMBERS), lambda x: x["name"])).withField("against", _named(w["folded"], w["blob"], UNRELATED)))
    out = out.withColumn(work, w.withField("hits", F.concat(*[_hits(w["listed"], w["context"], r) for r in RULES])))
    best = F.array_max(F.transform(w["hits"], lambda h: F.struct((-h["priority"]).alias("p"), h["weight"].alias("w"), h.alias("hit"))))["hit"]
    out = out.withColumn(work, w.withField("best", best).withField("fired", F.array_distinct(F.transform(w["hits"], lambda h: h["category"]))))
    hit, numbers, names = w["best"], w["numbers"], F.transform(w["against"], lambda x: x["name"])
    rivals = F.exists(w["hits"], lambda h: (h["category"] != hit["category"]) & (F.abs(h["priority"] - hit["priority"]) <= RIVAL))
    alone = (hit["field"] == "text") & F.forall(w["parts"], lambda f: f["field"].isin("text", "secondary"))
    confidence = (
        F.lit(MATCH) * (F.lit(0.55) + F.lit(0.45) * hit["weight"])
        + F.lit(0.08) * F.least(F.size(numbers), F.lit(3))
        + F.when(hit["field"].isin("title", "official_type") | alone, 0.12).otherwise(0.0)
        - F.when(rivals, 0.1).otherwise(0.0)
    )
    out = out.withColumn(work, w.withField("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).withField("rivals", rivals))
    low = lambda terms: F.transform(terms, lambda x: F.lower(x))
    reason = F.concat_ws(
        "; ",
        F.concat(F.lit("regra '"), hit["category"], F.lit("' em campo '"), hit["field"], F.lit("'")),
        F.when(F.size(numbers) > 0, _joined("padroes numericos: ", numbers)),
        F.when(w["rivals"], _joined("categorias candidatas: ", w["fired"])),
        F.when(F.size(names) > 0, _joined("expressoes negativas tambem presentes: ", names)),
    )
    review = (w["score"] < REVIEW) | w["rivals"] | (hit["category"] == "outros_atos_contratacao") | (F.size(w["fired"]) > 2) | (F.size(names) > 0)
    terms = F.concat(F.array_distinct(F.concat(F.array(F.lower(hit["term"])), low(F.transform(w["hits"], lambda h: h["term"])))), numbers)
    first = F.greatest(F.lit(1), hit["at"] - AROUND)
    evidence = F.substr(hit["plain"], first, hit["at"] + F.length(hit["term"]) + AROUND - first)
    some = F.size(numbers) > 0
    none = F.array().cast("array<string>")
    context_term = F.when(w["context"] != "", F.array(F.lower(F.substr(w["blob"], F.regexp_instr(w["folded"], F.lit(CONTEXT)), F.length(w["context"]))))).otherwise(none)
    residual = "procurement_context_residual"
    made: list[tuple[Column, tuple]] = [
        (w["blob"] == "", (F.lit("outros"), F.lit(0.1), none, none, F.lit("texto vazio"), F.lit(True), rest, F.lit(""))),
        (hit.isNotNull(), (hit["category"], w["score"], w["fired"], terms, reason, review, hit["category"], evidence)),
        (
            F.size(names) > 0,
            (
                F.lit("nao_relacionado"), F.when(some, 0.55).otherwise(0.82), F.transform(names, lambda n: F.concat(F.lit("neg:"), n)), F.concat(low(F.transform(w["against"], lambda x: x["term"])), numbers),
                _joined("expressoes nao relacionadas a contratacao: ", names), some, F.get(names, F.lit(0)), F.get(w["against"], F.lit(0))["term"],
            ),
        ),
        (
            (w["context"] != "") | some,
            (F.lit("outros_atos_contratacao"), F.when(some, 0.4).otherwise(0.35), F.array(F.lit(residual)), F.concat(context_term, numbers), F.lit("contexto de contratacao detectado sem ato especifico"), F.lit(True), F.lit(residual), F.substring(w["blob"], 1, 100)),
        ),
        (F.lit(True), (F.lit("outros"), F.lit(0.15), none, numbers, F.lit("nenhuma regra de classificacao acionada"), F.lit(True), rest, F.substring(w["blob"], 1, 80))),
    ]
    keys = ("category", "confidence", "rules_fired", "terms_found", "reason", "needs_human_review", "matched_rule", "evidence")
    cases = F.coalesce(*[F.when(test, F.struct(*[v.alias(k) for k, v in zip(keys, values, strict=True)])) for test, values in made])
    out = out.withColumn(to, cases).drop(work)
    score = F.col(to)["confidence"]
    return out.withColumn(to, F.col(to).withField("confidence_label", F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")))
