"""Act classes: expected rows by hand for every rule, for priorities, rivals, context, unrelated acts and empty rows."""

from __future__ import annotations

import pytest

from acquimetra.operators import acts

SHAPE = "id int, title string, official_type string, subject string, category string, text string, secondary string"
NONE = {"title": None, "official_type": None, "subject": None, "category": None, "text": None, "secondary": None}
#: One text for every rule: with only a text, a match counts 0.72 * (0.55 + 0.45 * 0.75) + 0.12 = 0.759.
BY_TEXT = {
    "Extrato de Contrato com a empresa": ("extrato_contrato", 0.759),
    "Primeiro Termo Aditivo ao ajuste": ("termo_aditivo", 0.759),
    "Apostilamento de valores": ("apostilamento", 0.759),
    "Rescisão unilateral do ajuste": ("rescisao", 0.759),
    "Ordem de Serviço para início": ("outros_atos_contratacao", 0.759),
    "Ata de Registro de Preços de materiais": ("ata_registro_precos", 0.759),
    "Intenção de Registro de Precos": ("intencao_registro_precos", 0.759),
    "HOMOLOGAÇÃO do procedimento": ("homologacao", 0.759),
    "fica adjudicado o objeto": ("adjudicacao", 0.759),
    "Resultado da Licitação": ("resultado", 0.759),
    "Revogação do certame": ("revogacao", 0.759),
    "Anulação do certame": ("anulacao", 0.759),
    "Suspende o certame": ("suspensao", 0.759),
    "Reabertura do certame": ("reabertura", 0.759),
    "Errata da publicação": ("errata", 0.759),
    "Retificação do certame": ("retificacao", 0.759),
    "Dispensa de Licitação": ("dispensa", 0.759),
    "Inexigível a disputa": ("inexigibilidade", 0.759),
    "Credenciamento de médicos": ("credenciamento", 0.759),
    "Chamada Pública de agricultores": ("chamamento_publico", 0.759),
    "Consulta Pública de minuta": ("consulta_publica", 0.759),
    "Aviso de Edital": ("edital", 0.759),
    "Tomada de Preços": ("aviso_licitacao", 0.759),
    "Suspensão de férias do setor": ("outros", 0.15),
    "Nomeação de servidor para cargo": ("nao_relacionado", 0.82),
    "Férias coletivas em julho": ("nao_relacionado", 0.82),
    "Ponto Facultativo na sexta": ("nao_relacionado", 0.82),
    "Assunto do certame em estudo": ("outros_atos_contratacao", 0.35),
    "Processo nº 12/2026 arquivado": ("outros_atos_contratacao", 0.4),
    "Calendário de eventos": ("outros", 0.15),
    "": ("outros", 0.1),
}


def classified(spark, rows):
    df = spark.createDataFrame([(i, *[{**NONE, **r}[k] for k in NONE]) for i, r in enumerate(rows)], SHAPE)
    return [r.act for r in acts.classify(df, {k: k for k in NONE}).orderBy("id").collect()]


def test_every_rule_by_text(spark):
    got = classified(spark, [{"text": t} for t in BY_TEXT])
    assert {t: (a.category, round(a.confidence, 6)) for t, a in zip(BY_TEXT, got, strict=True)} == BY_TEXT
    assert {r[0] for r in acts.RULES} | {"nao_relacionado", "outros"} == {a.category for a in got}


def test_fields_numbers_rivals(spark):
    rows = [
        {"title": "Homologação do Pregão Eletrônico nº 12/2026", "text": "texto do corpo"},
        {"text": "Homologação e Adjudicação do Pregão nº 05/2026"},
        {"text": "Publicação do processo.", "official_type": "Dispensa de Licitação", "title": "Serviços de impressão"},
        {"text": "Abre inscrições para concurso público de cargos.", "title": "Edital de Concurso Público nº 01/2026"},
        {"text": "Publicação oficial", "secondary": "Homologação do certame"},
        {"title": "Extrato de Termo Aditivo ao Contrato nº 10/2023", "subject": "Contrato nº 10/2023", "category": "Aditivo do contrato"},
        {"text": "Exoneração após homologação"},
    ]
    a = classified(spark, rows)
    # 0.72 + 0.08 + 0.12; the notice of the auction is 42 apart in priority and no rival, yet two categories fire.
    assert (a[0].category, round(a[0].confidence, 6), a[0].confidence_label, a[0].needs_human_review) == ("homologacao", 0.92, "high", False)
    assert a[0].rules_fired == ["homologacao", "aviso_licitacao"] and a[0].terms_found == ["homologação", "pregão eletrônico", "num_pregao"]
    assert a[0].evidence == "Homologação do Pregão Eletrônico no" and a[0].reason == "regra 'homologacao' em campo 'title'; padroes numericos: num_pregao"
    # 0.639 + 0.08 + 0.12 - 0.1 for the rival one place below.
    assert (a[1].category, round(a[1].confidence, 6), a[1].confidence_label, a[1].needs_human_review) == ("homologacao", 0.739, "medium", True)
    assert a[1].reason.endswith("categorias candidatas: homologacao, adjudicacao")
    # 0.72 * (0.55 + 0.45 * 0.95) + 0.12
    assert (a[2].category, round(a[2].confidence, 6), a[2].evidence) == ("dispensa", 0.8238, "Dispensa de Licitação")
    assert (a[3].category, a[3].rules_fired, a[3].confidence, a[3].needs_human_review) == ("nao_relacionado", ["neg:concurso_pessoal"], 0.82, False)
    # 0.72 * (0.55 + 0.45 * 0.65), no bonus for a secondary text
    assert (a[4].category, round(a[4].confidence, 6), a[4].needs_human_review) == ("homologacao", 0.6066, True)
    assert a[5].category == "termo_aditivo" and a[5].matched_rule == "termo_aditivo" and a[5].terms_found == ["termo aditiv", "aditivo do contrato", "contrato no 10", "num_contrato"]
    assert a[6].category == "homologacao" and a[6].needs_human_review and a[6].reason.endswith("expressoes negativas tambem presentes: exoneracao")


@pytest.mark.parametrize("text", [None, "", "  \n "])
def test_empty_rows(spark, text):
    (a,) = classified(spark, [{"text": text}])
    assert (a.category, a.confidence, a.reason, a.needs_human_review, a.evidence, a.matched_rule) == ("outros", 0.1, "texto vazio", True, "", None)


def test_long_text_and_extra_columns(spark):
    df = spark.createDataFrame([("x " * 50_000 + "homologação", 1), (None, 2)], "text string, blob int")
    rows = {r.blob: r.act.category for r in acts.classify(df, {"text": "text"}).collect()}
    assert rows == {1: "homologacao", 2: "outros"}
