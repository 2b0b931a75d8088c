"""Procurement acts that orders announce, classified; every order gets a title, an official type and a body by its date, priority and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.operators import acts
from acquimetra.sources.tables import Tables

_TITLES = (
    "Homologação do Pregão Eletrônico nº {}/2026", "Extrato de Contrato nº {}", "Aviso de Licitação", "Segundo Termo Aditivo ao Contrato nº {}", "Edital de Concurso Público nº {}", "", "Suspensão de prazo",
    "Dispensa de Licitação - processo nº {}", "Errata da publicação {}", "Ata de Registro de Preços nº {}", "Nomeação de servidor para cargo {}", "Comunicado {}",
)
_TYPES = {"1-URGENT": "Adjudicação", "2-HIGH": "Retificação", "3-MEDIUM": "", "4-NOT SPECIFIED": "Portaria de designação", "5-LOW": "Aviso"}
_BODIES = (
    "O certame segue  suspenso até nova data", "Ficam revogados os itens 3 e 4", "Resultado do julgamento da proposta do pregão nº {}", "Texto sem palavras conhecidas", "", "Férias coletivas no período", "Inexigibilidade nº {} ratificada",
    "Convite n. {} e tomada de preços", "Chamamento público para credenciamento", "Reabertura\tda sessão pública", "Rescisão contratual com a empresa {}", "Consulta pública da minuta de edital nº {}", "Ordem de serviço e empenho nº {}",
)


def _sql_list(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + "]"


def _pattern_rows(rows: tuple) -> str:
    return ", ".join(f"({i}, '{r[0]}', {r[1] if len(r) == 4 else 0}, {str(len(r) == 4 and r[2]).upper()}, '{r[-1]}')" for i, r in enumerate(rows))


_SQL = rf"""WITH o AS (SELECT o_orderkey AS id, replace(({_sql_list(_TITLES)})[month(o_orderdate)], '{{}}', CAST(o_custkey AS VARCHAR)) AS title,
 CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())} END AS official_type,
 replace(({_sql_list(_BODIES)})[1 + (day(o_orderdate) - 1) % {len(_BODIES)}], '{{}}', CAST(o_custkey AS VARCHAR)) AS body FROM orders),
raw_ AS (SELECT id, 'title' AS field, 1.0 AS w, 1 AS blob_at, 3 AS listed, title AS t FROM o UNION ALL SELECT id, 'official_type', 0.95, 2, 5, official_type FROM o UNION ALL SELECT id, 'text', 0.75, 5, 1, body FROM o),
f AS (SELECT id, field, CAST(w AS DOUBLE) AS w, blob_at, listed, trim(regexp_replace(translate(t, 'ºª', 'oa'), '\s+', ' ', 'g')) AS t FROM raw_ WHERE coalesce(trim(regexp_replace(t, '\s+', ' ', 'g')), '') <> ''),
b AS (SELECT o.id, coalesce(string_agg(t, ' ' ORDER BY blob_at), '') AS blob, strip_accents(lower(coalesce(string_agg(t, ' ' ORDER BY blob_at), ''))) AS flat, coalesce(bool_and(field = 'text'), false) AS alone FROM o LEFT JOIN f ON f.id = o.id GROUP BY o.id),
rules AS (SELECT * FROM (VALUES {_pattern_rows(acts.RULES)}) v(n, name, priority, needs, pattern)),
numbers AS (SELECT * FROM (VALUES {_pattern_rows(acts.NUMBERS)}) v(n, name, priority, needs, pattern)),
unrelated AS (SELECT * FROM (VALUES {_pattern_rows(acts.UNRELATED)}) v(n, name, priority, needs, pattern)),
c AS (SELECT id, blob, alone, regexp_extract(flat, '{acts.CONTEXT}') AS ctx, coalesce((SELECT list(name ORDER BY n) FROM numbers WHERE regexp_matches(flat, pattern)), []) AS nums,
 coalesce((SELECT list(name ORDER BY n) FROM unrelated WHERE regexp_matches(flat, pattern)), []) AS against FROM b),
hits AS (SELECT f.id, r.name, r.priority, f.field, f.w, f.listed, r.n FROM f JOIN c ON c.id = f.id JOIN rules r ON regexp_matches(strip_accents(lower(f.t)), r.pattern) WHERE NOT r.needs OR c.ctx <> ''),
best AS (SELECT id, name, priority, field, w FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, w DESC) = 1),
fired AS (SELECT h.id, list(DISTINCT h.name) AS names, bool_or(h.name <> best.name AND abs(h.priority - best.priority) <= 15) AS rivals FROM hits h JOIN best ON best.id = h.id GROUP BY h.id),
s AS (SELECT best.id, greatest(0, least(1, 0.72 * (0.55 + 0.45 * best.w) + 0.08 * least(3, len(nums)) + CASE WHEN best.field IN ('title', 'official_type') OR (best.field = 'text' AND alone) THEN 0.12 ELSE 0 END - CASE WHEN rivals THEN 0.1 ELSE 0 END)) AS score
 FROM best JOIN fired ON fired.id = best.id JOIN c ON c.id = best.id),
r AS (SELECT c.id, CASE WHEN blob = '' THEN 'outros' WHEN best.id IS NOT NULL THEN best.name WHEN len(against) > 0 THEN 'nao_relacionado' WHEN ctx <> '' OR len(nums) > 0 THEN 'outros_atos_contratacao' ELSE 'outros' END AS category,
 CASE WHEN blob = '' THEN 0.1 WHEN best.id IS NOT NULL THEN score WHEN len(against) > 0 THEN CASE WHEN len(nums) > 0 THEN 0.55 ELSE 0.82 END WHEN len(nums) > 0 THEN 0.4 WHEN ctx <> '' THEN 0.35 ELSE 0.15 END AS confidence,
 CASE WHEN best.id IS NULL THEN NULL ELSE best.field END AS field, array_to_string(list_sort(coalesce(fired.names, [])), ',') AS fired, array_to_string(nums, ',') AS numbers, array_to_string(against, ',') AS against,
 CASE WHEN best.id IS NOT NULL THEN score < 0.7 OR rivals OR best.name = 'outros_atos_contratacao' OR len(names) > 2 OR len(against) > 0 WHEN blob <> '' AND len(against) > 0 THEN len(nums) > 0 ELSE true END AS review
 FROM c LEFT JOIN best ON best.id = c.id LEFT JOIN fired ON fired.id = c.id LEFT JOIN s ON s.id = c.id)
SELECT id, category, round(CAST(confidence AS DOUBLE), 6) AS confidence, field, fired, numbers, against, review FROM r"""


def _pick(texts: tuple[str, ...], at: Column) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, texts)), at), F.lit("{}"), F.col("o_custkey").cast("string"))


@query("act_classes", _SQL)
def act_classes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    o = Tables(spark, d).orders.select(
        F.col("o_orderkey").alias("id"), _pick(_TITLES, F.month("o_orderdate")).alias("title"), F.try_element_at(kinds, F.col("o_orderpriority")).alias("official_type"), _pick(_BODIES, 1 + (F.dayofmonth("o_orderdate") - 1) % len(_BODIES)).alias("body")
    )
    x = acts.classify(o, {"title": "title", "official_type": "official_type", "text": "body"})
    a = F.col("act")
    names = lambda kind: F.array_join(F.transform(F.filter(F.array(*[F.lit(r[0]) for r in kind]), lambda n: F.array_contains(a["terms_found"], n)), lambda n: n), ",")
    negative = F.regexp_extract(a["reason"], "(?:contratacao|tambem presentes): ([a-z_, ]+)$", 1)
    rule = a["category"].isin(*[r[0] for r in acts.RULES]) & ~F.coalesce(a["matched_rule"] == "procurement_context_residual", F.lit(True))
    return x.select(
        "id", a["category"].alias("category"), F.round(a["confidence"], 6).alias("confidence"), F.nullif(F.regexp_extract(a["reason"], "em campo '([a-z_]+)'", 1), F.lit("")).alias("field"),
        F.when(rule, F.array_join(F.array_sort(a["rules_fired"]), ",")).otherwise("").alias("fired"), names(acts.NUMBERS).alias("numbers"), F.replace(negative, F.lit(", "), F.lit(",")).alias("against"), a["needs_human_review"].alias("review"),
    )
