"""Records of several sources and versions, as JSON, in one schema; what can't be read is kept with a reason.

A record is parsed once, to a variant, and fields are taken out of it by the list of names that each version may give them. The first
name that holds something counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acquimetra.functions.parse import any_date, brazilian_number

# Where each version has a field, in the order in which they are tried.
NATIONAL = {
    "source_id": ("numeroControlePNCP", "id"), "orgao_cnpj": ("orgaoCNPJ", "orgaoCnpj", "orgaoEntidade.cnpj"), "orgao_nome": ("orgaoRazaoSocial", "orgaoNome", "orgaoEntidade.razaoSocial"),
    "objeto": ("objeto", "objetoCompra", "descricaoObjeto"), "modalidade": ("modalidadeNome",), "modalidade_id": ("codigoModalidade", "modalidadeId"), "uf": ("uf",), "municipio": ("municipio", "nomeMunicipio", "unidadeOrgao.municipioNome"),
    "codigo_ibge": ("codigoMunicipioIbge", "codigoIBGE", "unidadeOrgao.codigoIbge"), "numero_processo": ("numeroProcesso",), "numero_edital": ("numeroEdital", "numeroCompra"), "valor": ("valorTotalEstimado", "valorEstimado"),
    "publicado": ("dataPublicacao", "dataPublicacaoPncp"), "aberto": ("dataAbertura", "dataAberturaProposta"), "encerrado": ("dataEncerramento", "dataEncerramentoProposta", "dataFechamentoProposta"),
    "status_fonte": ("situacaoCompra", "situacaoCompraNome", "situacao"), "link": ("linkSistemaOrigem", "urlSistemaOrigem"), "url": ("linkPNCP", "url"),
}
GAZETTE = {"source_id": ("id",), "orgao_nome": ("entidade", "nome_entidade"), "objeto": ("titulo", "Ato[titulo]"), "publicado": ("data_publicacao",), "status_fonte": ("status",), "link": ("url", "url_web"), "url": ("url", "url_web")}
GENERIC = {
    "source_id": ("id", "source_id", "identificador"), "orgao_cnpj": ("orgao_cnpj", "cnpj", "orgaoCNPJ"), "orgao_nome": ("orgao_nome", "nome_orgao", "orgaoRazaoSocial"), "objeto": ("objeto", "descricao", "titulo", "nome"),
    "modalidade": ("modalidade",), "uf": ("uf", "UF"), "municipio": ("municipio", "cidade", "nomeMunicipio"), "codigo_ibge": ("codigo_ibge", "codigoIBGE"), "numero_processo": ("numero_processo", "processo"), "numero_edital": ("numero_edital", "edital"),
    "valor": ("valor", "valor_estimado", "valorTotal"), "publicado": ("data_publicacao", "dataPublicacao"), "aberto": ("data_abertura", "dataAbertura"), "encerrado": ("data_encerramento", "dataEncerramento"),
    "status_fonte": ("status", "situacao"), "link": ("link_edital", "url"), "url": ("url", "link"),
}
VERSIONS = {"pncp": NATIONAL, "dom_sc": GAZETTE}
# The state of records that name none, and the subject of acts without a title.
STATE, UNTITLED = "SC", "Publicação DOM-SC"
FIELDS = tuple(NATIONAL)


def _path(name: str) -> str:
    return "$" + "".join(f"['{part}']" for part in ([name] if "[" in name else name.split(".")))


def first_of(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields of a variant that holds something, as text."""
    return F.coalesce(F.lit(None).cast("string"), *[F.nullif(F.trim(F.try_variant_get(record, _path(n), "string")), F.lit("")) for n in names])


def normalized(df: DataFrame, source: str, json: str) -> DataFrame:
    """``df`` with a struct ``record`` of ``FIELDS`` and ``reason``, null for records that can be used.

    valor is a double, modalidade_id an int, publicado, aberto and encerrado are dates; unreadable ones are null. A record that is no JSON object (``malformed``), or has no
    id (``no_id``) or no subject (``no_subject``), keeps its row with the reason; sources without a version of their own are read by the generic names.
    """
    parsed = df.withColumn("_v", F.try_parse_json(F.col(json)))
    parsed = parsed.withColumn("_object", F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False)))

    def field(name: str) -> Column:
        out = F
        for version, names in VERSIONS.items():
            out = out.when(F.col(source) == version, first_of(F.col("_v"), names.get(name, ())))
        return out.otherwise(first_of(F.col("_v"), GENERIC.get(name, ())))

    text = {name: field(name) for name in FIELDS}
    text["uf"] = F.coalesce(text["uf"], F.when(F.col("_object"), STATE))
    text["objeto"] = F.coalesce(text["objeto"], F.when(F.col("_object") & (F.col(source) == "dom_sc"), UNTITLED))
    typed = {name: any_date(c) if name in ("publicado", "aberto", "encerrado") else brazilian_number(c) if name == "valor" else c.try_cast("int") if name == "modalidade_id" else c for name, c in text.items()}
    out = parsed.withColumn("record", F.struct(*[c.alias(name) for name, c in typed.items()]))
    reason = F.when(~F.col("_object"), "malformed").when(F.col("record.source_id").isNull(), "no_id").when(F.col("record.objeto").isNull(), "no_subject")
    return out.withColumn("reason", reason).drop("_v", "_object")


def packed(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields that hold something, in their order."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "true"})


def appended(history: Column, entry: Column, kind: str) -> Column:
    """A JSON array with one more entry (a struct of the DDL ``kind``); null or unreadable history begins anew, entries that can't be read so are lost as nulls."""
    known = F.coalesce(F.from_json(history, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    return F.to_json(F.array_append(known, entry))
