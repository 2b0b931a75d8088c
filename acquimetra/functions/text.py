"""Text as Column expressions: digits, accents, names, tokens, set similarity, identifiers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters in lower case and what they become, as their canonical decomposition has it; bare accents go.
_BASES = {c: unicodedata.normalize("NFKD", c)[0] for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and len(c.upper()) == 1}
ACCENTED_LETTERS = "".join(c for c, base in _BASES.items() if base.isascii() and base.isalpha())
PLAIN = "".join(_BASES[c] for c in ACCENTED_LETTERS)
ACCENTED = ACCENTED_LETTERS + "".join(map(chr, range(0x300, 0x370)))
# Words that carry no meaning in object descriptions.
STOPWORDS = ("a", "o", "de", "da", "do", "das", "dos", "e", "em", "no", "na", "para", "por", "com", "the", "of", "and", "to", "in", "is")
# Abbreviations in agency names and what they stand for.
ABBREVIATIONS = {
    "SEC": "SECRETARIA", "MUN": "MUNICIPIO", "FUNDO MUN": "FUNDO MUNICIPAL", "CAMARA": "CAMARA", "CM": "CAMARA MUNICIPAL", "FMS": "FUNDO MUNICIPAL DE SAUDE", "FME": "FUNDO MUNICIPAL DE EDUCACAO", "PM": "PREFEITURA MUNICIPAL",
    "GOV": "GOVERNO", "DEP": "DEPARTAMENTO", "DEPT": "DEPARTAMENTO", "ADM": "ADMINISTRACAO", "REG": "REGIONAL", "HOSP": "HOSPITAL", "UNIV": "UNIVERSIDADE", "INST": "INSTITUTO", "FUND": "FUNDACAO", "AUT": "AUTARQUIA", "CONS": "CONSORCIO",
}


#: Endings that a stem does without: a stem keeps three letters or more and loses the longest ending.
ENDINGS = "amentos|amento|imentos|imento|acoes|acao|icoes|icao|idades|idade|mente|oes|aes|aos|ais|eis|ns|as|os|es|ao|a|e|o|s|m"
_STEM = f"^(.{{3,}}?)(?:{ENDINGS})$"


# Acronyms of public bodies and what they stand for.
ACRONYMS = {
    "PMF": "PREFEITURA MUNICIPAL DE", "FMS": "FUNDO MUNICIPAL DE SAUDE", "FUS": "FUNDO DE URBANIZACAO", "FMAS": "FUNDO MUNICIPAL DE ASSISTENCIA SOCIAL", "FME": "FUNDO MUNICIPAL DE EDUCACAO",
    "CMDCA": "CONSELHO MUNICIPAL DOS DIREITOS DA CRIANCA E DO ADOLESCENTE", "IPUF": "INSTITUTO DE PLANEJAMENTO URBANO DE", "CASAN": "COMPANHIA CATARINENSE DE AGUAS E SANEAMENTO",
    "CELESC": "CENTRAIS ELETRICAS DE SANTA CATARINA", "DEINFRA": "DEPARTAMENTO DE INFRAESTRUTURA DE SANTA CATARINA",
}


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def root8(c: Column) -> Column:
    """First eight digits of a tax id, which name the legal entity; null if there are fewer."""
    d = digits_only(c)
    return F.when(F.length(d) >= 8, F.left(d, F.lit(8)))


def extract_tax_id(c: Column) -> Column:
    """A formatted tax id, or else a run of 14 digits, as digits; null without one."""
    formatted = F.regexp_extract(c, r"([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2})", 1)
    bare = F.regexp_extract(c, r"(?:^|[^0-9])([0-9]{14})(?:[^0-9]|$)", 1)
    return F.coalesce(F.nullif(digits_only(formatted), F.lit("")), F.nullif(bare, F.lit("")))


def fold(c: Column) -> Column:
    """Lower case without accents; a sharp s becomes ss."""
    return F.replace(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def folded(x: str) -> str:
    """The same for a Python string, such as a query's."""
    return x.lower().translate({ord(a): (PLAIN[i] if i < len(PLAIN) else None) for i, a in enumerate(ACCENTED)}).replace("ß", "ss")


def stem(c: Column) -> Column:
    """A folded word without its ending."""
    return F.regexp_replace(c, _STEM, "$1")


def stemmed(w: str) -> str:
    return re.sub(_STEM, r"\1", w)


def fold_in_place(c: Column) -> Column:
    """Like ``fold``, but every character keeps its place."""
    return F.translate(F.lower(c), ACCENTED_LETTERS, PLAIN)


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, those at the ends go; ordinal marks become letters; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "ºª\u00a0", "oa "), r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """Upper case ASCII, punctuation to spaces, without numbers of 8 to 14 digits, abbreviations and then acronyms spelled out; null is empty."""
    x = F.regexp_replace(F.upper(fold(F.coalesce(c, F.lit("")))), r"[^\x00-\x7F]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[^A-Z0-9_\s]", " "), r"\b[0-9]{8,14}\b", "")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    for words in (ABBREVIATIONS, ACRONYMS):
        for short, full in sorted(words.items(), key=lambda kv: -len(kv[0])):  # those of two words first
            x = F.regexp_replace(x, rf"\b{short}\b", full)
    return x


def aliases(c: Column) -> Column:
    """Other names under which an agency may sign, from its normalized name; without repeats, in the order of the rules."""
    after = lambda start: F.when(c.startswith(start), F.substr(c, F.lit(len(start) + 1)))
    before = lambda end: F.when(c.endswith(end), F.left(c, F.length(c) - len(end)))
    put = lambda town, start="", end="": F.when(town.isNotNull(), F.trim(F.concat(F.lit(start), town, F.lit(end))))
    made = F.array(
        put(after("PREFEITURA MUNICIPAL DE "), "MUNICIPIO DE "),
        put(after("PREFEITURA DE "), "MUNICIPIO DE "),
        put(after("CAMARA DE VEREADORES DE "), end=" CAMARA DE VEREADORES"),
        put(before(" CAMARA DE VEREADORES"), "CAMARA DE VEREADORES DE "),
        put(after("CAMARA MUNICIPAL DE "), end=" CAMARA MUNICIPAL"),
        put(after("CAMARA MUNICIPAL DE VEREADORES DE "), end=" CAMARA MUNICIPAL DE VEREADORES"),
    )
    return F.array_distinct(F.array_compact(made))


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct folded words of at least ``least`` letters that aren't stop words."""
    words = F.split(F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS)))


def trigrams(c: Column) -> Column:
    """Distinct three-letter runs of the folded text with a blank on either side."""
    x = F.concat(F.lit("  "), F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def canonical_number(c: Column) -> Column:
    """``001/2026``, ``1-2026`` and ``1.2026`` all become ``1/2026``; null if there is no such number."""
    n, year = F.regexp_extract(c, "([0-9]{1,6})[/.-]([0-9]{4})", 1), F.regexp_extract(c, "([0-9]{1,6})[/.-]([0-9]{4})", 2)
    return F.when(n != "", F.concat(F.coalesce(F.nullif(F.regexp_replace(n, "^0+", ""), F.lit("")), F.lit("0")), F.lit("/"), year))


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-|-$", "")
