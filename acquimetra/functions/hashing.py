"""Content keys that let equal records from different sources meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold


def content_md5(*cols: Column) -> Column:
    """MD5 over fields joined by ``|``; null counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def content_sha256(*cols: Column) -> Column:
    """SHA-256 over trimmed lower-case fields joined by ``|``."""
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))) for c in cols]), 256)


def _plain(c: Column) -> Column:
    """Folded ASCII with single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", ""), r"\s+", " "))


def cross_source(modality: Column, subject: Column, agency: Column, published: Column, value: Column) -> Column:
    """The same tender has the same key in every portal: folded modality, folded subject without punctuation, agency root, date, value with two digits. What is null leaves its place empty."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(_plain(subject), r"[^a-z0-9_\s]", " "), r"\s+", " "))
    parts = (_plain(modality), bare, agency.cast("string"), published.cast("string"), value.cast("decimal(18,2)").cast("string"))
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


# What a portal puts before its subjects.
PORTAL_PREFIXES = ("[portal de compras públicas] - ", "[portal de compras publicas] - ")


def portal_hash(state: Column, town: Column, value: Column, subject: Column, prefixes: tuple[str, ...] = PORTAL_PREFIXES) -> Column:
    """SHA-256 of state, town, value and the first 150 characters of the subject without a portal's own prefix: town and subject in lower case, the subject with single blanks; null counts as empty, a null value as 0."""
    x = F.btrim(F.lower(F.coalesce(subject, F.lit(""))), F.lit(" \t\n\r\f\u000b"))
    for p in prefixes:
        x = F.when(F.startswith(x, F.lit(p)), F.substr(x, F.lit(len(p) + 1))).otherwise(x)
    bare = F.left(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(150))
    v = value.cast("double")
    shown = F.when(F.coalesce(v, F.lit(0.0)) == 0, "0").otherwise(F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"(\.[0-9]+?)0+$", "$1"))
    parts = (F.coalesce(state.cast("string"), F.lit("")), F.trim(F.lower(F.coalesce(town.cast("string"), F.lit("")))), shown, bare)
    return F.sha2(F.concat_ws("|", *parts), 256)
