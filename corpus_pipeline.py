"""From documents to token counts in five stages; each is written and reread as the next one's input.

Language ID drops documents without a recognizable language; of near-duplicate groups one document stays; personal data
is replaced by its kind; mixing draws documents at the fitted rates; the last stage gives each drawn document's pieces.

Defined results: a null text, or one without a letter, has no language and goes; where no document is labelled with a language there is no model and all stay; rows with a null
doc_id are never near-duplicates; equal rows count once after the second stage; without labels of quality all rates are 1; an empty table
gives an empty result; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.llm import langid, mixing, pieces, pii, simhash
from acquimetra.llm.shared import cut, drop, fresh, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
LEAST_SCORE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text has a predicted language with a score of at least ``LEAST_SCORE``."""
    langs, model = langid.fit(docs.where(~langid.held_out()))
    return langid.keep(docs, langs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (shingles of five words)."""
    return simhash.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    (spans,) = fresh(docs, "pii_spans")
    out = pii.redacted(pii.with_spans(docs, to=spans), spans_col=spans).drop(spans)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that the expected tokens of each domain meet the targets."""
    return mixing.resampled(docs, mixing.domain_labels(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts and digests of every drawn document."""
    return pieces.encoded(docs, pieces.load(), keep_ids=False).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix),
    ("pieces", encode),
]
#: SQL can't express trained models; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = cut(stage(spark, docs, sf_dir), name)
        drop(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
