"""A cleaning pipeline over ``documents``: toxic texts, near-duplicates, benchmark leaks, secrets, source mix.

Each stage reads what its predecessor wrote and all but the last return the columns of
documents; the last adds the words that the mix takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm import decontaminate, mixing, neardup, secrets, toxicity
from logfathom.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score ``toxicity.THRESHOLD`` or more; one at the threshold goes.

    Null and empty texts have the score of a text without terms and stay; repeated rows share a
    score; texts are scored whole; without labels or documents nothing goes; columns other than
    those of documents are dropped.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, out="_score").where(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, a null id last.

    Texts without words are copies of nothing and stay, but rows that are equal in id and text are
    one; very long texts are compared whole; an empty table stays empty.
    """
    return neardup.deduplicated(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain a benchmark item, by 80 % of its shingles or more; one at 80 % goes.

    Null and empty texts contain none; items without words are in none; repeated rows share their
    fate; without items nothing goes.
    """
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked, ``n_chars`` counted anew; a null text stays null, with a null count."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times; texts without words are never taken.

    A null source is one of its own; rows with equal id and text are taken together.
    """
    return mixing.mix(docs.select(*COLUMNS))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("secrets", redact_secrets), ("mixing", mix_sources)]
#: Toxicity scores and signatures have no SQL; tests compare near_duplicates with brute force, the other stages by ids and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
