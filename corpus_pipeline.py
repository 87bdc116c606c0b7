"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage calls one corpus operator on all rows that its predecessor kept, and its
decisions take effect: rejected documents, all but one document of each group of near
copies and contaminated documents go, entities are replaced, and the mix sets how often
a document stands in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import decontaminate, mixing, near_dedup, pii, quality
from quaver.llm.queries import PII_KEY, table
from quaver.llm.workspace import made, materialize, release


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal data", hide_pii),
    ("mixing", mix),
]

#: MinHash signatures and keyed draws have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. An empty table gives an empty one; very long texts pass whole.

    A stage's result stays until the next one is written; the tables that a stage has made on its way go at once.
    """
    docs, first = table(spark, sf_dir, "documents"), made(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since=first, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
