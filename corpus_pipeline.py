"""The corpus pipeline: five stages from documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents. Deciding stages keep clean rows unchanged:

1. toxicity: documents scored at or above the threshold go;
2. near_duplicates: one document of each group of n-gram Jaccard links stays, the one of the smallest id;
3. decontamination: documents a twentieth of whose words lie in benchmark windows go;
4. personal_data: spans of personal data become their kind in brackets, and n_chars follows the text;
5. packing: what is left is cut into token sequences.

Null and empty texts pass stages 1 to 4 and are packed as their end id; extra columns pass stages 1 to 4.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftmark.llm import decontamination, jaccard, packing, pii, toxicity  # noqa: E402
from siftmark.llm.common import checkpointed, shielded, table  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return shielded(docs, lambda given: toxicity.score(given, labels).where(F.col("_score") < toxicity.THRESHOLD).drop("_score"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def counted(given: DataFrame) -> DataFrame:
        hidden = pii.redacted(given.withColumn("_before", F.col("text")))
        changed = ~F.col("text").eqNullSafe(F.col("_before"))
        return hidden.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("_before")

    return shielded(docs, counted, needed=("doc_id", "text", "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

# A trained classifier and a tokenizer cannot be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL_TWINS = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
