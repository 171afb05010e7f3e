"""The corpus pipeline: from raw documents to packed training sequences, each stage an operator of shadowset.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of ``documents``. Rejected, duplicate and contaminated documents go, secrets are masked in place.

Defined results: every row is judged by itself, also where ids repeat or are null. A null or empty text has a score like any
other, is no duplicate of anything and never contaminated, has no secrets, and becomes the end mark alone; of equal or near
texts one row stays, the one with the least id (null ids come last); benchmark items without an id or text do no harm. Columns
beyond those of ``documents`` are kept by all stages but the last, whatever their names. Without labels all scores are 0.5 and
all rows pass; without a benchmark nothing is contaminated; an empty table gives no rows. Long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shadowset.llm import decontam, minhash, packing, quality, secrets
from shadowset.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, words=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"), null_ids=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Trees, shingles and subword ids are not expressible in SQL; tests/llm/test_pipeline.py holds a plain version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
