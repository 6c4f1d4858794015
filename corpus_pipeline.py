"""Corpus cleaning in five stages; each reads what the stage before it kept.

``STAGES`` are (name, function(spark, docs, sf_dir)); all but the last return the columns of ``documents``, and any others that the
rows have.  Rows with null or empty text pass through the quality model like others, form no near-duplicate group, hold no benchmark
passage and no personal data, and encode to no pieces (null ids for null text).  Rows without an id stay in every stage; of rows that
share an id and a near-duplicate group one stays.  Very long texts go whole through every stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankfile.llm import decontaminate, jaccard, pieces, pii, quality
from rankfile.llm.common import checkpoint, held_out, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents scored under 0.3 go."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return quality.keep(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the smallest id of each near-duplicate group stays."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data are replaced by their kind."""
    return pii.redacted(docs, pii.fit(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sampled piece ids of every text."""
    return pieces.op3_pieces(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
