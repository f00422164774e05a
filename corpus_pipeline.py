"""A corpus pipeline: each stage reads what its predecessor wrote.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that stay. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidalgrid.llm import decontaminate, jaccard, lines, pieces, toxicity
from tidalgrid.llm.common import release, scratch

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", lines.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("SentencePiece encoding and decoding", pieces.stage),
]

#: The stages train a model and encode by a vocabulary, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return docs
