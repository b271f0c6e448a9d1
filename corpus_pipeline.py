"""Training corpus in five stages: what is good, clean, seen once and in no benchmark, mixed by source.

Each stage is written and read again, so a lost executor costs at most its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelearn.llm import decontaminate, mixing, near_join, quality, rules
from tidelearn.session import materialize

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality classifier", quality.stage),
    ("quality rules", rules.stage),
    ("n-gram Jaccard join", near_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
]
#: The classifier, compression and latent retrieval have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
