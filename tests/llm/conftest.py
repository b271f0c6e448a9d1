import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names operators use themselves."""

    def build(rows, parts=3, clash=True):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        if clash:
            for name in ("id", "n", "a", "b", "key", "size", "rank", "token", "group", "score", "rules", "component", "target", "path", "marked", "licenses", "n_tokens"):
                docs = docs.withColumn(name, F.lit("x"))
        return docs

    return build


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
