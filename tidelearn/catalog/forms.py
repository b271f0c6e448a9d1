"""Queries on text forms and sinks: a table is printed, parsed back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelearn.catalog.fixtures import ORD, ord_rows, windowed
from tidelearn.catalog.registry import register, spread_table, table
from tidelearn.operators import text as tx
from tidelearn.operators.windows import count_windows
from tidelearn.session import new_path
from tidelearn.sources import sinks, text as src

PLAIN = f"WITH {ORD} SELECT seq, label, x1, x2 FROM ord"


def _flat(df, value="label"):
    x = F.col("features")
    return df.select("seq", F.col(value).alias("label"), x[0].alias("x1"), x[1].alias("x2"))


@register("parse_labeled_csv", PLAIN)
def parse_labeled_csv(spark, sf):
    lines = ord_rows(spark, sf).select("seq", src.labeled_csv(F.col("label"), F.col("features")).alias("value"))
    return _flat(src.parse_labeled_csv(lines, 2)[0])


@register("parse_labeled_text", PLAIN)
def parse_labeled_text(spark, sf):
    lines = ord_rows(spark, sf).select("seq", src.labeled_text(F.col("label"), F.col("features")).alias("value"))
    return _flat(src.parse_labeled_text(lines, 2)[0])


@register("parse_prediction_text", PLAIN)
def parse_prediction_text(spark, sf):
    lines = ord_rows(spark, sf).select(
        "seq", src.prediction_text(F.col("label"), F.col("features"), F.lit(0)).alias("value")
    )
    return _flat(src.parse_prediction_text(lines, 2)[0], "prediction")


@register("csv_rejects", f"""
WITH {ORD} SELECT seq, CASE WHEN label = -9 THEN 'waiting,' || CAST(seq AS VARCHAR) ELSE CAST(seq AS VARCHAR) END AS value
FROM ord""")
def csv_rejects(spark, sf):
    """Every line lacks fields or holds text where a number belongs, so all are rejected."""
    seq = F.col("seq").cast("string")
    lines = ord_rows(spark, sf).select(
        "seq", F.when(F.col("label") == -9.0, F.concat(F.lit("waiting,"), seq)).otherwise(seq).alias("value")
    )
    return src.parse_labeled_csv(lines, 2)[1]


LANGS = ["de", "en", "es", "fr"]


@register("parse_topic_matrix", """
WITH bw AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM benchmark),
ids AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY encode(word)) - 1 AS word_id FROM bw),
tok AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
freq AS (SELECT lang, word, count(*) AS n FROM tok GROUP BY 1, 2)
SELECT item_id, CAST(k AS INTEGER) AS topic, CAST(word_id AS INTEGER) AS word_id, CAST(coalesce(n, 0) AS DOUBLE) AS weight
FROM ids CROSS JOIN generate_series(0, 3) t(k)
LEFT JOIN freq ON freq.word = ids.word AND freq.lang = (['de', 'en', 'es', 'fr'])[k + 1]""")
def parse_topic_matrix(spark, sf):
    """One topic-by-word matrix per passage, printed column by column and parsed back."""
    docs = spread_table(spark, sf, "documents", "lang", "text")
    freq = tx.explode_words(docs, tx.word_tokens(F.col("text")), ["lang"]).groupBy("word").agg(
        *[F.count_if(F.col("lang") == k).cast("double").alias(f"n_{k}") for k in LANGS]
    )
    words = table(spark, sf, "benchmark").select(
        "item_id", F.explode(F.array_distinct(tx.word_tokens(F.col("text")))).alias("word")
    )
    cells = words.join(freq, "word", "left").select(
        "item_id",
        F.struct("word", F.array(*[F.coalesce(f"n_{k}", F.lit(0.0)) for k in LANGS]).alias("column")).alias("cell"),
    )
    # A passage has no more columns than distinct words of its own text.
    matrix = cells.groupBy("item_id").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    printed = F.array_join(
        F.transform(F.flatten(F.transform("cells", lambda c: c["column"])), lambda v: v.cast("string")), " "
    )
    size = F.size("cells").cast("string")
    lines = matrix.select(
        "item_id", F.concat(F.lit("lambda<&%$#,"), printed, F.lit(f",&%$#lambda>,{len(LANGS)},"), size).alias("value")
    )
    return src.parse_topic_matrix(lines)


@register("sink_roundtrip", f"""
WITH {ORD}, {windowed('1000')}
SELECT window_id, CAST(count(*) AS BIGINT) AS n, round(sum(x1), 4) AS s1, round(sum(x2), 4) AS s2 FROM win GROUP BY 1""")
def sink_roundtrip(spark, sf):
    """Window sums written twice under one batch key and read back once."""
    x = F.col("features")
    sums = count_windows(ord_rows(spark, sf), 1000).groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(x[0]), 4).alias("s1"), F.round(F.sum(x[1]), 4).alias("s2")
    )
    path = new_path(spark, "sink")
    for _ in range(2):
        sinks.write_batch(sums, path, 0)
    return sinks.read_batches(spark, path).select("window_id", "n", "s1", "s2")
