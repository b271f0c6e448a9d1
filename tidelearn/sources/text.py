"""Text forms of labelled rows, predictions, models, documents and topics.

Parsers take any DataFrame with a text column, bounded or streaming, keep its
other columns, and return the good rows and the rejected rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidelearn.functions.vectors import has_width
from tidelearn.operators.prefix import running_total

# Fixed text forms of the stream's rows and results.
LABELED = r"^\s*LabeledVector\(\s*([^,()]+?)\s*,\s*DenseVector\(([^()]*)\)\s*\)\s*$"
PREDICTION = r"^\s*Left\(\(LabeledVector\(\s*([^,()]+?)\s*,\s*DenseVector\(([^()]*)\)\s*\)\s*,\s*(\d+)\s*\)\)\s*$"
MODEL = r"^\s*Right\(\(WeightVector\(DenseVector\(([^()]*)\)\s*,\s*([^,()]+?)\s*\)\s*,\s*(\d+)\s*\)\)\s*$"
TOPICS = r"^\s*lambda<&%\$#,([^,]*),&%\$#lambda>,\s*(\d+)\s*,\s*(\d+)\s*$"


def numbers(text: Column, separator: str = ",") -> Column:
    """Separated text to ``array<double>``; an unreadable entry becomes null."""
    return F.transform(F.split(text, separator), lambda x: F.trim(x).try_cast("double"))


def _split_good(df: DataFrame, good: Column, text: str, keep: list[str], out: list[str]) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(good, F.lit(False))
    return df.filter(ok).select(*keep, *out), df.filter(~ok).select(*keep, text)


def parse_labeled_csv(lines: DataFrame, d: int, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """``label,f1,...,fd`` per line to ``label`` and ``features``."""
    keep = [c for c in lines.columns if c != text]
    fields = lines.withColumn("_f", numbers(F.col(text)))
    parsed = fields.withColumn("label", F.get("_f", 0)).withColumn("features", F.slice("_f", 2, d))
    good = (F.size("_f") == d + 1) & F.col("label").isNotNull() & has_width(F.col("features"), d)
    return _split_good(parsed, good, text, keep, ["label", "features"])


def parse_labeled_text(lines: DataFrame, d: int, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """``LabeledVector(y, DenseVector(...))`` per line to ``label`` and ``features``."""
    keep = [c for c in lines.columns if c != text]
    parsed = lines.withColumn("label", F.regexp_extract(text, LABELED, 1).try_cast("double")).withColumn(
        "features", numbers(F.regexp_extract(text, LABELED, 2))
    )
    good = F.col("label").isNotNull() & has_width(F.col("features"), d)
    return _split_good(parsed, good, text, keep, ["label", "features"])


def parse_prediction_text(lines: DataFrame, d: int, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that start with ``Left`` to ``prediction``, ``features`` and ``model_id``.

    Model lines (``Right``) are not predictions and are neither good nor rejected.
    """
    keep = [c for c in lines.columns if c != text]
    left = lines.filter(F.col(text).startswith("Left"))
    parsed = (
        left.withColumn("prediction", F.regexp_extract(text, PREDICTION, 1).try_cast("double"))
        .withColumn("features", numbers(F.regexp_extract(text, PREDICTION, 2)))
        .withColumn("model_id", F.regexp_extract(text, PREDICTION, 3).try_cast("int"))
    )
    good = F.col("prediction").isNotNull() & F.col("model_id").isNotNull() & has_width(F.col("features"), d)
    return _split_good(parsed, good, text, keep, ["prediction", "features", "model_id"])


def parse_model_text(lines: DataFrame, d: int, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that start with ``Right`` to ``weights``, ``intercept`` and ``n``."""
    keep = [c for c in lines.columns if c != text]
    right = lines.filter(F.col(text).startswith("Right"))
    parsed = (
        right.withColumn("weights", numbers(F.regexp_extract(text, MODEL, 1)))
        .withColumn("intercept", F.regexp_extract(text, MODEL, 2).try_cast("double"))
        .withColumn("n", F.regexp_extract(text, MODEL, 3).try_cast("long"))
    )
    good = F.col("intercept").isNotNull() & F.col("n").isNotNull() & has_width(F.col("weights"), d)
    return _split_good(parsed, good, text, keep, ["weights", "intercept", "n"])


def parse_topic_matrix(lines: DataFrame, text: str = "value") -> DataFrame:
    """A printed topic matrix to ``(topic, word_id, weight)`` rows; values run column by column."""
    keep = [c for c in lines.columns if c != text]
    parts = lines.select(
        *keep,
        numbers(F.regexp_extract(text, TOPICS, 1), " +").alias("_v"),
        F.regexp_extract(text, TOPICS, 2).try_cast("int").alias("_k"),
        F.regexp_extract(text, TOPICS, 3).try_cast("int").alias("_w"),
    ).filter(F.size("_v") == F.col("_k") * F.col("_w"))
    cells = parts.select(*keep, "_k", F.posexplode("_v").alias("_p", "weight"))
    return cells.select(
        *keep, F.expr("cast(_p % _k as int)").alias("topic"), F.expr("cast(_p div _k as int)").alias("word_id"), "weight"
    )


def labeled_csv(label: Column, features: Column) -> Column:
    """Row as ``label,f1,...,fd``."""
    return F.concat_ws(",", label.cast("string"), F.transform(features, lambda x: x.cast("string")))


def labeled_text(label: Column, features: Column) -> Column:
    inner = F.array_join(F.transform(features, lambda x: x.cast("string")), ", ")
    return F.format_string("LabeledVector(%s, DenseVector(%s))", label.cast("string"), inner)


def prediction_text(prediction: Column, features: Column, model_id: Column) -> Column:
    return F.format_string("Left((%s,%s))", labeled_text(prediction, features), model_id.cast("string"))


def model_text(weights: Column, intercept: Column, n: Column) -> Column:
    inner = F.array_join(F.transform(weights, lambda x: x.cast("string")), ", ")
    return F.format_string(
        "Right((WeightVector(DenseVector(%s),%s),%s))", inner, intercept.cast("string"), n.cast("string")
    )


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of text files, bounded or as a stream of files."""
    return spark.readStream.text(path) if stream else spark.read.text(path)


def read_labeled_csv(spark: SparkSession, path: str, d: int, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    return parse_labeled_csv(read_lines(spark, path, stream), d)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per line, numbered in file order."""
    return number_lines(_file_lines(spark, path), ["_file", "_start"], "_at", "doc_id").withColumnRenamed("value", "text")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One word per line; the id is the line number, and a later duplicate wins."""
    lines = number_lines(_file_lines(spark, path), ["_file", "_start"], "_at", "word_id")
    return vocabulary(lines.select(F.trim("value").alias("word"), "word_id"))


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, start of the input split, order inside it."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )


def number_lines(lines: DataFrame, block: list[str], at: str, name: str) -> DataFrame:
    """Consecutive numbers over ``(block, at)``, counted per block.

    Lines are numbered inside their block, which starts at the number of lines
    in the blocks before it.  One integer block column may have any number of
    values; several columns name file splits, whose list is short.
    """
    counts = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_first"))
    if len(block) == 1 and dict(counts.dtypes)[block[0]] in ("int", "bigint"):
        starts = running_total(counts, [], block[0], ["_first"], inclusive=False)
    else:
        before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.withColumn("_first", F.coalesce(F.sum("_first").over(before), F.lit(0)))
    inside = Window.partitionBy(*block).orderBy(at)
    numbered = lines.join(starts, block).withColumn(
        name, (F.col("_first") + F.row_number().over(inside) - 1).cast("long")
    )
    return numbered.drop(*[c for c in (*block, at, "_first") if c.startswith("_")])


def vocabulary(words: DataFrame) -> DataFrame:
    """``(word, word_id)`` rows with one id per word: the largest."""
    return words.groupBy("word").agg(F.max("word_id").alias("word_id"))
