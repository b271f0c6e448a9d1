"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Within each source the keys are cut into
equal ranges of about ``RANGE_ROWS`` documents, so that no task holds a source:
ranges are summed, the short list of range sums is added up in order, and each
range is sorted on its own.  The prefix sum of word counts then meets the
source's budget: whole epochs take every document, the rest of the budget takes
documents in key order and cuts the last one at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidelearn.llm.registry import register, table
from tidelearn.session import materialize

#: Documents of a source that are sorted together, about.
RANGE_ROWS = 8192
#: Repeated over the sources in code point order.
WEIGHTS = (5, 2, 1)
#: Hex digits of a key, and the bits of it that pick a range.
KEY_DIGITS, RANGE_BITS = 15, 40


def word_count(text: str) -> Column:
    """Words of a text column, parted by white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hash_key(doc_id: str, seed: int) -> Column:
    """60 random bits that depend on the id and the seed only."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = 100, most_epochs: int = 3) -> DataFrame:
    """One row per source: n, source_size, weight, cap, target.

    ``share`` percent of all words are dealt out by weight.  No source gets more
    than ``most_epochs`` times its size; what is above goes to the others by
    weight.  In the order of cap per weight the full sources come first, so two
    running sums find them.  This works on the list of sources, not on rows of data.
    """
    wide = "decimal(38,0)"
    ranked = (
        sized.groupBy("source")
        .agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1).cast("bigint"))
        .withColumn("cap", F.col("source_size") * most_epochs)
    )
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("total") - F.col("cap_before")
    return (
        ranked.withColumn("total", F.expr(f"sum(source_size) over () * {share} div 100"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_onward", F.sum("weight").over(onward))
        .withColumn("full", left.cast(wide) * F.col("weight").cast("decimal(10,0)") > F.col("cap").cast(wide) * F.col("weight_onward").cast("decimal(10,0)"))
        .withColumn("full_caps", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
                (F.col("weight") * (F.col("total") - F.col("full_caps"))).cast("double") / F.col("open_weight").cast("double")
            ),
        )
        .select("source", "rank", "n", "source_size", "weight", "cap", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: int = 100,
    most_epochs: int = 3,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words the mix takes, repeats included: ``taken // size``
    whole epochs and, for the one document at the budget's end, its first words.
    The taken words of a source are its target, rounded down.

    Null or empty texts have size 0 and are never taken; a null source is a source,
    last in order; a null id is a key of its own; repeated rows are documents each;
    documents with equal keys come in the order of id and size.  An
    empty table gives no rows.  Other columns are not read, whatever their names.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), hash_key(doc_id, seed).alias("key"))
    sized = materialize(sized, "mix-sized")
    targets = materialize(source_targets(sized, weights, share, most_epochs), "mix-sources")
    targets = targets.withColumnRenamed("source", "its_source")
    ranges = (F.col("n") / RANGE_ROWS).cast("bigint") + 1
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("its_source"))).select(
        "doc_id", "source", "size", "key", "rank", "source_size", "target",
        F.shiftright(F.shiftright(F.col("key"), 4 * KEY_DIGITS - RANGE_BITS) * ranges, RANGE_BITS).alias("range"),
    )
    in_order = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("rank", "range")
        .agg(F.sum("size").alias("range_size"))
        .select("rank", "range", F.coalesce(F.sum("range_size").over(in_order), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - F.col("epochs") * F.col("source_size")
    return (
        rows.join(starts, ["rank", "range"])
        .withColumn("before", before)
        .withColumn("epochs", epochs)
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))).cast("bigint").alias("taken"),
        )
    )


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 15) AS BIGINT) AS key
  FROM {documents}),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((rank - 1) % 3 + 1 AS INTEGER)] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sources),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_onward FROM weighed),
marked AS (SELECT *, (total - cap_before) * weight > cap * weight_onward AS is_full FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) AS DOUBLE)
      / CAST(sum(weight) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target FROM marked),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, {columns}size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM counted{where}
"""


@register("op3_mix", SQL.format(documents="documents", columns="", where=""))
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all documents mixed by the weights 5, 2, 1, at most three epochs."""
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the documents: doc_id, source, size, source_size, target and taken, for those of which any word is taken."""
    return mix_sources(docs).where("taken > 0")
