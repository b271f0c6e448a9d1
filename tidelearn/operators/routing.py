"""Routing, masking, partitioning and sampling of row streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelearn.functions.vectors import densify, has_width
from tidelearn.operators.prefix import running_total
from tidelearn.operators.windows import RANGE, number_rows
from tidelearn.session import materialize


def with_model(df: DataFrame, model: Column | int = 0) -> DataFrame:
    """Tag every row with the problem it belongs to."""
    return df.withColumn("model_id", F.lit(model) if isinstance(model, int) else model)


def unlabel(df: DataFrame, sentinel: float, label: str = "label") -> DataFrame:
    """Turn the sentinel that marks unlabelled rows into a null label."""
    return df.withColumn(label, F.nullif(F.col(label), F.lit(float(sentinel))))


def split_labelled(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows that train the model, and rows that wait for a prediction."""
    return df.filter(F.col(label).isNotNull()), df.filter(F.col(label).isNull())


def of_width(df: DataFrame, d: int, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has width ``d`` and the rejected rest."""
    good = F.coalesce(has_width(F.col(features), d), F.lit(False))
    return df.filter(good), df.filter(~good)


def sound(df: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """Rows that a learner of width ``d`` may use, and the rejected rest.

    A vector must have width ``d`` without nulls or NaN, a label must not be NaN, and the order key must be there.
    """
    good = has_width(F.col("features"), d) & F.coalesce(~F.isnan("label"), F.lit(True))
    if "seq" in df.columns:
        good = good & F.col("seq").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return df.filter(good), df.filter(~good)


def shard_of(n: int, key: str = "seq", by: Column | None = None) -> Column:
    """Repeatable shard number: a hash of the order key, or a user's integer column."""
    return F.pmod(by if by is not None else F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def shard(df: DataFrame, n: int, key: str = "seq", by: Column | None = None) -> DataFrame:
    """Partition rows by shard so that each shard sits in one task."""
    return df.withColumn("shard", shard_of(n, key, by)).repartition(n, "shard")


def scatter_slices(df: DataFrame, d: int, keys: list[str], slice_: str = "slice", data: str = "data") -> DataFrame:
    """Sliced events to dense vectors: sums of ``data`` at the positions in ``slice``."""
    parts = df.select(*keys, F.explode(F.arrays_zip(F.col(slice_).alias("i"), F.col(data).alias("v"))).alias("e"))
    cells = parts.groupBy(*keys, F.col("e.i").alias("i")).agg(F.sum("e.v").alias("v"))
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct("i", "v")).alias("cells"))
    return packed.select(*keys, densify(d, F.col("cells.i"), F.col("cells.v")).alias("features"))


def mask_tail(df: DataFrame, share: float, sentinel: float, order: str = "seq", label: str = "label") -> DataFrame:
    """Hide the labels of the last ``share`` of the rows and keep them in ``truth``.

    The cut needs only the row count and each row's position, so no task sorts
    the whole table.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    hidden = F.col("_position") >= F.floor(total * F.lit(1.0 - share))
    return (
        number_rows(df, order, name="_position")
        .withColumn("truth", F.col(label))
        .withColumn(label, F.when(hidden, F.lit(float(sentinel))).otherwise(F.col(label)))
        .drop("_position")
    )


def draw(seed: int, counter: Column, digits: int = 13) -> Column:
    """A whole number of ``digits`` hexadecimal digits from a seed and a counter: the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), counter.cast("string"))), 1, digits), 16, 10).cast("long")


def hash_split(df: DataFrame, test_share: float, seed: int = 0, key: str = "seq") -> DataFrame:
    """Mark every row ``train`` or ``test`` by a seeded draw on its key; rows without a key train."""
    slot = draw(seed, F.col(key), 8) % 10000
    return df.withColumn("part", F.when(slot < F.lit(round(test_share * 10000)), "test").otherwise("train"))


def sample_with_replacement(df: DataFrame, n: int, seed: int, order: str = "doc_id") -> DataFrame:
    """Exactly ``n`` draws with replacement; a row drawn twice appears twice.

    Draw k is the row at position ``floor(total * u)`` along ``order``, u from the seed and k alone.  First the draws are
    counted per range of the order key, then only ranges that were drawn are numbered, each on its own:
    the table is counted once and its other rows do not move.
    """
    spark = df.sparkSession
    cut = F.expr(f"cast(`{order}` as bigint) div {RANGE}L")
    ranged = df.withColumn("_range", cut)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = materialize(running_total(sizes.withColumn("_before", F.col("_n")), [], "_range", ["_before"], inclusive=False), "sample-ranges")
    total = starts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if not total:
        return df.withColumn("draw", F.lit(0).cast("long"))
    unit = draw(seed, F.col("id")) / F.lit(float(1 << 52))
    picks = spark.range(n).select(F.col("id").alias("draw"), F.floor(unit * total).alias("_at"))
    # A draw's range: ranges are runs of positions, so blocks of positions name the few that a draw can fall into.
    block = max(1, total // 4096)
    spans = starts.select("_range", "_before", "_n", F.explode(F.expr(f"sequence(_before div {block}, (_before + _n - 1) div {block})")).alias("_block"))
    placed = picks.withColumn("_block", F.expr(f"_at div {block}")).join(spans, "_block").where("_at >= _before and _at < _before + _n")
    placed = materialize(placed.select("draw", "_range", (F.col("_at") - F.col("_before")).cast("long").alias("_place")), "sample-draws")
    drawn = ranged.join(placed.select("_range").distinct(), "_range", "left_semi")
    inside = Window.partitionBy("_range").orderBy(order)
    numbered = drawn.withColumn("_place", (F.row_number().over(inside) - 1).cast("long"))
    return numbered.join(placed, ["_range", "_place"]).select(*df.columns, "draw")
