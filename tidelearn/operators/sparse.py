"""Moments and ridge models of sparse vectors, without a matrix of the full width anywhere.

Only pairs of features that are set together make a cell; cells add up before they are shuffled.  The ridge system is solved by
preconditioned conjugate gradients on the table of cells: a product with the matrix is one join and one sum, so
the number of features is bounded by storage and not by a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelearn.session import materialize


def entries(indices: Column, values: Column) -> Column:
    """Distinct set features of a row as structs (i, v); values of a repeated index add up, nulls and zeros are not set."""
    both = F.filter(F.arrays_zip(indices.alias("i"), values.alias("v")), lambda e: e["i"].isNotNull() & (F.coalesce(e["v"], F.lit(0.0)) != 0))
    names = F.array_sort(F.array_distinct(F.transform(both, lambda e: e["i"].cast("long"))))

    def total(i: Column) -> Column:
        own = F.filter(both, lambda e: e["i"].cast("long") == i)
        return F.struct(i.alias("i"), F.aggregate(own, F.lit(0.0), lambda s, e: s + e["v"]).alias("v"))

    return F.transform(names, total)


def sparse_moments(df: DataFrame, d: int, keys: list[str], indices: str = "indices", values: str = "values", label: str = "label") -> DataFrame:
    """Moments in long form ``(keys, i, j, g)`` with ``i <= j``: cells of features that occur together.

    As in the dense form, column ``j = d`` holds ``sum y x`` and the cell ``(d, d)`` the count of labelled rows.  Rows
    without a label add nothing.  A row of m set features makes m (m + 1) / 2 cells, however large ``d`` is.
    """
    y = F.nullif(F.col(label).cast("double"), F.lit(float("nan")))
    rows = df.select(*keys, y.alias("_y"), F.coalesce(entries(F.col(indices), F.col(values)), F.array().cast("array<struct<i:bigint,v:double>>")).alias("_e")).where("_y is not null")
    pairs = F.expr("flatten(transform(_e, (a, k) -> transform(slice(_e, k + 1, size(_e) - k), b -> struct(a.i as i, b.i as j, a.v * b.v as g))))")
    along = F.expr(f"transform(_e, a -> struct(a.i as i, {d}L as j, a.v * _y as g))")
    count = F.expr(f"array(struct({d}L as i, {d}L as j, 1D as g))")
    cells = rows.select(*keys, F.explode(F.concat(pairs, along, count)).alias("c")).select(*keys, "c.*")
    return cells.groupBy(*keys, "i", "j").agg(F.sum("g").alias("g"))


def sparse_ridge(cells: DataFrame, d: int, keys: list[str], penalty: float = 1.0, tolerance: float = 1e-8, most: int = 200) -> DataFrame:
    """Weights ``(keys, i, w)`` of ``(penalty I + sum x x') w = sum y x`` for the features that occur; the others weigh nothing.

    ``keys`` name the models, at least one column, without nulls.  Stops when every key's residual is below ``tolerance`` of its right side, or after ``most`` steps.  Each step is written,
    which cuts lineage; only the largest residual reaches the driver.
    """
    cells = materialize(cells, "sparse-cells")
    inner = cells.where((F.col("i") < d) & (F.col("j") < d))
    turned = inner.where("i < j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "g")
    matrix = materialize(inner.select(*keys, "i", "j", "g").union(turned), "sparse-matrix")
    scale = inner.where("i = j").select(*keys, "i", (F.col("g") + penalty).alias("m"))
    right = cells.where((F.col("i") < d) & (F.col("j") == d)).select(*keys, "i", F.col("g").alias("r"))
    start = scale.join(right, [*keys, "i"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    v = materialize(start.select(*keys, "i", "m", F.lit(0.0).alias("w"), "r", (F.col("r") / F.col("m")).alias("p")), "sparse-step")

    def sums(table: DataFrame, **of: Column) -> DataFrame:
        """Sums per key, joined back to the key's rows."""
        names = [F.sum(c).alias(n) for n, c in of.items()]
        return table.join(table.groupBy(*keys).agg(*names), keys)

    norm = F.col("r") * F.col("r") / F.col("m")
    begun = materialize(v.groupBy(*keys).agg(F.sum(norm).alias("_b")), "sparse-norms")
    for _ in range(most):
        along = matrix.join(v.select(*keys, F.col("i").alias("j"), "p"), [*keys, "j"]).groupBy(*keys, "i").agg(F.sum(F.col("g") * F.col("p")).alias("q"))
        moved = v.join(along, [*keys, "i"]).withColumn("q", F.col("q") + penalty * F.col("p"))
        moved = sums(materialize(moved, "sparse-product"), _rz=norm, _pq=F.col("p") * F.col("q"))
        rate = F.coalesce(F.col("_rz") / F.nullif(F.col("_pq"), F.lit(0.0)), F.lit(0.0))
        moved = moved.select(*keys, "i", "m", (F.col("w") + rate * F.col("p")).alias("w"), (F.col("r") - rate * F.col("q")).alias("r"), "p", F.col("_rz").alias("_old"))
        turned = sums(moved, _new=norm)
        keep = F.coalesce(F.col("_new") / F.nullif(F.col("_old"), F.lit(0.0)), F.lit(0.0))
        v = materialize(turned.select(*keys, "i", "m", "w", "r", (F.col("r") / F.col("m") + keep * F.col("p")).alias("p")), "sparse-step")
        left = v.groupBy(*keys).agg(F.sum(norm).alias("_r")).join(begun, keys)
        worst = left.agg(F.max(F.col("_r") / F.nullif(F.col("_b"), F.lit(0.0)))).first()[0]
        if worst is None or worst <= tolerance * tolerance:
            break
    return v.select(*keys, "i", "w")
