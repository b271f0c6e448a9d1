"""Queries on the linear learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelearn.catalog.fixtures import LINES, ORD, SENTINEL, labelled_windows, line_rows, ord_rows, windowed
from tidelearn.catalog.registry import register, table
from tidelearn.catalog.rows import rounded
from tidelearn.functions.vectors import clamp_at_zero
from tidelearn.operators import metrics
from tidelearn.operators.hinge import sign_of, decision, svm_step
from tidelearn.operators.routing import unlabel, with_model
from tidelearn.operators.sparse import sparse_moments, sparse_ridge
from tidelearn.operators.windows import count_windows
from tidelearn.params import LassoParams, RidgeParams, SgdParams, SvmParams
from tidelearn.plans.learner import Chain, Standardize
from tidelearn.plans.moment_learners import Ridge, ShrinkageLasso
from tidelearn.plans.sgd import SgdRegression
from tidelearn.plans.svm import OnlineSvm
from tidelearn.session import materialize

RIDGE = Ridge(RidgeParams(dimension=2, window=1000, penalty=1.0, warmup=50, sentinel=SENTINEL))
LASSO = ShrinkageLasso(LassoParams(dimension=2, window=1000, penalty=20.0, warmup=2000, sentinel=SENTINEL))

# Labelled rows per window of the sequential learner: one distributed job each.
SVM_WINDOW = 5000


def flat(df, *keep, digits=6, names=("w1", "w2")):
    return df.select(*keep, *[F.round(F.col("weights")[i], digits).alias(n) for i, n in enumerate(names)])


# Running moments of two features, one row per version.
MOM2 = f"""
{ORD}, {labelled_windows(1000)},
per AS (
  SELECT window_id AS version, count(y) AS m, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22,
         sum(y * x1) AS r1, sum(y * x2) AS r2
  FROM win WHERE y IS NOT NULL GROUP BY 1),
mom AS (
  SELECT version, CAST(sum(m) OVER o AS BIGINT) AS n, sum(a11) OVER o AS a11, sum(a12) OVER o AS a12,
         sum(a22) OVER o AS a22, sum(r1) OVER o AS r1, sum(r2) OVER o AS r2
  FROM per WINDOW o AS (ORDER BY version))"""


def solve2(source: str, keep: str, penalty: str = "1e0") -> str:
    det = f"((a11 + {penalty}) * (a22 + {penalty}) - a12 * a12)"
    return (f"SELECT {keep}, (r1 * (a22 + {penalty}) - a12 * r2) / {det} AS w1, "
            f"((a11 + {penalty}) * r2 - a12 * r1) / {det} AS w2 FROM {source}")


RIDGE_FIT = f"WITH {MOM2}, fit AS ({solve2('mom', 'version, n')})"


def _ridge_versions(spark, sf):
    return RIDGE.fit(ord_rows(spark, sf))


@register("ridge_fit", f"{RIDGE_FIT} SELECT version, n, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM fit")
def ridge_fit(spark, sf):
    return flat(_ridge_versions(spark, sf), "version", "n")


@register("ridge_override", f"""{RIDGE_FIT.replace("// 1000 AS BIGINT", "// 2500 AS BIGINT").replace("1e0)", "4e0)")}
SELECT version, n, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM fit""")
def ridge_override(spark, sf):
    """Parameters given with the call hold for the call."""
    return flat(RIDGE.fit(ord_rows(spark, sf), window=2500, penalty=4.0), "version", "n")


AS_OF = """
first AS (SELECT min(version) AS v0 FROM fit WHERE n > {warm}),
wait AS (SELECT seq, window_id, x1, x2, CASE WHEN v0 IS NOT NULL THEN greatest(window_id - 1, v0) END AS version
         FROM win, first WHERE y IS NULL)"""


@register("ridge_predict", f"""{RIDGE_FIT}, {AS_OF.format(warm=50)}
SELECT seq, version, round(w1 * x1 + w2 * x2, 5) AS prediction FROM wait LEFT JOIN fit USING (version)""")
def ridge_predict(spark, sf):
    versions = materialize(_ridge_versions(spark, sf), "ridge-models")
    scored = RIDGE.predict(ord_rows(spark, sf), versions)
    return scored.select("seq", "version", F.round("prediction", 5).alias("prediction"))


@register("warmup_asof", f"""{RIDGE_FIT}, {AS_OF.format(warm=2000)}
SELECT seq, window_id, version, n FROM wait LEFT JOIN fit USING (version)""")
def warmup_asof(spark, sf):
    me = RIDGE.with_params(warmup=2000)
    versions = materialize(me.fit(ord_rows(spark, sf)), "ridge-models")
    scored = me.predict(ord_rows(spark, sf), versions)
    return scored.select("model_id", "seq", "window_id", "version").join(
        versions.select("model_id", "version", "n"), ["model_id", "version"], "left"
    ).select("seq", "window_id", "version", "n")


@register("per_group_ridge", f"""
WITH {LINES},
mom AS (SELECT model_id, count(*) AS n, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22,
               sum(x1 * y) AS r1, sum(x2 * y) AS r2 FROM li GROUP BY 1),
fit AS ({solve2('mom', 'model_id, CAST(n AS BIGINT) AS n')})
SELECT model_id, n, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM fit""")
def per_group_ridge(spark, sf):
    return flat(RIDGE.fit_groups(line_rows(spark, sf), ["model_id"]), "model_id", "n")


TRUE = [0.4, 0.3]


@register("coef_error", f"{RIDGE_FIT} SELECT version, round((abs(w1 - 0.4e0) + abs(w2 - 0.3e0)) / 2, 6) AS err FROM fit")
def coef_error(spark, sf):
    return rounded(metrics.coef_error(_ridge_versions(spark, sf), TRUE, ["version"]), 6, "err")


# Half is taken off each weight, so that the clamp has something to cut.
@register("clamp_weights", f"""{RIDGE_FIT}
SELECT version, round(greatest(w1 - 0.45e0, 0), 6) AS w1, round(greatest(w2 - 0.45e0, 0), 6) AS w2 FROM fit""")
def clamp_weights(spark, sf):
    moved = _ridge_versions(spark, sf).withColumn("weights", F.transform("weights", lambda w: w - 0.45))
    return flat(moved.withColumn("weights", clamp_at_zero(F.col("weights"))), "version")


STANDARD = f"""
WITH {ORD}, st AS (
  SELECT avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM ord)"""
STANDARD_FIT = (RIDGE_FIT.replace("WITH", "WITH", 1)
                .replace("SELECT *, CAST((count(y)", "SELECT seq, (x1 - m1) / s1 AS x1, (x2 - m2) / s2 AS x2, label, y, CAST((count(y)")
                .replace("AS window_id FROM ord)", "AS window_id FROM ord, (SELECT avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM ord))"))


@register("chained_ridge", f"{STANDARD_FIT} SELECT version, n, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM fit")
def chained_ridge(spark, sf):
    chain = Standardize(2).chain(RIDGE)
    assert isinstance(chain, Chain)
    return flat(chain.fit(ord_rows(spark, sf))[-1], "version", "n")


# Shrinkage lasso: the fixed point runs per version with its own stop.
# With s = sqrt|beta| the 2 x 2 system is (s_i s_j G_ij + lambda I) u = s r, beta = s u.
SLOG_FIT = f"""
WITH RECURSIVE {MOM2},
it AS (
  SELECT version, 0 AS k, 1e0 AS b1, 1e0 AS b2, 1e0 AS move FROM mom
  UNION ALL
  SELECT version, k + 1, n1, n2, greatest(abs(n1 - b1), abs(n2 - b2))
  FROM (
    SELECT it.version, k, b1, b2,
           (b1a * r1 * (b2a * a22 + 20e0) - b1a * b2a * a12 * r2)
             / ((b1a * a11 + 20e0) * (b2a * a22 + 20e0) - b1a * b2a * a12 * a12) AS n1,
           ((b1a * a11 + 20e0) * b2a * r2 - b1a * b2a * a12 * r1)
             / ((b1a * a11 + 20e0) * (b2a * a22 + 20e0) - b1a * b2a * a12 * a12) AS n2
    FROM (SELECT *, abs(b1) AS b1a, abs(b2) AS b2a FROM it) it JOIN mom USING (version)
    WHERE k < 100 AND move >= 1e-8) s),
fit AS (
  SELECT version, CASE WHEN abs(b1) < 1e-6 THEN 0 ELSE b1 END AS w1, CASE WHEN abs(b2) < 1e-6 THEN 0 ELSE b2 END AS w2,
         m.n
  FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY k DESC) AS last FROM it) i JOIN mom m USING (version)
  WHERE last = 1)"""


@register("slog_fit", f"{SLOG_FIT} SELECT version, round(w1, 5) AS w1, round(w2, 5) AS w2 FROM fit")
def slog_fit(spark, sf):
    return flat(LASSO.fit(ord_rows(spark, sf)), "version", digits=5)


@register("slog_predict", f"""{SLOG_FIT}, {AS_OF.format(warm=2000)}
SELECT seq, round(w1 * x1 + w2 * x2, 4) AS prediction FROM wait LEFT JOIN fit USING (version)""")
def slog_predict(spark, sf):
    versions = materialize(LASSO.fit(ord_rows(spark, sf)), "slog-models")
    scored = LASSO.predict(ord_rows(spark, sf), versions)
    return scored.select("seq", F.round("prediction", 4).alias("prediction"))


# Hinge gradient of each window at a fixed model.
@register("svm_gradient", f"""
WITH {ORD}, {windowed('1000')},
h AS (SELECT window_id, s, CASE WHEN s * (0.5e0 * x1 - 0.25e0 * x2 + 0.1e0) < 1 THEN s END AS v, x1, x2
      FROM (SELECT *, 2 * y - 1 AS s FROM win))
SELECT window_id, round(0.5e0 - coalesce(sum(v * x1), 0) / count(s), 6) AS g1,
       round(-0.25e0 - coalesce(sum(v * x2), 0) / count(s), 6) AS g2,
       round(-coalesce(sum(v), 0) / count(s), 6) AS gb
FROM h GROUP BY window_id""")
def svm_gradient(spark, sf):
    rows = with_model(count_windows(unlabel(ord_rows(spark, sf), SENTINEL), 1000))
    fixed = rows.withColumn("weights", F.array(F.lit(0.5), F.lit(-0.25))).withColumn("intercept", F.lit(0.1))
    from tidelearn.operators.hinge import hinge_sums

    sums = hinge_sums(fixed, ["window_id"], 2)
    return sums.select(
        "window_id",
        F.round(0.5 - F.col("sum_yx")[0] / F.col("m"), 6).alias("g1"),
        F.round(-0.25 - F.col("sum_yx")[1] / F.col("m"), 6).alias("g2"),
        F.round(-F.col("sum_y") / F.col("m"), 6).alias("gb"),
    )


@register("svm_predict", f"""
WITH {ORD} SELECT seq, CASE WHEN 0.5e0 * x1 - 0.25e0 * x2 - 0.1e0 > 0 THEN 1e0 ELSE -1e0 END AS prediction
FROM ord WHERE y IS NULL""")
def svm_predict(spark, sf):
    rows = with_model(unlabel(ord_rows(spark, sf), SENTINEL)).filter("label is null")
    state = spark.range(1).select(
        F.lit(0).alias("model_id"), F.array(F.lit(0.5), F.lit(-0.25)).alias("weights"), F.lit(-0.1).alias("intercept")
    )
    return OnlineSvm(SvmParams(dimension=2)).score(rows, state).select("seq", "prediction")


@register("svm_fit", f"""
WITH RECURSIVE {ORD}, {labelled_windows(SVM_WINDOW)},
it AS (
  SELECT CAST(-1 AS BIGINT) AS version, CAST(0 AS BIGINT) AS n, 0.1e0 AS w1, 0.1e0 AS w2, 0.1e0 AS b
  UNION ALL
  SELECT version + 1, CAST(n + m AS BIGINT),
         w1 - 0.5e0 * (m / (n + m)) * (w1 - s1 / m), w2 - 0.5e0 * (m / (n + m)) * (w2 - s2 / m),
         b + 0.5e0 * (m / (n + m)) * sy / m
  FROM (
    SELECT it.version, it.n, it.w1, it.w2, it.b, CAST(count(y) AS DOUBLE) AS m,
           coalesce(sum(CASE WHEN v THEN s * x1 END), 0) AS s1, coalesce(sum(CASE WHEN v THEN s * x2 END), 0) AS s2,
           coalesce(sum(CASE WHEN v THEN s END), 0) AS sy
    FROM it JOIN (SELECT *, 2 * y - 1 AS s FROM win WHERE y IS NOT NULL) r ON r.window_id = it.version + 1
    CROSS JOIN LATERAL (SELECT r.s * (it.w1 * r.x1 + it.w2 * r.x2 + it.b) < 1 AS v) t
    GROUP BY ALL) g)
SELECT version, n, round(w1, 6) AS w1, round(w2, 6) AS w2, round(b, 6) AS b FROM it WHERE version >= 0""")
def svm_fit(spark, sf):
    rows = ord_rows(spark, sf)
    learner = OnlineSvm(SvmParams(dimension=2, window=SVM_WINDOW, step=0.5, step_intercept=0.5, sentinel=SENTINEL))
    versions = learner.fit(rows)
    return flat(versions.withColumn("b", F.round("intercept", 6)), "version", "n", "b")


# Rounds of 48 shards with 2 windows each; within a round both steps start from the model of the round before.
@register("svm_local_sgd", f"""
WITH RECURSIVE {ORD}, {labelled_windows(100)},
r AS (SELECT *, 2 * y - 1 AS s FROM win WHERE y IS NOT NULL),
it AS (
  SELECT CAST(-1 AS BIGINT) AS version, CAST(0 AS BIGINT) AS n, 0.1e0 AS w1, 0.1e0 AS w2, 0.1e0 AS b
  UNION ALL
  SELECT version + 1, CAST(n + sum(k) AS BIGINT), (n * w1 + sum(k * v1)) / (n + sum(k)), (n * w2 + sum(k * v2)) / (n + sum(k)), (n * b + sum(k * vb)) / (n + sum(k))
  FROM (
    SELECT version, n, w1, w2, b, m + m2 AS k,
      CASE WHEN m2 = 0 THEN u1 ELSE u1 - 0.5e0 * (m2 / (m + m2)) * (u1 - s1 / m2) END AS v1,
      CASE WHEN m2 = 0 THEN u2 ELSE u2 - 0.5e0 * (m2 / (m + m2)) * (u2 - s2 / m2) END AS v2,
      CASE WHEN m2 = 0 THEN ub ELSE ub + 0.5e0 * (m2 / (m + m2)) * sy / m2 END AS vb
    FROM (
      SELECT a.version, a.n, a.w1, a.w2, a.b, a.m, a.u1, a.u2, a.ub, CAST(count(r.y) AS DOUBLE) AS m2,
        coalesce(sum(CASE WHEN r.s * (u1 * r.x1 + u2 * r.x2 + ub) < 1 THEN r.s * r.x1 END), 0) AS s1,
        coalesce(sum(CASE WHEN r.s * (u1 * r.x1 + u2 * r.x2 + ub) < 1 THEN r.s * r.x2 END), 0) AS s2,
        coalesce(sum(CASE WHEN r.s * (u1 * r.x1 + u2 * r.x2 + ub) < 1 THEN r.s END), 0) AS sy
      FROM (
        SELECT version, n, w1, w2, b, shard, m, w1 - 0.5e0 * (w1 - t1 / m) AS u1, w2 - 0.5e0 * (w2 - t2 / m) AS u2, b + 0.5e0 * ty / m AS ub
        FROM (
          SELECT it.version, it.n, it.w1, it.w2, it.b, r.window_id // 2 AS shard, CAST(count(*) AS DOUBLE) AS m,
            coalesce(sum(CASE WHEN r.s * (it.w1 * r.x1 + it.w2 * r.x2 + it.b) < 1 THEN r.s * r.x1 END), 0) AS t1,
            coalesce(sum(CASE WHEN r.s * (it.w1 * r.x1 + it.w2 * r.x2 + it.b) < 1 THEN r.s * r.x2 END), 0) AS t2,
            coalesce(sum(CASE WHEN r.s * (it.w1 * r.x1 + it.w2 * r.x2 + it.b) < 1 THEN r.s END), 0) AS ty
          FROM it JOIN r ON r.window_id // 96 = it.version + 1 AND r.window_id % 2 = 0 GROUP BY ALL) g) a
      LEFT JOIN r ON r.window_id = 2 * a.shard + 1
      GROUP BY a.shard, a.version, a.n, a.w1, a.w2, a.b, a.m, a.u1, a.u2, a.ub) h) z
  GROUP BY version, n, w1, w2, b)
SELECT version, n, round(w1, 6) AS w1, round(w2, 6) AS w2, round(b, 6) AS b FROM it WHERE version >= 0""")
def svm_local_sgd(spark, sf):
    rows = ord_rows(spark, sf)
    learner = OnlineSvm(SvmParams(dimension=2, window=100, step=0.5, step_intercept=0.5, shards=48, sentinel=SENTINEL))
    versions = learner.fit_sharded(rows, steps=2)
    return flat(versions.withColumn("b", F.round("intercept", 6)), "version", "n", "b")


def _sgd_sql(update1: str, update2: str) -> str:
    """Recursion over (window, step): fifty steps on each window's moments."""
    return f"""
WITH RECURSIVE {ORD}, {labelled_windows(1000)},
per AS MATERIALIZED (
  SELECT window_id AS version, CAST(count(y) AS DOUBLE) AS m, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22,
         sum(y * x1) AS r1, sum(y * x2) AS r2
  FROM win WHERE y IS NOT NULL GROUP BY 1),
it AS (
  SELECT 0 AS k, 0e0 AS w1, 0e0 AS w2
  UNION ALL
  SELECT k + 1, {update1}, {update2}
  FROM (
    SELECT k, w1, w2, rate, w1 - rate * (a11 * w1 + a12 * w2 - r1) / m AS u1,
           w2 - rate * (a12 * w1 + a22 * w2 - r2) / m AS u2
    FROM (SELECT *, 0.1e0 / sqrt(CAST(k % 50 + 1 AS DOUBLE)) AS rate FROM it) it JOIN per ON per.version = k // 50) s)
SELECT CAST(k // 50 - 1 AS BIGINT) AS version, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM it WHERE k > 0 AND k % 50 = 0"""


def _sgd(spark, sf, penalty):
    learner = SgdRegression(SgdParams(dimension=2, penalty=penalty, sentinel=SENTINEL))
    return flat(learner.fit(ord_rows(spark, sf)), "version")


@register("sgd_ridge", _sgd_sql("u1 - rate * 0.1e0 * w1", "u2 - rate * 0.1e0 * w2"))
def sgd_ridge(spark, sf):
    return _sgd(spark, sf, "l2")


@register("sgd_lasso", _sgd_sql("sign(u1) * greatest(abs(u1) - rate * 0.1e0, 0)", "sign(u2) * greatest(abs(u2) - rate * 0.1e0, 0)"))
def sgd_lasso(spark, sf):
    return _sgd(spark, sf, "l1")


# Line items as sparse rows of a million features, three of them set: supplier, line number, quantity.
SPARSE_D, SPARSE_AT = 1 << 20, 1 << 19
SPARSE = f"""
li AS (SELECT row_number() OVER () AS id, l_returnflag AS model_id, l_extendedprice / 100000e0 AS y,
         [CAST(l_suppkey AS BIGINT), {SPARSE_AT} + l_linenumber, {SPARSE_AT + 16} + CAST(l_quantity AS BIGINT)] AS ix FROM lineitem),
e AS MATERIALIZED (SELECT id, model_id, y, unnest(ix) AS i FROM li),
inner_cells AS (SELECT a.model_id, a.i, b.i AS j, CAST(count(*) AS DOUBLE) AS g FROM e a JOIN e b ON a.id = b.id AND a.i <= b.i GROUP BY ALL),
right_side AS (SELECT model_id, i, sum(y) AS g FROM e GROUP BY ALL)"""


def _sparse_cells(spark, sf):
    lines = table(spark, sf, "lineitem")
    at = F.array(F.col("l_suppkey").cast("long"), (F.lit(SPARSE_AT) + F.col("l_linenumber")).cast("long"), F.lit(SPARSE_AT + 16) + F.col("l_quantity").cast("long"))
    rows = lines.select(F.col("l_returnflag").alias("model_id"), (F.col("l_extendedprice") / 100000.0).alias("label"), at.alias("indices"), F.array_repeat(F.lit(1.0), 3).alias("values"))
    return sparse_moments(rows, SPARSE_D, ["model_id"])


@register("sparse_moments", f"""
WITH {SPARSE}
SELECT model_id, i, j, round(g, 8) AS g FROM inner_cells UNION ALL SELECT model_id, i, {SPARSE_D}, round(g, 8) FROM right_side
UNION ALL SELECT model_id, {SPARSE_D}, {SPARSE_D}, CAST(count(*) AS DOUBLE) FROM li GROUP BY 1""")
def sparse_moments_query(spark, sf):
    return rounded(_sparse_cells(spark, sf), 8, "g")


def _gradients(steps: int) -> str:
    """Conjugate gradients with a diagonal preconditioner, one pair of tables per step."""
    parts = [
        SPARSE,
        "matrix AS MATERIALIZED (SELECT model_id, i, j, g FROM inner_cells UNION ALL SELECT model_id, j, i, g FROM inner_cells WHERE i < j)",
        "v0 AS MATERIALIZED (SELECT d.model_id, d.i, d.g + 1 AS m, 0e0 AS w, r.g AS r, r.g / (d.g + 1) AS p FROM inner_cells d JOIN right_side r ON r.model_id = d.model_id AND r.i = d.i WHERE d.i = d.j)",
    ]
    for k in range(steps):
        parts += [
            f"q{k} AS (SELECT v.model_id, v.i, v.m, v.w, v.r, v.p, s.q + v.p AS q FROM v{k} v JOIN (SELECT m.model_id, m.i, sum(m.g * v.p) AS q FROM matrix m JOIN v{k} v ON v.model_id = m.model_id AND v.i = m.j GROUP BY ALL) s ON s.model_id = v.model_id AND s.i = v.i)",
            f"a{k} AS MATERIALIZED (SELECT *, sum(r * r / m) OVER (PARTITION BY model_id) AS rz, sum(p * q) OVER (PARTITION BY model_id) AS pq FROM q{k})",
            f"u{k} AS (SELECT model_id, i, m, w + rz / pq * p AS w, r - rz / pq * q AS r, p, rz FROM a{k})",
            f"v{k + 1} AS MATERIALIZED (SELECT model_id, i, m, w, r, r / m + sum(r * r / m) OVER (PARTITION BY model_id) / rz * p AS p FROM u{k})",
        ]
    return "WITH " + ",\n".join(parts) + f" SELECT model_id, i, round(w, 5) AS w FROM v{steps}"


@register("sparse_ridge", _gradients(4))
def sparse_ridge_query(spark, sf):
    """Four steps towards the ridge weights of three models over a million features."""
    return rounded(sparse_ridge(_sparse_cells(spark, sf), SPARSE_D, ["model_id"], most=4, tolerance=0.0), 5, "w")
