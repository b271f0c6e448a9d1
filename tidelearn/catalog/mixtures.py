"""Queries on the mixture classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelearn.catalog.fixtures import EMB2, EVENT_LIST, emb2_rows, event_rank
from tidelearn.catalog.registry import register, spread_table, table
from tidelearn.catalog.rows import rounded
from tidelearn.operators import mixture as mx
from tidelearn.params import MixtureParams
from tidelearn.plans.mixture import GrowingMixture
from tidelearn.session import materialize

# One component per user and event type over (value, hour).  Errors start
# without a label; purchases and signups share one label, clicks and views another.
PARAMS = MixtureParams(dimension=2, max_components=6, merge_below=0.5, split_above=0.02)

EV = """
ev AS (
  SELECT event_id, user_id AS model_id, value / 97e0 AS x1, CAST(hour(ts) AS DOUBLE) / 23e0 AS x2, event_type,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('click', 'view') THEN 2 ELSE 3 END AS label
  FROM events)"""
COMP = f"""
{EV},
comp AS (
  SELECT model_id, CAST(list_position({EVENT_LIST}, event_type) - 1 AS BIGINT) AS id,
         count(*) / CAST(sum(count(*)) OVER (PARTITION BY model_id) AS DOUBLE) AS tau, CAST(count(*) AS DOUBLE) AS c,
         avg(x1) AS mu1, avg(x2) AS mu2, var_pop(x1) + 0.01e0 AS s11, covar_pop(x1, x2) AS s12, var_pop(x2) + 0.01e0 AS s22,
         CASE WHEN any_value(label) = 3 THEN 0 ELSE any_value(label) END AS label
  FROM ev GROUP BY model_id, event_type)"""
FIT = f"""
{COMP},
fit AS (
  SELECT event_id, ev.model_id, ev.label AS row_label, x1, x2, comp.id, comp.label, tau, c, mu1, mu2, s11, s12, s22,
         sqrt((s22 * (x1 - mu1) ** 2 - 2 * s12 * (x1 - mu1) * (x2 - mu2) + s11 * (x2 - mu2) ** 2) / (s11 * s22 - s12 * s12)) AS dist,
         exp(-0.5e0 * (s22 * (x1 - mu1) ** 2 - 2 * s12 * (x1 - mu1) * (x2 - mu2) + s11 * (x2 - mu2) ** 2) / (s11 * s22 - s12 * s12))
           / (2 * pi() * sqrt(s11 * s22 - s12 * s12)) AS dens
  FROM ev JOIN comp ON comp.model_id = ev.model_id)"""
MATCH = f"""
{FIT},
best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dens DESC, id) AS r FROM fit WHERE dist < 5) WHERE r = 1),
matched AS (
  SELECT e.event_id, e.model_id, e.label AS row_label, e.x1, e.x2, b.id,
         CASE WHEN b.id IS NULL THEN 2 WHEN b.label = 0 THEN 1 WHEN b.label <> e.label THEN 2 ELSE 3 END AS situation
  FROM ev e LEFT JOIN best b USING (event_id))"""


def event_rows(spark, sf):
    kind = F.col("event_type")
    label = F.when(kind.isin("purchase", "signup"), 1).when(kind.isin("click", "view"), 2).otherwise(3)
    return spread_table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "ts").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("model_id"),
        label.alias("label"),
        F.array(F.col("value") / 97.0, F.hour("ts").cast("double") / 23.0).alias("features"),
        event_rank().cast("long").alias("kind"),
    )


def components(spark, sf):
    x = F.col("features")
    groups = event_rows(spark, sf).groupBy("model_id", F.col("kind").alias("id")).agg(
        F.count(F.lit(1)).cast("double").alias("c"),
        F.avg(x[0]).alias("m1"), F.avg(x[1]).alias("m2"),
        F.var_pop(x[0]).alias("v1"), F.var_pop(x[1]).alias("v2"), F.covar_pop(x[0], x[1]).alias("cv"),
        F.any_value("label").alias("label"),
    )
    users = groups.groupBy("model_id").agg(F.sum("c").alias("total"))
    return groups.join(users, "model_id").select(
        "model_id", "id", (F.col("c") / F.col("total")).alias("tau"), "c",
        F.array("m1", "m2").alias("mu"),
        F.array(F.col("v1") + 0.01, F.col("cv"), F.col("v2") + 0.01).alias("sigma"),
        F.when(F.col("label") == 3, 0).otherwise(F.col("label")).alias("label"),
    )


def state(spark, sf):
    """Model rows as a learner would read them: from a written table."""
    return materialize(mx.pack_components(components(spark, sf), PARAMS.max_components), "components")


def rows_and_matcher(spark, sf):
    return event_rows(spark, sf).drop("kind"), mx.Matcher(state(spark, sf), PARAMS)


def component_rows(models, digits=6):
    flat = mx.unpack_components(models)
    mu, s = F.col("mu"), F.col("sigma")
    cols = {"mu1": mu[0], "mu2": mu[1], "s11": s[0], "s12": s[1], "s22": s[2], "tau": F.col("tau"), "c": F.col("c")}
    return flat.select("model_id", "id", "label", *[F.round(v, digits).alias(k) for k, v in cols.items()])


ROWS_OUT = ("model_id, id, CAST(label AS INTEGER) AS label, round(mu1, 6) AS mu1, round(mu2, 6) AS mu2, round(s11, 6) AS s11, "
            "round(s12, 6) AS s12, round(s22, 6) AS s22, round(tau, 6) AS tau, round(c, 6) AS c")


@register("gmm_init", f"""
WITH {EMB2}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) AS place FROM emb2)
SELECT CAST(label AS INTEGER) AS model_id, CAST(place - 1 AS BIGINT) AS id, round(1e0 / count(*) OVER (PARTITION BY label), 6) AS tau,
       round(x1, 6) AS mu1, round(x2, 6) AS mu2
FROM r WHERE place <= 3""")
def gmm_init(spark, sf):
    rows = emb2_rows(spark, sf).withColumn("model_id", F.col("label").cast("int"))
    seeds = mx.seed_components(rows, 3, 2)
    mu = F.col("mu")
    return seeds.select(
        "model_id", "id", F.round("tau", 6).alias("tau"), F.round(mu[0], 6).alias("mu1"), F.round(mu[1], 6).alias("mu2")
    )


def _per_component(spark, sf, field):
    rows, matcher = rows_and_matcher(spark, sf)
    fits = matcher.evaluate(rows).select(F.col("seq").alias("event_id"), F.explode("fits").alias("f"))
    return fits.select("event_id", F.col("f.id").alias("id"), F.round(F.col(f"f.{field}"), 6).alias("v"))


@register("gmm_density", f"WITH {FIT} SELECT event_id, id, round(dens, 6) AS v FROM fit")
def gmm_density(spark, sf):
    return _per_component(spark, sf, "density")


@register("gmm_mahalanobis", f"WITH {FIT} SELECT event_id, id, round(dist, 6) AS v FROM fit")
def gmm_mahalanobis(spark, sf):
    return _per_component(spark, sf, "distance")


@register("gmm_match", f"WITH {MATCH} SELECT event_id, situation, id FROM matched")
def gmm_match(spark, sf):
    rows, matcher = rows_and_matcher(spark, sf)
    return matcher.match(rows).select(F.col("seq").alias("event_id"), "situation", "id")


@register("gmm_predict", f"""
WITH {FIT},
best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dens DESC, id) AS r FROM fit WHERE label <> 0) WHERE r = 1)
SELECT ev.event_id, CAST(coalesce(best.label, -1) AS DOUBLE) AS prediction FROM ev LEFT JOIN best USING (event_id)""")
def gmm_predict(spark, sf):
    rows, matcher = rows_and_matcher(spark, sf)
    return matcher.predict(rows).select(F.col("seq").alias("event_id"), "prediction")


ASOF = MixtureParams(dimension=2, window=20, warmup=30, sentinel=3.0, max_components=6)


# Version v of a user's model has all means moved by v hundredths and stands for 20 (v + 1) rows; errors wait for a label.
@register("gmm_asof", f"""
WITH {COMP},
win AS (
  SELECT *, (count(y) OVER (PARTITION BY model_id ORDER BY event_id) - CASE WHEN y IS NULL THEN 0 ELSE 1 END) // 20 AS window_id,
         count(y) OVER (PARTITION BY model_id) // 20 AS newest
  FROM (SELECT *, CASE WHEN label <> 3 THEN label END AS y FROM ev)),
wait AS (SELECT event_id, model_id, x1, x2, CASE WHEN newest >= 1 THEN greatest(window_id - 1, 1) END AS version FROM win WHERE y IS NULL),
near AS (
  SELECT event_id, comp.label, id, exp(-0.5e0 * (s22 * g1 ** 2 - 2 * s12 * g1 * g2 + s11 * g2 ** 2) / (s11 * s22 - s12 * s12)) / (2 * pi() * sqrt(s11 * s22 - s12 * s12)) AS dens
  FROM wait JOIN comp ON comp.model_id = wait.model_id AND comp.label <> 0,
       LATERAL (SELECT x1 - mu1 - version / 100e0 AS g1, x2 - mu2 - version / 100e0 AS g2) t WHERE version IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dens DESC, id) AS r FROM near) WHERE r = 1)
SELECT event_id, CAST(version AS BIGINT) AS version, CASE WHEN version IS NOT NULL THEN CAST(coalesce(best.label, -1) AS DOUBLE) END AS prediction
FROM wait LEFT JOIN best USING (event_id)""")
def gmm_asof(spark, sf):
    """Unlabelled events scored with the version of their time, all versions in one job."""
    rows = event_rows(spark, sf).drop("kind")
    newest = rows.groupBy("model_id").agg(F.expr("count_if(label <> 3) div 20").alias("newest"))
    moved = F.transform("comps", lambda c: c.withField("mu", F.transform(c["mu"], lambda m: m + F.col("version") / 100.0)))
    versions = state(spark, sf).join(newest, "model_id").withColumn("version", F.explode(F.sequence(F.lit(0).cast("long"), F.col("newest"))))
    versions = versions.select("model_id", "version", (20 * (F.col("version") + 1)).alias("n"), moved.alias("comps"))
    scored = GrowingMixture(ASOF).predict(rows, materialize(versions, "mixture-asof"))
    return scored.select(F.col("seq").alias("event_id"), "version", "prediction")


def _after(spark, sf, *steps):
    rows, matcher = rows_and_matcher(spark, sf)
    return mx.advance(matcher.state, matcher.window_stats(rows), PARAMS, steps)


@register("gmm_adopt_label", f"""
WITH {MATCH},
own AS (SELECT model_id, id, arg_min(row_label, event_id) AS label FROM matched WHERE situation = 1 GROUP BY 1, 2)
SELECT model_id, id, CAST(coalesce(own.label, comp.label) AS INTEGER) AS label FROM comp LEFT JOIN own USING (model_id, id)""")
def gmm_adopt_label(spark, sf):
    return mx.unpack_components(_after(spark, sf, "adopt")).select("model_id", "id", "label")


@register("gmm_create", f"""
WITH {MATCH},
place AS (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY event_id) AS place_no, count(*) OVER (PARTITION BY model_id) AS new
  FROM (SELECT model_id, row_label AS label, min(event_id) AS event_id, arg_min(x1, event_id) AS mu1, arg_min(x2, event_id) AS mu2
        FROM matched WHERE situation = 2 GROUP BY 1, 2)),
room AS (SELECT DISTINCT model_id, new FROM place),
old AS (
  SELECT comp.*, new, row_number() OVER (PARTITION BY comp.model_id ORDER BY tau DESC, id DESC) AS r
  FROM comp LEFT JOIN room ON room.model_id = comp.model_id),
kept AS (SELECT * FROM old WHERE new IS NULL OR r <= 6 - new),
free AS (
  SELECT m.model_id, i, row_number() OVER (PARTITION BY m.model_id ORDER BY i) AS place_no
  FROM room m CROSS JOIN generate_series(0, 12) s(i)
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.model_id = m.model_id AND k.id = i)),
out AS (
  SELECT model_id, id, label, mu1, mu2, s11, s12, s22, CASE WHEN new IS NULL THEN tau ELSE 0.5e0 * tau END AS tau, c FROM kept
  UNION ALL
  SELECT p.model_id, free.i, p.label, p.mu1, p.mu2, 1e0, 0e0, 1e0, 0.5e0, 1e0
  FROM place p JOIN free ON free.model_id = p.model_id AND free.place_no = p.place_no)
SELECT {ROWS_OUT} FROM out""")
def gmm_create(spark, sf):
    return component_rows(_after(spark, sf, "create"))


@register("gmm_em_step", f"""
WITH {MATCH},
q AS (
  SELECT f.*, tau * dens / sum(tau * dens) OVER (PARTITION BY f.event_id) AS q
  FROM fit f JOIN matched m ON m.event_id = f.event_id AND m.situation = 3 WHERE dist < 5),
n AS (SELECT model_id, count(*) AS n FROM matched WHERE situation = 3 GROUP BY 1),
s AS (
  SELECT model_id, id, sum(q) AS sq, sum(q * x1) AS q1, sum(q * x2) AS q2, sum(q * (x1 - mu1) ** 2) AS t11,
         sum(q * (x1 - mu1) * (x2 - mu2)) AS t12, sum(q * (x2 - mu2) ** 2) AS t22
  FROM q GROUP BY 1, 2),
r AS (
  SELECT comp.*, n.n, s.*, least(1e0, sq * (0.5e0 / (c + sq) + 0.5e0 / n)) AS eta
  FROM comp LEFT JOIN s ON s.model_id = comp.model_id AND s.id = comp.id LEFT JOIN n ON n.model_id = comp.model_id),
d AS (SELECT *, eta * (q1 / sq - mu1) AS d1, eta * (q2 / sq - mu2) AS d2 FROM r),
out AS (
  SELECT model_id, id, label, coalesce(mu1 + d1, mu1) AS mu1, coalesce(mu2 + d2, mu2) AS mu2,
         coalesce((1 - eta) * s11 + eta * t11 / sq - d1 * d1 + 1e-6, s11) AS s11,
         coalesce((1 - eta) * s12 + eta * t12 / sq - d1 * d2, s12) AS s12,
         coalesce((1 - eta) * s22 + eta * t22 / sq - d2 * d2 + 1e-6, s22) AS s22,
         CASE WHEN n IS NULL THEN tau ELSE 0.5e0 * tau + 0.5e0 * coalesce(sq, 0) / n END AS tau, c + coalesce(sq, 0) AS c
  FROM d)
SELECT {ROWS_OUT} FROM out""")
def gmm_em_step(spark, sf):
    return component_rows(_after(spark, sf, "em"))


PAIRS = f"""
{COMP},
pair AS (
  SELECT a.model_id, a.id, b.id AS id2,
         0.25e0 * ((b.s22 * a.s11 - 2 * b.s12 * a.s12 + b.s11 * a.s22) / (b.s11 * b.s22 - b.s12 * b.s12)
                  + (a.s22 * b.s11 - 2 * a.s12 * b.s12 + a.s11 * b.s22) / (a.s11 * a.s22 - a.s12 * a.s12)
                  + (b.s22 * (a.mu1 - b.mu1) ** 2 - 2 * b.s12 * (a.mu1 - b.mu1) * (a.mu2 - b.mu2) + b.s11 * (a.mu2 - b.mu2) ** 2)
                    / (b.s11 * b.s22 - b.s12 * b.s12)
                  + (a.s22 * (a.mu1 - b.mu1) ** 2 - 2 * a.s12 * (a.mu1 - b.mu1) * (a.mu2 - b.mu2) + a.s11 * (a.mu2 - b.mu2) ** 2)
                    / (a.s11 * a.s22 - a.s12 * a.s12) - 4) AS skld
  FROM comp a JOIN comp b ON a.model_id = b.model_id AND a.label = b.label AND a.id < b.id WHERE a.label <> 0)"""


@register("gmm_merge_pairs", f"""
WITH {PAIRS}
SELECT model_id, id, arg_min(id2, skld) AS id2, round(min(skld), 5) AS skld FROM pair GROUP BY 1, 2""")
def gmm_merge_pairs(spark, sf):
    return rounded(mx.merge_pairs(state(spark, sf)), 5, "skld")


@register("gmm_merge", f"""
WITH {PAIRS},
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY skld, id, id2) AS r FROM pair)
         WHERE r = 1 AND skld < 0.5e0),
out AS (
  SELECT comp.* FROM comp LEFT JOIN near ON near.model_id = comp.model_id
  WHERE near.id IS NULL OR (comp.id <> near.id AND comp.id <> near.id2)
  UNION ALL
  SELECT model_id, id, t, c, (ta * m1a + tb * m1b) / t, (ta * m2a + tb * m2b) / t,
         (ta * a11 + tb * b11) / t + ta * tb / (t * t) * (m1a - m1b) ** 2,
         (ta * a12 + tb * b12) / t + ta * tb / (t * t) * (m1a - m1b) * (m2a - m2b),
         (ta * a22 + tb * b22) / t + ta * tb / (t * t) * (m2a - m2b) ** 2, label
  FROM (SELECT a.model_id, a.id, a.tau + b.tau AS t, a.tau AS ta, b.tau AS tb, a.c + b.c AS c, a.mu1 AS m1a, b.mu1 AS m1b,
               a.mu2 AS m2a, b.mu2 AS m2b, a.s11 AS a11, b.s11 AS b11, a.s12 AS a12, b.s12 AS b12, a.s22 AS a22, b.s22 AS b22, a.label
        FROM near JOIN comp a ON a.model_id = near.model_id AND a.id = near.id
                  JOIN comp b ON b.model_id = near.model_id AND b.id = near.id2) p)
SELECT {ROWS_OUT} FROM out""")
def gmm_merge(spark, sf):
    return component_rows(mx.reshape(state(spark, sf), PARAMS, ("merge",)))


@register("gmm_split", f"""
WITH {COMP},
big AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY s11 * s22 - s12 * s12 DESC, id) AS r,
         count(*) OVER (PARTITION BY model_id) AS k, max(id) OVER (PARTITION BY model_id) AS top FROM comp)
  WHERE r = 1 AND s11 * s22 - s12 * s12 > 0.02e0 AND k < 6),
eig AS (SELECT *, (s11 + s22) / 2 + sqrt(((s11 - s22) / 2) ** 2 + s12 * s12) AS l FROM big),
axis AS (SELECT *, sqrt(0.8e0 * l) * sign(s12) / sqrt(s12 * s12 + (l - s11) ** 2) AS f FROM eig),
shift AS (SELECT *, f * s12 AS d1, f * (l - s11) AS d2 FROM axis),
free AS (
  SELECT big.model_id, min(i) AS i FROM big CROSS JOIN generate_series(0, 6) s(i)
  WHERE NOT EXISTS (SELECT 1 FROM comp k WHERE k.model_id = big.model_id AND k.id = i) GROUP BY 1),
out AS (
  SELECT comp.* FROM comp LEFT JOIN big ON big.model_id = comp.model_id AND big.id = comp.id WHERE big.id IS NULL
  UNION ALL
  SELECT model_id, id, tau / 2, c / 2, mu1 + d1, mu2 + d2, s11 - d1 * d1, s12 - d1 * d2, s22 - d2 * d2, label FROM shift
  UNION ALL
  SELECT s.model_id, i, tau / 2, c / 2, mu1 - d1, mu2 - d2, s11 - d1 * d1, s12 - d1 * d2, s22 - d2 * d2, label
  FROM shift s JOIN free ON free.model_id = s.model_id)
SELECT {ROWS_OUT} FROM out""")
def gmm_split(spark, sf):
    return component_rows(mx.reshape(state(spark, sf), PARAMS, ("split",)))


@register("gmm_fit")
def gmm_fit(spark, sf):
    rows = emb2_rows(spark, sf).withColumn("label", F.col("label") + 1.0)
    learner = GrowingMixture(MixtureParams(dimension=2, window=250, max_components=10))
    versions = learner.fit(rows)
    flat = versions.select("version", "n", F.explode("comps").alias("c"))
    mu = F.col("c.mu")
    return flat.select(
        "version", "n", F.col("c.id").alias("id"), F.round("c.tau", 6).alias("tau"), F.round(mu[0], 6).alias("mu1"),
        F.round(mu[1], 6).alias("mu2"), F.col("c.label").alias("label"),
    )
