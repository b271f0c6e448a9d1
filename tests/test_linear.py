"""Linear learners against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelearn.operators import hinge
from tidelearn.operators.sparse import sparse_moments, sparse_ridge
from tidelearn.params import LassoParams, RidgeParams, SgdParams, SvmParams
from tidelearn.plans import sgd as sgd_module, svm as svm_module
from tidelearn.plans.learner import Chain, RowFunction, Stage, Standardize
from tidelearn.plans.moment_learners import Ridge, ShrinkageLasso
from tidelearn.plans.sgd import SgdRegression, descend
from tidelearn.plans.svm import OnlineSvm


def data(n=400, d=3, seed=0, models=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.linspace(1, 2, d) + 0.1 * rng.normal(size=n)
    return x, y, np.arange(n) % models


def frame(spark, x, y, m, sentinel=None):
    rows = [
        (i, int(m[i]), sentinel if sentinel is not None and i % 7 == 6 else float(y[i]), [float(v) for v in x[i]])
        for i in range(len(y))
    ]
    return spark.createDataFrame(rows, "seq long, model_id int, label double, features array<double>").repartition(3)


def weights(versions):
    return {(r.model_id, r.version): np.array(r.weights) for r in versions.collect()}


@pytest.mark.parametrize("d", [3, 33])
def test_ridge_equals_batch_solve(spark, d):
    x, y, m = data(d=d, models=2)
    learner = Ridge(RidgeParams(dimension=d, window=50, penalty=0.5))
    got = weights(learner.fit(frame(spark, x, y, m)))
    assert len(got) == 8
    for (model, t), w in got.items():
        rows = np.flatnonzero(m == model)[: 50 * (t + 1)]
        want = np.linalg.solve(x[rows].T @ x[rows] + 0.5 * np.eye(d), x[rows].T @ y[rows])
        assert np.allclose(w, want)


def test_scoring_waits_for_a_warm_model(spark):
    x, y, m = data()
    rows = frame(spark, x, y, m, sentinel=-9.0)
    learner = Ridge(RidgeParams(dimension=3, window=50, warmup=60))
    versions = learner.fit(rows)
    got = {r.seq: r for r in learner.predict(rows, versions).collect()}
    waiting = [i for i in range(400) if i % 7 == 6]
    assert sorted(got) == waiting
    w = weights(versions)
    n = {r.version: r.n for r in versions.collect()}
    first = min(v for v in n if n[v] > 60)
    for i in waiting:
        version = max((i - i // 7) // 50 - 1, first)
        assert got[i].version == version and np.isclose(got[i].prediction, x[i] @ w[(0, version)])
    # A call-time parameter wins over the learner's own; rows that wait for ever are returned unscored.
    cold = learner.predict(rows, versions, warmup=10_000)
    assert cold.count() == len(waiting) and cold.filter("prediction is not null or version is not null").count() == 0


def test_lasso_equals_coordinate_descent(spark):
    x, y, m = data(n=300, d=5)
    x[:, 3] *= 0.01
    learner = ShrinkageLasso(LassoParams(dimension=5, window=100, penalty=20.0))
    got = weights(learner.fit(frame(spark, x, y, m)))
    for (_, t), w in got.items():
        a, b = x[: 100 * (t + 1)], y[: 100 * (t + 1)]
        beta = np.zeros(5)
        for _ in range(2000):
            for j in range(5):
                r = b - a @ beta + a[:, j] * beta[j]
                z = a[:, j] @ r
                beta[j] = np.sign(z) * max(abs(z) - 20.0, 0) / (a[:, j] @ a[:, j])
        assert np.allclose(w, beta, atol=1e-4) and w[3] == 0


def svm_numpy(x, y, size, p):
    w, b, n, out = np.full(x.shape[1], p.start_weight), p.start_intercept, 0, []
    for s in range(0, len(y), size):
        a, t = x[s : s + size], y[s : s + size]
        hit = t * (a @ w + b) < 1
        rate = len(t) / (n + len(t)) if p.merge == "count" else 1.0
        gw, gb = w - p.cost / len(t) * (t[hit] @ a[hit]), -p.cost / len(t) * t[hit].sum()
        w, b, n = w - p.step * rate * gw, b - p.step_intercept * rate * gb, n + len(t)
        out.append((w, b, n))
    return out


@pytest.mark.parametrize("merge", ["count", "step"])
def test_svm_windows(spark, merge):
    x, y, m = data(n=300, models=2)
    y = np.sign(y)
    p = SvmParams(dimension=3, window=50, step=0.3, step_intercept=0.2, merge=merge)
    # The second model ends early and then keeps its state.
    keep = (m == 0) | (np.arange(300) < 200)
    x, y, m = x[keep], y[keep], m[keep]
    versions = {(r.model_id, r.version): r for r in OnlineSvm(p).fit(frame(spark, x, y, m)).collect()}
    for model in (0, 1):
        want = svm_numpy(x[m == model], y[m == model], 50, p)
        for t, (w, b, n) in enumerate(want):
            r = versions[(model, t)]
            assert np.allclose(r.weights, w) and np.isclose(r.intercept, b) and r.n == n
    assert versions[(1, 2)].weights == versions[(1, 1)].weights


def test_wide_hinge_sums(spark, monkeypatch):
    x, y, m = data(n=100, d=4)
    rows = frame(spark, x, np.sign(y), m).withColumn("weights", F.array_repeat(F.lit(0.1), 4)).withColumn("intercept", F.lit(0.0))
    want = hinge.hinge_sums(rows, ["model_id"], 4).first()
    monkeypatch.setattr(hinge, "UNROLL", 2)
    monkeypatch.setattr(svm_module, "UNROLL", 2)
    got = hinge.hinge_sums(rows, ["model_id"], 4).first()
    assert np.allclose(got.sum_yx, want.sum_yx) and (got.m, got.sum_y) == (want.m, want.sum_y)
    learner = OnlineSvm(SvmParams(dimension=4))
    state = learner.update(rows.drop("weights", "intercept"), None)
    again = learner.update(rows.drop("weights", "intercept"), state)
    assert again.first().n == 200


def test_svm_shards(spark):
    x, y, m = data(n=630)
    y = np.sign(y)
    p = SvmParams(dimension=3, window=40, step=0.3, step_intercept=0.3, shards=3)
    rows = frame(spark, x, y, m)
    got = OnlineSvm(p).fit_sharded(rows, steps=2).orderBy("version").collect()
    w, b, n = np.full(3, 0.1), 0.1, 0
    for t in range(3):
        # 16 windows, the last with 30 rows, in rounds of 3 x 2.
        parts = [(n, w, b)] if n else []
        for s in range(3):
            lw, lb, ln = w, b, 0
            for k in range(t * 6 + 2 * s, t * 6 + 2 * s + 2):
                a, c = x[40 * k : 40 * k + 40], y[40 * k : 40 * k + 40]
                if not len(c):
                    continue
                hit = c * (a @ lw + lb) < 1
                rate = len(c) / (ln + len(c))
                gw, gb = lw - (c[hit] @ a[hit]) / len(c), -c[hit].sum() / len(c)
                lw, lb, ln = lw - 0.3 * rate * gw, lb - 0.3 * rate * gb, ln + len(c)
            parts += [(ln, lw, lb)] if ln else []
        n = sum(q[0] for q in parts)
        w, b = sum(q[0] * q[1] for q in parts) / n, sum(q[0] * q[2] for q in parts) / n
        assert got[t].n == n and np.allclose(got[t].weights, w) and np.isclose(got[t].intercept, b)
    assert len(got) == 3
    # A shorter table has the same first versions.
    short = OnlineSvm(p).fit_sharded(rows.where("seq < 480"), steps=2).orderBy("version").collect()
    assert [(r.version, r.n) for r in short] == [(0, 240), (1, 480)]
    assert all(np.allclose(a.weights, c.weights) for a, c in zip(short, got))


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_sgd_in_passes(spark, monkeypatch, penalty):
    x, y, m = data(n=300, models=2)
    p = SgdParams(dimension=3, iterations=7, penalty=penalty, window=40)
    rows = frame(spark, x, y, m)
    want = weights(SgdRegression(p).fit(rows))
    monkeypatch.setattr(sgd_module, "HELD_CELLS", 18)
    got = weights(SgdRegression(p).fit(rows))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    w = np.zeros(3)
    for t in range(4):
        ids = np.flatnonzero(m == 1)[40 * t : 40 * (t + 1)]
        w = descend(w, x[ids].T @ x[ids], x[ids].T @ y[ids], len(ids), p)
        assert np.allclose(got[(1, t)], w)
    # The moment form equals plain steps on the rows.
    ids, v = np.arange(40), np.zeros(3)
    for i in range(1, 8):
        r = p.step / np.sqrt(i)
        u = v - r * x[ids].T @ (x[ids] @ v - y[ids]) / 40
        v = np.sign(u) * np.maximum(np.abs(u) - r * p.reg, 0) if penalty == "l1" else u - r * p.reg * v
    assert np.allclose(v, descend(np.zeros(3), x[ids].T @ x[ids], x[ids].T @ y[ids], 40, p))


def test_chain_standardises_then_fits(spark):
    x, y, m = data(models=2)
    x[:, 2] = 5.0
    rows = frame(spark, x, y, m)
    chain = Standardize(3).chain(Ridge(RidgeParams(dimension=3, window=100)))
    scale, versions = chain.fit(rows)
    assert scale.count() == 2
    got = weights(versions)
    ids = np.flatnonzero(m == 0)
    s = x[ids].std(axis=0)
    z = (x[ids] - x[ids].mean(axis=0)) / np.where(s > 1e-12, s, 1.0)
    z[:, 2] = 0
    want = np.linalg.solve(z[:100].T @ z[:100] + np.eye(3), z[:100].T @ y[ids][:100])
    assert np.allclose(got[(0, 0)], want)


def test_user_functions_and_errors(spark):
    x, y, m = data(n=20)
    rows = frame(spark, x, y, m)
    doubled = RowFunction(lambda model, a: list(a * model), 2.0, "features", "array<double>")
    total = RowFunction(lambda model, a: a.sum(axis=1))
    got = Chain([doubled, total]).predict(rows)
    assert got.count() == 20 and set(rows.columns) < set(got.columns)
    assert all(np.isclose(r.prediction, 2 * x[r.seq].sum()) for r in got.collect())
    with pytest.raises(TypeError, match="Stage cannot"):
        Stage().transform(rows)
    with pytest.raises(TypeError, match="needs column"):
        Ridge(RidgeParams(dimension=3)).fit(rows.drop("label"))
    with pytest.raises(TypeError, match="no parameter"):
        Ridge(RidgeParams(dimension=3)).fit(rows, nothing=1)
    with pytest.raises(TypeError, match="must be fitted"):
        Standardize(3).transform(rows)


def test_unsound_rows_are_rejected(spark):
    """Another width, null or NaN entries, NaN labels and lost order keys neither train nor spoil a model."""
    x, y, m = data(n=120)
    rows = frame(spark, x, y, m, sentinel=-9.0)
    nan = float("nan")
    bad = spark.createDataFrame(
        [(1000, 0, 1.0, [1.0]), (1001, 0, 1.0, [1.0] * 4), (1002, 0, 1.0, [1.0, nan, 1.0]), (1003, 0, nan, [1.0] * 3), (1004, 0, 1.0, None), (None, 0, 1.0, [1.0] * 3), (1005, 0, -9.0, [1.0, None, 1.0])],
        rows.schema,
    )
    both = rows.unionByName(bad)
    ridge, svm = Ridge(RidgeParams(dimension=3, window=30, warmup=20)), OnlineSvm(SvmParams(dimension=3, window=60))
    sgd = SgdRegression(SgdParams(dimension=3, window=30))
    for learner in (ridge, svm, sgd):
        want, got = weights(learner.fit(rows)), weights(learner.fit(both))
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
        assert learner.rejects(both).count() == 7
    versions = ridge.fit(both)
    assert ridge.predict(both, versions).count() == ridge.predict(rows, versions).count()


def test_windows_hold_labelled_rows(spark):
    """A masked head and tail make no empty versions."""
    x, y, m = data(n=300)
    rows = frame(spark, x, y, m).withColumn("label", F.when(F.col("seq").between(100, 219), F.col("label")).otherwise(-9.0))
    versions = Ridge(RidgeParams(dimension=3, window=50)).fit(rows)
    assert sorted((r.version, r.n) for r in versions.collect()) == [(0, 50), (1, 100), (2, 120)]
    got = {r.seq: r.version for r in Ridge(RidgeParams(dimension=3, window=50)).predict(rows, versions).collect()}
    assert len(got) == 180 and got[0] == 1 and got[299] == 1


def test_small_models_are_broadcast(spark):
    """A 1 MB model table is sent to the rows, not shuffled with them; a hot model is split."""
    rows = spark.range(50_000).select(F.col("id").alias("seq"), (F.col("id") % 20_000).alias("model_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("features"))
    state = spark.range(20_000).select(F.col("id").alias("model_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("weights"), F.lit(0.5).alias("intercept"))
    scored = OnlineSvm(SvmParams(dimension=2)).score(rows, state)
    scored.collect()
    assert "BroadcastHashJoin" in scored._jdf.queryExecution().executedPlan().toString()


def test_chain_passes_parameters_on(spark):
    x, y, m = data(n=100)
    chain = Standardize(3).chain(Ridge(RidgeParams(dimension=3, window=50)))
    rows = frame(spark, x, y, m)
    assert chain.fit(rows, window=10)[-1].count() == 10
    with pytest.raises(TypeError, match="no parameter"):
        chain.fit(rows, nothing=1)
    with pytest.raises(TypeError, match="no parameter"):
        Chain([Standardize(3)]).transform(rows, [Standardize(3).fit(rows)], nothing=1)


def test_sparse_moments_equal_dense(spark):
    rng = np.random.default_rng(8)
    d, rows = 6, []
    for k in range(60):
        at = sorted(rng.choice(d, rng.integers(0, 4), replace=False).tolist())
        rows.append((k % 2, [int(i) for i in at], [float(v) for v in rng.normal(size=len(at))], None if k % 9 == 4 else float(rng.normal())))
    # A repeated index adds up, nulls and zeros are not set, a NaN label is none.
    rows += [(0, [2, 2, 4], [1.0, 2.0, 0.0], 1.0), (1, [1, None], [1.5, 2.0], 2.0), (1, None, None, 3.0), (0, [0], [1.0], float("nan"))]
    frame_ = spark.createDataFrame(rows, "model_id int, indices array<int>, values array<double>, label double")
    got = {(r.model_id, r.i, r.j): r.g for r in sparse_moments(frame_, d, ["model_id"]).collect()}
    for key in (0, 1):
        x, y = [], []
        for m, at, v, label in rows:
            if m == key and label is not None and label == label:
                row = np.zeros(d)
                for i, u in zip(at or [], v or []):
                    if i is not None:
                        row[i] += u
                x.append(row)
                y.append(label)
        x, y = np.array(x), np.array(y)
        gram = x.T @ x
        assert all(np.isclose(got.get((key, i, j), 0.0), gram[i, j]) for i in range(d) for j in range(i, d))
        assert np.allclose([got.get((key, i, d), 0.0) for i in range(d)], x.T @ y) and got[key, d, d] == len(y)
        want = np.linalg.solve(gram + 0.5 * np.eye(d), x.T @ y)
        w = {r.i: r.w for r in sparse_ridge(sparse_moments(frame_, d, ["model_id"]), d, ["model_id"], penalty=0.5).where(F.col("model_id") == key).collect()}
        assert np.allclose([w.get(i, 0.0) for i in range(d)], want, atol=1e-6)
    assert sparse_moments(frame_.where("false"), d, ["model_id"]).count() == 0


def test_sparse_ridge_of_many_features(spark):
    rng = np.random.default_rng(9)
    d, n = 10_000, 400
    at = [sorted(rng.choice(d, 3, replace=False).tolist()) for _ in range(n)]
    x = np.zeros((n, d))
    for k, i in enumerate(at):
        x[k, i] = [1.0, -2.0, 0.5]
    y = rng.normal(size=n)
    rows = spark.createDataFrame([(0, a, [1.0, -2.0, 0.5], float(v)) for a, v in zip(at, y)], "model_id int, indices array<int>, values array<double>, label double")
    got = {r.i: r.w for r in sparse_ridge(sparse_moments(rows, d, ["model_id"]), d, ["model_id"]).collect()}
    want = x.T @ np.linalg.solve(x @ x.T + np.eye(n), y)
    assert len(got) == len({i for a in at for i in a}) and all(np.isclose(w, want[i], atol=1e-6) for i, w in got.items())
