"""Mixture steps and the whole loop against plain numpy, one row at a time."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelearn.functions import gaussian as g
from tidelearn.operators import mixture as mx
from tidelearn.params import MixtureParams
from tidelearn.plans.mixture import GrowingMixture
from tidelearn.session import materialize


def clusters(n=240, d=2, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.integers(1, 4, size=n)
    centre = np.zeros((4, d))
    centre[1:, 0] = [0, 8, 0]
    centre[1:, 1] = [0, 0, 8]
    return centre[label] + rng.normal(size=(n, d)), label


def frame(spark, x, label, models=1):
    rows = [(i, i % models, float(label[i]), [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "seq long, model_id int, label double, features array<double>").repartition(3)


def density(c, x):
    d = len(x)
    s = g.full(c["sigma"], d)
    gap = x - np.array(c["mu"])
    q = gap @ np.linalg.inv(s) @ gap
    return np.sqrt(q), np.exp(-0.5 * q) / np.sqrt((2 * np.pi) ** d * np.linalg.det(s))


def loop(x, label, size, p):
    """The window rule of the learner, row by row."""
    d = x.shape[1]
    comps = [g.component(i, 1 / p.start_components, 1.0, x[i], np.eye(d), 0) for i in range(p.start_components)]
    out = []
    for s in range(0, len(x), size):
        own, sums, places, em = {}, {}, {}, 0
        for a, t in zip(x[s : s + size], label[s : s + size]):
            fits = [(c, *density(c, a)) for c in comps]
            near = [f for f in fits if f[1] < p.gate]
            best = max(near, key=lambda f: (f[2], -f[0]["id"]))[0] if near else None
            if best is None or (best["label"] != 0 and best["label"] != t):
                places.setdefault(int(t), a)
            elif best["label"] == 0:
                own.setdefault(best["id"], int(t))
            else:
                em += 1
                total = sum(c["tau"] * v for c, _, v in near)
                for c, _, v in near:
                    q, gap = c["tau"] * v / total, a - np.array(c["mu"])
                    old = sums.get(c["id"], (0.0, np.zeros(d), np.zeros((d, d))))
                    sums[c["id"]] = (old[0] + q, old[1] + q * a, old[2] + q * np.outer(gap, gap))
        comps = g.em_step(g.adopt(comps, own), sums, em, p.alpha, p.jitter)
        comps = g.create(comps, list(places.items()), p.alpha, p.max_components)
        comps = g.merge_closest(comps, p.merge_below)
        comps = g.split_largest(comps, p.split_above, p.split_share, p.max_components)
        comps = sorted(g.normalize(comps), key=lambda c: c["id"])
        out.append(comps)
    return out


@pytest.mark.parametrize("d,models,limit", [(2, 1, mx.SENT_CELLS), (2, 2, 0), (9, 1, mx.SENT_CELLS), (9, 1, 0)])
def test_loop(spark, monkeypatch, d, models, limit):
    """Both ways of meeting the components, narrow and wide vectors, one and two models."""
    monkeypatch.setattr(mx.Matcher.__init__, "__defaults__", (limit,))
    x, label = clusters(120, d)
    p = MixtureParams(dimension=d, window=30, max_components=6, split_above=4.0)
    versions = GrowingMixture(p).fit(frame(spark, x, label, models)).collect()
    for model in range(models):
        ids = np.arange(len(x)) % models == model
        want = loop(x[ids], label[ids], 30, p)
        got = {r.version: r for r in versions if r.model_id == model}
        for t, comps in enumerate(want):
            have = got[t].comps
            assert [c["id"] for c in comps] == [c["id"] for c in have]
            for a, b in zip(comps, have):
                assert a["label"] == b["label"] and np.isclose(a["tau"], b["tau"])
                assert np.allclose(a["mu"], b["mu"]) and np.allclose(a["sigma"], b["sigma"], atol=1e-9)
                assert np.linalg.eigvalsh(g.full(b["sigma"], d)).min() > 0
            assert np.isclose(sum(c["tau"] for c in have), 1.0)
        assert got[len(want) - 1].n == ids.sum()


def test_learns_clusters_and_scores_waiting_rows(spark):
    x, label = clusters(600)
    hidden = np.where(np.arange(600) % 5 == 4, -1, label)
    learner = GrowingMixture(MixtureParams(dimension=2, window=100, max_components=10, warmup=150))
    rows = frame(spark, x, hidden)
    versions = learner.fit(rows)
    scored = learner.predict(rows, versions).collect()
    assert len(scored) == 120
    assert np.mean([r.prediction == label[r.seq] for r in scored]) > 0.9
    # The version before a row's window of labelled rows, or the first of more than 150 rows.
    assert all(r.version == max((r.seq - r.seq // 5) // 100 - 1, 1) for r in scored)
    cold = learner.predict(rows, versions, warmup=1000).collect()
    assert len(cold) == 120 and {(r.version, r.prediction) for r in cold} == {(None, None)}


def test_model_without_labels_predicts_minus_one(spark):
    x, label = clusters(5)
    state = materialize(GrowingMixture(MixtureParams(dimension=2)).start(frame(spark, x, label)), "start")
    for limit in (mx.SENT_CELLS, 0):
        got = mx.Matcher(state, MixtureParams(dimension=2), limit).predict(frame(spark, x, label))
        assert {r.prediction for r in got.collect()} == {-1.0}


def test_ties_and_far_rows(spark):
    rows = [(0, i, 0.5, 1.0, [0.0, 0.0], [1.0, 0.0, 1.0], i + 1) for i in range(2)]
    comp = spark.createDataFrame(rows, "model_id int, id long, tau double, c double, mu array<double>, sigma array<double>, label int")
    state = materialize(mx.pack_components(comp, 4), "tie")
    points = frame(spark, np.array([[1.0, 0.0], [99.0, 0.0]]), [1, 1])
    for limit in (mx.SENT_CELLS, 0):
        got = {r.seq: (r.situation, r.id) for r in mx.Matcher(state, MixtureParams(dimension=2), limit).match(points).collect()}
        assert got == {0: (3, 0), 1: (2, None)}


def test_too_many_components_is_an_error(spark):
    rows = [(0, i, 0.5, 1.0, [0.0], [1.0], 1) for i in range(5)]
    comp = spark.createDataFrame(rows, "model_id int, id long, tau double, c double, mu array<double>, sigma array<double>, label int")
    with pytest.raises(Exception, match="more than 4 components"):
        mx.pack_components(comp, 4).collect()
    assert mx.unpack_components(mx.pack_components(comp, 5)).count() == 5


def test_merge_and_split_keep_the_moments():
    a, b = g.component(0, 0.3, 2, [0, 0], np.eye(2), 1), g.component(1, 0.3, 3, [0, 0], np.eye(2), 1)
    (m,) = g.merge_closest([a, b], 0.01)
    assert m["tau"] == 0.6 and m["c"] == 5 and np.allclose(g.full(m["sigma"], 2), np.eye(2))
    assert g.merge_closest([a, {**b, "label": 2}], 0.01) == [a, {**b, "label": 2}]
    big = g.component(2, 0.4, 4, [1, 1], np.diag([9.0, 1.0]), 1)
    halves = g.split_largest([big], 1.0, 0.8, 5)
    mean = sum(np.array(h["mu"]) for h in halves) / 2
    spread = sum(g.full(h["sigma"], 2) + np.outer(h["mu"] - mean, h["mu"] - mean) for h in halves) / 2
    assert np.allclose(mean, [1, 1]) and np.allclose(spread, np.diag([9.0, 1.0]))
    assert [h["id"] for h in halves] == [2, 0]


class Taken:
    """Stands for a table: hands over the function that its tasks would run."""

    dtypes = [("model_id", "bigint")]

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def repartition(self, *by):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def mapInPandas(self, run, schema):
        self.run = run
        raise StopIteration


def test_few_models_are_objects_at_a_time(spark):
    batch = pa.RecordBatch.from_pylist([{"model_id": k} for k in range(2 * mx.MODELS + 5)])
    seen = []
    run = mx.per_model(Taken(spark), lambda row: [seen.append(row["model_id"]) or row], "model_id long").run
    done = 0
    for out in run(iter([batch])):
        assert len(seen) - done <= mx.MODELS
        done += len(out)
    assert seen == list(range(len(batch))) and done == len(batch)


def test_statistics_leave_in_few_rows(spark, monkeypatch):
    models = 2 * mx.MODELS + 5
    rows = [(k, 0, 1.0, 1.0, [float(k), 0.0], [1.0, 0.0, 1.0], 1) for k in range(models)]
    components = spark.createDataFrame(rows, "model_id long, id long, tau double, c double, mu array<double>, sigma array<double>, label int")
    matcher = mx.Matcher(mx.pack_components(components, 6), MixtureParams(dimension=2))
    assert matcher.sent
    taken = Taken(spark)
    monkeypatch.setattr(matcher, "_known", lambda rows: taken)
    with pytest.raises(StopIteration):
        matcher.window_stats(taken)
    given = pd.DataFrame({"model_id": range(models), "seq": range(models), "label": 1, "features": [np.array([float(k), 0.5]) for k in range(models)]})
    parts = list(taken.run(iter([given])))
    assert max(map(len, parts)) <= mx.MODELS
    out = pd.concat(parts)
    assert sorted(out["model_id"]) == list(range(models)) and (out["rows"] == 1).all() and np.allclose(out["q"], 1.0)
