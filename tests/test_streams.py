"""Streams against the same rows in one table, replays and late rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelearn.operators.sax import Sax, SaxDictionary, breakpoints
from tidelearn.params import MixtureParams, RidgeParams, SgdParams, SvmParams
from tidelearn.plans.mixture import GrowingMixture
from tidelearn.plans.moment_learners import Ridge
from tidelearn.plans.sgd import SgdRegression
from tidelearn.plans.svm import OnlineSvm
from tidelearn.session import new_path
from tidelearn.streaming.driver import StreamRun
from tidelearn.streaming.event_time import window_models, window_moments
from tidelearn.streaming.exact_windows import exact_windows, open_windows, start_windows
from tidelearn.streaming.store import FAN, ModelStore, model_snapshots
from tidelearn.streaming.window_run import WindowRun

SCHEMA = "seq long, model_id int, label double, features array<double>"


def rows_of(n=200, d=2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = np.sign(x[:, 0] + 0.2 * rng.normal(size=n))
    return [(i, 0, -9.0 if i % 5 == 3 else float(y[i]), [float(v) for v in x[i]]) for i in range(n)]


def files_of(spark, rows, size):
    """One file per window, written one after the other."""
    path = new_path(spark, "stream-in")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


LEARNERS = {
    "ridge": Ridge(RidgeParams(dimension=2, window=40, warmup=50)),
    "svm": OnlineSvm(SvmParams(dimension=2, window=40, step=0.3)),
    "mixture": GrowingMixture(MixtureParams(dimension=2, window=40, sentinel=-9.0, warmup=0)),
    "sgd": SgdRegression(SgdParams(dimension=2, iterations=5, window=50)),
}


@pytest.mark.parametrize("name", sorted(LEARNERS))
def test_stream_equals_table(spark, name):
    rows = rows_of()
    learner = LEARNERS[name]
    run = StreamRun(spark, learner, new_path(spark, f"run-{name}"))
    if name == "sgd":
        rows = [r for r in rows if r[2] != -9.0]
        run.run(files_of(spark, rows, 50))
    else:
        run.run(files_of(spark, rows, 50))
    table = spark.createDataFrame(rows, SCHEMA)
    want = {r.version: r for r in learner.fit(table).collect()}
    got = {r.version: r for r in run.versions().collect()}
    assert sorted(got) == sorted(want)
    for t in want:
        if name == "mixture":
            assert [c.id for c in got[t].comps] == [c.id for c in want[t].comps]
            assert np.allclose([c.mu for c in got[t].comps], [c.mu for c in want[t].comps])
        else:
            assert np.allclose(got[t].weights, want[t].weights)
    if name == "ridge":
        pred = {r.seq: (r.version, r.prediction) for r in run.predictions().collect()}
        same = {r.seq: (r.version, r.prediction) for r in learner.predict(table, learner.fit(table)).collect()}
        assert sorted(pred) == sorted(same) == [i for i in range(200) if i % 5 == 3]
        assert all(pred[i][0] == same[i][0] and np.isclose(pred[i][1], same[i][1]) for i in pred)


def test_replayed_batch_changes_nothing(spark):
    rows = rows_of(100)
    run = StreamRun(spark, LEARNERS["ridge"], new_path(spark, "replay"))
    first, second = spark.createDataFrame(rows[:50], SCHEMA), spark.createDataFrame(rows[50:], SCHEMA)
    for batch, i in ((first, 0), (second, 1), (second, 1)):
        run.handle(batch, i)
    run.finish()
    assert [r.n for r in run.versions().orderBy("version").collect()] == [40, 80]
    assert run.predictions().count() == 20
    assert run.models.before(1).first().version == 0 and run.models.before(0) is None


def test_waiting_rows_stay_until_warm(spark):
    learner = Ridge(RidgeParams(dimension=2, window=50, warmup=10_000))
    run = StreamRun(spark, learner, new_path(spark, "cold"))
    run.run(files_of(spark, rows_of(100), 50))
    assert run.predictions().count() == 0
    assert run.pending.newest().count() == 20


def test_new_model_in_a_later_batch(spark):
    rows = rows_of(40)
    other = [(1000 + i, 1, *r[2:]) for i, r in enumerate(rows)]
    for name in ("svm", "mixture", "sgd"):
        learner = LEARNERS[name]
        run = StreamRun(spark, learner, new_path(spark, f"later-{name}"))
        run.handle(spark.createDataFrame([r for r in rows if r[2] != -9.0], SCHEMA), 0)
        run.handle(spark.createDataFrame([r for r in other if r[2] != -9.0], SCHEMA), 1)
        newest = {r.model_id: r for r in run.models.newest().collect()}
        assert set(newest) == {0, 1} and newest[0].n == newest[1].n == 32


def test_store_ignores_uncommitted_versions(spark):
    store = ModelStore(spark, new_path(spark, "store"))
    assert store.versions() == [] and store.newest() is None and store.all() is None and store.before(3) is None
    store.write(spark.range(3), 2)
    store.write(spark.range(5), 10)
    spark.range(7).write.parquet(store.folder(11))
    assert store.versions() == [2, 10] and store.newest().count() == 5 and store.all().count() == 8
    assert store.vacuum() == 1 and store.all().count() == 8
    again = ModelStore(spark, store.path)
    assert again.newest_number() == 10 and again.before(10).count() == 3 and again.before(2) is None


def test_store_merges_old_versions_and_finds_all(spark):
    store = ModelStore(spark, new_path(spark, "log"))
    calls = []
    for v in range(2 * FAN + 9):
        before = store.calls
        store.write(spark.createDataFrame([(v, v * 10)], "model_id int, n long").coalesce(1), v)
        calls.append(store.calls - before)
    assert len(set(calls[1:])) == 1  # the same number of file calls however many versions there are
    runs, _ = store._runs()
    assert sorted({r.level for r in runs}) == [0, 1] and len(runs) < 2 * FAN
    last = 2 * FAN + 8
    store.write(spark.createDataFrame([(5, -1)], "model_id int, n long"), 5)  # in a merged run
    store.write(spark.createDataFrame([(last, -2)], "model_id int, n long"), last)
    want = {v: v * 10 for v in range(last)} | {5: -1, last: -2}
    assert store.versions() == list(range(last + 1))
    assert {r.version: r.n for r in store.all().collect()} == want
    for v in (0, 4, 5, 6, FAN - 1, FAN, last - 1, last):
        assert [r.n for r in store.read(v).collect()] == [want[v]]
        assert v == 0 or [r.version for r in store.before(v).collect()] == [v - 1]
    assert sorted(r.version for r in store.since(3, 20).collect()) == list(range(3, 21))
    store.vacuum()
    assert {r.version: r.n for r in ModelStore(spark, store.path).all().collect()} == want


def test_snapshots(spark):
    versions = spark.createDataFrame([(0, v, 30 * (v + 1)) for v in range(10)], "model_id int, version long, n long")
    assert [r.version for r in model_snapshots(versions, 100).orderBy("version").collect()] == [3, 6, 9]


def test_exact_windows(spark):
    rows = rows_of(230)
    stream = files_of(spark, rows, 60).withColumn("label", F.nullif("label", F.lit(-9.0)))
    path = new_path(spark, "exact")
    store = ModelStore(spark, path, "batch_id")
    start_windows(exact_windows(stream, 20, 2, 2, by=F.col("seq")), store.write, path + "-c").awaitTermination()
    closed, opened = store.all().collect(), open_windows(spark, path + "-c").collect()
    assert all(r.n == 20 for r in closed) and len({(r.shard, r.window_id) for r in closed}) == len(closed)
    for s in (0, 1):
        x = np.array([r[3] for r in rows if r[0] % 2 == s and r[2] != -9.0])
        mine = [r for r in closed if r.shard == s]
        last = [r for r in opened if r.shard == s]
        assert len(mine) == len(x) // 20 and [r.n for r in last] == [len(x) % 20] and last[0].window_id == len(mine)
        # No row is lost between the closed windows and the open one.
        assert np.isclose(sum(r.xx[0] for r in mine + last), (x[:, 0] ** 2).sum())
        y = np.array([r[2] for r in rows if r[0] % 2 == s and r[2] != -9.0])
        assert np.allclose(sum(np.array(r.xy) for r in mine + last), x.T @ y)


def test_idle_worker_closes_its_window(spark):
    path, rows = new_path(spark, "idle"), [r for r in rows_of(60) if r[2] != -9.0]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    store = ModelStore(spark, path + "-w", "batch_id")
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    query = start_windows(exact_windows(stream, 40, 2, 1, idle=1000), store.write, path + "-c", every="1 second")
    try:
        for _ in range(120):
            got = store.all()
            if got is not None and got.count() == 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted((r.window_id, r.n) for r in store.all().collect()) == [(0, 40), (1, 8)]
    assert open_windows(spark, path + "-c").count() == 0


def pulls(rows, size, warm):
    """Version that serves each unlabelled row: the oldest ``size`` in line at each closing, the rest at the end."""
    line, out, seen, version = [], {}, 0, -1
    for seq, _, label, _ in rows:
        if label == -9.0:
            line.append(seq)
            continue
        seen += 1
        if seen % size == 0:
            version += 1
            if seen > warm:
                out |= dict.fromkeys(line[:size], version)
                line = line[size:]
    last = version + (seen % size > 0)
    return out | dict.fromkeys(line, last)


@pytest.mark.parametrize("cuts", [(0, 200), (0, 33, 150, 160, 200)])
def test_windows_and_pulls_do_not_follow_batches(spark, cuts):
    """Versions equal those of the table, and lines are served alike, for several arrival splits."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, -9.0 if rng.random() < (0.9 if 60 < i < 120 else 0.2) else 1.0 + i % 3, [float(v) for v in rng.normal(size=2)]) for i in range(200)]
    learner = Ridge(RidgeParams(dimension=2, window=12, warmup=20))
    run = WindowRun(spark, learner, new_path(spark, "windows"))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        run.handle(spark.createDataFrame(rows[a:b], SCHEMA), k)
        if k == 1:
            run.handle(spark.createDataFrame(rows[a:b], SCHEMA), k)  # a replay
    run.close()
    want = {r.version: r for r in learner.fit(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = {r.version: r for r in run.versions().collect()}
    assert sorted(got) == sorted(want)
    assert all(got[t].n == want[t].n and np.allclose(got[t].weights, want[t].weights) for t in want)
    served = {r.seq: (r.version, r.prediction) for r in run.predictions().collect()}
    assert {s: v for s, (v, _) in served.items()} == pulls(rows, 12, 20)
    x = {r[0]: np.array(r[3]) for r in rows}
    assert all(np.isclose(p, x[s] @ np.array(want[v].weights)) for s, (v, p) in served.items())


def test_wide_windows_several_models_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    d = 33
    rows = [(i, i % 2, -9.0 if i % 7 == 0 else float(i % 3), [float(v) for v in rng.normal(size=d)]) for i in range(120)]
    bad = [(1000, 0, 1.0, [1.0]), (None, 1, 1.0, rows[0][3])]
    learner = Ridge(RidgeParams(dimension=d, window=25, warmup=10))
    run = WindowRun(spark, learner, new_path(spark, "wide"))
    run.close()
    for k, part in enumerate((rows[:30] + bad, rows[30:90], [], [(r[0], 0, *r[2:]) for r in rows[90:]])):
        run.handle(spark.createDataFrame(part, SCHEMA), k)
    run.close()
    table = spark.createDataFrame(rows[:90] + [(r[0], 0, *r[2:]) for r in rows[90:]], SCHEMA)
    want = {(r.model_id, r.version): r for r in learner.fit(table).collect()}
    got = {(r.model_id, r.version): r for r in run.versions().collect()}
    assert sorted(got) == sorted(want) and all(np.allclose(got[k].weights, want[k].weights) for k in want)
    assert run.rejected.all().count() == 2
    assert run.predictions().count() == sum(r[2] == -9.0 for r in rows)


def test_late_rows_add_to_their_window(spark):
    base = "timestamp'2024-01-01 00:00:00'"
    first = spark.range(10).selectExpr(f"{base} + make_dt_interval(0, cast(id as int)) ts", "0 model_id", "double(id) label", "array(1D, double(id)) features")
    late = spark.range(3).selectExpr(f"{base} + make_dt_interval(0, 0, cast(id as int)) ts", "0 model_id", "1D label", "array(1D, 0D) features")
    path = new_path(spark, "late")
    for part in (first, late):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = ModelStore(spark, path + "-m")
    learner = Ridge(RidgeParams(dimension=2))
    query = (
        window_moments(stream, 2, "6 hours", ["model_id"], late="1 day").writeStream.outputMode("update")
        .foreachBatch(lambda b, i: store.write(window_models(b, learner, ["model_id"]), i))
        .option("checkpointLocation", path + "-c").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r.n for r in store.read(0).orderBy("window").collect()] == [6, 4]
    assert [r.n for r in store.read(1).collect()] == [9]


def test_sax_words_and_classes(spark):
    assert np.allclose(breakpoints(4), [-0.6744897502, 0, 0.6744897502])
    values = [(0, i, float(v)) for i, v in enumerate([0, 0, 10, 10, 0, 0, 10, 10, 3])] + [(1, i, 5.0) for i in range(4)]
    rows = spark.createDataFrame(values, "series int, seq long, value double")
    sax = Sax(2, 2, 4)
    words = sax.transform(rows, sax.fit(rows))
    assert sorted((r.series, r.pos, r.word) for r in words.collect()) == [(0, 0, "ad"), (0, 1, "ad"), (1, 0, "cc")]
    train = spark.createDataFrame([("ad", "up"), ("ad", "up"), ("cc", "flat"), ("bb", "up"), ("bb", "flat")], "word string, class string")
    model = SaxDictionary(2).fit(train)
    assert {r["class"]: r.weight for r in model.filter("weight > 0").collect()} == {"up": 1.0, "flat": 1.0}
    odd = spark.createDataFrame([(2, 0, "zz")], "series int, pos long, word string")
    got = {(r.series, r.win): (r["class"], r.score) for r in SaxDictionary(2).predict(words.unionByName(odd), model).collect()}
    assert got == {(0, 0): ("up", 1.0), (1, 0): ("flat", 1.0), (2, 0): (None, 0.0)}
