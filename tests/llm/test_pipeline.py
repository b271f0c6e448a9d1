"""Decontamination against a brute-force search, and the pipeline stage by stage."""

import os
import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelearn.llm import decontaminate as dc, memory, near_join, quality, rules, words
from tidelearn.session import materialize

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def lower(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + 1 if x == y else 0)
    return row[-1]


def brute(docs, items):
    """Pairs found by comparing every window of 1.5 item lengths with every item."""
    found = set()
    for d, text in docs:
        w = lower(text)
        for i, item in items:
            own = lower(item)
            n, span = len(own), max(12, 3 * len(own) // 2)
            for a in range(0, max(1, len(w) - span + 1), max(1, len(own) // 4)) if n >= dc.LEAST_WORDS else ():
                part = w[a : a + span]
                if len(set(part) & set(own)) < dc.LCS * len(set(own)) * 0.8:
                    continue
                same, answer = lcs(own, part), len(set(own[-5:]) & set(part)) >= dc.ANSWER * len(set(own[-5:]))
                if same >= dc.QUOTE * n or same >= dc.LCS * n and answer:
                    found.add((d, i))
                    break
    return found


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfglm" for b in ("a", "é", "ou") for c in ("n", "rst", "tion", "k", "x", "p")]
    common = ["the", "of", "and", "to", "in", "a"]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(prose(rng.randint(15, 60)))) for k in range(20)]
    docs, kinds = [], {}
    for d in range(240):
        w = prose(rng.randint(20, 400))
        if d % 4 == 0:
            i = rng.randrange(20)
            own = items[i][1].split()
            if d % 8 == 0:  # a paraphrase: some words replaced or left out
                own = [x if rng.random() > 0.12 else rng.choice(vocabulary) for x in own if rng.random() > 0.05]
            at = rng.randrange(len(w))
            w[at:at] = own
            kinds[d, i] = "paraphrase" if d % 8 == 0 else "exact"
        docs.append((d, ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)).title()))
    return docs, items, kinds


def found(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()}


def test_recall_against_brute_force(spark, make, planted):
    docs, items, kinds = planted
    want = brute(docs, items)
    exact = {p for p, k in kinds.items() if k == "exact"}
    assert exact <= want and len(want) >= 0.9 * len(kinds)
    got = found(spark, make(docs), items)
    assert exact <= got
    assert len(got & want) >= 0.9 * len(want) and not {p for p in got if p not in kinds}


def test_given_documents(spark, documents, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    docs = [(r.doc_id, f" {' '.join(lower(r.text))} ") for r in documents.select("doc_id", "text").collect()]
    want = {(d, i) for d, t in docs for i, x in items if f" {' '.join(lower(x))} " in t}
    assert want and {(r.doc_id, r.item_id) for r in dc.leaks(documents, benchmark).collect()} == want


def test_decontamination_edges(spark, make, planted):
    docs, items, _ = planted
    item = items[0][1]
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "w " * 50_000 + item), (5, "x y")] + docs[1:40:2]
    more = items[:3] + [(77, None), (78, ""), (79, "x y"), (None, items[4][1])]
    got = found(spark, make(rows), more)
    assert {(3, 0), (None, 0), (4, 0)} <= got and not {i for _, i in got} & {77, 78, 79}
    assert found(spark, make(rows).where("false"), more) == set()
    assert found(spark, make(rows), [(1, None)]) == set()


def test_long_items(spark, make):
    """Items longer than the largest window are found whole, edited and quoted in part, and nowhere else."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    often = [1 / (k + 3) for k in range(len(vocabulary))]

    def prose(n):
        return rng.choices(vocabulary, often, k=n)

    items = [(k, prose(n)) for k, n in enumerate((500, 513, 903, 1000, 1280, 1281, 2000, 5000))]
    docs, want = [], set()
    for k, own in items:
        edited = [x if rng.random() > 0.1 else rng.choice(vocabulary) for x in own]
        paraphrase = [x if rng.random() > 0.3 else rng.choice(vocabulary) for x in own[:-5]] + own[-5:]
        for way, text in enumerate((own, edited, paraphrase, own[: len(own) // 2], prose(len(own)))):
            docs.append((10 * k + way, " ".join(prose(rng.randint(0, 700)) + text + prose(rng.randint(0, 700)))))
            want |= {(10 * k + way, k)} if way < 3 else set()
    assert found(spark, make(docs), [(k, " ".join(own)) for k, own in items]) == want


@pytest.fixture(scope="module")
def edited():
    """More passages than the latent space is fitted on, items of 6 to 14 words and copies with 30 to 40% other words."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
    total = np.cumsum([1 / (k + 3) for k in range(len(vocabulary))]).tolist()

    def prose(n):
        return rng.choices(vocabulary, cum_weights=total, k=n)

    items = [(k, prose(6 + k % 9)) for k in range(90)]
    docs, exact = [], set()
    for d in range(360):
        i = d % 90
        own, share = items[i][1], (0, 0.3, 0.35, 0.4)[d // 90]
        if share:
            gone = set(rng.sample(range(len(own)), int(share * len(own))))
            own = [rng.choice(vocabulary) if j in gone else x for j, x in enumerate(own)]
        else:
            exact.add((d, i))
        w = prose(rng.randint(30, 120))
        at = rng.randrange(len(w))
        docs.append((d, " ".join(w[:at] + own + w[at:])))
    rest = [(1000 + d, " ".join(prose(3200))) for d in range(340)]
    return docs, rest, [(k, " ".join(x)) for k, x in items], exact


def test_edited_short_items(spark, make, edited):
    docs, rest, items, exact = edited
    assert sum(-(-len(t.split()) // dc.PASSAGE) for _, t in docs + rest) > dc.SAMPLE
    want = brute(docs, items)
    assert exact <= want and len(want) > 200
    assert want <= found(spark, make(docs + rest), items)


def test_items_of_few_words(spark, make):
    docs = [(1, "Here: one two, THREE four five six."), (2, "one two four three five"), (3, "one two"), (4, "three four"), (5, "zero one two three"), (5, "four five six one two three")]
    items = [(3, "one two three"), (4, "two three four five"), (5, "One two-three, four five!"), (6, "six seven eight"), (7, "one two three"), (8, "three four")]
    assert found(spark, make(docs), items) == {(1, 3), (1, 4), (1, 5), (1, 7), (5, 3), (5, 7)}


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 25))] for _ in range(2))
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert dc.common([masks[x] for x in b if x in masks], len(a)) == lcs(a, b)


def test_latent_space_is_the_svd(spark):
    """On a small matrix the randomised factors span the leading singular vectors."""
    rng = np.random.default_rng(2)
    rows = [rng.choice(40, 12, p=np.r_[[0.06] * 10, [0.4 / 30] * 30] / (0.6 + 0.4)).tolist() for _ in range(300)]
    sample = spark.createDataFrame([(r,) for r in rows], "features array<int>").repartition(3)
    weight = np.ones(dc.FEATURES, np.float32)
    space = dc.latent_space(sample, weight, rank=5)
    a = np.zeros((300, 40))
    for k, r in enumerate(rows):
        np.add.at(a[k], r, 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = np.linalg.svd(a, full_matrices=False)[2][:5]
    q = np.linalg.qr(space[:40])[0]
    assert np.linalg.svd(v @ q)[1].min() > 0.95
    assert np.allclose((a @ space[:40]).T @ (a @ space[:40]), np.eye(5), atol=0.02)


def test_space_is_fitted_on_all_passages(spark, make, edited):
    """Coordinates of all passages together are white, which those of a share of them are not."""
    docs = edited[0] + edited[1]
    space = dc.fit(make(docs).repartition(3))
    held, gram, total = np.zeros(dc.FEATURES, int), np.zeros((dc.RANK, dc.RANK)), 0
    for _, text in docs:
        data, bounds = words.utf8(pa.array([text]))
        f = dc._feature(dc._hashed(data, bounds)[0])
        for low in range(0, len(f), dc.PASSAGE):
            own, often = np.unique(f[low : low + dc.PASSAGE], return_counts=True)
            held[own] += 1
            x = often @ space.vectors[own] / np.linalg.norm(often * space.weight[own])
            gram += np.outer(x, x)
            total += 1
    assert total > dc.SAMPLE
    assert np.allclose(space.weight, np.log((1 + total) / np.maximum(held, 1)), atol=1e-4)
    assert np.allclose(gram, np.eye(dc.RANK), atol=0.005)


def test_long_passages_and_empty_ones_in_products():
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((50, 7)).astype(np.float32)
    size = np.array([0, 3, 900, 0, 1, 64, 0])
    bounds = np.append(0, size.cumsum())
    index = rng.integers(0, 50, bounds[-1])
    want = [rows[index[a:b]].sum(0) for a, b in zip(bounds[:-1], bounds[1:])]
    assert np.allclose(dc._sums(dc._with_zero(rows), index, bounds), want, atol=1e-3)
    out = np.ones((20, 7), np.float32)
    dc._add_runs(out, np.arange(19, 12, -1), dc._with_zero(rows), index, bounds)
    assert np.allclose(out[19:12:-1], 1 + np.array(want), atol=1e-3) and (out[:13] == 1).all()
    for n in (1, 63, 64, 65, 300):
        some = rng.standard_normal((n, 7)).astype(np.float32)
        out = np.empty_like(some)
        dc._running(some.copy(), out)
        assert np.allclose(out, some.cumsum(0), atol=1e-4)


def test_stages(spark, sf_dir):
    """Every stage works on what the one before kept, by plain versions of its rule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], sf_dir), "stage"))
    assert all(s.columns == columns for s in steps[:-1])
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]
    model = quality.fit(docs, labels)
    kept = [k for k, t in texts[0].items() if model.score(quality.statistics(pa.array([t])))[0] >= quality.THRESHOLD]
    assert set(texts[1]) == set(kept)
    fine = rules.measure(pa.array(texts[1].values()), rules.Bands()).to_pylist()
    assert set(texts[2]) == {k for k, r in zip(texts[1], fine) if r["in_bands"] and r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]}
    groups = near_join.jaccard_groups(steps[2]).where("doc_id = component_id").collect()
    assert set(texts[3]) == {r.doc_id for r in groups}
    items = [f" {' '.join(lower(r.text))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(texts[4]) == {k for k, t in texts[3].items() if not any(i in f" {' '.join(lower(t))} " for i in items)}
    last = steps[5].collect()
    assert last and {r.doc_id for r in last} <= set(texts[4]) and all(0 < r.taken <= 3 * r.size for r in last)
    by = {r.source: (r.target, 0) for r in last}
    for r in last:
        by[r.source] = (r.target, by[r.source][1] + r.taken)
    assert all(taken == int(target + 1e-9) for target, taken in by.values())


def test_stages_on_edges(spark, make, tmp_path):
    """Empty tables, nulls, repeated rows and clashing names pass through all stages."""
    prose = " ".join(f"word{k} and other{k * 7 % 11}" for k in range(60))
    rows = [(1, None), (2, ""), (None, prose), (3, prose), (3, prose), (4, prose + " end."), (5, "few words")]
    for name, table in (
        ("labels", spark.createDataFrame([(1, 0), (3, 1), (7, None)], "doc_id long, quality int")),
        ("benchmark", spark.createDataFrame([(1, "nothing of this kind is anywhere in these texts")], "item_id long, text string")),
    ):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (make(rows), make(rows).where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, docs, str(tmp_path)), "stage")
            assert out.columns == docs.columns
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where(F.col("taken") <= 0).count() == 0


def test_no_broadcast_outlives_its_stage(spark, sf_dir, monkeypatch):
    """What a stage sends along is destroyed once its table is written, and the setting for batches is put back."""
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(plain(self, value)) or sent[-1])
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (near_join.stage, dc.stage):
        before = len(sent)
        docs = stage(spark, docs, sf_dir)
        assert len(sent) > before and not any(os.path.exists(b._path) for b in sent)
        assert memory._sent == [] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    assert docs.count() > 0


def test_common_words_are_searched_in_few_places_at_a_time():
    """A long text made of the items' own words: memory follows the text and not items times places."""
    rng = random.Random(3)
    vocabulary = [f"word{k}" for k in range(22)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(32)]
    text = " ".join(rng.choice(vocabulary) for _ in range(20_000))
    weight = np.ones(dc.FEATURES, np.float32)
    items = [dc.Item(k, k, dc._hashed(*words.utf8(pa.array([t])))[0], np.zeros(1, np.float32), frozenset()) for k, t in enumerate(texts)]
    h, first = dc._hashed(*words.utf8(pa.array([text])))
    whole = dc.Rare(items, weight)
    want = sorted((i.at, a, b) for _, i, a, b in whole.places(h, first))
    cut = dc.Rare(items, weight)
    before, dc.PLACES = dc.PLACES, 30_000
    try:
        assert sorted((i.at, a, b) for _, i, a, b in cut.places(h, first)) == want and want
    finally:
        dc.PLACES = before
