import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidelearn.llm import near_join, words
from tidelearn.llm.components import components
from tidelearn.llm.near_join import jaccard_groups, keep_one, keep_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows):
    """{row index: (n, component)} by comparing all pairs of rows with ids."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect())


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" if k % 3 else f"é{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 6)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.6:
            own = " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))
            texts.append(f"{own} {passage} {own[::-1]}")
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))))
    return texts


def test_brute_force(make):
    for seed in (1, 2):
        rows = list(enumerate(corpus(seed)))
        assert got(jaccard_groups(make(rows))) == brute(rows)


def test_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(jaccard_groups(documents)) == brute(rows)


def test_edges(make):
    same = "one two three four five six seven eight nine ten"
    long = " ".join(f"w{k % 5003}" for k in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a\tB"), (6, "a b c"), (7, same), (8, same.upper()), (8, same), (None, same), (None, None),
        (9, long), (10, long + " tail"), (11, "x\u00a0y"), (12, "x y"),
    ]
    assert got(jaccard_groups(make(rows))) == brute(rows)
    assert got(jaccard_groups(make(rows).where("false"))) == []


def test_hot_groups(make):
    """Hundreds of copies and of pairwise different near copies; no pair table comes out."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(300, 600):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(w)))
    out = jaccard_groups(make(rows)).collect()
    assert len(out) == 600 and {r.component_id for r in out} == {0}


def test_small_parts_and_copies(make, monkeypatch):
    """Groups dealt out in many parts, parts copied for their queries: the same links."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(90)]]
    for _ in range(150):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + list(enumerate(corpus(7, 60), 1000))
    want = brute(rows)
    assert 1 < len({c for _, d, _, c in want if d < 1000}) < 150
    assert got(jaccard_groups(make(rows))) == want
    monkeypatch.setattr(near_join, "PART_TOKENS", 400)
    monkeypatch.setattr(near_join, "QUERIES_EACH", 3)
    assert got(jaccard_groups(make(rows))) == want
    monkeypatch.setattr(near_join, "ALIKE", 95)
    assert got(jaccard_groups(make(rows))) == want


def test_prefixes_of_linked_sets_meet():
    """Whatever the order, two sets at the threshold share a prefix token."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = words.distinct(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, len(a)))
        b = words.distinct(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            frequent = rng.random(near_join.BUCKETS) < 0.4
            assert np.intersect1d(near_join._prefix(a, frequent, 80), near_join._prefix(b, frequent, 80)).size


def test_keep_one(make):
    same = "one two three four five six seven eight nine ten"
    rows = [(5, same), (7, same.upper()), (7, "other words"), (None, same), (8, ""), (9, None), (11, "alone"), (11, "alone")]
    docs = make(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 5), (False, 8), (False, 9), (False, 11), (True, 0)]
    assert keep_one(docs.where("false")).count() == 0


def test_keep_texts(make):
    """One row of every group of texts stays, also where texts share ids."""
    a, b, c = ("one two three four five six seven eight nine ten", "red green blue black white grey pink brown cyan lime", "alpha beta gamma delta epsilon zeta eta theta iota kappa")
    for rows in (
        [(5, a), (7, a), (5, b), (3, b)],
        [(5, a), (3, a.upper()), (5, c), (5, c), (8, b)],
        [(1, a), (1, b), (1, c), (1, a)],
        [(1, a), (2, b), (2, b.title()), (3, c)],
    ):
        docs = make(rows)
        kept = keep_texts(docs)
        assert kept.columns == docs.columns
        assert sorted(r.text.lower() for r in kept.collect()) == sorted({t for _, t in rows if t.islower()})
    edges = make([(None, a), (None, a), (8, ""), (9, None), (8, None), (4, c), (4, c)])
    assert sorted((r.doc_id or 0, r.text or "") for r in keep_texts(edges).collect()) == [(0, a), (0, a), (4, c), (8, ""), (8, ""), (9, "")]
    assert keep_texts(edges.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3), (3, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r.node, r.component) for r in components(df).collect()} == {(x, find(x)) for x in list(parent)}
    assert components(df.where("false")).count() == 0
    names = components(df.select(F.col("a").cast("string").alias("x"), F.col("b").cast("string").alias("y")), "x", "y")
    assert names.select("component").distinct().count() == len({find(x) for x in parent})


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b c d e f", "", None, "a b c d e", "A B", "ab", "a b", "b a", "é x\u00a0y", "a\x0bb"]
    column = pa.array(["skipped", *texts])[1:]
    data, bounds = words.utf8(column)
    starts, ends, first = words.spans(data[bounds[0] :], bounds - bounds[0])
    raw = data[bounds[0] :].tobytes()
    spelled = [raw[s:e].decode() for s, e in zip(starts, ends)]
    assert [spelled[a:b] for a, b in zip(first, first[1:])] == [WORD.findall(t or "") for t in texts]
    h = words.hashes(data[bounds[0] :], starts, ends)
    assert len({*zip(spelled, h.tolist())}) == len(set(spelled)) == len(set(h.tolist()))
    sets = list(words.shingle_sets(data[bounds[0] :], bounds - bounds[0], 5))
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 1, 1, 1, 1, 1]
    assert sets[4][0] == sets[6][0] == sets[9][0] != sets[7][0] and sets[3][0] in sets[0]
    assert np.array_equal(words.distinct(np.array([3, 1, 3], np.uint64)), [1, 3])
