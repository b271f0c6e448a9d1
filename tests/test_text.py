"""Text forms, files, words and topics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelearn.functions.special import digamma, digamma_np, lgamma_np, log_sum_exp
from tidelearn.functions.vectors import densify
from tidelearn.operators import text as tx, topics as tp
from tidelearn.params import TopicParams
from tidelearn.plans import baselines
from tidelearn.plans.topics import TopicModel
from tidelearn.session import new_path
from tidelearn.sources import sinks, text as src


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_labeled_csv_and_rejects(spark):
    good, bad = src.parse_labeled_csv(lines(spark, "1, 0.5,-2e1", "1,2", "x,1,2", "", "1,2,3,4", "0,,1"), 2)
    assert [(r.label, r.features) for r in good.collect()] == [(1.0, [0.5, -20.0])]
    assert bad.count() == 5


def test_labeled_and_prediction_text(spark):
    text = "LabeledVector(1.0, DenseVector(0.5, -2.0))"
    good, bad = src.parse_labeled_text(lines(spark, text, "LabeledVector(1.0, DenseVector(0.5))", "?"), 2)
    assert good.first() == (1.0, [0.5, -2.0]) and bad.count() == 2
    out = lines(spark, f"Left(({text},3))", "Left((bad,3))", "Right((WeightVector(DenseVector(0.1, 0.2),0.3),40))")
    good, bad = src.parse_prediction_text(out, 2)
    assert good.first() == (1.0, [0.5, -2.0], 3) and bad.count() == 1
    good, bad = src.parse_model_text(out, 2)
    assert good.first() == ([0.1, 0.2], 0.3, 40) and bad.count() == 0
    model = spark.createDataFrame([([0.1, 0.2], 0.3, 40)], "w array<double>, b double, n long")
    assert model.select(src.model_text(F.col("w"), F.col("b"), F.col("n"))).first()[0] == out.collect()[2].value


def test_topic_matrix_is_read_by_column(spark):
    got = src.parse_topic_matrix(lines(spark, "lambda<&%$#,1 2 3 4 5 6,&%$#lambda>,2,3", "noise"))
    cells = {(r.topic, r.word_id): r.weight for r in got.collect()}
    assert cells == {(0, 0): 1, (1, 0): 2, (0, 1): 3, (1, 1): 4, (0, 2): 5, (1, 2): 6}


def test_files_are_numbered_by_line(spark):
    path = new_path(spark, "vocab")
    words = [f"w{i}" for i in range(500)] + ["w7", "w8 "]
    lines(spark, *words).coalesce(1).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        vocab = {r.word: r.word_id for r in src.read_vocabulary(spark, path).collect()}
        docs = {r.doc_id: r.text for r in src.read_documents(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(vocab) == 500 and vocab["w9"] == 9 and vocab["w7"] == 500 and vocab["w8"] == 501
    assert docs == dict(enumerate(words))


def test_sinks_replace(spark):
    path = new_path(spark, "sink")
    df = spark.range(10)
    for _ in range(2):
        sinks.write_batch(df, path, 4)
    sinks.write_batch(df, path, 5)
    assert sinks.read_batches(spark, path).count() == 20
    for _ in range(2):
        sinks.write_text(df.select(F.col("id").cast("string").alias("value")), path + "-t", files=2)
    assert src.read_lines(spark, path + "-t").count() == 10


DOCS = [
    (1, "Rain is good to have. My farmer likes it"), (2, "the the  the\tThe\n cat"), (3, ""), (4, "99 1_000 über x9 a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_words(docs):
    space = {r.doc_id: r.w for r in docs.select("doc_id", tx.space_words(F.col("text")).alias("w")).collect()}
    assert space[2] == ["the", "the", "the\tthe", "cat"] and space[3] == []
    counts = {(r.doc_id, r.word): r.cnt for r in tx.word_counts(docs, tx.word_tokens(F.col("text"))).collect()}
    assert counts[(2, "the")] == 4 and counts[(1, "is")] == 1 and (4, "über") in counts and not [k for k in counts if k[0] == 3]
    words = tx.explode_words(docs, tx.word_tokens(F.col("text")), [])
    assert {r.word for r in tx.clean_words(words.filter("word in ('99', '1_000', 'über', 'a', 'x9')")).collect()} == {"über"}
    assert tx.drop_stop_words(tx.corpus_counts(docs, tx.word_tokens(F.col("text")))).filter("word = 'the'").count() == 0


def test_vocabulary_steps(spark, docs):
    vocab = spark.createDataFrame([("the", 5), ("cat", 2), ("good", 0)], "word string, word_id long")
    words = tx.space_words(F.col("text"))
    got = {(r.doc_id, r.word_id): r.cnt for r in tx.encode(tx.word_counts(docs, words), vocab).collect()}
    assert got == {(1, 0): 1, (2, 5): 2, (2, 2): 1}
    assert {r.doc_id for r in tx.known_documents(docs, words, vocab).collect()} == {1, 2}
    assert {r.doc_id for r in tx.empty_documents(docs, words, vocab).collect()} == {3, 4}
    numbered = tx.number_words(tx.explode_words(docs, tx.word_tokens(F.col("text")), [])).orderBy("word_id").collect()
    assert [r.word_id for r in numbered] == list(range(len(numbered))) and [r.word for r in numbered] == sorted(r.word for r in numbered)


def test_tfidf_has_unit_rows(spark, docs):
    counts = tx.word_counts(docs, tx.word_tokens(F.col("text")))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    words = tx.vocabulary_by_df(counts, total, least=1, share=1.0, top=5)
    assert words.count() == 5
    norms = tx.tfidf(counts, words, total).groupBy("doc_id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("s")).collect()
    assert norms and all(math.isclose(r.s, 1.0) for r in norms)


def test_special_functions(spark):
    x = np.array([0.01, 0.5, 1.0, 3.0, 50.0])
    assert np.allclose(lgamma_np(x), [math.lgamma(v) for v in x], atol=1e-9)
    assert np.isclose(digamma_np(np.array(1.0)), -0.5772156649, atol=2e-9)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert np.allclose([r[0] for r in df.select(digamma(F.col("x"))).collect()], digamma_np(x))
    got = spark.range(1).select(log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0]
    assert math.isclose(got, 1000 + math.log(2))
    dense = spark.range(1).select(densify(3, F.array(F.lit(2)), F.array(F.lit(4.0)))).first()[0]
    assert dense == [0.0, 0.0, 4.0]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    topics = rng.dirichlet(np.full(30, 0.1), size=3)
    rows = []
    for doc in range(60):
        words = rng.choice(30, size=40, p=topics[doc % 3])
        rows += [(doc, int(w), int(c)) for w, c in zip(*np.unique(words, return_counts=True))]
    counts = spark.createDataFrame(rows, "doc_id long, word_id long, cnt long")
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(30)], "word string, word_id long")
    return counts, vocab


def dense(df, value, shape, row, col):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[row], r[col]] = r[value]
    return out


def e_step_numpy(counts, lam, p):
    """One document at a time."""
    logs = digamma_np(lam) - digamma_np(lam.sum(axis=1))[:, None]
    k = lam.shape[0]
    gammas, sstats = {}, np.zeros_like(lam)
    for doc in {r.doc_id for r in counts}:
        ids = np.array([r.word_id for r in counts if r.doc_id == doc])
        cnt = np.array([r.cnt for r in counts if r.doc_id == doc], dtype=float)
        gamma = np.full(k, p.alpha + cnt.sum() / k)

        def phi():
            z = np.exp(digamma_np(gamma) - digamma_np(gamma.sum()))[:, None] * np.exp(logs[:, ids])
            return z / z.sum(axis=0)

        for _ in range(p.passes):
            new = p.alpha + (phi() * cnt).sum(axis=1)
            moved, gamma = np.abs(new - gamma).mean(), new
            if moved <= p.tolerance:
                break
        gammas[doc] = gamma
        np.add.at(sstats.T, ids, (phi() * cnt).T)
    return gammas, sstats


@pytest.mark.parametrize("limit", [tp.SENT_CELLS, 0])
def test_e_step_both_ways(spark, corpus, limit):
    counts, vocab = corpus
    p = TopicParams(topics=3, passes=4, tolerance=0.5)
    model = TopicModel(p)
    topics = model.start(vocab)
    lam = dense(topics, "weight", (3, 30), "topic", "word_id")
    gammas, sstats = e_step_numpy(counts.collect(), lam, p)
    step = tp.EStep(topics, p.alpha, p.passes, p.tolerance, limit)
    assert step.sent == (limit > 0)
    got = dense(step.gamma(counts), "gamma", (60, 3), "doc_id", "topic")
    assert np.allclose(got, np.stack([gammas[i] for i in range(60)]))
    assert np.allclose(dense(step.sstats(counts), "s", (3, 30), "topic", "word_id"), sstats)
    want = tp.EStep(topics, p.alpha, p.passes, p.tolerance).document_bound(counts).agg(F.sum("bound")).first()[0]
    assert math.isclose(step.document_bound(counts).agg(F.sum("bound")).first()[0], want, rel_tol=1e-9)


@pytest.mark.parametrize("limit", [tp.SENT_CELLS, 0])
def test_unknown_words_and_tiny_priors(spark, corpus, limit):
    """Documents without known words keep alpha; products below the range of doubles do not become nulls."""
    counts, _ = corpus
    p = TopicParams(topics=3, alpha=0.0005, eta=0.0005)
    cells = [(k, w, 5.0 if w % 3 == k else p.eta) for k in range(3) for w in range(30)]
    topics = spark.createDataFrame(cells, "topic int, word_id long, weight double")
    more = counts.select("doc_id", F.col("word_id").cast("long"), F.col("cnt").cast("long")).union(spark.createDataFrame([(900, 77, 3), (901, 78, 1)], "doc_id long, word_id long, cnt long"))
    step = tp.EStep(topics, p.alpha, p.passes, p.tolerance, limit)
    got = {(r.doc_id, r.topic): r.gamma for r in step.gamma(more).collect()}
    assert len({d for d, _ in got}) == 62 and got[(900, 0)] == pytest.approx(p.alpha)
    assert all(v is not None and math.isfinite(v) for v in got.values())
    bounds = {r.doc_id: r.bound for r in step.document_bound(more).collect()}
    assert len(bounds) == 62 and all(math.isfinite(b) for b in bounds.values())
    assert all(math.isfinite(r.s) for r in step.sstats(more).collect())


def test_topic_fit_and_bound(spark, corpus):
    counts, vocab = corpus
    p = TopicParams(topics=3, documents=60, offset=1.0)
    model = TopicModel(p)
    lam = dense(model.start(vocab), "weight", (3, 30), "topic", "word_id")
    versions = model.fit(counts, vocab, 20)
    rows = counts.collect()
    for t in range(3):
        batch = [r for r in rows if r.doc_id // 20 == t]
        sstats = e_step_numpy(batch, lam, p)[1]
        rate = (1.0 + t + 1) ** -0.7
        lam = (1 - rate) * lam + rate * (0.01 + 60 / 20 * sstats)
        got = dense(versions.filter(F.col("version") == t), "weight", (3, 30), "topic", "word_id")
        assert np.allclose(got, lam)
    newest = versions.filter("version = 2").select("topic", "word_id", "weight")
    first = model.start(vocab)
    assert model.bound(counts, newest).first()[0] > model.bound(counts, first).first()[0]
    bounds = [TopicModel(TopicParams(topics=3, passes=i, tolerance=0.0)).bound(counts, newest).first()[0] for i in (1, 2, 5)]
    assert bounds == sorted(bounds)
    main = model.predict(counts, newest).groupBy("doc_id").agg(F.max_by("topic", "gamma").alias("k")).collect()
    groups = [{r.k for r in main if r.doc_id % 3 == j} for j in range(3)]
    assert all(len(s) == 1 for s in groups)
    shares = tx.top_words(newest.withColumnRenamed("word_id", "word"), 30).groupBy("topic").agg(F.sum("share").alias("s"))
    assert all(math.isclose(r.s, 1.0) for r in shares.collect())


def test_matrix_factors_lower_the_loss(spark, corpus):
    counts, vocab = corpus
    rows = counts.join(vocab, "word_id").select("doc_id", "word", F.col("cnt").cast("double").alias("tfidf"))
    words = [f"w{i}" for i in range(30)]
    x = dense(counts, "cnt", (60, 30), "doc_id", "word_id")

    def loss(passes):
        out = baselines.batch_nmf(rows, words, topics=3, passes=passes, alpha=0.0).collect()
        h = np.zeros((3, 30))
        for r in out:
            h[r.topic, words.index(r.word)] = r.weight
        assert (h >= 0).all()
        w = baselines._refine(np.full((60, 3), 0.1), x @ h.T, h @ h.T, 0.0, 0.0, 200)
        return ((x - w @ h) ** 2).sum()

    assert loss(15) < 0.7 * loss(0)
