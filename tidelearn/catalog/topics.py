"""Queries on the topic model, symbolic words and batch baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelearn.catalog.fixtures import ORD, SENTINEL, ord_rows
from tidelearn.catalog.registry import register, spread_table, table
from tidelearn.catalog.rows import rounded
from tidelearn.catalog.words import SPACE, STOP, VOCAB, documents, doc_total, space_counts, token_counts, vocabulary
from tidelearn.operators import text as tx, topics as tp
from tidelearn.operators.routing import unlabel
from tidelearn.operators.sax import Sax, SaxDictionary, breakpoints, majority_class
from tidelearn.params import TopicParams
from tidelearn.plans import baselines
from tidelearn.plans.learner import Chain
from tidelearn.plans.topics import TopicModel
from tidelearn.session import materialize

LANGS = ["de", "en", "es", "fr"]
PARAMS = TopicParams(topics=4)


def psi(x: str) -> str:
    """The same digamma series as SQL text."""
    z = f"({x} + 6e0)"
    shift = " + ".join(f"1e0 / ({x} + {i}e0)" for i in range(6))
    return (f"(ln({z}) - 0.5e0 / {z} - 1e0 / (12e0 * {z} ** 2) + 1e0 / (120e0 * {z} ** 4) - 1e0 / (252e0 * {z} ** 6) - ({shift}))")


def lang_topics(spark, sf, vocab):
    """Topics from the word counts of each language: ``eta`` plus the count."""
    docs = spread_table(spark, sf, "documents", "lang", "text")
    words = tx.explode_words(docs, tx.space_words(F.col("text")), ["lang"])
    counts = words.groupBy("word").agg(*[F.count_if(F.col("lang") == k).alias(f"n_{k}") for k in LANGS])
    cells = vocab.join(counts, "word", "left").select(
        "word_id", F.posexplode(F.array(*[0.01 + F.coalesce(f"n_{k}", F.lit(0)) for k in LANGS])).alias("topic", "weight")
    )
    return cells.select("topic", "word_id", "weight")


def topic_inputs(spark, sf):
    """Vocabulary, word counts and language topics, written once and read by every pass."""
    vocab = materialize(vocabulary(spark, sf), "vocabulary")
    counts = materialize(tx.encode(space_counts(spark, sf), vocab), "counts")
    return vocab, counts, materialize(lang_topics(spark, sf, vocab), "topics")


TOPICS = f"""
{SPACE}, {VOCAB},
counts AS MATERIALIZED (SELECT doc_id, word_id, count(*) AS cnt FROM sw JOIN vocab USING (word) GROUP BY 1, 2),
freq AS (SELECT lang, word, count(*) AS n FROM sw JOIN documents USING (doc_id) GROUP BY 1, 2),
topics AS MATERIALIZED (
  SELECT k AS topic, word_id, 0.01e0 + coalesce(n, 0) AS weight
  FROM vocab CROSS JOIN generate_series(0, 3) t(k)
  LEFT JOIN freq ON freq.word = vocab.word AND freq.lang = (['de', 'en', 'es', 'fr'])[k + 1]),
logs AS MATERIALIZED (
  SELECT topic, word_id, {psi('weight')} - {psi('total')} AS lb
  FROM (SELECT *, sum(weight) OVER (PARTITION BY topic) AS total FROM topics))"""


def _passes(passes: int) -> str:
    """The E-step, one table per pass; a document that has settled keeps its weights."""
    out = ["""
g0 AS (
  SELECT doc_id, topic, 0.01e0 + len / 4e0 AS g, TRUE AS live
  FROM (SELECT doc_id, CAST(sum(cnt) AS DOUBLE) AS len FROM counts GROUP BY 1) CROSS JOIN generate_series(0, 3) t(topic))"""]
    for i in range(passes + 1):
        out.append(f"""
p{i} AS MATERIALIZED (
  SELECT doc_id, word_id, topic, cnt, z, z / sum(z) OVER (PARTITION BY doc_id, word_id) AS phi
  FROM (SELECT c.doc_id, c.word_id, t.topic, c.cnt, exp(lt + lb) AS z
        FROM counts c
        JOIN (SELECT doc_id, topic, {psi('g')} - {psi('total')} AS lt
              FROM (SELECT *, sum(g) OVER (PARTITION BY doc_id) AS total FROM g{i})) t ON t.doc_id = c.doc_id
        JOIN logs l ON l.word_id = c.word_id AND l.topic = t.topic))""")
        if i < passes:
            out.append(f"""
g{i + 1} AS MATERIALIZED (
  SELECT doc_id, topic, CASE WHEN live THEN new ELSE g END AS g,
         live AND avg(abs(new - g)) OVER (PARTITION BY doc_id) > 0.001e0 AS live
  FROM g{i} JOIN (SELECT doc_id, topic, 0.01e0 + sum(cnt * phi) AS new FROM p{i} GROUP BY 1, 2) USING (doc_id, topic))""")
    return ",".join(out)


ESTEP = f"{TOPICS}, {_passes(5)}"


@register("dirichlet_expectation", f"""
WITH tok AS (SELECT lang AS topic, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
w AS (SELECT topic, word, 0.01e0 + count(*) AS weight FROM tok GROUP BY 1, 2)
SELECT topic, word, round({psi('weight')} - {psi('total')}, 6) AS e
FROM (SELECT *, sum(weight) OVER (PARTITION BY topic) AS total FROM w)""")
def dirichlet_expectation(spark, sf):
    docs = spread_table(spark, sf, "documents", "lang", "text").withColumnRenamed("lang", "topic")
    words = tx.explode_words(docs, tx.word_tokens(F.col("text")), ["topic"])
    weights = words.groupBy("topic", "word").agg((0.01 + F.count(F.lit(1))).alias("weight"))
    return tp.dirichlet_expectation(weights, ["topic"]).select("topic", "word", F.round("e", 6).alias("e"))


@register("lda_estep", f"WITH {ESTEP} SELECT doc_id, CAST(topic AS INTEGER) AS topic, round(g, 5) AS gamma FROM g5")
def lda_estep(spark, sf):
    _, counts, topics = topic_inputs(spark, sf)
    return rounded(TopicModel(PARAMS).predict(counts, topics), 5, "gamma")


@register("lda_sstats", f"""
WITH {ESTEP} SELECT CAST(topic AS INTEGER) AS topic, word_id, round(sum(cnt * phi), 4) AS s FROM p5 GROUP BY 1, 2""")
def lda_sstats(spark, sf):
    _, counts, topics = topic_inputs(spark, sf)
    return rounded(TopicModel(PARAMS).e_step(topics).sstats(counts), 4, "s")


RATE = (50.0 + 1) ** (-0.7)


@register("lda_update", f"""
WITH {ESTEP}, s AS (SELECT topic, word_id, sum(cnt * phi) AS s FROM p5 GROUP BY 1, 2)
SELECT CAST(topic AS INTEGER) AS topic, word_id,
       round((1 - {RATE!r}) * weight + {RATE!r} * (0.01e0 + coalesce(s, 0)), 4) AS weight
FROM topics LEFT JOIN s USING (topic, word_id)""")
def lda_update(spark, sf):
    """One window: all documents update the language topics once."""
    _, counts, topics = topic_inputs(spark, sf)
    return rounded(TopicModel(PARAMS).update_topics(counts, topics, 0), 4, "weight")


@register("lda_bound", f"""
WITH {ESTEP},
lik AS (SELECT sum(cnt * l) AS v FROM (SELECT doc_id, word_id, any_value(cnt) AS cnt, ln(sum(z)) AS l FROM p5 GROUP BY 1, 2)),
th AS (SELECT *, {psi('g')} - {psi('total')} AS lt FROM (SELECT *, sum(g) OVER (PARTITION BY doc_id) AS total FROM g5)),
doc AS (SELECT sum((0.01e0 - g) * lt + lgamma(g) - lgamma(0.01e0)) AS v FROM th),
docn AS (SELECT sum(lgamma(0.04e0) - lgamma(total)) AS v FROM (SELECT DISTINCT doc_id, total FROM th)),
top AS (SELECT sum((0.01e0 - weight) * lb + lgamma(weight) - lgamma(0.01e0)) AS v FROM topics JOIN logs USING (topic, word_id)),
topn AS (SELECT sum(lgamma(v * 0.01e0) - lgamma(total)) AS v FROM (SELECT topic, count(*) AS v, sum(weight) AS total FROM topics GROUP BY 1))
SELECT round((lik.v + doc.v + docn.v + top.v + topn.v) / 1000, 4) AS bound_k FROM lik, doc, docn, top, topn""")
def lda_bound(spark, sf):
    """The bound in thousands."""
    _, counts, topics = topic_inputs(spark, sf)
    return TopicModel(PARAMS).bound(counts, topics).select(F.round(F.col("bound") / 1000, 4).alias("bound_k"))


@register("lda_fit")
def lda_fit(spark, sf):
    vocab = materialize(vocabulary(spark, sf), "vocabulary")
    versions = TopicModel(PARAMS).fit(tx.encode(space_counts(spark, sf), vocab), vocab, 1000)
    return versions.select("version", "topic", "word_id", F.round("weight", 6).alias("weight"))


# Symbolic words of each user's event values.
SERIES = """
ser AS (SELECT user_id AS series, event_id AS seq, value, event_type, ts FROM events)"""


def series(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("series"), F.col("event_id").alias("seq"), "value", "event_type", "ts"
    )


def _letter_sql(z: str, alphabet: int) -> str:
    cuts = breakpoints(alphabet)
    whens = " ".join(f"WHEN {z} < {c!r} THEN '{chr(97 + i)}'" for i, c in enumerate(cuts))
    return f"CASE {whens} ELSE '{chr(97 + alphabet - 1)}' END"


def words_sql(name: str, where: str, fit_where: str, f: int = 2, w: int = 3, alphabet: int = 6) -> str:
    letters = " || ".join(_letter_sql(f"coalesce((f{i} - mean) / nullif(scale, 0), 0)", alphabet) for i in range(w))
    slots = ", ".join(f"avg(value) FILTER ((place // {f}) % {w} = {i}) AS f{i}" for i in range(w))
    return f"""
{name} AS (
  SELECT series, pos, {letters} AS word
  FROM (SELECT series, place // {f * w} AS pos, count(*) AS n, {slots}
        FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY seq) - 1 AS place FROM ser {where})
        GROUP BY 1, 2) p
  JOIN (SELECT series, avg(value) AS mean, stddev_pop(value) AS scale FROM ser {fit_where} GROUP BY 1) m USING (series)
  WHERE n = {f * w})"""


def _classes_sql(where: str) -> str:
    return f"""
cls AS (
  SELECT series, event_type AS class FROM (
    SELECT series, event_type, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, event_type) AS r
    FROM ser {where} GROUP BY 1, 2) WHERE r = 1)"""


def _dictionary_sql(words: str, number: int) -> str:
    return f"""
cnt AS (SELECT word, class, count(*) AS n FROM {words} JOIN cls USING (series) GROUP BY 1, 2),
wt AS (SELECT word, class, (1 + ln(n)) * ln((SELECT count(DISTINCT class) FROM cnt) / CAST(count(*) OVER (PARTITION BY word) AS DOUBLE)) AS w FROM cnt),
dic AS (SELECT word, class, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY class)), 0) AS weight FROM wt),
wc AS (SELECT series, CAST(pos // {number} AS BIGINT) AS win, word, count(*) AS n FROM ev_words GROUP BY 1, 2, 3),
nm AS (SELECT *, sqrt(CAST(sum(n * n) OVER (PARTITION BY series, win) AS DOUBLE)) AS norm FROM wc),
sc AS (SELECT series, win, class, sum(n / norm * weight) AS score FROM nm JOIN dic USING (word) WHERE weight > 0 GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY series, win ORDER BY score DESC, class) AS r FROM sc),
res AS (
  SELECT k.series AS user_id, k.win, best.class, round(coalesce(best.score, 0), 6) AS score
  FROM (SELECT DISTINCT series, win FROM wc) k LEFT JOIN best ON best.series = k.series AND best.win = k.win AND r = 1)"""


@register("sax_words", f"""
WITH {SERIES}, {words_sql('words', '', '')} SELECT series AS user_id, CAST(pos AS BIGINT) AS pos, word FROM words""")
def sax_words(spark, sf):
    rows, sax = series(spark, sf), Sax(2, 3, 6)
    return sax.transform(rows, sax.fit(rows)).select(F.col("series").alias("user_id"), "pos", "word")


def _result(df):
    return df.select(F.col("series").alias("user_id"), "win", "class", F.round("score", 6).alias("score"))


@register("sax_classify", f"""
WITH {SERIES}, {words_sql('ev_words', '', '')}, {_classes_sql('')}, {_dictionary_sql('ev_words', 3)} SELECT * FROM res""")
def sax_classify(spark, sf):
    rows, sax, dictionary = series(spark, sf), Sax(2, 3, 6), SaxDictionary(3)
    words = materialize(sax.transform(rows, sax.fit(rows)), "words")
    model = dictionary.fit(words.join(majority_class(rows, "series", "event_type"), "series"))
    return _result(dictionary.predict(words, model))


HALF = "TIMESTAMP '2024-01-16 00:00:00'"


@register("sax_chain", f"""
WITH {SERIES}, {words_sql('tr_words', f'WHERE ts < {HALF}', f'WHERE ts < {HALF}')},
{words_sql('ev_words', f'WHERE ts >= {HALF}', f'WHERE ts < {HALF}')}, {_classes_sql(f'WHERE ts < {HALF}')},
{_dictionary_sql('tr_words', 3)} SELECT * FROM res""")
def sax_chain(spark, sf):
    """Fit on the first half of the month, classify the second half."""
    rows, sax, dictionary = series(spark, sf), Sax(2, 3, 6), SaxDictionary(3)
    early = rows.filter("ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    late = rows.filter("ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    scale = sax.fit(early)
    train = sax.transform(early, scale).join(majority_class(early, "series", "event_type"), "series")
    return _result(Chain([sax, dictionary]).predict(late, [scale, dictionary.fit(train)]))


# Batch baselines on the labelled orders.
LABELLED = f"""
WITH {ORD}, m AS (
  SELECT sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * y) AS r1, sum(x2 * y) AS r2
  FROM ord WHERE y IS NOT NULL)"""


def labelled(spark, sf):
    return unlabel(ord_rows(spark, sf), SENTINEL).filter("label is not null")


def _coef(df, digits=5):
    w = F.col("weights")
    return df.select(F.round(w[0], digits).alias("w1"), F.round(w[1], digits).alias("w2"), F.round("intercept", digits).alias("b"))


@register("batch_ridge", f"""{LABELLED}
SELECT round((r1 * (a22 + 1) - a12 * r2) / ((a11 + 1) * (a22 + 1) - a12 * a12), 5) AS w1,
       round(((a11 + 1) * r2 - a12 * r1) / ((a11 + 1) * (a22 + 1) - a12 * a12), 5) AS w2, 0e0 AS b FROM m""")
def batch_ridge(spark, sf):
    return _coef(baselines.linear_regression(labelled(spark, sf), 1.0, l1=False))


@register("batch_least_squares", f"""{LABELLED}
SELECT round((r1 * a22 - a12 * r2) / (a11 * a22 - a12 * a12), 5) AS w1,
       round((a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12), 5) AS w2, 0e0 AS b FROM m""")
def batch_least_squares(spark, sf):
    return _coef(baselines.linear_regression(labelled(spark, sf), 0.0, l1=False))


# With both weights positive the lasso solves G w = r - lambda.
@register("batch_lasso", f"""{LABELLED}
SELECT round(((r1 - 20) * a22 - a12 * (r2 - 20)) / (a11 * a22 - a12 * a12), 4) AS w1,
       round((a11 * (r2 - 20) - a12 * (r1 - 20)) / (a11 * a22 - a12 * a12), 4) AS w2, 0e0 AS b FROM m""")
def batch_lasso(spark, sf):
    return _coef(baselines.linear_regression(labelled(spark, sf), 20.0, l1=True), 4)


@register("batch_linear_svc")
def batch_linear_svc(spark, sf):
    return _coef(baselines.linear_svc(labelled(spark, sf)), 4)


def frequent(counts, total):
    """The bounded vocabulary (at most 1,000 words) by document frequency, from counts that are written."""
    return [r["word"] for r in tx.vocabulary_by_df(counts, total).orderBy("word").select("word").collect()]


@register("batch_lda")
def batch_lda(spark, sf):
    counts = token_counts(spark, sf, STOP)
    # At most 1,000 words.
    vocab = spark.createDataFrame(list(enumerate(frequent(counts, doc_total(spark, sf)))), "word_id int, word string")
    topics = baselines.batch_lda(tx.encode(counts, vocab), vocab)
    return rounded(tx.top_words(topics, 20), 6, "share")


@register("batch_nmf")
def batch_nmf(spark, sf):
    counts, total = token_counts(spark, sf, STOP), doc_total(spark, sf)
    words = materialize(tx.vocabulary_by_df(counts, total), "frequent-words")
    vocab = [r["word"] for r in words.orderBy("word").collect()]
    topics = baselines.batch_nmf(tx.tfidf(counts, words, total), vocab)
    return rounded(tx.top_words(topics, 20), 6, "share")
