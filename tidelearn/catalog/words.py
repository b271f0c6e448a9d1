"""Queries on documents, vocabularies and word reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelearn.catalog.registry import register, spread_table, table
from tidelearn.catalog.rows import rounded
from tidelearn.operators import text as tx
from tidelearn.operators.routing import sample_with_replacement
from tidelearn.session import materialize
from tidelearn.sources import text as src

# Blank characters around a word, and word characters, in SQL.
BLANKS = "chr(32) || chr(9) || chr(13) || chr(10)"
SPACE = f"""
sw AS (
  SELECT doc_id, word FROM (
    SELECT doc_id, trim(unnest(string_split(lower(text), ' ')), {BLANKS}) AS word FROM documents) WHERE word <> '')"""
TOKENS = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents)"""
# The benchmark passages, word by word, stand for a vocabulary file with one word per line.
VOCAB = f"""
lines AS (
  SELECT item_id, pos, trim(word, {BLANKS}) AS word FROM (
    SELECT item_id, unnest(string_split(lower(text), ' ')) AS word,
           generate_subscripts(string_split(lower(text), ' '), 1) AS pos FROM benchmark)),
numbered AS (SELECT word, CAST(row_number() OVER (ORDER BY item_id, pos) - 1 AS BIGINT) AS word_id FROM lines),
vocab AS (SELECT word, max(word_id) AS word_id FROM numbered WHERE word <> '' GROUP BY word)"""


def documents(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "text")


def vocabulary(spark, sf):
    """Ids by line number; blank lines take a number but are no words."""
    lines = table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(F.split(F.lower("text"), " ")).alias("_at", "_line")
    )
    numbered = src.number_lines(lines, ["item_id"], "_at", "word_id")
    words = numbered.select(F.btrim("_line", F.lit(tx.BLANKS)).alias("word"), "word_id").filter("word <> ''")
    return src.vocabulary(words)


def space_counts(spark, sf):
    return tx.word_counts(documents(spark, sf), tx.space_words(F.col("text")))


def doc_total(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_docs"))


@register("doc_source", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY 1""")
def doc_source(spark, sf):
    """Documents as one line each, written as text with their id and read back.

    Line ends inside a document become Unicode line separators in the file.
    """
    from tidelearn.session import new_path
    from tidelearn.sources.sinks import write_text

    path = new_path(spark, "documents")
    lines = table(spark, sf, "documents").select(
        F.concat_ws("\t", F.col("doc_id").cast("string"), F.translate("text", "\n\r", "\u2028\u2029")).alias("value")
    )
    write_text(lines, path)
    back = src.read_lines(spark, path).select(
        F.substring_index("value", "\t", 1).cast("long").alias("doc_id"),
        F.expr("substring(value, locate('\t', value) + 1)").alias("text"),
    )
    pieces = F.split("text", "\u2028")
    return back.select(
        "doc_id",
        F.size(pieces).cast("long").alias("n_lines"),
        F.aggregate(pieces, F.lit(0).cast("long"), lambda s, p: s + F.length(p)).alias("n_chars"),
    )


@register("vocab_index", f"WITH {VOCAB} SELECT word, word_id FROM vocab")
def vocab_index(spark, sf):
    return vocabulary(spark, sf)


@register("dictionary", f"""
WITH {TOKENS} SELECT word, CAST(row_number() OVER (ORDER BY encode(word)) - 1 AS BIGINT) AS word_id
FROM (SELECT DISTINCT word FROM tok)""")
def dictionary(spark, sf):
    return tx.number_words(tx.explode_words(documents(spark, sf), tx.word_tokens(F.col("text")), []))


@register("tokens", f"WITH {TOKENS} SELECT word, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY 1")
def tokens(spark, sf):
    return tx.corpus_counts(documents(spark, sf), tx.word_tokens(F.col("text")))


# A short list of English function words for this query; fixed values.
STOP = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "have", "he", "her", "his", "i",
        "in", "is", "it", "not", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "were", "with", "you"]


@register("stopped_tokens", f"""
WITH {TOKENS} SELECT word, CAST(count(*) AS BIGINT) AS n FROM tok
WHERE word NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY 1""")
def stopped_tokens(spark, sf):
    return tx.drop_stop_words(tokens(spark, sf), STOP)


@register("clean_vocab", f"""
WITH {TOKENS} SELECT DISTINCT word FROM tok
WHERE length(word) > 2 AND NOT regexp_matches(word, '^\\p{{Nd}}+(_\\p{{Nd}}+)*$')""")
def clean_vocab(spark, sf):
    return tx.clean_words(tx.explode_words(documents(spark, sf), tx.word_tokens(F.col("text")), []))


@register("doc_term_counts", f"""
WITH {SPACE}, {VOCAB}
SELECT doc_id, word_id, CAST(count(*) AS BIGINT) AS cnt FROM sw JOIN vocab USING (word) GROUP BY 1, 2""")
def doc_term_counts(spark, sf):
    return tx.encode(space_counts(spark, sf), vocabulary(spark, sf))


@register("oov_terms", f"""
WITH {SPACE}, {VOCAB}
SELECT word, CAST(count(*) AS BIGINT) AS n FROM sw WHERE word NOT IN (SELECT word FROM vocab) GROUP BY 1""")
def oov_terms(spark, sf):
    corpus = tx.corpus_counts(documents(spark, sf), tx.space_words(F.col("text")))
    return tx.unknown_words(corpus, vocabulary(spark, sf))


@register("docs_with_vocab", f"WITH {SPACE}, {VOCAB} SELECT DISTINCT doc_id FROM sw JOIN vocab USING (word)")
def docs_with_vocab(spark, sf):
    return tx.known_documents(documents(spark, sf), tx.space_words(F.col("text")), vocabulary(spark, sf))


@register("empty_docs", f"""
WITH {SPACE}, {VOCAB}
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sw JOIN vocab USING (word))""")
def empty_docs(spark, sf):
    found = tx.empty_documents(documents(spark, sf), tx.space_words(F.col("text")), vocabulary(spark, sf))
    return found.select("doc_id")


BY_DF = f"""
{TOKENS},
counts AS (SELECT doc_id, word, count(*) AS cnt FROM tok GROUP BY 1, 2),
total AS (SELECT count(*) AS n_docs FROM documents),
kept AS (
  SELECT word, count(*) AS df, CAST(sum(cnt) AS BIGINT) AS tf FROM counts GROUP BY word
  HAVING count(*) >= 2 AND count(*) <= 0.95e0 * (SELECT n_docs FROM total)
  ORDER BY tf DESC, encode(word) LIMIT 1000)"""


def token_counts(spark, sf, stop=()):
    """Words of each document, but for ``stop``; texts are cut once, the counts are written for those who need them twice."""
    counts = tx.word_counts(documents(spark, sf), tx.word_tokens(F.col("text")))
    return materialize(tx.drop_stop_words(counts, stop) if stop else counts, "token-counts")


def by_df(spark, sf):
    return tx.vocabulary_by_df(token_counts(spark, sf), doc_total(spark, sf))


@register("vocab_by_df", f"WITH {BY_DF} SELECT word, CAST(df AS BIGINT) AS df, tf FROM kept")
def vocab_by_df(spark, sf):
    return by_df(spark, sf)


@register("tfidf", f"""
WITH {BY_DF},
raw AS (SELECT doc_id, word, cnt * (ln((1e0 + n_docs) / (1e0 + df)) + 1) AS t FROM counts JOIN kept USING (word), total)
SELECT doc_id, word, round(t / sqrt(sum(t * t) OVER (PARTITION BY doc_id)), 5) AS tfidf FROM raw""")
def tfidf(spark, sf):
    counts = token_counts(spark, sf)
    total = doc_total(spark, sf)
    return rounded(tx.tfidf(counts, tx.vocabulary_by_df(counts, total), total), 5, "tfidf")


@register("top_words", """
WITH tok AS (SELECT lang AS topic, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
w AS (SELECT topic, word, CAST(count(*) AS DOUBLE) AS weight FROM tok GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, encode(word)) AS rank,
             sum(weight) OVER (PARTITION BY topic) AS total FROM w)
SELECT topic, CAST(rank AS INTEGER) AS rank, word, round(weight / total, 6) AS share FROM r WHERE rank <= 20""")
def top_words(spark, sf):
    docs = spread_table(spark, sf, "documents", "lang", "text").withColumnRenamed("lang", "topic")
    words = tx.explode_words(docs, tx.word_tokens(F.col("text")), ["topic"])
    weights = words.groupBy("topic", "word").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return rounded(tx.top_words(weights, 20), 6, "share")


@register("sample_docs", """
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS total FROM documents),
d AS (SELECT CAST(floor(CAST('0x' || substr(md5('11:' || k), 1, 13) AS BIGINT) / 4503599627370496e0 * (SELECT max(total) FROM n)) AS BIGINT) AS place FROM range(100) t(k))
SELECT doc_id FROM d JOIN n USING (place)""")
def sample_docs(spark, sf):
    return sample_with_replacement(table(spark, sf, "documents").select("doc_id"), 100, seed=11).select("doc_id")
