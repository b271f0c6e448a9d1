"""Word preparation for topic models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelearn.session import materialize

# Letters, digits and the underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
# What a whole number looks like; digits may be grouped by single underscores.
WHOLE = r"^\p{Nd}+(_\p{Nd}+)*$"
BLANKS = " \t\r\n"
# A run of characters other than the space, without blanks at either end.
PIECE = r"[^ \t\r\n](?:[^ ]*[^ \t\r\n])?"


def space_words(text: Column) -> Column:
    """Lower case, split at single spaces, trim, drop empty pieces."""
    return F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def explode_words(docs: DataFrame, words: Column, keep: list[str] | None = None) -> DataFrame:
    return docs.select(*(keep or ["doc_id"]), F.explode(words).alias("word"))


def word_counts(docs: DataFrame, words: Column, keep: list[str] | None = None) -> DataFrame:
    """Count of each distinct word of each document, without a shuffle.

    A document is one row, so its words are sorted and counted in place: a run
    of equal words starts where a word differs from the one before it.
    """
    keep = keep or ["doc_id"]
    lined = docs.select(*keep, F.sort_array(words).alias("_w")).filter(F.size("_w") > 0)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1))
    )
    runs = F.transform(
        "_s",
        lambda p, k: F.struct(
            F.get("_w", p).alias("word"), (F.coalesce(F.get("_s", k + 1), F.size("_w")) - p).cast("long").alias("cnt")
        ),
    )
    exploded = lined.withColumn("_s", starts).select(*keep, F.explode(runs).alias("_e"))
    return exploded.select(*keep, "_e.word", "_e.cnt")


def corpus_counts(docs: DataFrame, words: Column) -> DataFrame:
    """Occurrences of each word over all documents."""
    return explode_words(docs, words, []).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def drop_stop_words(counts: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Remove stop words; the default is Spark's English list."""
    if stop is None:
        from pyspark.ml.feature import StopWordsRemover

        stop = StopWordsRemover.loadDefaultStopWords("english")
    return counts.filter(~F.col("word").isin(list(stop)))


def clean_words(words: DataFrame) -> DataFrame:
    """Distinct words longer than two characters that are not whole numbers."""
    return words.select("word").filter((F.length("word") > 2) & ~F.col("word").rlike(WHOLE)).distinct()


def number_words(words: DataFrame, name: str = "word_id") -> DataFrame:
    """Dense ids of distinct words in sorted order.

    The sorted words are written once; an id is the number of words in the
    files before plus the row's place in its file.
    """
    ordered = materialize(words.select("word").distinct().orderBy("word"), "words")
    placed = ordered.select("word", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(starts, "_file").select("word", (F.col("_first") + F.col("_row")).cast("long").alias(name))


def encode(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc_id, word, cnt)`` to ``(doc_id, word_id, cnt)``; unknown words are dropped.

    A common word occurs in most documents, so the join key is salted.
    """
    return counts.join(vocab.select("word", "word_id"), ["word"]).select("doc_id", "word_id", "cnt")


def unknown_words(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words of the corpus that the vocabulary lacks, counted before the join."""
    return corpus.join(vocab.select("word"), "word", "left_anti")


def known_documents(docs: DataFrame, words: Column, vocab: DataFrame) -> DataFrame:
    """Ids of documents with at least one vocabulary word."""
    distinct = explode_words(docs, F.array_distinct(words))
    return distinct.join(vocab.select("word"), ["word"]).select("doc_id").distinct()


def empty_documents(docs: DataFrame, words: Column, vocab: DataFrame) -> DataFrame:
    """Documents without any vocabulary word; they are dropped from training."""
    return docs.join(known_documents(docs, words, vocab), "doc_id", "left_anti")


def vocabulary_by_df(counts: DataFrame, n_docs: DataFrame, least: int = 2, share: float = 0.95, top: int = 1000) -> DataFrame:
    """``(word, df, tf)`` of words in at least ``least`` and at most ``share`` of the documents.

    ``counts`` has one row per document and word; ``n_docs`` holds one number.
    The ``top`` words by occurrence are kept, as asked for.
    """
    words = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("tf"))
    kept = words.filter((F.col("df") >= least) & (F.col("df") <= F.lit(share) * n_docs.scalar()))
    return kept.select("word", "df", "tf").orderBy(F.desc("tf"), "word").limit(top)


def tfidf(counts: DataFrame, words: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``cnt * (ln((1+N)/(1+df)) + 1)``, scaled so that each document has length one."""
    idf = words.select("word", (F.ln((1.0 + n_docs.scalar()) / (1.0 + F.col("df"))) + 1.0).alias("_idf"))
    raw = counts.join(idf, ["word"]).select("doc_id", "word", (F.col("cnt") * F.col("_idf")).alias("_t"))
    # A document has at most as many rows here as the vocabulary has words.
    whole = Window.partitionBy("doc_id")
    return raw.select("doc_id", "word", (F.col("_t") / F.sqrt(F.sum(F.col("_t") * F.col("_t")).over(whole))).alias("tfidf"))


def top_words(weights: DataFrame, k: int, topic: str = "topic", word: str = "word") -> DataFrame:
    """The ``k`` heaviest words of each topic with their share of the topic.

    The total is a sum joined back, so that the ranking window keeps only
    ``k`` rows per topic and task before its shuffle.
    """
    totals = weights.groupBy(topic).agg(F.sum("weight").alias("_total"))
    best = Window.partitionBy(topic).orderBy(F.desc("weight"), word)
    ranked = weights.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(totals, topic).select(topic, "rank", word, (F.col("weight") / F.col("_total")).alias("share"))
