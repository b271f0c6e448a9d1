"""Symbolic words of time series, and a word dictionary per class.

Series are rows ``(series, seq, value)``; words are ``(series, pos, word)``.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelearn.operators.windows import number_rows
from tidelearn.plans.learner import Stage, need_columns

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def breakpoints(alphabet: int) -> list[float]:
    """Cuts that give each letter the same share of a standard normal."""
    return [NormalDist().inv_cdf(i / alphabet) for i in range(1, alphabet)]


def letter(z: Column, alphabet: int) -> Column:
    out = F.lit(LETTERS[alphabet - 1])
    for i, cut in reversed(list(enumerate(breakpoints(alphabet)))):
        out = F.when(z < cut, F.lit(LETTERS[i])).otherwise(out)
    return out


class Sax(Stage):
    """Normalise, average fragments of values, map to letters, group into words."""

    def __init__(self, fragment: int = 2, word: int = 2, alphabet: int = 4):
        self.fragment, self.word, self.alphabet = fragment, word, alphabet

    def fit(self, rows: DataFrame, **override) -> DataFrame:
        """Mean and standard deviation of each training series."""
        need_columns(rows, self, "series", "value")
        return rows.groupBy("series").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))

    def transform(self, rows: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        """Full words of each series; values of a last, shorter piece give none.

        A word's letters are averages over fixed places in the word, so one
        aggregate per word is enough and no series is gathered.
        """
        need_columns(rows, self, "series", "seq", "value")
        f, w = self.fragment, self.word
        placed = number_rows(rows.select("series", "seq", "value"), "seq", ["series"], name="_at")
        slot = F.expr(f"(_at div {f}L) % {w}L")
        pieces = placed.groupBy("series", F.expr(f"_at div {f * w}L").alias("pos")).agg(
            F.count(F.lit(1)).alias("_n"), *[F.avg(F.when(slot == i, F.col("value"))).alias(f"_f{i}") for i in range(w)]
        )
        scaled = pieces.filter(F.col("_n") == f * w).join(model, ["series"])

        def z(i: int) -> Column:
            flat = F.coalesce(F.col("scale"), F.lit(0.0)) <= 0
            return F.when(flat, F.lit(0.0)).otherwise(
                (F.col(f"_f{i}") - F.col("mean")) / F.nullif(F.col("scale"), F.lit(0.0))
            )

        return scaled.select("series", "pos", F.concat(*[letter(z(i), self.alphabet) for i in range(w)]).alias("word"))


class SaxDictionary(Stage):
    """Weights of words per class, and the class closest to a window of words.

    A word weighs ``(1 + ln n) ln(C / c)`` in a class where it occurs ``n``
    times, with ``c`` of the ``C`` classes having it.  Windows of ``number``
    words are compared by the cosine of their counts with these weights.
    """

    def __init__(self, number: int = 3):
        self.number = number

    def fit(self, words: DataFrame, **override) -> DataFrame:
        """``(word, class, weight)`` with each class scaled to length one."""
        need_columns(words, self, "word", "class")
        counts = words.groupBy("word", "class").agg(F.count(F.lit(1)).alias("n"))
        spread = counts.groupBy("word").agg(F.count(F.lit(1)).alias("_c"))
        classes = counts.agg(F.count_distinct("class")).scalar()
        weights = counts.join(spread, "word").select(
            "word", "class", ((1.0 + F.ln("n")) * F.ln(classes.cast("double") / F.col("_c"))).alias("_w")
        )
        norms = weights.groupBy("class").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
        scaled = F.when(F.col("_norm") > 0, F.col("_w") / F.nullif(F.col("_norm"), F.lit(0.0))).otherwise(F.lit(0.0))
        return weights.join(norms, "class").select("word", "class", scaled.alias("weight"))

    def predict(self, words: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        """Best class and its score for every window of ``number`` words of a series.

        Windows without any dictionary word get no class and score 0.
        """
        need_columns(words, self, "series", "pos", "word")
        counts = (
            words.groupBy("series", F.expr(f"pos div {self.number}L").alias("win"), "word").agg(F.count(F.lit(1)).alias("n"))
        )
        # A window has at most ``number`` distinct words.
        whole = Window.partitionBy("series", "win")
        normed = counts.withColumn("_norm", F.sqrt(F.sum(F.col("n") * F.col("n")).over(whole).cast("double")))
        hits = normed.join(model.filter("weight > 0"), ["word"], "left")
        scores = hits.groupBy("series", "win", "class").agg(
            F.sum(F.col("n") / F.col("_norm") * F.coalesce("weight", F.lit(0.0))).alias("score")
        )
        # Largest score first, then the smaller class name; a missing class loses.
        tied = scores.withColumn("_top", F.max(F.struct(F.col("class").isNotNull().alias("k"), "score")).over(whole))
        top = tied.filter(
            (F.col("class").isNotNull() == F.col("_top.k")) & (F.col("score") == F.col("_top.score"))
        )
        return top.groupBy("series", "win").agg(F.min("class").alias("class"), F.max("score").alias("score"))


def majority_class(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value per key, the smaller one on ties."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(key).agg(F.max("n").alias("_n"))
    return counts.join(top, key).filter("n = _n").groupBy(key).agg(F.min(value).alias("class"))
