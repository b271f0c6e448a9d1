"""Quality rules: counts of words, symbols and repeats, and compression bands.

Repetitive text compresses far better than prose, noise far worse.  Each whole text is
compressed with zstandard and its ratio held against the band of its length (short
texts compress badly whatever they say); then overlapping chunks of fixed size are, to the
last byte, so that a long repetitive or random stretch shows in an otherwise ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from tidelearn.llm import words
from tidelearn.llm.memory import give_back, stay_few
from tidelearn.llm.registry import register, table

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LINE = np.zeros(256, bool)
LINE[10] = True
#: First bytes and inner bytes of code points.
INNER = np.zeros(256, bool)
INNER[128:192] = True


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio compressed / raw.

    ``whole`` has (bytes from, least, most); a text under the first length is not judged.  Chunks
    of ``chunk`` bytes, one from every half chunk on and one that ends with the text, have the limits ``of_chunk``; a text fails if more than ``most_bad`` of
    its chunks are outside them or bad chunks cover ``bad_run`` bytes on end, as they do in any bad stretch of two chunks' length.  The upper limits hold for ASCII and lie above the ratios of clean texts
    and below base64 and random letters of that length; scripts of several bytes a
    letter compress worse, so ``scripts`` times the share of bytes beyond ASCII is added.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.30, 0.99), (192, 0.30, 0.92), (256, 0.33, 0.86), (384, 0.33, 0.81), (512, 0.33, 0.77), (768, 0.33, 0.73),
        (1024, 0.25, 0.69), (2048, 0.25, 0.64), (4096, 0.18, 0.59), (16384, 0.18, 0.56), (32768, 0.18, 0.55),
    )
    chunk: int = 4096
    of_chunk: tuple[float, float] = (0.20, 0.59)
    most_bad: float = 0.3
    bad_run: int = 6144
    level: int = 3
    scripts: float = 0.12

    def ratio(self, text: memoryview, zstd: zstandard.ZstdCompressor, low: float, high: float) -> tuple[float, bool]:
        """The ratio and whether it is inside the limits."""
        ratio = len(zstd.compress(text)) / len(text)
        return ratio, low <= ratio <= high + self.scripts * np.count_nonzero(np.frombuffer(text, np.uint8) >= 128) / len(text)

    def verdict(self, text: memoryview, zstd: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
        """Whole ratio, share of bad chunks, and whether the text is inside its bands."""
        n = len(text)
        if not n:
            return 0.0, 0.0, True
        ratio, fine = self.ratio(text, zstd, *([b[1:] for b in self.whole if b[0] <= n] or [(0.0, np.inf)])[-1])
        starts = list(range(0, n - self.chunk + 1, self.chunk // 2))
        if starts and starts[-1] + self.chunk < n:
            starts.append(n - self.chunk)
        bad = run = 0
        since = -1
        for start in starts:
            if self.ratio(text[start : start + self.chunk], zstd, *self.of_chunk)[1]:
                since = -1
                continue
            bad += 1
            since = start if since < 0 else since
            run = max(run, start + self.chunk - since)
        share = bad / len(starts) if starts else 0.0
        return ratio, share, fine and share <= self.most_bad and run < self.bad_run


def covered(h: np.ndarray, width: int) -> int:
    """Words inside those of the windows ``h`` that occur twice or more."""
    if len(words.distinct(h)) == len(h):
        return 0
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    equal = sorted_[1:] == sorted_[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    steps = np.zeros(len(h) + width, np.int64)
    steps[: len(h)] += twice
    steps[width:] -= twice
    return int((np.cumsum(steps) > 0).sum())


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ",ratio:double,bad_chunks:double,in_bands:boolean>"


def measure(column: pa.Array, bands: Bands, width: int = 5) -> pa.StructArray:
    """The counts and the bands' verdict for each text; null counts as empty."""
    counts = np.zeros((len(FIELDS), len(column)), np.int64)
    ratio, bad, fine = np.zeros(len(column)), np.zeros(len(column)), np.ones(len(column), bool)
    zstd = zstandard.ZstdCompressor(level=bands.level)
    for first, data, bounds in words.chunks(column):
        n = len(bounds) - 1
        starts, ends, head = words.spans(data, bounds)
        windows = words.windows(words.hashes(data, starts, ends), width)
        line_starts, line_ends, line_head = words.spans(data, bounds, LINE)
        lines = words.hashes(data, line_starts, line_ends)
        filled = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
        here = counts[:, first : first + n]
        here[0] = np.diff(head)
        here[1] = words.per_text(~words.SPACE[data] & ~INNER[data], bounds)
        here[2] = words.per_text(SYMBOL[data], bounds)
        raw = memoryview(data)
        for d in range(n):
            own = lines[line_head[d] : line_head[d + 1]][filled[line_head[d] : line_head[d + 1]]]
            here[3, d] = len(own) - len(words.distinct(own))
            here[4, d] = covered(windows[head[d] : max(head[d], head[d + 1] - width + 1)], width)
            ratio[first + d], bad[first + d], fine[first + d] = bands.verdict(raw[bounds[d] : bounds[d + 1]], zstd)
    arrays = [pa.array(c) for c in counts] + [pa.array(ratio), pa.array(bad), pa.array(fine)]
    return pa.StructArray.from_arrays(arrays, [*FIELDS, "ratio", "bad_chunks", "in_bands"])


def measurer(bands: Bands = Bands()):
    @arrow_udf(RESULT)
    def measured(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in text:
            yield measure(column, bands)
        give_back()

    return measured


def base_failed(of: str = "", least_words: int = 10, most_repeats: int = 20):
    """Too few words, or more than ``most_repeats`` percent of them in repeated windows."""
    return (F.col(f"{of}n_words") < least_words) | (100 * F.col(f"{of}n_repeat_words") > most_repeats * F.col(f"{of}n_words"))


def apply_rules(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with a struct column ``rules``: the counts, ratio, bad_chunks, in_bands, base_failed and kept.

    A column named rules is replaced.  Null and empty texts have no words, so they fail the base rules;
    texts under the first band's length are judged by the base rules alone.  The verdict
    depends on the text only; an empty table gives no rows.
    """
    docs = docs.withColumn("rules", measurer(bands)(F.col(text)))
    failed = base_failed("rules.")
    return docs.withColumn("rules", F.col("rules").withField("base_failed", failed).withField("kept", ~failed & F.col("rules.in_bands")))


@register("op6_rules")
def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of all documents."""
    judged = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"rules.{c}").alias(c) for c in (*FIELDS, "base_failed", "kept", "ratio")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    stay_few(spark)
    measured = measurer()(F.col("text"))
    kept = docs.withColumn("__rules", measured).where(~base_failed("__rules.") & F.col("__rules.in_bands"))
    return kept.drop("__rules")
