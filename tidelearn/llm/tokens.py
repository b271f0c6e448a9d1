"""Token counts of a word-level BPE by whole-token shortcut.

The vocabulary is asked once, before any text is read, which of its strings the library
encodes alone as one token.  Texts are cut into pre-tokens; those found in the proven
set count one, the few others are merged by the library and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer

from tidelearn.llm.registry import register, table

#: White-space parted strings remembered per worker with their counts; beyond that the store starts anew.
REMEMBERED = 300_000
#: A text with any other character is normalised and cut by the library itself.
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\u012f\\u2013\\u2014\\u2018-\\u201d\\u2026\\u20ac]|\\u0130")
#: The library's cut for the characters above in lower case: letters, digits and the rest by their ranges.
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_CUT = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens that the library encodes as exactly one token, proven by encoding each vocabulary string alone."""
    tokenizer = Tokenizer.from_file(path)
    end = "</w>"
    unbyte = {c: b for b, c in byte_letters().items()}
    found = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith(end) and all(c in unbyte for c in piece[: -len(end)]):
            try:
                text = bytes(unbyte[c] for c in piece[: -len(end)]).decode()
            except UnicodeDecodeError:
                continue
            if len(tokenizer.model.tokenize(piece[: -len(end)])) == 1:
                found.append(text)
    return frozenset(found)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 stays, the rest follow from U+0100."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in stay}
    return letters | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in letters)}


class Counter(dict):
    """String without white space -> number of tokens; cuts and merges what it has not seen."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.tokenizer, self.whole, self.letters = Tokenizer.from_file(path), whole, byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def merged(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, piece.encode()))))

    def __missing__(self, part: str) -> int:
        n = sum(1 if piece in self.whole else self.merged(piece) for piece in _CUT.findall(part))
        if len(part) < 256:
            self[part] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text as the library's default gives them without added begin and end tokens."""
        if any(map(text.__contains__, self.special)):
            parts = self.special_cut.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if _OTHER.search(text):
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
            return sum(len(self.tokenizer.model.tokenize(piece)) for piece, _ in pieces)  # bytes are letters already
        if len(self) > REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, text.lower().split()))


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); columns of these names are replaced.

    ``path`` names the tokenizer file, which every executor can read.  The proven set is sent along once:
    it has no more strings than the vocabulary.  Null and empty texts have no tokens; whole texts are
    counted, however long; equal texts count alike; an empty table gives no rows.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    @arrow_udf("bigint")
    def counted(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _counters:
            _counters[path] = Counter(path, whole.value)
        counter = _counters[path]
        for texts in column:
            yield pa.array(np.fromiter((counter.count(t.as_py() or "") for t in texts), np.int64, len(texts)))

    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint"))
        .withColumn("n_tokens", counted(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


@register("op7_tokens")
def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the 49,408-entry word BPE."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")

