"""Byte-level BPE of a rank file by the tokenizers library, with offsets, and back to bytes.

A rank file lists byte strings by rank; the pair of tokens that a string is merged from follows from the ranks below
its own, and no other pair can ever be merged into it (what happens inside a stretch of text
that becomes one token is what happens to that stretch alone).  So one merge per string gives the
library exactly the file's encoding.  Bytes are written as printable characters for it; a table turns them back.

Token ends are byte counts; the characters they fall into follow from the bytes that begin a character.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tidelearn.llm.memory import give_back, once
from tidelearn.llm.registry import register, table
from tidelearn.llm.tokens import byte_letters

#: Characters of text given to the library at a time; a longer run without a safe cut is given whole.
RUN = 1 << 18
#: Matches of the pattern that a worker remembers the ids of, and the characters of the longest of them.
MEMORY, LONGEST = 1 << 17, 32
#: A single space between other characters: the pattern always begins a match there, and none reaches across.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def halves(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of ``word`` after all merges of lower rank than its own."""
    parts, own = [bytes([b]) for b in word], ranks[word]
    while len(parts) > 2:
        least, at = min((ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if least >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encodes runs of texts and decodes ids with numpy tables."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level rank file holds all single bytes")
        letters = byte_letters()
        name = {word: "".join(map(letters.__getitem__, word)) for word in ranks}
        split = {word: halves(word, ranks) for word in ranks if len(word) > 1}
        # A string whose parts stay more than two is no merge, but a whole match equal to it is one token (ignore_merges).
        merges = [(name[p[0]], name[p[1]]) for p in (split[w] for w in sorted(split, key=ranks.get)) if len(p) == 2]
        self.library = Tokenizer(models.BPE({name[w]: r for w, r in ranks.items()}, merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.split, self.memory, self.plain = regex.compile(pattern), {}, set()
        words = [b""] * (max(ranks.values()) + 1)
        for word, r in ranks.items():
            words[r] = word
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.known = self.size > 0

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, a bounded run of text at a time."""
        held, room = [], RUN
        for text in texts:
            if len(text) > room and held:
                yield from self._run(held)
                held, room = [], RUN
            if len(text) > RUN:
                yield np.concatenate([ids for part in pieces(text) for ids in self._run([part])])
                continue
            held.append(text)
            room -= len(text)
        yield from self._run(held)

    def _run(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids match by match: a match's ids depend on it alone, so the library encodes each once and they are remembered."""
        for text in texts:
            if not self._plain(text):
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
                continue
            matches = self.split.findall(text)
            known, found = self.memory, {}
            new = [m for m in set(matches) if m not in known]
            if new:
                found = {m: np.array(e.ids, np.int32).tobytes() for m, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False))}
                if len(known) + len(new) <= MEMORY:
                    known.update((m, ids) for m, ids in found.items() if len(m) <= LONGEST)
            ids = [known[m] if m in known else found[m] for m in matches] if found else map(known.__getitem__, matches)
            yield np.frombuffer(b"".join(ids), np.int32)

    def _plain(self, text: str) -> bool:
        """Whether all characters are assigned in Unicode 15: the regex module and the library, of other versions, disagree on newer ones only."""
        new = set(text) - self.plain
        self.plain |= {c for c in new if unicodedata.category(c) != "Cn"}
        return new <= self.plain

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte position behind each token."""
        return np.cumsum(self.size[ids])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, gathered from the table."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.begin[ids] - (ends - size), size)
        return self.bytes[shift + np.arange(len(shift))]


def pieces(text: str, run: int = RUN) -> Iterator[str]:
    """Cuts a text where every encoder that follows the pattern cuts it too, into parts of about ``run`` characters."""
    at = 0
    while len(text) - at > run:
        cut = _SAFE.search(text, at + run)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def char_offsets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters (first, behind the last) that each token touches; a split character belongs to all its tokens."""
    begins = (data & 0xC0) != 0x80
    count = np.concatenate(([0], np.cumsum(begins)))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return count[np.minimum(starts + 1, len(data))] - 1, count[ends]


def token_texts(data: bytes, ends: np.ndarray) -> list[str]:
    """The text each token completes: a split character comes with its last token, bytes that are no UTF-8 as U+FFFD."""
    import codecs

    reader, out, at = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for k, end in enumerate(ends.tolist()):
        out.append(reader.decode(data[at:end], k + 1 == len(ends)))
        at = end
    return out


def codec(path: str, pattern: str) -> Codec:
    return once(f"codec {path} {pattern}", lambda: Codec(path, pattern))


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about four million bytes of text, so that memory follows the longest row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) >> 22
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """(key, ids) of every row, with ``offsets`` also byte_ends, char_starts and char_ends per token.

    ``path`` names a rank file all executors can read.  Each match of ``pattern`` is encoded by itself, without special tokens.
    Null and empty texts have no ids; whole texts are encoded, long ones in runs cut where the pattern cuts;
    equal rows give equal rows; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    more = ", byte_ends array<bigint>, char_starts array<bigint>, char_ends array<bigint>" if offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = list(own.encode(texts))
                columns, names = [part.column(0), _lists(ids, np.int32)], ["key", "ids"]
                if offsets:
                    ends = [own.ends(i) for i in ids]
                    chars = [char_offsets(np.frombuffer(t.encode(), np.uint8), e) for t, e in zip(texts, ends)]
                    columns += [_lists(x, np.int64) for x in (ends, [c[0] for c in chars], [c[1] for c in chars])]
                    names += ["byte_ends", "char_starts", "char_ends"]
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>{more}").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, ids: str = "ids", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encoded`` with ``data``, the bytes of its ids (a column of this name is replaced); characters that were split
    over tokens are whole again.  Null and empty lists give no bytes; unknown ids raise an error."""

    @F.arrow_udf("binary")
    def back(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for lists in column:
            yield pa.array([own.decode(x.values.to_numpy(zero_copy_only=False)).tobytes() if x.is_valid else b"" for x in lists], pa.binary())

    return encoded.withColumn("data", back(F.col(ids)))


@register("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the multilingual rank file and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
