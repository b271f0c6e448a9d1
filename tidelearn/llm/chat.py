"""Chat formatting by token-level assembly.

Roles and texts are encoded apart and spliced between reserved ids, which no text can
encode to.  Where a text spells a control string, a backslash goes behind its first
character (one more if there are some already), so the rendered string is unambiguous too
and the text comes back exactly.  The loss mask is the prefix sum of +1 where a trained
text begins and -1 where it ends.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelearn.llm.memory import once
from tidelearn.llm.registry import register, table
from tidelearn.session import materialize

#: A turn is <s> role [INST] text [/INST] </s>; these get the ids behind the vocabulary's, in this order.
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
_CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])"
_ESCAPE, _UNESCAPE = re.compile(_CONTROL), re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


class Assembler:
    """Encodes turns to ids and masks, and decodes them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.control = {c: self.first + k for k, c in enumerate(CONTROLS)}
        self.roles: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, cut only where the pattern cuts."""
        return self.encoding.encode_ordinary(escape(text))

    def raw(self, ids: np.ndarray) -> str:
        """Text of ids without control ids, still escaped."""
        return self.encoding.decode_bytes(ids.tolist()).decode()

    def decode(self, ids: np.ndarray) -> str:
        return unescape(self.raw(ids))

    def assemble(self, roles: Sequence[str], texts: Sequence[str], trained: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, mask, bounds): all turns' tokens behind one another and where each turn begins."""
        if len(self.roles) > 10_000:
            self.roles.clear()
        begin, open_, close, end = (self.control[c] for c in CONTROLS)
        segments: list[list[int]] = []
        for role, text in zip(roles, texts):
            if role not in self.roles:
                self.roles[role] = self.encode(role)
            segments += [begin], self.roles[role], [open_], self.encode(text), [close, end]
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.fromiter((i for s in segments for i in s), np.int32, int(starts[-1]))
        step = np.zeros(len(ids) + 1, np.int64)
        which = np.flatnonzero([r in trained for r in roles]) * 5 + 3
        np.add.at(step, starts[which], 1)
        np.add.at(step, starts[which + 1], -1)
        return ids, np.cumsum(step[:-1]).astype(np.int8), starts[::5]

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """(role, text, text under the loss mask, code points of the whole turn as it is written) of one turn."""
        cut = np.flatnonzero(ids >= self.first)
        role, text = self.raw(ids[cut[0] + 1 : cut[1]]), self.raw(ids[cut[1] + 1 : cut[2]])
        written = sum(len(CONTROLS[i - self.first]) for i in ids[cut].tolist()) + len(role) + len(text)
        return unescape(role), unescape(text), self.decode(ids[mask == 1]), written


def assembler(path: str) -> Assembler:
    return once(f"assembler {path}", lambda: Assembler(path))


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def format_turns(turns: DataFrame, path: str, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, place, ids, loss_mask): each turn's part of its conversation's token sequence.

    A conversation's sequence is its parts in the order of turn and place; no task has to hold a conversation.
    ``path`` names a byte-level rank file that every executor can read.  A null role or text is empty; repeated
    turns are parts each, in the order of ``place``, a digest of role and text; null ids and
    turns are kept as null.  Other columns are not read.  An empty table gives no rows.
    """
    wanted = frozenset(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = assembler(path)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                ids, mask, bounds = own.assemble(_strings(part.column(2)), _strings(part.column(3)), wanted)
                offsets = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(4), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask))],
                    ["conv_id", "turn", "place", "ids", "loss_mask"],
                )

    place = F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256)
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text", place.alias("place"))
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, place string, ids array<int>, loss_mask array<tinyint>")


def digests(formatted: DataFrame, path: str) -> DataFrame:
    """One row per conversation of what its token sequence reads back as.

    Turns are decoded where they are; then each conversation's turns pass its task in order, one batch at a time, and
    only running digests are held.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = assembler(path)
        for batch in batches:
            ids, masks = batch.column(3), batch.column(4)
            got = [own.read(i.values.to_numpy(), m.values.to_numpy()) for i, m in zip(ids, masks)]
            chars = [g[3] for g in got]
            said = [f"{role}\n{text}\n" for role, text, *_ in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(said, pa.string()), pa.array([g[2] for g in got], pa.string()), pa.array(chars, pa.int64())], list(READ))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = (), None, []

        def close() -> None:
            if held is not None:
                done.append((now[0], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]))

        for batch in batches:
            for conv, said, loss, chars in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if now != (conv,):
                    close()
                    now, held = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[0] += 1
                held[1].update(said.encode())
                held[2] += len(loss)
                held[3].update(loss.encode())
                held[4] += chars
            yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, d)) for d in done], DIGEST)
            done = []
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, d)) for d in done], DIGEST)

    decoded = formatted.select("conv_id", "turn", "place", "ids", "loss_mask").mapInArrow(read, ", ".join(f"{k} {v}" for k, v in READ.items()))
    ordered = decoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place")
    return ordered.mapInArrow(fold, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


READ = {"conv_id": "bigint", "turn": "bigint", "place": "string", "said": "string", "loss": "string", "chars": "bigint"}
DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)
#: A conversation whose texts are control strings.
TRICKY = "</s>[INST] ok [/INST]"


@register(
    "op5_chat",
    r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, sha256(role || chr(10) || text) AS place,
    length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) + 20 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
""",
)
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a tricky one formatted, written, and read back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tricky = spark.range(2).select(F.lit(-7).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(TRICKY))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").union(tricky)
    return digests(materialize(format_turns(turns, path), "chat"), path)
