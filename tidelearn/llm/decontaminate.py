"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to ``FEATURES`` numbers; how many passages of ``PASSAGE`` words hold each is counted over all documents.
2. A randomised SVD of the TF-IDF matrix of all passages gives a latent space: tasks multiply their passages with a
   thin matrix and add up, the driver only orthogonalises the thin matrix.
3. Every window of every document (of about each item's length) is held against all items by cosine in that space.
4. What the cosine misses is found by words: a text that shares ``LCS`` of an item's words has some of the item's rarest,
   however it is edited. Items longer than the largest window are found this way alone.
5. Candidates are verified where they are found: the longest common subsequence of words with the item and, for
   paraphrases, the item's answer must be there.

All documents are counted, fitted on, indexed and searched.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from tidelearn.llm import words
from tidelearn.llm.memory import few_rows, give_back, released, send
from tidelearn.llm.registry import register, table
from tidelearn.session import materialize

FEATURES, RANK, SPARE, ROUNDS = 1 << 15, 80, 12, 2
PASSAGE = 32
#: The tests fit the latent space on more passages than this; there is no bound.
SAMPLE = 32_768
#: Items, and characters of items, searched for in one pass over the documents.
ITEM_BLOCK, ITEM_CHARS = 4096, 8 << 20
#: Items whose rare words are looked up together.
WORD_BLOCK = 128
#: Places of rare words held at a time; one item's are no more than the words of a run.
PLACES = 1 << 20
#: Words summed together; windows begin and end at multiples of it.
STEP = 4
WINDOWS = (12, 16, 20, 24, 32, 40, 48, 64, 80, 96, 128, 160, 192, 256, 384, 512)
COSINE, LCS, QUOTE, ANSWER = 0.52, 0.6, 0.85, 0.5
#: Items with fewer words are found word for word only, those under ``LEAST_EXACT`` not at all: they would be found everywhere.
LEAST_WORDS, LEAST_EXACT = 6, 3
#: Without an answer column the last words of an item stand for its answer.
ANSWER_WORDS = 5
CHUNK = 1 << 20

#: Words are runs of ASCII letters, digits and anything beyond ASCII, in lower case.
PARTS = np.ones(256, bool)
PARTS[0x30:0x3A] = PARTS[0x41:0x5B] = PARTS[0x61:0x7B] = PARTS[0x80:] = False
#: Tasks that add up sums as tall as the features, and passages for each task that sends such sums.
_TASKS, _SLICES, _SHARE = 4, 32, 1 << 18
#: Passages multiplied together, at least, and words whose rows are gathered at a time.
_PASSAGES, _GATHERED = 1 << 14, 1024


def _hashed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words.spans(data, bounds, PARTS)
    return words.hashes(data, starts, ends, words.LOWER), first


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)


def _pieces(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each piece of ``size`` words, first piece of each text); pieces end with their text."""
    count = -(-np.diff(first) // size)
    head = np.concatenate(([0], np.cumsum(count)))
    local = np.arange(head[-1]) - np.repeat(head[:-1], count)
    return np.repeat(first[:-1], count) + local * size, head


def _sums(rows: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the rows that each run of ``index`` names.  The last row is zero and fills short runs up."""
    size = np.diff(bounds)
    wide = int(size.max(initial=1))
    full = np.full((len(size), wide), len(rows) - 1, np.int32)
    full[np.arange(wide) < size[:, None]] = index
    out, one = np.empty((len(size), rows.shape[1]), np.float32), np.ones((1, wide), np.float32)
    step = max(1, _GATHERED // wide)
    for low in range(0, len(size), step):
        some = full[low : low + step]
        np.matmul(one, rows.take(some, axis=0, mode="clip"), out=out[low : low + step, None])
    return out


def _add_runs(out: np.ndarray, place: np.ndarray, rows: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> None:
    """Adds the sum of the rows that each run of ``index`` names to its place of ``out``; runs of like lengths go together."""
    size = np.diff(bounds)
    for wide in (1, 2, 4, 8, 16, 32, None):
        own = np.flatnonzero((size > wide // 2) & (size <= wide) if wide else size > 32)
        if not len(own):
            continue
        first = np.append(0, size[own].cumsum())
        some = index[np.arange(first[-1]) + np.repeat(bounds[own] - first[:-1], size[own])]
        if wide:
            out[place[own]] += _sums(rows, some, first)
        else:
            starts, head = _pieces(first, 32)
            out[place[own]] += np.add.reduceat(_sums(rows, some, np.append(starts, first[-1])), head[:-1])


def _running(rows: np.ndarray, out: np.ndarray) -> None:
    """Running sums of ``rows`` into ``out``, 64 rows at a time side by side, then the sums of those before."""
    whole = len(rows) // 64 * 64
    if whole:
        side = rows[:whole].reshape(-1, 64, rows.shape[1])
        for k in range(1, 64):
            side[:, k] += side[:, k - 1]
        side[1:] += np.cumsum(side[:-1, -1], axis=0)[:, None]
        out[:whole] = rows[:whole]
    if whole < len(rows):
        np.cumsum(rows[whole:], axis=0, out=out[whole:])
        if whole:
            out[whole:] += out[whole - 1]


def _with_zero(rows: np.ndarray) -> np.ndarray:
    return np.concatenate((rows, np.zeros((1, rows.shape[1]), np.float32)), dtype=np.float32)


def all_passages(docs: DataFrame) -> DataFrame:
    """(features) of every text's words as 16-bit numbers; each ``PASSAGE`` of them are a passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in words.chunks(batch.column(0), CHUNK):
                h, first = _hashed(data, bounds)
                rows = [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(_feature(h).astype("<u2"))]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(first) - 1, rows)], ["features"])
        give_back()

    return docs.mapInArrow(cut, "features binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, bounds) of at least ``_PASSAGES`` passages at a time but the last, fewer than twice as many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        bounds = np.concatenate([[0], *(size for _, size in held)]).cumsum()
        return np.concatenate([f for f, _ in held]), bounds

    n = 0
    for batch in batches:
        rows = batch.column(0)
        if pa.types.is_list(rows.type):
            f, first = rows.flatten().to_numpy(), rows.offsets.to_numpy() - rows.offsets[0].as_py()
            starts = first[:-1]
        else:
            data, first = words.bytes_of(rows)
            f = data[first[0] : first[-1]].view("<u2")
            starts, _ = _pieces((first - first[0]) // 2, PASSAGE)
        ends = np.append(starts[1:], len(f))
        for low in range(0, len(starts), _PASSAGES):
            begin, end = starts[low : low + _PASSAGES], ends[low : low + _PASSAGES]
            held.append((f[begin[0] : end[-1]], end - begin))
            n += len(begin)
            if n >= _PASSAGES:
                yield joined()
                held, n = [], 0
    if n:
        yield joined()


def _sorted(f: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage and feature of all words as sorted numbers, where each pair begins, and how often it is there."""
    pairs = np.sort(np.repeat(np.arange(len(bounds) - 1, dtype=np.int32) * FEATURES, np.diff(bounds)) + f.astype(np.int32))
    at = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs, at, np.diff(at, append=len(pairs))


def passage_counts(passages: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each feature, and the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FEATURES + 1, np.int64)
        for f, bounds in _blocks(batches):
            pairs, at, _ = _sorted(f, bounds)
            held[:FEATURES] += np.bincount(pairs[at] % FEATURES, minlength=FEATURES)
            held[FEATURES] += len(bounds) - 1
        found = np.flatnonzero(held)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], ["feature", "n"])

    sums = passages.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(FEATURES + 1, np.int64)
    held[sums["feature"].to_numpy()] = sums["n"].to_numpy()
    return held[:FEATURES], int(held[FEATURES])


def latent_space(passages: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """(FEATURES, rank): maps summed words to whitened latent coordinates, weights included.

    ``passages`` holds a list of features for each, or what ``all_passages`` gives.  Randomised SVD with ``ROUNDS`` power iterations.  A task sends sums as tall as the features, in slices that are
    added up before they reach the driver; their size is fixed by FEATURES and rank.
    """
    spark, width = passages.sparkSession, rank + SPARE
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, width)))[0].astype(np.float32)
    high = FEATURES // _SLICES

    def times(sent, gram: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, w = sent.value
            out = np.zeros((width, width) if gram else (FEATURES, width), np.float64 if gram else np.float32)
            own = _with_zero(q * w[:, None])
            for f, bounds in _blocks(batches):
                # TF-IDF rows of length 1; words that repeat in a passage add up.
                pairs, at, often = _sorted(f, bounds)
                norm = np.sqrt(np.bincount(pairs[at] // FEATURES, (w[pairs[at] % FEATURES] * often) ** 2, len(bounds) - 1))
                scale = np.divide(1, norm, out=np.zeros_like(norm), where=norm > 0).astype(np.float32)[:, None]
                y = _sums(own, pairs % FEATURES, bounds) * scale
                if gram:
                    out += y.T @ y
                elif len(pairs):
                    order = np.argsort((pairs % FEATURES).astype(np.uint16), kind="stable")
                    f, piece = (pairs % FEATURES)[order], (pairs // FEATURES)[order]
                    at = np.flatnonzero(np.diff(f, prepend=-1))
                    _add_runs(out, f[at], _with_zero(y * scale), piece, np.append(at, len(f)))
            if not gram:
                out *= w[:, None]
            parts = [out] if gram else np.split(out, _SLICES)
            used = [k for k, p in enumerate(parts) if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].astype(np.float32 if not gram else np.float64).tobytes() for k in used], pa.binary())], ["slice", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(part.as_py(), kind_of)
                    held[k] = held[k] + part if k in held else part
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], ["slice", "part"])

        kind, kind_of = "slice int, part binary", np.float64 if gram else np.float32
        got = passages.mapInArrow(run, kind).repartition(_TASKS, "slice").mapInArrow(add, kind).toArrow()
        out = np.zeros((1 if gram else _SLICES, width * (width if gram else high)))
        for k, part in zip(got["slice"].to_pylist(), got["part"].to_pylist()):
            out[k] = np.frombuffer(part, kind_of)
        return out.reshape(-1, width)

    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((basis, weight))
        basis = np.linalg.qr(times(sent, False))[0].astype(np.float32)
        sent.destroy()
    sent = spark.sparkContext.broadcast((basis, weight))
    gram = times(sent, True)
    sent.destroy()
    values, vectors = np.linalg.eigh(gram)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    scale = np.where(values > 1e-9 * max(values[0], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return ((basis @ vectors) * scale * weight[:, None]).astype(np.float32)


class Space(NamedTuple):
    """Latent coordinates of all features, and how rare each feature is in the documents."""

    vectors: np.ndarray
    weight: np.ndarray


@dataclass
class Item:
    item_id: int
    at: int
    words: np.ndarray
    vector: np.ndarray
    answer: frozenset[int]
    #: Places of each word as bits; kept for items that windows are long enough for.
    kept: dict[int, int] | None = None

    @property
    def size(self) -> int:
        return len(self.words)

    @property
    def span(self) -> int:
        """Words of text that an item's words are looked for in."""
        return max(12, 3 * self.size // 2)

    @property
    def stride(self) -> int:
        return max(1, self.size // 4)

    def masks(self) -> dict[int, int]:
        if self.kept is not None:
            return self.kept
        masks: dict[int, int] = defaultdict(int)
        for k, w in enumerate(self.words.tolist()):
            masks[w] |= 1 << k
        return dict(masks)


class Rare:
    """The rarest words of some items, and how many of them a text with ``LCS`` of an item's words has at least.

    Of an item's n words at most n - need are missing from a find, so at least k of any n - need + k are there.
    """

    def __init__(self, items: list[Item], weight: np.ndarray, lcs: float = LCS):
        keys, owner = [], []
        self.items, self.weight, self.lcs, self.least = items, weight, lcs, np.zeros(len(items), np.int64)
        for k, item in enumerate(items):
            need = int(np.ceil(lcs * item.size - 1e-9))
            self.least[k] = max(1, need // 3)
            rarest = np.argsort(-weight[_feature(item.words)], kind="stable")[: item.size - need + self.least[k]]
            keys.append(words.distinct(item.words[rarest]))
            owner.append(np.full(len(keys[-1]), k))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        self.owner = owner[order]
        self.keys, self.head = np.unique(keys[order], return_index=True)
        self.head = np.append(self.head, len(keys))
        #: Whether some key begins with these 16 bits.
        self.begins = np.zeros(1 << 16, bool)
        self.begins[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.span, self.stride = (np.array([getattr(i, n) for i in items]) for n in ("span", "stride"))

    @cached_property
    def halves(self) -> list[Rare]:
        middle = len(self.items) // 2
        return [Rare(self.items[:middle], self.weight, self.lcs), Rare(self.items[middle:], self.weight, self.lcs)]

    def places(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, Item, int, int]]:
        """(text, item, first word, end) of all stretches that may hold an item: each span of its length is inside one."""
        place = np.flatnonzero(self.begins[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[place]), len(self.keys) - 1)
        there = self.keys[at] == h[place]
        place, at = place[there], at[there]
        count = self.head[at + 1] - self.head[at]
        if count.sum() > PLACES and len(self.items) > 1:
            # Common words: fewer items at a time.
            for half in self.halves:
                yield from half.places(h, first)
            return
        owner = self.owner[np.arange(count.sum()) + np.repeat(self.head[at] - np.cumsum(count) + count, count)]
        place = np.repeat(place, count)
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order]
        # The first and the last of as many rare words as a find has.
        last = np.arange(len(owner)) + self.least[owner] - 1
        run = np.flatnonzero(last < len(owner))
        last = last[run]
        text = np.searchsorted(first, place[run], "right") - 1
        near = (owner[last] == owner[run]) & (place[last] < first[text + 1]) & (place[last] - place[run] < self.span[owner[run]])
        run, last, text = run[near], last[near], text[near]
        item, low = owner[run], first[text]
        span, stride = self.span[item], self.stride[item]
        begin = np.maximum(place[last] - span + 1 - low, 0) // stride
        count = (place[run] - low) // stride - begin + 1
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(low, count) + (np.repeat(begin, count) + step) * np.repeat(stride, count)
        key = np.unique(np.repeat(item, count) * (len(h) + 1) + start)
        item, start = key // (len(h) + 1), key % (len(h) + 1)
        text = np.searchsorted(first, start, "right") - 1
        end = np.minimum(start + self.span[item] + self.stride[item] - 1, first[text + 1])
        yield from zip(text.tolist(), (self.items[k] for k in item.tolist()), start.tolist(), end.tolist())


@dataclass
class Items:
    """Items with their latent vectors, by the length of the windows that they are held against; rare words of
    all items; short items by their length and the hash of their words."""

    by_window: dict[int, tuple[np.ndarray, list[Item]]] = field(default_factory=dict)
    rare: list[Rare] = field(default_factory=list)
    short: dict[int, dict[int, list[Item]]] = field(default_factory=dict)

    @staticmethod
    def of(ids: list, texts: list, answers: list, space: Space) -> Items:
        groups: dict[int, list[Item]] = defaultdict(list)
        short: dict[int, dict[int, list[Item]]] = defaultdict(lambda: defaultdict(list))
        long: list[Item] = []

        def hashed(text: str | None) -> np.ndarray:
            data, bounds = words.utf8(pa.array([text], pa.string()))
            return _hashed(data, bounds)[0]

        for at, (item_id, text, answer) in enumerate(zip(ids, texts, answers)):
            h = hashed(text)
            if len(h) < LEAST_EXACT:
                continue
            vector = space.vectors[_feature(h)].sum(0)
            norm = np.linalg.norm(vector)
            told = hashed(answer) if answer else h[-ANSWER_WORDS:]
            item = Item(item_id, at, h, (vector / (norm or 1)).astype(np.float32), frozenset(told.tolist()))
            if len(h) < LEAST_WORDS:
                short[len(h)][int(words.windows(h, len(h))[0])].append(item)
                continue
            long.append(item)
            window = next((w for w in WINDOWS if w >= len(h)), None)
            if window:
                item.kept = item.masks()
                if norm:
                    groups[window].append(item)
        return Items(
            {w: (np.array([i.vector for i in own], np.float32), own) for w, own in groups.items()},
            [Rare(long[k : k + WORD_BLOCK], space.weight) for k in range(0, len(long), WORD_BLOCK)],
            {size: dict(own) for size, own in short.items()},
        )


def common(marks: list[int], size: int) -> int:
    """Length of the longest common subsequence of an item and a text: ``marks`` has, for each word of the text
    that the item has, the item's places of that word as bits."""
    full = (1 << size) - 1
    v = full
    for m in marks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def find(column: pa.Array, items: Items, space: np.ndarray, cosine: float = COSINE, lcs: float = LCS) -> Iterator[tuple[int, list[tuple]]]:
    """For each text with hits its index and (item id, item words, common words, cosine, answer found, first word) per item."""
    filled = _with_zero(space)
    for start, data, bounds in words.chunks(column, CHUNK):
        h, first = _hashed(data, bounds)
        pieces, head = _pieces(first, STEP)
        if not len(pieces):
            continue
        f, ends = _feature(h), np.append(pieces[1:], len(h))
        # Running sums of the latent vectors of all words, so that a window is a difference.
        sums = np.zeros((len(pieces) + 1, space.shape[1]), np.float32)
        _running(_sums(filled, f, np.append(pieces, len(h))), sums[1:])
        text_of = np.repeat(np.arange(len(head) - 1), np.diff(head))
        local = np.arange(len(pieces)) - head[text_of]
        count = np.diff(head)[text_of]
        found: dict[tuple[int, int], tuple[Item, list[tuple[float, int, int]]]] = {}

        def add(d: int, item: Item, near: float, begin_word: int, end_word: int) -> None:
            found.setdefault((d, item.at), (item, []))[1].append((-near, begin_word, end_word))

        for window, (vectors, own) in items.by_window.items():
            long, margin = window // STEP, window // 4
            stride = max(1, long // 4)
            begin = np.flatnonzero((local % stride == 0) & (local <= np.maximum(count - long + stride - 1, 0)))
            end = np.minimum(begin + long, head[text_of[begin] + 1])
            for a in range(0, len(begin), 1024):
                x = sums.take(end[a : a + 1024], axis=0)
                x -= sums.take(begin[a : a + 1024], axis=0)
                least = cosine * np.sqrt(np.einsum("ij,ij->i", x, x)) + np.float32(1e-6)
                for rows in range(0, len(own), 512):
                    c = x @ vectors[rows : rows + 512].T
                    window_at, item_at = np.divmod(np.flatnonzero(c >= least[:, None]), c.shape[1])
                    close = c[window_at, item_at] / (least[window_at] / cosine)
                    window_at += a
                    d = text_of[begin[window_at]]
                    low = np.maximum(pieces[begin[window_at]] - margin, first[d])
                    high = np.minimum(ends[end[window_at] - 1] + margin, first[d + 1])
                    for at, k, near, i, j in zip(d.tolist(), item_at.tolist(), close.tolist(), low.tolist(), high.tolist()):
                        add(at, own[rows + k], near, i, j)
        for rare in items.rare:
            for d, item, i, j in rare.places(h, first):
                # After all that the cosine found.
                add(d, item, -2.0, i, j)
        hits: dict[int, list[tuple]] = defaultdict(list)
        for (d, _), (item, places) in found.items():
            best, place = None, item.kept.get if item.kept else None
            for near, begin_word, end_word in sorted(places):
                if not place:
                    if np.isin(h[begin_word:end_word], item.words).sum() < lcs * item.size:
                        continue
                    place = item.masks().get
                text = h[begin_word:end_word].tolist()
                marks = [m for w in text if (m := place(w))]
                if len(marks) < lcs * item.size:
                    continue
                same = common(marks, item.size)
                if same < lcs * item.size:
                    continue
                answer = len(item.answer.intersection(text)) >= ANSWER * len(item.answer)
                if same >= QUOTE * item.size or answer:
                    if best is None or same > best[2]:
                        if near > 1:
                            x = space[f[begin_word:end_word]].sum(0)
                            near = -float(x @ item.vector) / (float(np.linalg.norm(x)) or 1.0)
                        best = (item.item_id, item.size, same, round(-near, 4), answer, begin_word - int(first[d]))
                    if same == item.size:
                        break
            if best:
                hits[d].append(best)
        for size, own in items.short.items():
            w = words.windows(h, size)
            seen = set()
            for i in np.flatnonzero(np.isin(w, np.array(list(own), np.uint64))).tolist():
                d = int(np.searchsorted(first, i, "right")) - 1
                for item in own[int(w[i])] if i + size <= first[d + 1] else ():
                    if (d, item.at) not in seen:
                        seen.add((d, item.at))
                        hits[d].append((item.item_id, size, size, 1.0, len(item.answer.intersection(item.words.tolist())) >= ANSWER * len(item.answer), i - int(first[d])))
        for d in sorted(hits):
            yield start + d, sorted(hits[d], key=lambda x: (x[0] is None, x[0]))


def item_blocks(benchmark: DataFrame, space: Space, item_id: str = "item_id", text: str = "text", answer: str | None = None) -> Iterator:
    """Broadcast (items, latent coordinates) for blocks of about ``ITEM_BLOCK`` items or ``ITEM_CHARS``, so that no more are held at once."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("w"))
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(n // ITEM_BLOCK, chars // ITEM_CHARS) + 1
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toArrow()
        items = Items.of(got["i"].to_pylist(), got["t"].to_pylist(), got["w"].to_pylist(), space)
        if items.rare or items.short:
            yield send(spark, cloudpickle.dumps((items, space.vectors)))  # with its classes, which tasks may not be able to import


def fit(docs: DataFrame, text: str = "text") -> Space:
    """The latent space of the documents' passages."""
    passages = materialize(all_passages(docs.select(F.col(text).alias("text"))), "decontaminate-passages")
    counts, total = passage_counts(passages)
    # The rarest words tell passages apart best; unseen features weigh as much as those seen once.
    weight = np.log((1 + total) / np.maximum(counts, 1)).clip(0).astype(np.float32)
    return Space(latent_space(passages.coalesce(max(_TASKS, total // _SHARE)), weight), weight)


HIT = "doc_id bigint, item_id bigint, item_words bigint, common_words bigint, cosine double, answer_found boolean, first_word bigint"


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", answer: str | None = None, space: Space | None = None) -> DataFrame:
    """One row per document and benchmark item found in it; documents without a find have no rows.

    A find has ``QUOTE`` of the item's words in order, or ``LCS`` of them and ``ANSWER`` of the answer's words.  Without an
    ``answer`` column the item's last words stand for the answer.  Null and empty texts hold nothing; items of
    fewer than ``LEAST_WORDS`` words are found word for word, of fewer than ``LEAST_EXACT`` not at all; repeated rows are found each; rows without an id are
    reported with a null id.  Empty tables give no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    space = fit(docs, text) if space is None else space

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, own = pickle.loads(sent.value)
            names = [c.split()[0] for c in HIT.split(", ")]
            kind = pa.schema([(n, pa.float64() if n == "cosine" else pa.bool_() if n == "answer_found" else pa.int64()) for n in names])
            for batch in batches:
                found = [(batch.column(0)[d].as_py(), *hit) for d, hits in find(batch.column(1), items, own) for hit in hits]
                yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], kind)

        return rows.mapInArrow(run, HIT)

    out = None
    for sent in item_blocks(benchmark, space, answer=answer):
        part = search(sent)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], HIT)


@register("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def cleaner(sent):
    """A column function: whether a text holds none of the broadcast items."""

    @arrow_udf("boolean")
    def clean(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items, space = pickle.loads(sent.value)
        for column in text:
            fine = np.ones(len(column), bool)
            fine[[d for d, _ in find(column, items, space)]] = False
            yield pa.array(fine)
        give_back()

    return clean


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.  The space and the items are sent along until the result is written."""
    with few_rows(spark), released():
        space = fit(docs)
        for sent in item_blocks(table(spark, sf_dir, "benchmark"), space):
            docs = docs.where(cleaner(sent)(F.col("text")))
        return materialize(docs, "decontaminate-kept")
