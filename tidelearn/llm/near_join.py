"""N-gram Jaccard self-join by a token-group matrix.

1. Each text becomes its set of word shingles (64-bit hashes).  Texts with equal sets are
   one class, which its smallest doc_id stands for.
2. Classes are partitioned into groups of similar texts: classes that share a pair of minima are held against the
   one among them with the fewest rare tokens, and chains of similar pairs make the groups.  A large group is dealt out in
   parts of bounded size; a class without similar ones is a part of its own.
3. The matrix keeps a (token, part) entry for every token that can matter: for a
   link, two sets must share one of their first ``n - ceil(0.8 n) + 1`` tokens in any common order,
   and here tokens of crowded hash buckets come last.  Parts that share no such token, or too few, are never
   held against each other.
4. Every text of a part asks the parts that it meets in the matrix.  The part's token union
   bounds the overlap; only parts whose bound reaches the threshold are opened, and their sets compared exactly.
5. Of the links to a part's texts that are linked among themselves one is returned, so copies
   are not expanded into pairs.  Links make the components.

No link between different texts is lost: step 3 is an exact filter, whatever groups step 2 finds, and the texts of a part are
held against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from tidelearn.llm import words
from tidelearn.llm.components import components
from tidelearn.llm.memory import few_rows, give_back, released, send
from tidelearn.llm.registry import register, table
from tidelearn.session import materialize

WIDTH, PERCENT = 5, 80
#: Similarity in percent from which a class joins a group.
ALIKE = 40
#: A pair of minima is a key for step 2; the ranges of hashes that the minima are taken from are twice as many.
KEYS = 4
#: Tokens are counted in so many buckets, to see which are frequent.
BUCKETS, SLICES = 1 << 23, 16
#: Bits of a map of ids (4 MB).
BITS = 1 << 25
#: Tokens of a part of a group, about, and queries that one copy of a part answers, about.
PART_TOKENS, QUERIES_EACH = 32_768, 2_000
#: Bytes of text that a task has as sets at a time, about.
RUN = 1 << 20


def _flat(sets: list[np.ndarray]) -> pa.ListArray:
    """Sets as a list column of signed 64-bit numbers."""
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets) for runs of (id, text) rows."""
    for batch in batches:
        for first, data, bounds in words.chunks(batch.column(1), RUN):
            yield batch.column(0).slice(first, len(bounds) - 1), list(words.shingle_sets(data, bounds, width))
    give_back()


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(BUCKETS - 1)).astype(np.int32)


def frequent_buckets(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """For each of ``BUCKETS`` token buckets whether it is fuller than chance explains: some of its tokens are frequent.

    Tasks count all tokens of all documents and send one array of fixed size each, in slices that are added up before the
    driver sees them.  The answer only orders tokens, so buckets shared by several tokens do no harm.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.uint16)
        for _, sets in _runs(batches, width):
            at = np.sort(_bucket(np.concatenate(sets))) if sets else np.zeros(0, np.int32)
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            # A bucket that is full in one task is crowded in all.
            held[at[begin]] = np.minimum(held[at[begin]] + np.diff(np.append(begin, len(at))), 255)
        zstd = zstandard.ZstdCompressor(level=1)
        parts = [zstd.compress(p.tobytes()) for p in np.split(held.astype(np.uint8), SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[k] = held.get(k, 0) + np.frombuffer(zstd.decompress(part.as_py()), np.uint8).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], ["slice", "part"])

    kind = "slice int, part binary"
    sums = docs.mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind).toArrow()
    held = np.zeros((SLICES, BUCKETS // SLICES), np.int32)
    for k, part in zip(sums["slice"].to_pylist(), sums["part"].to_pylist()):
        held[k] = np.frombuffer(part, np.int32)
    mean = np.median(held)
    return (held > mean + 4 * np.sqrt(mean) + 2).ravel()


def _prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a sorted set one of which every set linked with it must share.

    Any common order of tokens will do; here the frequent ones come last.
    """
    n = len(tokens)
    length = n - -(-percent * n // 100) + 1
    often = frequent[_bucket(tokens)]
    rare = tokens[~often]
    return rare[:length] if len(rare) >= length else np.concatenate((rare, tokens[often][: length - len(rare)]))


def signatures(docs: DataFrame, frequent, width: int = WIDTH, percent: int = PERCENT, keys: int = KEYS) -> DataFrame:
    """(id, n, a, b, rare, k0.., prefix) per document: set size, 128 bits of the set, tokens that are not frequent, keys of minima, prefix tokens."""
    names = [f"k{i}" for i in range(keys)]
    edges = (np.arange(2 * keys, dtype=np.uint64)) * np.uint64((1 << 64) // (2 * keys))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = frequent.value
        for ids, sets in _runs(batches, width):
            n = np.array([len(s) for s in sets], np.int64)
            marks, rare = np.zeros((2 + keys, len(sets)), np.uint64), np.zeros(len(sets), np.int64)
            for d, s in enumerate(sets):
                if len(s):
                    marks[0, d] = words.mix(s * np.uint64(3)).sum()
                    marks[1, d] = np.bitwise_xor.reduce(words.mix(s ^ np.uint64(0x5BD1E995)))
                    rare[d] = len(s) - order[_bucket(s)].sum()
                    at = np.searchsorted(s, edges)
                    low = s[np.where(at < len(s), at, 0)]  # an empty last range takes the smallest of all
                    marks[2:, d] = words.mix(low[0::2] * np.uint64(5) + low[1::2] + np.arange(keys, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), *[pa.array(m.view(np.int64)) for m in marks[:2]], pa.array(rare), *[pa.array(m.view(np.int64)) for m in marks[2:]], _flat([_prefix(s, order, percent) if len(s) else s for s in sets])],
                ["id", "n", "a", "b", "rare", *names, "prefix"],
            )

    return docs.mapInArrow(sign, f"id long, n long, a long, b long, rare long, {', '.join(f'{k} long' for k in names)}, prefix array<long>")


def token_sets(width: int):
    """A column function: the sorted set of a text column."""

    @arrow_udf("array<bigint>")
    def tokens(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in text:
            yield _flat([t for _, data, bounds in words.chunks(column, RUN) for t in words.shingle_sets(data, bounds, width)])
        give_back()

    return tokens


class Part:
    """Sets that queries are held against together."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        begin = np.empty(len(tokens), bool)
        begin[0] = True
        np.not_equal(tokens[1:], tokens[:-1], out=begin[1:])
        self.first = np.flatnonzero(begin)
        self.union, self.count = tokens[self.first], np.diff(np.append(self.first, len(tokens)))
        self.root = list(range(len(sets)))

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def linked(self, own: np.ndarray) -> np.ndarray:
        """Which sets are linked with ``own``; the part stays shut if its union has too few of the tokens."""
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if 100 * len(at) < self.percent * len(own):
            return at[:0]
        count = self.count[at]
        places = np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= self.percent * (len(own) + self.sizes - both)))

    def inside(self) -> list[tuple[int, int]]:
        """Links that join what is linked within the part."""
        out = []
        for k, own in enumerate(self.sets):
            for j in self.linked(own).tolist() if len(self.sets) > 1 else ():
                x, y = self.find(k), self.find(j)
                if x != y:
                    self.root[x] = y
                    out.append((self.ids[k], self.ids[j]))
        return out

    def links(self, q: int, own: np.ndarray) -> list[tuple[int, int]]:
        """One link of the query for each of the part's linked sets of texts."""
        return [(q, self.ids[j]) for j in {self.find(j): j for j in self.linked(own).tolist()}.values()]


def _answered(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows (part, copy, asks, id, tokens): the texts of a part (asks 0) and then its queries (asks 1).

    A task holds one part at a time; queries stream past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, part = None, [], [], None

        def ready() -> tuple[Part | None, list[tuple[int, int]]]:
            if part is not None or not ids:
                return part, []
            made = Part(ids, sets, percent)
            return made, made.inside()

        for batch in batches:
            out: list[tuple[int, int]] = []
            for p, copy, asks, i, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                tokens = tokens.values.to_numpy().view(np.uint64)
                if (p, copy) != key:
                    out += ready()[1]
                    key, ids, sets, part = (p, copy), [], [], None
                if not asks:
                    ids.append(i)
                    sets.append(tokens.copy())
                else:
                    part, more = ready()
                    out += more
                    if part is not None:
                        out += part.links(i, tokens)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        out = ready()[1]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    placed = rows.select("part", "copy", "asks", "id", "tokens").repartition("part", "copy").sortWithinPartitions("part", "copy", "asks", "id")
    return placed.mapInArrow(run, "a long, b long")


def _bitmap(ids: DataFrame, bits: int = BITS):
    """Broadcast bits that mark the hashes of ``ids`` and perhaps others: ``bits`` of them, whatever the number of ids."""
    place = f"pmod(xxhash64(id), {bits})"
    word, bit = F.expr(f"cast({place} div 32 as int)"), F.expr(f"shiftleft(1L, cast({place} % 32 as int))")
    words_set = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
    marks = np.zeros(bits // 32, np.uint32)
    marks[words_set["word"].to_numpy()] = words_set["set"].to_numpy().astype(np.uint32)
    return send(ids.sparkSession, marks)


def _marked(rows: DataFrame, ids: DataFrame, of: str = "id", bits: int = BITS) -> DataFrame:
    """``rows`` with a column ``marked``: false only where the id in ``of`` is surely not among ``ids``."""
    marks = _bitmap(ids, bits)

    @arrow_udf("boolean")
    def marked(place: pa.Array) -> pa.Array:
        at = place.to_numpy(zero_copy_only=False)
        return pa.array(((marks.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool))

    return rows.withColumn("marked" if of == "id" else f"{of}_marked", marked(F.pmod(F.xxhash64(of), F.lit(bits))))


def _with_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (one row per id) with the whole sets.  Most other rows are dropped by the bitmap before their texts are shuffled."""
    likely = _marked(rows, wanted.select("id")).where("marked").drop("marked")
    return likely.join(wanted, "id").withColumn("tokens", token_sets(width)("text")).drop("text")


def _copies(asked: DataFrame, texts) -> DataFrame:
    """(part, copies): a part that many texts ask is copied, so that its queries spread over tasks."""
    return materialize(asked.groupBy("part").agg(F.expr(f"cast({texts} div {QUERIES_EACH} + 1 as int)").alias("copies")), "join-copies")


def _alike(rows: DataFrame, near: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``near`` whose sets have a similarity of ``percent`` or more: each b is a part that its a ask."""
    copies = _copies(near.select(F.col("b").alias("part")), "count(1)")
    asks = near.join(copies, F.col("b") == F.col("part")).select(F.col("a").alias("id"), "part", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("asks"))
    own = copies.select(F.col("part").alias("id"), "part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("asks"))
    # A text asks one part per key at most.
    wanted = asks.union(own).groupBy("id").agg(F.collect_list(F.struct("part", "copy", "asks")).alias("to"))
    sets = _with_sets(rows, wanted, width).select(F.explode("to").alias("to"), "id", "tokens")
    return materialize(_answered(sets.select("to.part", "to.copy", "to.asks", "id", "tokens"), percent), "join-alike")


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: documents are linked where their shingle sets have a Jaccard similarity of ``percent`` or more.

    A-Z count as lower case; words are parted by white space; a text with fewer words than ``width`` has its whole
    sequence as its one shingle.  Null and empty texts and those without words have an empty set and link with nothing:
    their component is their own id.  Repeated rows are copies; texts that share an id count as one document
    where it stands for them.  A row without an id has a null component.  An empty table gives no rows.  Other columns are not read.
    """
    # All jobs with Python run inside; what is returned joins written tables, so nothing that was sent is needed then.
    with few_rows(docs.sparkSession), released():
        return _jaccard_groups(docs, doc_id, text, width, percent)


def _jaccard_groups(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    frequent = send(spark, frequent_buckets(rows, width))
    signed = materialize(signatures(rows, frequent, width, percent), "join-signed")
    keys = [c for c in signed.columns if c.startswith("k")]

    # Classes of equal sets.
    full = signed.where("id is not null and n > 0")
    classes = materialize(full.groupBy("a", "b", "n").agg(F.min("id").alias("rep"), F.first("rare").alias("rare"), *[F.first(k).alias(k) for k in keys]), "join-classes")

    # Groups of similar classes, and their parts.
    paired = classes.select(F.explode(F.array(*keys)).alias("key"), "rep", "n", "rare")
    leaders = paired.groupBy("key").agg(F.min(F.struct("rare", "rep", "n")).alias("first"), F.count("*").alias("members")).where("members > 1")
    near = (
        paired.join(leaders, "key").select(F.col("rep").alias("a"), F.col("first.rep").alias("b"), "n", F.col("first.n").alias("m"))
        .where(f"a <> b and 100 * least(n, m) >= {ALIKE} * greatest(n, m)").select("a", "b").distinct()
    )
    near = materialize(near, "join-near")
    groups = components(_alike(rows, near, width, ALIKE)).join(classes.select(F.col("rep").alias("node"), "n"), "node")
    sizes = groups.groupBy("component").agg(F.sum("n").alias("tokens"))
    # A part is named by its smallest member.
    deal = F.pmod(F.xxhash64("node"), F.expr(f"tokens div {PART_TOKENS} + 1"))
    dealt = materialize(groups.join(sizes, "component").select("node", "component", deal.alias("deal")), "join-dealt")
    names = dealt.groupBy("component", "deal").agg(F.min("node").alias("part"))
    parts = materialize(dealt.join(names, ["component", "deal"]).select("node", "part"), "join-parts")

    # The matrix: tokens that two parts share.  A class on its own has each token once and needs no lookup;
    # copies and texts of larger parts do, and the latters' entries have repeats to take out.
    named = full.select("id", "a", "b", "n").join(classes.select("a", "b", "n", "rep"), ["a", "b", "n"])
    small = named.where("id = rep").select("id", "a", "b").distinct().join(parts.withColumnRenamed("node", "id"), "id", "left")
    special = materialize(named.where("id <> rep").select("id").union(parts.select(F.col("node").alias("id"))).distinct(), "join-special")
    marked = _marked(full.select("id", "a", "b", "prefix"), special)
    alone = marked.where("not marked").select(F.explode("prefix").alias("token"), F.col("id").alias("part"))
    looked_up = marked.where("marked").join(small, ["id", "a", "b"]).select(F.explode("prefix").alias("token"), F.coalesce("part", "id").alias("part"))
    matrix = alone.union(looked_up.distinct())
    one, two = matrix.select("token", F.col("part").alias("g")), matrix.select("token", F.col("part").alias("h"))
    meet = one.join(two, "token").where("g < h").groupBy("g", "h").agg(F.count("*").alias("shared"))

    final = components(_links(rows, materialize(meet, "join-meet"), parts, classes, width, percent))
    of_class = classes.select("a", "b", "n", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    linked = full.select("id", "n", "a", "b").join(of_class.select("a", "b", "n", F.coalesce("component", "rep").alias("component_id")), ["a", "b", "n"])
    rest = signed.where("id is null or n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).alias("component_id"))
    return linked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").union(rest)


def _links(rows: DataFrame, meet: DataFrame, parts: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within parts of several texts, and between parts that meet in the matrix."""
    members = classes.select(F.col("rep").alias("id"), "n").join(parts.withColumnRenamed("node", "id"), "id", "left")
    members = members.select(F.coalesce("part", "id").alias("part"), "id", "n", F.col("part").isNotNull().alias("several"))
    met = meet.select(F.explode(F.array("g", "h")).alias("part")).distinct().withColumn("meets", F.lit(True))
    members = materialize(members.join(met, "part", "left").where("several or meets"), "join-members")
    sizes = materialize(members.groupBy("part").agg(F.count("*").alias("texts"), F.min("n").alias("least"), F.max("n").alias("most")), "join-sizes")
    g, h = (sizes.select(*[F.col(c).alias(f"{s}_{c}") for c in sizes.columns]) for s in "gh")
    both = 100 + percent
    pairs = (
        meet.join(g, F.col("g") == F.col("g_part")).join(h, F.col("h") == F.col("h_part"))
        # No text of one can be similar to one of the other if all are too long.
        .where(f"100 * h_most >= {percent} * g_least and 100 * g_most >= {percent} * h_least")
        # Two sets can share, besides their common prefix tokens, no more than what is behind the prefix of the larger one.
        # Between parts the best case counts: the smallest text, and one as much larger as a link allows.
        .withColumn("small", F.least("g_least", "h_least"))
        .withColumn("large", F.expr(f"least(greatest(g_most, h_most), 100 * small div {percent})"))
        .where(
            f"case when g_texts + h_texts = 2 then {both} * (shared + ({percent} * greatest(g_most, h_most) + 99) div 100 - 1) >= {percent} * (g_most + h_most) "
            f"else {both} * (shared + ({percent} * large + 99) div 100) >= {percent} * (small + large) end"
        )
        # The part of fewer texts asks.
        .withColumn("turn", F.col("g_texts") <= F.col("h_texts"))
        .select(F.when(F.col("turn"), F.col("g")).otherwise(F.col("h")).alias("asking"), F.when(F.col("turn"), F.col("h")).otherwise(F.col("g")).alias("part"))
    )
    pairs = materialize(pairs, "join-pairs")
    several = members.where("several").select("part")
    used = pairs.select(F.col("asking").alias("part")).union(pairs.select("part")).union(several).distinct()
    members = members.join(used, "part", "left_semi").select("part", "id")
    sets = materialize(_with_sets(rows, members.select("id", "part"), width), "join-open")
    copies = _copies(pairs.join(sizes.select(F.col("part").alias("asking"), "texts"), "asking"), "sum(texts)")
    last = F.coalesce("copies", F.lit(1)) - 1
    texts_of = sets.join(copies, "part", "left").select("part", F.explode(F.sequence(F.lit(0), last)).alias("copy"), F.lit(0).alias("asks"), "id", "tokens")
    queries = pairs.join(sets.withColumnRenamed("part", "asking"), "asking").join(copies, "part")
    queries = queries.select("part", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("asks"), "id", "tokens")
    return materialize(_answered(texts_of.union(queries), percent), "join-links")


@register("op2_near_join")
def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of rows that share an id the one with the least hash of its text stays; rows without an id all stay.
    """
    with few_rows(docs.sparkSession), released():
        return materialize(_kept(docs, doc_id, text), "join-kept")


def _kept(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    groups = materialize(jaccard_groups(docs, doc_id, text), "join-groups")
    away = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    twice = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    special = materialize(away.union(twice).distinct(), "join-special")
    away = away.select(F.col("id").alias("__id"))
    marked = _marked(docs.withColumn("__id", F.col(doc_id).cast("bigint")), special, "__id")
    clear = marked.where("__id is null or not __id_marked").select(*docs.columns)
    looked_up = marked.where("__id is not null and __id_marked").join(away, "__id", "left_anti")
    one = looked_up.groupBy("__id").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(text)).alias("__row"))
    return clear.union(one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def keep_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of similar texts, whatever ids they have.

    Of several texts under one id the one with the least hash is judged by the id, the others by numbers of their
    own behind it: each stays unless a text like it does.  Copies of a row are one; rows without an id all stay.
    """
    with few_rows(docs.sparkSession), released():
        return _kept_texts(docs, doc_id, text)


def _kept_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.withColumns({"__key": F.col(doc_id).cast("bigint"), "__hash": F.xxhash64(text)})
    texts = rows.where("__key is not null").groupBy(F.col("__key").alias("id")).agg(F.min("__hash").alias("__least"), F.max("__hash").alias("__most"))
    several = materialize(texts.where("__least <> __most").select("id", "__least"), "join-several")
    if several.isEmpty():
        return keep_one(docs, doc_id, text)
    marked = _marked(rows, several.select("id"), "__key")
    clear = marked.where("__key is null or not __key_marked").select(*docs.columns, "__key")
    least = several.select(F.col("id").alias("__of"), "__least")
    looked_up = marked.where("__key is not null and __key_marked").join(least, F.col("__key") == F.col("__of"), "left")
    own = F.xxhash64("__key", "__hash").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    key = F.when(F.col("__hash") > F.col("__least"), own).otherwise(F.col("__key"))
    keyed = materialize(clear.union(looked_up.select(*docs.columns, key.alias("__key"))), "join-keyed")
    return keep_one(keyed, "__key", text).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_texts(docs)
