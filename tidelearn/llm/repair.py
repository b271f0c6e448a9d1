"""Cheapest repair of conversations by dynamic programming over a shared grammar.

Each row is one of nine symbols (its role's initial, and whether it must go or is cut off).
Re-Pair rounds over all distinct symbol sequences replace frequent neighbours by new symbols.
Every symbol and every rule has one min-plus matrix over the four states of a well-formed
conversation; its entries are the least cost and the edits that reach it, as ropes.  Rules are evaluated
bottom-up, once, and then serve all conversations.

Long conversations are cut into blocks of rows; block matrices multiply in order.  Ties go to the least edit string.  Between two
states, no cheapest edit string begins another one of equal cost (more edits over the same rows are insertions and cost more), so
the least strings of two stretches give the least string of both.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelearn.llm.memory import once
from tidelearn.llm.order import in_order
from tidelearn.llm.registry import register, table
from tidelearn.session import materialize

#: Rows of a conversation that one matrix covers at most.
BLOCK = 4096
#: Rounds of the grammar and pairs replaced in each; both bound the rules, not the conversations.
ROUNDS, PAIRS = 8, 8
#: Block sequences whose matrices a worker remembers.
REMEMBERED = 50_000

#: States: nothing yet, behind a system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The next role that an inserted or changed row takes on, by state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of an initial leads to; other steps are not well-formed.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
#: Row symbols: rows that must go, whole rows by initial (o: any other), cut off rows by initial.
SYMBOLS = "xsuaoSUAO"
FIRST_RULE = 0xE000  # a private-use character stands for each rule
WHITE = " \t\n\x0b\x0c\r"


class Rope:
    """A string of edits as a tree; ``hash`` and ``size`` tell equal parts apart without writing them out."""

    __slots__ = ("left", "right", "text", "size", "hash")
    MOD, BASE = (1 << 61) - 1, 911_382_323

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.size, self.hash = len(text), functools.reduce(lambda h, c: (h * self.BASE + ord(c)) % self.MOD, text, 0)
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(self.BASE, right.size, self.MOD) + right.hash) % self.MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return other if not self.size else self
        if self.size + other.size <= 32 and self.left is None and other.left is None:
            return Rope(self.text + other.text)
        return Rope("", self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                out.append(x.text)
            else:
                todo += [x.right, x.left]
        return "".join(out)

    def less(self, other: Rope) -> bool:
        """Whether this string sorts before the other: descends to the first parts that differ."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.size == y.size and x.hash == y.hash):
                continue
            if x.left is None and y.left is None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                a += [Rope(x.text[n:])] if x.size > n else []
                b += [Rope(y.text[n:])] if y.size > n else []
            elif y.left is None or (x.left is not None and x.size >= y.size):
                a += [x.right, x.left]
                b.append(y)
            else:
                a.append(x)
                b += [y.right, y.left]
        return bool(b) and not a


Cell = tuple[int, Rope]
Matrix = list[list[Cell | None]]


def better(a: Cell | None, b: Cell | None) -> Cell | None:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1].less(a[1]) else a


def row_times(row: list[Cell | None], m: Matrix) -> list[Cell | None]:
    """Min-plus product of one row of cells with a matrix.  Ropes are joined only for the least costs."""
    out: list[Cell | None] = []
    for j in STATES:
        costs = [row[k][0] + m[k][j][0] if row[k] is not None and m[k][j] is not None else None for k in STATES]
        least = min((c for c in costs if c is not None), default=None)
        best = None
        for k in STATES:
            if least is not None and costs[k] == least:
                best = better(best, (least, row[k][1] + m[k][j][1]))
        out.append(best)
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [row_times(row, b) for row in a]


def _insertions() -> Matrix:
    """Insertions between two rows; going around once more never pays."""
    m: Matrix = [[(0, Rope()) if i == j else None for j in STATES] for i in STATES]
    for i in STATES:
        at, cell = i, (0, Rope())
        for _ in range(2):
            at, cell = NEXT[at], (cell[0] + INSERT, cell[1] + Rope("I"))
            m[i][at] = better(m[i][at], cell)
    return m


INSERTIONS = _insertions()


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions before a row, then its own edit."""
    m: Matrix = [[None] * 4 for _ in STATES]
    cut = CUT if symbol.isupper() else 0
    for i in STATES:
        m[i][i] = (DELETE, Rope("D"))
        if symbol != "x":
            m[i][NEXT[i]] = better(m[i][NEXT[i]], (REROLE + cut, Rope("R")))
            j = KEEP[symbol.lower()].get(i)
            if j is not None:
                m[i][j] = better(m[i][j], (cut, Rope("K")))
    return times(INSERTIONS, m)


class Grammar:
    """The rules' matrices, each made once from those of its two symbols."""

    def __init__(self, pairs: tuple[str, ...]):
        self.pairs = pairs
        self.matrix = {s: symbol_matrix(s) for s in SYMBOLS}
        for k, pair in enumerate(pairs):
            self.matrix[chr(FIRST_RULE + k)] = times(self.matrix[pair[0]], self.matrix[pair[1]])
        self.seen: dict[str, tuple[list[int], list[str]]] = {}

    def compress(self, sequence: str) -> str:
        for k, pair in enumerate(self.pairs):
            sequence = sequence.replace(pair, chr(FIRST_RULE + k))
        return sequence

    def block(self, sequence: str) -> tuple[list[int], list[str]]:
        """Costs (-1: no way) and edits of the 16 entries of a block's matrix."""
        if sequence not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            m = functools.reduce(times, (self.matrix[s] for s in self.compress(sequence)))
            cells = [c for row in m for c in row]
            self.seen[sequence] = [-1 if c is None else c[0] for c in cells], ["" if c is None else str(c[1]) for c in cells]
        return self.seen[sequence]


def grammar(pairs: tuple[str, ...]) -> Grammar:
    """The grammar of these rules; a worker keeps the last one."""
    held = once("grammar", dict)
    if pairs not in held:
        held.clear()
        held[pairs] = Grammar(pairs)
    return held[pairs]


def learn(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> tuple[str, ...]:
    """Re-Pair over (seq, weight) rows: each round counts neighbours and replaces the most frequent ones that share no
    symbol.  Stops where no pair occurs twice.  Only counts of the most frequent pairs reach the driver."""
    rules: list[str] = []
    for _ in range(rounds):
        text = F.col("seq")
        for k, pair in enumerate(rules):
            text = F.replace(text, F.lit(pair), F.lit(chr(FIRST_RULE + k)))
        found = (
            sequences.select(text.alias("seq"), "weight").where("length(seq) > 1")
            .select(F.explode(F.expr("transform(sequence(1, length(seq) - 1), i -> substring(seq, i, 2))")).alias("pair"), "weight")
            .groupBy("pair").agg(F.sum("weight").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * pairs)
        )
        taken: set[str] = set()
        before = len(rules)
        for row in found.collect():
            if len(rules) - before < pairs and not taken & set(row.pair):
                taken |= set(row.pair)
                rules.append(row.pair)
        if len(rules) == before:
            break
    return tuple(rules)


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of all conversations in order, with ``digest`` (of the text), ``initial``, ``blank`` and ``open`` (last visible character ends no sentence)."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    first = F.substring("role", 1, 1)
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("initial", F.when(first.isin("s", "u", "a"), first).otherwise("o"))
    rows = rows.withColumn("blank", bare == "").withColumn("open", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    return in_order(rows, ["conv_id", "turn", "role", "digest"], "repair-rows")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block of a conversation: its symbols and initials in order and its counts."""
    # The first of equal rows is found by an aggregate, and marked by its place, so that no row that is repeated often makes a hot key.
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first")).select("first")
    facts = rows.select("conv_id", "turn", "at", "initial", "blank", "open").join(firsts, F.col("at") == F.col("first"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    facts = facts.withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return (
        facts.withColumn("symbol", symbol)
        .groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("block"))
        .agg(
            F.sort_array(F.collect_list(F.struct("at", "symbol", "initial"))).alias("rows"),
            *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
            F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
        )
        .select("conv_id", "block", F.concat_ws("", "rows.symbol").alias("seq"), F.concat_ws("", "rows.initial").alias("initials"), "blank", "duplicate", "truncated", "low", "high", "turns")
    )


AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
LEGAL = {"su", "ua", "au"}
MOST = (1 << 63) - 1


class _Sum:
    """A conversation's running result over its blocks."""

    def __init__(self, conv):
        self.conv, self.vector = conv, [(0, Rope()), None, None, None]
        self.counts, self.illegal, self.last = [0, 0, 0], 0, ""
        self.low = self.high = None
        self.turns = 0

    def add(self, r: dict) -> None:
        cells = [None if c < 0 else (c, Rope(a)) for c, a in zip(r["costs"], r["edits"])]
        self.vector = row_times(self.vector, [cells[4 * i : 4 * i + 4] for i in STATES])
        self.counts = [a + r[k] for a, k in zip(self.counts, ("blank", "duplicate", "truncated"))]
        line = self.last + r["initials"]
        self.illegal += sum(line[i : i + 2] not in LEGAL for i in range(len(line) - 1))
        self.last = line[-1]
        if r["low"] is not None:
            self.turns += r["turns"] - (self.high == r["low"])
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def close(self) -> dict:
        end = row_times(self.vector, INSERTIONS)
        cost, audit = better(end[START], end[ASSISTANT])
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, MOST)
        return dict(zip(("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), (self.conv, gaps, *self.counts, self.illegal, cost, str(audit))))


def audits(rows: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> DataFrame:
    """One row per conversation of ``ordered`` rows: counts of faults, illegal neighbours and gaps, least cost, and its edits."""
    blocks = materialize(_blocks(rows), "repair-blocks")
    sequences = materialize(blocks.groupBy("seq").agg(F.count("*").alias("weight")), "repair-sequences")
    rules = learn(sequences, rounds, pairs)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grammar(rules)
        for batch in batches:
            got = [own.block(s) for s in batch.column("seq").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns)) | {
                "costs": pa.array([g[0] for g in got], pa.list_(pa.int64())), "edits": pa.array([g[1] for g in got], pa.list_(pa.string())),
            }
            del columns["seq"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None
        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type)
            done = []
            for r in batch.to_pylist():
                if now is None or now.conv != r["conv_id"]:
                    done += [now.close()] if now else []
                    now = _Sum(r["conv_id"])
                now.add(r)
            yield pa.RecordBatch.from_pylist(done, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.close()], schema)

    made = blocks.mapInArrow(multiply, f"conv_id {kind}, block bigint, initials string, blank bigint, duplicate bigint, truncated bigint, low bigint, high bigint, turns bigint, costs array<bigint>, edits array<string>")
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(fold, f"conv_id {kind}, {AUDIT}")


def _schema(kind: pa.DataType) -> pa.Schema:
    counts = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.schema([("conv_id", kind), *counts, ("audit", pa.string())])


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows of each repaired conversation in order.

    Each conversation's edits come before its rows in the same task, which holds them and one batch of rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    texts = rows.select("conv_id", "at", "turn", "role", "initial", "text", F.lit(None).cast("string").alias("audit"))
    plans = audited.select("conv_id", F.lit(-1).cast("bigint").alias("at"), *[F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("initial", "string"), ("text", "string"))], "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, START, 0
        out: list[tuple] = []

        def emit(edit: str, to: int, turn: int | None, role: str, text: str) -> None:
            nonlocal state, place
            out.append((conv, place, edit, turn, role, text))
            state, place = to, place + 1

        def insert() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                emit("I", NEXT[state], None, NAMES[NEXT[state]], "")

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            for k in range(0, len(batch), 1000):
                for c, place_, turn, role, initial, text, plan in zip(*(x.to_pylist() for x in batch.slice(k, 1000).columns)):
                    if place_ < 0:
                        insert()
                        conv, audit, at, state, place = c, plan, 0, START, 0
                        continue
                    insert()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        emit("K", KEEP[initial][state], turn, role, text)
                    elif edit == "R":
                        emit("R", NEXT[state], turn, NAMES[NEXT[state]], text)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
                out.clear()
        insert()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    both = texts.union(plans).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return both.mapInArrow(run, f"conv_id {kind}, place bigint, edit string, turn bigint, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of ``repaired``, which lie in order in their tasks; only running digests are held."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("repaired_sha256", pa.string())])
            done = []
            for c, place, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    done += [(conv, held.hexdigest())] if held else []
                    conv, held = c, hashlib.sha256()
                held.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], schema.field(k).type) for k in (0, 1)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema.field(0).type), pa.array([held.hexdigest()])], schema=schema)

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of all conversations of ``turns``.

    Rows go by turn, null first; rows of one turn by role and the sha256 of their text.  Null roles and texts are one space; a null
    conversation is one.  Repeated rows are duplicates.  A conversation whose edits delete all rows has an audit and no
    repaired row.  Texts and conversations of any length are taken whole, extra columns are not read, and an empty
    table gives empty tables.  ``gaps`` stops at the largest long.
    """
    rows = ordered(turns, conv, turn, role, text)
    audited = materialize(audits(rows), "repair-audits")
    return audited, repaired(rows, audited)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults by the crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.expr("if(kind = 3, array(0, 1), array(0))")).alias("copy"))
    return rows.drop("copy")


def _oracle() -> str:
    """Row by row with one recursive query, states as columns of cost and edits."""

    def add(v: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {v} IS NOT NULL THEN printf('%010d', CAST(left({v}, 10) AS BIGINT) + {cost}) || substr({v}, 11) || '{edit}' END"

    u = f"least(v.u, {add('v.n', '2', 'I')}, {add('v.s', '2', 'I')}, {add('v.a', '2', 'I')})"
    a = f"least(v.a, {add('v.u', '2', 'I')}, {add('v.n', '4', 'II')}, {add('v.s', '4', 'II')})"
    any_ = "least(c.n, c.s, c.a)"
    crc = (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), "
        "lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, s: CASE WHEN s >= 0 THEN xor(r, s) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295)"
    )
    return rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
          CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
             left(role, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dam),
f0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
             lag(ini) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM o),
f AS (SELECT conv_id, turn, role, text, k, ini, prev, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f0),
v(conv_id, k, n, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '0000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM f
  UNION ALL
  SELECT c.conv_id, c.k + 1, {add('c.n', '3', 'D')},
    least({add('c.s', '3', 'D')}, CASE WHEN c.ini = 's' AND c.free THEN {add('c.n', 'c.p', 'K')} END),
    least({add('c.u', '3', 'D')}, CASE WHEN c.ini = 'u' AND c.free THEN {add(any_, 'c.p', 'K')} END, CASE WHEN c.free THEN {add(any_, '(2 + c.p)', 'R')} END),
    least({add('c.a', '3', 'D')}, CASE WHEN c.ini = 'a' AND c.free THEN {add('c.u', 'c.p', 'K')} END, CASE WHEN c.free THEN {add('c.u', '(2 + c.p)', 'R')} END)
  FROM (SELECT v.conv_id, v.k, v.n, v.s, {u} AS u, {a} AS a, f.ini, f.fault NOT IN ('b', 'd') AS free, CASE WHEN f.fault = 't' THEN 1 ELSE 0 END AS p
        FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.k = v.k + 1) c),
e AS (SELECT v.conv_id, least(v.n, {a}) AS best FROM v
      WHERE v.k = (SELECT max(k) FROM f WHERE f.conv_id IS NOT DISTINCT FROM v.conv_id)),
w(conv_id, audit, i, k, state, out) AS (
  SELECT conv_id, substr(best, 11), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'n', CAST(NULL AS VARCHAR) FROM e
  UNION ALL
  SELECT g.conv_id, g.audit, g.i + 1, CASE WHEN g.e = 'I' THEN g.k ELSE g.k + 1 END,
    CASE g.e WHEN 'D' THEN g.state WHEN 'K' THEN f.ini ELSE CASE WHEN g.state = 'u' THEN 'a' ELSE 'u' END END,
    CASE WHEN g.e = 'D' THEN g.out ELSE coalesce(g.out || chr(10), '') ||
      CASE g.e WHEN 'K' THEN f.role ELSE CASE WHEN g.state = 'u' THEN 'assistant' ELSE 'user' END END || ':' || CASE WHEN g.e = 'I' THEN '' ELSE f.text END END
  FROM (SELECT *, substr(audit, i + 1, 1) AS e FROM w WHERE i < length(audit)) g
  JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.k = least(g.k + 1, (SELECT max(k) FROM f x WHERE x.conv_id IS NOT DISTINCT FROM g.conv_id))),
r AS (SELECT conv_id, audit, sha256(coalesce(out, '')) AS repaired_sha256 FROM w WHERE i = length(audit)),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(t.gaps, 0) AS BIGINT) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated,
  coalesce(t.illegal, 0) AS illegal, coalesce(CAST(left(e.best, 10) AS BIGINT), 0) AS cost, coalesce(r.audit, '') AS audit, coalesce(r.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""


@register("op13_repair", _oracle())
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired at least cost."""
    turns = table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id").cast("bigint"))
    audited, rows = repair(damage(turns))
    made = digests(rows)
    named = lambda t, name: t.withColumnRenamed("conv_id", name)
    out = turns.select("conv_id").distinct()
    out = out.join(named(audited, "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").join(named(made, "by"), F.col("conv_id").eqNullSafe(F.col("by")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
