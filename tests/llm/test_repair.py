"""Conversation repair against an exhaustive row-by-row search."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidelearn.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows, kinds):
    """Least (cost, audit, lines) over all edits, by states; strings are compared whole."""
    best = {"": (0, "", ())}

    def insertions():
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for to in "ua":
                    if to in STEP[state]:
                        cell = (cost + 2, audit + "I", (*lines, NAMES[to] + ":"))
                        best[to] = min(best.get(to, cell), cell)

    for (_, role, text), kind in zip(rows, kinds):
        insertions()
        now = {}

        def put(state, cell):
            now[state] = min(now.get(state, cell), cell)

        cut = int(kind == "truncated")
        for state, (cost, audit, lines) in best.items():
            put(state, (cost + 3, audit + "D", lines))
            if kind not in ("blank", "duplicate"):
                if role[:1] in STEP[state]:
                    put(STEP[state][role[:1]], (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                for to in "ua":
                    if to in STEP[state]:
                        put(to, (cost + 2 + cut, audit + "R", (*lines, f"{NAMES[to]}:{text}")))
        best = now
    insertions()
    return min(best[s] for s in ("", "a") if s in best)


def plain(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = [(t[1], " " if t[2] is None else t[2], " " if t[3] is None else t[3]) for t in turns if t[0] == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        kinds = faults(rows)
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = search(rows, kinds)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def run(turns):
    audited, rows = repair.repair(turns)
    shas = {r.conv_id: r.repaired_sha256 for r in repair.digests(rows).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = audited.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (*tuple(r)[1:], shas.get(r.conv_id, empty)) for r in got}


def conversations(seed, n, length, texts=("Yes.", "no", "", "Well?", " ", "x!\n", "y ")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice([*texts, f"t{t}."])) for c in range(n) for t in range(rng.randint(1, length))]


def test_random_conversations(spark):
    turns = conversations(1, 120, 9) + [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (500, None, "user", "q?"), (500, None, None, None), (501, 0, "tool", "")]
    frame = spark.createDataFrame(turns, SCHEMA).repartition(3)
    for name in ("at", "part", "seq", "block", "digest", "initial", "audit", "symbol", "edit", "place"):
        frame = frame.withColumn(name, F.lit("x"))
    assert run(frame) == plain(turns)
    assert run(frame.where("false")) == {}


def test_blocks_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)
    turns = conversations(2, 3, 900, ("Yes.", "no", "", "Well?")) + conversations(3, 20, 5)[:40]
    turns = [(c, t, r, f"{x}{i}." if x else x) for i, (c, t, r, x) in enumerate(turns)]
    assert run(spark.createDataFrame(turns, SCHEMA).repartition(4)) == plain(turns)


def test_rules_do_not_change_matrices():
    rng = random.Random(4)
    pairs = ("ua", "xU", chr(repair.FIRST_RULE) * 2, chr(repair.FIRST_RULE + 2) + "s")
    with_rules, without = repair.grammar(pairs), repair.grammar(())
    for n in range(1, 40):
        sequence = "".join(rng.choice("xsuaoSUAOuaua") for _ in range(n))
        assert with_rules.block(sequence) == without.block(sequence)


def test_grammar_learns_frequent_pairs(spark):
    seqs = spark.createDataFrame([("uauaua", 5), ("sua", 3), ("xo", 1)], "seq string, weight long")
    rules = repair.learn(seqs)
    assert rules[0] == "ua" and "xo" not in rules
    assert repair.learn(seqs.where("false")) == ()


def test_ropes_compare_as_strings():
    rng = random.Random(7)
    for _ in range(400):
        strings = ["".join(rng.choice("DIK") for _ in range(rng.randint(0, 50))) for _ in range(2)]
        if rng.random() < 0.5:
            strings[1] = strings[0][: rng.randint(0, 50)] + strings[1][:3]
        ropes = []
        for s in strings:
            rope, k = repair.Rope(), 0
            while k < len(s):
                step = rng.randint(1, 9)
                rope, k = rope + repair.Rope(s[k : k + step]), k + step
            ropes.append(rope)
        assert [str(r) for r in ropes] == strings
        assert ropes[0].less(ropes[1]) == (strings[0] < strings[1])


@pytest.mark.parametrize("kinds", itertools.product("suao", repeat=3))
def test_every_short_order(kinds):
    own = repair.grammar(("ua",))
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    rows = [(t, names[k], f"t{t}.") for t, k in enumerate(kinds)]
    costs, edits = own.block("".join(kinds))
    total = repair._Sum(0)
    total.add({"costs": costs, "edits": edits, "blank": 0, "duplicate": 0, "truncated": 0, "initials": "".join(kinds), "low": 0, "high": 2, "turns": 3})
    end = total.close()
    assert (end["cost"], end["audit"]) == search(rows, [None] * 3)[:2]


def test_damage(spark):
    turns = spark.createDataFrame([(c, t, "assistant", f"Say. {t}!") for c in range(40) for t in range(5)] + [(None, None, None, None)], SCHEMA)
    import zlib

    want = []
    for c, t, role, text in [tuple(r) for r in turns.collect()]:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role or " ", {1: "", 2: (text or " ").replace(".", "").replace("!", "")}.get(kind, text or " "))
        want += [] if kind == 0 else [row, row] if kind == 3 else [row]
    assert sorted(map(tuple, repair.damage(turns).collect()), key=repr) == sorted(want, key=repr)
