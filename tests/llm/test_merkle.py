"""Merkle manifests against a plain loop."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidelearn.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fan=8):
    """(root, proof per leaf): the siblings of each leaf, level by level."""
    proofs, at, level = ["" for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for k, p in enumerate(at):
            run = runs[p // fan]
            proofs[k] += "".join(run[: p % fan] + run[p % fan + 1 :])
        level, at = [h("".join(r)) for r in runs], [p // fan for p in at]
    return level[0], proofs


def plain(rows, lowered, fan=8):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        parts[lang] = own, *tree([leaf(r) for r in own], fan)
    root, above = tree([parts[x][1] for x in langs], fan)
    out = []
    for lang, upper in zip(langs, above):
        own, sub, proofs = parts[lang]
        for r, proof in zip(own, proofs):
            text = r[4]
            changed = lowered(r) and text is not None and any("A" <= c <= "Z" for c in text)
            out.append((r[0], leaf(r), sub, root, h(proof + upper), not changed))
    return sorted(out, key=repr)


def run(docs, lowered=None):
    now = {"text": F.when(lowered, F.translate("text", merkle.LETTERS, merkle.LETTERS.lower())).otherwise(F.col("text"))} if lowered is not None else None
    got = merkle.verify(docs, now).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "verified").collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (8,), (9, 1), (64, 65, 1, 2, 3, 4, 5, 6, 7, 8), (700, 1)])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(i * 7 % 997 - 5, "s", None if g == 1 else f"l{g}", i, f"Text {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert run(docs, F.col("doc_id") % 3 == 0) == plain(rows, lambda r: r[0] % 3 == 0)


def test_nulls_repeats_ties_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "s", "en", 2, "A"), (1, "s", "en", 2, "A"), (1, "t", "en", None, ""), (2, "", "", 0, "é😀" * 9000), (-4, "-", "en", 1, "-"), (3, "s", "é", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("leaf", "found", "at", "part", "tree", "idx", "node", "width", "digest", "members", "children", "root"):
        docs = docs.withColumn(name, F.lit("x"))
    assert run(docs, F.lit(True)) == plain(rows, lambda r: True)
    assert all(r[5] for r in run(docs))
    assert run(docs.where("false")) == []


def test_a_tampered_row_only_fails_itself(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(200)]
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA), {"n_chars": F.when(F.col("doc_id") == 77, F.lit(None)).otherwise(F.col("n_chars"))}).collect()
    assert [r.doc_id for r in got if not r.verified] == [77]


def test_far_and_near_nodes_give_the_same(spark):
    """With few nodes sent to all tasks the lower levels are climbed by key joins."""
    rows = [(i, "s", f"l{i % 3}", i, f"Text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    digest = merkle.leaf_digest([F.col(c) for c in merkle.COLUMNS])
    made = merkle.build(docs.select("lang", "doc_id", digest.alias("leaf"), F.lit(None).cast("string").alias("found")))
    some, every = (merkle.climb(made, b).drop("found").collect() for b in (40, 10_000))
    assert sorted(some) == sorted(every) and len(some) == 600 and all(r.folded == r.root for r in some)
    nodes = made.nodes.collect()
    names = {n.node: n for n in nodes}
    assert len(names) == len(nodes) and sum(n.parent is None for n in nodes) == 1
    for n in nodes:
        if n.parent is not None:
            up = names[n.parent]
            assert up.children[64 * n.pos : 64 * n.pos + 64] == n.digest
