"""Merkle manifest of a table, proofs climbed by a recursive query.

Leaves are numbered inside their group without one task per group; every ``FAN`` consecutive
digests become a node, level by level, up to each group's root, and the groups' roots likewise
up to one root.  The levels are kept as node rows that name their parent.  A recursive query
then ascends from the leaves: each step joins the node above, appends the siblings met there and
folds the leaf's digest in.  The leaves of one run climb in one row, as they meet the same
siblings from their run upwards.

Near the roots all rows meet few nodes.  Nodes above at least ``n * levels / BROADCAST`` leaves
are at most ``BROADCAST`` in number (the nodes of a level share the n leaves), so they are sent to all tasks;
the nodes below have fewer rows beneath them than that and are joined by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidelearn.llm.order import in_order
from tidelearn.llm.registry import register, table
from tidelearn.session import materialize

#: Children of a node.
FAN = 8
#: Most node rows sent to all tasks (about 700 bytes each).
BROADCAST = 16_384
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """sha256 over the values, each ``-`` if null, else its UTF-8 length, a colon and itself."""
    texts = [v.cast("string") for v in values]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*coded), 256)


@dataclass
class Manifest:
    """``nodes``: (node, parent, pos, tree, level, idx, leaves, children, digest, subroot, root), parents above their
    children; tree -1 is that of the groups' roots.  ``runs``: the lowest nodes with their leaves, ``members`` (idx,
    doc_id, leaf, found) in order.  ``levels``: number of levels, ``n``: number of leaves."""

    nodes: DataFrame
    runs: DataFrame
    levels: int
    n: int


def _linked(rows: DataFrame, level: int, fan: int) -> DataFrame:
    """Adds a row's own name and its place under its parent: in its tree, then in the tree of roots."""
    inside, above = F.col("width") > 1, (F.col("tree") >= 0) & (F.col("trees") > 1)
    name = lambda tree, level, idx: F.concat_ws(".", tree, level, idx)
    return (
        rows.withColumn("node", name(F.col("tree"), F.lit(level), F.col("idx")))
        .withColumn(
            "parent",
            F.when(inside, name(F.col("tree"), F.lit(level + 1), F.expr(f"idx div {fan}"))).when(above, name(F.lit(-1), F.lit(1), F.expr(f"tree div {fan}"))),
        )
        .withColumn("pos", F.when(inside, F.col("idx") % fan).when(above, F.col("tree") % fan).cast("int"))
        .withColumn("subroot", F.when((F.col("tree") >= 0) & ~inside, F.col("digest")))
        .withColumn("root", F.when(F.col("parent").isNull(), F.col("digest")))
        .withColumn("level", F.lit(level))
    )


NODE = ["node", "parent", "pos", "tree", "level", "idx", "width", "trees", "leaves", "children", "digest", "subroot", "root"]


def _above(rows: DataFrame, level: int, fan: int) -> DataFrame:
    """The next level: every ``fan`` consecutive nodes of the trees that still have several."""
    groups = rows.where("width > 1").groupBy("tree", F.expr(f"idx div {fan}").alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("below"),
        F.sum("leaves").alias("leaves"),
        F.expr(f"(max(width) + {fan - 1}) div {fan}").alias("width"),
        F.max("trees").alias("trees"),
    )
    groups = groups.withColumnRenamed("up", "idx").withColumn("children", F.concat_ws("", "below.digest"))
    return _linked(groups.withColumn("digest", F.sha2("children", 256)), level, fan).select(*NODE)


def build(leaves: DataFrame, fan: int = FAN) -> Manifest:
    """Builds all levels over ``leaves`` (lang, doc_id, leaf, found).

    Groups are the values of ``lang`` (null is one, and the first); leaves ascend by doc_id, null first, then by digest, so
    repeated ids and rows have one order.  ``found`` is the digest a leaf has now where it was changed,
    else null; it decides nothing here.  An empty table gives empty tables.
    """
    placed = in_order(leaves, ["lang", "doc_id", "leaf"], "merkle-leaves")
    # Leaves of a group in each range, and in the ranges before it.
    counts = placed.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("lang")
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(
        counts.select("lang", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(group).alias("width")), "merkle-counts"
    )
    # Groups are numbered the same way; the windows without a key run over one row per range.
    groups = in_order(counts.groupBy("lang").agg(F.max("width").alias("width")), ["lang"], "merkle-groups")
    ranges = groups.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", "first", F.coalesce(F.sum("rows").over(every), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("trees"))
    groups = groups.join(ranges, "part").select(F.col("lang").alias("name"), (F.col("before") + F.col("at") - F.col("first")).alias("tree"), "trees")
    offsets = counts.join(groups, F.col("lang").eqNullSafe(F.col("name"))).select(F.col("lang").alias("name"), F.col("part").alias("range"), "first", "before", "width", "tree", "trees")

    numbered = placed.join(offsets, (F.col("part") == F.col("range")) & F.col("lang").eqNullSafe(F.col("name")))
    numbered = numbered.select("tree", "trees", "width", (F.col("before") + F.col("at") - F.col("first")).alias("idx"), "lang", "doc_id", "leaf", "found")
    runs = numbered.groupBy("tree", F.expr(f"idx div {fan}").alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "lang", "doc_id", "leaf", "found"))).alias("members"),
        F.count("*").alias("leaves"),
        F.max("width").alias("below"),
        F.max("trees").alias("trees"),
    )
    runs = runs.select(
        "tree", F.col("run").alias("idx"), "trees", "leaves", "members", F.expr(f"(below + {fan - 1}) div {fan}").alias("width"),
        F.when(F.col("below") > 1, F.concat_ws("", "members.leaf")).otherwise("").alias("children"),
    )
    # A lone leaf is its group's root as it is.
    runs = runs.withColumn("digest", F.when(F.col("children") == "", F.col("members")[0]["leaf"]).otherwise(F.sha2("children", 256)))
    runs = materialize(_linked(runs, 1, fan).select(*NODE, "members"), "merkle-runs")

    size = counts.agg(F.sum(F.when(F.col("before") == 0, F.col("width"))), F.max("width")).first()
    n, widest = size[0] or 0, size[1] or 0
    levels = [runs.select(*NODE)]
    widest = -(-widest // fan)
    while widest > 1:
        levels.append(materialize(_above(levels[-1], len(levels) + 1, fan), "merkle-level"))
        widest = -(-widest // fan)
    tops = levels[0].where("subroot is not null")
    for level in levels[1:]:
        tops = tops.union(level.where("subroot is not null"))
    tops = materialize(tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("width"), F.lit(1).cast("long").alias("trees"), "leaves", "digest"), "merkle-roots")
    widest, level = (tops.agg(F.max("width")).first()[0] or 0), 1
    below = tops
    while widest > 1:
        below = materialize(_above(below, level, fan), "merkle-level")
        levels.append(below)
        widest, level = -(-widest // fan), level + 1
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.union(more)
    return Manifest(nodes, runs, len(levels), n)


def _others(children: str, pos: str) -> tuple[str, str]:
    return f"substring({children}, 1, {HEX} * {pos})", f"substring({children}, {HEX} * ({pos} + 1) + 1)"


def _ascend(starts: DataFrame, nodes: DataFrame, hint: str = "") -> DataFrame:
    """All steps of a recursive climb from ``starts`` through ``nodes``, the start rows included."""
    left, right = _others("n.children", "c.pos")
    return nodes.sparkSession.sql(
        f"""
        WITH RECURSIVE climb AS (
          SELECT run, node, pos, near, folded, siblings, subroot, root FROM {{starts}}
          UNION ALL
          SELECT {hint} c.run, n.parent, n.pos, n.near, transform(c.folded, f -> sha2(concat({left}, f, {right}), 256)),
                 concat(c.siblings, unhex(concat({left}, {right}))), coalesce(c.subroot, n.subroot), coalesce(c.root, n.root)
          FROM climb c JOIN {{nodes}} n ON c.node = n.node)
        SELECT * FROM climb LIMIT ALL""",
        starts=starts,
        nodes=nodes,
    )


def climb(manifest: Manifest, broadcast: int = BROADCAST) -> DataFrame:
    """One row per leaf: doc_id, lang, leaf, found, subroot, root, siblings (hex digests behind one another, from the leaf's
    run to the root, left to right) and folded, the root that the found (else the original) leaf leads to."""
    near = max(1, -(-manifest.n * manifest.levels // broadcast))
    nodes, runs = manifest.nodes, manifest.runs
    parents = nodes.select(F.col("node").alias("up"), (F.col("leaves") < near).alias("near"))
    left, right = _others("children", "i")
    fold = f"transform(members, (m, i) -> if(children = '', coalesce(m.found, m.leaf), sha2(concat({left}, coalesce(m.found, m.leaf), {right}), 256)))"
    starts = runs.join(parents, F.col("parent") == F.col("up"), "left").select(
        F.col("node").alias("run"), F.col("parent").alias("node"), "pos", F.coalesce("near", F.lit(False)).alias("near"),
        F.expr(fold).alias("folded"), F.expr("X''").alias("siblings"), "subroot", "root",
    )
    inner = nodes.where("tree < 0 or level > 1").join(parents, F.col("parent") == F.col("up"), "left")
    inner = inner.select("node", "parent", "pos", F.coalesce("near", F.lit(False)).alias("near"), "children", "subroot", "root", "leaves")
    inner, starts = materialize(inner, "merkle-nodes"), materialize(starts, "merkle-starts")
    if near > 1:
        low = _ascend(starts, inner.where(F.col("leaves") < near).drop("leaves"))
        starts = materialize(low.where("not near"), "merkle-low")
    ends = _ascend(starts, inner.where(F.col("leaves") >= near).drop("leaves"), "/*+ BROADCAST(n) */").where("node is null")
    ends = ends.select(F.col("run").alias("of"), "folded", "siblings", F.col("subroot").alias("sub"), F.col("root").alias("top"))
    joined = runs.join(ends, F.col("node") == F.col("of"))
    each = joined.select("children", "siblings", "sub", "top", F.posexplode(F.arrays_zip("members", "folded")).alias("i", "m"))
    return each.select(
        F.col("m.members.doc_id").alias("doc_id"), F.col("m.members.lang").alias("lang"), F.col("m.members.leaf").alias("leaf"), F.col("m.members.found").alias("found"),
        F.col("sub").alias("subroot"), F.col("top").alias("root"),
        F.expr(f"concat({left}, {right}, lower(hex(siblings)))").alias("siblings"), F.col("m.folded").alias("folded"),
    )


def verify(docs: DataFrame, now: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", fan: int = FAN) -> DataFrame:
    """Builds the manifest of ``docs`` and climbs it with the rows as they are now.

    ``now`` gives columns that have other values now, by name; a null value of such an expression is a null.  Only ``columns``
    are hashed and read.  Rows: those of ``climb`` and ``verified``, whether the climb ends in the root.  Nulls are values
    of their own; repeated rows are leaves each; texts are hashed whole; a single row is its own root with no siblings; an
    empty table gives no rows.
    """
    now = now or {}
    original = leaf_digest([F.col(c) for c in columns])
    found = leaf_digest([now.get(c, F.col(c)) for c in columns])
    rows = docs.select(F.col(group).alias("lang"), F.col(order).alias("doc_id"), original.alias("leaf"), found.alias("found"))
    # Unchanged rows need no second digest from here on.
    rows = rows.select("lang", "doc_id", "leaf", F.when(F.col("found") != F.col("leaf"), F.col("found")).alias("found"))
    return climb(build(materialize(rows, "merkle-digests"), fan)).withColumn("verified", F.col("folded") == F.col("root"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: per character its code, then eight shifts (-1)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda r, s: CASE WHEN s >= 0 THEN xor(r, s) "
        "ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295)"
    )


def _oracle(depth: int = 9, fan: int = FAN) -> str:
    """The same digests with one common table expression per level; trees of up to ``fan ** depth`` leaves."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(enc(c) for c in COLUMNS[:-1])
    lowered = f"translate(text, '{LETTERS}', '{LETTERS.lower()}')"
    tampered = f"CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {lowered} ELSE text END"
    parts = [
        f"rows AS (SELECT doc_id, lang, sha256({head} || {enc('text')}) AS leaf, sha256({head} || {enc(f'({tampered})')}) AS found FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p0, row_number() OVER () AS id FROM rows)",
        "a0 AS (SELECT lang AS tree, p0 AS p, leaf AS h, count(*) OVER (PARTITION BY lang) AS width FROM leaves)",
    ]

    def grow(name: str, k: int) -> str:
        return (
            f"{name}{k} AS (SELECT tree, p // {fan} AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, (any_value(width) + {fan - 1}) // {fan} AS width "
            f"FROM {name}{k - 1} WHERE width > 1 GROUP BY tree, p // {fan})"
        )

    parts += [grow("a", k) for k in range(1, depth + 1)]
    roots = " UNION ALL ".join(f"SELECT tree AS lang, h FROM a{k} WHERE width = 1" for k in range(depth + 1))
    parts.append(f"subs AS ({roots})")
    parts.append("b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, h, count(*) OVER () AS width, lang FROM subs)")
    parts += [grow("b", k) for k in range(1, depth + 1)]
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{k} WHERE width = 1" for k in range(depth + 1)) + ")")
    parts.append("c0 AS (SELECT l.id, l.lang, l.doc_id, l.leaf, l.p0 AS p, l.found AS folded, '' AS proof FROM leaves l)")

    def fold(k: int, trees: str, name: str, same: str) -> str:
        side = f"{trees}{k}"
        return (
            f"{name} AS (SELECT c.id, any_value(c.lang) AS lang, any_value(c.doc_id) AS doc_id, any_value(c.leaf) AS leaf, any_value(c.p) // {fan} AS p, "
            f"CASE WHEN max(s.width) > 1 THEN sha256(string_agg(CASE WHEN s.p = c.p THEN c.folded ELSE s.h END, '' ORDER BY s.p)) ELSE any_value(c.folded) END AS folded, "
            f"any_value(c.proof) || coalesce(string_agg(s.h, '' ORDER BY s.p) FILTER (s.p <> c.p AND s.width > 1), '') AS proof "
            f"FROM {{last}} c LEFT JOIN {side} s ON {same} AND s.p // {fan} = c.p // {fan} GROUP BY c.id)"
        )

    last = "c0"
    for k in range(depth):
        parts.append(fold(k, "a", f"c{k + 1}", "s.tree IS NOT DISTINCT FROM c.lang").replace("{last}", last))
        last = f"c{k + 1}"
    parts.append(f"d0 AS (SELECT c.id, c.lang, c.doc_id, c.leaf, b.p, c.folded, c.proof FROM {last} c JOIN b0 b ON b.lang IS NOT DISTINCT FROM c.lang)")
    last = "d0"
    for k in range(depth):
        parts.append(fold(k, "b", f"d{k + 1}", "s.tree = 0").replace("{last}", last))
        last = f"d{k + 1}"
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT d.doc_id, d.leaf, s.h AS subroot, r.root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = r.root AS verified "
        f"FROM {last} d JOIN subs s ON s.lang IS NOT DISTINCT FROM d.lang, root r"
    )


@register("op11_merkle", _oracle())
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, checked against rows whose text lost its capitals where 3 divides the id's crc32."""
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    now = {"text": F.when(changed, F.translate("text", LETTERS, LETTERS.lower())).otherwise(F.col("text"))}
    out = verify(docs, now)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")
