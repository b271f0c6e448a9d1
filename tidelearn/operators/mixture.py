"""Mixture components against rows: densities, matching and window statistics.

A model is one row ``(model_id, n, comps)``; ``comps`` is bounded by the
``max_components`` of the learner.  Rows meet their model's components in
place, so no row is repeated per component before a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelearn.functions import gaussian as g
from tidelearn.functions.vectors import triangle
from tidelearn.session import tasks

KEY = ["model_id"]
# Widths up to this have their quadratic form written out term by term.
UNROLL = 8
# Numbers in all components together that may be sent to every task: 32 MB.
SENT_CELLS = 4_000_000
# Numbers one step of a batch may gather.
BATCH_CELLS = 4_000_000
# Models, or rows of their statistics, that are Python objects at a time.
MODELS = 256
COMPONENT = (
    "struct<id:bigint,tau:double,c:double,mu:array<double>,sigma:array<double>,label:int,"
    "prec:array<double>,white:array<array<double>>,logdet:double>"
)
PARTS = ["id", "tau", "c", "mu", "sigma", "label"]


def per_model(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Apply ``fn`` to each model row; each is small, and rows stay spread over tasks."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), MODELS):
                rows = [out for row in batch.slice(low, MODELS).to_pylist() for out in fn(row)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.repartition(tasks(df.sparkSession), *KEY).mapInArrow(run, schema)


def model_type(df: DataFrame) -> str:
    return dict(df.dtypes)["model_id"]


def state_schema(df: DataFrame) -> str:
    return f"model_id {model_type(df)}, n bigint, comps array<{COMPONENT}>"


def pack_components(components: DataFrame, most: int) -> DataFrame:
    """Component rows to model rows.

    A model with more than ``most`` components is an error.  The check runs on
    the sorted rows, before any of them are gathered.
    """
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    checked = components.withColumn("_at", place).withColumn(
        "id",
        F.when(F.col("_at") <= most, F.col("id")).otherwise(
            F.raise_error(F.lit(f"a mixture model has more than {most} components")).cast("long")
        ),
    )
    # The error must not be optimised away with an unused column, so it sits in ``id``.
    lists = checked.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*PARTS))).alias("comps"))
    lists = lists.withColumn("n", F.lit(0).cast("long"))
    return per_model(
        lists,
        lambda row: [{**row, "comps": [g.with_precision(c) for c in row["comps"]]}],
        state_schema(components),
    )


def unpack_components(state: DataFrame) -> DataFrame:
    """Model rows to component rows."""
    flat = state.select(*KEY, F.explode("comps").alias("c"))
    return flat.select(*KEY, *[F.col(f"c.{p}").alias(p) for p in PARTS])


def squared_distance(x: Column, c: Column, d: int) -> Column:
    """Squared Mahalanobis distance of ``x`` from component ``c``."""
    if d <= UNROLL:
        out = F.lit(0.0)
        for k, (i, j) in enumerate(triangle(d)):
            term = c["prec"][k] * (x[i] - c["mu"][i]) * (x[j] - c["mu"][j])
            out = out + (term if i == j else 2.0 * term)
        return out
    gap = F.zip_with(x, c["mu"], lambda a, b: a - b)

    def square(row: Column) -> Column:
        v = F.aggregate(F.zip_with(row, gap, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
        return v * v

    return F.aggregate(F.transform(c["white"], square), F.lit(0.0), lambda s, t: s + t)


class Matcher:
    """Rows against the components of their model.

    Components of a checked total size are sent to the tasks and rows are
    evaluated in Arrow batches.  Larger tables of models are joined to the rows
    by model and evaluated by column expressions; both give the same results.
    """

    def __init__(self, state: DataFrame, params, limit: int = SENT_CELLS):
        self.state, self.p = state, params
        d = params.dimension
        # Tables are as wide as the largest model.
        held = state.select(F.coalesce(F.count(F.lit(1)) * F.max(F.size("comps")), F.lit(0))).first()[0]
        self.sent = held * (d * d + d + 4) <= limit
        if self.sent:
            rows = state.select(*KEY, "comps").collect()
            self.packet = state.sparkSession.sparkContext.broadcast(_tables(rows, d))

    # Every method keeps the rows' other columns.

    def evaluate(self, rows: DataFrame) -> DataFrame:
        """Add ``fits``: id, distance and density of every component of the row's model."""
        if not self.sent:
            kept = F.transform("fits", lambda f: F.struct(f["id"], f["distance"], f["density"]))
            return self._joined(rows).withColumn("fits", kept)
        packet, d = self.packet, self.p.dimension

        @F.pandas_udf("struct<id:array<bigint>,distance:array<double>,density:array<double>>")
        def fit(model: pd.Series, x: pd.Series) -> pd.DataFrame:
            t = packet.value
            at, dist, dens = _fit(t, model, x, d)
            ok = [t["valid"][i] for i in at]
            return pd.DataFrame({
                "id": [t["id"][i][m] for i, m in zip(at, ok)],
                "distance": [r[m] for r, m in zip(dist, ok)],
                "density": [r[m] for r, m in zip(dens, ok)],
            })

        known = self._known(rows).withColumn("_f", fit("model_id", "features"))
        return known.withColumn("fits", F.arrays_zip("_f.id", "_f.distance", "_f.density")).drop("_f")

    def match(self, rows: DataFrame) -> DataFrame:
        """Add ``situation`` and the id of the best component inside the gate.

        1: the best component is unlabelled; 2: none is near or its label
        differs; 3: the labels agree.
        """
        p = self.p
        if not self.sent:
            return self._matched_joined(rows).drop("fits")
        packet = self.packet

        @F.pandas_udf("struct<situation:int,id:bigint>")
        def best(model: pd.Series, x: pd.Series, label: pd.Series) -> pd.DataFrame:
            t = packet.value
            at, dist, dens = _fit(t, model, x, p.dimension)
            situation, k = _situations(t, at, dist, dens, label.to_numpy(), p.gate)
            ids = pd.array(t["id"][at, np.maximum(k, 0)], dtype="Int64")
            ids[k < 0] = pd.NA
            return pd.DataFrame({"situation": situation, "id": ids})

        known = self._known(rows).withColumn("_b", best("model_id", "features", F.col("label").cast("int")))
        return known.withColumn("situation", F.col("_b.situation")).withColumn("id", F.col("_b.id")).drop("_b")

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction``: the label of the densest labelled component, -1 where there is none."""
        if not self.sent:
            labelled = F.filter("fits", lambda f: f["label"] != 0)
            out = F.coalesce(_densest(labelled)["label"], F.lit(-1)).cast("double")
            return self._joined(rows).withColumn("prediction", out).drop("fits")
        packet, d = self.packet, self.p.dimension

        @F.pandas_udf("double")
        def label(model: pd.Series, x: pd.Series) -> pd.Series:
            t = packet.value
            at, _, dens = _fit(t, model, x, d)
            dens = np.where(t["valid"][at] & (t["label"][at] != 0), dens, -1.0)
            k = dens.argmax(axis=1)
            n = np.arange(len(k))
            return pd.Series(np.where(dens[n, k] < 0, -1, t["label"][at, k]).astype(float))

        return self._known(rows).withColumn("prediction", label("model_id", "features"))

    def window_stats(self, rows: DataFrame) -> DataFrame:
        """What one window of labelled rows tells each model, one row per model.

        Rows give their responsibilities (situation 3), a label for their
        component (1) or a place for a new one (2).
        """
        parts = self._parts_sent(rows) if self.sent else self._parts_joined(rows)
        # A model holds at most ``max_components``, so no more new places than
        # that can be used; the other kinds have at most one entry per component.
        order = Window.partitionBy(*KEY, "situation").orderBy("first_seq", "key")
        usable = parts.withColumn("_at", F.row_number().over(order)).withColumn(
            "_kept", (F.col("situation") != 2) | (F.col("_at") <= self.p.max_components)
        )
        entry = F.struct("situation", "first_seq", "key", "q", "first_label", "qx", "qxx", "x")
        return usable.groupBy(*KEY).agg(
            F.sum("rows").alias("m"),
            F.sum(F.when(F.col("situation") == 3, F.col("rows"))).alias("rows3"),
            F.array_sort(F.collect_list(F.when(F.col("_kept"), entry))).alias("entries"),
        )

    def _known(self, rows: DataFrame) -> DataFrame:
        """Rows whose model exists."""
        names = self.packet.value["models"]
        return rows.filter(F.col("model_id").isin(names)) if len(names) <= 100 else rows.join(
            self.state.select(*KEY), KEY, "left_semi"
        )

    def _parts_sent(self, rows: DataFrame) -> DataFrame:
        packet, p = self.packet, self.p
        d = p.dimension
        upper = np.triu_indices(d)
        kind = model_type(rows)
        out = (f"model_id {kind}, situation int, key bigint, rows bigint, q double, first_seq bigint, first_label int, "
               "qx array<double>, qxx array<double>, x array<double>")

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = packet.value
            m, k = t["valid"].shape
            q_sum, n_rows = np.zeros((m, k)), np.zeros((m, k), dtype="int64")
            x_sum, s_sum = np.zeros((m, k, d)), np.zeros((m, k, len(upper[0])))
            first = np.full(m, np.iinfo("int64").max)
            models = np.array(t["models"], dtype=object)
            zero_x, zero_s = np.zeros(d), np.zeros(len(upper[0]))
            for pdf in batches:
                at, dist, dens = _fit(t, pdf["model_id"], pdf["features"], d)
                label, seq = pdf["label"].to_numpy(), pdf["seq"].to_numpy()
                situation, best = _situations(t, at, dist, dens, label, p.gate)
                x = np.stack(pdf["features"].to_numpy())
                em = np.flatnonzero(situation == 3)
                if len(em):
                    a = at[em]
                    pull = np.where(t["valid"][a] & (dist[em] < p.gate), t["tau"][a] * dens[em], 0.0)
                    whole = pull.sum(axis=1)[:, None]
                    q = pull / np.where(whole > 0, whole, 1.0)
                    gap = x[em][:, None, :] - t["mu"][a]
                    np.add.at(q_sum, a, q)
                    np.add.at(x_sum, a, q[:, :, None] * x[em][:, None, :])
                    np.add.at(s_sum, a, q[:, :, None] * (gap[:, :, upper[0]] * gap[:, :, upper[1]]))
                    # Each row is counted once, at its best component.
                    np.add.at(n_rows, (a, best[em]), 1)
                    np.minimum.at(first, a, seq[em])
                rest = np.flatnonzero(situation != 3)
                if len(rest):
                    key = np.where(situation[rest] == 1, t["id"][at[rest], np.maximum(best[rest], 0)], label[rest])
                    part = pd.DataFrame({
                        "model_id": pdf["model_id"].to_numpy()[rest], "situation": situation[rest], "key": key,
                        "first_seq": seq[rest], "first_label": label[rest], "row": rest,
                    }).sort_values("first_seq")
                    by = ["model_id", "situation", "key"]
                    counts = part.groupby(by, sort=False).size().rename("rows").reset_index()
                    lead = part.drop_duplicates(by).merge(counts, on=by)
                    lead["q"] = lead["rows"].astype(float)
                    lead["qx"], lead["qxx"] = [zero_x] * len(lead), [zero_s] * len(lead)
                    lead["x"] = list(x[lead["row"].to_numpy()])
                    yield lead[[c.strip().split(" ")[0] for c in out.split(", ")]]
            used = np.nonzero(q_sum)
            for low in range(0, len(used[0]), MODELS):
                i, j = (u[low : low + MODELS] for u in used)
                yield pd.DataFrame({
                    "model_id": models[i], "situation": 3, "key": t["id"][i, j], "rows": n_rows[i, j], "q": q_sum[i, j],
                    "first_seq": first[i], "first_label": 0, "qx": list(x_sum[i, j]), "qxx": list(s_sum[i, j]),
                    "x": [zero_x] * len(i),
                })

        wanted = self._known(rows).select(*KEY, "seq", F.col("label").cast("int").alias("label"), "features")
        notes = wanted.mapInPandas(partial, out)
        sums = [F.sum(F.col("qx")[i]).alias(f"s_{i}") for i in range(d)]
        sums += [F.sum(F.col("qxx")[i]).alias(f"t_{i}") for i in range(len(upper[0]))]
        places = [F.min_by(F.col("x")[i], "first_seq").alias(f"x_{i}") for i in range(d)]
        grouped = notes.groupBy(*KEY, "situation", "key").agg(
            F.sum("rows").alias("rows"), F.sum("q").alias("q"), F.min_by("first_label", "first_seq").alias("first_label"),
            F.min("first_seq").alias("first_seq"), *sums, *places,
        )
        return self._pack_parts(grouped)

    def _pack_parts(self, grouped: DataFrame) -> DataFrame:
        d = self.p.dimension
        return grouped.select(
            *KEY, "situation", "key", "rows", "q", "first_seq", "first_label",
            F.array(*[F.col(f"s_{i}") for i in range(d)]).alias("qx"),
            F.array(*[F.col(f"t_{i}") for i in range(len(triangle(d)))]).alias("qxx"),
            F.array(*[F.col(f"x_{i}") for i in range(d)]).alias("x"),
        )

    # Models too many to send: components joined to the rows.

    def _joined(self, rows: DataFrame) -> DataFrame:
        d = self.p.dimension
        x, const = F.col("features"), d * math.log(2.0 * math.pi)

        def fit(c: Column) -> Column:
            dist = squared_distance(x, c, d)
            return F.struct(
                c["id"].alias("id"), c["label"].alias("label"), c["tau"].alias("tau"), c["mu"].alias("mu"),
                F.sqrt(dist).alias("distance"), F.exp(-0.5 * (dist + c["logdet"] + const)).alias("density"),
            )

        joined = rows.join(self.state.select(*KEY, "comps"), KEY)
        return joined.withColumn("fits", F.transform("comps", fit)).drop("comps")

    def _matched_joined(self, rows: DataFrame) -> DataFrame:
        gate = self.p.gate
        best = self._joined(rows).withColumn("_best", _densest(F.filter("fits", lambda f: f["distance"] < gate)))
        b = F.col("_best")
        situation = (
            F.when(b.isNull(), 2).when(b["label"] == 0, 1).when(b["label"].eqNullSafe(F.col("label").cast("int")), 3).otherwise(2)
        )
        return best.withColumn("situation", situation).withColumn("id", b["id"]).drop("_best")

    def _parts_joined(self, rows: DataFrame) -> DataFrame:
        d, gate = self.p.dimension, self.p.gate
        x = F.col("features")
        near = F.filter("fits", lambda f: (f["distance"] < gate) & (f["density"] > 0))
        total = F.aggregate(near, F.lit(0.0), lambda s, f: s + f["tau"] * f["density"])
        none = F.array_repeat(F.lit(0.0), d)

        def note(key: Column, q: Column, mu: Column, counts: Column) -> Column:
            return F.struct(
                key.cast("long").alias("key"), q.alias("q"), mu.alias("mu"), counts.cast("long").alias("rows")
            )

        shares = F.transform(
            near, lambda f: note(f["id"], f["tau"] * f["density"] / F.col("_total"), f["mu"], f["id"] == F.col("id"))
        )
        own = F.when(F.col("situation") == 1, F.array(note(F.col("id"), F.lit(1.0), none, F.lit(1))))
        new = F.when(F.col("situation") == 2, F.array(note(F.col("label"), F.lit(1.0), none, F.lit(1))))
        notes = self._matched_joined(rows).withColumn("_total", total).select(
            *KEY, "situation", "seq", F.col("label").cast("int").alias("label"), "features",
            F.explode(F.when(F.col("situation") == 3, shares).otherwise(F.coalesce(own, new))).alias("e"),
        )
        q, mu = F.col("e.q"), F.col("e.mu")
        sums = [F.sum(q * x[i]).alias(f"s_{i}") for i in range(d)]
        sums += [F.sum(q * (x[i] - mu[i]) * (x[j] - mu[j])).alias(f"t_{k}") for k, (i, j) in enumerate(triangle(d))]
        places = [F.min_by(x[i], "seq").alias(f"x_{i}") for i in range(d)]
        grouped = notes.groupBy(*KEY, "situation", F.col("e.key").alias("key")).agg(
            F.sum("e.rows").alias("rows"), F.sum(q).alias("q"), F.min("seq").alias("first_seq"),
            F.min_by("label", "seq").alias("first_label"), *sums, *places,
        )
        return self._pack_parts(grouped)


def _densest(fits: Column) -> Column:
    """Struct of the component with the largest density, the smaller id on ties; null for none."""
    return F.array_max(F.transform(fits, lambda f: F.struct(f["density"], (-f["id"]).alias("minus"), f["label"], f["id"])))


def _tables(rows: list, d: int) -> dict:
    """Components of all models as arrays ``models x components``, in id order."""
    models = [r["model_id"] for r in rows]
    most = max([len(r["comps"]) for r in rows], default=0) or 1
    m = len(models)
    t = {
        "models": models, "index": pd.Index(models), "valid": np.zeros((m, most), dtype=bool),
        "id": np.zeros((m, most), dtype="int64"), "label": np.zeros((m, most), dtype="int64"),
        "tau": np.zeros((m, most)), "logdet": np.zeros((m, most)),
        "mu": np.zeros((m, most, d)), "prec": np.zeros((m, most, d, d)),
    }
    for i, r in enumerate(rows):
        for k, c in enumerate(sorted(r["comps"], key=lambda c: c["id"])):
            t["valid"][i, k] = True
            for name in ("id", "label", "tau", "logdet", "mu"):
                t[name][i, k] = c[name]
            t["prec"][i, k] = g.full(c["prec"], d)
    return t


def _fit(t: dict, model: pd.Series, x: pd.Series, d: int):
    """Model place, distances and densities (rows x components) of a batch."""
    at = t["index"].get_indexer(model)
    return _fit_at(t, at, np.stack(x.to_numpy()) if len(at) else np.empty((0, d)), d)


def _fit_at(t: dict, at: np.ndarray, points: np.ndarray, d: int):
    most = t["valid"].shape[1]
    dist, n = np.empty((len(at), most)), len(at)
    step = max(1, BATCH_CELLS // (most * d * d))
    for s in range(0, n, step):
        a = at[s : s + step]
        gap = points[s : s + step, None, :] - t["mu"][a]
        dist[s : s + step] = np.einsum("nki,nkij,nkj->nk", gap, t["prec"][a], gap)
    dens = np.exp(-0.5 * (dist + t["logdet"][at] + d * math.log(2.0 * math.pi)))
    return at, np.sqrt(np.maximum(dist, 0.0)), dens


def window_entries(comps: list[dict], points: np.ndarray, label: np.ndarray, seq: np.ndarray, p) -> tuple[int, list[dict]]:
    """What :meth:`Matcher.window_stats` tells of one model's window: rows of situation 3, and the entries."""
    d = p.dimension
    t = _tables([{"model_id": 0, "comps": comps}], d)
    upper = np.triu_indices(d)
    order = np.argsort(seq, kind="stable")
    points, label, seq = points[order], label[order], seq[order]
    at, dist, dens = _fit_at(t, np.zeros(len(points), dtype="int64"), points, d)
    situation, best = _situations(t, at, dist, dens, label, p.gate)
    entries = []
    em = np.flatnonzero(situation == 3)
    if len(em):
        pull = np.where(t["valid"][0] & (dist[em] < p.gate), t["tau"][0] * dens[em], 0.0)
        whole = pull.sum(axis=1)[:, None]
        q = pull / np.where(whole > 0, whole, 1.0)
        for j in np.flatnonzero(q.sum(axis=0)):
            gap = points[em] - t["mu"][0, j]
            qxx = (q[:, j, None] * (gap[:, upper[0]] * gap[:, upper[1]])).sum(axis=0)
            entries.append({"situation": 3, "key": int(t["id"][0, j]), "q": float(q[:, j].sum()), "qx": q[:, j] @ points[em], "qxx": qxx})
    key = np.where(situation == 1, t["id"][0, np.maximum(best, 0)], label)
    for kind in (1, 2):
        rest = np.flatnonzero(situation == kind)
        first = rest[np.sort(np.unique(key[rest], return_index=True)[1])]
        # Places of equal order go by their label.
        first = first[np.lexsort((key[first], seq[first]))][: p.max_components if kind == 2 else None]
        entries += [{"situation": kind, "key": int(key[i]), "first_label": int(label[i]), "x": points[i].tolist()} for i in first]
    return len(em), entries


def _situations(t: dict, at: np.ndarray, dist: np.ndarray, dens: np.ndarray, label: np.ndarray, gate: float):
    """Situation of each row and the place of its best component, -1 for none."""
    near = np.where(t["valid"][at] & (dist < gate), dens, -1.0)
    k = near.argmax(axis=1) if len(at) else np.empty(0, dtype="int64")
    n = np.arange(len(k))
    none = near[n, k] < 0
    own = t["label"][at, k]
    situation = np.where(none, 2, np.where(own == 0, 1, np.where(own != label, 2, 3))).astype("int32")
    return situation, np.where(none, -1, k)


def advance(state: DataFrame, stats: DataFrame, params, steps: tuple[str, ...]) -> DataFrame:
    """New model rows from old ones and window statistics.

    ``steps`` names which of adopt, em, create, merge, split and normalize run,
    in that order.  Models without statistics stay as they are.
    """
    joined = state.select(*KEY, "n", "comps").join(stats, KEY, "left")

    def move(row: dict) -> list[dict]:
        comps, n = row["comps"], row["n"] + (row["m"] or 0)
        if row["entries"]:
            comps = _moved(comps, row["entries"], row["rows3"] or 0, params, steps)
        return [{"model_id": row["model_id"], "n": n, "comps": comps}]

    return per_model(joined, move, state_schema(state))


def reshape(state: DataFrame, params, steps: tuple[str, ...]) -> DataFrame:
    """Merge or split the components of each model without any window."""

    def move(row: dict) -> list[dict]:
        return [{**row, "comps": _moved(row["comps"], [], 0, params, steps)}]

    return per_model(state.select(*KEY, "n", "comps"), move, state_schema(state))


def _moved(comps: list[dict], entries: list[dict], em_rows: int, p, steps: tuple[str, ...]) -> list[dict]:
    """One model's components after the given steps."""
    if "adopt" in steps:
        comps = g.adopt(comps, {e["key"]: e["first_label"] for e in entries if e["situation"] == 1})
    if "em" in steps:
        d = p.dimension
        sums = {e["key"]: (e["q"], np.array(e["qx"]), g.full(e["qxx"], d)) for e in entries if e["situation"] == 3}
        comps = g.em_step(comps, sums, em_rows, p.alpha, p.jitter)
    if "create" in steps:
        places = [(e["key"], e["x"]) for e in entries if e["situation"] == 2]
        comps = g.create(comps, places, p.alpha, p.max_components)
    if "merge" in steps:
        comps = g.merge_closest(comps, p.merge_below)
    if "split" in steps:
        comps = g.split_largest(comps, p.split_above, p.split_share, p.max_components)
    if "normalize" in steps:
        comps = g.normalize(comps)
    return sorted((g.with_precision({k: c[k] for k in PARTS}) for c in comps), key=lambda c: c["id"])


def merge_pairs(state: DataFrame) -> DataFrame:
    """Each component with its closest partner of the same label and a larger id."""
    return per_model(
        state.select(*KEY, "comps"),
        lambda row: [
            {"model_id": row["model_id"], "id": i, "id2": j, "skld": s} for i, j, s in g.nearest_partners(row["comps"])
        ],
        f"model_id {model_type(state)}, id bigint, id2 bigint, skld double",
    )


def seed_components(rows: DataFrame, k: int, d: int) -> DataFrame:
    """The first ``k`` rows of each model by ``seq`` as unit components without label."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    first = rows.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k)
    eye = F.array(*[F.lit(1.0 if i == j else 0.0) for i, j in triangle(d)])
    share = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    return first.select(
        *KEY, (F.col("_at") - 1).cast("long").alias("id"), (1.0 / share).alias("tau"), F.lit(1.0).alias("c"),
        F.col("features").alias("mu"), eye.alias("sigma"), F.lit(0).alias("label"),
    )
