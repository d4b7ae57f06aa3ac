"""M8: second-order gradient boosting on histograms, one model per series.

Spark deals out the series; a task fits one series at a time from arrays that
are as long as the series has months, so memory follows the calendar and not
the table.  The recursive forecast around the model stays in column
expressions; Python sees one (features, targets) pair per series, and one
feature row per series and step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature; with fewer distinct values each has a bin of its own.
MAX_BINS = 256
#: A split must lower the loss by more than this.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    """Settings of the learner.  Fixed values: the defaults are the reference's hyper-parameters."""

    rounds: int = 500
    rate: float = 0.03
    depth: int = 4
    rows: float = 0.95
    columns: float = 0.95
    l2: float = 1.2
    seed: int = 42


def cut_points(values: np.ndarray) -> np.ndarray:
    """Upper bounds of the bins: a value belongs left of a cut that is greater than it."""
    distinct = np.unique(values)
    if len(distinct) > MAX_BINS:
        distinct = distinct[np.linspace(0, len(distinct) - 1, MAX_BINS).astype(int)]
    return distinct[1:]


def samples(p: Boosting, n: int, m: int):
    """Per round the sampled rows (a mask) and columns (sorted positions); only settings and sizes decide."""
    rng = np.random.default_rng(p.seed)
    for _ in range(p.rounds):
        yield rng.random(n) < p.rows, np.sort(rng.permutation(m)[:max(1, int(p.columns * m))])


def fit(x: np.ndarray, y: np.ndarray, p: Boosting) -> dict:
    """Trees for squared error on features ``x`` (rows x columns).

    Rows are binned once.  A level of a tree sums gradients and counts over (node, feature, bin)
    in one pass, and a node splits where G_L^2/(H_L+l2) + G_R^2/(H_R+l2) - G^2/(H+l2) is greatest
    (first feature, then least cut, among equals); a leaf is -rate * G/(H+l2).  Trees are stored
    as complete binary trees; a node that does not split sends all rows left.
    """
    n, m = x.shape
    cuts = [cut_points(x[:, j]) for j in range(m)]
    width = max(len(c) for c in cuts) + 1
    code = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1)
    bounds = np.full((m, width), np.inf)
    for j, c in enumerate(cuts):
        bounds[j, :len(c)] = c
    inner, leaves = 2 ** p.depth - 1, 2 ** p.depth
    feature, cut = np.zeros((p.rounds, inner), np.int16), np.full((p.rounds, inner), np.inf)
    leaf = np.zeros((p.rounds, leaves))
    base = float(y.mean())
    predicted = np.full(n, base)
    cell = np.arange(m) * width + code
    for t, (kept, columns) in enumerate(samples(p, n, m)):
        gradient = predicted - y
        rows = np.flatnonzero(kept)
        usable = np.isin(np.arange(m), columns)[:, None] & np.isfinite(bounds)
        node = np.zeros(n, np.int64)
        for level in range(p.depth):
            nodes = 2 ** level
            at = (node[rows, None] * (m * width) + cell[rows]).ravel()
            shape = (nodes, m, width)
            g = np.bincount(at, np.repeat(gradient[rows], m), nodes * m * width).reshape(shape).cumsum(2)
            h = np.bincount(at, minlength=nodes * m * width).reshape(shape).cumsum(2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            right_g, right_h = all_g - g, all_h - h
            gain = g * g / (h + p.l2) + right_g * right_g / (right_h + p.l2) - all_g * all_g / (all_h + p.l2)
            gain = np.where(usable & (h >= 1) & (right_h >= 1), gain, -np.inf).reshape(nodes, -1)
            best = gain.argmax(1)
            splits = gain[np.arange(nodes), best] > LEAST_GAIN
            first = nodes - 1
            feature[t, first:first + nodes] = np.where(splits, best // width, 0)
            cut[t, first:first + nodes] = np.where(splits, bounds.ravel()[best], np.inf)
            node = 2 * node + (x[np.arange(n), feature[t, first + node]] >= cut[t, first + node])
        g, h = np.bincount(node[rows], gradient[rows], leaves), np.bincount(node[rows], minlength=leaves)
        leaf[t] = -p.rate * g / (h + p.l2)
        predicted = predicted + leaf[t][node]
    return {"base": base, "feature": feature, "cut": cut, "leaf": leaf}


def predict(model: dict, x: np.ndarray, depth: int) -> float:
    """Prediction for one feature row: all trees are walked level by level at once."""
    tree = np.arange(len(model["leaf"]))
    node = np.zeros(len(tree), np.int64)
    for level in range(depth):
        at = 2 ** level - 1 + node
        node = 2 * node + (x[model["feature"][tree, at]] >= model["cut"][tree, at])
    return model["base"] + float(np.add.reduce(model["leaf"][tree, node]))


def pack(model: dict) -> bytes:
    return b"".join([np.float64(model["base"]).tobytes(), *(model[k].tobytes() for k in ("feature", "cut", "leaf"))])


def unpack(data: bytes, p: Boosting) -> dict:
    inner, leaves = 2 ** p.depth - 1, 2 ** p.depth
    out, at = {"base": float(np.frombuffer(data, np.float64, 1)[0])}, 8
    for name, kind, size in (("feature", np.int16, inner), ("cut", np.float64, inner), ("leaf", np.float64, leaves)):
        out[name] = np.frombuffer(data, kind, p.rounds * size, at).reshape(p.rounds, size)
        at += out[name].nbytes
    return out


def _with(df: DataFrame, out: str, kind: str, used: list[str], of) -> DataFrame:
    """Put the column ``out``, computed row by row, in the place of the columns ``used``."""
    kept = [c for c in df.columns if c not in used]
    schema = df.select(*kept, F.lit(None).cast(kind).alias(out)).schema
    arrow = pa.binary() if kind == "binary" else pa.float64()

    def run(batches):
        for batch in batches:
            values = [of(*row) for row in zip(*(batch.column(c).to_pylist() for c in used))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values, arrow)], names=[*kept, out])

    return df.mapInArrow(run, schema)


def with_models(series: DataFrame, p: Boosting, x: str = "xs", y: str = "ys", out: str = "model") -> DataFrame:
    """The packed model of every series from its feature rows (array of arrays) and targets (array), in their place."""
    return _with(series, out, "binary", [x, y], lambda xs, ys: pack(fit(np.array(xs, float), np.array(ys, float), p)))


def with_predictions(state: DataFrame, p: Boosting, model: str = "model", x: str = "x", out: str = "prediction") -> DataFrame:
    """The prediction of every series' packed model for one feature row (array), in its place; the model stays."""
    state = state.withColumn("__model", F.col(model))
    return _with(state, out, "double", ["__model", x], lambda m, row: predict(unpack(m, p), np.array(row, float), p.depth))
