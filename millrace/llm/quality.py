"""Quality classifier learned from positive and unlabelled text.

A small network is fitted by minimising the non-negative unbiased risk

    prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)])

over trusted positives and unlabelled texts.  Labelled negatives take no part: the class prior is
estimated from positives and unlabelled texts alone, by the smallest ratio of their shares beyond
a score (best bin estimation, with confidence bounds), on halves
that a first fit has not seen, as a mean over several splits (``prior`` overrides it).

Features come from one pass over whole texts.  Their means and scales are those of all texts of
the training fold.  Of the unlabelled texts all count: they are dealt to 4,096 cells by the signs
of random projections, and each cell is represented by up to ``per_cell`` of its texts, chosen by
hash, which share the number of all its texts as their weight.  Only labelled rows are a plain
sample, of at most about ``max_labelled`` rows by a hash of the id.

Defined results: a null text counts as empty, an empty text has features of zero and gets
a score like any other; labels that repeat count once, with the larger value, null labels
not at all; the result does not depend on the order or layout of rows; an empty table gives an
empty table; without labelled positives every score is 0.5.  Other columns pass through
``score_texts``; one named like the result is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.memory import map_batches
from millrace.storage import drop, materialise

SYMBOLS = b"!#$%&*|+/=<>@_~^`\"'()[]{};:-?"
N_FEATURES = 22 + len(SYMBOLS)
CELL_BITS, PER_CELL, PRIOR_SPLITS, SLICE = 12, 8, 4, 256


def text_features(text: str | None) -> np.ndarray:
    """Shares of character classes, and how much words, lines and phrases repeat."""
    out = np.zeros(N_FEATURES)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    n = len(data)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digits = h[97:123].sum(), h[65:91].sum(), h[48:58].sum()
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    head = [x for x in words if x[0].isupper()]
    shout = sum(1 for x in head if len(x) > 1 and x.isupper())
    tail = sum(not x[-1].isalnum() for x in words)
    out[:22] = (
        1, np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lower / n, upper / n, digits / n, h[32] / n, h[10] / n,
        h[46] / n, h[44] / n, h[128:].sum() / n, h[:10].sum() / n, n / w / 10, len(set(words)) / w, runs / w,
        pairs / max(1, w - 1), len(set(lines)) / len(lines), len(head) / w, shout / w, tail / w, len(zlib.compress(data, 1)) / (n + 20),
    )
    out[22:] = np.sqrt(h[list(SYMBOLS)] / n)
    return out


@dataclass
class QualityModel:
    """A fitted network: the mean and scale of features, two layers and the class prior."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, weight: np.ndarray | None = None, centre: tuple[np.ndarray, np.ndarray] | None = None, hidden: int = 24, steps: int = 1500, seed: int = 7) -> QualityModel:
    """Minimise the non-negative risk by mini-batch Adam; where the negative part falls below zero its gradient is reversed.

    ``weight`` tells how many texts each unlabelled row stands for, ``centre`` the mean and scale of the features.
    """
    rng = np.random.default_rng(seed)
    mean, scale = centre if centre is not None else (unlabelled.mean(0), unlabelled.std(0) + 1e-3)
    share = np.cumsum(weight if weight is not None else np.ones(len(unlabelled)))
    m = QualityModel(mean, scale, rng.normal(0, 0.3, (positive.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0, prior=prior)
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    params = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        a, b = xp[rng.integers(0, len(xp), 1024)], xu[np.minimum(np.searchsorted(share, rng.random(3072) * share[-1], "right"), len(xu) - 1)]
        x = np.concatenate([a, b])
        hid = np.tanh(x @ params[0] + params[1])
        z = hid @ params[2] + params[3]
        zp, zu = z[: len(a)], z[len(a) :]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = np.concatenate([-prior * _sigmoid(zp) / len(a), _sigmoid(zu) / len(b)]) * (1 if negative >= 0 else -1)
        if negative >= 0:
            g[: len(a)] += -prior * _sigmoid(-zp) / len(a)
        back = np.outer(g, params[2]) * (1 - hid**2)
        grads = [x.T @ back + 1e-4 * params[0], back.sum(0), hid.T @ g + 1e-4 * params[2], np.array([g.sum()])]
        rate = 0.01 * min(1, 3 * (1 - step / (steps + 1)))
        for k, d in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            params[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3][0])
    return m


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, weight: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from margins of rows that the model has not seen.

    Beyond any threshold the unlabelled share is at least the prior times that of positives, so
    their ratio bounds the prior from above; the threshold is where it has the least upper
    confidence bound (level ``delta``), and one standard error is taken off.
    """
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    by = np.argsort(unlabelled, kind="stable")
    total = np.concatenate([[0], np.cumsum(weight[by])])
    u = 1 - total[np.searchsorted(unlabelled[by], cuts, "left")] / total[-1]
    effective = weight.sum() ** 2 / (weight**2).sum()  # rows of equal weight that would be as sure
    slack = np.sqrt(np.log(4 / delta) / 2) * (effective**-0.5 + len(positive) ** -0.5)
    best = int(((u + slack) / p).argmin())
    ratio = u[best] / p[best]
    error = np.sqrt(u[best] * (1 - u[best]) / effective + ratio**2 * p[best] * (1 - p[best]) / len(positive)) / p[best]
    return float(np.clip(ratio - error, 0.02, 0.98))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, N_FEATURES).astype(np.float64)


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and x (features of ``text`` as 32-bit floats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                x = [text_features(t).astype("<f4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], ["doc_id", "x"])

    return map_batches(docs.select("doc_id", "text"), run, T.StructType([docs.schema["doc_id"], T.StructField("x", T.BinaryType())]))


def feature_moments(features: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and scale of their features (a row for each feature reaches the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for batch in batches:
            x = _matrix(batch.column(0))
            n, one, two = n + len(x), one + x.sum(0), two + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_FEATURES)), pa.array(np.full(N_FEATURES, n)), pa.array(one), pa.array(two)], ["k", "n", "one", "two"])

    sums = map_batches(features.select("x"), run, "k long, n long, one double, two double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    rows = sorted(sums.collect())
    n = max(1, rows[0].n if rows else 1)
    mean = np.round(np.array([r.one for r in rows] or np.zeros(N_FEATURES)) / n, 9)  # the order of the sums does not show
    spread = np.array([r.two for r in rows] or np.zeros(N_FEATURES)) / n - mean**2
    return (rows[0].n if rows else 0), mean, np.round(np.sqrt(np.maximum(spread, 0)), 6) + 1e-3


def weighted_cells(features: DataFrame, mean: np.ndarray, scale: np.ndarray, per_cell: int = PER_CELL) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of rows that stand for all rows: of each cell up to ``per_cell`` different ones, by hash."""
    rng = np.random.default_rng(11)
    planes, bits = rng.normal(size=(N_FEATURES, CELL_BITS)), 1 << np.arange(CELL_BITS)

    def first(cell: np.ndarray, h: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The first different rows of each cell by hash; a cell's number stands with the first of them."""
        by = np.lexsort((x, h, cell))
        cell, h, n, x = cell[by], h[by], n[by], x[by]
        start = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        total = np.bincount(np.cumsum(start) - 1, n) if len(cell) else n
        new = start | np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
        cell, h, x = cell[new], h[new], x[new]
        start = np.flatnonzero(start[new])
        rank = np.arange(len(cell)) - np.repeat(start, np.diff(start, append=len(cell)))
        n = np.zeros(len(cell), np.int64)
        n[start] = total
        return tuple(a[rank < per_cell] for a in (cell, h, n, x))

    def arrays(columns: list) -> tuple[np.ndarray, ...]:
        return (*(np.asarray(c) for c in columns[:3]), np.frombuffer(b"".join(columns[3].to_pylist()), f"S{4 * N_FEATURES}"))

    def rows(cell: np.ndarray, h: np.ndarray, n: np.ndarray, x: np.ndarray) -> list[pa.Array]:
        width = 4 * N_FEATURES
        data = x.tobytes()
        return [pa.array(cell, pa.int64()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array([data[k : k + width] for k in range(0, len(data), width)], pa.binary())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first(*arrays([[], [], [], pa.array([], pa.binary())]))
        for batch in batches:
            cell = ((np.clip((_matrix(batch.column(0)) - mean) / scale, -8, 8) @ planes > 0) * bits).sum(1)
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"S{4 * N_FEATURES}")
            h = np.array([zlib.crc32(v.as_buffer()) for v in batch.column(0)], np.int64)
            held = first(*(np.concatenate(p) for p in zip(held, first(cell, h, np.ones(len(h), np.int64), x), strict=True)))
        yield pa.RecordBatch.from_arrays(rows(*held), names)

    names, kind = ["cell", "h", "n", "x"], "cell long, h long, n long, x binary"
    dealt = materialise(map_batches(features.select("x"), deal, kind), "cells")  # at most 4,096 * per_cell rows of each task
    totals = dealt.groupBy("cell").agg(F.sum("n").alias("total"))
    each = dealt.groupBy("cell", "h", "x").agg(F.count("*").alias("tasks"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "x"))
    some = each.withColumn("rank", rank).where(F.col("rank") <= per_cell).join(totals, "cell")
    found = some.select("cell", "h", F.when(F.col("rank") == 1, F.col("total")).otherwise(F.lit(0)).alias("n"), "x").toArrow()  # at most 4,096 * per_cell rows
    drop(dealt)
    cell, _, n, x = first(*arrays(found.combine_chunks().columns))
    if not len(cell):
        return np.zeros((0, N_FEATURES)), np.zeros(0)
    at = np.unique(cell, return_inverse=True)[1]
    weight = np.bincount(at, n) / np.bincount(at)
    return np.frombuffer(x.tobytes(), "<f4").reshape(-1, N_FEATURES).astype(np.float64), weight[at]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _thin(df: DataFrame, bound: int, salt: int) -> DataFrame:
    """About ``bound`` rows, or all if there are no more, by a hash of doc_id."""
    n = df.count()
    return df if n <= bound else df.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40)) < int((1 << 40) * bound / n))


def fit_features(features: DataFrame, labels: DataFrame, max_labelled: int = 20_000, prior: float | None = None) -> QualityModel | None:
    """Fit on positives outside the held-out fold, and on all texts of the same fold; ``features`` should be a written table."""
    fold = features.where(~held_out())
    good = labels.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    picked = F.broadcast(_thin(good, max_labelled, 1))  # bounded by the parameter
    rows = sorted(r.x for r in fold.join(picked, "doc_id").select("x").collect())
    n, mean, scale = feature_moments(fold)
    if not rows or not n:
        return None
    xp = _matrix(pa.array([bytes(r) for r in rows], pa.binary()))
    xu, weight = weighted_cells(fold, mean, scale)
    centre = (mean, scale)
    if prior is None:
        rng, found = np.random.default_rng(3), []
        for _ in range(PRIOR_SPLITS):
            p, u = (np.array_split(rng.permutation(len(x)), 2) for x in (xp, xu))
            for k in (0, 1):  # each half is judged by the model of the other
                if all(map(len, (*p, *u))):
                    m = fit_nnpu(xp[p[1 - k]], xu[u[1 - k]], 0.5, weight[u[1 - k]], centre, steps=500)
                    found.append(estimate_prior(m.margin(xp[p[k]]), m.margin(xu[u[k]]), weight[u[k]]))
        prior = float(np.mean(found)) if found else 0.5
    return fit_nnpu(xp, xu, prior, weight, centre)


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, prior: float | None = None) -> QualityModel | None:
    """:func:`fit_features` over the texts of ``docs``."""
    return fit_features(materialise(feature_table(docs), "features"), labels, max_labelled, prior)


def score_features(features: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id and score of a :func:`feature_table`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.score(_matrix(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.float64())], ["doc_id", "score"])

    return map_batches(features.select("doc_id", "x"), run, T.StructType([features.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def score_texts(docs: DataFrame, model: QualityModel | None, name: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1, higher: label 1 likelier); no shuffle."""
    kept = [c for c in docs.columns if c != name]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                x = np.array([text_features(t) for t in part.column(at).to_pylist()], "<f4").reshape(-1, N_FEATURES).astype(np.float64)
                y = model.score(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y, pa.float64())], [*kept, name])

    source = docs.select(*kept)
    return map_batches(source, run, T.StructType([*source.schema.fields, T.StructField(name, T.DoubleType())]))
