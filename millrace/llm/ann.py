"""Nearest neighbours by inner product with vantage-point trees.

Vectors are dealt to cells around centres that are fitted on a bounded sample (eight vectors for
each centre), and large cells are split by hash into shards of about ``shard_rows``.  Each shard is
indexed once by a vantage-point tree and kept as one row, with its ball (centre and radius).
Largest inner product becomes smallest distance by lifting the vectors of a shard to a sphere (one
more coordinate) and queries to the same radius.  A search first scans the leaf that a query falls
into, which bounds its k-th distance, then skips every subtree whose triangle-inequality bound
times ``factor`` exceeds that distance.  Factor 1 is exact; larger factors skip more and may lose
some.

A query first goes to the shard of the nearest centre.  Its k-th score there tells which other
balls it reaches at all (inner product with the centre plus length times radius over ``factor``),
and it travels to these shards only, where that score bounds the search from the start.  So queries are pruned before they are shuffled; in data
without any clusters, such as random directions, exact search has to reach nearly all shards.

Equal vectors are stored once with all their ids, so a vector that a third of the rows share costs
one comparison.  There are at most ``2 * MAX_SHARDS`` shards, whose balls the driver holds; beyond
16 million vectors shards grow instead.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor rows without an id; vectors are compared with those of the same length
only; ties go to the smaller id; rows with the query's own id are no candidates; rows that repeat
an id are all candidates, and of queries with one id the best of all are given; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import drop, materialise

LEAF, MAX_SHARDS = 128, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, dim) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    return v.where(fine).withColumn("dim", F.size("embedding"))


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple]]:
    """Order of the rows of ``x`` and nodes (from, to, vantage row, inner, inner range, outer, outer range).

    A leaf has no children; a node's rows stand together in the order.
    """
    order, nodes = np.arange(len(x)), []
    rng = np.random.default_rng(0)

    def grow(a: int, b: int) -> int:
        at = len(nodes)
        nodes.append((a, b, -1, -1, (0, 0), -1, (0, 0)))
        if b - a > leaf:
            point = x[order[a + rng.integers(b - a)]]
            d = np.sqrt(((x[order[a:b]] - point) ** 2).sum(1))
            by = np.argsort(d, kind="stable")
            order[a:b], d = order[a:b][by], d[by]
            mid = (b - a) // 2
            nodes[at] = (a, b, point, grow(a, a + mid), (d[0], d[mid - 1]), grow(a + mid, b), (d[mid], d[-1]))
        return at

    if len(x):
        grow(0, len(x))
    return order, nodes


def search_shard(index: dict, queries: np.ndarray, ids: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[list[np.ndarray], ...]:
    """Query ids, vector ids and scores of the best ``k`` of a shard for each query, without what scores below ``least``."""
    x, nodes, radius = index["x"] * index["unit"], index["nodes"], index["radius"]
    most = np.abs(queries).max(1, keepdims=True)  # first, as squares of very large or small numbers are none
    length = np.linalg.norm(queries / most, axis=1, keepdims=True)
    q = queries / most / length * radius
    floor = np.full(len(q), -np.inf)
    if least is not None:
        with np.errstate(over="ignore", invalid="ignore"):
            floor = least / (most * length)[:, 0] * radius * index["unit"]
        floor = np.where(np.isfinite(floor), floor, -np.inf)
    lifted = np.concatenate([q, np.zeros((len(q), 1))], 1)
    dots = np.full((len(q), len(x)), -np.inf)

    def distance(point: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((lifted[at] - point) ** 2).sum(1))

    def home(node: int, at: np.ndarray) -> None:
        a, b, point, inner, near, outer, far = nodes[node]
        if not len(at):
            return
        if inner < 0:
            dots[at, a:b] = q[at] @ x[a:b].T
            return
        d = distance(point, at)
        inside = d <= (near[1] + far[0]) / 2
        home(inner, at[inside])
        home(outer, at[~inside])

    every = np.arange(len(q))
    home(0, every)
    want = min(k + 1, len(x))  # one more: the query itself may be among them
    worst = np.maximum(np.partition(dots, len(x) - want, axis=1)[:, len(x) - want], floor)
    bound = np.sqrt(np.maximum(0, 2 * radius**2 - 2 * worst)) * (1 + 1e-9) + 1e-9

    def rest(node: int, at: np.ndarray) -> None:
        a, b, point, inner, near, outer, far = nodes[node]
        if not len(at):
            return
        if inner < 0:
            at = at[np.isinf(dots[at, a])]
            if len(at):
                dots[at, a:b] = q[at] @ x[a:b].T
            return
        d = distance(point, at)
        for child, (low, high) in ((inner, near), (outer, far)):
            gap = np.maximum(np.maximum(d - high, low - d), 0) * (1 - 1e-9)
            rest(child, at[~(gap * factor > bound[at])])

    rest(0, every)
    worst = np.maximum(np.partition(dots, len(x) - want, axis=1)[:, len(x) - want], floor)
    hit_q, hit_x = np.nonzero(dots >= (worst - 1e-9 * radius**2)[:, None])
    keep = np.isfinite(dots[hit_q, hit_x])
    hit_q, hit_x = hit_q[keep], hit_x[keep]
    score = np.zeros(len(hit_q))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(x.shape[1]):  # summed in order of dimensions: equal vectors score equally, whatever stands beside them
            score += queries[hit_q, d] * index["x"][hit_x, d]
    out: tuple[list, list, list] = ([], [], [])
    for one in np.split(np.arange(len(hit_q)), np.searchsorted(hit_q, np.arange(1, len(q)))):
        if not len(one):
            continue
        own = ids[hit_q[one[0]]]
        names = [index["ids"][j][: k + 1] for j in hit_x[one]]
        vec = np.concatenate(names)
        val = np.repeat(score[one], [len(n) for n in names])
        vec, val = vec[vec != own], val[vec != own]
        best = np.lexsort((vec, -val))[:k]
        for held, new in zip(out, (np.full(len(best), own), vec[best], val[best]), strict=True):
            held.append(new)
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) + 0.0


def centres_of(v: DataFrame, cells: int) -> np.ndarray:
    """Centres of ``cells`` cells of vectors (of :func:`usable`, of one length), by k-means over eight times as many, chosen by hash."""
    n = v.count()
    some = v.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1, 8 * cells / n))).select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in sorted(some)], np.float64)
    if not len(x):
        x = np.array([v.first().embedding], np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        c = x[np.unique(np.linspace(0, len(x) - 1, cells).astype(int))]
        for _ in range(4):
            at = np.nan_to_num(x @ c.T - (c**2).sum(1) / 2, nan=-np.inf).argmax(1)
            n_at = np.bincount(at, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            c = np.where(n_at[:, None] > 0, sums / np.maximum(n_at, 1)[:, None], c)
    return c


def build_index(vectors: DataFrame, shard_rows: int = 4096) -> DataFrame:
    """One row for each shard: dim, shard, index (binary), centre and radius of its ball."""
    v = usable(vectors)
    sizes = {r.dim: r["count"] for r in v.groupBy("dim").count().collect()}  # a row for each length of vectors
    total = max(1, sum(sizes.values()))
    rows = max(shard_rows, -(-total // MAX_SHARDS))
    centres = {dim: centres_of(v.where(F.col("dim") == dim), cells) for dim, n in sizes.items() if (cells := -(-n // rows)) > 1}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                if dim in centres:
                    at, c = np.flatnonzero(dims == dim), centres[dim]
                    with np.errstate(over="ignore", invalid="ignore"):
                        near = _vectors(batch.column(1).take(pa.array(at))) @ c.T - (c**2).sum(1) / 2
                    cell[at] = np.nan_to_num(near, nan=-np.inf).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "embedding", "dim", "cell"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64) + 0.0
        distinct, group = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(group.ravel(), kind="stable")
        ids = np.split(rows["vec_id"].to_numpy()[by], np.cumsum(np.bincount(group.ravel()))[:-1])
        most = float(np.abs(distinct).max())
        unit = 1.0 if 1e-100 < most < 1e100 else float(np.ldexp(1.0, -int(np.frexp(most)[1])))  # so that squares are numbers
        scaled = distinct * unit
        norm = (scaled**2).sum(1)
        radius = float(np.sqrt(norm.max()))
        lifted = np.concatenate([scaled, np.sqrt(np.maximum(0, radius**2 - norm))[:, None]], 1)
        order, nodes = build_tree(lifted)
        blob = pickle.dumps({"x": distinct[order], "ids": [ids[j] for j in order], "nodes": nodes, "radius": radius, "unit": unit})
        centre = scaled.mean(0)
        reach = np.sqrt(((scaled - centre) ** 2).sum(1).max()) / unit
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": [f"{rows['dim'].iloc[0]}:{rows['cell'].iloc[0]}:{rows['part'].iloc[0]}"], "index": [blob], "centre": [centre / unit], "radius": [reach]})

    dealt = materialise(v.mapInArrow(deal, "vec_id long, embedding array<double>, dim int, cell int"), "cells") if centres else v.withColumn("cell", F.lit(0))
    parts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))  # a row for each cell
    split = dealt.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), parts) as int)"))
    return split.groupBy("dim", "cell", "part").applyInPandas(build, "dim int, shard string, index binary, centre array<double>, radius double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``vectors`` for each of ``queries`` (vec_id, embedding)."""
    index = materialise(build_index(vectors, shard_rows), "vp-index")
    balls: dict[int, tuple[list[str], np.ndarray, np.ndarray]] = {}
    for r in sorted(index.select("dim", "shard", "centre", "radius").collect()):  # at most 2 * MAX_SHARDS rows, and one for each length
        names, c, radius = balls.get(r.dim, ([], [], []))
        balls[r.dim] = ([*names, r.shard], [*c, r.centre], [*radius, r.radius])
    balls = {dim: (names, np.array(c), np.array(radius)) for dim, (names, c, radius) in balls.items()}
    kind = "vec_id long, embedding array<double>, least double, shards array<string>"

    def reach(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen: list[list[str]] = []
                for vec, dim, least in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    names, c, radius = balls.get(dim, ([], None, None))
                    if not names:
                        chosen.append([])
                        continue
                    q = np.array(vec.as_py(), np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        near = c @ q
                        first = int(np.nan_to_num(near, nan=-np.inf).argmax())
                        far = near + np.sqrt(((q / np.abs(q).max()) ** 2).sum()) * np.abs(q).max() * radius / factor
                        out = far + 1e-9 * np.abs(far) < (-np.inf if least is None else least)
                    chosen.append([names[first]] if home else [n for j, n in enumerate(names) if j != first and not out[j]])
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(chosen, pa.list_(pa.string()))], ["vec_id", "embedding", "least", "shards"])

        return run

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        blob = pickle.dumps((rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64) + 0.0, rows["least"].fillna(-np.inf).to_numpy(np.float64)))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "queries": [blob]})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1), strict=True):
                ids, x, least = pickle.loads(other.as_buffer())
                found = search_shard(pickle.loads(one.as_buffer()), x, ids, k, factor, least)
                cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    def search(sent: DataFrame) -> DataFrame:
        sent = materialise(sent, "sent")
        each = sent.select("vec_id", "embedding", "least", F.explode("shards").alias("shard"))
        blocks = F.broadcast(each.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))  # a row for each shard
        dealt = each.join(blocks, "shard").withColumn("block", F.expr("cast(pmod(xxhash64(vec_id, 1), blocks) as int)"))
        packed = dealt.groupBy("shard", "block").applyInPandas(pack, "shard string, queries binary")
        found = index.select("shard", "index").join(packed, "shard").select("index", "queries").mapInArrow(scan, "query_id long, vec_id long, score double")
        out = materialise(found, "found")
        drop(sent)
        return out

    q = usable(queries).select("vec_id", "embedding", "dim")
    first = search(q.withColumn("least", F.lit(None).cast("double")).mapInArrow(reach(home=True), kind))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first
    if any(len(names) > 1 for names, _, _ in balls.values()):
        kth = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        second = search(q.join(kth, "vec_id", "left").select("vec_id", "embedding", "dim", "least").mapInArrow(reach(home=False), kind))
        found = first.unionByName(second)
    drop(index)
    return found.withColumn("rank", F.row_number().over(w)).where(f"rank <= {int(k)}").select("query_id", "rank", "vec_id", "score")
