"""Near-duplicate classes by improved consistent weighted sampling.

A text is a weighted set of shingles of five words, with weight (1 + ln tf) * idf.  Document
frequencies are counted over distinct texts, so equal copies count once.  The idf is
ln(1 + min(N / df, ``saturation``)): shingles in more than 1/saturation of the texts weigh less,
the rarer ones alike, so a group of near copies does not lower its own weight.  The frequent
shingles are found exactly: one that is in 1/saturation of all texts is in half that share of the
texts of batches that together hold half that share of all, so each task names what is frequent
in its batches, and a second pass counts the few that are named often enough.

Equal texts become one node first; everything later works on nodes, never on ids.  A node keeps
its shingles, so no text is read twice.  ``bands * rows`` consistent weighted samples are drawn
from each node; nodes that agree in all samples of a band share a bucket.

Links are verified by weighted Jaccard similarity of whole texts, in two steps.  Each node of a
bucket is compared with one pivot of the bucket, and links make components; in buckets where
thousands stay outside of the largest component this is repeated with other pivots while it
helps.  In buckets that then hold several components, nodes outside of the largest one meet all
nodes of the bucket, block by block; within two blocks every candidate pair is verified unless
links that were found already connect it.  So each pair that shares a bucket and whose samples
agree in a share of ``threshold - 0.2`` (4.5 standard deviations) is verified or lies within a
component, and what leaves a block is a spanning forest, not its pairs.

Defined results: words are lower-case and separated by white space; a text of fewer than five
words is one shingle, texts without words are equal; a null text is empty; rows that repeat are
in the same class, whose id is the smallest doc_id; rows of one id but different texts are
classed by their texts; rows without an id are in classes like others, a class without any id has
a null class_id, and ``class_key`` tells it from others; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.memory import map_batches
from millrace.operators.graph import components
from millrace.storage import drop, materialise

WORDS, MEMO_WORDS, CHUNK, BATCH, BLOCK, BLOCK_BYTES = 5, 100_000, 256, 128, 256, 1 << 24
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
GRID = 1 << 16


class Shingles:
    """Shingle hashes of a text in ascending order, one for each place.

    32 bits do: two texts of a thousand shingles share a hash by chance in one of 4,000 cases,
    which moves their similarity by a thousandth.
    """

    def __init__(self) -> None:
        import xxhash

        self.hash, self.memo = xxhash.xxh64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint32)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.hash(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(h) < WORDS:
            h = np.concatenate([h, np.full(WORDS - len(h), 7, np.uint64)])
        n = len(h) - WORDS + 1
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s = (s ^ h[k : k + n]) * ODD[k]
            s ^= s >> np.uint64(29)
        out = (s >> np.uint64(32)).astype(np.uint32)
        out.sort()
        return out


def counted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(first, append=len(s))


class Sampler:
    """Consistent weighted samples: for weight w the sample k minimises ln c - r (t - b) - r with t = floor(ln w / r + b).

    r and c are Gamma(2, 1) and b is uniform, all read off a hash of shingle and sample number,
    at the quantiles of a grid.
    """

    def __init__(self, samples: int):
        rng = np.random.default_rng(20_240_501)
        self.seeds = rng.integers(0, 1 << 63, samples, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.odd = rng.integers(0, 1 << 63, samples, np.uint64)[:, None] | np.uint64(1)
        q = (np.arange(GRID) + 0.5) / GRID
        x = np.full(GRID, 1.0)
        for _ in range(60):  # the quantile of Gamma(2, 1): 1 - (1 + x) exp(-x) = q
            x = np.clip(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-12), x / 3, x * 3 + 0.1)
        self.r, self.ln_c = x.astype(np.float32), np.log(x).astype(np.float32)
        self.every = np.arange(samples)
        self.whole = [np.empty((samples, CHUNK), np.uint64) for _ in range(2)]
        self.real = [np.empty((samples, CHUNK), np.float32) for _ in range(3)]

    def __call__(self, shingles: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
        """A 64-bit code of (shingle, t) for each sample."""
        n, low16 = len(self.every), np.uint64(GRID - 1)
        best, code = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
        for k in range(0, len(shingles), CHUNK):
            s, w = shingles[k : k + CHUNK].astype(np.uint64), ln_w[k : k + CHUNK].astype(np.float32)
            z, bits = (x[:, : len(s)] for x in self.whole)
            r, t, b = (x[:, : len(s)] for x in self.real)
            np.bitwise_xor(s, self.seeds, out=z)
            np.multiply(z, self.odd, out=z)
            np.right_shift(z, np.uint64(48), out=bits)
            np.take(self.r, bits.view(np.int64), out=r, mode="wrap")
            np.right_shift(z, np.uint64(16), out=bits)
            np.bitwise_and(bits, low16, out=bits)
            np.multiply(bits, np.float32(1 / GRID), out=b, casting="unsafe")
            np.divide(w, r, out=t)
            np.add(t, b, out=t)
            np.floor(t, out=t)
            np.subtract(t, b, out=b)
            np.add(b, np.float32(1), out=b)
            np.multiply(b, r, out=b)
            np.right_shift(z, np.uint64(32), out=bits)
            np.bitwise_and(bits, low16, out=bits)
            np.take(self.ln_c, bits.view(np.int64), out=r, mode="wrap")
            np.subtract(r, b, out=r)
            at = r.argmin(1)
            low = r[self.every, at]
            new = low < best
            picked = s[at] ^ (t[self.every, at].astype(np.int64).astype(np.uint64) * ODD[0])
            best, code = np.where(new, low, best), np.where(new, picked, code)
        return code


class Weights:
    """Weights of shingles: tf dampened, idf lower for the frequent ones only."""

    def __init__(self, total: int, frequent: dict[int, int], saturation: float):
        self.keys = np.array(sorted(frequent), np.uint32)
        df = np.array([frequent[int(k)] for k in self.keys], np.float64)
        self.idf = np.log1p(np.minimum(total / np.maximum(df, 1), saturation))
        self.common = float(np.log1p(saturation))

    def __call__(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(s), self.common)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
            idf = np.where(self.keys[at] == s, self.idf[at], idf)
        return (1 + np.log(np.maximum(tf, 1))) * idf


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum of minima / sum of maxima of two weighted sets with sorted keys."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    low = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def shingled(docs: DataFrame, saturation: float) -> DataFrame:
    """A row (node, text_key, id, shingles) for each distinct text of ``docs`` (id, text_key, text), and rows (s, n) of named shingles.

    ``id`` is the smallest of the text's.  Rows with a null text_key tell that a task has seen
    the shingle s in n texts of batches in which it is frequent.
    """
    share = 1 / (2 * saturation)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, held = Shingles(), {}, []

        def name() -> None:
            s, n = np.unique(np.concatenate([counted(x)[0] for x in held]), return_counts=True)
            often = n >= share * len(held)
            for key, count in zip(s[often].tolist(), n[often].tolist(), strict=True):
                seen[key] = seen.get(key, 0) + count
            held.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                sets = [shingles(t) for t in part.column(3).to_pylist()]
                for x in sets:
                    held.append(x)
                    if len(held) == BATCH:
                        name()
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in sets], pa.binary()), none, none], names)
        if held:
            name()
        n = len(seen)
        more = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*more, pa.array(np.array(list(seen), np.int64)), pa.array(list(seen.values()), pa.int64())], names)

    names = ["node", "text_key", "id", "shingles", "s", "n"]
    alone = docs.groupBy("text_key").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    alone = alone.select(F.monotonically_increasing_id().alias("node"), "text_key", "id", "text")
    return map_batches(alone, cut, "node long, text_key string, id long, shingles binary, s long, n long")


def frequent_shingles(sets: DataFrame, total: int, saturation: float) -> dict[int, int]:
    """Document frequencies of all shingles in more than 1/saturation of the ``total`` texts of :func:`shingled`."""
    named = sets.where("text_key is null").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= total / (2 * saturation))
    keys = np.sort(np.array([r.s for r in named.select("s").collect()], np.uint32))  # at most 2 * saturation * mean size of a text
    if not len(keys):
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys) + 1, np.int64)
        for batch in batches:
            for data in batch.column(0):
                s, _ = counted(np.frombuffer(data.as_buffer(), np.uint32))
                at = np.searchsorted(keys, s)
                n[at[keys[np.minimum(at, len(keys) - 1)] == s]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n[:-1])], ["s", "n"])

    counts = map_batches(sets.where("text_key is not null").select("shingles"), count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > total / saturation)
    return {r.s: r.n for r in counts.collect()}


def signatures(nodes: DataFrame, weights: Weights, bands: int, rows: int) -> DataFrame:
    """node, size (of its shingles), bands (hashes) and sig (16 bits of each sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler(bands * rows)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                keys, sigs = [], []
                for data in part.column(2):
                    s, tf = counted(np.frombuffer(data.as_buffer(), np.uint32))
                    code = sample(s, np.log(weights(s, tf)))
                    grid = code.reshape(bands, rows)
                    band = np.zeros(bands, np.uint64)
                    for r in range(rows):
                        band = (band ^ grid[:, r]) * ODD[r % 5]
                        band ^= band >> np.uint64(31)
                    keys.append(band.view(np.int64))
                    sigs.append((code ^ (code >> np.uint64(32))).astype(np.uint16).tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], lists, pa.array(sigs, pa.binary())], ["node", "size", "bands", "sig"])

    return map_batches(nodes.select("node", F.octet_length("shingles").alias("size"), "shingles"), run, "node long, size int, bands array<long>, sig binary")


def agreeing(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose samples agree in at least a share ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((x == y).mean(1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(keep)

    one, two = (sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b"), run, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``nodes`` that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)

        def weighed(data: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
            s, tf = counted(np.frombuffer(data.as_buffer(), np.uint32))
            return s, weights(s, tf)

        for batch in batches:
            keep = []
            for at, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if held[0] != at:
                    held = (at, weighed(y))
                keep.append(weighted_jaccard(weighed(x), held[1]) >= threshold)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def with_pivots(buckets: DataFrame, pivots: DataFrame, many: int) -> DataFrame:
    """``buckets`` (bucket, band, node, size) joined with ``pivots`` (one row for each bucket, with its size n).

    Buckets of more than ``many`` nodes are joined by broadcast, so none of them meets in one task.
    """
    large = F.broadcast(pivots.where(F.col("n") > many))
    rest = buckets.join(large.select("bucket"), "bucket", "left_anti").join(pivots.where(F.col("n") <= many), "bucket")
    return rest.unionByName(buckets.join(large, "bucket"))


def mixed_buckets(named: DataFrame) -> DataFrame:
    """The buckets with several components: n nodes of ``bytes``, top of them in the largest, ``major``, and the hash ``pivot`` of one of these.

    ``named`` has bucket, node, comp and size.
    """
    sizes = named.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.xxhash64("node", F.lit(5))).alias("pivot"))
    most = F.max_by(F.struct("comp", "n", "bytes", "pivot"), F.struct("n", "comp"))
    found = sizes.groupBy("bucket").agg(most.alias("m"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return found.where("n > m.n").select("bucket", F.col("m.comp").alias("major"), F.col("m.n").alias("top"), F.col("m.bytes").alias("top_bytes"), F.col("m.pivot").alias("pivot"), "n", "bytes")


class Open:
    """Candidate pairs of two blocks of a bucket that lie between components, the most alike first."""

    def __init__(self, rows: list[dict], least: float):
        left, right = ([r for r in rows if r["left"] is side] for side in (True, False))
        self.left, self.right, self.pairs = left, right, np.zeros((0, 2), np.int64)
        if not left or not right:
            return
        x, y = (np.frombuffer(b"".join(r["sig"] for r in side), np.uint16).reshape(len(side), -1) for side in (left, right))
        u, v = (np.array([r["bands"] for r in side]) for side in (left, right))
        (p, a, _), (q, b, minor) = ([np.array([r[c] for r in side]) for c in ("comp", "node", "minor")] for side in (left, right))
        found, band = [], rows[0]["band"]
        for k in range(0, len(left), 64):
            alike = (x[k : k + 64, None, :] == y[None, :, :]).mean(2)
            i, j = np.nonzero((alike >= least) & (p[k : k + 64, None] != q[None, :]))
            mean = alike[i, j]
            i += k
            # a pair is met in the first band that it shares, and once where both are outside of the largest component
            keep = ((u[i] == v[j]).argmax(1) == band) & (~minor[j] | (a[i] < b[j]))
            found.append(np.stack([mean[keep], i[keep], j[keep]], 1))
        edges = np.concatenate(found)
        self.pairs = edges[np.argsort(-edges[:, 0], kind="stable"), 1:].astype(np.int64)


def between_components(named: DataFrame, mixed: DataFrame, sigs: DataFrame, nodes: DataFrame, weights: Weights, threshold: float, least: float) -> DataFrame:
    """Verified links (a, b) that connect all components that are linked within a bucket.

    ``named`` has bucket, band, node, comp.  Nodes outside of a bucket's largest component meet all
    nodes of the bucket, in blocks of about ``BLOCK``.  First the samples tell which nodes of two
    blocks have candidates at all; only their shingles are then brought together.  There the
    candidates are taken by likeness, and one that no link connects yet is verified.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, y, rows in (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows)):  # one pair of blocks at a time
                open_ = Open(rows, least)
                held = [(side[k], side is open_.left) for side, col in ((open_.left, 0), (open_.right, 1)) for k in np.unique(open_.pairs[:, col])]
                cols = [[at] * len(held), [x] * len(held), [y] * len(held), *([r[c] for r, _ in held] for c in ("node", "comp", "minor", "band")), [left for _, left in held]]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "x", "y", "node", "comp", "minor", "band", "left"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (x.as_py() for x in batch.column(0)):
                open_, parent, sets, a, b = Open(rows, least), {}, {}, [], []

                def top(c: int) -> int:
                    while c in parent:
                        c = parent[c]
                    return c

                def weighed(r: dict) -> tuple[np.ndarray, np.ndarray]:
                    if r["node"] not in sets:
                        s, tf = counted(np.frombuffer(r["shingles"], np.uint32))
                        sets[r["node"]] = (s, weights(s, tf))
                    return sets[r["node"]]

                for i, j in open_.pairs.tolist():
                    one, other = open_.left[i], open_.right[j]
                    p, q = top(one["comp"]), top(other["comp"])
                    if p != q and weighted_jaccard(weighed(one), weighed(other)) >= threshold:
                        parent[max(p, q)] = min(p, q)
                        a.append(one["node"])
                        b.append(other["node"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    counts = mixed.select("bucket", "major", parts(F.col("n"), F.col("bytes")).alias("alls"), parts(F.col("n") - F.col("top"), F.col("bytes") - F.col("top_bytes")).alias("minors"))
    d = named.join(counts, "bucket").join(sigs.select("node", "bands", "sig"), "node").withColumn("minor", F.expr("comp <> major"))
    block = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = ("bucket", "band", "node", "comp", "minor", "bands", "sig")
    left = d.where("minor").select(*own, F.lit(True).alias("left"), block("minors", 1).alias("x"), every("alls").alias("y"))
    right = d.select(*own, F.lit(False).alias("left"), every("minors").alias("x"), block("alls", 2).alias("y"))
    fields = ("node", "comp", "minor", "band", "left", "bands", "sig")
    met = left.unionByName(right).groupBy("bucket", "x", "y").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    near = materialise(map_batches(met.select("bucket", "x", "y", "rows"), candidates, "bucket long, x int, y int, node long, comp long, minor boolean, band int, left boolean"), "near")
    held = near.join(sigs.select("node", "bands", "sig"), "node").join(nodes.select("node", "shingles"), "node")
    grouped = held.groupBy("bucket", "x", "y").agg(F.collect_list(F.struct(*fields, "shingles")).alias("rows"))
    return map_batches(grouped.select("rows"), links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 16, rows: int = 5, saturation: float = 10.0) -> DataFrame:
    """doc_id, text_key, class_key, class_id (smallest doc_id) and n_links of every row of ``docs`` (doc_id, text).

    ``n_links`` counts the verified links of a text to different texts that made its class.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.md5("text"))
    sets = materialise(shingled(d, saturation), "shingles")
    nodes = sets.where("text_key is not null").select("node", "text_key", "id", "shingles")
    total = nodes.count()
    weights = Weights(total, frequent_shingles(sets, total, saturation), saturation)
    sigs = materialise(signatures(nodes, weights, bands, rows), "signatures")

    buckets = sigs.select("node", "size", F.posexplode("bands").alias("band", "hash")).select("node", "size", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = materialise(buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "shared")
    # at most bands * 4096 buckets are larger than that
    members = materialise(with_pivots(buckets, shared, max(256, total // 4096)), "buckets")
    least = threshold - 0.2
    pairs = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links, outside = None, None
    while True:
        tried = materialise(agreeing(pairs.distinct(), sigs, least), "candidates")
        found = materialise(verified(tried, nodes, weights, threshold), "links")
        drop(tried)
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        named = materialise(members.select("bucket", "band", "node", "size").join(comps, "node", "left").select("bucket", "band", "node", "size", F.coalesce("comp", "node").alias("comp")), "named")
        mixed = materialise(mixed_buckets(named), "mixed")
        large = mixed.where(F.col("n") - F.col("top") > 8 * BLOCK)
        left = large.agg(F.coalesce(F.sum(F.col("n") - F.col("top")), F.lit(0))).first()[0]
        if not left or (outside is not None and left > 0.8 * outside):
            break
        outside = left
        around = named.join(large.select("bucket", "major", "pivot"), "bucket").withColumn("center", F.expr("comp = major and xxhash64(node, 5) = pivot"))
        centers = around.where("center").groupBy("bucket").agg(F.min("node").alias("b"))
        pairs = around.where("comp <> major").select("bucket", F.col("node").alias("a")).join(centers, "bucket").select("a", "b")
    more = materialise(between_components(named, mixed, sigs, nodes, weights, threshold, least), "links")
    links = links.unionByName(more)
    drop(shared, members, named, mixed, sigs)
    comps = components(links)

    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.select("node", "text_key", "id").join(comps, "node", "left").withColumn("class_key", F.coalesce("comp", "node"))
    ids = named.where("comp is not null").groupBy("class_key").agg(F.min("id").alias("class_id"))
    named = named.join(ids, "class_key", "left").join(ends, "node", "left")
    named = named.select("text_key", "class_key", F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return d.select("id", "text_key").join(named, "text_key").select(F.col("id").alias("doc_id"), "text_key", "class_key", "class_id", "n_links")
