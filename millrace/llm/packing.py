"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity`` tokens; the pieces are packed
into sequences of ``capacity`` tokens.  The packing decision depends only on how many
pieces of each length there are, so it is taken on a histogram of at most ``capacity``
rows, however large the corpus: combinations of lengths are planned with multiplicities,
and each piece finds its place from its rank among the pieces of its length.

Defined results: a null or empty text is one piece that holds the separator only;
rows that repeat are packed as often as they occur; an empty table gives an empty table;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.memory import map_batches
from millrace.storage import materialise

LEARN = 300  # words encoded in one call
MEMO_ENTRIES = 400_000  # words remembered by a task; the memory is bounded, the result does not depend on it
ODD_CASE = {"\u0130", "\u03a3"}  # their small forms are two characters, or depend on the place
SEPARATOR = np.array([0], "<u4").tobytes()

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


class WordIds:
    """Token ids of words between spaces, as little-endian 32-bit bytes.

    The tokenizer composes, lower-cases and never merges across a space, a line feed, or
    between a letter and the punctuation after it, so a text's ids are the ids of its words in
    a row.  A text that is composed before and after it is lower-cased has the ids of its lower
    case; others keep their case.  Words of letters are encoded many in one call: each ends in
    a word-end token.  All other words go through the whole tokenizer.
    """

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        mark = r"[!-&(-/:-@\[-^`{-~]"  # ASCII punctuation but ' and _
        self.tail = re.compile(rf"({mark}(?<=[a-z].){mark}*)(?=\s|$)").sub
        self.entries = entries
        self.memo: dict[str, bytes] = {"": b""}

    def _words(self, text: str) -> list[str]:
        text = text.replace("\n", " ")
        if "<|" not in text and not any(c in text for c in ODD_CASE):  # special tokens stay as they are
            low = text.lower()
            if text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
                text = self.tail(r" \1", low)
        return text.split(" ")

    def _learn(self, missing: set[str]) -> None:
        letters = [w for w in missing if w.isalpha() and w.islower() and (w.isascii() or unicodedata.is_normalized("NFC", w))]
        other = list(missing.difference(letters))
        for k in range(0, len(letters), LEARN):
            plain = letters[k : k + LEARN]
            ids = np.array(self.letters.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) == len(plain):
                data, at = ids.tobytes(), 0
                for word, stop in zip(plain, stops.tolist(), strict=True):
                    self.memo[word] = data[at:stop]
                    at = stop
            else:
                other += plain
        for word, e in zip(other, self.whole.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.memo[word] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        words = [self._words(t) for t in texts]
        missing = set().union(*words).difference(self.memo)  # looks up the few words, not the memo
        if len(self.memo) + len(missing) > self.entries:
            self.memo = {"": b""}
            missing = set().union(*words, [""])
        self._learn(missing)
        get = self.memo.__getitem__
        for w in words:
            yield b"".join(map(get, w))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of ``docs`` (doc_id, text), and their row in the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, made = WordIds(tokenizer_path), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(texts), strict=True):
                    ids += SEPARATOR
                    n = len(ids) // 4
                    for p, start in enumerate(range(0, n, capacity)):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, p, start, len(cut) // 4, zlib.crc32(cut), made))
                        made += 1
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [*NAMES, "row"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES + ", row long")


Plan = list[tuple[list[tuple[int, int]], int]]


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """Sequence patterns ([(length, copies)...], multiplicity) that use up the histogram.

    Exact complements of up to three pieces spend small pieces that later lengths may need,
    so plans with complements of at most 3, 2 and 1 pieces are made and the one with the
    fewest sequences is taken, the deepest of equals.
    """
    floor = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best: tuple[int, Plan] | None = None
    for depth in (3, 2, 1):
        plan = _plan(histogram, capacity, depth)
        size = sum(times for _, times in plan)
        if best is None or size < best[0]:
            best = (size, plan)
        if size == floor:
            break
    return best[1] if best else []


def _plan(histogram: dict[int, int], capacity: int, depth: int) -> Plan:
    """A plan with exact complements of at most ``depth`` pieces.

    Lengths are taken from the largest.  A gap is closed exactly by one piece, else by a
    pair, else by a triple, found by hashing sums of available lengths; a combination is
    consumed as often as the availability counts allow.  What has no exact complement is
    packed best-fit, largest first.  Every step uses up a length or closes a group of
    bins, so the plan is bounded by the number of distinct lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: Plan = []

    def pattern(lengths: list[int]) -> tuple[list[tuple[int, int]], int]:
        uses: dict[int, int] = {}
        for x in lengths:
            uses[x] = uses.get(x, 0) + 1
        return sorted(uses.items(), reverse=True), min(int(left[x]) // k for x, k in uses.items())

    def pair(total: int, besides: list[int]) -> list[int] | None:
        """The available pair with that sum whose smaller count is the largest."""
        if total < 2:
            return None
        low = np.arange(max(1, total - capacity), total // 2 + 1)
        have = np.minimum(left[low], left[total - low])
        if total % 2 == 0:
            have[-1] = left[total // 2] // 2
        for x in {*besides}:
            for at in (x, total - x):
                if low[0] <= at <= low[-1]:
                    have[at - low[0]] = pattern([*besides, at, total - at])[1]
        best = int(have.argmax())
        return [int(low[best]), int(total - low[best])] if have[best] > 0 else None

    def complement(length: int) -> list[int] | None:
        gap = capacity - length
        if gap == 0:
            return []
        if depth >= 1 and left[gap] > (gap == length):
            return [gap]
        if depth >= 2 and (found := pair(gap, [length])):
            return found
        # triples: sums of pairs of available lengths, looked up by what a third piece leaves
        here = np.flatnonzero(left[: gap - 1])
        if depth < 3 or not len(here):
            return None
        there = np.zeros(gap + 1, bool)
        there[here] = True
        sums = np.convolve(there.astype(np.int32), there.astype(np.int32))[: gap + 1] > 0
        for third in here[sums[gap - here]][::-1]:
            third = int(third)
            if pattern([length, third])[1] and (found := pair(gap - third, [length, third])) and pattern([length, third, *found])[1]:
                return [third, *found]
        return None

    for length in range(capacity, 0, -1):
        while left[length]:
            found = complement(length)
            if found is None:
                break
            uses, times = pattern([length, *found])
            if not times:
                break
            out.append((uses, times))
            for x, k in uses:
                left[x] -= k * times

    gaps: dict[int, list[tuple[dict[int, int], int]]] = {}  # gap -> groups of alike bins
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = next((g for g in range(length, capacity) if gaps.get(g)), capacity)
            uses, bins = gaps[gap].pop() if gap < capacity else ({}, n)
            each = gap // length
            full = min(bins, n // each)
            if full:
                gaps.setdefault(gap - each * length, []).append(({**uses, length: each}, full))
                n -= full * each
            if full < bins and n and n < each:
                gaps.setdefault(gap - n * length, []).append(({**uses, length: n}, 1))
                full, n = full + 1, 0
            if gap < capacity and full < bins:
                gaps[gap].append((uses, bins - full))
    out += [(list(uses.items()), bins) for groups in gaps.values() for uses, bins in groups]
    return out


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (of :func:`token_pieces`, materialised) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for uses, times in plan_packing(histogram, capacity):
        offset = 0
        for length, copies in uses:
            slots.setdefault(length, []).append((ranks.get(length, 0), times, sequence, offset))
            ranks[length] = ranks.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    table = {length: np.array(rows, np.int64) for length, rows in slots.items()}

    # The rank of a piece among those of its length: a length's pieces are dealt into about
    # sqrt(count) groups, so neither a group nor the list of groups of one length is large.
    # Rows that repeat differ in the row of their task, so they do not share a group.
    groups = spark.createDataFrame([(int(k), max(1, int(n**0.5))) for k, n in histogram.items()] or [(0, 1)], "length long, groups int")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.expr("cast(pmod(xxhash64(row, ids_crc32, doc_id), groups) as int)"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(bases, ["length", "salt"])
    ranked = ranked.select(*NAMES, (F.col("base") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, times, base, begin = table[int(x)].T
                slot = np.searchsorted(first, rank[at], "right") - 1
                j = rank[at] - first[slot]
                seq[at] = base[slot] + j % times[slot]
                off[at] = begin[slot] + j // times[slot] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [*NAMES, "sequence_id", "offset"])

    return map_batches(ranked, place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pack all ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces, without their ids, are written once to the shared folder: the plan and
    the ranks read them, and no text is tokenized twice.
    """
    return place_pieces(materialise(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
