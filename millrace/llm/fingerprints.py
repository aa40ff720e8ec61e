"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut by content into paragraphs: a line, or of a long line pieces that end with a sentence
after at least 100 characters, so an insertion changes the pieces around it and not all that
follow.  What a text holds is the set of (paragraph, how often it occurs), as 64-bit digests.  A
sketch hashes each digest into one cell of each of three tables; a cell holds a count, the XOR of
its digests and the XOR of their checks.  Sketches of two versions subtract cell by cell, and
peeling - take a cell that holds one digest, remove it from its other cells - recovers the digests
that differ.

The fingerprint is a small sketch of fixed size.  Where the difference of two fingerprints does
not peel, larger ones are made of both versions: the digests are dealt to blocks of about two
dozen by a hash, and each block has its own sketch, which grows by half at every retry until it
peels, so the work stays linear in the text.  The likeness of two versions is the Jaccard
similarity that the recovered difference D and the two sizes give: (a + b - D) / (a + b + D).

Everything is column expressions within one stage after one shuffle, which brings documents that
follow each other together.  Defined results: a null text is empty, two empty texts have likeness
1; null ids come first, rows with the same id follow in order of their text's hash; an only
document follows itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS, TABLES, ROUNDS, BLOCK, RETRIES = 6, 3, 12, 24, 40
PARAGRAPH = r"(?:[^\n]{100}[^\n.!?]{0,200}[.!?]*+|[^\n]{1,100})\S{0,64}[^\S\n]?\n?|\n"
ROWS, RANGES = 2048, 1 << 16  # rows of a range, and ranges at most; beyond 134 million rows ranges grow
CELL = "struct<c:int,k:bigint,h:int>"
ZERO = f"cast(struct(0 as c, 0L as k, 0 as h) as {CELL})"


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def digests(text: str) -> str:
    """SQL for the digests of a text: one for each different paragraph and its number of places."""
    pattern = PARAGRAPH.replace("\\", "\\\\")
    sorted_ = f"array_sort(transform(regexp_extract_all({text}, '{pattern}', 0), u -> xxhash64(u)))"
    starts = "filter(sequence(0, size(own) - 1), i -> i = 0 or get(own, i) <> get(own, i - 1))"
    counted = "transform(starts, (p, j) -> xxhash64(get(own, p), coalesce(get(starts, j + 1), size(own)) - p))"
    return _let(sorted_, "own", f"case when size(own) = 0 then cast(array() as array<bigint>) else {_let(starts, 'starts', counted)} end")


def _slots(key: str, slots: str, seed: int | str) -> str:
    return "array(" + ", ".join(f"cast(pmod(xxhash64({key}, {seed} + {t}), {slots}) as int)" for t in range(TABLES)) + ")"


def _cells(entries: str, slots: str, seed: int | str) -> str:
    """Cells of all tables from entries (k, c), the sign c being -1 for the version that is subtracted."""
    located = f"transform({entries}, e -> struct(e.k as k, e.c as c, hash(e.k) as h, {_slots('e.k', slots, seed)} as p))"
    merge = f"(a, x) -> cast(struct(a.c + x.c as c, a.k ^ x.k as k, a.h ^ x.h as h) as {CELL})"
    cell = f"aggregate(filter(placed, x -> get(x.p, cast(j div {slots} as int)) = j % {slots}), {ZERO}, {merge})"
    return _let(located, "placed", f"transform(sequence(0, cast({TABLES} * {slots} - 1 as int)), j -> {cell})")


def _peeled(cells: str, slots: str, seed: int | str) -> str:
    """The digests that peeling recovers, null if cells remain."""
    alone = f"filter(st.cells, (x, j) -> abs(x.c) = 1 and x.h = hash(x.k) and get({_slots('x.k', slots, seed)}, cast(j div {slots} as int)) = j % {slots})"
    pure = f"array_distinct(transform({alone}, x -> struct(x.k as k, x.c as c, {_slots('x.k', slots, seed)} as p)))"
    drop = f"aggregate(filter(pure, q -> get(q.p, cast(j div {slots} as int)) = j % {slots}), x, (a, q) -> cast(struct(a.c - q.c as c, a.k ^ q.k as k, a.h ^ hash(q.k) as h) as {CELL}))"
    state = "struct<cells:array<" + CELL + ">,found:array<struct<k:bigint,c:int>>>"
    step = _let(pure, "pure", f"case when size(pure) = 0 then st else cast(struct(transform(st.cells, (x, j) -> {drop}) as cells, concat(st.found, transform(pure, q -> struct(q.k as k, q.c as c))) as found) as {state}) end")
    start = f"cast(struct({cells} as cells, cast(array() as array<struct<k:bigint,c:int>>) as found) as {state})"
    done = "st -> case when forall(st.cells, x -> x.c = 0 and x.k = 0 and x.h = 0) then st.found end"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> {step}, {done})"


def sketch(keys: str) -> str:
    """The fixed-size sketch of a set of digests."""
    return _cells(f"transform({keys}, k -> struct(k as k, 1 as c))", str(SLOTS), 11)


def as_text(keys: str, cells: str) -> str:
    return f"concat_ws('.', cast(size({keys}) as string), array_join(transform({cells}, x -> concat(hex(x.c), '-', hex(x.k), '-', hex(x.h))), '.'))"


def difference(a_keys: str, a_cells: str, b_keys: str, b_cells: str) -> str:
    """Number of digests in one of two versions only: from the fixed sketches, else from larger ones."""

    def minus(one: str, other: str) -> str:
        return f"zip_with({one}, {other}, (x, y) -> cast(struct(x.c - y.c as c, x.k ^ y.k as k, x.h ^ y.h as h) as {CELL}))"

    small = f"case when abs(size({a_keys}) - size({b_keys})) <= {TABLES * SLOTS} then size({_peeled(minus(a_cells, b_cells), str(SLOTS), 11)}) end"
    side = lambda sign: f"transform(filter(block, e -> e.c {sign} 0), e -> struct(e.k as k, 1 as c))"
    larger = minus(_cells(side(">"), "s", "100 * again"), _cells(side("<"), "s", "100 * again"))
    attempt = _let("cast(ceil(size(block) * 0.25 * pow(1.5, again)) + 3 as int)", "s", f"size({_peeled(larger, 's', '100 * again')})")
    until = f"aggregate(sequence(1, {RETRIES}), cast(null as int), (found, again) -> coalesce(found, {attempt}), found -> coalesce(found, cast(raise_error('a sketch did not peel') as int)))"
    signed = f"concat(transform({a_keys}, k -> struct(k as k, 1 as c)), transform({b_keys}, k -> struct(k as k, -1 as c)))"
    blocks = f"greatest(1, cast(ceil((size({a_keys}) + size({b_keys})) / {BLOCK}) as int))"
    per_block = _let("filter(dealt, e -> e.b = n)", "block", f"case when size(block) = 0 then 0 else {until} end")
    large = _let(blocks, "nb", _let(f"transform({signed}, e -> struct(e.k as k, e.c as c, cast(pmod(xxhash64(e.k, 7), nb) as int) as b))", "dealt", f"aggregate(sequence(0, nb - 1), 0, (total, n) -> total + {per_block})"))
    return f"case when size({a_keys}) + size({b_keys}) = 0 then 0 else coalesce({small}, {large}) end"


def likeness(a_keys: str, b_keys: str, differ: str) -> str:
    total = f"(size({a_keys}) + size({b_keys}))"
    return f"case when {total} = 0 then 1.0D else cast({total} - {differ} as double) / ({total} + {differ}) end"


def _listed(rows: list[dict], fields: str) -> Column:
    """A literal list of structs, read from JSON in the JVM."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text, keys, next_text, next_keys: the text of the next document in order of doc_id, after the last the first.

    The order (id, hash of the text) is cut into ranges of about ``rows`` rows at places from a
    sample, so rows of one id are spread, too; each range also gets the first document of the
    next one, so a window over ranges finds every successor with one shuffle of the texts.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("at", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h")))
    n = d.count()
    ranges = min(RANGES, -(-n // rows))
    cuts: list = []
    if ranges > 1:  # at most 16 places for each range reach the driver
        some = sorted(tuple(r.at) for r in d.select("at").where(F.pmod(F.xxhash64("at", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * min(1, 16 * ranges / n))).collect())
        cuts = sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []
    if cuts:  # binary search among the cuts
        step = "(s, k) -> case when s.lo >= s.hi then s when get(cuts, cast((s.lo + s.hi) div 2 as int)) <= at then struct(cast((s.lo + s.hi) div 2 + 1 as int) as lo, s.hi as hi) else struct(s.lo as lo, cast((s.lo + s.hi) div 2 as int) as hi) end"
        search = F.expr(f"aggregate(sequence(1, {len(cuts).bit_length() + 1}), struct(0 as lo, {len(cuts)} as hi), {step}).lo")
        held = docs.sparkSession.range(1).select(_listed([{"id": i, "h": h} for i, h in cuts], "id:bigint,h:bigint").alias("cuts"))
        d = d.join(F.broadcast(held)).withColumn("range", search).drop("cuts")  # one row of at most `RANGES` cuts
    else:
        d = d.withColumn("range", F.lit(0))
    # the first place of each range, and the range before it, the last one's being before the first
    firsts = sorted((r.range, tuple(r.at)) for r in d.groupBy("range").agg(F.min("at").alias("at")).collect())
    before = [{"id": at[0], "h": at[1], "place": firsts[k - 1][0]} for k, (_, at) in enumerate(firsts)]
    heads = docs.sparkSession.range(1).select(F.inline(_listed(before, "id:bigint,h:bigint,place:int")))
    heads = F.broadcast(heads)  # at most `RANGES` rows
    first = d.join(heads, (F.col("at.id") == heads["id"]) & (F.col("at.h") == heads["h"])).select("doc_id", "text", "at", F.col("place").alias("range"))
    both = d.withColumn("head", F.lit(0)).unionByName(first.withColumn("head", F.lit(1)))
    w = Window.partitionBy("range").orderBy("head", "at")
    keyed = both.repartition("range").withColumn("keys", F.expr(digests("text")))
    return keyed.withColumns({"next_text": F.lead("text").over(w), "next_keys": F.lead("keys").over(w)}).where("head = 0").select("doc_id", "text", "keys", "next_text", "next_keys")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of
    the next document.
    """
    d = with_next(docs)
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", "next_keys", F.expr(digests("edited")).alias("edited_keys"))
    d = d.withColumns({f"{p}cells": F.expr(sketch(f"{p}keys")) for p in ("", "edited_", "next_")})
    d = d.withColumn("d_edited", F.expr(difference("keys", "cells", "edited_keys", "edited_cells")))
    d = d.withColumn("d_next", F.expr(difference("keys", "cells", "next_keys", "next_cells")))
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(as_text("keys", "cells")).alias("fingerprint"),
        F.expr(as_text("edited_keys", "edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("keys", "edited_keys", "d_edited")).alias("near_edited"),
        F.expr(likeness("keys", "next_keys", "d_next")).alias("near_next"),
    )
