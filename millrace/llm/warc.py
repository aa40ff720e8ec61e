"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record, so any record can be read by its range.
The index sorts captures by reversed-host URL key into zlib-compressed blocks of lines; a
segment keeps the first key of each of its blocks (the sparse directory).  The driver sees the
first keys of some thousand segments, however many there are.  A lookup binary-searches these, finds
the segments in a join, and binary-searches the directory and the block; then it
reads the record's range of the archive.

Archives are cut by their bytes, and read in streams and ranges, so no file is held whole.

Defined results: a null html is an empty payload, a null url is kept under ``urn:page``; a url
that cannot be parsed, or has no host, is its own key; every url is read back as it was;
a page_id that repeats gives a record for each row; payloads shorter than ``min_bytes``
are never revisits; an empty table gives no captures; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import drop, materialise, new_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_LINES, SEGMENT_BLOCKS, TOP_CUTS = 1024, 256, 4096
FILE_BYTES, TASK_BYTES, STEP = 64 << 20, 64 << 20, 1 << 16


def url_key(url: str) -> str:
    """Sort key with the host reversed: ``org,example,www)/path?query``; what has no host is its own key."""
    try:
        parts = urlsplit(url)
    except ValueError:  # such as an unclosed bracket in the host
        return url
    if not parts.netloc:
        return url
    host = ",".join(reversed(parts.netloc.lower().split(".")))
    rest = (parts.path or "/") + ("?" + parts.query if parts.query else "") + ("#" + parts.fragment if parts.fragment else "")
    return f"{host}){rest}"


def _base32(hexdigest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex, five hex digits at a time."""
    quarters = []
    for k in range(8):
        v = F.conv(F.substring(hexdigest, 1 + 5 * k, 5), 16, 10).cast("int")
        quarters += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(v, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*quarters)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to: null for responses.

    Only digests and ids are aggregated; a payload that many pages share is a skewed
    equi-join that adaptive execution splits.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1("html")).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    shared = p.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha1", "keeper")
    joined = p.join(shared, "sha1", "left")
    refers = F.when((F.col("payload_bytes") >= min_bytes) & (F.col("keeper") != F.col("page_id")), F.col("keeper"))
    return joined.select("page_id", "url", "html", "payload_bytes", _base32(F.col("sha1")).alias("payload_digest"), refers.alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, html: str, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header but not the payload."""
    name = "" if page_id is None else page_id
    uri = quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else f"urn:page:{name}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (html.encode() if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None and (uri != url or url.startswith("urn:page:")):  # some characters had to be coded; this undoes it exactly
        head.append(f"X-Source-URL: {quote(url, safe='')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields, record type and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    uri = fields["WARC-Target-URI"]
    url = unquote(fields["X-Source-URL"]) if "X-Source-URL" in fields else None if uri.startswith("urn:page:") else uri
    return {"type": fields["WARC-Type"], "url": url, "id": fields["WARC-Record-ID"][10:-1], "digest": fields["WARC-Payload-Digest"][5:], "refers_to": fields.get("WARC-Refers-To", "          ")[10:-1], "length": length, "payload": payload}


def member(data: bytes) -> bytes:
    """A gzip member of ``data`` that ends in a zero byte.

    The last byte of a member is the top byte of its size, zero below 16 MiB; a larger
    record is followed by an empty member.  The writer's row separator is that zero.
    """
    out = gzip.compress(data, 4, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def write_archives(records: DataFrame, file_bytes: int = FILE_BYTES) -> str:
    """Write ``records`` of :func:`plan_records` as ``.warc.gz`` data in files of about ``file_bytes``; returns the folder.

    Spark's text writer puts down the bytes of each row and a separator: with members that
    end in a zero byte, less that byte, and a zero byte as separator the files are plain
    concatenations of gzip members, written through the output committer on any store.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True)
                made = [member(record_bytes(*r))[:-1] for r in rows]
                parts = []
                for m in made:
                    parts.append(written // file_bytes)
                    written += len(m) + 1
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(parts, pa.int32())], ["value", "part"])

    path = new_path(records.sparkSession, "warc")
    rows = records.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to").mapInArrow(pack, "value binary, part int")
    rows.select(F.col("value").cast("string"), "part").write.option("lineSep", "\0").partitionBy("part").text(path)
    return path


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and first bytes (the record's header at least) of the gzip members of a stream."""
    data, at = stream.read(STEP), 0
    while data:
        inflate, begin, head = zlib.decompressobj(31), at, b""
        while data:
            out = inflate.decompress(data)
            if b"\r\n\r\n" not in head:
                head += out
            rest = inflate.unused_data
            at += len(data) - len(rest)
            data = rest or stream.read(STEP)
            if inflate.eof:
                break
        yield begin, at - begin, head


def captures(spark, folder: str) -> DataFrame:
    """key, file, offset, length of every record, from one sequential read of the archives."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(at) as stream:
                    for offset, length, head in members(stream):
                        if head:  # none in the empty member after a very large one
                            uri = next(x for x in head.split(b"\r\n") if x.startswith(b"WARC-Target-URI: "))[17:].decode()
                            rows.append((url_key(uri), path, offset, length))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])

    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.mapInArrow(scan, "key string, file string, offset long, length long")


def build_index(found: DataFrame, block_lines: int = BLOCK_LINES, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """Segments (segment, first_key, last_key, directory, blocks) of the captures in key order.

    Ranges are cut by key, file and offset, so the captures of one URL may fill many segments.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple[str, str]] = []
        blocks: list[tuple[str, str, bytes]] = []

        def close() -> None:
            nonlocal lines
            if lines:
                blocks.append((lines[0][0], lines[-1][0], zlib.compress("\n".join(x for _, x in lines).encode(), 6)))
                lines = []

        def segment() -> pa.RecordBatch:
            first, last, data = zip(*blocks, strict=True)
            blocks.clear()
            return pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([last[-1]]), pa.array([list(first)], pa.list_(pa.string())), pa.array([list(data)], pa.list_(pa.binary()))], ["first_key", "last_key", "directory", "blocks"])

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append((key, f"{key}\t{file}\t{offset}\t{length}"))
                if len(lines) == block_lines:
                    close()
                if len(blocks) == segment_blocks:
                    yield segment()
        close()
        if blocks:
            yield segment()

    ordered = found.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    out = ordered.mapInArrow(pack, "first_key string, last_key string, directory array<string>, blocks array<binary>")
    return out.withColumn("segment", F.concat_ws("#", "first_key", "last_key", F.md5(F.col("blocks")[0]), F.md5(F.element_at("blocks", -1))))


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """key, file, offset, length of the captures of each of ``keys`` (key, without repeats).

    The first keys of some segments cut the key space into parts; a segment stands in every part
    that it reaches into, a key in one, and they meet by part.  Keys that fall into one segment
    travel in groups, so its blocks are carried once for a group; a segment has a bounded number
    of captures, and so of keys.
    """
    tops = index.select("segment", "first_key", "last_key")
    n = tops.count()
    some = tops.where(F.pmod(F.xxhash64("segment"), F.lit(1 << 30)) < int((1 << 30) * min(1, TOP_CUTS / max(1, n))))
    cuts = sorted(r.first_key for r in some.select("first_key").collect())  # about TOP_CUTS at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = ([bisect.bisect_right(cuts, k) for k in batch.column(c).to_pylist()] for c in (1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["name", "first", "last", "low", "high"])

    kind = "name string, first string, last string, low int, high int"
    held = tops.mapInArrow(place, kind).select(F.col("name").alias("segment"), "first", "last", F.explode(F.sequence("low", "high")).alias("part"))
    asked = keys.select("key", F.col("key").alias("a"), F.col("key").alias("b")).mapInArrow(place, kind).select(F.col("name").alias("key"), F.col("low").alias("part"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted, directory, blocks in zip(*batch.columns, strict=True):
                rows, opened, lines, heads = [], -1, [], []
                directory = directory.as_py()
                for key in wanted.as_py():
                    at = max(0, bisect.bisect_left(directory, key) - 1)
                    while at < len(directory) and directory[at] <= key:
                        if opened != at:
                            opened, lines = at, zlib.decompress(blocks[at].as_py()).decode().split("\n")
                            heads = [x.split("\t", 1)[0] for x in lines]
                        for j in range(bisect.bisect_left(heads, key), bisect.bisect_right(heads, key)):
                            _, file, offset, length = lines[j].rsplit("\t", 3)
                            rows.append((key, file, int(offset), int(length)))
                        at += 1
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])

    routed = asked.join(held, "part").where("first <= key and key <= last").select("key", "segment")
    grouped = routed.groupBy("segment", F.expr("pmod(xxhash64(key), 16)")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    held = grouped.join(index.select("segment", "directory", "blocks"), "segment").select("keys", "directory", "blocks")
    return held.mapInArrow(find, "key string, file string, offset long, length long")


def read_captures(found: DataFrame) -> DataFrame:
    """The records at (file, offset, length): page_id, url, record_type, payload_bytes, payload_digest, refers_to, html.

    Reads only the ranges asked for, file by file in order of offset, in as many tasks as their
    bytes ask for.  ``found`` is read twice, so it should be a written table.  The digest of a
    response is taken from the payload that was read; a revisit has that of its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: tuple = (None, None)
        number = lambda x: int(x.rpartition(":")[2]) if x.rpartition(":")[2] else None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    if held[0] != file:
                        store, path = fs.FileSystem.from_uri(file)
                        held = (file, store.open_input_file(path))
                    held[1].seek(offset)
                    r = parse_record(gzip.decompress(held[1].read(length)))
                    whole = r["type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() if whole else r["digest"]
                    rows.append((number(r["id"]), r["url"], r["type"], len(r["payload"]) if whole else r["length"], digest, number(r["refers_to"].strip()), r["payload"].decode() if whole else None))
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"])

    size = found.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(2 * found.sparkSession.sparkContext.defaultParallelism, size >> 20))
    ordered = found.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return ordered.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages``, index the archives, and read every capture back through the index."""
    folder = write_archives(plan_records(pages, min_bytes))
    found = materialise(captures(pages.sparkSession, folder), "captures")
    index = materialise(build_index(found), "cdx")
    ranges = materialise(lookup(index, found.select("key").distinct()), "ranges")
    drop(found, index)
    return read_captures(ranges)
