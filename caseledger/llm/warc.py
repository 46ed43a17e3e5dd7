"""Operator 6, WARC archives with a two-level capture index.

Records are strings: Spark's text writer puts them to the shared folder, with the
CRLF pair that ends a record as its line separator, so a file is a plain
uncompressed WARC file, committed as Spark commits files. Readers open the files
by range. The index sorts captures by reversed-host URL key into compressed
blocks, one behind the other in flat files; a sparse directory holds the first and
last key of each block and where it lies. A look-up reads the part of the directory
that its keys span, finds their blocks by binary search, reads just these by range,
searches in them, and reads the records by range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path
from .common import query, saved, ship, table, tasks
from .files import mapped, new_name, opened

#: Lines of an index block, and bytes of an archive read at a time.
BLOCK_LINES, READ = 1024, 4 << 20

DATE = "1970-01-01T00:00:00Z"
URN = "urn:capture:"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://a.example.org/x?b=1`` is ``org,example,a)/x?b=1``.
    Scheme, port, a leading ``www``, user, fragment and case of the host don't count."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").strip(".")
    except ValueError:
        return f"){url}"
    host = host.removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _target(url: str | None) -> str | None:
    """A URL as its header holds it: a line break would end the header, blanks around it don't count."""
    if url and ("\r" in url or "\n" in url):
        url = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return url.strip() if url else url


def _packed(batches):
    for batch in batches:
        html = [x.encode("utf-8") if x is not None else b"" for x in batch.column(2).to_pylist()]
        press = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([len(x) for x in html], pa.int64()),
            pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in html]), pa.array([press.compress(x) for x in html], pa.binary())],
            ["page_id", "url", "payload_bytes", "payload_digest", "packed"])


def _digests(batches):
    for batch in batches:
        html = [x.encode("utf-8") if x is not None else b"" for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in html], pa.int64()),
                                          pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in html])],
                                         ["page_id", "payload_bytes", "payload_digest"])


def _record(page_id, url, n, digest, packed, first) -> str:
    revisit = first is not None and first != page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{first}>"]
    body = "" if revisit else zstandard.ZstdDecompressor().decompress(packed).decode("utf-8")
    return "\r\n".join([*head, f"Content-Length: {0 if revisit else n}", "", body])


def _records(batches):
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:  # few at a time: payloads are unpacked here
            rows = batch.slice(at, 256)
            at += 256
            yield pa.RecordBatch.from_arrays([pa.array([_record(*r) for r in zip(*(c.to_pylist() for c in rows.columns))], pa.string())], ["value"])


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0,
               page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes one record per row of ``pages``.

    Of records with equal payloads of at least ``least_bytes``, that with the
    smallest page_id is a response and the others revisit it; a null page_id is
    larger than any, and null ids alone are all responses. Null html is an empty payload, a null URL has no
    target header. Rows that repeat the smallest page_id are responses too.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    slim = saved(rows.select("page_id", "html").mapInArrow(_digests, "page_id long, payload_bytes long, payload_digest string"), "digests")
    first = slim.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes") \
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1") \
        .select(F.xxhash64("payload_digest").alias("k"), F.col("payload_digest").alias("d"), "first")
    # only slim rows are dealt by digest; Spark can split those of a hot payload
    revisits = slim.withColumn("dk", F.xxhash64("payload_digest")).join(first, (F.col("dk") == F.col("k")) & (F.col("payload_digest") == F.col("d"))) \
        .where("page_id <> first or page_id is null").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("pd"), "first").distinct()
    packed = rows.mapInArrow(_packed, "page_id long, url string, payload_bytes long, payload_digest string, packed binary")
    # payloads move at most once, compressed; not at all where the revisits are few enough to be sent to every task
    whole = packed.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("pd")), "left") \
        .select("page_id", "url", "payload_bytes", "payload_digest", "packed", "first")
    whole.mapInArrow(_records, "value string").write.option("lineSep", "\r\n\r\n").text(folder)


def _header(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines[1:])}


def scan(uri: str):
    """(offset, length, header, payload) of each record of a file, one after another."""
    with opened(uri)[0].open_input_stream(opened(uri)[1], compression=None) as f:
        held, at = bytearray(), 0

        def need(n: int) -> bool:
            while len(held) < n:
                more = f.read(max(READ, n - len(held)))
                if not more:
                    return False
                held.extend(more)
            return True

        while need(1):
            seen = 0
            while (end := held.find(b"\r\n\r\n", seen)) < 0:
                seen = max(0, len(held) - 3)
                if not need(len(held) + 1):
                    raise ValueError(f"{uri}: no end of header at {at}")
            lines = bytes(held[:end]).split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError(f"{uri}: no record at {at}")
            head = _header(lines)
            n = int(head["content-length"])
            if not need(end + 4 + n + 4) or held[end + 4 + n:end + 8 + n] != b"\r\n\r\n":
                raise ValueError(f"{uri}: record at {at} is cut off")
            yield at, end + 8 + n, head, bytes(held[end + 4:end + 4 + n])
            del held[:end + 8 + n]
            at += end + 8 + n


def _captures(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = [(url_key(h.get("warc-target-uri")), h.get("warc-target-uri"), uri, at, n) for at, n, h, _ in scan(uri)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                             ["key", "url", "file", "offset", "length"])


def index_captures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives: key, url, file, offset, length."""
    ship(spark)
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path")  # contents are not read
    spread = spark.sparkContext.defaultParallelism
    return files.repartition(spread).mapInArrow(_captures, "key string, url string, file string, offset long, length long")


DIRECTORY = "first string, last string, lines int, file string, offset long, length long"


def _blocks(folder: str):
    def run(batches):
        held, out, file, at = [], None, None, 0

        def block(lines):
            nonlocal out, file, at
            if out is None:
                where, path = opened(folder)
                where.create_dir(path, recursive=True)
                name = new_name("blocks")
                out, file = where.open_output_stream(f"{path}/{name}"), f"{folder}/{name}"
            body = zlib.compress("".join(json.dumps(x) + "\n" for x in lines).encode(), 1)
            out.write(body)
            at += len(body)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                (lines[0][0], lines[-1][0], len(lines), file, at - len(body), len(body)), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["first", "last", "lines", "file", "offset", "length"])

        for batch in batches:
            held += list(zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if held:
            yield block(held)
        if out is not None:
            out.close()

    return run


@dataclass
class Index:
    """Level two, the directory: a table in key order, stored at ``path``."""

    path: str
    directory: DataFrame


def build_index(captures: DataFrame) -> Index:
    """Level one, blocks of captures in key order, as flat files in the shared folder, and
    the directory of them. A file that a failed task leaves behind is in no directory."""
    spark = captures.sparkSession
    dealt = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    path = fresh_path(spark, "directory")
    dealt.mapInArrow(_blocks(fresh_path(spark, "index")), DIRECTORY).write.parquet(path)
    return Index(path, spark.read.schema(DIRECTORY).parquet(path))


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(_target(x)) for x in batch.column(0).to_pylist()], pa.string())], ["key"])


def _find(path: str):
    """Sorted keys to the blocks that hold them."""
    def run(batches):
        where, at = opened(path)
        directory = ds.dataset(at, filesystem=where, format="parquet")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if not keys:
                continue
            # only what the keys span is read: files and row groups outside are told by their statistics
            part = directory.to_table(filter=(ds.field("last") >= keys[0]) & (ds.field("first") <= keys[-1])).sort_by([("first", "ascending"), ("last", "ascending")])
            first, last = part.column("first").to_pylist(), part.column("last").to_pylist()
            key_of, block = [], []
            for key in keys:
                i = bisect_left(last, key)
                while i < len(first) and first[i] <= key:
                    key_of.append(key)
                    block.append(i)
                    i += 1
            rows = part.take(pa.array(block, pa.int64()))
            yield from pa.table([pa.array(key_of, pa.string()), *(rows.column(c) for c in ("file", "offset", "length"))], ["key", "file", "offset", "length"]).combine_chunks().to_batches()

    return run


CAPTURE = "key string, url string, file string, offset long, length long"


def _hits(batches):
    """(key, block) to the captures of the key in the block; rows of a block follow each other."""
    now, lines, names = None, [], []
    for batch in batches:
        out = []
        for key, uri, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (uri, offset):
                now = uri, offset
                with mapped(uri) as f:
                    f.seek(offset)
                    lines = [json.loads(x) for x in zlib.decompress(f.read(length)).splitlines()]
                names = [x[0] for x in lines]
            i = bisect_left(names, key)
            while i < len(names) and names[i] == key:
                out.append(lines[i])
                i += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                         ["key", "url", "file", "offset", "length"])


def lookup(index: Index, urls: DataFrame, url: str = "url") -> DataFrame:
    """All captures of the URLs in a column, each once: key, url, file, offset, length.

    URLs of one key are one search; a null or empty URL finds the captures without one; URLs
    that were never captured find nothing. The captures of a key that fills many blocks are
    read by as many tasks.
    """
    spark = urls.sparkSession
    ship(spark)
    keys = urls.select(F.col(url).alias("url")).mapInArrow(_keys, "key string").distinct()
    blocks = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_find(index.path), "key string, file string, offset long, length long")
    return blocks.repartition(tasks(spark), "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(_hits, CAPTURE)


def _resolve(payloads: bool):
    """Reads records by range, file by file."""
    def number(text):
        text = text.strip("<>").removeprefix(URN)
        return int(text) if text else None

    def run(batches):
        for batch in batches:
            lines = sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda x: (x[2], x[3]))
            out, name, f = [], None, None
            for key, url, uri, offset, length in lines:
                if uri != name:
                    name, f = uri, mapped(uri)
                f.seek(offset)
                raw = f.read(length)
                end = raw.index(b"\r\n\r\n")
                head, payload = _header(raw[:end].split(b"\r\n")), raw[end + 4:-4]
                kind = head["warc-type"]
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(head["x-payload-length"])):
                    raise ValueError(f"{uri}: payload at {offset} does not match its digest")
                out.append((number(head["warc-record-id"]), key, url, int(head["x-payload-length"]), digest, kind,
                            number(head["warc-refers-to"]) if kind == "revisit" else None, payload if payloads else None))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, kinds)],
                                             ["page_id", "url_key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def read_captures(hits: DataFrame, payloads: bool = False) -> DataFrame:
    """Captures that a look-up found, read by range: page_id, url_key, url, payload_bytes,
    payload_digest (checked for responses), record_type, refers_to; on request the payload,
    empty for revisits."""
    return hits.mapInArrow(_resolve(payloads), "page_id long, url_key string, url string, payload_bytes long, payload_digest string, record_type string, "
                                               "refers_to long, payload binary")


_SHA = "sha1(coalesce(html, ''))"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr({_SHA}, {5 * k + 1}, 5) AS BIGINT) >> {s}) % 32, 1)"
                      for k in range(8) for s in (15, 10, 5, 0))


@query("op6_warc", f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BASE32} AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    found = lookup(build_index(index_captures(spark, folder)), table(spark, sf_dir, "pages"))
    return read_captures(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
