"""Web archives: a writer, and a reader that splits files anywhere.

An archive is a row of gzip members, one WARC record each.  A task reads a byte range:
it looks for the first bytes of a gzip member, decodes what follows and accepts it if
a WARC header comes out, and owns the records that start inside its range.  So ranges
need no index, each record is read once, and one record at a time is in memory.

Files are written by the tasks to the shared folder of ``spark.checkpoint.dir``, each
attempt under a name of its own; the manifest names those of the attempts that count.
``pyarrow.fs`` opens the folder, so it can be of any kind that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage, new_folder

#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Pages of one payload that meet in a task when their response is looked up.
SLICE = 1000
#: A writer begins a new file after so many bytes; a reader's range has so many.
ARCHIVE_BYTES, SPLIT_BYTES = 256 << 20, 8 << 20
#: Reading tasks at most; beyond that, tasks read several ranges.
READ_TASKS = 100_000
_MAGIC, _BLOCK = b"\x1f\x8b\x08", 1 << 16
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None,
            unique: str) -> bytes:
    target = quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._")
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, unique)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page-Id: {refers}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records(record_type, page_id, url, html, payload_digest, refers_to)``.

    Returns the manifest ``(path, bytes)``; running it writes the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        out, name, size, number = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{root}/pages-{attempt:08d}-{len(done):04d}.warc.gz"
                    out, size = store.open_output_stream(name, compression=None), 0
                payload = (row["html"] or "").encode("utf-8", "replace")
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                unique = f"{folder}/{attempt}/{number}"
                data = packer.compress(_record(row["record_type"], row["page_id"], row["url"], payload,
                                               row["payload_digest"], row["refers_to"], unique)) + packer.flush()
                out.write(data)
                size += len(data)
                number += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["path", "bytes"]
        )

    return records.mapInArrow(run, "path string, bytes long")


class _Window:
    """Bytes of a file from some place on, read in blocks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place: int) -> bytes:
        """Some bytes from ``place`` on; none at the end of the file."""
        if not self.start <= place < self.start + len(self.data):
            self.file.seek(place)
            self.start, self.data = place, self.file.read(_BLOCK)
        return self.data[place - self.start :]

    def find(self, place: int, end: int) -> int | None:
        """The next first bytes of a gzip member that lie at ``place`` or later, before ``end``."""
        while place < end:
            data = self.at(place)
            if len(data) < len(_MAGIC):
                self.file.seek(place)
                self.start, self.data = place, self.file.read(_BLOCK)
                data = self.data
                if len(data) < len(_MAGIC):
                    return None
            found = data.find(_MAGIC)
            if found >= 0:
                return place + found if place + found < end else None
            place += len(data) - len(_MAGIC) + 1
        return None


def _decode(window: _Window, place: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and end of the record at ``place``; None if there is none."""
    unpacker, out, at = zlib.decompressobj(31), [], place
    checked = False
    try:
        while not unpacker.eof:
            data = window.at(at)
            if not data:
                return None
            out.append(unpacker.decompress(data))
            at += len(data) - len(unpacker.unused_data)
            if not checked and sum(map(len, out[:2])) >= 5:
                if not b"".join(out[:2]).startswith(b"WARC/"):
                    return None
                checked = True
    except zlib.error:
        return None
    head, split, block = b"".join(out).partition(b"\r\n\r\n")
    if not split or not head.startswith(b"WARC/"):
        return None
    header = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        header[name.strip().lower()] = value.strip()
    if not header.get("content-length", "").isdigit() or int(header["content-length"]) > len(block):
        return None
    return header, block[: int(header["content-length"])], at


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record that starts in ``[start, end)``."""
    window, place = _Window(file, size), start
    while (found := window.find(place, end)) is not None:
        record = _decode(window, found)
        if record is None:
            place = found + 1
            continue
        yield record[0], record[1]
        place = record[2]


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The response and revisit records of all files in ``manifest(path, bytes)``.

    Ranges are dealt to as many tasks by number, since adaptive execution would join
    them: their rows are tiny, whatever lies behind them.
    The payload of a response is read and its digest computed; one that differs from the
    header is an error.  A revisit tells size and digest of the payload it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for job in batch.to_pylist():
                rows = []
                with store.open_input_file(job["path"]) as file:
                    for header, block in records_in(file, job["bytes"], job["start"], job["start"] + split_bytes):
                        kind = header.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = header["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            size, own = len(payload), hashlib.sha256(payload).hexdigest()
                            if own != digest:
                                raise ValueError(f"{job['path']}: payload of {header['warc-record-id']} is damaged")
                        else:
                            fields = dict(x.lower().split(": ", 1) for x in http.decode().split("\r\n")[1:])
                            size = int(fields["content-length"])
                        page, refers = header.get("x-page-id"), header.get("x-refers-to-page-id")
                        rows.append((page and int(page), size, digest, kind, refers and int(refers)))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.where(F.col("bytes") > 0).select("path", "bytes", starts.alias("start"))
    ranges = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    return splits.repartition(max(1, min(ranges, READ_TASKS))).mapInArrow(run, READ)


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Record type and digest of each page.

    Of the pages with equal payloads of ``revisit_bytes`` or more, those with the smallest
    page_id are responses (all rows of it, if rows repeat) and the others revisit it.  A
    NULL page_id is never the smallest; pages without any id are all responses.  NULL html
    is an empty payload.  Other columns are not looked at.

    A payload of more than ``SLICE`` pages is split by its pages' ids, and the one row that
    names its response is repeated per slice; payloads that need no look-up go anywhere.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.sha2(html, 256).alias("payload_digest"),
    )
    long_enough = F.octet_length("html") >= revisit_bytes
    repeated = cut_lineage(
        hashed.where(long_enough).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull()),
        "warc-repeated",
    )
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    hot = repeated.where(F.col("n") > SLICE).select("payload_digest", slices.alias("slices"))
    firsts = repeated.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    page = F.xxhash64("page_id", "url")
    dealt = hashed.join(hot, "payload_digest", "left").withColumn(
        "slice", F.pmod(page, F.when(long_enough, F.coalesce("slices", F.lit(1))).otherwise(1 << 20)).cast("int")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return dealt.join(firsts, ["payload_digest", "slice"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "page_id", "url", "html", "payload_digest", F.when(revisit, F.col("first")).alias("refers_to"),
    )


def archive_pages(spark: SparkSession, pages: DataFrame, **sizes) -> DataFrame:
    """Write all pages to archives and read the archives back: a row per record."""
    folder = new_folder(spark, "warc")
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    _make_folder(folder)
    manifest = cut_lineage(
        write_archives(plan_records(pages), folder, sizes.get("archive_bytes", ARCHIVE_BYTES)), "warc-manifest"
    )
    return read_archives(manifest, folder, sizes.get("split_bytes", SPLIT_BYTES))


def _make_folder(folder: str) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
