"""WARC archives: a writer with revisit records and a splittable reader.

Writer: every row becomes one gzip member holding one WARC/1.1 record. Of
records with equal payloads of at least ``min_revisit`` bytes, the one with
the largest id is a ``response``; the others are ``revisit`` records without a
block, that name it. Each task writes one archive under a name of its own
attempt, and the manifest (a Parquet table, committed by Spark) lists only
the archives of tasks that succeeded: a repeated or lost task leaves at most
an unlisted file.

Reader: archives are cut into byte ranges of ``split_bytes``. A task looks in
its range for the gzip magic, accepts a candidate only if the whole member
decodes, starts with a WARC header and is followed by another member or the
end of the file, and from there walks member by member. It owns the records
that start inside its range, reading past the range's end for the last one.
Payloads are inflated in pieces, so an archive of any size is read in bounded
memory (``with_payload`` holds one payload at a time).

Files are reached through ``pyarrow.fs``, so the folder may be any location
that it knows (file, s3, gs, hdfs).

Cases: a null payload is empty; empty and short payloads are never
deduplicated; rows with the same id and payload are all responses if they
hold the largest id; a null id is written as an empty id, never
chosen as response if another row of its group has an id, and comes back as
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import prepare
from epilens.session import staging_path

MIN_REVISIT = 1000
SPLIT_BYTES = 8 << 20
_PIECE = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_MANIFEST = "path string, bytes long"
_RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary"
)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def _record(page_id, url, payload: bytes, digest: str, n_bytes: int, refers_to, is_revisit: bool, date: str) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/octet-stream",
    ]
    if is_revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>",
        ]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return (
        gz.compress("\r\n".join(head).encode("utf-8", "surrogatepass"))
        + gz.compress(b"\r\n\r\n")
        + gz.compress(payload)
        + gz.compress(b"\r\n\r\n")
        + gz.flush()
    )


def mark_revisits(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT
) -> DataFrame:
    """(page_id, url, payload, digest, n_bytes, refers_to, is_revisit).

    Groups meet as digests only: one row per task and digest is shuffled for
    the maximum; the join back is a plain equi-join, whose hot digests
    adaptive execution splits."""
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long"))
    long = rows.where(F.col("n_bytes") >= min_revisit)
    last = (
        long.groupBy("digest")
        .agg(F.max("page_id").alias("last_id"), F.count("*").alias("n"))
        .where("n > 1 AND last_id IS NOT NULL")
        .drop("n")
    )
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("last_id")) & F.col("last_id").isNotNull(), F.lit(False))
    return rows.join(last, "digest", "left").select(
        "page_id", "url", "payload", "digest", "n_bytes",
        F.when(revisit, F.col("last_id")).alias("refers_to"),
        revisit.alias("is_revisit"),
    )


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write ``mark_revisits`` rows as archives under ``folder``; the manifest."""
    prepare(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        out, name, size = None, "", 0
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                row = [b.column(k)[i].as_py() for k in range(7)]
                size += out.write(_record(*row, date))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size]})

    return records.mapInArrow(write, _MANIFEST)


class _Window:
    """Bytes of a file from a moving start on, read ahead in pieces."""

    def __init__(self, f, at: int, size: int):
        self.f, self.size = f, size
        self.seek(at)

    def seek(self, at: int) -> None:
        self.at, self.buf = at, b""

    def more(self) -> bytes:
        """The next piece from ``at`` on (empty at the end of the file)."""
        if not self.buf and self.at < self.size:
            self.f.seek(self.at)
            self.buf = self.f.read(min(_PIECE, self.size - self.at))
        piece, self.buf = self.buf, b""
        self.at += len(piece)
        return piece

    def back(self, rest: bytes) -> None:
        self.buf = rest + self.buf
        self.at -= len(rest)


def _member(win: _Window, keep: bool):
    """Decode the member at the window's start: (headers, payload digest,
    payload length, payload or None). Raises ValueError if it is none."""
    gz, head, fields, left = zlib.decompressobj(31), b"", None, 0
    sha, n, kept = hashlib.sha1(), 0, []
    while not gz.eof:
        piece = gz.unconsumed_tail or win.more()
        try:
            data = gz.decompress(piece, _PIECE)  # may hold output back
        except zlib.error as e:
            raise ValueError(str(e)) from e
        if not piece and not data and not gz.eof:
            raise ValueError("truncated member")
        if fields is None:
            head += data
            if not b"WARC/1.".startswith(head[:7]):
                raise ValueError("no WARC header")
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            fields = {}
            for line in head[:end].split(b"\r\n")[1:]:
                k, _, v = line.partition(b": ")
                fields[k.lower()] = v.decode("utf-8", "surrogatepass")
            if not fields.get(b"content-length", "").isdigit() or b"warc-type" not in fields:
                raise ValueError("incomplete WARC header")
            left, data = int(fields[b"content-length"]), head[end + 4 :]
        part = data[:left]
        left -= len(part)
        sha.update(part)
        n += len(part)
        if keep:
            kept.append(part)
    win.back(gz.unused_data)
    if fields is None or left:
        raise ValueError("incomplete record")
    return fields, sha.hexdigest(), n, b"".join(kept) if keep else None


def _follows(win: _Window) -> bool:
    """Whether another member or the end of the file comes next."""
    piece = win.more()
    if 0 < len(piece) < 3:
        piece += win.more()
    win.back(piece)
    return not piece or piece.startswith(_MAGIC)


def _first_member(win: _Window, start: int, end: int) -> int | None:
    """Offset of the first record that starts in [start, end)."""
    at, tail = start, b""
    while at < min(end + 2, win.size):  # the magic may cross the pieces
        win.f.seek(at)
        block = tail + win.f.read(min(_PIECE, min(end + 2, win.size) - at))
        base = at - len(tail)
        i = block.find(_MAGIC)
        while i >= 0:
            if base + i >= end:
                return None
            win.seek(base + i)
            try:
                _member(win, False)
                if _follows(win):
                    return base + i
            except ValueError:
                pass
            i = block.find(_MAGIC, i + 1)
        at = base + len(block)
        tail = block[-2:]
        if len(block) <= 2:
            break
    return None


def _page(urn: str) -> int | None:
    body = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body else None


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the listed archives. A revisit has the digest and length of
    the full payload, from its header, and no payload."""
    prepare(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                fs, local = _filesystem(path)
                with fs.open_input_file(local) as f:
                    win = _Window(f, start, size)
                    at = _first_member(win, start, start + split_bytes)
                    rows: list[tuple] = []
                    held = 0
                    if at is not None:
                        win.seek(at)
                    while at is not None and win.at < min(start + split_bytes, size):
                        h, digest, n, payload = _member(win, with_payload)
                        revisit = h[b"warc-type"] == "revisit"
                        if revisit:
                            digest, n, payload = h[b"warc-payload-digest"].removeprefix("sha1:"), int(h[b"x-payload-length"]), None
                        refers = _page(h[b"warc-refers-to"]) if revisit else None
                        rows.append((_page(h[b"warc-record-id"]), h.get(b"warc-target-uri"), h[b"warc-type"], refers, n, digest, payload))
                        held += 200 + len(payload or b"")
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    ranges = manifest.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start")
    )
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n).mapInArrow(read, _RECORD)


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def round_trip(pages: DataFrame, with_payload: bool = True, split_bytes: int = SPLIT_BYTES, **columns) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    root = staging_path(spark, "warc")
    write_warc(mark_revisits(pages, **columns), f"{root}/archives").write.parquet(f"{root}/manifest")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    return read_warc(spark, manifest, split_bytes, with_payload)
