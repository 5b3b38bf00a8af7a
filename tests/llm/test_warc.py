import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from epilens.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows():
    big, other = "é" * 600, "x" * 1000
    out = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 40)) for i in range(30)]
    out += [(100, "u", big), (101, "u", big), (99, "u", big), (102, None, other), (103, "a\r\nb", other)]
    out += [(110, "u", "short"), (111, "u", "short"), (112, "u", None), (113, "u", ""), (114, "u", "y" * 999), (115, "u", "y" * 999)]
    out += [(120, "u", "z" * 2000), (120, "u", "z" * 2000), (None, "u", "z" * 2000), (None, None, None), (130, "u", "WARC/1.1\r\n\r\n" * 300)]
    return out


def want(data):
    last = {}
    for i, _, h in data:
        h = (h or "").encode()
        if i is not None and len(h) >= 1000:
            last[h] = max(last.get(h, i), i)
    for i, _, h in data:
        h = (h or "").encode()
        r = h in last and i != last[h]
        yield i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if r else "response", last[h] if r else None


@pytest.mark.parametrize("split", [97, 1500, 8 << 20])
def test_round_trip(spark, split):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3).withColumn("digest", F.lit(1))
    got = warc.round_trip(df, split_bytes=split).collect()
    key = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[k] for k in key) for r in got), key=str) == sorted(want(data), key=str)
    html = {(i, (h or "")) for i, _, h in data}
    for r in got:
        assert r.payload is None if r.record_type == "revisit" else (r.page_id, r.payload.decode()) in html
    assert {r.url for r in got if r.page_id in (102, 103)} == {"", "a%0D%0Ab"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reader_is_not_fooled_by_nested_members(spark, tmp_path):
    """A stored (uncompressed) member whose payload holds a whole member."""
    date = "2024-01-01T00:00:00Z"

    def record(i, payload):
        return warc._record(i, "u", payload, hashlib.sha1(payload).hexdigest(), len(payload), None, False, date)

    inner = record(9, b"inner" * 50)
    plain = gzip.decompress(record(1, b"-" * 300 + inner + b"-" * 300))
    outer = gzip.compress(plain, compresslevel=0)
    assert inner in outer
    path = tmp_path / "a.warc.gz"
    path.write_bytes(outer + record(2, b"tail"))
    manifest = spark.createDataFrame([(str(path), os.path.getsize(path))], "path string, bytes long")
    for split in (50, 333, 10**6):
        got = warc.read_warc(spark, manifest, split_bytes=split).collect()
        assert sorted(r.page_id for r in got) == [1, 2]


def test_archives_are_plain_gzip(spark, tmp_path):
    folder = str(tmp_path / "w")
    df = spark.createDataFrame([(1, "u", "hello")], SCHEMA)
    path = warc.write_warc(warc.mark_revisits(df), folder).first().path
    body = gzip.open(path).read()
    assert body.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\nhello\r\n\r\n")
