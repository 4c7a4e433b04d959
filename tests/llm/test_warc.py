import base64
import gzip
import hashlib
import os
import random
import string

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from folioscope.llm import warc
from folioscope.llm.common import work_dir
from folioscope.llm.warc import SCHEMA, read_warc, warc_round_trip, write_warc
from tests.llm.cases import rows_of

PAGES = [
    (3, "http://a/", "<p>same</p>"), (1, "http://b/\r\nX: y", "<p>same</p>"), (2, None, None), (5, "http://c/", ""),
    (4, "http://d/", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "http://é/", "日本é" * 40_000),
    (None, "http://n/", "<p>same</p>"), (None, "http://n/", "only nulls"), (7, "u", "<p>same</p>"), (7, "u", "<p>same</p>"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        revisit = len(data) >= least and first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, sf):
    assert rows_of(warc_round_trip(frame(spark))) == brute(PAGES)
    assert rows_of(warc_round_trip(frame(spark), min_revisit_bytes=1)) == brute(PAGES, 1)
    assert rows_of(warc_round_trip(frame(spark, []))) == []
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows_of(warc_round_trip(pages)) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_filters_and_payloads(spark, compression):
    path = work_dir(spark, "w")
    write_warc(frame(spark), path, compression=compression)
    df = read_warc(spark, path, verify=True)
    assert df.schema == spark.createDataFrame([], SCHEMA).schema
    some = df.where("record_type = 'response' and page_id in (4, 6)")
    plan = some._jdf.queryExecution().toString()
    assert rows_of(some.select("page_id", F.col("payload").cast("string"))) == [(4, PAGES[4][2]), (6, PAGES[5][2])]
    assert "BatchScan" in plan
    assert df.where("record_type = 'revisit'").where("payload_bytes > 5").count() == 4


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_unwanted_payloads_are_not_read(spark, tmp_path, monkeypatch, compression):
    """Bytes that the reader asks its files for, over pages of a megabyte that doesn't compress."""
    path, size = f"file://{tmp_path}/w", 1_000_000
    rows = [(k, f"http://{k}/", "".join(random.Random(k).choices(string.printable, k=size))) for k in range(8)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, compression=compression)
    total = sum(f.stat().st_size for f in (tmp_path / "w").iterdir())
    read = []
    into = warc._Window.readinto

    def counted(self, target):
        n = into(self, target)
        read.append(n)
        return n

    monkeypatch.setattr(warc._Window, "readinto", counted)

    def rows_read(columns, wanted=()):
        read.clear()
        reader = warc.WarcReader({"path": path}, spark.createDataFrame([], columns).schema)
        assert list(reader.pushFilters(list(wanted))) == []
        return [r for part in reader.partitions() for r in reader.read(part)]

    assert sorted(rows_read("page_id long, payload_bytes long, record_type string")) == [(k, len(r[2].encode()), "response") for k, r in enumerate(rows)]
    assert sum(read) < 0.15 * total, (sum(read), total)
    found = rows_read("page_id long, payload binary", [EqualTo(("page_id",), 5)])
    assert [(k, bytes(p).decode()) for k, p in found] == [(5, rows[5][2])]
    assert sum(read) < 0.3 * total, (sum(read), total)


def test_copies_of_one_page_are_dealt_out(spark):
    """A third of all pages alike: their revisits are known before the join, and no task of it gets them all."""
    rows = [(k, "u", "the same" if k % 3 == 0 else f"own {k}") for k in range(900)] + [(None, "u", "the same")] * 20
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert rows_of(warc_round_trip(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_files_are_readable_by_the_book(spark):
    path = work_dir(spark, "w")
    write_warc(frame(spark), path, compression="gzip")
    local = path.removeprefix("file://")
    names = [n for n in os.listdir(local) if n.endswith(".warc.gz")]
    data = b"".join(gzip.decompress(open(f"{local}/{n}", "rb").read()) for n in names)
    count = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        n = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[n : n + 4] == b"\r\n\r\n"
        data, count = rest[n + 4 :], count + 1
    assert count == len(PAGES)
    for n in names:
        os.remove(f"{local}/{n}.idx")
    assert read_warc(spark, path, "page_id long, payload_bytes long").count() == len(PAGES)
    stray = f"{local}/part-dead.warc.gz"
    open(stray, "wb").write(b"half a rec")
    assert read_warc(spark, path, "page_id long").count() == len(PAGES)


def test_partitions_start_at_records(spark):
    path = work_dir(spark, "w")
    rows = [(i, "u", f"{i} " * 5000) for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").createOrReplaceTempView("many_pages")
    write_warc(spark.table("many_pages").coalesce(1), path)
    assert read_warc(spark, path, "page_id long").count() == 300
