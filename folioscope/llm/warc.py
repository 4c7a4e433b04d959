"""WARC 1.1 as a Spark data source, and deduplicating WARC output.

``spark.read.format("warc")`` reads .warc and .warc.gz files through pyarrow's
file systems. A file is cut into partitions at record starts: the writer
leaves a .cuts file beside it with the offset of about one record per
``split_mb``; without one a file is one partition. In a partition each
record's WARC header is parsed first; a record that the pushed filters
reject is skipped, its payload neither read nor decoded: in a plain file by its
Content-Length, in a compressed one by the next record's offset in the
writer's .idx file (a foreign .gz has none and is inflated throughout). The HTTP
header is parsed only if a column needs it, the payload is decoded only if a
column needs it. Select columns by ``.schema(...)``: Spark doesn't tell Python
sources which columns it wants.

``df.write.format("warc")`` writes one file a task under a name of its own
attempt; the driver's commit writes ``_MANIFEST`` with the files that count.
Readers take the manifest's files only, so a task that ran twice or died
leaves nothing that is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from folioscope.llm.common import stored, text_of, work_dir

#: Column -> WARC header.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "warc_date": "warc-date",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to_id": "warc-refers-to",
    "content_type": "content-type",
    "page_id": "x-page-id",
    "refers_to": "x-refers-to-page-id",
}
LONGS = {"page_id", "refers_to"}
SCHEMA = (
    "record_type string, record_id string, warc_date string, target_uri string, payload_digest string, "
    "refers_to_id string, content_type string, page_id long, refers_to long, payload_bytes long, payload binary"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Written dates are fixed, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


class WarcSource(DataSource):
    """Options: path; compression (write; none or gzip), verify (read; payloads are held against their digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema)
#: A digest of more than one in so many pages is dealt with apart.
HOT_SHARE = 10_000


@dataclass
class Slice(InputPartition):
    path: str
    start: int
    end: int | None


def _header_value(column: str, headers: dict[str, str]):
    text = headers.get(HEADERS[column])
    if text is None:
        return None
    if column == "payload_digest":
        return text.removeprefix("sha1:")
    return int(text) if column in LONGS else text


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.verify = options["path"], options.get("verify", "false").lower() == "true"
        self.columns = schema.names
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes column = value, IN and IS NOT NULL on header columns; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, ()))
            else:
                yield f

    def _accepts(self, headers: dict[str, str]) -> bool:
        for column, values in self.wanted:
            value = _header_value(column, headers)
            if value is None or values and value not in values:
                return False
        return True

    def partitions(self) -> list[Slice]:
        fs, top = _open(self.path)
        manifest = fs.get_file_info(f"{top}/_MANIFEST")
        if manifest.type == pafs.FileType.File:
            names = json.loads(fs.open_input_stream(f"{top}/_MANIFEST").read())
            files = [f"{top}/{n}" for n in names]
        elif fs.get_file_info(top).type == pafs.FileType.File:
            files = [top]
        else:
            found = fs.get_file_info(pafs.FileSelector(top, recursive=True))
            files = sorted(f.path for f in found if f.path.endswith((".warc", ".warc.gz")))
        slices = []
        for file in files:
            if fs.get_file_info(f"{file}.cuts").type == pafs.FileType.File:
                cuts = json.loads(fs.open_input_stream(f"{file}.cuts").read())
            else:
                cuts = [0]
            slices += [Slice(file, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return slices or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as raw:
            end = partition.end if partition.end is not None else raw.size()
            raw.seek(partition.start)
            if not partition.path.endswith(".gz"):
                yield from self._records(io.BufferedReader(_Window(raw, end), 1 << 16))
            elif fs.get_file_info(f"{partition.path}.idx").type == pafs.FileType.File:
                starts = np.frombuffer(fs.open_input_stream(f"{partition.path}.idx").read(), "<u8")
                mine = starts[(starts >= partition.start) & (starts < end)].tolist()
                # A member and no more is read; of one whose payload isn't asked for, or that a filter may leave out, its head first.
                head = 1 << 12 if self.wanted or not ("payload" in self.columns or self.verify) else 1 << 17
                for at, following in zip(mine, [*mine[1:], end]):
                    raw.seek(at)
                    member = gzip.GzipFile(fileobj=_Window(raw, following, head))
                    yield from self._records(member, one=True)
            else:
                yield from self._records(gzip.GzipFile(fileobj=_Window(raw, end)))

    def _records(self, stream, one: bool = False) -> Iterator[tuple]:
        """``one``: ends after a record, without a look at what it leaves."""
        need_http = "payload_bytes" in self.columns or "payload" in self.columns or self.verify
        need_body = "payload" in self.columns or self.verify
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record starts with {line[:40]!r}")
            headers = _read_headers(stream)
            length = int(headers.get("content-length", 0))
            if not self._accepts(headers):
                if one:
                    return
                _skip(stream, length)
                continue
            row = dict.fromkeys(self.columns)
            for column in self.columns:
                if column in HEADERS:
                    row[column] = _header_value(column, headers)
            if need_http:
                http, used = {}, 0
                if headers.get("content-type", "").startswith("application/http"):
                    status = stream.readline()
                    http = _read_headers(stream)
                    used = len(status) + http.pop("", 0)
                rest = length - used
                body = stream.read(rest) if need_body else None
                if not need_body and not one:
                    _skip(stream, rest)
                if "payload_bytes" in row:
                    row["payload_bytes"] = int(http.get("content-length", rest))
                if self.verify and headers.get("warc-type") == "response":
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if headers.get("warc-payload-digest") not in (None, f"sha1:{digest}"):
                        raise ValueError(f"payload of {headers.get('warc-record-id')} doesn't have its digest")
                if "payload" in row:
                    row["payload"] = body
            elif not one:
                _skip(stream, length)
            yield tuple(row[c] for c in self.columns)
            if one:
                return


class _Window(io.RawIOBase):
    """A file up to ``end``; the first read gives ``head`` bytes at most, each further one up to twice as many as the one before."""

    def __init__(self, raw, end: int, head: int = 1 << 20):
        self._raw, self._end, self._most = raw, end, head

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._raw.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        return self._raw.seek(at, whence) if whence != 2 else self._raw.seek(self._end + at)

    def readinto(self, into) -> int:
        data = self._raw.read(max(0, min(len(into), self._most, self._end - self._raw.tell())))
        self._most = min(2 * self._most, 1 << 20)
        into[: len(data)] = data
        return len(data)


def _skip(stream, n: int) -> None:
    """Plain files are seeked over what is not wanted."""
    if isinstance(stream, io.BufferedReader):
        stream.seek(n, 1)
        return
    while n > 0 and (data := stream.read(min(n, 1 << 20))):
        n -= len(data)


def _read_headers(stream) -> dict[str, str]:
    """Lower-cased names; "" has the number of bytes read."""
    found: dict = {}
    used, last = 0, None
    while line := stream.readline():
        used += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        found[last] = value.strip()
    found[""] = used
    return found


def _uri(url: str | None) -> str:
    """A header value is one line."""
    return "".join(f"%{ord(c):02X}" if c < " " else c for c in url or "")


def record(page_id, url, payload: bytes, payload_bytes: int, sha1_hex: str, refers_to, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header and no payload."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    body = http if revisit else http + payload
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Takes columns page_id, url, payload (binary), payload_bytes, sha1, refers_to, revisit."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.gzip = options["path"], options.get("compression", "none") == "gzip"
        self.split = int(options.get("split_mb", "32")) << 20
        self.names = schema.names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = _open(self.path)
        fs.create_dir(top, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        out, at, cuts, starts = None, 0, [0], array("Q")
        for batch in iterator:
            columns = [batch.column(self.names.index(c)) for c in ("page_id", "url", "payload", "payload_bytes", "sha1", "refers_to", "revisit")]
            for k in range(batch.num_rows):
                page_id, url, payload, n, sha1, refers_to, revisit = (c[k].as_py() for c in columns)
                data = record(page_id, url, payload or b"", n, sha1, refers_to, revisit)
                if self.gzip:
                    data = gzip.compress(data, 1, mtime=0)
                out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
                if at - cuts[-1] >= self.split:
                    cuts.append(at)
                starts.append(at)
                out.write(data)
                at += len(data)
        if out is None:
            return Written(None)
        out.close()
        with fs.open_output_stream(f"{top}/{name}.cuts") as side:
            side.write(json.dumps(cuts).encode())
        if self.gzip:
            with fs.open_output_stream(f"{top}/{name}.idx") as side:
                side.write(np.frombuffer(starts, np.uint64).astype("<u8").tobytes())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = _open(self.path)
        fs.create_dir(top, recursive=True)
        names = sorted(m.name for m in messages if m and m.name)
        with fs.open_output_stream(f"{top}/_MANIFEST") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = _open(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{top}/{m.name}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    compression: str = "none",
) -> None:
    """A record per row, payload the UTF-8 of ``html_col``.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the one with
    the smallest id is a response and the others revisit it; smaller ones
    are all responses. The digests are grouped map-side first; payloads are
    shuffled once. Digests of more than 1 in HOT_SHARE of all pages, fewer than
    HOT_SHARE by that, are broadcast; their revisits go without a payload.

    Defined cases: a null payload is empty; null ids come after all others
    (a group of null ids only is all responses); rows that repeat the
    smallest id are responses each; a null url is an empty target; control
    characters in a url are percent-encoded; an empty table writes an empty
    manifest; payloads of any length are one record; other columns are
    ignored.
    """
    register(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        text_of(html_col).cast("binary").alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    firsts = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    firsts = stored(firsts.where("n > 1"), "shared-digests")
    floor = max(1, pages.count() // HOT_SHARE)
    hot = firsts.where(F.col("n") > floor).select("sha1", F.col("first").alias("hot_first"))
    known = rows.join(F.broadcast(hot), "sha1", "left")
    # What a hot digest's row revisits is known by now: it has nothing to meet, and its payload isn't moved.
    known = known.withColumn("payload", F.when(F.col("hot_first").isNull() | F.col("page_id").eqNullSafe(F.col("hot_first")), F.col("payload")))
    scattered = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    known = known.withColumn("meets", F.when(F.col("hot_first").isNull(), F.col("sha1")).otherwise(scattered))
    rest = firsts.where(F.col("n") <= floor).select(F.col("sha1").alias("meets"), F.col("first").alias("rest_first"))
    joined = known.join(rest, "meets", "left").withColumn("first", F.coalesce("hot_first", "rest_first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "sha1",
        F.when(revisit, F.col("first")).alias("refers_to"),
        revisit.alias("revisit"),
    ).write.format("warc").mode("append").option("path", path).option("compression", compression).save()


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """``columns`` is a schema string with the columns to decode; header filters on the result are pushed down."""
    register(spark)
    return spark.read.format("warc").schema(columns).option("path", path).option("verify", str(verify).lower()).load()


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the archives back."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc", keep=True)
    write_warc(pages, path, min_revisit_bytes=min_revisit_bytes, compression="gzip")
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read_warc(spark, path, columns, verify=True).where(F.col("record_type").isin("response", "revisit"))
