"""WARC archives: a Python data source that writes and reads them.

Reading plans the archives' files as partitions, takes record-type and header predicates from the query before anything
is read, parses a record's headers first, and skips payloads that the query does not want.
Files of this source hold a gzip member for each record and are read in ranges, from places that their list tells. Other
archives (.warc, .warc.gz) are read from the start, a partition for each file.
"""

from __future__ import annotations

import base64
import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import fresh_path, materialize, small_batches

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"

#: Header of a record for each column that a predicate can be pushed to.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of a file that one partition reads, and that lie at most between the places where one can start.
RANGE, STEP = 64 << 20, 1 << 20
#: Bytes that are read of a file at once.
AT_ONCE = 1 << 18
#: An extra gzip field before each record: its compressed size, so that a skipped record is not inflated.
_FIELD = b"LS"
#: Keys of a payload's group are dealt over so many parts, as one payload may be that of many pages.
SALTS = 16


def open_store(path: str) -> tuple:
    """(file system, path) for a path or URI, by pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """A gzip member whose header tells its own size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 8) + _FIELD + struct.pack("<HI", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row, now: str) -> bytes:
    """The bytes of one record; payloads of revisits stay out."""
    payload = b"" if row["record_type"] == "revisit" else bytes(row["payload"] or b"")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {now}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block) + len(payload)}",
    ]
    if row["target_uri"] is not None:
        head.insert(3, "WARC-Target-URI: " + " ".join(row["target_uri"].split()))
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {row['refers_to']}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + payload + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    starts: list[int] = field(default_factory=list)


class Writer(DataSourceWriter):
    """A task writes one file under a name of its own. A commit lists its files, and where their ranges may start, in a list of its own.

    Files that no list names are not read, so what a lost or repeated task leaves does no harm.
    """

    def __init__(self, path: str, overwrite: bool = False, step: int = STEP):
        self.path, self.overwrite, self.step = path, overwrite, step

    def write(self, rows: Iterator) -> Written:
        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        name, now, at, out, starts = f"{uuid.uuid4().hex}.warc.gz", datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), 0, None, []
        for row in rows:
            out = out or store.open_output_stream(f"{path}/{name}", compression=None)
            data = member(record(row, now))
            if not starts or at - starts[-1] >= self.step:
                starts.append(at)
            out.write(data)
            at += len(data)
        if out:
            out.close()
        return Written(name if out else None, [*starts, at])

    def commit(self, messages: list) -> None:
        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        before = lists(store, path) if self.overwrite else []
        gone = [n for m in before for n, _ in listed(store, path, m)]
        with store.open_output_stream(f"{path}/MANIFEST-{uuid.uuid4().hex}") as f:
            f.write("".join(f"{m.name} {','.join(map(str, m.starts))}\n" for m in messages if m and m.name).encode())
        for name in [*before, *gone]:
            store.delete_file(f"{path}/{name}")

    def abort(self, messages: list) -> None:
        store, path = open_store(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{path}/{m.name}")


def lists(store, path: str) -> list[str]:
    """Names of the folder's lists of files."""
    from pyarrow import fs

    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("MANIFEST-"))


def listed(store, path: str, name: str) -> list[tuple[str, list[int]]]:
    """(file, places where a range may start, then its size) of a list."""
    with store.open_input_stream(f"{path}/{name}") as f:
        rows = [x.split() for x in f.read().decode().splitlines()]
    return [(n, [int(x) for x in at.split(",")]) for n, at in rows]


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int  # -1 for a file that is read from its start to its end


def headers(data) -> dict[str, str] | None:
    """Names, in lower case, and values up to a blank line; None at the end of the data."""
    line, out = data.readline(), {}
    if not line:
        return None
    while line := line.rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
        line = data.readline()
    return out


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, size: int):
        self.path, self.schema, self.size, self.wanted = path, schema, size, []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Equalities and IN lists on header columns are applied while headers are parsed; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in HEADERS:
                self.wanted.append((column, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, path = open_store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Range("", 0, -1)]
        names = lists(store, path)
        if not names:
            other = [i.base_name for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.endswith((".warc", ".warc.gz"))]
            return [Range(n, 0, -1) for n in sorted(other)] or [Range("", 0, 0)]
        out = []
        for name, starts in sorted(x for m in names for x in listed(store, path, m)):
            at = starts[0]
            for after in starts[1:]:
                if after - at >= self.size or after == starts[-1]:
                    out.append(Range(name, at, after))
                    at = after
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.end == part.start:
            return
        columns = [f.name for f in self.schema.fields]
        store, path = open_store(self.path)
        with io.BufferedReader(store.open_input_file(f"{path}/{part.file}" if part.file else path), AT_ONCE) as f:
            if part.end < 0:
                yield from self.whole(f, columns)
                return
            at = part.start
            while at < part.end:
                f.seek(at)
                size = struct.unpack("<I", f.read(20)[16:20])[0]
                f.seek(at)
                row = self.parse(gzip.GzipFile(fileobj=f), columns)[0]
                if row:
                    yield row
                at += size

    def whole(self, f, columns: list[str]) -> Iterator[tuple]:
        """Records of any archive, in order. Payloads that are not wanted are passed over."""
        packed = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        data = io.BufferedReader(gzip.GzipFile(fileobj=f), AT_ONCE) if packed else f
        while True:
            row, left = self.parse(data, columns)
            if left is None:
                return
            if row:
                yield row
            if not packed:
                data.seek(left, io.SEEK_CUR)
                continue
            while left > 0:  # the rest of the block
                left -= len(data.read(min(left, AT_ONCE))) or left

    def parse(self, data, columns: list[str]) -> tuple[tuple | None, int | None]:
        """(row, bytes of the block that are left): None for a row that does not pass, None left at the end.

        Headers first; the payload is read only for a record that passes and if its column is asked for. The payload of
        an HTTP record is what follows its headers; that of another one is its block. A revisit tells its payload's size by its HTTP headers.
        """
        line = data.readline()
        while line and not line.strip():
            line = data.readline()
        if not line:
            return None, None
        head = headers(data) or {}
        left = int(head.get("content-length") or 0)
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
        if any(row[c] not in values for c, values in self.wanted):
            return None, left
        if "payload" in columns or "payload_bytes" in columns:
            block = Block(data, left)
            http = (headers(block) or {}) if head.get("content-type", "").startswith("application/http") else {}
            left, told = block.left, http.get("content-length", "")
            row["payload_bytes"] = left if row["record_type"] != "revisit" else int(told) if told.isdigit() else None
            row["payload"] = None
            if "payload" in columns and row["record_type"] != "revisit":
                row["payload"] = data.read(left)
                left = 0
        return tuple(row[c] for c in columns), left


class Block:
    """The lines of a record's block."""

    def __init__(self, data, left: int):
        self.data, self.left = data, left

    def readline(self) -> bytes:
        line = self.data.readline(self.left) if self.left else b""
        self.left -= len(line)
        return line


class WarcSource(DataSource):
    """spark.read.format("lodestone_warc").option("path", ...), and the same for writing.

    Options: path (a folder; for reading also one file), range_bytes (of a file, for one partition), step_bytes (of a
    written file, between places where a range may start). Modes: append adds files, overwrite replaces those of the folder's lists.
    """

    @classmethod
    def name(cls) -> str:
        return "lodestone_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("range_bytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("step_bytes", STEP)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32(digest):
    """Hexadecimal strings as upper-case base32."""
    return digest.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode(), na_action="ignore")


def digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of bytes."""
    return F.pandas_udf(base32, "string")(F.sha1(payload))


def archive(pages: DataFrame, path: str, *, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html", step: int = STEP) -> None:
    """Write one record per page to a new folder at path.

    Of pages with equal payloads of at least `least` bytes, that with the largest key is a response and holds the payload;
    the others are revisits that refer to it. Smaller payloads are all responses. A null html is an empty payload,
    a null url gives no target; of repeated rows with the largest key each is a response, and equal keys with other
    payloads are judged each by its own. A null key is smaller than all others.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("target_uri"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumns({"_sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # A hot payload is one key of this aggregate; partial aggregation leaves a row of it in each task. The join with it is salted.
    first = own.where(F.col("payload_bytes") >= least).groupBy("_sha").agg(F.max("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    first = first.select("_sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = own.select("_key", "_sha", F.pmod(F.hash("_key"), F.lit(SALTS)).alias("_salt"))
    other = salted.join(first, ["_sha", "_salt"]).where(~F.col("_key").eqNullSafe(F.col("_first")))
    refs = materialize(other.select(F.col("_key").alias("_k"), F.col("_sha").alias("_s"), "_first").distinct(), "revisits")
    record_id = lambda k: F.concat(F.lit("<urn:page:"), F.coalesce(k.cast("string"), F.lit("")), F.lit(">"))
    (
        own.join(refs, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s")), "left")
        .select(
            record_id(F.col("_key")).alias("record_id"),
            F.when(F.col("_first").isNull(), "response").otherwise("revisit").alias("record_type"),
            "target_uri",
            F.when(F.col("_first").isNotNull(), record_id(F.col("_first"))).alias("refers_to"),
            F.pandas_udf(base32, "string")("_sha").alias("payload_digest"),
            "payload_bytes",
            F.when(F.col("_first").isNull(), F.col("payload")).alias("payload"),
        )
        .write.format("lodestone_warc").mode("append").option("path", path).option("step_bytes", step).save()
    )


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records under path; filters on header columns are pushed down, payloads are left undecoded if not wanted."""
    register(spark)
    reader = spark.read.format("lodestone_warc").option("path", path)
    return reader.load() if payloads else reader.schema(SCHEMA.rpartition(",")[0]).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and return the records as read back, payloads included."""
    path = fresh_path(pages.sparkSession, "warc")
    archive(pages, path)
    return read(pages.sparkSession, path)
