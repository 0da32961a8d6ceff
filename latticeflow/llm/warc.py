"""Deterministic sharded WARC writer and verifying reader.

Records are sorted by (id, digest) and cut into ranges of about RANGE_BYTES, by
exact running sums, so the layout of the archive depends on the data alone, not
on partitions or cores. Files of a range roll by compressed size. Each file is written under a temporary name of its attempt and
moved to its final name, so a task that runs again only replaces equal bytes;
the manifest table lists what was committed, and the reader takes only files
that the manifest names, with the size and checksum that it gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table

MIN_REVISIT_BYTES = 0
ROLL_BYTES = 16 << 20
#: Payload bytes of a range, what a record adds to them, and how many ranges there
#: are at most: their bounds are broadcast. Beyond that ranges grow (1 GB at 100 TB).
RANGE_BYTES, RECORD_BYTES, MAX_RANGES = 16 << 20, 512, 100_000
DATE = "2024-01-01T00:00:00Z"
_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, bytes long, sha256 string, records long"
RECORD = (
    "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string"
)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; any store that Arrow reads, or a shared mount."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", uri)
    return (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, key: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member. The record id depends on the key alone."""
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(key)),
        ("WARC-Date", DATE),
        *headers,
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NS, key)}>"


def _header_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes, first: tuple | None) -> bytes:
    """response (first is None), or a revisit of the page whose id first holds, which may be null."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Target-URI", _header_safe(url))] if url else []
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if first is None:
        return _record("response", f"{page_id} {digest}", headers, http + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(f"{first[0]} {digest}"))]
    if first[0] is not None:
        headers.append(("X-Refers-To-Page-Id", str(first[0])))
    return _record("revisit", f"{page_id} {digest} revisit", headers, http)


def _bounds(keys: DataFrame, range_bytes: int) -> list[tuple]:
    """The first (id, sha) of each range but the first, in order, null ids first;
    from keys (id, sha, bytes). Equal keys stay in one range."""
    summed = keys.groupBy("id", "sha").agg(F.sum("bytes").alias("bytes"))
    ordered = summed.repartitionByRange("id", "sha").sortWithinPartitions("id", "sha")
    rows = Table(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered").df
    # Where the partitions lie is up to Spark; the order of all rows, and so the sum before each, is not.
    sums = sorted((r["part"], r["bytes"]) for r in rows.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect())
    starts, total = [], 0
    for part, size in sums:
        starts.append((part, total))
        total += size
    if total <= range_bytes:
        return []
    range_bytes = max(range_bytes, -(-total // MAX_RANGES))
    before = F.sum("bytes").over(W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long")), "part")
    cut = F.floor((F.col("start") + F.coalesce(before, F.lit(0))) / range_bytes)
    firsts = placed.withColumn("cut", cut).groupBy("cut").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "sha")).alias("k")).where("cut > 0")
    return sorted((r["k"]["some"], r["k"]["id"] or 0, r["k"]["sha"]) for r in firsts.collect())


def _range_of(spark: SparkSession, bounds: list[tuple]) -> Column:
    """The number of the range of a row's id and sha; only those two go to Python."""
    if not bounds:
        return F.lit(0)
    sent = spark.sparkContext.broadcast(bounds)

    def find(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, shas in pairs:
            rows = zip(ids.to_pylist(), shas.to_pylist(), strict=True)
            yield pa.array([bisect_right(sent.value, (i is not None, i or 0, sha)) for i, sha in rows], pa.int32())

    return F.arrow_udf(find, T.IntegerType())("id", "sha")


class _Roller:
    """Writes the records of one range; yields a manifest row for each closed file."""

    def __init__(self, out: str, part: int, attempt: int, roll: int):
        self.fs, self.root = _open(out)
        self.part, self.roll, self.n = part, roll, 0
        self.tmp = f"{self.root}/_temporary/{part}-{attempt}-{uuid.uuid4().hex}"
        self.stream = None

    def add(self, member: bytes) -> dict | None:
        closed = self.close() if self.stream is not None and self.size + len(member) > self.roll else None
        if self.stream is None:
            self.fs.create_dir(self.tmp)
            self.name = f"part-{self.part:06d}-{self.n:05d}.warc.gz"
            self.stream = self.fs.open_output_stream(f"{self.tmp}/{self.name}", compression=None)
            self.size, self.records, self.sum = 0, 0, hashlib.sha256()
            info = b"software: latticeflow\r\nformat: WARC File Format 1.1\r\n"
            self._put(_record("warcinfo", self.name, [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records += 1
        return closed

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> dict | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.fs.move(f"{self.tmp}/{self.name}", f"{self.root}/{self.name}")
        self.stream = None
        self.n += 1
        return {"file": self.name, "bytes": self.size, "sha256": self.sum.hexdigest(), "records": self.records}


def write(
    pages: DataFrame,
    out: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    roll_bytes: int = ROLL_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    partitions: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Write one record per row under out (a new shared folder); returns the manifest.

    Of rows with equal payloads of at least min_revisit_bytes the one of smallest
    id is the response, the others revisit it; of repeated (id, payload) rows the
    first is the response. Null payloads are empty. Rows with a null id revisit
    like any other; if no row of a payload has an id, one of them is the response
    and what revisits it names no id. A null or empty url is left out of the
    record. An empty table gives an empty manifest. Payloads are strings (written
    as UTF-8) or binary. The files depend on the rows, roll_bytes and range_bytes
    only; partitions is the number of tasks.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    keys = Table(rows.select("id", "sha", F.octet_length("payload").cast("long").alias("bytes")), "digests")
    shared = (
        keys.df.where(F.col("bytes") >= min_revisit_bytes)
        .groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first")
    )
    # Rows without a payload travel ahead of the records that they mark as
    # revisits, so payloads are shuffled once, by range.
    marks = keys.df.select("id", "sha").distinct().join(shared, "sha").where("id is null or first < id")
    rows = rows.select("id", "sha", F.lit(None).cast("long").alias("first"), "url", "payload").unionByName(
        marks.select("id", "sha", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    )
    bounds = _bounds(keys.df.withColumn("bytes", F.col("bytes") + RECORD_BYTES), range_bytes)
    rows = rows.withColumn("range", _range_of(spark, bounds))
    order = ("range", "id", "sha", F.col("first").isNull(), "url")
    dealt = rows.repartition(partitions, "range") if partitions else rows.repartition("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        files, part, last, target = None, None, None, None  # target: (id,) of what the key's rows revisit
        emit = lambda m: pa.RecordBatch.from_pylist([m])
        for batch in batches:
            ids, shas, firsts, urls = (batch.column(i).to_pylist() for i in range(4))
            ranges = batch.column(5).to_pylist()
            for k in range(batch.num_rows):
                key = (ids[k], shas[k])
                if firsts[k] is not None:
                    last, target = key, (firsts[k],)
                    continue
                if ranges[k] != part:
                    if files is not None and (done := files.close()):
                        yield emit(done)
                    part, files = ranges[k], _Roller(out, ranges[k], attempt, roll_bytes)
                payload = batch.column(4)[k].as_py()
                if key != last:
                    target = None
                if done := files.add(page_record(ids[k], urls[k], payload, target)):
                    yield emit(done)
                if target is None and len(payload) >= min_revisit_bytes:
                    target = (ids[k],)  # what repeats this very row revisits it
                last = key
        if files is not None and (done := files.close()):
            yield emit(done)

    made = dealt.sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
    made.write.parquet(f"{out}/_manifest")
    fs, root = _open(out)
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")
    return manifest(pages.sparkSession, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")


class _Members:
    """Bytes of the gzip members of a stream, checked against the manifest."""

    def __init__(self, stream, bytes_: int, sha256: str):
        self.stream, self.want, self.got = stream, (bytes_, sha256), 0
        self.sum, self.z, self.held = hashlib.sha256(), zlib.decompressobj(31), bytearray()
        self.raw = b""

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(1 << 20)
            self.got += len(self.raw)
            self.sum.update(self.raw)
            if not self.raw:
                if (self.got, self.sum.hexdigest()) != self.want:
                    raise ValueError("a WARC file differs from its manifest")
                return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(self.raw)
        self.raw = self.z.unused_data
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("a WARC file ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> bytes | None:
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("a WARC file ends inside a header")
                return None
        return self.take(at + 4)


def records(stream, bytes_: int, sha256: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of one file; digests are checked."""
    members = _Members(stream, bytes_, sha256)
    while (head := members.head()) is not None:
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        block = members.take(int(headers["content-length"]))
        members.take(4)
        if headers["warc-block-digest"] != "sha1:" + base32_sha1(block):
            raise ValueError("a record's block differs from its digest")
        yield headers, block


def read(spark: SparkSession, out: str, payloads: bool = True) -> DataFrame:
    """The records of the committed files (RECORD). A revisit has no payload of
    its own; payload_bytes and payload_digest are those of the full payload."""
    listed = manifest(spark, out)
    n = max(1, min(listed.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out)
        names = [x.split()[0] for x in RECORD.split(", ")]
        schema = pa.schema(
            [(k, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for k, x in zip(names, RECORD.split(", "), strict=True)]
        )
        held, size = [], 0
        for batch in batches:
            for f in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{f['file']}", compression=None) as stream:
                    for h, block in records(stream, f["bytes"], f["sha256"]):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if h["warc-type"] == "response" else None
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and base32_sha1(payload) != digest:
                            raise ValueError("a payload differs from its digest")
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        held.append(
                            (number("x-page-id"), h.get("warc-target-uri"), h["warc-type"], number("x-refers-to-page-id"),
                             len(payload) if payload is not None else number("x-payload-length"), digest, payload if payloads else None, f["file"])
                        )
                        size += len(payload or b"") if payloads else 0
                        if len(held) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return listed.repartition(n).mapInArrow(run, RECORD)
