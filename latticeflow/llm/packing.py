"""Conflict-constrained best-fit packing.

Documents are dealt at random but repeatably into independent parts of bounded
size; each part is packed by best-fit decreasing. Open bins are kept in order of
what they have left, each with a bitmap of its sources and of its duplicate
clusters; from the tightest bin that the document fits, the search goes on to
the next until one has neither its source nor its cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 16_384
#: Pieces of a part, about; parts grow in number, not in size.
PART_ROWS = 8_192


class Bins:
    """Open bins in order of (room left, bin). A bin's bitmaps have one bit for
    each of the part's sources and clusters; codes count from 1, and bit 0, the
    code of nulls, is never set."""

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity = capacity
        self.room = np.empty(0, np.int64)
        self.order = np.empty(0, np.int64)
        self.used = 0
        self.sources = np.zeros((64, sources // 64 + 1), np.uint64)
        self.clusters = np.zeros((64, clusters // 64 + 1), np.uint64)

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the tightest bin that has room and neither conflict."""
        at = int(np.searchsorted(self.room, size))
        ws, bs = source >> 6, np.uint64(1 << (source & 63))
        wc, bc = cluster >> 6, np.uint64(1 << (cluster & 63))
        step, found = 16, -1
        while at < len(self.order) and found < 0:
            bins = self.order[at : at + step]
            free = ((self.sources[bins, ws] & bs) == 0) & ((self.clusters[bins, wc] & bc) == 0)
            hit = np.flatnonzero(free)
            if len(hit):
                found = at + int(hit[0])
            at, step = at + step, step * 2
        if found < 0:
            b, left = self.used, self.capacity
            self.used += 1
            if self.used > len(self.sources):
                self.sources = np.concatenate((self.sources, np.zeros_like(self.sources)))
                self.clusters = np.concatenate((self.clusters, np.zeros_like(self.clusters)))
        else:
            b, left = int(self.order[found]), int(self.room[found])
            self.room = np.delete(self.room, found)
            self.order = np.delete(self.order, found)
        offset = self.capacity - left
        left -= size
        if source:
            self.sources[b, ws] |= bs
        if cluster:
            self.clusters[b, wc] |= bc
        if left:
            to = int(np.searchsorted(self.room, left))
            while to < len(self.room) and self.room[to] == left and self.order[to] < b:
                to += 1
            self.room = np.insert(self.room, to, left)
            self.order = np.insert(self.order, to, b)
        return b, offset


def pack_part(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces come largest first, in a fixed order of
    equals. Sources and clusters are codes from 1, without gaps; 0 is null."""
    bins = Bins(capacity, int(sources.max(initial=0)), int(clusters.max(initial=0)))
    got = [bins.put(int(x), int(a), int(b)) for x, a, b in zip(sizes, sources, clusters, strict=True)]
    return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    known = np.unique(column.drop_null().to_numpy())
    code = np.searchsorted(known, column.fill_null(0).to_numpy()).astype(np.int64) + 1
    return np.where(column.is_null().to_numpy(), 0, code)


_OUT = [("part", T.LongType()), ("bin", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("size", T.LongType()), ("offset", T.LongType())]


def best_fit(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """One row (id, part, bin, piece, start, size, offset) per piece of a document.

    A document takes its UTF-8 bytes plus one separator byte. Longer ones than
    capacity are cut into pieces of capacity bytes and a last one, so no byte is
    lost; pieces that fill a bin have it alone. In a bin no two pieces come from
    one source, nor from one duplicate cluster (cluster_col, or equal texts up to
    case and white space). A bin is (part, bin); offset is the piece's place in
    it. The part of pieces that fill a bin is negative and the document's own. A null source or cluster conflicts with nothing. A null or empty text is
    one piece of one byte. Null and repeated ids are rows of their own. An empty
    table gives an empty result. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    alike = F.col(cluster_col) if cluster_col else F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("total"),
        F.when(F.col(source_col).isNotNull(), F.xxhash64(F.col(source_col))).alias("source"),
        F.when(alike.isNotNull(), F.xxhash64(alike)).alias("cluster"),
    )
    full = F.floor(F.col("total") / capacity).cast("int")
    rest = F.pmod(F.col("total"), F.lit(capacity))
    # Whole pieces fill a bin each and need no search: only rests are packed.
    whole = (
        rows.where(full > 0)
        .select("id", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
        .select(
            "id",
            (-1 - F.col("row")).alias("part"),
            F.col("piece").cast("long").alias("bin"),
            "piece",
            (F.col("piece").cast("long") * capacity).alias("start"),
            F.lit(capacity).cast("long").alias("size"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    rests = rows.where(rest > 0).select(
        "id", "row", "source", "cluster", full.alias("piece"), (full.cast("long") * capacity).alias("start"), rest.cast("long").alias("size")
    )
    n = docs.count()
    parts = max(1, -(-n // part_rows))
    # Copies may share a part or not; either way they never share a bin. The row is in the hash, so that equal rows spread.
    dealt = rests.withColumn("part", F.pmod(F.xxhash64("row", "id", "size"), F.lit(parts)))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(k, t) for k, t in _OUT]])
    order = ["part", F.desc("size"), "id", "cluster", "source"]
    held = dealt.select("id", "part", "piece", "start", "size", "source", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
            part = table.column("part").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                one = table.slice(int(a), int(b - a))
                bins, offsets = pack_part(one.column("size").to_numpy(), _codes(one.column("source")), _codes(one.column("cluster")), capacity)
                got = one.select(["id", "part"]).append_column("bin", pa.array(bins))
                for name in ("piece", "start", "size"):
                    got = got.append_column(name, one.column(name))
                yield from got.append_column("offset", pa.array(offsets)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(1).to_numpy()
            cut = int(np.searchsorted(part, part[-1]))  # rows of the last part may go on
            if cut:
                yield from pack(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
            elif kept and kept[-1].column(1)[0].as_py() != part[0]:
                yield from pack(pa.Table.from_batches(kept))
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield from pack(pa.Table.from_batches(kept))

    packed = held.repartition("part").sortWithinPartitions(*order).mapInArrow(run, schema)
    return packed.unionByName(whole)
