"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints are cut into m blocks of bits. Two fingerprints that differ in at
most r bits agree on at least m - r whole blocks, so joining on every choice of
m - r blocks finds every close pair. Equal fingerprints are collapsed first, and
within a block only links that join two still separate sets are emitted, so a
large group of copies costs linear, not quadratic, output.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, arrow_map, fresh, light
from .components import components

RADIUS = 4
SHINGLE = 4
#: Buckets above this many distinct fingerprints are dealt as pairs of chunks.
BUCKET = 16_384


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingle_hashes(raw: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a shorter sequence is one shingle."""
    n = len(raw)
    if not n:
        return np.empty(0, "<u8")
    line = b" ".join(raw)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype="<u8")


def _majority(hashes: np.ndarray) -> bytes:
    """Eight bytes: each bit as in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(set_bits * 2 > len(hashes), bitorder="little").tobytes()


def simhash(text: str | None, words: int = SHINGLE, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of the whole text, repeats
    included. Null, empty or blank text gives 0; a text of fewer words than a
    shingle is one shingle."""
    return int.from_bytes(_majority(_shingle_hashes(_words(text), words, seed)), "little")


def fingerprints(docs: DataFrame, keep: list[str], text_col: str, words: int) -> DataFrame:
    """The columns keep and fp: the fingerprint of each row as a signed long. Null
    texts count as empty; other columns are left out."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((simhash(t, words) for t in batch.column(len(keep)).to_pylist()), np.uint64, batch.num_rows)
        return {c: batch.column(i) for i, c in enumerate(keep)} | {"fp": fps.view(np.int64)}

    return arrow_map(docs.select(*keep, text_col), run, schema)


def block_masks(m: int, radius: int) -> list[int]:
    """Masks of all choices of m - radius blocks out of m."""
    cuts = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def block_count(n: int, radius: int) -> int:
    """The fewest blocks for which a bucket of n random fingerprints is expected
    to hold no more than four. Any number of blocks finds all pairs."""
    m = radius + 1
    while m < radius + 6 and n / 2 ** (64 * (m - radius) / m) > 4:
        m += 1
    return m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs within the radius that connect fps exactly as all such pairs would.

    Each pivot absorbs the free points in its ball. Two balls need a cross check
    only while their sets are apart and their pivots are within 3 x radius."""
    free = np.arange(len(fps))
    pairs: list[tuple[int, int]] = []
    parent: list[int] = []
    pivots: list[int] = []
    balls: list[np.ndarray] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    while len(free):
        p = free[0]
        far = np.bitwise_count(fps[free] ^ fps[p])
        ball = free[far <= radius]
        pairs += [(int(p), int(x)) for x in ball[1:]]
        new = len(pivots)
        parent.append(new)
        if pivots:
            gaps = np.bitwise_count(fps[np.array(pivots)] ^ fps[p])
            for k in np.flatnonzero(gaps <= 3 * radius).tolist():
                if root(k) == root(new):
                    continue
                other = balls[k]
                for x in ball.tolist():
                    hit = np.flatnonzero(np.bitwise_count(fps[other] ^ fps[x]) <= radius)
                    if len(hit):
                        pairs.append((x, int(other[hit[0]])))
                        parent[root(k)] = root(new)
                        break
        pivots.append(int(p))
        balls.append(ball)
        free = free[far > radius]
    return pairs


_LINKS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("u", "v", "bucket")] + [T.StructField("mask", T.IntegerType())]
)


def _links_in_buckets(radius: int, cap: int | None):
    """mapInArrow function over rows (mask, bucket, fp[, side]) sorted by bucket:
    emits links, or, for a bucket above cap, one row that only names it."""

    def one(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = np.array(spanning(fps, radius), dtype=np.int64).reshape(-1, 2)
        return fps[got[:, 0]], fps[got[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]

        def work(mask, bucket, fp):
            """All groups here are whole."""
            if not len(fp):
                return
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            starts = np.concatenate(([0], edge))
            sizes = np.diff(np.concatenate((starts, [len(fp)])))
            us, vs, hot = [], [], []
            small = (sizes > 1) & (sizes <= 32)
            if small.any():
                left = np.repeat(sizes, sizes) - (np.arange(len(fp)) - np.repeat(starts, sizes))
                alive = np.repeat(small, sizes)
                bits = fp.view(np.uint64)
                for gap in range(1, int(sizes[small].max())):
                    a = np.flatnonzero(alive & (left > gap))
                    near = a[np.bitwise_count(bits[a] ^ bits[a + gap]) <= radius]
                    us.append(fp[near])
                    vs.append(fp[near + gap])
            for k in np.flatnonzero(sizes > 32).tolist():
                at, n = int(starts[k]), int(sizes[k])
                if cap is not None and n > cap:
                    hot.append((int(mask[at]), int(bucket[at])))
                    continue
                u, v = one(fp[at : at + n].view(np.uint64))
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            u = np.concatenate([*us, np.empty(0, np.int64)])
            v = np.concatenate([*vs, np.empty(0, np.int64)])
            link = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0) if len(u) else np.empty((0, 2), np.int64)
            if len(link) or hot:
                yield pa.RecordBatch.from_pydict(
                    {
                        "u": pa.array([*link[:, 0].tolist(), *[None] * len(hot)], pa.int64()),
                        "v": pa.array([*link[:, 1].tolist(), *[None] * len(hot)], pa.int64()),
                        "bucket": pa.array([None] * len(link) + [h[1] for h in hot], pa.int64()),
                        "mask": pa.array([None] * len(link) + [h[0] for h in hot], pa.int32()),
                    }
                )

        over = None  # a bucket that is known to be above cap: the rest of it is not gathered
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if over is not None:
                rest = (cols[0] != over[0]) | (cols[1] != over[1])
                cols = [c[rest] for c in cols]
            if not len(cols[0]):
                continue
            now = [np.concatenate((k, c)) for k, c in zip(kept, cols, strict=True)]
            mask, bucket, _ = now
            same = np.flatnonzero((mask != mask[-1]) | (bucket != bucket[-1]))
            cut = int(same[-1]) + 1 if len(same) else 0
            yield from work(*(x[:cut] for x in now))
            kept = [x[cut:] for x in now]
            if cap is not None and len(kept[0]) > max(cap, 32):
                over = (kept[0][0], kept[1][0])
                yield from work(*kept)
                kept = [k[:0] for k in kept]
        yield from work(*kept)

    return run


def links(distinct_fps: DataFrame, radius: int = RADIUS, bucket_cap: int = BUCKET, m: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints (one long column, fp) that
    differ in at most radius bits, enough of them to connect what all links
    connect. Exact for every number of blocks and every bucket size."""
    m = m or block_count(distinct_fps.count(), radius)
    masks = [_signed(x) for x in block_masks(m, radius)]
    table = F.array(*[F.lit(x).cast("long") for x in masks])
    keys = distinct_fps.select("fp", F.posexplode(table).alias("mask", "bits")).select(
        "mask", F.col("bits").bitwiseAND(F.col("fp")).alias("bucket"), "fp"
    )
    dealt = keys.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp")
    first = Table(dealt.mapInArrow(_links_in_buckets(radius, bucket_cap), _LINKS), "links")
    found = first.df.where("u is not null").select("u", "v")
    hot = first.df.where("u is null").select("mask", "bucket")
    if hot.isEmpty():
        return found
    # A hot bucket: its members are dealt into chunks, and each pair of chunks is one task's work.
    members = keys.join(F.broadcast(hot) if hot.count() < 100_000 else hot, ["mask", "bucket"])
    sized = members.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / (bucket_cap // 2)).cast("int")
    pairs = (
        members.join(sized, ["mask", "bucket"])
        .withColumn("g", chunks)
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select(
            "mask",
            F.xxhash64("bucket", F.least("c", "o"), F.greatest("c", "o")).alias("bucket"),
            "fp",
        )
    )
    dealt = pairs.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp")
    more = dealt.mapInArrow(_links_in_buckets(radius, None), _LINKS).select("u", "v")
    return found.unionByName(more)


def text_key(text: F.Column) -> F.Column:
    """Tells the texts of a repeated id apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """One row (id, fp, component) per row of docs: component is the smallest id
    among the rows whose fingerprints can be reached by links of at most radius
    bits. Null and empty texts have fingerprint 0 and link like any other; rows
    with a null id keep their fingerprint and get the component of the others
    (null if there is no other); repeated ids stay as rows; an empty table gives
    an empty one. Extra columns are ignored."""
    return near_rows(docs, id_col, text_col, words, radius).select("id", "fp", "component")


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row (id, key, fp, component, first) per row of docs: component is as
    in near_duplicates, key that of text_key, and (component, first) are the id
    and key of the group's first row."""
    keyed = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    fps = Table(fingerprints(keyed, ["id", "key"], "text", words), "fingerprints").df
    first = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least")
    classes = Table(fps.groupBy("fp").agg(first), "classes").df
    linked = components(links(classes.select("fp"), radius), "u", "v")
    groups = linked.join(classes, F.col("node") == F.col("fp"))
    least = groups.groupBy("component").agg(F.min("least").alias("smallest"))
    by_fp = Table(groups.join(least, "component").select("fp", "smallest"), "groups").df
    named = classes.join(by_fp, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("first"))
    found = fps.join(named, "fp")
    return found.select("id", "key", "fp", F.col("first.id").alias("component"), F.col("first.key").alias("first"))


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- groups by shingle similarity ------------------------------------------------

#: Bits of the wide fingerprint, and the share of pairs at the threshold that its blocks may miss.
WIDE, MISS = 256, 0.02
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Documents of a candidate group that one task compares; larger groups are compared as pairs of chunks.
GROUP = 4_000
#: Texts of at most so many distinct shingles also get exact keys: fingerprints of
#: few hashes differ in more bits than distance_at says.
SHORT = 80


def wide_simhash(hashes: np.ndarray) -> bytes:
    """WIDE bits: the SimHash of the hashes and of three scrambled copies."""
    parts = []
    for k in range(WIDE // 64):
        x = hashes
        if k:
            x = (x ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
        parts.append(_majority(x.astype("<u8")))
    return b"".join(parts)


def prefix_of(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a sorted set, as many as it takes for any two sets of at
    least this Jaccard similarity to have one of them in common."""
    return shingles[: len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1]


def distance_at(similarity: float) -> tuple[int, float]:
    """(most, share): a pair whose fingerprints differ in more than most bits is
    below the similarity; share is the chance that a bit differs right at it."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    mean, sd = WIDE * share, np.sqrt(WIDE * share * (1 - share))
    return int(mean + 3 * sd), share


def wide_blocks(n: int, share: float) -> np.ndarray:
    """Bit positions of each block. Fingerprints this far apart have no pigeonhole
    block that is long enough to tell documents apart, so blocks overlap: as many
    as it takes for a pair at the threshold to agree on one."""
    width = min(40, max(12, int(np.ceil(np.log2(max(n, 2)))) + 2))
    many = int(np.ceil(np.log(MISS) / np.log1p(-((1 - share) ** width))))
    g = np.random.default_rng(0)
    return np.stack([g.choice(WIDE, width, replace=False) for _ in range(many)])


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def spanning_wide(wide: np.ndarray, label: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs within most bits that connect the rows of wide as all such pairs
    would; rows of equal label are connected already and need no pair."""
    names, spot = np.unique(label, return_inverse=True)
    parent, pairs, balls, free = list(range(len(names))), [], [], np.arange(len(wide))

    def root(x: int) -> int:
        k = int(spot[x])
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            pairs.append((x, y))

    while len(free):
        p = int(free[0])
        d = _far(wide[free], wide[p])
        ball = free[d <= most]
        for x in ball[1:].tolist():
            join(p, x)
        for other in balls:
            if root(int(other[0])) != root(p):
                for x in ball.tolist():
                    hit = np.flatnonzero(_far(wide[other], wide[x]) <= most)
                    if len(hit):
                        join(x, int(other[hit[0]]))
                        break
        balls.append(ball)
        free = free[d > most]
    return pairs


def _wide_links(most: int):
    """Rows (bucket, ref, label, wide) sorted by bucket and ref -> pairs (a, b)
    within most bits that connect each bucket; never all pairs of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [*[np.empty(0, np.int64)] * 3, np.empty((0, WIDE // 64), np.uint64)]

        def work(bucket, ref, label, wide):
            if not len(ref):
                return
            starts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(ref)])))
            left = np.repeat(sizes, sizes) - (np.arange(len(ref)) - np.repeat(starts, sizes))
            small = np.repeat(sizes <= 4, sizes)
            found = []
            for gap in range(1, int(min(4, sizes.max()))):
                a = np.flatnonzero(small & (left > gap))
                a = a[(label[a] != label[a + gap]) & (_far(wide[a], wide[a + gap]) <= most)]
                found.append(np.stack((ref[a], ref[a + gap]), 1))
            for k in np.flatnonzero(sizes > 4).tolist():
                at = slice(int(starts[k]), int(starts[k] + sizes[k]))
                found.append(ref[at][np.array(spanning_wide(wide[at], label[at], most), np.int64).reshape(-1, 2)])
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, WIDE // 64)
            now = [np.concatenate(x) for x in zip(held, (*(batch.column(i).to_numpy() for i in range(3)), raw), strict=True)]
            same = np.flatnonzero(now[0] != now[0][-1])
            cut = int(same[-1]) + 1 if len(same) else 0
            yield from work(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        yield from work(*held)

    return run


def _candidate_groups(classes: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the classes (ref, wide) that blocks connect.

    The first blocks go first: most of a large group is one component after
    them, and the other blocks only add what joins two components."""
    most, share = distance_at(similarity)
    blocks = wide_blocks(classes.count(), share)
    weights = np.uint64(1) << np.arange(blocks.shape[1], dtype=np.uint64)
    longs = [T.StructField(n, T.LongType()) for n in ("bucket", "ref", "label")]
    schema = T.StructType([*longs, T.StructField("wide", T.BinaryType())])

    def pairs(labelled: DataFrame, some: range) -> DataFrame:
        def deal(batch: pa.RecordBatch) -> dict:
            raw = batch.column(2).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little").astype(np.uint64)
            keys = np.stack([(bits[:, blocks[k]] * weights).sum(axis=1) | np.uint64(k << 44) for k in some], axis=1)
            ref, label = (np.repeat(batch.column(i).to_numpy(), len(some)) for i in range(2))
            return {"bucket": keys.view(np.int64).ravel(), "ref": ref, "label": label, "wide": [w for w in raw for _ in some]}

        dealt = arrow_map(labelled.select("ref", "label", "wide"), deal, schema, slice_bytes=1 << 17)
        return dealt.repartition("bucket").sortWithinPartitions("bucket", "ref").mapInArrow(_wide_links(most), _PAIR)

    first = max(4, len(blocks) // 8)
    begun = Table(components(pairs(classes.withColumn("label", F.col("ref")), range(first)), "a", "b"), "begun").df
    labelled = classes.join(begun.withColumnRenamed("node", "ref"), "ref", "left").withColumn("label", F.coalesce("component", "ref"))
    more = pairs(labelled, range(first, len(blocks)))
    return components(more.unionByName(begun.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")


def connect_similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets with at least this Jaccard similarity that connect them as
    all such pairs would. An inverted index gives one set's overlap with all
    others at once. A set that a pivot reaches needs no look of its own while it
    is in the largest component: a link between two components has an end outside."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    values, spot = np.unique(flat, return_inverse=True)
    members = owner[np.argsort(spot, kind="stable")]
    ends = np.cumsum(np.bincount(spot, minlength=len(values)))
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    parent, pairs = np.arange(n), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = int(parent[k])
        return k

    def look(x: int) -> np.ndarray:
        at = spot[firsts[x] : firsts[x + 1]]
        both = np.bincount(np.concatenate([members[begins[v] : ends[v]] for v in at]), minlength=n) if len(at) else np.where(sizes == 0, 1, 0)
        alike = both >= similarity * (sizes[x] + sizes - both) if len(at) else both > 0
        hits = np.flatnonzero(alike)
        for y in hits.tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                pairs.append((x, y))
        return hits

    common = np.array([(ends - begins)[spot[firsts[x] : firsts[x + 1]]].mean() if sizes[x] else 0 for x in range(n)])
    reached, looked = np.zeros(n, bool), np.zeros(n, bool)
    for x in np.argsort(-common, kind="stable").tolist():
        if not reached[x]:
            reached[look(x)] = True
            looked[x] = True
    roots = np.array([root(k) for k in range(n)])
    largest = np.bincount(roots, minlength=n).argmax()
    for x in np.flatnonzero((roots != largest) & ~looked).tolist():
        look(x)
    return pairs


def _verified(similarity: float):
    """Rows (group, i, j, ref, shingles) sorted by group, i, j -> connecting pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, refs, sets = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = connect_similar(sets, similarity) if len(sets) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": pa.array([refs[x] for x, _ in pairs], pa.int64()), "b": pa.array([refs[y] for _, y in pairs], pa.int64())})

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for k, ref in enumerate(batch.column(3).to_pylist()):
                if keys[k] != key:
                    yield from flush()
                    key, refs, sets = keys[k], [], []
                refs.append(ref)
                sets.append(np.frombuffer(batch.column(4)[k].as_py(), "<u8"))
        yield from flush()

    return run


def similar_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int | None = RADIUS
) -> DataFrame:
    """One row (id, key, component, first) per row of docs: component is as in
    similar_documents, key that of text_key, and (component, first) are the id and
    key of the group's first row."""
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_ = [T.StructField(n, T.LongType()) for n in ("key", "fp")]
    binary = [T.StructField(n, T.BinaryType()) for n in ("held", "wide", "short")]
    schema = T.StructType([T.StructField("id", kind), *long_, *binary])

    def mark(batch: pa.RecordBatch) -> dict:
        raws = [_words(t) for t in batch.column(2).to_pylist()]
        fps = np.array([int.from_bytes(_majority(_shingle_hashes(r, SHINGLE)), "little") for r in raws], np.uint64)
        held, wide, short = [], [], []
        for r in raws:
            some = np.unique(_shingle_hashes(r, words))  # the sets that are verified
            held.append(xxhash.xxh3_128_digest(some.tobytes()))
            wide.append(wide_simhash(some))
            short.append(some.tobytes() if len(some) <= SHORT else None)
        return {"id": batch.column(0), "key": batch.column(1), "fp": fps.view(np.int64), "held": held, "wide": wide, "short": short}

    keyed = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), text.alias("text"))
    rows = Table(arrow_map(keyed, mark, schema), "rows").df
    # A class is a set of shingles; its first row stands for it, rows without an id come last.
    first = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least")
    alike = rows.groupBy("held").agg(first, *[F.min(c).alias(c) for c in ("wide", "short")])
    classes = Table(alike.withColumn("ref", F.monotonically_increasing_id()), "classes").df
    found = _candidate_groups(classes.select("ref", "wide"), similarity)
    groups = found.select(F.col("node").alias("ref"), F.col("component").alias("group"))
    wanted = Table(groups.join(classes, "ref").select("ref", "group", "least.id", "least.key"), "wanted").df

    def sets(batch: pa.RecordBatch) -> dict:
        found = [np.unique(_shingle_hashes(_words(t), words)).astype("<u8").tobytes() for t in batch.column(2).to_pylist()]
        return {"ref": batch.column(0), "group": batch.column(1), "shingles": found}

    set_schema = T.StructType([T.StructField("ref", T.LongType()), T.StructField("group", T.LongType()), T.StructField("shingles", T.BinaryType())])
    at = light(wanted.select(F.col("id").alias("_id"), "key", "ref", "group"))
    texts = keyed.join(at, (keyed["key"] == at["key"]) & keyed["id"].eqNullSafe(at["_id"])).select("ref", "group", "text")
    # Rows that repeat an id and its text give a set again.
    by_blocks = arrow_map(texts, sets, set_schema).groupBy("ref", "group").agg(F.min("shingles").alias("shingles"))

    def keys(batch: pa.RecordBatch) -> dict:
        found = [prefix_of(np.frombuffer(x, "<u8"), similarity) for x in batch.column(1).to_pylist()]
        group = np.concatenate([np.empty(0, "<u8"), *found]).view(np.int64)
        return {"ref": np.repeat(batch.column(0).to_numpy(), [len(x) for x in found]), "group": group}

    short = classes.where("short is not null").select("ref", "short")
    prefixes = Table(arrow_map(short, keys, T.StructType(set_schema.fields[:2]), slice_bytes=1 << 18), "prefixes").df
    # Sets travel only to prefixes that two texts share.
    shared = prefixes.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    by_prefix = prefixes.join(shared, "group").join(short, "ref").select("ref", "group", F.col("short").alias("shingles"))
    shingled = Table(by_blocks.unionByName(by_prefix), "shingles").df
    chunks = shingled.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group", F.ceil(F.col("n") * 2 / GROUP).cast("int").alias("c"))
    many = F.when(F.col("c") > 2, F.col("c")).otherwise(1)  # two chunks fit one task
    placed = shingled.join(chunks, "group").withColumn("k", F.pmod(F.xxhash64("ref"), many).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), many - 1)))
    compared = placed.select("group", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "ref", "shingles")
    ordered = compared.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "ref")
    links_ = ordered.mapInArrow(_verified(similarity), _PAIR)
    if radius is not None:
        fps = Table(rows.select("fp").distinct(), "fps").df
        close = components(links(fps, radius), "u", "v").select(F.col("node").alias("fp"), F.col("component").alias("group"))
        # Every class of a Hamming group is linked to the group's first class.
        of = rows.select("fp", "held").distinct().join(classes.select("held", "ref"), "held")
        grouped = of.join(close, "fp", "left").select(F.coalesce("group", "fp").alias("group"), "ref")
        first = grouped.groupBy("group").agg(F.min("ref").alias("first"))
        links_ = links_.unionByName(grouped.join(first, "group").where("ref <> first").select(F.col("ref").alias("a"), F.col("first").alias("b")))
    found = components(Table(links_, "similar").df, "a", "b").withColumnRenamed("node", "ref")
    named = found.join(classes.select("ref", "least"), "ref")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    by_ref = named.join(smallest, "component").select("ref", "smallest")
    final = Table(classes.join(by_ref, "ref", "left").select("held", F.coalesce("smallest", "least").alias("first")), "final").df
    return rows.join(final, "held").select("id", "key", F.col("first.id").alias("component"), F.col("first.key").alias("first"))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int | None = RADIUS
) -> DataFrame:
    """One row (id, component) per row of docs: component is the smallest id of
    the rows that can be reached by links between texts whose sets of word
    shingles have a Jaccard similarity of at least similarity and, unless radius
    is null, by the links of near_duplicates.

    Candidate groups come from blocks of wide fingerprints of the shingle sets
    (which miss about MISS of the pairs right at the threshold and fewer above it)
    and, between texts of at most SHORT distinct shingles, from shared prefixes,
    which miss none; within a group links are exact, on whole shingle sets, equal
    fingerprints or not. Null and empty texts are alike. Repeated ids are rows of
    their own, each linked by its own text; rows without an id take part like any
    other, and the component is null only if no row of the group has one. An empty
    table gives an empty one. Extra columns are ignored.
    """
    return similar_rows(docs, id_col, text_col, words, similarity, radius).select("id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **how) -> DataFrame:
    """docs with one row of each near-duplicate group, the row of smallest id (and
    of its texts the one of smallest text_key); with similarity the groups of
    similar_rows, else those of near_rows. Rows without an id are kept, whatever
    their group. Rows that repeat an id and its text are one: the first of them
    stays. Of a repeated id with several texts each goes by the group of its own
    text. An empty table stays empty; columns are as they were."""
    if similarity is None:
        found = near_rows(docs, id_col, text_col, **how)
    else:
        found = similar_rows(docs, id_col, text_col, similarity=similarity, **how)
    found = Table(found.where("id is not null"), "found").df
    k, n = fresh("_key", docs.columns), fresh("_n", docs.columns)
    gone = found.where((F.col("id") != F.col("component")) | (F.col("key") != F.col("first"))).select(F.col("id").alias(id_col), F.col("key").alias(k))
    kept = docs.withColumn(k, text_key(F.col(text_col))).join(light(Table(gone.distinct(), "gone").df), [id_col, k], "left_anti")
    twice = found.groupBy(F.col("id").alias(id_col), F.col("key").alias(k)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    if not twice.isEmpty():
        marked = kept.join(twice, [id_col, k], "left")
        once = marked.where(F.col(n).isNotNull()).dropDuplicates([id_col, k])  # combined before they are shuffled
        kept = marked.where(F.col(n).isNull()).unionByName(once)
    return kept.select(*docs.columns)
