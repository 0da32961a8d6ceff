"""Region queries and chunk dataflow over sparse voxel tables (x, y, z, v)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import affine
from ..functions.geometry import AXES, Box, Vec, floor_div

CHUNK = "cx long, cy long, cz long, shape array<int>, data binary"


def chunk_key(shape, prefix: str = "c") -> list:
    at = Vec.columns() // Vec.of(shape)
    return [v.alias(prefix + a) for v, a in zip(at, AXES, strict=True)]


def read(vox: DataFrame, box: Box) -> DataFrame:
    """The stored voxels inside a box; the test is pushed down to the scan."""
    return vox.where(box.contains(Vec.columns()))


def grid(spark, box: Box) -> DataFrame:
    """Every point of a box."""
    df = spark.range(box.low.x, box.high.x).withColumnRenamed("id", "x")
    for a, lo, hi in (("y", box.low.y, box.high.y), ("z", box.low.z, box.high.z)):
        df = df.withColumn(a, F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))))
    return df


def read_dense(vox: DataFrame, box: Box) -> DataFrame:
    """Every voxel of the box; absent ones are 0. Empty boxes are an error."""
    if box.is_empty():
        raise ValueError("an empty region can't be read")
    return grid(vox.sparkSession, box).join(read(vox, box), list(AXES), "left").select(*AXES, F.coalesce("v", F.lit(0)).alias("v"))


def write(vox: DataFrame, data: DataFrame, box: Box) -> DataFrame:
    """vox with the box replaced by data: what lay in the box is gone, zeros too."""
    return vox.where(~box.contains(Vec.columns())).unionByName(read(data, box).where("v <> 0"))


def overlay(base: DataFrame, over: DataFrame, chunk) -> DataFrame:
    """Chunks that over holds replace those of base whole, zeros included."""
    keyed = base.select("*", *chunk_key(chunk))
    held = over.select(*chunk_key(chunk)).distinct()
    return keyed.join(held, ["cx", "cy", "cz"], "left_anti").select(*AXES, "v").unionByName(over.where("v <> 0"))


def content_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: voxels of a that b hasn't, voxels of b that a hasn't, and whether they are equal."""
    side = lambda df, n: df.where("v <> 0").select(*AXES, "v", F.lit(n).alias("d"))
    sums = side(a, 1).unionByName(side(b, -1)).groupBy(*AXES, "v").agg(F.sum("d").alias("d"))
    left = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0))
    right = F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0))
    return sums.agg(left.alias("only_left"), right.alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0)
    )


def chunk_occupancy(vox: DataFrame, shape) -> DataFrame:
    """Stored chunks with their boxes, voxel counts and sums."""
    shape = Vec.of(shape)
    counted = vox.where("v <> 0").groupBy(*chunk_key(shape)).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    low = Vec.columns("c") * shape
    return counted.select("cx", "cy", "cz", *Box(low, low + shape).named(), "n", "total")


def touching_chunks(boxes: DataFrame, shape, keep: list[str]) -> DataFrame:
    """Chunk keys of a grid that the boxes of rows (x0 .. z1) overlap."""
    shape = Vec.of(shape)
    df = boxes
    for a, lo, hi, s in zip(AXES, ("x0", "y0", "z0"), ("x1", "y1", "z1"), shape, strict=True):
        df = df.withColumn(f"c{a}", F.explode(F.sequence(floor_div(F.col(lo), s), floor_div(F.col(hi) - 1, s))))
    return df.select(*keep, "cx", "cy", "cz")


def shifted(vox: DataFrame, by) -> DataFrame:
    at = Vec.columns() + Vec.of(by)
    return vox.select(*[v.alias(a) for v, a in zip(at, AXES, strict=True)], "v")


def flipped(vox: DataFrame, axis: str, size: int) -> DataFrame:
    return vox.withColumn(axis, F.lit(size - 1) - F.col(axis))


def pad_or_crop(vox: DataFrame, size, target) -> DataFrame:
    """Voxels of a cube of size moved to the middle of one of target, cropped to it."""
    by = (Vec.of(target) - Vec.of(size)) // 2
    return read(shifted(vox, by), Box.of(0, target))


def apply_mapping(vox: DataFrame, mapping: DataFrame, source: str = "id", target: str = "mapped", missing: str = "zero") -> DataFrame:
    """Values replaced by mapping (source -> target); ids that it lacks become 0, or stay."""
    found = vox.join(mapping.select(F.col(source).alias("v"), F.col(target).alias("_to")), "v", "left")
    other = F.lit(0) if missing == "zero" else F.col("v")
    return found.select(*AXES, F.coalesce("_to", other).cast("long").alias("v"))


def masked(vox: DataFrame, mask: DataFrame) -> DataFrame:
    return vox.join(mask.where("v > 0").select(*AXES), list(AXES), "left_semi")


def rescaled(vox: DataFrame, low: float, high: float, top: float) -> DataFrame:
    """(v - low) / (high - low) * top, cut to an integer and not clipped; 0 where low and high agree."""
    if abs(high - low) < 1e-12:
        return vox.withColumn("v", F.lit(0).cast("long"))
    return vox.withColumn("v", ((F.col("v") - low) / (high - low) * top).cast("long"))


def transformed(vox: DataFrame, matrix: affine.Matrix, source: Box, target: Box, fill: int = 0, mask: DataFrame | None = None, step=1) -> DataFrame:
    """Every voxel of target, taken from the voxel nearest to its source point.

    The inverse of matrix gives the point; it is rounded by floor(p + 0.5) and
    counts if it lies from the source's low corner to its high corner less step.
    The grid is a projection and meets the voxels in one equi-join."""
    back = affine.apply(affine.inverse(matrix), Vec.columns())
    near = Vec(*[F.floor(p + 0.5) for p in back])
    step = Vec.of(step)
    inside = [t for p, a, b, s in zip(back, source.low, source.high, step, strict=True) for t in (p >= a, p <= b - s)]
    ok = inside[0]
    for t in inside[1:]:
        ok = ok & t
    points = grid(vox.sparkSession, target).select(*AXES, *[F.when(ok, p).alias(f"s{a}") for p, a in zip(near, AXES, strict=True)])
    values = (masked(vox, mask) if mask is not None else vox).select(*[F.col(a).alias(f"s{a}") for a in AXES], "v")
    return points.join(values, ["sx", "sy", "sz"], "left").select(*AXES, F.coalesce("v", F.lit(fill)).cast("long").alias("v"))


def moved(vox: DataFrame, matrix: affine.Matrix, source: Box, target: Box | None = None, mask: DataFrame | None = None, step=1) -> DataFrame:
    """The voxels that transformed takes from stored ones, over all of the target
    or without bounds; everything else there is the fill.

    Each stored voxel goes to the few points around its place whose source point
    rounds to it, so the work follows the voxels, not the target's volume, and
    needs no join."""
    values = (masked(vox, mask) if mask is not None else vox).where("v <> 0")
    centre = affine.apply(matrix, Vec.columns())
    reach = [sum(abs(f) for f in row[:3]) / 2 + 1e-6 for row in matrix[:3]]
    names = [f"t{a}" for a in AXES]
    at = values.select(
        *AXES, "v", *extra_axes(vox),
        *[F.struct(F.ceil(c - h).alias("a"), F.floor(c + h).alias("b")).alias(n) for c, h, n in zip(centre, reach, names, strict=True)],
    )
    for n in names:
        points = F.when(F.col(f"{n}.a") <= F.col(f"{n}.b"), F.sequence(f"{n}.a", f"{n}.b"))
        at = at.withColumn(n, F.explode(points))
    back = affine.apply(affine.inverse(matrix), Vec.columns("t"))
    ok = [F.floor(p + 0.5) == F.col(a) for p, a in zip(back, AXES, strict=True)]
    ok += [t for p, a, b, s in zip(back, source.low, source.high, Vec.of(step), strict=True) for t in (p >= a, p <= b - s)]
    for t in ok:
        at = at.where(t)
    if target is not None:
        at = at.where(target.contains(Vec.columns("t")))
    return at.select(*extra_axes(vox), *[F.col(n).alias(a) for n, a in zip(names, AXES, strict=True)], "v")


def slice_batches(vox: DataFrame, axis: str, size: int) -> DataFrame:
    """What a writer that buffers size slices flushes: per batch the slices, the extent and the voxels."""
    others = [a for a in AXES if a != axis]
    return vox.groupBy(floor_div(F.col(axis), size).alias("batch")).agg(
        F.countDistinct(axis).alias("slices"),
        (F.max(others[0]) + 1).alias("width"),
        (F.max(others[1]) + 1).alias("height"),
        F.count(F.lit(1)).alias("n"),
    )


def tiles(vox: DataFrame, size: int) -> DataFrame:
    """Image tiles of each slice, with what they hold."""
    return vox.groupBy("z", floor_div(F.col("x"), size).alias("tx"), floor_div(F.col("y"), size).alias("ty")).agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("top")
    )


#: Voxels that a kernel gathers before it hands on a batch of them.
BATCH_ROWS = 65536


def pack_chunk(a: np.ndarray) -> bytes:
    """A dense block as bytes: its kind (i or f), then 64-bit values in Fortran order, zstd."""
    kind = np.float64 if a.dtype.kind == "f" else np.int64
    return (b"f" if a.dtype.kind == "f" else b"i") + zstandard.ZstdCompressor(level=1).compress(np.asarray(a, kind).tobytes(order="F"))


def pack_voxels(shape, at: np.ndarray, v: np.ndarray) -> bytes:
    """A block by its voxels: places in Fortran order, ascending and each once, and
    values. Blocks that are less than an eighth full are packed as those (kind I
    or F), others as pack_chunk does."""
    if len(v) * 8 < np.prod(shape):
        return (b"F" if v.dtype.kind == "f" else b"I") + at.astype("<i8").tobytes() + v.tobytes()
    dense = np.zeros(int(np.prod(shape)), v.dtype)
    dense[at] = v
    return pack_chunk(dense.reshape(shape, order="F"))


def unpack_voxels(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in Fortran order and values of what a packed block holds that isn't zero."""
    kind = np.float64 if data[:1] in b"fF" else np.int64
    if data[:1] in b"IF":
        n = (len(data) - 1) // 16
        return np.frombuffer(data, "<i8", n, 1), np.frombuffer(data, kind, n, 1 + 8 * n)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), kind)
    at = np.flatnonzero(flat)
    return at, flat[at]


def unpack_chunk(shape, data: bytes) -> np.ndarray:
    kind = np.float64 if data[:1] in b"fF" else np.int64
    if data[:1] in b"IF":
        at, v = unpack_voxels(data)
        flat = np.zeros(int(np.prod(shape)), kind)
        flat[at] = v
    else:
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), kind)
    return flat.reshape(shape, order="F")


def flat_places(shape, p: np.ndarray) -> np.ndarray:
    """Places in Fortran order of points (rows of p) in a block."""
    steps = np.cumprod([1, *shape[:-1]])
    return p @ steps


def points_of(shape, at: np.ndarray) -> np.ndarray:
    """The points of places in Fortran order."""
    return np.stack(np.unravel_index(at, shape, order="F"), axis=1)


def last_of_each(at: np.ndarray, v: np.ndarray, merge: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places ascending, each once, with the value that came last, or the greatest."""
    order = np.lexsort((v, at)) if merge else np.argsort(at, kind="stable")
    at, v = at[order], v[order]
    keep = np.append(at[1:] != at[:-1], True)
    return at[keep], v[keep]


def is_real(vox: DataFrame) -> bool:
    """Whether the values are floating numbers."""
    return vox.schema["v"].dataType.typeName() in ("double", "float")


def extra_axes(vox: DataFrame) -> list[str]:
    """Columns beside x, y, z and v: channels, time and so on."""
    return [c for c in vox.columns if c not in (*AXES, "v")]


def by_key(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, other columns but the last, last column) of each run of rows whose
    first n columns agree; what is held is one run and a batch."""
    key, held = None, []

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, v = (np.concatenate(x) if len(held) > 1 else x[0] for x in zip(*held, strict=True))
        return key, m, v

    for b in batches:
        if not b.num_rows:
            continue
        m = np.stack([b.column(i).to_numpy() for i in range(b.num_columns - 1)], axis=1)
        values = b.column(b.num_columns - 1).to_numpy()
        keys, rest = m[:, :n], m[:, n:]
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(m)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if key is None or not (keys[lo] == key).all():
                if key is not None:
                    yield run()
                key, held = keys[lo].copy(), []
            held.append((rest[lo:hi], values[lo:hi]))
    if key is not None:
        yield run()


#: Voxels that a task gathers before it packs them by chunk.
PACK_ROWS = 1 << 20

PART = "cx long, cy long, cz long, part binary"

_WIDTHS = [np.dtype(t) for t in ("<u1", "<u2", "<u4", "<u8", "<i1", "<i2", "<i4", "<i8", "<f4", "<f8")]


def _narrow(low, high, signed: bool) -> int:
    """The place in _WIDTHS of the narrowest integers that hold low to high."""
    return next(k for k in range(4 * signed, 4 + 4 * signed) if np.iinfo(_WIDTHS[k]).min <= low and high <= np.iinfo(_WIDTHS[k]).max)


def pack_part(at: np.ndarray, v: np.ndarray) -> bytes:
    """Ascending places and their values in few bytes: steps from place to place
    and values, each as narrow as they allow."""
    steps = np.diff(at, prepend=0)
    if v.dtype.kind == "f":
        with np.errstate(over="ignore"):
            kind = 8 if np.array_equal(v.astype("<f4").astype("<f8"), v, equal_nan=True) else 9
    else:
        low, high = int(v.min()), int(v.max())
        kind = _narrow(low, high, low < 0)
    step = _narrow(0, int(steps.max()), False)
    return bytes([step << 4 | kind]) + steps.astype(_WIDTHS[step]).tobytes() + v.astype(_WIDTHS[kind]).tobytes()


def unpack_part(data) -> tuple[np.ndarray, np.ndarray]:
    step, kind = _WIDTHS[data[0] >> 4], _WIDTHS[data[0] & 15]
    n = (len(data) - 1) // (step.itemsize + kind.itemsize)
    v = np.frombuffer(data, kind, n, 1 + step.itemsize * n)
    return np.cumsum(np.frombuffer(data, step, n, 1), dtype=np.int64), v.astype(np.float64 if kind.kind == "f" else np.int64)


def by_chunk(vox: DataFrame, shape, extra: dict[str, int] | None = None, merge: str | None = None) -> DataFrame:
    """Stored voxels dealt and sorted by chunk, as PART: each row holds those that
    one task had of a chunk, packed before they are dealt. Of values that meet at
    one place the last that comes counts, or with merge "max" the greatest."""
    if merge not in (None, "max"):
        raise ValueError(f"merge {merge} is not known")
    sides, more = tuple(Vec.of(shape)), tuple((extra or {}).values())
    value = F.col("v").cast("double" if is_real(vox) else "long").alias("v")
    stored = vox.where("v is not null" if merge else "v <> 0").select(*[F.col(a).cast("long").alias(a) for a in (*(extra or {}), *AXES)], value)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.combine_chunks().to_numpy() for c in pa.Table.from_batches(held).columns]
        v, p = columns[-1], columns[:-1]
        for c, n in zip(p, more, strict=False):
            if ((c < 0) | (c >= n)).any():
                raise ValueError("a voxel lies outside its further axes")
        keys = [c // s for c, s in zip(p[len(more) :], sides, strict=True)]
        inside = [*p[: len(more)], *(c - k * s for c, k, s in zip(p[len(more) :], keys, sides, strict=True))]
        steps = np.cumprod([1, *more, *sides[:-1]])
        at = sum(c * int(n) for c, n in zip(inside, steps, strict=True))
        order = np.lexsort((*([v] if merge else []), at, *keys[::-1]))  # stable
        at, v, keys = at[order], v[order], [k[order] for k in keys]
        new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
        keep = np.append(new[1:] | (at[1:] != at[:-1]), True)  # the last of each place
        at, v, keys = at[keep], v[keep], [k[keep] for k in keys]
        starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        ends = [*starts[1:].tolist(), len(at)]
        for lo in range(0, len(starts), 4096):
            some = starts[lo : lo + 4096]
            parts = [pack_part(at[a:b], v[a:b]) for a, b in zip(some.tolist(), ends[lo : lo + 4096], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[some]) for k in keys), pa.array(parts, pa.binary())], names=["cx", "cy", "cz", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    return stored.mapInArrow(run, PART).repartition("cx", "cy", "cz").sortWithinPartitions("cx", "cy", "cz")


def chunk_voxels(batches: Iterator[pa.RecordBatch], merge: str | None = None) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray]]:
    """(chunk, places in Fortran order, values) of rows as by_chunk gives them; what
    is held is one chunk and a batch."""

    def whole() -> tuple:
        at, v = (np.concatenate(x) if len(held) > 1 else x[0] for x in zip(*held, strict=True))
        if len(held) > 1:
            at, v = last_of_each(at, v, merge)
        return key, at[v != 0], v[v != 0]

    key, held = None, []
    for b in batches:
        for *k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if tuple(k) != key:
                if held and len((found := whole())[1]):
                    yield found
                key, held = tuple(k), []
            held.append(unpack_part(data))
    if held and len((found := whole())[1]):
        yield found


def merged(vox: DataFrame, shape, merge: str = "max") -> DataFrame:
    """Voxels of which several may lie at one place, as one each; zeros are left
    out. They are packed by chunks of shape, which is less to shuffle than rows,
    and come chunk by chunk."""
    sides, kind = tuple(Vec.of(shape)), np.float64 if is_real(vox) else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((points_of(sides, at) + np.array(key) * sides, v) for key, at, v in chunk_voxels(batches, merge))
        yield from voxel_batches(found, [*AXES, "v"], kind)

    return by_chunk(vox, sides, merge=merge).mapInArrow(run, f"x long, y long, z long, v {'double' if kind is np.float64 else 'long'}")


def _packed(held: list[tuple]) -> pa.RecordBatch:
    """Chunk rows (key, shape, data) as one batch."""
    keys = np.array([k for k, _, _ in held], np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(np.ascontiguousarray(keys[:, i])) for i in range(3)), pa.array([s for _, s, _ in held], pa.list_(pa.int32())), pa.array([d for _, _, d in held], pa.binary())],
        names=["cx", "cy", "cz", "shape", "data"],
    )


#: Bytes of packed chunks that are gathered into a batch.
BATCH_BYTES = 1 << 20


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 64
        if size >= BATCH_BYTES:
            yield _packed(held)
            held, size = [], 0
    if held:
        yield _packed(held)


def to_chunks(vox: DataFrame, shape, extra: dict[str, int] | None = None) -> DataFrame:
    """Voxels to dense chunks (CHUNK). Rows are dealt and sorted by chunk, so a
    task holds one chunk's voxels at a time; all-zero chunks are left out. extra:
    sizes of the axes before x, which a chunk holds whole (shape then has them too)."""
    sides, more = tuple(Vec.of(shape)), tuple((extra or {}).values())
    full = [*more, *sides]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((key, full, pack_voxels(full, at, v)) for key, at, v in chunk_voxels(batches))

    return by_chunk(vox, shape, extra).mapInArrow(run, CHUNK)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows; only one chunk's bytes are Python's at a time."""
    for b in batches:
        names, columns = b.schema.names, b.columns
        for k in range(b.num_rows):
            yield {n: c[k].as_py() for n, c in zip(names, columns, strict=True)}


def voxel_batches(parts: Iterator[tuple[np.ndarray, np.ndarray]], names: list[str], kind) -> Iterator[pa.RecordBatch]:
    """Points and values, gathered into batches."""

    def flush() -> pa.RecordBatch:
        q, v = (np.concatenate(x) if len(held) > 1 else x[0] for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(q[:, i])) for i in range(q.shape[1])), pa.array(v)], names=names)

    held, n = [], 0
    for q, v in parts:
        if len(v):
            held.append((q, v.astype(kind)))
            n += len(v)
        if n >= BATCH_ROWS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def from_chunks(chunks: DataFrame, real: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Non-zero voxels of dense chunks; real if their values are floating numbers."""
    names = [*extra, *AXES, "v"]
    kind = np.float64 if real else np.int64

    def voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for r in _one_by_one(batches):
            at, v = unpack_voxels(r["data"])
            low = [0] * len(extra) + [r[c] * s for c, s in zip(("cx", "cy", "cz"), r["shape"][len(extra) :], strict=True)]
            yield points_of(r["shape"], at) + np.array(low), v

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from voxel_batches(voxels(batches), names, kind)

    return chunks.mapInArrow(unpack, ", ".join(f"{n} long" for n in names[:-1]) + f", v {'double' if real else 'long'}")


#: Results of map_chunks that are gathered into a batch.
MAPPED_ROWS = 256


def map_chunks(chunks: DataFrame, fn: Callable[[Box, np.ndarray], dict], schema: str) -> DataFrame:
    """fn over every dense chunk; its result is a row with the chunk's key, since
    the order of chunks means nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for r in _one_by_one([b]):
                a = unpack_chunk(r["shape"], r["data"])
                low = Vec(*(int(r[k]) * s for k, s in zip(("cx", "cy", "cz"), r["shape"], strict=True)))
                rows.append({"cx": r["cx"], "cy": r["cy"], "cz": r["cz"]} | fn(Box(low, low + Vec(*r["shape"])), a))
                if len(rows) >= MAPPED_ROWS:
                    yield pa.RecordBatch.from_pylist(rows)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return chunks.mapInArrow(run, f"cx long, cy long, cz long, {schema}")


def zip_chunks(source: DataFrame, target: DataFrame, fn: Callable[[np.ndarray | None, np.ndarray | None], np.ndarray], ratio=1) -> DataFrame:
    """fn over source and target chunks of the same place; source chunk indices
    are ratio times the target's. Chunks of which only one side is stored come with None."""
    r = Vec.of(ratio)
    at = Vec.columns("c") // r
    keyed = source.select(*[v.alias(f"c{a}") for v, a in zip(at, AXES, strict=True)], F.col("shape").alias("s_shape"), F.col("data").alias("s_data"))
    both = keyed.join(target.withColumnsRenamed({"shape": "t_shape", "data": "t_data"}), ["cx", "cy", "cz"], "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda s, d: None if d is None else unpack_chunk(s, d)

        def rows() -> Iterator[tuple]:
            for x in _one_by_one(batches):
                got = np.asarray(fn(load(x["s_shape"], x["s_data"]), load(x["t_shape"], x["t_data"])))
                flat = got.ravel(order="F")
                at = np.flatnonzero(flat)
                yield (x["cx"], x["cy"], x["cz"]), list(got.shape), pack_voxels(got.shape, at, flat[at].astype(np.float64 if got.dtype.kind == "f" else np.int64))

        yield from _batched(rows())

    return both.mapInArrow(run, CHUNK)
