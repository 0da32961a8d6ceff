"""Which magnifications a pyramid has."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from ..functions.geometry import Vec, mag

INTERPOLATION = {"segmentation": "mode", "color": "median"}


def _elongation(size: Sequence[float]) -> float:
    return max(size) / min(size)


def _next(now: tuple, limit: tuple, voxel_size: Sequence[float] | None) -> tuple:
    """The next coarser magnification, before it is held against others of its size."""
    doubled = tuple(2 * m for m in now)
    if voxel_size is not None:
        extent = [m * v for m, v in zip(now, voxel_size, strict=True)]
        smallest = min(extent)
        narrow = tuple(2 * m if e == smallest else m for m, e in zip(now, extent, strict=True))
        shape = lambda m: _elongation([a * v for a, v in zip(m, voxel_size, strict=True)])
        if shape(narrow) <= shape(doubled):
            doubled = narrow
    return tuple(min(a, b) for a, b in zip(doubled, limit, strict=True))


def coarser_mags(from_mag, coarsest, voxel_size: Sequence[float] | None = None, others: Iterable = ()) -> list[Vec]:
    """Magnifications after from_mag up to coarsest, by their largest axis.

    Without voxel_size every axis doubles until it reaches coarsest; with it the
    step is taken that keeps voxels closest to cubes. A step that leaves the
    largest axis as it was only prepares the next. Magnifications of other layers
    are taken over where one has the next size. A coarsest magnification that
    can't be reached is an error."""
    now, limit = tuple(mag(from_mag)), tuple(mag(coarsest))
    if any(a > b for a, b in zip(now, limit, strict=True)):
        raise ValueError("the first magnification is coarser than the last")
    known: dict[int, tuple] = {}
    for m in map(tuple, map(mag, others)):
        if known.setdefault(max(m), m) != m:
            raise ValueError(f"other layers disagree on magnification {max(m)}")
    found: list[Vec] = []
    while max(now) < max(limit):
        step = known.get(2 * max(now)) or _next(now, limit, voxel_size)
        if step == now:
            raise RuntimeError(f"{limit} can't be reached from {now} with voxels of {voxel_size}")
        grown = max(step) > max(now)
        now = step
        if grown or voxel_size is None:
            found.append(Vec(*now))
    return found


def finer_mags(from_mag, finest=1, voxel_size: Sequence[float] | None = None, others: Iterable = ()) -> list[Vec]:
    """The way down from from_mag to finest, over the same steps."""
    up = coarser_mags(finest, from_mag, voxel_size, others)
    return [*reversed(up[:-1]), mag(finest)]


def default_coarsest(size) -> Vec:
    """The power of two, 4 at least, at which a slice has about 100 voxels a side."""
    longest, m = max(list(Vec.of(size))[:2]), 1
    while m * 100 < longest:
        m *= 2
    return Vec.of(max(m, 4))


def constant_z(coarsest: Vec) -> Vec:
    return coarsest.replace("z", 1)


#: Target voxels a side of a buffer, at most.
BUFFER = 512


def buffer_shape(shard) -> Vec:
    """Voxels of the coarser magnification that one job makes: a shard's, up to BUFFER a side."""
    return Vec(*[min(BUFFER, s) for s in Vec.of(shard)])


def shard_shape(chunk=(32, 32, 32), shard=None, chunks_per_shard=None) -> Vec | None:
    """The shard that is asked for, by its shape or in chunks; null if neither is."""
    if shard is not None and chunks_per_shard is not None:
        raise ValueError("give a shard's shape or its chunks, not both")
    if shard is None:
        return None if chunks_per_shard is None else Vec.of(chunk) * Vec.of(chunks_per_shard)
    if any(s % c for s, c in zip(Vec.of(shard), Vec.of(chunk), strict=True)):
        raise ValueError("a shard must hold whole chunks")
    return Vec.of(shard)


def check_chunk_shape(shape, mag, chunk, shard=None) -> None:
    """A chunk of work must hold whole chunks, or whole shards if it is written."""
    if any(s < 1 for s in Vec.of(shape)):
        raise ValueError("a chunk shape must be positive")
    if any(s % (m * u) for s, m, u in zip(Vec.of(shape), Vec.of(mag), Vec.of(shard or chunk), strict=True)):
        raise ValueError("a chunk shape must be a multiple of the stored one")


def interpolation(mode: str, category: str) -> str:
    return INTERPOLATION.get(category, "median") if mode.lower() == "default" else mode.lower()
