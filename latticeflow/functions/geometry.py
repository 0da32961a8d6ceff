"""Vectors, boxes and magnifications as Column expressions.

A value may be a Python int or a Column; the same code serves both, so driver
code and query plans agree. Boxes are half-open: (x0, y0, z0) is inside,
(x1, y1, z1) is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Num = "int | Column"
AXES = ("x", "y", "z")


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _symbolic(*values) -> bool:
    return any(isinstance(v, Column) for v in values)


def floor_div(a, b):
    """Division rounded down, also for negative values."""
    if not _symbolic(a, b):
        return a // b
    return ((_col(a) - F.pmod(_col(a), _col(b))) / _col(b)).cast("long")


def ceil_div(a, b):
    return -floor_div(-a, b)


def floor_mod(a, b):
    return F.pmod(_col(a), _col(b)) if _symbolic(a, b) else a % b


def at_least(a, b):
    return F.greatest(_col(a), _col(b)) if _symbolic(a, b) else max(a, b)


def at_most(a, b):
    return F.least(_col(a), _col(b)) if _symbolic(a, b) else min(a, b)


@dataclass(frozen=True)
class Vec:
    """Three numbers or Columns with element-wise arithmetic."""

    x: object
    y: object
    z: object

    @classmethod
    def of(cls, value) -> Vec:
        """A Vec, a sequence of three, or one number for all axes."""
        if isinstance(value, Vec):
            return value
        if isinstance(value, int | float | Column):
            return cls(value, value, value)
        return cls(*value)

    @classmethod
    def columns(cls, prefix: str = "", names: Sequence[str] = AXES) -> Vec:
        return cls(*[F.col(prefix + n) for n in names])

    @classmethod
    def parse(cls, text: str | Column) -> Vec:
        """Three integers out of text such as '1, 2, 3' or '(1,2,3)'."""
        if isinstance(text, str):
            import re

            return cls(*map(int, re.findall(r"-?\d+", text)))
        found = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), 1), lambda s: s.cast("long"))
        return cls(*[F.get(found, k) for k in range(3)])

    def __iter__(self) -> Iterator:
        return iter((self.x, self.y, self.z))

    def map(self, other, fn: Callable) -> Vec:
        return Vec(*[fn(a, b) for a, b in zip(self, Vec.of(other), strict=True)])

    def __add__(self, other) -> Vec:
        return self.map(other, lambda a, b: a + b)

    def __sub__(self, other) -> Vec:
        return self.map(other, lambda a, b: a - b)

    def __mul__(self, other) -> Vec:
        return self.map(other, lambda a, b: a * b)

    def __floordiv__(self, other) -> Vec:
        return self.map(other, floor_div)

    def __mod__(self, other) -> Vec:
        return self.map(other, floor_mod)

    def __neg__(self) -> Vec:
        return Vec(*[-a for a in self])

    def ceil_div(self, other) -> Vec:
        return self.map(other, ceil_div)

    def pair_max(self, other) -> Vec:
        return self.map(other, at_least)

    def pair_min(self, other) -> Vec:
        return self.map(other, at_most)

    def product(self):
        return self.x * self.y * self.z

    def largest(self):
        return at_least(at_least(self.x, self.y), self.z)

    def replace(self, axis: str, value) -> Vec:
        return Vec(*[value if n == axis else v for n, v in zip(AXES, self, strict=True)])

    def moved(self, source: int, target: int) -> Vec:
        """One axis taken out and put in at another place."""
        values = list(self)
        values.insert(target, values.pop(source))
        return Vec(*values)

    def is_positive(self, strict: bool = False):
        tests = [(v > 0) if strict else (v >= 0) for v in self]
        return tests[0] & tests[1] & tests[2]

    def is_uniform(self):
        return (self.x == self.y) & (self.y == self.z)

    def is_power_of_two(self):
        one = lambda v: (F.bit_count(v) == 1) & (v > 0) if _symbolic(v) else v > 0 and v & (v - 1) == 0
        a, b, c = map(one, self)
        return a & b & c if _symbolic(*self) else a and b and c

    def to_int(self) -> Vec:
        """Truncated to integers."""
        return Vec(*[v.cast("long") if _symbolic(v) else int(v) for v in self])

    def struct(self) -> Column:
        return F.struct(*[_col(v).alias(n) for n, v in zip(AXES, self, strict=True)])


def mag(value) -> Vec:
    """A magnification: an int, three ints or text such as '2-2-1'; powers of two only."""
    if isinstance(value, str):
        parts = [int(p) for p in value.split("-")]
        value = parts[0] if len(parts) == 1 else parts
    v = Vec.of(value)
    if not _symbolic(*v) and not v.is_power_of_two():
        raise ValueError(f"not a power of two on every axis: {value}")
    return v


def parse_mag(text: Column) -> Vec:
    """Magnification text of a column; one number counts for every axis."""
    parts = F.transform(F.split(text, "-"), lambda s: s.cast("long"))
    return Vec(F.get(parts, 0), *[F.coalesce(F.get(parts, k), F.get(parts, 0)) for k in (1, 2)])


def mag_name(v: Vec) -> str:
    return str(v.x) if v.x == v.y == v.z else f"{v.x}-{v.y}-{v.z}"


@dataclass(frozen=True)
class Box:
    """A half-open box from low to high."""

    low: Vec
    high: Vec

    @classmethod
    def of(cls, top_left, size) -> Box:
        """Negative sizes turn the box round."""
        tl, size = Vec.of(top_left), Vec.of(size)
        end = tl + size
        return cls(tl.pair_min(end), tl.pair_max(end))

    @classmethod
    def columns(cls, prefix: str = "") -> Box:
        return cls(Vec.columns(prefix, ("x0", "y0", "z0")), Vec.columns(prefix, ("x1", "y1", "z1")))

    @property
    def size(self) -> Vec:
        return self.high - self.low

    def named(self, prefix: str = "") -> list[Column]:
        names = ("x0", "y0", "z0", "x1", "y1", "z1")
        return [_col(v).cast("long").alias(prefix + n) for n, v in zip(names, (*self.low, *self.high), strict=True)]

    def padded(self, before, after=None) -> Box:
        return Box(self.low - before, self.high + (before if after is None else after))

    def offset(self, by) -> Box:
        return Box(self.low + by, self.high + by)

    def intersected(self, other: Box) -> Box:
        """The common part; its size is 0 on axes where there is none."""
        low = self.low.pair_max(other.low)
        return Box(low, self.high.pair_min(other.high).pair_max(low))

    def hull(self, other: Box) -> Box:
        """The smallest box around both; an empty box adds nothing."""
        if _symbolic(*self.low, *self.high, *other.low, *other.high):
            pick = lambda a, b, both: F.when(_col(self.is_empty()), _col(b)).when(_col(other.is_empty()), _col(a)).otherwise(both)
            low = Vec(*[pick(a, b, at_most(a, b)) for a, b in zip(self.low, other.low, strict=True)])
            return Box(low, Vec(*[pick(a, b, at_least(a, b)) for a, b in zip(self.high, other.high, strict=True)]))
        if self.is_empty():
            return other
        return self if other.is_empty() else Box(self.low.pair_min(other.low), self.high.pair_max(other.high))

    def volume(self):
        return self.size.product()

    def is_empty(self):
        a, b, c = [v <= 0 for v in self.size]
        return a | b | c

    def contains(self, point: Vec) -> Column:
        """A conjunction over single columns, which reaches the Parquet scan."""
        tests = [t for p, a, b in zip(point, self.low, self.high, strict=True) for t in (p >= a, p < b)]
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found

    def contains_box(self, inner: Box):
        tests = [t for k in range(3) for t in (list(self.low)[k] <= list(inner.low)[k], list(inner.high)[k] <= list(self.high)[k])]
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found

    def overlaps(self, other: Box):
        tests = [t for k in range(3) for t in (list(self.low)[k] < list(other.high)[k], list(other.low)[k] < list(self.high)[k])]
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found

    def aligned(self, m, ceil: bool) -> Box:
        """Grown (ceil) or shrunk to multiples of m."""
        m = Vec.of(m)
        if ceil:
            return Box(self.low // m * m, self.high.ceil_div(m) * m)
        return Box(self.low.ceil_div(m) * m, self.high // m * m)

    def in_mag(self, m) -> Box:
        """In voxels of m; a box that is not aligned is an error."""
        m = Vec.of(m)

        def exact(a, b):
            if not _symbolic(a, b):
                if a % b:
                    raise ValueError(f"{a} is no multiple of {b}")
                return a // b
            told = F.raise_error(F.lit("box is not aligned to the magnification")).cast("long")
            return F.when(F.pmod(_col(a), _col(b)) != 0, told).otherwise((_col(a) / _col(b)).cast("long"))

        return Box(self.low.map(m, exact), self.high.map(m, exact))

    def from_mag(self, m) -> Box:
        return Box(self.low * m, self.high * m)

    def chunks(self, shape, aligned_to=None) -> Iterable[Box]:
        """Boxes of a grid over this box, clipped to it, on the driver; with
        aligned_to the inner borders are multiples of it, else the grid starts at the box."""
        shape = Vec.of(shape)
        axes = []
        for low, high, step, grid in zip(self.low, self.high, shape, Vec.of(aligned_to) if aligned_to else (None,) * 3, strict=True):
            if grid is not None and step % grid:
                raise ValueError("a chunk must be a multiple of its alignment")
            first = low if grid is None else low - low % grid
            axes.append([(max(a, low), min(a + step, high)) for a in range(first, high, step)])
        for x in axes[0]:
            for y in axes[1]:
                for z in axes[2]:
                    yield Box(Vec(x[0], y[0], z[0]), Vec(x[1], y[1], z[1]))


def explode_chunks(df: DataFrame, box: Box, shape, aligned_to=None) -> DataFrame:
    """One row per chunk of each row's box, as x0 .. z1, clipped to the box."""
    shape = Vec.of(shape)
    kept = df.columns
    for axis, low, high, step, grid in zip(AXES, box.low, box.high, shape, Vec.of(aligned_to) if aligned_to else (None,) * 3, strict=True):
        first = low if grid is None else floor_div(low, grid) * grid
        starts = F.when(_col(high) > _col(low), F.sequence(_col(first), _col(high) - 1, F.lit(step).cast("long"))).otherwise(
            F.array().cast("array<bigint>")
        )
        df = df.withColumn(f"_{axis}", F.explode(starts))
    start = Vec.columns("_")
    clipped = Box(start.pair_max(box.low), (start + shape).pair_min(box.high))
    drop = {"x0", "y0", "z0", "x1", "y1", "z1"}
    return df.select(*[c for c in kept if c not in drop], *clipped.named())


def hull_of(df: DataFrame, keys: Sequence[str], point: Vec) -> DataFrame:
    """The smallest box around the points of each key."""
    names = (("x0", "y0", "z0"), ("x1", "y1", "z1"))
    low = [F.min(_col(v)).cast("long").alias(n) for v, n in zip(point, names[0], strict=True)]
    high = [(F.max(_col(v)) + 1).cast("long").alias(n) for v, n in zip(point, names[1], strict=True)]
    return df.groupBy(*keys).agg(*low, *high)


def morton(v: Vec, bits: int = 15) -> Column:
    """Z-order index: bits of x, y and z interleaved, x lowest."""
    total = F.lit(0).cast("long")
    for b in range(bits):
        for k, a in enumerate(v):
            bit = F.shiftright(_col(a).cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            total = total + F.shiftleft(bit, 3 * b + k)
    return total
