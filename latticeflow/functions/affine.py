"""4 x 4 affine matrices, built on the driver and applied as projections."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import functions as F

from .geometry import Box, Vec, _col, _symbolic, at_least, at_most

Matrix = list[list[float]]


def identity() -> Matrix:
    return [[float(i == j) for j in range(4)] for i in range(4)]


def translation(by: Sequence[float]) -> Matrix:
    m = identity()
    for i, t in enumerate(by):
        m[i][3] = float(t)
    return m


def scale(by: float | Sequence[float]) -> Matrix:
    factors = [by] * 3 if isinstance(by, int | float) else by
    m = identity()
    for i, f in enumerate(factors):
        m[i][i] = float(f)
    return m


def flip(axis: str) -> Matrix:
    return scale([-1.0 if a == axis else 1.0 for a in "xyz"])


def rotation(axis: str, degrees: float) -> Matrix:
    """Counter-clockwise about an axis; multiples of 90 degrees are exact."""
    quarter = {0: (1.0, 0.0), 1: (0.0, 1.0), 2: (-1.0, 0.0), 3: (0.0, -1.0)}
    turn = degrees / 90
    c, s = quarter[int(turn) % 4] if turn == int(turn) else (math.cos(math.radians(degrees)), math.sin(math.radians(degrees)))
    a = "xyz".index(axis)
    i, j = (a + 1) % 3, (a + 2) % 3
    m = identity()
    m[i][i], m[i][j], m[j][i], m[j][j] = c, -s, s, c
    return m


def chain(*matrices: Matrix) -> Matrix:
    """The transform that applies the matrices in the order given."""
    total = identity()
    for m in matrices:
        total = [[sum(m[i][k] * total[k][j] for k in range(4)) for j in range(4)] for i in range(4)]
    return total


def inverse(m: Matrix) -> Matrix:
    """By elimination with pivoting; a singular matrix is an error."""
    rows = [list(map(float, r)) + e for r, e in zip(m, identity(), strict=True)]
    for k in range(4):
        p = max(range(k, 4), key=lambda r: abs(rows[r][k]))
        if not rows[p][k]:
            raise ValueError("the matrix has no inverse")
        rows[k], rows[p] = rows[p], rows[k]
        rows[k] = [v / rows[k][k] for v in rows[k]]
        for r in range(4):
            if r != k and rows[r][k]:
                rows[r] = [a - rows[r][k] * b for a, b in zip(rows[r], rows[k], strict=True)]
    return [r[4:] for r in rows]


def apply(m: Matrix, p: Vec) -> Vec:
    """The transformed point, as doubles."""
    values = [_col(v).cast("double") if _symbolic(*p) else float(v) for v in p]

    def row(r: list[float]):
        total = None
        for f, v in zip(r, values, strict=False):
            if f:
                term = v if f == 1.0 else v * f
                total = term if total is None else total + term
        if total is None:
            return F.lit(r[3]) if _symbolic(*p) else r[3]
        return total + r[3] if r[3] else total

    return Vec(*[row(r) for r in m[:3]])


def apply_to_box(m: Matrix, box: Box) -> Box:
    """The box around the transformed corners, rounded outward."""
    lows = highs = None
    for corner in product(*zip(box.low, box.high, strict=True)):
        p = apply(m, Vec(*corner))
        lows = p if lows is None else lows.map(p, at_most)
        highs = p if highs is None else highs.map(p, at_least)
    down = lambda v: F.floor(v) if _symbolic(v) else math.floor(v)
    up = lambda v: F.ceil(v) if _symbolic(v) else math.ceil(v)
    return Box(Vec(*map(down, lows)), Vec(*map(up, highs)))
