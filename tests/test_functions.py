import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeflow.functions import affine, scalars
from latticeflow.functions.geometry import Box, Vec, ceil_div, floor_div, mag, mag_name
from latticeflow.operators import graph
from latticeflow.plans import schedule

small = st.integers(-50, 50)
side = st.integers(1, 9)
point = st.tuples(small, small, small)


@given(small, side)
def test_division_rounds(a, b):
    assert floor_div(a, b) * b <= a < (floor_div(a, b) + 1) * b
    assert (ceil_div(a, b) - 1) * b < a <= ceil_div(a, b) * b


def test_columns_divide_like_numbers(spark):
    rows = [(a, b) for a in range(-9, 10) for b in (1, 2, 3, 7)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", floor_div(F.col("a"), F.col("b")), ceil_div(F.col("a"), F.col("b"))).collect()
    assert all(r[2] == r[0] // r[1] and r[3] == -(-r[0] // r[1]) for r in got)


@given(point, st.tuples(small, small, small), side)
def test_alignment(tl, size, m):
    box = Box.of(tl, size)
    out, inner = box.aligned(m, True), box.aligned(m, False)
    assert out.contains_box(box)
    assert all(v % m == 0 for v in (*out.low, *out.high, *inner.low, *inner.high))
    assert out.in_mag(m).from_mag(m) == out


def test_negative_size_turns_the_box_round():
    box = Box.of((10, 10, 10), (-5, 5, -50))
    assert tuple(box.low) == (5, 10, -40) and tuple(box.size) == (5, 5, 50)


def test_point_in_box(spark):
    box = Box.of(1, 5)
    inside = spark.range(1).select(*[box.contains(Vec.of(F.lit(v))) for v in (5.5, 6.0, 1.0)]).first()
    assert tuple(inside) == (True, False, True)


def test_chunk_grid():
    lows = lambda boxes, k: sorted({list(b.low)[k] for b in boxes})
    grid = list(Box.of((5, 7, 9), 20).chunks(16))
    assert [lows(grid, k) for k in range(3)] == [[5, 21], [7, 23], [9, 25]]
    grid = list(Box.of((-5, 3, -7), (20, 10, 10)).chunks((16, 8, 4), (8, 4, 2)))
    assert [lows(grid, k) for k in range(3)] == [[-5, 8], [3, 8], [-7, -4, 0]]
    assert sum(b.volume() for b in grid) == 20 * 10 * 10


@given(point, st.tuples(side, side, side), st.tuples(side, side, side))
@settings(max_examples=50)
def test_chunks_cover_once(tl, size, shape):
    box = Box.of(tl, size)
    assert sum(c.volume() for c in box.chunks(shape)) == box.volume()


def test_unaligned_box_is_an_error(spark):
    with pytest.raises(ValueError):
        Box.of(1, 4).in_mag(2)
    with pytest.raises(Exception, match="not aligned"):
        spark.range(1).select(*Box.of(Vec.of(F.lit(1)), 4).in_mag(2).named()).collect()


def test_mags():
    assert mag_name(mag("4-4-2")) == "4-4-2" and mag_name(mag(2)) == "2"
    with pytest.raises(ValueError):
        mag(3)


def names(found):
    return [mag_name(m) for m in found]


def test_schedules():
    assert names(schedule.coarser_mags(1, 16, (10.5, 10.5, 24))) == ["2-2-1", "4-4-2", "8-8-4", "16-16-8"]
    assert names(schedule.coarser_mags(1, 16, (10.5, 10.5, 35))) == ["2-2-1", "4-4-1", "8-8-2", "16-16-4"]
    assert names(schedule.coarser_mags(1, (16, 16, 1))) == ["2-2-1", "4-4-1", "8-8-1", "16-16-1"]
    assert names(schedule.coarser_mags((4, 4, 2), 16, (1, 1, 1))) == ["8", "16"]
    with pytest.raises(RuntimeError):
        schedule.coarser_mags(2, (16, 16, 2), (10.5, 10.5, 24))
    assert [schedule.default_coarsest((n,) * 3).x for n in (65536, 4096, 256)] == [1024, 64, 4]
    assert names(schedule.finer_mags(8, 1)) == ["4", "2", "1"]
    assert schedule.interpolation("default", "segmentation") == "mode"


def test_affine_inverse_and_chain():
    m = affine.chain(affine.rotation("z", 30), affine.scale((1.3, 0.8, 1.1)), affine.translation((5.5, -3.25, 7)))
    back = affine.apply(affine.inverse(m), affine.apply(m, Vec(3.0, -2.0, 9.0)))
    assert [round(v, 9) for v in back] == [3.0, -2.0, 9.0]
    assert tuple(affine.apply(affine.rotation("z", 90), Vec(1, 0, 0))) == (0.0, 1.0, 0.0)


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        scalars.normal_path(F.lit("/a/./b/../c//d/")), scalars.normal_path(F.lit("../a/..")), scalars.snake_to_camel(F.lit("largest_segment_id")),
        scalars.relative_path(F.lit("/data/x/color"), F.lit("/data/x/")), scalars.metadata_kind(F.lit("12.5")), scalars.metadata_kind(F.lit('["a"]')),
        scalars.channel_dtype(F.lit("uint24"), F.lit(3)), scalars.element_class(F.lit("uint8"), F.lit(3)),
    ).first()
    assert tuple(got) == ("/a/c/d", "..", "largestSegmentId", "./color", "number", "string[]", "uint8", "uint24")
    with pytest.raises(Exception, match="unknown length unit"):
        one.select(scalars.unit_name(F.lit("furlong"))).collect()


def test_small_settings(spark):
    import colorsys
    import time

    assert scalars.job_resources("cpus-per-task=4, mem=2.5,queue=long") == {"cpus_per_task": 4, "mem": 2.5, "queue": "long"}
    assert scalars.job_resources('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError):
        scalars.job_resources("nothing")
    assert tuple(schedule.buffer_shape((1024, 128, 600))) == (512, 128, 512)
    assert tuple(schedule.shard_shape((32, 32, 32), chunks_per_shard=(4, 4, 1))) == (128, 128, 32) and schedule.shard_shape() is None
    for bad in ({"shard": (33, 32, 32)}, {"shard": (32, 32, 32), "chunks_per_shard": (1, 1, 1)}):
        with pytest.raises(ValueError):
            schedule.shard_shape(**bad)
    schedule.check_chunk_shape((64, 64, 64), (2, 2, 1), (32, 32, 32))
    for shape in ((64, 64, 48), (0, 64, 64)):
        with pytest.raises(ValueError):
            schedule.check_chunk_shape(shape, (2, 2, 1), (32, 32, 32))
    row = spark.range(50).select(scalars.epoch_ms().alias("now"), scalars.random_color(3).alias("c")).collect()
    assert abs(row[0]["now"] / 1000 - time.time()) < 60
    for r in row:
        h, light, s = colorsys.rgb_to_hls(*r["c"][:3])
        assert 0.399 <= light <= 0.601 and 0.499 <= s <= 1.001 and r["c"][3] == 1.0
    assert len({tuple(r["c"]) for r in row}) == 50


def test_import_graphs(spark):
    nodes = spark.createDataFrame([("a", 7, 1, 1, 1), ("b", 7, 2, 2, 2), ("b", 3, 0, 0, 0)], "tree string, node long, x int, y int, z int")
    edges = spark.createDataFrame([("b", 7, 3, "red")], "tree string, source long, target long, color string")
    made, links = graph.import_graphs(nodes, edges, first=10)
    assert sorted((r["tree"], r["id"], r["node"], r["radius"]) for r in made.collect()) == [("a", 10, 7, 1.0), ("b", 11, 3, 1.0), ("b", 12, 7, 1.0)]
    assert [tuple(r) for r in links.collect()] == [("b", 12, 11)]
