import numpy as np
import pytest

from latticeflow.functions import affine
from latticeflow.functions.geometry import Box
from latticeflow.operators import aggregate, graph, region, resample


def table(spark, a):
    rows = [(*map(int, p), int(a[tuple(p)])) for p in np.argwhere(a)]
    return spark.createDataFrame(rows, "x long, y long, z long, v long")


def array(df, shape):
    a = np.zeros(shape, np.int64)
    for r in df.collect():
        a[r["x"], r["y"], r["z"]] = r["v"]
    return a


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(3).integers(0, 4, (9, 8, 6)) * np.random.default_rng(4).integers(0, 2, (9, 8, 6))


def blocks(a, f):
    pad = [(0, -n % k) for n, k in zip(a.shape, f, strict=True)]
    a = np.pad(a, pad)
    shape = [v for n, k in zip(a.shape, f, strict=True) for v in (n // k, k)]
    b = a.reshape(shape)
    # z, x, y inside a cell: y runs fastest
    return b.transpose(0, 2, 4, 5, 1, 3).reshape(*b.shape[::2], -1)


def first_mode(values):
    found, n = np.unique(values, return_counts=True)
    best = {v for v, k in zip(found, n, strict=True) if k == n.max()}
    return next(v for v in values if v in best)


REDUCE = {"max": lambda b: b.max(-1), "min": lambda b: b.min(-1), "median": lambda b: np.median(b, -1).astype(int), "mode": lambda b: np.apply_along_axis(first_mode, -1, b)}


@pytest.mark.parametrize("mode", sorted(REDUCE))
@pytest.mark.parametrize("factor", [(2, 2, 2), (2, 2, 1), (4, 2, 1)])
def test_downsample(spark, cube, mode, factor):
    want = REDUCE[mode](blocks(cube, factor))
    assert (array(resample.downsample(table(spark, cube), factor, mode), want.shape) == want).all()


def test_known_modes_and_medians(spark):
    columns = np.array([[1, 3, 4, 2, 2, 7], [5, 2, 2, 1, 4, 1], [3, 3, 2, 2, 1, 1]])
    a = np.zeros((6, 4, 1), int)
    a[:, :3, 0] = columns.T  # y runs fastest; the fourth value of a cell is 0
    got = array(resample.downsample(table(spark, a), (1, 4, 1), "mode"), (6, 1, 1))[:, 0, 0]
    assert got.tolist() == [1, 3, 2, 2, 2, 1]


def test_upsample(spark, cube):
    want = cube.repeat(2, 0).repeat(2, 1).repeat(4, 2)
    assert (array(resample.upsample(table(spark, cube), (2, 2, 4)), want.shape) == want).all()
    assert resample.upsample(table(spark, cube), (1, 1, 4), corners_only=True).count() == 2 * (cube != 0).sum()


def test_zoom_keeps_ends_and_constants():
    assert (resample.zoom(np.full((8, 8, 4), 5.0), (2, 2, 2), 2) == 5).all()
    got = resample.zoom(np.arange(8.0).reshape(8, 1, 1), (2, 1, 1), 1).ravel()
    assert got.tolist()[0] == 0 and got.tolist()[-1] == 7


def test_region_read_write_overlay(spark, cube):
    vox, box = table(spark, cube), Box.of((1, 2, 1), (5, 4, 3))
    part = cube.copy()
    part[1:6, 2:6, 1:4] = 0
    assert (array(region.write(vox, vox.limit(0), box), cube.shape) == part).all()
    dense = region.read_dense(vox, box)
    assert dense.count() == box.volume()
    with pytest.raises(ValueError):
        region.read_dense(vox, Box.of(1, (0, 1, 1)))
    over = np.zeros_like(cube)
    over[5, 5, 5] = 9
    want = cube.copy()
    want[4:8, 4:8, 4:8] = 0
    want[5, 5, 5] = 9
    assert (array(region.overlay(vox, table(spark, over), 4), cube.shape) == want).all()
    assert region.content_difference(vox, vox).first()["equal"]
    assert not region.content_difference(vox, vox.limit(3)).first()["equal"]


def test_chunks_round_trip_and_zip(spark, cube):
    vox = table(spark, cube)
    chunks = region.to_chunks(vox, (4, 4, 4))
    assert (array(region.from_chunks(chunks), cube.shape) == cube).all()
    sums = {tuple(r[:3]): r["total"] for r in region.map_chunks(chunks, lambda box, a: {"total": int(a.sum())}, "total long").collect()}
    assert sum(sums.values()) == cube.sum()
    both = region.zip_chunks(chunks, chunks, lambda a, b: a + b)
    assert (array(region.from_chunks(both), cube.shape) == 2 * cube).all()


def test_transform_is_nearest_neighbour(spark, cube):
    m = affine.chain(affine.rotation("z", 30), affine.scale((1.3, 0.8, 1.1)), affine.translation((1.5, 2.25, 0.5)))
    target = Box.of(0, (14, 12, 8))
    got = array(region.transformed(table(spark, cube), m, Box.of(0, cube.shape), target), (14, 12, 8))
    back = np.array(affine.inverse(m))
    want = np.zeros_like(got)
    for p in np.ndindex(want.shape):
        q = back[:3, :3] @ p + back[:3, 3]
        if (q >= 0).all() and (q <= np.array(cube.shape) - 1).all():
            want[p] = cube[tuple(np.floor(q + 0.5).astype(int))]
    assert (got == want).all()


def test_segment_aggregates(spark):
    a = np.zeros((4, 4, 2), int)
    a[1:3, 1, 0], a[3, 3, 1] = 7, 2
    vox = table(spark, a)
    assert aggregate.largest_id(vox).first()["largest"] == 7
    assert aggregate.largest_id(vox.limit(0)).first()["largest"] is None
    sizes = {r["segment"]: (r["n"], r["volume"]) for r in aggregate.segment_sizes(vox, (2.0, 2.0, 1.0)).collect()}
    assert sizes == {7: (2, 8.0), 2: (1, 4.0)}
    assert aggregate.segment_boxes(vox).where("segment = 7").drop("segment").first()[:] == (1, 1, 0, 3, 2, 1)


def test_agglomerates(spark):
    segments = spark.createDataFrame([(i,) for i in range(1, 8)], "segment long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (1, 7)], "source long, target long")
    members = graph.agglomerates(segments, edges)
    assert [r["agglomerate"] for r in members.orderBy("segment").collect()] == [1, 1, 1, 1, 2, 2, 1]
    flat = [r["segment"] for r in members.orderBy("agglomerate", "position").collect()]
    assert flat == [1, 2, 3, 4, 7, 5, 6]
    rows = graph.agglomerate_offsets(members, edges).orderBy("agglomerate").collect()
    assert [(r["segment_offset"], r["edge_offset"]) for r in rows] == [(0, 0), (5, 4)]


def test_components_of_nothing_and_of_a_ring(spark):
    none = spark.createDataFrame([], "source long, target long")
    assert graph.components(none).count() == 0
    ring = spark.createDataFrame([(i, (i + 1) % 50) for i in range(50)] + [(60, 61), (5, 5)], "source long, target long")
    got = {r["node"]: r["component"] for r in graph.components(ring).collect()}
    assert got == dict.fromkeys(range(50), 0) | {60: 60, 61: 60}


def test_spanning_links(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 2.5), (4, 5, 1.0)], "tree_a long, tree_b long, distance double")
    got = {(r["tree_a"], r["tree_b"]) for r in graph.spanning_links(pairs).collect()}
    assert got == {(1, 2), (2, 3), (4, 5)}


def spline_by_hand(line, at):
    """A quadratic spline through line, continued by its ends, at places; its
    coefficients are found by repeated sweeps over the equations."""
    far = 30
    f = [line[0]] * far + list(line) + [line[-1]] * far
    c = list(f)
    for _ in range(200):
        c = [(f[i] - (c[max(i - 1, 0)] + c[min(i + 1, len(f) - 1)]) / 8) / 0.75 for i in range(len(f))]

    def b(t):
        t = abs(t)
        return 0.75 - t * t if t <= 0.5 else (1.5 - t) ** 2 / 2 if t <= 1.5 else 0.0

    return [sum(c[i] * b(x + far - i) for i in range(len(f))) for x in at]


def test_zoom_against_a_spline_by_hand():
    g = np.random.default_rng(8)
    for n in (4, 8, 12):
        line = g.integers(0, 200, n).astype(float)
        at = np.linspace(0, n - 1, n // 2)
        got = resample.zoom(line.reshape(n, 1, 1), (2, 1, 1), 2).ravel()
        assert np.allclose(got, spline_by_hand(line.tolist(), at.tolist()), atol=1e-6)
        assert np.allclose(resample.zoom(line.reshape(1, n, 1), (1, 2, 1), 0).ravel(), line[np.floor(at + 0.5).astype(int)])
        low = np.minimum(np.floor(at).astype(int), n - 2)
        assert np.allclose(resample.zoom(line.reshape(1, 1, n), (1, 1, 2), 1).ravel(), line[low] + (at - low) * (line[low + 1] - line[low]))
    smooth = resample.zoom(np.arange(16.0).reshape(16, 1, 1) ** 2, (2, 1, 1), 2).ravel()
    assert smooth[0] == pytest.approx(0, abs=1e-6) and smooth[-1] == pytest.approx(225)  # ends are kept, not blurred


def test_spline_tiles(spark, cube):
    padded = np.zeros((16, 8, 8))
    padded[:9, :8, :6] = cube
    for mode, order in (("nearest", 0), ("bilinear", 1), ("bicubic", 2)):
        got = array(resample.resample_tiles(table(spark, cube), 2, mode, tile=4), (8, 4, 4))
        halves = [resample.zoom(padded[i : i + 8], (2, 2, 2), order) for i in (0, 8)]
        want = np.concatenate(halves)
        assert (got == (np.sign(want) * np.floor(np.abs(want) + 0.5 + 1e-9))).all()


def test_moved_is_what_transformed_takes_from_stored_voxels(spark, cube):
    mask = cube * (np.random.default_rng(9).random(cube.shape) < 0.5)
    source = Box.of(0, cube.shape)
    turns = [
        affine.translation((3, -2, 1)),
        affine.scale((2, 0.5, 1)),
        affine.scale((3, 1, 1)),
        affine.chain(affine.rotation("z", 90), affine.translation((9, 0, 0))),
        affine.chain(affine.rotation("y", 30), affine.scale(1.5)),
    ]
    for m in turns:
        target = affine.apply_to_box(m, source).padded(2, 2)
        for where in (None, table(spark, mask)):
            dense = region.transformed(table(spark, cube), m, source, target, mask=where).where("v <> 0")
            sparse = region.moved(table(spark, cube), m, source, mask=where)
            assert sorted(map(tuple, sparse.select("x", "y", "z", "v").collect())) == sorted(map(tuple, dense.collect()))
        part = Box(target.low, source.high)
        assert region.moved(table(spark, cube), m, source, part).count() == region.read(region.moved(table(spark, cube), m, source), part).count()


def test_real_values_and_channels_stay_what_they_are(spark, cube):
    rows = [(c, *map(int, p), float(cube[tuple(p)]) / 4 + c) for c in (0, 1) for p in np.argwhere(cube)]
    both = spark.createDataFrame(rows, "c long, x long, y long, z long, v double")
    for mode in ("max", "median", "mode", "min"):
        got = resample.downsample(both, 2, mode)
        assert got.columns == ["c", "x", "y", "z", "v"] and dict(got.dtypes)["v"] == "double"
        for c in (0, 1):
            one = resample.downsample(both.where(f"c = {c}").drop("c"), 2, mode)
            assert sorted(map(tuple, got.where(f"c = {c}").drop("c").collect())) == sorted(map(tuple, one.collect()))
    chunks = region.to_chunks(both, (4, 4, 4), {"c": 2})
    assert sorted(map(tuple, region.from_chunks(chunks, real=True, extra=("c",)).collect())) == sorted(rows)
    assert sorted(r["v"] for r in resample.downsample(both.where("c = 0").drop("c"), 2, "max").collect())[-1] == 0.75


def test_circles_of_groups_are_an_error(spark):
    groups = spark.createDataFrame([(1, None, "a"), (2, 3, "b"), (3, 2, "c")], "id long, parent long, name string")
    values = spark.createDataFrame([(1, 5), (2, 6)], "id long, n long")
    with pytest.raises(ValueError, match="top"):
        graph.flattened(groups)
    with pytest.raises(ValueError, match="circle"):
        graph.subtree_sums(groups, values, "n")
    assert {tuple(r) for r in graph.subtree_sums(groups.where("id = 1"), values.where("id = 1"), "n").collect()} == {(1, 5)}
