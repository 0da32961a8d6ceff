"""Work and memory follow what is stored, not the boxes around it."""

import tracemalloc

import numpy as np
import pytest

from latticeflow.operators import region, resample
from latticeflow.plans import queries
from latticeflow.sources import arrays, files, nml, volumes


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_nearest_and_bilinear_need_no_dense_tiles(spark):
    far = spark.createDataFrame([(1 << 40, 5, 1, 9), (7, 1 << 35, 3, 4)], "x long, y long, z long, v long")
    for mode in ("nearest", "bilinear"):
        got = resample.resample_tiles(far, 2, mode)
        assert "Pandas" not in _plan(got) and "InArrow" not in _plan(got)
        for x, y, z, v in got.collect():
            assert v and (x, y) in {(1 << 39, 2), (3, 1 << 34), ((1 << 39), 3)}
    assert "Pandas" not in _plan(resample.resample_tiles(far, 2, "bicubic"))


def test_bicubic_multiplies_only_planes_that_hold_a_voxel(spark):
    g = np.random.default_rng(3)
    a = np.zeros((16, 8, 8), np.int64)
    a[g.integers(0, 16, 9), g.integers(0, 8, 9), 2] = g.integers(1, 99, 9)
    rows = [(*map(int, p), int(a[tuple(p)])) for p in np.argwhere(a)]
    got = resample.resample_tiles(spark.createDataFrame(rows, "x long, y long, z long, v long"), 2, "bicubic", tile=4).collect()
    want = np.concatenate([resample.zoom(a[i : i + 8], (2, 2, 2), 2) for i in (0, 8)])
    want = np.sign(want) * np.floor(np.abs(want) + 0.5 + 1e-9)
    assert {tuple(r)[:3]: r["v"] for r in got} == {tuple(map(int, p)): want[tuple(p)] for p in np.argwhere(want)}


def test_a_chunk_of_few_voxels_is_packed_as_those(spark):
    vox = spark.createDataFrame([(64, 1, 2, 9), (127, 63, 7, -4)], "x long, y long, z long, v long")
    (row,) = region.to_chunks(vox, (64, 64, 8)).collect()
    assert len(row["data"]) == 1 + 2 * 16
    a = region.unpack_chunk(row["shape"], bytes(row["data"]))
    assert a.shape == (64, 64, 8) and a[0, 1, 2] == 9 and a[63, 63, 7] == -4 and (a != 0).sum() == 2
    full = np.arange(1, 65).reshape(4, 4, 4)
    flat = full.ravel(order="F")
    data = region.pack_voxels(full.shape, np.arange(64), flat)
    assert data[:1] == b"i" and (region.unpack_chunk(full.shape, data) == full).all() and (region.unpack_voxels(data)[1] == flat).all()


def test_nml_files_are_written_from_columns(spark):
    n = 20000
    node = [(i, float(i), 0.5, 2.0, "a<b" if i == 7 else None) for i in range(n, 0, -1)]
    nodes = spark.createDataFrame([("f", 5, *v) for v in node] + [("f", 2, 1, 1.0, 1.0, 1.0, None)], "file string, tree long, id long, x double, y double, z double, comment string")
    edges = spark.createDataFrame([("f", 5, 2, 3), ("f", 5, 1, 2)], "file string, tree long, source long, target long")
    (row,) = nml.assemble(nodes, edges)._collect_as_arrow()
    tracemalloc.start()
    text = nml.serialise(row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 800 * n  # as dicts the nodes alone take more than that
    assert text.index('<thing id="2"') < text.index('<thing id="5"') and text.index('<node id="2"') < text.index('<node id="3"')
    assert '<comment node="7" content="a&lt;b" />' in text and text.index('source="1"') < text.index('source="2"')


def test_files_hold_what_is_stored(spark, tmp_path):
    root = f"file://{tmp_path}"
    vox = spark.createDataFrame([(300001, 40003, 2, 9), (5, 130, 2, 7)], "x long, y long, z long, v long")
    want = sorted(map(tuple, vox.collect()))
    size = lambda p: sum(f.stat().st_blocks * 512 for f in (tmp_path / p).rglob("*.*") if f.is_file())
    arrays.write_wkw(vox, f"{root}/w", "uint8", 32, 4)
    assert sorted(map(tuple, arrays.read_array(spark, f"{root}/w").collect())) == want and size("w") < 100_000
    volumes.write_cubes(vox, f"{root}/c")
    assert sorted(map(tuple, volumes.read_cubes(spark, f"{root}/c").collect())) == want and size("c") < 300_000
    assert {f.stat().st_size for f in (tmp_path / "c").rglob("*.raw")} == {128**3}
    volumes.write_tiff_slices(vox, f"{root}/t", (300002, 40004))
    assert sorted(map(tuple, volumes.read_tiff_stack(spark, f"{root}/t").collect())) == [(5, 130, 0, 7), (300001, 40003, 0, 9)] and size("t") < 1_000_000


def test_arrays_end_where_their_voxels_do_and_many_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    monkeypatch.setattr(files, "LISTED", 1)
    vox = spark.createDataFrame([(64 * i, i, i % 3, i + 1) for i in range(40)], "x long, y long, z long, v long")
    want = sorted(map(tuple, vox.collect()))
    arrays.write_zarr3(vox, f"{root}/z", None, "uint16", (8, 8, 8), (16, 16, 8))
    arrays.write_zarr2(vox, f"{root}/y", None, "<u2", (16, 16, 8))
    for name in "zy":
        got = arrays.read_array(spark, f"{root}/{name}")
        assert sorted(map(tuple, got.collect())) == want and tuple(arrays.array_box(f"{root}/{name}").high) == (2497, 40, 3)
    assert arrays.read_array(spark, f"{root}/z").inputFiles() == []


def test_parts_of_chunks_take_few_bytes():
    g = np.random.default_rng(5)
    at = np.sort(g.choice(128 * 128 * 8, 480, replace=False))
    for v in (g.integers(1, 51, 480), g.integers(-9, 9, 480), g.integers(-(1 << 62), 1 << 62, 480), g.integers(0, 99, 480) / 8, g.random(480)):
        data = region.pack_part(at, v)
        got_at, got = region.unpack_part(data)
        assert (got_at == at).all() and (got == v).all() and got.dtype == v.dtype
    assert len(region.pack_part(at, g.integers(1, 51, 480))) <= 1 + 3 * 480
    far = np.array([0, (1 << 62) + 5])
    assert (region.unpack_part(region.pack_part(far, np.array([(1 << 63) - 1, -(1 << 63)])))[0] == far).all()


def test_voxels_are_packed_by_chunk_before_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(region, "PACK_ROWS", 700)
    g = np.random.default_rng(6)
    rows = [(*p, v) for p, v in zip(g.integers(-40, 40, (3000, 3)).tolist(), g.integers(-3, 9, 3000).tolist(), strict=True)]
    vox = spark.createDataFrame(rows, "x long, y long, z long, v long").repartition(3)
    parts = region.by_chunk(vox, (16, 16, 16), merge="max")
    assert parts.columns == ["cx", "cy", "cz", "part"] and _plan(parts).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    want = {}
    for *p, v in rows:
        want[tuple(p)] = max(v, want.get(tuple(p), v))
    got = region.merged(vox, (16, 16, 16)).collect()
    assert len(got) == len({tuple(r)[:3] for r in got}) and {tuple(r)[:3]: r["v"] for r in got} == {p: v for p, v in want.items() if v}
    once = region.from_chunks(region.to_chunks(spark.createDataFrame([(*p, v) for p, v in want.items()], vox.schema), (16, 16, 16))).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, got))


def test_writers_keep_the_greatest_of_each_place(spark, tmp_path):
    root = f"file://{tmp_path}"
    lines = spark.createDataFrame([(5, 130, 2, 7), (5, 130, 2, 9), (5, 130, 2, None), (300, 4, 2, 0), (300, 4, 2, 3), (6, 6, 6, 0)], "x long, y long, z long, v long").repartition(4)
    arrays.write_zarr3(lines, f"{root}/z", None, "uint16", (8, 8, 8), (16, 16, 8), merge="max")
    arrays.write_zarr3(lines, f"{root}/f", None, "uint16", (8, 8, 8), (16, 16, 8), merge="max", separator=".")
    arrays.write_wkw(lines, f"{root}/w", "uint8", 8, 2, merge="max")
    volumes.write_cubes(lines, f"{root}/c", merge="max")
    for got in (*(arrays.read_array(spark, f"{root}/{k}") for k in "zfw"), volumes.read_cubes(spark, f"{root}/c")):
        assert sorted(map(tuple, got.collect())) == [(5, 130, 2, 9), (300, 4, 2, 3)]
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["c.0.8.0", "c.18.0.0", "zarr.json"]
    with pytest.raises(ValueError, match="merge"):
        arrays.write_wkw(lines, f"{root}/x", merge="least")


@pytest.mark.parametrize("name", ["cube_roundtrip", "read_bbox_zarr3", "wkw_roundtrip", "float_roundtrip", "nd_read", "channel_roundtrip", "zarr3_roundtrip"])
def test_round_trips_shuffle_packed_chunks_only(spark, data, monkeypatch, name):
    plans, by_chunk = [], region.by_chunk

    def seen(*a, **b):
        plans.append(_plan(found := by_chunk(*a, **b)).split("== Physical Plan ==")[1])
        return found

    monkeypatch.setattr(region, "by_chunk", seen)
    queries.QUERIES[name](spark, data)
    assert plans
    for p in plans:  # rows of voxels are no longer dealt for an aggregate
        assert "Aggregate" not in p and p.count("Exchange hashpartitioning(cx") == p.count("Exchange ")


def test_nd_read_makes_no_folder_for_a_shard(spark, data, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    assert queries.QUERIES["nd_read"](spark, data).count()
    assert not [p for p in (tmp_path / "nd").iterdir() if p.is_dir()]
