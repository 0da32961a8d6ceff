import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow import cli
from latticeflow.api import Dataset
from latticeflow.functions.geometry import Box, mag_name
from latticeflow.operators import graph
from latticeflow.sources import agglomerate, arrays, codecs, columns, datasource, images, metadata, nml, volumes
from latticeflow.sources.files import put
from latticeflow.streaming import slices
from tests.test_operators import array, table

SHAPE = (40, 33, 20)


@pytest.fixture(scope="module")
def cube():
    g = np.random.default_rng(1)
    return g.integers(1, 250, SHAPE) * (g.random(SHAPE) < 0.05)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


@pytest.mark.parametrize("shard,packed", [((16, 16, 16), True), ((8, 8, 8), True), ((16, 16, 16), False)])
def test_zarr3(spark, cube, root, shard, packed):
    arrays.write_zarr3(table(spark, cube), f"{root}/a", SHAPE, "uint16", (8, 8, 8), shard, packed)
    assert arrays.detect(f"{root}/a") == "zarr3"
    assert (array(arrays.read_array(spark, f"{root}/a"), SHAPE) == cube).all()


def test_zarr2(spark, cube, root):
    arrays.write_zarr2(table(spark, cube), f"{root}/a", SHAPE, "<u2", (16, 16, 8))
    assert (array(arrays.read_array(spark, f"{root}/a"), SHAPE) == cube).all()


@pytest.mark.parametrize("packed", [True, False])
def test_wkw(spark, cube, root, packed):
    arrays.write_wkw(table(spark, cube), f"{root}/a", "uint16", 8, 2, packed)
    assert (array(arrays.read_array(spark, f"{root}/a"), SHAPE) == cube).all()
    boxes = {tuple(r)[:3] for r in arrays.wkw_boxes(spark, f"{root}/a").collect()}
    assert boxes == {tuple(16 * (p // 16)) for p in np.argwhere(cube)}


def test_n5_and_precomputed(spark, cube, root):
    put(f"{root}/n/attributes.json", json.dumps({"dimensions": SHAPE, "blockSize": [32, 32, 32], "dataType": "uint32", "compression": {"type": "gzip"}}).encode())
    put(f"{root}/p/info", json.dumps({"data_type": "uint16", "num_channels": 1, "scales": [{"key": "1", "encoding": "raw", "size": SHAPE}]}).encode())
    for i in np.ndindex(2, 2, 1):
        low = np.array(i) * 32
        part = cube[tuple(slice(a, a + 32) for a in low)]
        body = codecs.compress("gzip", part.astype(">u4").tobytes(order="F"))
        put(f"{root}/n/{i[0]}/{i[1]}/{i[2]}", struct.pack(">HH3I", 0, 3, *part.shape) + body)
        name = "_".join(f"{a}-{a + s}" for a, s in zip(low, part.shape, strict=True))
        put(f"{root}/p/1/{name}", part.astype("<u2").tobytes(order="F"))
    assert (array(arrays.read_n5(spark, f"{root}/n"), SHAPE) == cube).all()
    assert (array(arrays.read_precomputed(spark, f"{root}/p"), SHAPE) == cube).all()


def test_lz4_back_references():
    block = bytes([0x52]) + b"abcde" + bytes([5, 0]) + bytes([0x10]) + b"!"
    assert codecs.lz4_block(block) == b"abcdeabcdea!"
    data = bytes(range(256)) * 5
    assert codecs.lz4_block(codecs.lz4_literals(data), len(data)) == data
    with pytest.raises(ValueError):
        codecs.lz4_block(bytes([0x10]) + b"a" + bytes([9, 0]))


def test_crc32c():
    assert codecs.crc32c(b"123456789") == struct.pack("<I", 0xE3069283)


def test_raw(spark, cube, root, tmp_path):
    (tmp_path / "a.raw").write_bytes(cube.astype("<u2").tobytes(order="F"))
    got = volumes.read_raw(spark, f"{root}/a.raw", SHAPE, "<u2", slab_bytes=5000)
    assert (array(got, SHAPE) == cube).all()
    flipped = volumes.read_raw(spark, f"{root}/a.raw", SHAPE, "<u2", flip="y")
    assert (array(flipped, SHAPE) == cube[:, ::-1]).all()


def test_cubes(spark, root):
    a = np.zeros((130, 5, 5), np.int64)
    a[0, 1, 2], a[129, 4, 4] = 5, 9
    assert volumes.write_cubes(table(spark, a), f"{root}/c") == 2
    assert (array(volumes.read_cubes(spark, f"{root}/c"), a.shape) == a).all()
    assert {tuple(r)[:3] for r in volumes.cube_list(spark, f"{root}/c").collect()} == {(0, 0, 0), (1, 0, 0)}


def test_tiff(spark, cube, root):
    a = cube[:, :, :12]
    a[0, 0, :] = 1
    volumes.write_tiff_slices(table(spark, a), f"{root}/t", SHAPE[:2], "uint16")
    assert (array(volumes.read_tiff_stack(spark, f"{root}/t"), a.shape) == a).all()


def test_mrc(spark, cube, root):
    head = struct.pack("<4i", *SHAPE, 6).ljust(1024, b"\0")
    put(f"{root}/m/a.mrc", head + cube.transpose(2, 1, 0).astype("<u2").tobytes())
    assert (array(volumes.read_mrc(spark, f"{root}/m"), SHAPE) == cube).all()


def test_data_source(spark, cube, root):
    arrays.write_wkw(table(spark, cube), f"{root}/a", "uint16", 8, 2)
    datasource.register(spark)
    df = spark.read.format("voxels").option("box", json.dumps([[4, 4, 4], [20, 20, 10]])).load(f"{root}/a")
    want = np.zeros_like(cube)
    want[4:20, 4:20, 4:10] = cube[4:20, 4:20, 4:10]
    assert (array(df, SHAPE) == want).all()


NML = b"""<things><meta name="user" content="a &amp; b" /><parameters><scale x="4.0" y="4.0" z="35.0" /></parameters>
<thing id="2" color.r="0.5" color.g="0.25" color.b="1.0" color.a="1.0" name="two" groupId="2"><nodes>
<node id="5" radius="1.0" x="1" y="2" z="3" inVp="0" inMag="1" bitDepth="8" interpolation="true" time="7" />
<node id="6" radius="1.5" x="4" y="5" z="6" /></nodes><edges><edge source="5" target="6" /></edges></thing>
<branchpoints><branchpoint id="6" time="11" /></branchpoints><comments><comment node="5" content="here" /></comments>
<groups><group id="1" name="up"><group id="2" name="down" /></group></groups>
<volume id="0" name="v" largestSegmentId="9"><segments><segment id="9" name="s" anchorPositionX="1" anchorPositionY="2" anchorPositionZ="3" /></segments></volume></things>"""


def test_nml_round_trip(spark, root):
    put(f"{root}/in/a.nml", NML)
    first = nml.read(spark, f"{root}/in")
    t = nml.tables(first)
    nodes = {r["id"]: r for r in t["nodes"].collect()}
    assert nodes[5]["comment"] == "here" and nodes[6]["branchpoint_time"] == 11 and not nodes[5]["is_branchpoint"]
    assert [(r["id"], r["parent"]) for r in t["groups"].orderBy("id").collect()] == [(1, None), (2, 1)]
    assert nml.write(first, f"{root}/out") == 1
    same = lambda df: df.drop("file").first().asDict(recursive=True)
    assert same(nml.read(spark, f"{root}/out")) == same(first)


def test_dataset(spark, cube, root, tmp_path):
    ds = Dataset(spark, f"{root}/ds", (10.5, 10.5, 24))
    layer = ds.write_layer("seg", "segmentation", table(spark, cube), Box.of(0, SHAPE), dtype="uint16")
    assert layer.largest_segment_id == cube.max()
    made = layer.downsample(8)
    assert [mag_name(m.mag) for m in made] == ["2-2-1", "4-4-2", "8-8-4"]
    again = Dataset.open(spark, f"{root}/ds")
    assert again.is_equal(ds) and again.layers["seg"].largest_segment_id == cube.max()
    copy = ds.copy(f"{root}/copy", "zarr3", (8, 8, 8), (16, 16, 16))
    assert copy.is_equal(ds)
    layer.mags["1"].write(table(spark, cube).limit(0), Box.of(0, (8, 8, 8)))
    assert not copy.is_equal(Dataset.open(spark, f"{root}/ds"))
    layer.redownsample()
    layer.upsample("8-8-4", 4)
    layers, mags = metadata.catalogue(spark, [f"{root}/ds"])
    assert layers.count() == 1 and mags.count() == len(layer.mags)
    body = json.loads(metadata.ome(mags, ds.voxel_size, "0.4").first()["json"])
    assert body["multiscales"][0]["datasets"][0]["coordinateTransformations"][0]["scale"] == [1.0, 10.5, 10.5, 24.0]
    view = layer.mags["1"].view((8, 8, 8), (8, 8, 8))
    assert view.read().where(~Box.of(8, 8).contains(__import__("latticeflow.functions.geometry", fromlist=["Vec"]).Vec.columns())).count() == 0
    with pytest.raises(ValueError):
        ds.add_layer("seg", "color", Box.of(0, 1))


def test_command_line(spark, cube, root, tmp_path):
    (tmp_path / "a.raw").write_bytes(cube.astype("uint8").tobytes(order="F"))
    shape = ",".join(map(str, SHAPE))
    assert cli.run(spark, ["convert-raw", f"{root}/a.raw", f"{root}/one", "--shape", shape]) == 0
    assert cli.run(spark, ["copy-dataset", f"{root}/one", f"{root}/two", "--data-format", "wkw", "--chunk-shape", "8,8,8", "--shard-shape", "16,16,16"]) == 0
    assert cli.run(spark, ["check-equality", f"{root}/one", f"{root}/two"]) == 0
    assert cli.run(spark, ["downsample", f"{root}/two", "--coarsest-mag", "2"]) == 0
    assert cli.run(spark, ["check-equality", f"{root}/one", f"{root}/two"]) == 1
    assert cli.run(spark, ["compress", f"{root}/one"]) == 0
    assert cli.run(spark, ["export-as-tiff", f"{root}/one", f"{root}/tiff"]) == 0
    got = volumes.read_tiff_stack(spark, f"{root}/tiff")
    assert got.agg(F.sum("v")).first()[0] == cube.sum()


def test_slice_stream(spark, cube, root):
    rows = table(spark, cube)
    for z in range(SHAPE[2]):
        rows.where(F.col("z") == z).coalesce(1).write.mode("append").parquet(f"{root}/in")
    slices.ingest(spark, f"{root}/in", f"{root}/out", f"{root}/check", 7).awaitTermination()
    assert (array(spark.read.parquet(f"{root}/out").select("x", "y", "z", "v"), SHAPE) == cube).all()


def test_floats_come_back_whole(spark, root):
    rows = [(0, 0, 0, 1.75), (5, 3, 2, 0.4000000059604645), (39, 32, 19, -2.5)]
    v = spark.createDataFrame(rows, "x long, y long, z long, v double")
    arrays.write_zarr3(v, f"{root}/z3", SHAPE, "float32", (8, 8, 8), (16, 16, 16))
    arrays.write_zarr2(v, f"{root}/z2", SHAPE, "<f4", (16, 16, 8))
    arrays.write_wkw(v, f"{root}/w", "float32", 8, 2)
    for name in ("z3", "z2", "w"):
        got = arrays.read_array(spark, f"{root}/{name}")
        assert dict(got.dtypes)["v"] == "double" and sorted(map(tuple, got.collect())) == rows
    ds = Dataset(spark, f"{root}/ds")
    layer = ds.write_layer("raw", "color", v, Box.of(0, SHAPE), dtype="float32", data_format="zarr3")
    assert sorted(map(tuple, layer.mags["1"].read().collect())) == rows
    assert layer.downsample_mag(1, 2, "max").table().where("v = 1.75").count() == 1


def test_raw_floats(spark, root):
    a = np.random.default_rng(2).random((6, 5, 4)).astype("float32")
    put(f"{root}/a.raw", a.tobytes(order="F"))
    got = {tuple(r)[:3]: r["v"] for r in volumes.read_raw(spark, f"{root}/a.raw", a.shape, "float32").collect()}
    assert got == {tuple(map(int, p)): float(a[tuple(p)]) for p in np.argwhere(a)}


def test_channels_and_further_axes(spark, root):
    g = np.random.default_rng(3)
    cells = {(int(t), int(c), *map(int, p)) for t, c, p in zip(g.integers(0, 3, 200), g.integers(0, 2, 200), g.integers(0, 20, (200, 3)), strict=True)}
    rows = sorted((*k, 1 + i) for i, k in enumerate(sorted(cells)))
    v = spark.createDataFrame(rows, "t long, c long, x long, y long, z long, v long")
    arrays.write_zarr3(v, f"{root}/nd", (20, 20, 20), "uint16", (8, 8, 8), (16, 16, 16), extra={"t": 3, "c": 2})
    everything = arrays.read_array(spark, f"{root}/nd", channel=None)
    assert everything.columns == v.columns and sorted(map(tuple, everything.collect())) == rows
    assert sorted(map(tuple, arrays.read_array(spark, f"{root}/nd", channel=1).collect())) == sorted(r[2:] for r in rows if r[:2] == (0, 1))
    two = v.where("t = 0").drop("t")
    arrays.write_wkw(two, f"{root}/w", "uint16", 8, 2, channels=2)
    assert sorted(map(tuple, arrays.read_array(spark, f"{root}/w", channel=None).collect())) == sorted(r[1:] for r in rows if r[0] == 0)
    for form in ("parquet", "zarr3", "wkw"):
        ds = Dataset(spark, f"{root}/{form}")
        layer = ds.write_layer("color", "color", two, Box.of(0, (20, 20, 20)), dtype="uint16", data_format=form, chunk=(8, 8, 8), shard=(16, 16, 16), channels=2)
        layer.downsample_mag(1, 2, "max")
        again = Dataset.open(spark, f"{root}/{form}").layers["color"]
        assert again.channels == 2 and sorted(map(tuple, again.mags["1"].read().collect())) == sorted(r[1:] for r in rows if r[0] == 0)
        assert {r["c"] for r in again.mags["2"].table().collect()} == {0, 1}


@pytest.mark.parametrize("form", ["zarr3", "zarr2", "wkw"])
def test_a_box_reads_only_its_files(spark, cube, root, form):
    ds = Dataset(spark, f"{root}/ds")
    m = ds.write_layer("a", "color", table(spark, cube), Box.of(0, SHAPE), dtype="uint16", data_format=form, chunk=(8, 8, 8), shard=(16, 16, 16)).mags["1"]
    box = Box.of((10, 3, 2), (5, 10, 20))
    want = np.zeros_like(cube)
    want[10:15, 3:13, 2:20] = cube[10:15, 3:13, 2:20]
    assert (array(m.read(Box.of((10, 3, 2), (5, 10, 18))), SHAPE) == want).all()
    files = arrays.read_array(spark, m.path, box=box).inputFiles()
    side = 8 if form == "zarr2" else 16
    spots = {tuple(p // side) for p in np.argwhere(cube) if all(lo // side * side <= v < -(-hi // side) * side for v, lo, hi in zip(p, box.low, box.high, strict=True))}
    assert len(files) == len(spots) < len(arrays.read_array(spark, m.path).inputFiles())
    assert arrays.read_array(spark, m.path, box=Box.of((1000, 0, 0), (5, 5, 5))).count() == 0


def test_boxes_are_those_of_arrays_and_images(spark, root):
    one = spark.createDataFrame([(1, 1, 0, 5)], "x long, y long, z long, v long")
    arrays.write_zarr3(one.limit(0), f"{root}/zeros", (20, 10, 5), "uint8", (8, 8, 8), (8, 8, 8))
    assert cli.run(spark, ["convert-zarr", f"{root}/zeros", f"{root}/ds", "--dtype", "uint8"]) == 0
    assert tuple(Dataset.open(spark, f"{root}/ds").layers["color"].box.high) == (20, 10, 5)
    for z in range(3):
        page = np.zeros((7, 9), "uint8")
        page[1, 1] = z == 0
        put(f"{root}/images/s{z}.tif", volumes.tiff_bytes(page))
    assert volumes.stack_shape(spark, f"{root}/images") == (9, 7, 3)
    assert tuple(Dataset.from_images(spark, f"{root}/images", f"{root}/ds2").layers["color"].box.high) == (9, 7, 3)


def png(page, bits=8, filters=(0,)):
    """A PNG of page (y, x, samples) whose lines take turns with filters."""
    import zlib

    h, w, n = page.shape
    raw = page.astype(">u2" if bits == 16 else "u1").tobytes()
    step, wide = n * bits // 8, w * n * bits // 8
    lines, above = [], bytes(wide)
    for y in range(h):
        line, kind = raw[y * wide : (y + 1) * wide], filters[y % len(filters)]
        out = bytearray()
        for k, v in enumerate(line):
            a, b, c = (line[k - step] if k >= step else 0), above[k], (above[k - step] if k >= step else 0)
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, guess)[kind]) & 255)
        lines.append(bytes([kind]) + bytes(out))
        above = line
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, bits, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


def lzw_bytes(data):
    """TIFF's LZW by the book."""
    out, width = [], 9
    table = {bytes([k]): k for k in range(256)}
    out.append((256, 9))
    n, now = 258, b""
    for v in data:
        more = now + bytes([v])
        if more in table:
            now = more
            continue
        out.append((table[now], width))
        table[more] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            out.append((256, width))
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        now = bytes([v])
    if now:
        out.append((table[now], width))
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    out.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8)


def test_images(spark, root):
    g = np.random.default_rng(4)
    for bits, samples in ((8, 1), (8, 3), (8, 4), (16, 1), (16, 2)):
        page = g.integers(0, 1 << bits, (7, 9, samples))
        assert (images.png_pixels(png(page, bits, (0, 1, 2, 3, 4))) == page).all()
    for data in (b"", b"a", b"abababababab" * 50, bytes(g.integers(0, 256, 9000, dtype=np.uint8)), bytes(20000)):
        assert images.lzw(lzw_bytes(data)) == data
    stack = g.integers(0, 255, (3, 7, 9, 3))
    for z in range(3):
        put(f"{root}/stack/im{z}.PNG", png(stack[z], filters=(4, 2)))
    put(f"{root}/stack/readme.txt", b"no image")
    assert volumes.stack_shape(spark, f"{root}/stack") == (9, 7, 3)
    got = {tuple(r)[:4]: r["v"] for r in volumes.read_tiff_stack(spark, f"{root}/stack", channel=None).collect()}
    assert got == {(c, x, y, z): int(stack[z, y, x, c]) for z, y, x, c in np.argwhere(stack).tolist()}
    assert images.possible_layers(1) == {} and images.possible_layers(2, 3) == {"channel": [0, 1], "timepoint": [0, 1, 2]} and images.possible_layers(3) == {}


def test_columns(spark, root):
    rows = [(i, i * 3) for i in range(0, 5000, 7)]
    df = spark.createDataFrame(rows, "index long, value long")
    written = columns.write_column(df, f"{root}/a", 6000, "uint32", chunk_bytes=400, shard_bytes=4000)
    got = {r["index"]: r["value"] for r in columns.read_column(spark, f"{root}/a").collect()}
    assert got == dict.fromkeys(range(6000), 0) | dict(rows) and written == 5
    wide = spark.createDataFrame([(3, 1.5, 2.5)], "index long, a double, b double")
    columns.write_column(wide, f"{root}/b", 5, "float32", ("a", "b"))
    assert sorted(map(tuple, columns.read_column(spark, f"{root}/b", ("a", "b")).collect()))[3:] == [(3, 1.5, 2.5), (4, 0.0, 0.0)]


def test_agglomerate_attachment(spark, root):
    segments = spark.range(1, 10).withColumnRenamed("id", "segment")
    edges = spark.createDataFrame([(1, 4, 0.5), (4, 9, 0.25), (2, 3, 1.0), (6, 7, 0.75)], "source long, target long, affinity double")
    places = spark.createDataFrame([(4, 40, 41, 42)], "segment long, x int, y int, z int")
    members = graph.agglomerates(segments, edges)
    agglomerate.write_attachment(members, edges, f"{root}/agg", places)
    of, links, where = agglomerate.read_attachment(spark, f"{root}/agg")
    assert {tuple(r) for r in of.collect()} == {tuple(r) for r in members.select("segment", "agglomerate").collect()}
    assert {(*sorted((r["source"], r["target"])), r["affinity"]) for r in links.collect()} == {tuple(r) for r in edges.collect()}
    assert {tuple(r) for r in where.where("x > 0").collect()} == {(4, 40, 41, 42)}
    ds = Dataset(spark, f"{root}/ds")
    layer = ds.add_layer("seg", "segmentation", Box.of(0, (4, 4, 4)))
    layer.add_attachment("agglomerates", "main", f"{root}/agg", copy=True)
    again = Dataset.open(spark, f"{root}/ds").layers["seg"]
    assert agglomerate.read_attachment(spark, again.attachment("agglomerates", "main")["path"])[0].count() == 9
    with pytest.raises(ValueError, match="exists"):
        layer.add_attachment("agglomerates", "main", "elsewhere")
    layer.rename_attachment("agglomerates", "main", "other")
    layer.delete_attachment("agglomerates", "other", files=True)
    put(f"{layer.path}/agglomerates/old.hdf5", b"x")
    put(f"{layer.path}/agglomerates/cumsum.json", b"{}")
    assert [(a["kind"], a["name"]) for a in layer.detect_attachments()] == [("agglomerates", "old"), ("cumsum", "cumsum")]


def test_layers_of_files_that_are_there(spark, cube, root):
    arrays.write_zarr3(table(spark, cube), f"{root}/array", SHAPE, "uint16", (8, 8, 8), (16, 16, 16))
    ds = Dataset(spark, f"{root}/ds")
    layer = ds.add_layer("a", "color", Box.of(0, (1, 1, 1)), dtype="uint16", data_format="zarr3")
    layer.add_mag_from_files(1, f"{root}/array")
    assert tuple(layer.box.high) == SHAPE and (array(layer.mags["1"].table(), SHAPE) == cube).all()
    with pytest.raises(ValueError, match="exists"):
        layer.add_mag_from_files(1, f"{root}/array")
    copy = ds.shallow_copy(f"{root}/shallow")
    assert (array(Dataset.open(spark, f"{root}/shallow").layers["a"].mags["1"].table(), SHAPE) == cube).all()
    assert copy.layers["a"].mags["1"].used_storage() > 0
