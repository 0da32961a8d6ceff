import struct

import numpy as np
import pytest

from latticeflow.functions.geometry import Box
from latticeflow.operators import administration as admin
from latticeflow.operators import execution, graph
from latticeflow.sources import agglomerate, transfer
from latticeflow.sources.files import put


def test_map_and_submit(spark):
    assert list(execution.map_in_order(spark, lambda x: x * x, range(20), batch_size=3)) == [x * x for x in range(20)]
    assert execution.submit(spark, execution.named_partial(pow, 2), 10) == 1024
    assert list(execution.map_in_order(spark, str, [])) == []

    def half(x):
        if x == 3:
            raise ValueError("three")
        return x / 2

    rows = execution.map_to_table(spark, half, range(5), fail_fast=False).orderBy("index").collect()
    assert [r["ok"] for r in rows] == [True, True, True, False, True] and rows[3]["error"] == "ValueError: three"
    with pytest.raises(Exception, match="three"):
        execution.map_to_table(spark, half, range(5)).collect()


def test_retries():
    left = [OSError(), OSError()]

    def flaky():
        if left:
            raise left.pop()
        return "done"

    assert execution.retried(flaky, first_wait=0.001) == "done"
    with pytest.raises(OSError):
        execution.retried(lambda: (_ for _ in ()).throw(OSError()), 2, 0.001)


def test_batches(spark):
    got = execution.batches(spark.range(10), ["id"], 4)
    assert {r["id"]: r["batch"] for r in got.collect()} == {i: i // 4 for i in range(10)}


def varint(v):
    out = bytearray()
    v &= 2**64 - 1
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def part(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def test_agglomerate_message(spark):
    edge = lambda a, b: part(2, b"\x08" + varint(a) + b"\x10" + varint(b))
    data = part(1, b"".join(map(varint, (1, 2, 300)))) + edge(1, 2) + edge(2, 300) + part(3, b"\x08" + varint(-5) + b"\x18\x07") + part(4, struct.pack("<f", 0.5))
    row = agglomerate.decode(spark.createDataFrame([(bytearray(data),)], "content binary")).first()
    assert row["segments"] == [1, 2, 300]
    assert [tuple(e) for e in row["edges"]] == [(1, 2, 0.5), (2, 300, 0.0)]
    assert tuple(row["positions"][0]) == (-5, 0, 7)


def test_flat_arrays(spark):
    segments = spark.createDataFrame([(i,) for i in range(1, 8)], "segment long")
    edges = spark.createDataFrame([(1, 2, 124.0), (2, 3, None), (3, 4, 250.5), (5, 6, 80.0), (1, 7, 65.5)], "source long, target long, affinity double")
    members = graph.agglomerates(segments, edges)
    flat, ends = agglomerate.flat_arrays(members, edges, graph.agglomerate_offsets(members, edges))
    assert [r["segment"] for r in flat.orderBy("index").collect()] == [1, 2, 3, 4, 7, 5, 6]
    rows = ends.orderBy("index").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(0, 1), (0, 4), (1, 2), (2, 3), (0, 1)]
    assert [r["affinity"] for r in rows] == [124.0, 65.5, 0.0, 250.5, 80.0]
    assert all(agglomerate.validate(segments).first()) and not agglomerate.validate(segments.where("segment <> 3")).first()["dense"]


def test_transfer(spark, tmp_path):
    for n in ("a/x.txt", "a/b/y.txt", "a/z.tmp"):
        put(f"file://{tmp_path}/{n}", n.encode())
    assert transfer.copy_tree(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/c", ("*.tmp",)) == 16
    assert (tmp_path / "c/b/y.txt").read_bytes() == b"a/b/y.txt" and not (tmp_path / "c/z.tmp").exists()
    transfer.transfer(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/d", "move")
    assert (tmp_path / "c").is_symlink() and (tmp_path / "d/x.txt").exists()


def test_pages_and_regions(spark):
    source = transfer.paged("numbers", "n int", lambda: 25, lambda limit, page: [(i,) for i in range(page * limit, min(25, page * limit + limit))], size=10)
    assert sorted(r["n"] for r in transfer.load_pages(spark, source).collect()) == list(range(25))
    a = np.arange(6 * 5 * 4, dtype="uint16").reshape(6, 5, 4)
    fetch = lambda low, size: a[tuple(slice(x, x + s) for x, s in zip(low, size, strict=True))].tobytes(order="F")
    got = transfer.RegionService(fetch, "uint16").read(spark, Box.of(0, (6, 5, 4)), 4)
    assert {tuple(r) for r in got.collect()} == {(*p, int(a[p])) for p in np.ndindex(a.shape) if a[p]}


def test_administration(spark):
    users = admin.inserted(admin.empty(spark, "teams"), spark.createDataFrame([("1", "a", "o"), ("2", "b", "o")], admin.SCHEMAS["teams"]))
    with pytest.raises(Exception, match="exists already: 2"):
        admin.inserted(users, spark.createDataFrame([("2", "c", "o")], admin.SCHEMAS["teams"])).collect()
    changed = admin.updated(users, spark.createDataFrame([("2", None)], "id string, organization string"))
    assert sorted(map(tuple, changed.collect())) == [("1", "a", "o"), ("2", "b", None)]
    assert admin.deleted(users, users.where("name = 'a'")).count() == 1
    tasks = spark.createDataFrame([("t", "p", None, None, 1, 2, 3), ("u", "p", None, None, 1, 0, 0)], admin.SCHEMAS["tasks"])
    assert admin.project_progress(tasks).first()[:] == ("p", 2, 2, 3)
    projects = spark.createDataFrame([("p", "Project")], "id string, name string")
    assert admin.resolved(tasks, "project", projects).first()["project_name"] == "Project"
