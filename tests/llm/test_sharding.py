import zlib
from collections import Counter, defaultdict

from latticeflow.llm import queries, sharding
from latticeflow.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, size long"


def check(got, docs, shards):
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in docs)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    return total


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    got = queries.op7_kd_sharding(spark, data).withColumnRenamed("doc_id", "id").collect()
    total = check(got, docs, 8)
    assert len(total) == 8 and max(total.values()) / min(total.values()) < 1.02
    again = queries.op7_kd_sharding(spark, data).withColumnRenamed("doc_id", "id").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sizes_are_near_equal_and_copies_stay_together(spark):
    rows = [(i, f"text {i % 900} " + "w" * (i % 900 % 97), f"l{i % 4}", f"s{i % 7 if i % 3 else 0}", 0) for i in range(3000)]
    rows += [(10_000 + i, "hot copy " * 20, "en", "s0", 0) for i in range(1500)]
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 6).collect()
    total = check(got, rows, 6)
    assert max(total.values()) / min(total.values()) < 1.03
    text = {r[0]: r[1] for r in rows}
    places = defaultdict(set)
    for r in got:
        places[text[r["id"]]].add(r["shard"])
    assert all(len(p) == 1 for t, p in places.items() if not t.startswith("hot")) and len(places["hot copy " * 20]) > 1


def test_medians_match_a_plain_kd_tree(spark):
    """Against the same recursion over a sorted list."""
    rows = [(h, 1 + h * 7919 % 50, h * 31 % 17, h % 4 * 10**9, h * h % 5 * 10**9) for h in range(1, 400)]
    points = spark.createDataFrame(rows, "h long, weight long, size long, lang long, source long")
    got = {r["h"]: r["shard"] for r in sharding.split_points(points, 5).collect()}
    whole = [max(1, max(r[k] for r in rows) - min(r[k] for r in rows)) for k in (2, 3, 4)]
    want = {}

    def split(part, first, shards):
        if shards == 1:
            want.update((r[0], first) for r in part)
            return
        half = (shards + 1) // 2
        extent = [(max(r[k] for r in part) - min(r[k] for r in part)) / w for k, w in zip((2, 3, 4), whole, strict=True)]
        dim = 2 + extent.index(max(extent))
        part = sorted(part, key=lambda r: (r[dim], r[0]))
        target, below = sum(r[1] for r in part) * half / shards, 0
        for k, r in enumerate(part):
            if below + r[1] >= target:
                break
            below += r[1]
        short, over = int(target - below), int(below + r[1] - target)
        room, moved = short, []
        for q in sorted(part[k + 1 : k + 65], key=lambda r: (-r[1], r[0])):
            if q[1] <= room:
                room -= q[1]
                moved.append(q)
        if min(short, over) > 0.001 * sum(r[1] for r in part) / shards and room < min(short, over):
            left = part[:k] + moved
        else:
            left = part[: k + (below + r[1] - target <= target - below)]
        split(left, first, half)
        split([r for r in part if r not in left], first + half, shards - half)

    split(rows, 0, 5)
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "x", "en", None, 0), (4, "é" * 200_000, "fr", "b", 0), (5, "x", "en", "c", 0), (5, "x", "en", "c", 0)]
    check(sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 8).collect(), rows, 8)
    same = [(1, "t", "en", "a", 0)] * 20
    check(sharding.kd_shards(spark.createDataFrame(same, SCHEMA), 4).collect(), same, 4)
    assert sharding.kd_shards(spark.createDataFrame([], SCHEMA), 8).count() == 0
    got = sharding.kd_shards(spark.createDataFrame(rows[1:3], SCHEMA), target_bytes=2).collect()
    assert len({r["shard"] for r in got}) == 2


def test_written_shards(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    placed = sharding.kd_shards(docs, 4)
    sharding.write_shards(docs, placed, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4
