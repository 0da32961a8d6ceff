from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeflow.llm import packing, queries
from latticeflow.llm.common import table

SCHEMA = "doc_id long, text string, source string, bin string"


def best_fit_by_hand(items, capacity):
    """(bin, offset) in order: every bin is looked at."""
    bins, out = [], []
    for size, source, cluster in items:
        free = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and (not source or source not in b["s"]) and (not cluster or cluster not in b["c"])]
        if free:
            k = min(free)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        b = bins[k]
        out.append((k, capacity - b["room"]))
        b["room"] -= size
        b["s"].add(source)
        b["c"].add(cluster)
    return out


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 4), st.integers(0, 6)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_part_matches_brute_force(items):
    items.sort(key=lambda x: -x[0])
    cols = [np.array(c, np.int64) for c in zip(*items, strict=True)] or [np.empty(0, np.int64)] * 3
    bins, offsets = packing.pack_part(*cols, 30)
    want = best_fit_by_hand(items, 30)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


def verify(got, docs, capacity):
    """Every byte once, no overlap, no conflict."""
    size = defaultdict(list)
    for r in docs:
        size[r[0]].append(len((r[1] or "").encode()) + 1)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["id"]].append(r["size"])
        bins[r["part"], r["bin"]].append(r)
    assert {i: sum(v) for i, v in pieces.items()} == {i: sum(v) for i, v in size.items()}
    about = {r[0]: (r[2], " ".join((r[1] or "").lower().split())) for r in docs}
    for (part, _), rows in bins.items():
        rows.sort(key=lambda r: r["offset"])
        end = 0
        for r in rows:
            assert r["offset"] == end
            end += r["size"]
        assert end <= capacity
        if part >= 0:
            for k in (0, 1):
                said = [about[r["id"]][k] for r in rows if about[r["id"]][k] is not None]
                assert len(said) == len(set(said))


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, data, "documents").collect()]
    got = queries.op8_best_fit_packing(spark, data).withColumnRenamed("doc_id", "id").collect()
    verify(got, docs, packing.CAPACITY)


def test_odd_rows_and_many_parts(spark):
    rows = [(i, f"word{i % 50} " * (i % 40 + 1), f"s{i % 9}" if i % 5 else None, "x") for i in range(500)]
    rows += [(1000, None, "a", ""), (1001, "", "a", ""), (1002, "z" * 999, "b", ""), (1003, "z" * 1000, "b", ""), (1004, "y" * 5000, None, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.best_fit(docs, capacity=1000, part_rows=40).collect()
    verify(got, rows, 1000)
    assert sum(r["id"] == 1003 for r in got) == 2 and sum(r["id"] == 1004 for r in got) == 6
    again = packing.best_fit(docs, capacity=1000, part_rows=40).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.best_fit(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a", "s", ""), (7, "b", "s", ""), (7, "b", "s", "")], SCHEMA)
    assert packing.best_fit(twice).count() == 3


def test_nulls_conflict_with_nothing(spark):
    docs = spark.createDataFrame([(i, f"t{i}", None, "") for i in range(8)], SCHEMA)
    assert packing.best_fit(docs, capacity=100).select("part", "bin").distinct().count() == 1


def test_given_clusters(spark):
    rows = [(i, f"text {i}", f"s{i}", f"c{i % 2}") for i in range(6)]
    got = packing.best_fit(spark.createDataFrame(rows, SCHEMA), capacity=1000, cluster_col="bin")
    assert got.select("bin").distinct().count() == 3


def test_many_clusters_match_brute_force():
    """More clusters than a few words of bits hold: none is taken for another."""
    g = np.random.default_rng(2)
    sizes = np.sort(g.integers(1, 400, 3_000))[::-1]
    sources = g.integers(0, 1_500, 3_000)
    clusters = np.concatenate((np.arange(2_500), g.integers(0, 2_500, 500)))
    bins, offsets = packing.pack_part(sizes, sources, clusters, 1_000)
    want = best_fit_by_hand(list(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)), 1_000)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


def test_long_texts_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(i, "z" * 20_000, "s", "") for i in (1, 1, None, None)], SCHEMA)
    got = packing.best_fit(docs).collect()
    held = defaultdict(int)
    for r in got:
        held[r["part"], r["bin"]] += r["size"]
    assert max(held.values()) <= packing.CAPACITY and sum(held.values()) == 4 * 20_001 and len(got) == 8
