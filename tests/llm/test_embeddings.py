import numpy as np

from latticeflow.llm import embeddings, queries
from latticeflow.llm.common import table

SCHEMA = "vec_id long, label int, embedding array<float>, vec string"


def by_hand(rows, threshold=0.98):
    """(links, least id) of each row: all pairs."""
    ok = [r[1] is not None and r[2] is not None and None not in r[2] and np.isfinite(r[2]).all() and np.any(r[2]) for r in rows]
    unit = [np.array(r[2], float) / np.linalg.norm(np.array(r[2], float)) if o else None for r, o in zip(rows, ok, strict=True)]
    linked = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    least = [r[0] for r in rows]
    for _ in rows:
        for i, js in enumerate(linked):
            for j in js:
                least[i] = least[j] = min(least[i], least[j])
    return {(r[0], len(js), m) for r, js, m in zip(rows, linked, least, strict=True)}


def near(n, seed, dims=16):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, dims))
    out = []
    for i in range(n):
        v = centres[g.integers(12)] + g.normal(size=dims) * g.choice([0.0, 0.02, 0.1, 0.3])
        out.append((i * 3, int(g.integers(3)), [float(np.float32(x)) for x in v * g.choice([1.0, 1.0, 5.0])], "x"))
    return out


def test_links_match_brute_force(spark, monkeypatch):
    rows = near(400, 2)
    for block, leaf in ((512, 64), (32, 8)):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        monkeypatch.setattr(embeddings, "LEAF", leaf)
        got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {tuple(r) for r in got} == by_hand(rows) and len(got) == len(rows)


def test_odd_rows(spark):
    e = [1.0, 0.0]
    rows = [
        (1, 1, e, ""), (2, 1, e, ""), (3, None, e, ""), (4, 1, None, ""), (5, 1, [0.0, 0.0], ""), (6, 1, [float("nan"), 1.0], ""), (7, 1, [None, 1.0], ""),
        (8, 1, [float("inf"), 1.0], ""), (9, 1, [], ""), (10, 1, [1.0, 0.0, 0.0], ""), (11, 2, e, ""), (12, 1, [1e-30, 0.0], ""), (13, 1, [1e30, -0.0], ""), (14, 3, [0.0, 1.0], None),
    ]
    got = {tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 14)} | {(i, 3, 1) for i in (1, 2, 12, 13)}
    assert got == want
    twice = embeddings.near_duplicates(spark.createDataFrame([(1, 1, e, ""), (1, 1, [0.0, 1.0], ""), (None, 1, e, "")], SCHEMA)).collect()
    assert sorted((str(r["id"]), r["n_links"], r["component"]) for r in twice) == [("1", 0, 1), ("1", 1, 1), ("None", 1, 1)]
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, data):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, data, "embeddings").collect()]
    got = queries.op5_embedding_near_dedup(spark, data).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == by_hand(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
