import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeflow.llm import queries, simhash
from latticeflow.llm.common import table
from latticeflow.llm.components import components


def by_hand(texts):
    """Fingerprints and components the plain way."""
    import re

    import xxhash

    fps = []
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return fps, groups(fps, 4)


def groups(fps, radius):
    least = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= radius and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_query_matches_brute_force(spark, data):
    docs = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    ids = sorted(docs)
    fps, least = by_hand([docs[i] for i in ids])
    got = {r["doc_id"]: r for r in queries.op4_simhash_near_dedup(spark, data).collect()}
    assert {i: (got[i]["fingerprint"], got[i]["component_id"]) for i in ids} == {
        i: (f"{f:016x}", ids[m]) for i, f, m in zip(ids, fps, least, strict=True)
    }


def test_odd_rows(spark):
    long = "tok " * 200_000 + "end"
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "One two", None), (5, "one TWO", "d"), (5, "one TWO", "d"), (None, "one two", "e"), (7, long, "f"), (8, "É é", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    found = {(r["id"], r["fp"], r["component"]) for r in got}
    assert {(r[0], r[2]) for r in found if r[1] == 0} == {(1, 1), (2, 1), (3, 1)}
    same = {r for r in found if r[0] in (4, 5, None)}
    assert {r[2] for r in same} == {4} and len({r[1] for r in same}) == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or -1 for r in simhash.keep_one(docs).collect()) == [-1, 1, 4, 7, 8]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.sets(st.integers(0, 63), max_size=6)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_spanning_connects_what_all_links_connect(centres, edits):
    fps = {*centres}
    for k, bits in edits:
        fps.add(centres[k % len(centres)] ^ sum(1 << b for b in bits))
    fps = sorted(fps)
    want = groups(fps, 4)
    least = list(range(len(fps)))
    pairs = simhash.spanning(np.array(fps, np.uint64), 4)
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in pairs)
    for _ in fps:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert least == want


@pytest.mark.parametrize("m", [5, 6, 7])
@pytest.mark.parametrize("cap", [64, 10_000])
def test_links_in_hot_buckets(spark, m, cap):
    g = np.random.default_rng(m)
    centre = int(g.integers(0, 2**62))
    fps = {centre} | {centre ^ int(sum(1 << int(b) for b in g.choice(64, 3, replace=False))) for _ in range(300)} | {int(x) for x in g.integers(0, 2**62, 100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f if f < 2**63 else f - 2**64,) for f in fps], "fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(df, 4, cap, m), "u", "v").collect()}
    want = groups([f % 2**64 for f in fps], 4)
    signed = [f if f < 2**63 else f - 2**64 for f in fps]
    for i, w in enumerate(want):
        mates = [signed[j] for j in range(len(fps)) if want[j] == w]
        assert got.get(signed[i], signed[i]) == min(mates)


def test_every_close_pair_shares_a_block():
    for m in (5, 6, 8):
        masks = simhash.block_masks(m, 4)
        g = np.random.default_rng(0)
        for _ in range(300):
            flips = sum(1 << int(b) for b in g.choice(64, 4, replace=False))
            assert any(not mask & flips for mask in masks)


def edited(words, share, g):
    return " ".join(f"new{g.integers(10**9)}" if g.random() < share else w for w in words)


def test_similar_documents_match_brute_force(spark):
    g = np.random.default_rng(7)
    rows = []
    for k in range(25):
        words = [f"w{g.integers(5000)}" for _ in range(int(g.integers(40, 400)))]
        rows += [edited(words, s, g) for s in (0, 0, 0.003, 0.01, 0.02, 0.04, 0.08, 0.3)]
    hot = [f"h{i}" for i in range(300)]
    rows += [edited(hot, 0.004, g) for _ in range(150)]
    rows += ["", None, "one two", "ONE  two", "one two three", "a b c d e f"]
    docs = spark.createDataFrame([(i * 2, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, component string")
    got = {r["id"] // 2: r["component"] // 2 for r in simhash.similar_documents(docs, radius=None).collect()}
    sets = [set(simhash._shingle_hashes(simhash._words(t), 5).tolist()) for t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if (not sets[a] and not sets[b]) or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    assert sum(got[a] == got[b] for a, b in alike) >= 0.98 * len(alike)
    least = list(range(len(rows)))
    for _ in rows:
        for a, b in alike:
            least[a] = least[b] = min(least[a], least[b])
    assert all(least[got[i]] == least[i] for i in range(len(rows)))  # nothing is joined that shouldn't be
    both = {r["id"] // 2: r["component"] // 2 for r in simhash.similar_documents(docs).collect()}
    plain = {r["id"] // 2: r["component"] // 2 for r in simhash.near_duplicates(docs).collect()}
    assert all(both[i] == both[plain[i]] and both[i] == both[got[i]] for i in both)


def test_similar_documents_odd_rows(spark):
    long = "tok " * 100_000
    rows = [(1, None), (2, ""), (4, "One two"), (5, "one TWO"), (5, "other words"), (None, "one two"), (7, long), (8, long + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r["id"], r["component"])) for r in simhash.similar_documents(docs).collect())
    assert got == sorted(map(str, [(1, 1), (2, 1), (4, 4), (5, 4), (5, 5), (None, 4), (7, 7), (8, 7)]))
    assert simhash.similar_documents(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or -1 for r in simhash.keep_one(docs, similarity=0.8).collect()) == [-1, 1, 4, 5, 7]


def test_repeated_ids_lose_neither_links_nor_texts(spark):
    g = np.random.default_rng(20)
    a, b = (" ".join(f"{x}{g.integers(10**6)}" for _ in range(120)) for x in "ab")
    rows = [(1, a, "x"), (2, a + " end", "x"), (2, b, "x"), (3, b + " two more", "x"), (4, b, "y"), (4, b, "z"), (5, a[::-1], "x"), (5, a[::-1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = simhash.similar_rows(docs).collect()
    key = {r["key"]: t for r, (_, t) in zip(docs.select(simhash.text_key(docs["text"]).alias("key"), "text").collect(), [(r[0], r[1]) for r in rows], strict=True)}
    assert sorted((r["id"], key[r["key"]], r["component"]) for r in got) == sorted((i, t, 2 if t.startswith(b) else min(i, 1) if t.startswith(a) else i) for i, t, _ in rows)
    for similarity in (None, 0.8):
        kept = simhash.keep_one(docs, similarity=similarity)
        assert kept.columns == docs.columns
        assert {r["text"] for r in kept.collect()} >= {a, b, a[::-1]}
        assert sum(r["text"] == a[::-1] for r in kept.collect()) == 1  # rows that repeat id and text are one
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs, similarity=0.8).collect()) == sorted([(1, a), (2, b), (5, a[::-1])])


def test_equal_wide_fingerprints_are_verified(spark, monkeypatch):
    monkeypatch.setattr(simhash, "wide_simhash", lambda hashes: bytes(simhash.WIDE // 8))
    g = np.random.default_rng(21)
    texts = [" ".join(f"w{g.integers(10**6)}" for _ in range(150)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[2] + " and"])), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_documents(docs, radius=None).collect()}
    assert got == {**{i: i for i in range(6)}, 6: 2}


@given(st.lists(st.sets(st.integers(0, 30), max_size=12), min_size=2, max_size=25), st.sampled_from([0.5, 0.8]))
@settings(max_examples=100, deadline=None)
def test_connect_similar_is_exact(sets, similarity):
    pairs = simhash.connect_similar([np.array(sorted(s), np.uint64) for s in sets], similarity)
    alike = lambda a, b: (not a and not b) or (bool(a and b) and len(a & b) >= similarity * len(a | b))
    assert all(alike(sets[x], sets[y]) for x, y in pairs)
    want, got = list(range(len(sets))), list(range(len(sets)))
    every = [(x, y) for x in range(len(sets)) for y in range(x) if alike(sets[x], sets[y])]
    for _ in sets:
        for least, links in ((want, every), (got, pairs)):
            for x, y in links:
                least[x] = least[y] = min(least[x], least[y])
    assert got == want


def test_large_candidate_groups_are_compared_in_chunks(spark, monkeypatch):
    g = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, edited(base, g.choice([0.005, 0.02, 0.05]), g)) for i in range(120)], "doc_id long, text string")
    whole = sorted(map(tuple, simhash.similar_documents(docs, radius=None).collect()))
    monkeypatch.setattr(simhash, "GROUP", 20)
    assert sorted(map(tuple, simhash.similar_documents(docs, radius=None).collect())) == whole


def test_repeated_passages_are_no_difference(spark):
    g = np.random.default_rng(11)
    rows = []
    for k in range(30):
        base, passage = ([f"{x}{g.integers(10**6)}" for _ in range(n)] for x, n in (("w", 300), ("p", 30)))
        rows += [" ".join(base), " ".join(base + passage * (3, 5, 20)[k % 3])]
    sets = [set(simhash._shingle_hashes(simhash._words(t), 5).tolist()) for t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_documents(docs, radius=None).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}


def test_short_texts_are_compared_exactly(spark, monkeypatch):
    g = np.random.default_rng(12)
    rows = []
    for n in (8, 8, 8, 9, 12, 13, 20, 40, 60) * 12:
        words = [f"w{g.integers(10**6)}" for _ in range(n)]
        rows += [" ".join(words), " ".join(words + ["end"] * max(1, (n - 4) // 8))]
    sets = [set(simhash._shingle_hashes(simhash._words(t), 5).tolist()) for t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for size in (simhash.GROUP, 2):
        monkeypatch.setattr(simhash, "GROUP", size)
        got = {r["id"]: r["component"] for r in simhash.similar_documents(docs, radius=None).collect()}
        assert got == {i: i - i % 2 for i in range(len(rows))}


@given(st.sets(st.integers(0, 40), max_size=25), st.sets(st.integers(0, 40), max_size=25), st.sampled_from([0.5, 0.8, 0.9]))
@settings(max_examples=300, deadline=None)
def test_similar_sets_share_a_prefix(a, b, similarity):
    if a and b and len(a & b) >= similarity * len(a | b):
        x, y = (simhash.prefix_of(np.array(sorted(s)), similarity).tolist() for s in (a, b))
        assert {*x} & {*y}
