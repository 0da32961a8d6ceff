from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeflow.llm import decontaminate as d
from latticeflow.llm import queries
from latticeflow.llm.common import table


def by_hand(text, items, similarity=0.8):
    """Every window of every item's size."""
    words, found = d.words_of(text), {}
    for item, body in items:
        want = d.words_of(body)
        target = Counter(d.shingles(want))
        for p in range(max(1, len(words) - len(want) + 1)) if want else ():
            sim = d.weighted_similarity(Counter(d.shingles(words[p : p + len(want)])), target)
            if sim >= similarity:
                found[item] = max(sim, found.get(item, 0))
    return found


def test_query_matches_brute_force(spark, data):
    docs = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op9_decontamination(spark, data).collect()}
    shared = {s for _, t in items for s in d.shingles(d.words_of(t))}
    want = {}
    for i, t in docs.items():
        if shared & set(d.shingles(d.words_of(t))):  # brute force over all others would only take time
            want |= {(i, k): s for k, s in by_hand(t, items).items()}
    assert got == want and want


@given(st.lists(st.sampled_from("abcdef"), min_size=0, max_size=60), st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=14), min_size=1, max_size=3))
@settings(max_examples=150, deadline=None)
def test_small_alphabets(words, bodies):
    items = [(k, " ".join(b)) for k, b in enumerate(bodies)]
    text = " ".join(words)
    assert d.Index(items).matches(text) == by_hand(text, items)


def test_edited_passages():
    item = " ".join(f"w{i}" for i in range(60))
    index = d.Index([(1, item)])
    words = item.split()
    around = lambda w: "before it came " + " ".join(w) + " and after"
    assert index.matches(around(words)) == {1: 1.0}
    swapped = [*words[:30], "new", *words[31:]]
    assert index.matches(around(swapped)) == by_hand(around(swapped), [(1, item)]) != {}
    left_out = [*words[:20], *words[21:]]
    assert index.matches(around(left_out)) == by_hand(around(left_out), [(1, item)]) != {}
    assert index.matches(around(words[:30])) == {}
    assert index.matches(item.upper().replace(" ", ",  ")) == {1: 1.0}


def test_odd_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog again"
    docs = spark.createDataFrame(
        [(1, None, 0.0), (2, "", 0.0), (3, item, 0.0), (3, item, 0.0), (None, "x " * 200_000 + item, 0.0), (5, "two words", 0.0), (6, "quick brown", 0.0)],
        "doc_id long, text string, similarity double",
    )
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, " ?", "x"), (4, "two words", "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    for size in (d.INDEX_BYTES, 30):
        monkeypatch.setattr(d, "INDEX_BYTES", size)
        got = {(r["id"], r["item"], r["similarity"]) for r in d.matches(docs, bench).collect()}
        assert got == {(3, 1, 1.0), (None, 1, 1.0), (5, 4, 1.0)}
        kept = d.keep_clean(docs, bench)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6]
    assert d.matches(docs.limit(0), bench).count() == 0
    assert d.matches(docs, bench.limit(0)).count() == 0 and d.keep_clean(docs, bench.limit(0)).count() == 7


def test_moved_passages():
    for size in (40, 50, 59, 120):
        words = [f"w{i}" for i in range(size)]
        item = " ".join(words)
        index = d.Index([(1, item)])
        for cut in (size // 2, size // 3, size - 6):
            text = " ".join(["before", "it", *words[cut:], *words[:cut], "and", "after"])
            assert index.matches(text) == by_hand(text, [(1, item)]) != {}
        thirds = [words[: size // 3], words[size // 3 : 2 * size // 3], words[2 * size // 3 :]]
        text = " ".join(["before", *thirds[2], *thirds[1], *thirds[0], "after"])
        assert index.matches(text) == by_hand(text, [(1, item)])


@given(st.lists(st.sampled_from("ab"), min_size=0, max_size=80), st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=40), min_size=1, max_size=3))
@settings(max_examples=300, deadline=None)
def test_repetitive_texts(words, bodies):
    items = [(k, " ".join(b)) for k, b in enumerate(bodies)]
    text = " ".join(words)
    assert d.Index(items).matches(text) == by_hand(text, items)


def test_documents_shorter_than_items(spark):
    g = np.random.default_rng(3)
    items = [(f"item {k}", [f"w{g.integers(10**6)}" for _ in range(60)]) for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(w[:50])) for k, (_, w) in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    got = {(r["id"], r["item"]): r["similarity"] for r in d.matches(docs, bench).collect()}
    assert got == {(k, f"item {k}"): 46 / 56 for k in range(400)}
    assert d.keep_clean(docs, bench).count() == 0


def test_shorter_documents_against_brute_force():
    g = np.random.default_rng(4)
    for size in (9, 10, 14, 20, 40, 59):
        items = [(k, " ".join(f"w{g.integers(10**6)}" for _ in range(size))) for k in range(40)]
        index = d.Index(items)
        for k, (_, text) in enumerate(items):
            cut = " ".join(text.split()[: int(g.integers(size * 3 // 4, size + 1))])
            assert index.matches(cut) == by_hand(cut, [items[k]])


def test_blocks_select_and_lose_nothing():
    g = np.random.default_rng(5)
    prints = g.integers(0, 256, (2_000, d.BITS // 8), dtype=np.uint8)
    blocks = d.Blocks(prints)
    assert len(blocks.candidates(prints[:50])[0]) < 0.05 * 50 * len(prints)
    row, item = blocks.within(prints[:50])
    assert row.tolist() == item.tolist() == list(range(50))
    for k in range(200):  # as far as the radius allows
        bits = np.unpackbits(prints[k])
        bits[g.choice(d.BITS, d.RADIUS, replace=False)] ^= 1
        assert k in blocks.within(np.packbits(bits)[None])[1]


def test_recall_of_the_radius_at_the_threshold():
    """Windows right at a similarity of 0.8, items from the shortest to long ones."""
    g = np.random.default_rng(6)
    for n in (9, 18, 34, 90):
        far = []
        for _ in range(400):
            both = g.integers(0, 2**63, n + n // 9, dtype=np.uint64)
            a, b = d.fingerprint(both[:n]), d.fingerprint(both[n // 9 :])
            far.append(int(np.bitwise_count(a ^ b).sum()))
        assert max(far) <= d.RADIUS - 8
