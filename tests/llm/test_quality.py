import numpy as np

from latticeflow.llm import quality, queries
from latticeflow.llm.common import table


def test_em_recovers_accuracies():
    g = np.random.default_rng(5)
    good = g.random(20_000) < 0.85
    votes = np.empty((len(good), 6), int)
    for j, (hit, miss) in enumerate([(0.9, 0.01), (0.8, 0.01), (0.7, 0.005), (0.9, 0.01), (0.6, 0.0), (0.8, 0.01)]):
        bad = np.where(good, g.random(len(good)) < miss, g.random(len(good)) < hit)
        votes[:, j] = np.where(g.random(len(good)) < 0.1, -1, ~bad)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, p = quality.em(patterns, counts.astype(float))
    assert abs(share - good.mean()) < 0.02
    assert np.abs(1 - p[:, 0] - [0.9, 0.8, 0.7, 0.9, 0.6, 0.8]).max() < 0.05 and p[:, 1].min() > 0.97
    assert ((quality.posterior(votes, share, p) >= 0.5) == good).mean() > 0.97


def test_posterior_by_hand():
    p = np.array([[0.2, 0.99], [0.5, 0.98]])
    got = quality.posterior(np.array([[1, 0], [-1, -1], [0, 0]]), 0.8, p)
    odds = [0.8 / 0.2 * 0.99 / 0.2 * 0.02 / 0.5, 4.0, 4 * 0.01 / 0.8 * 0.02 / 0.5]
    assert np.allclose(got, [o / (1 + o) for o in odds])


def test_query_agrees_with_labels_it_never_saw(spark):
    at = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, at, "labels").collect()}
    got = queries.op10_quality_classifier(spark, at).collect()
    assert len(got) == table(spark, at, "documents").count()
    pairs = [(r["good"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels]
    assert sum(g for g, q in pairs if q) / sum(q for _, q in pairs) > 0.99
    assert sum(not g for g, q in pairs if not q) / sum(not q for _, q in pairs) > 0.95


def test_odd_rows(spark):
    prose = "The quick brown fox jumps over the dog. It was a fine day, and all was well."
    rows = [(1, None, 1.0), (2, "", 1.0), (3, " \n", 1.0), (4, "THE!! END!! " * 40, 1.0), (5, "| a | b " * 30, 1.0), (None, prose, 1.0), (7, prose, 1.0), (7, prose, 1.0), (8, "a" * 300_000, 1.0)]
    rows += [(100 + i, f"{prose} Word {i} came then.", 1.0) for i in range(80)] + [(300 + i, f"x$$$ y{i}### z*** " * 20, 1.0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = quality.fit(docs)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows)
    judged = {r["id"]: r["good"] for r in got}
    assert judged[7] and judged[None] and judged[100] and not judged[4] and not judged[300]
    assert len({r["score"] for r in got if r["id"] in (1, 2, 3)}) == 1
    kept = quality.keep_good(docs.withColumnRenamed("score", "_QUALITY"), model)
    assert kept.columns == ["doc_id", "text", "_QUALITY"]
    assert kept.count() == sum(judged[r[0]] for r in rows)
    empty = quality.fit(docs.limit(0))
    assert empty.score("") > 0.99 and quality.score(docs.limit(0), model).count() == 0


def em_by_hand(patterns, counts, rounds=60):
    """EM in plain loops, one document pattern and one labeller at a time."""
    good = quality.START_GOOD
    post = [1 - quality.START_ACCURACY if 0 in p else quality.START_ACCURACY for p in patterns]
    for _ in range(rounds):
        acc = []
        for j in range(len(patterns[0])):
            row = []
            for mass in ([1 - q for q in post], post):
                yes = sum(m * c for m, c, p in zip(mass, counts, patterns, strict=True) if p[j] == 1)
                said = sum(m * c for m, c, p in zip(mass, counts, patterns, strict=True) if p[j] >= 0)
                row.append((yes + 1e-3) / (said + 2e-3))
            acc.append(row)
        good = min(0.98, max(0.02, sum(q * c for q, c in zip(post, counts, strict=True)) / sum(counts)))
        new = []
        for p in patterns:
            odds = good / (1 - good)
            for j, v in enumerate(p):
                a = [min(1 - 1e-6, max(1e-6, x)) for x in acc[j]]
                odds *= a[1] / a[0] if v == 1 else (1 - a[1]) / (1 - a[0]) if v == 0 else 1
            odds = min(np.exp(30), max(np.exp(-30), odds))
            new.append(odds / (1 + odds))
        post = new
    return good, np.array(acc), np.array(post)


def test_em_on_the_documents_against_plain_loops(spark, data):
    texts = [r["text"] for r in table(spark, data, "documents").collect()]
    seen = {}
    for t in texts:
        key = tuple(quality.votes(quality.measures(t)))
        seen[key] = seen.get(key, 0) + 1
    patterns, counts = [list(k) for k in sorted(seen)], [seen[k] for k in sorted(seen)]
    good, acc, post = em_by_hand(patterns, counts)
    share, p = quality.em(np.array(patterns), np.array(counts, float))
    assert abs(share - good) < 1e-3 and np.abs(p - acc).max() < 1e-2
    assert np.abs(quality.posterior(np.array(patterns), share, p) - post).max() < 1e-2
    model = quality.fit(table(spark, data, "documents"))
    said = {r["id"]: r["good"] for r in quality.score(table(spark, data, "documents"), model).collect()}
    of = {tuple(k): v for k, v in zip(patterns, post, strict=True)}
    want = {r["doc_id"]: of[tuple(quality.votes(quality.measures(r["text"])))] >= quality.REJECT for r in table(spark, data, "documents").collect()}
    assert sum(said[i] == want[i] for i in want) >= 0.98 * len(want)
