import zlib

import numpy as np

from latticeflow.llm import queries, toxicity
from latticeflow.llm.common import table


def test_folding():
    assert toxicity.fold("Іdi0t! ｉＤＩＯＴ") == " idiot idiot "
    assert toxicity.fold("1d1ot tr@sh pa​thetic") == " idiot trash pathetic "
    assert toxicity.fold("wow$$$ the@end") == " wow theaend "
    assert toxicity.fold(None) == toxicity.fold("  ") == toxicity.fold("!?") == " "


def scorer(exceptions=("trash can",)):
    return toxicity.Scorer({" trash ": 4.0, " idiot ": 5.0, " trash": 2.0}, [-4.0, 1.0, 0.5, 0.5], exceptions)


def test_matching_by_hand():
    s = scorer()
    one, total = s.features("you trash and IDIOT")[1:3]
    assert one == 5.0 and abs(total - np.log1p(2)) < 1e-12
    assert s.features("a trash can")[1] == 0.0
    assert s.features("a trash can of trash")[1] == 4.0
    assert s.features("xtrash")[1] == 0.0 and s.features("trashy")[1] == 2.0
    assert s.score("idiot") > s.score("idiot " + "word " * 500) > s.score("word")  # length counts


def test_odd_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "idiot " * 100_000, 0.5), (3, "fine", 0.1), (None, "trash", 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.score(docs, scorer()).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    base = scorer().score("")
    assert [r["score"] for r in got if r["id"] in (1, 2)] == [base, base]
    kept = toxicity.reject(docs.withColumnRenamed("score", "_toxic"), scorer())
    assert kept.columns == ["doc_id", "text", "_toxic"] and {r["text"] for r in kept.collect()} == {None, "", "fine"}
    assert toxicity.score(docs.limit(0), scorer()).count() == 0


def test_fit_without_one_of_the_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(None, 1), (2, None)], [(7, 1)]):
        s = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert s.lexicon == {} and 0 < s.score("anything") < 1


def test_query_on_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, at, "labels").collect()}
    got = queries.op2_toxicity(spark, at).collect()
    assert len(got) == table(spark, at, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    pairs = [(r["score"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    predicted = [(s >= 0.7, t) for s, t in pairs]
    hits = sum(p and t for p, t in predicted)
    assert hits / sum(p for p, _ in predicted) > 0.95 and hits / sum(t for _, t in predicted) > 0.9
    assert sum(p == bool(t) for p, t in predicted) / len(predicted) > 0.98


def test_labels_of_held_out_rows_do_not_matter(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    seen = labels.where(~toxicity.held_out("doc_id"))
    flipped = seen.unionByName(labels.where(toxicity.held_out("doc_id")).selectExpr("doc_id", "quality", "1 - toxic AS toxic")).where(~toxicity.held_out("doc_id"))
    a, b = toxicity.fit(docs, seen), toxicity.fit(docs, flipped)
    assert a.lexicon == b.lexicon and np.allclose(a.weights, b.weights)


def by_hand(s, text):
    """Features by looking for every pattern at every place."""
    folded = toxicity.fold(text)

    def at(p):
        found, i = [], folded.find(p)
        while i >= 0:
            found.append(i)
            i = folded.find(p, i + 1)
        return found

    harmless = [(i, i + len(toxicity.fold(p)) - 1) for p in s.exceptions for i in at(toxicity.fold(p))]
    best = {}
    for p, w in s.lexicon.items():
        for i in at(p):
            if not any(a <= i < b for a, b in harmless):
                best[i] = max(w, best.get(i, 0.0))
    words = max(1, len(folded.split()))
    return [1.0, max(best.values(), default=0.0), np.log1p(len(best)), np.log1p(100 * sum(best.values()) / words)]


def test_every_document_against_matching_by_hand(spark):
    data = "/root/testdata/sf0.01"
    docs = table(spark, data, "documents")
    s = toxicity.fit(docs, table(spark, data, "labels").where(~toxicity.held_out("doc_id")))
    assert s.lexicon
    want = {}
    for r in docs.collect():
        z = float(np.dot(s.weights, by_hand(s, r["text"])))
        want[r["doc_id"]] = 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))
    got = {r["id"]: r["score"] for r in toxicity.score(docs, s).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
