import pytest

from latticeflow.llm import decontaminate, packing, quality, simhash, toxicity
from latticeflow.llm.common import table

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_every_stage_against_plain_python(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(pipeline.STAGES)

    def left(name):
        nonlocal docs
        docs = stages[name](spark, docs, data)
        assert docs.columns == columns
        return {r["doc_id"] for r in docs.collect()}

    model = quality.fit(docs)
    rows = {i: t for i, t in rows.items() if model.score(t) >= quality.REJECT}
    assert left("quality_classifier") == rows.keys()
    scorer = toxicity.fit(docs, table(spark, data, "labels").where(~toxicity.held_out("doc_id")))
    rows = {i: t for i, t in rows.items() if scorer.score(t) < toxicity.THRESHOLD}
    assert left("toxicity") == rows.keys()
    fps = {i: simhash.simhash(t) for i, t in sorted(rows.items())}
    least = {i: i for i in fps}
    sets = {i: set(simhash._shingle_hashes(simhash._words(t), 5).tolist()) for i, t in rows.items()}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS or alike(sets[a], sets[b]))]
    for _ in range(5):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    rows = {i: t for i, t in rows.items() if least[i] == i}
    assert left("simhash_near_dedup") == rows.keys()
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()])
    rows = {i: t for i, t in rows.items() if not index.matches(t)}
    assert left("benchmark_decontamination") == rows.keys()
    packed = stages["best_fit_packing"](spark, docs, data).collect()
    assert {r["doc_id"] for r in packed} == rows.keys()
    assert sum(r["size"] for r in packed) == sum(len(t.encode()) + 1 for t in rows.values())
    assert max(r["offset"] + r["size"] for r in packed) <= packing.CAPACITY


def test_run_gives_the_last_stage(spark, data):
    got = pipeline.run(spark, data)
    assert "doc_id" in got.columns and got.count() > 0
