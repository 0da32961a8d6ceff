from latticeflow.plans import queries


def test_sampled_category_covers_the_layer(spark, monkeypatch):
    rows = [(9000 + x, 700 + y, 3 + z, 1 + x % 5) for x in range(20) for y in range(20) for z in range(4)]
    far = spark.createDataFrame(rows, "x long, y long, z long, v long")
    monkeypatch.setattr(queries, "vox", lambda spark, d: far)
    got = queries.QUERIES["sampled_category"](spark, "").first()
    assert (got["kinds"], got["n"] > 0) == (5, True)
