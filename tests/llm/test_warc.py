import gzip
import hashlib

import duckdb
import pytest

from latticeflow.llm import queries, warc
from latticeflow.llm.common import new_path, table


def test_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = con.sql(queries.ORACLE["op3_warc"])
    df = queries.op3_warc(spark, data)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


ODD = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, "http://c/ d\r\nX: y", "same"), (1, None, None), (2, "", ""), (7, "u", "é" * 300_000),
    (7, "u", "é" * 300_000), (8, "u", "WARC/1.1\r\n\r\n"), (None, "n", "alone"), (None, "n", "same"),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in ODD], "page_id long, url string, html string, payload string")
    out = new_path(spark, "warc")
    listed = warc.write(pages, out, roll_bytes=2000, partitions=3, range_bytes=1500)
    assert listed.agg({"records": "sum"}).first()[0] == len(ODD) and listed.count() > 3
    got = [(r["id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(spark, out).collect()]
    digest = lambda t: warc.base32_sha1((t or "").encode())
    size = lambda t: len((t or "").encode())
    first = {"same": 3, None: 1, "": 1, "é" * 300_000: 7, "WARC/1.1\r\n\r\n": 8}
    seen, want = set(), []
    for i, _, html in ODD:
        to = first.get(html)
        revisit = i != to if to is not None else (i, html) in seen
        revisit = revisit or (i, html) in seen
        seen.add((i, html))
        want.append((i, "revisit" if revisit else "response", to if revisit else None, size(html), digest(html)))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    texts = {(r["id"], bytes(r["payload"]).decode()) for r in warc.read(spark, out).where("payload is not null").collect()}
    assert (3, "same") in texts and (None, "alone") in texts


def test_same_bytes_again_and_damage_is_seen(spark, data):
    sums = []
    for _ in range(2):
        out = new_path(spark, "warc")
        listed = warc.write(table(spark, data, "pages"), out, partitions=2)
        sums.append(sorted((r["file"], r["sha256"]) for r in listed.collect()))
    assert sums[0] == sums[1]
    name = out.removeprefix("file://") + "/" + sums[0][0][0]
    raw = open(name, "rb").read()
    assert hashlib.sha256(raw).hexdigest() == sums[0][0][1]
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") >= 10
    with open(name, "ab") as f:
        f.write(raw[:40])
    with pytest.raises(Exception, match="WARC"):
        warc.read(spark, out).collect()


def test_empty(spark, data):
    out = new_path(spark, "warc")
    assert warc.write(table(spark, data, "pages").limit(0), out).count() == 0
    assert warc.read(spark, out).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    out = new_path(spark, "warc")
    warc.write(pages, out, min_revisit_bytes=3)
    assert {r["id"]: r["record_type"] for r in warc.read(spark, out).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_layout_depends_on_the_data_alone(spark):
    rows = spark.range(40_000).selectExpr("id * 7 % 39989 AS page_id", "concat('http://h/', id) AS url", "repeat(sha1(cast(id % 30000 AS string)), 1 + cast(id % 9 AS int)) AS html")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, order in (("3", "page_id"), ("7", "html")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            listed = warc.write(rows.orderBy(order), new_path(spark, "warc"), range_bytes=4 << 20, roll_bytes=300_000)
            found.append(sorted(map(tuple, listed.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) > 6 and sum(r[3] for r in found[0]) == 40_000


def test_null_ids_revisit(spark):
    rows = [(None, "a", "same"), (None, "b", "same"), (4, "c", "same"), (None, "d", "lone"), (None, "d", "lone"), (None, "e", None)]
    out = new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), out, range_bytes=600)
    got = sorted((r["id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.read(spark, out).collect())
    assert got == sorted([(0, 4, "revisit", 4), (0, 4, "revisit", 4), (4, 4, "response", 0), (0, 4, "response", 0), (0, 4, "revisit", 0), (0, 0, "response", 0)])
