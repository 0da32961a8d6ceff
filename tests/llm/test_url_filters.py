from pyspark.sql import functions as F

from latticeflow.llm import queries, url_filters
from latticeflow.llm.common import table
from latticeflow.llm.url_filters import RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:stop]


def rule_of(host, path):
    found = None
    for said, rule in RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and len(rule) > len(found[1] if found else ""):
            found = said, rule
    return found


def test_query_matches_brute_force(spark, data):
    urls = {r["page_id"]: r["url"] for r in table(spark, data, "pages").collect()}
    got = queries.op1_url_filters(spark, data).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(urls[r["page_id"]])
        rule = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
        assert r["verdict"] == (rule[0] if rule else "block" if r["mined"] is not None else "allow")


ODD = [
    (1, None), (2, ""), (3, "no scheme.org/"), (4, "http://EXAMPLE.Org/es/x"), (5, "http://a.example.org/en/12?x#y"), (6, "http://org/"),
    (7, "http://notexample.org"), (8, "http://x.com/fr/"), (9, "http://x.com/FR/"), (10, "a://b://c/d"), (11, "http://É.org/é?"), (12, "http://x.com/de/\n"),
    (12, "http://x.com/de/\n"), (None, "http://x.com/de"), (13, "://?q"), (14, "http://x.org/" + "a" * 100_000),
]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(*r, "z") for r in ODD], "page_id long, url string, host string")
    none = url_filters.mine_rules(pages.withColumn("bad", F.lit(True)).limit(0))
    assert none.count() == 0
    got = sorted(url_filters.judge(pages, none).collect(), key=lambda r: (r["page_id"] or -1))
    for r, (i, url) in zip(got, sorted(ODD, key=lambda r: r[0] or -1), strict=True):
        host, path = split(url)
        rule = rule_of(host, path)
        assert (r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) == (i, host, path, rule and rule[1], rule[0] if rule else "allow")
    assert url_filters.judge(pages.limit(0), none).count() == 0


def test_mined_rules(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'news'}-{i % 3}.example.net/{'win' if i % 8 == 0 else 'read'}/{i}", i % 8 == 0) for i in range(400)]
    labelled = spark.createDataFrame([*rows, (999, None, True), (998, "http://x.net/", None)], "page_id long, url string, bad boolean")
    mined = url_filters.mine_rules(labelled)
    found = [(r["antecedent"], r["confidence"]) for r in mined.collect()]
    assert (["p:win"], 1.0) in found
    assert not any("p:win" in a and len(a) > 1 for a, _ in found)  # rules on more tokens are no surer
    verdicts = {r["page_id"]: r["verdict"] for r in url_filters.judge(labelled, mined).collect()}
    assert all(verdicts[i] == ("block" if bad else "allow") for i, _, bad in rows)
    assert url_filters.mine_rules(labelled.where("not bad")).count() == 0
