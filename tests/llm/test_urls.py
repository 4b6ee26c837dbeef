import re

from pyspark.sql import functions as F

from voxlake.llm import urls

D = "/root/testdata/sf0.01"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


def rule(host, path):
    fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    got = urls.op5_urls(spark, D).collect()
    assert len(got) == len(pages)
    for r in got:
        h, p = split(pages[r.page_id])
        assert (r.host, r.path) == (h, p) and r.rule == rule(h, p)[0]
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == rule(h, p)[1])
    assert {r.rule for r in got} >= {None, "com/", "example.com/en/"}


def test_reputation_shrinks_to_parents(spark):
    pages = [(i, f"http://bad.x.org/{i}") for i in range(200)] + [(1000 + i, f"http://good.x.org/{i}") for i in range(200)] + [(2000, "http://new.x.org/"), (2001, "http://once.x.org/")]
    labels = [(i, 1, int(i < 1000 and i % 10 > 0)) for i, _ in pages if i < 2000] + [(2001, 1, 1)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.host: r for r in out.select("host", "verdict", "bad_rate", "bad_bound").distinct().collect()}
    assert got["bad.x.org"].verdict == "block" and got["good.x.org"].verdict == "allow"
    assert got["bad.x.org"].bad_rate > 0.8 and got["good.x.org"].bad_rate < 0.05
    assert got["new.x.org"].verdict == got["once.x.org"].verdict == "allow"  # too little is known
    assert got["good.x.org"].bad_rate < got["new.x.org"].bad_rate < got["once.x.org"].bad_rate < 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (None, "http://A.NET/es/x?y#z"), (5, "x://h"), (5, "x://h?q/r"), (6, "a://b://c/d\ne")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, labels).collect()}
    assert got == {(i, *split(u), rule(*split(u))[0], rule(*split(u))[1] or "allow") for i, u in rows}
    assert urls.judge(df.limit(0), labels).count() == 0 and urls.judge(df, labels.limit(0)).count() == 7
