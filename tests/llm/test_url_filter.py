import pandas as pd
from pyspark.sql import functions as F

from placewright.llm import url_filter as U

from . import duck

SF = "/root/testdata/sf0.001"
URLS = [
    None,
    "",
    "no scheme here",
    "http://Example.ORG/es/1?x=/en/",
    "http://sub.example.org/en/12#t",
    "http://example.org",
    "http://notexample.org/es/2",
    "https://a.example.com/fr/1",
    "https://a.example.com/de/1",
    "https://bad.example.net/x",
    "https://bad.example.net/y",
    "https://good.example.net/y?u=http://bad.example.net/",
    "://",
    "x://y://z/org",
    "http://user:pw@a.b.co.uk:8080/x",
    "http://c.b.co.uk/x",
    "http://10.0.0.7:80/p",
    "http://[::1]:80/p",
    "http://h.com:8080/q",
]


def tables():
    pages = pd.DataFrame({"page_id": [*range(len(URLS)), 3, None], "url": [*URLS, URLS[3], URLS[4]]}).astype({"page_id": "Int64"})
    more = pd.DataFrame({"page_id": range(100, 160), "url": ["https://bad.example.net/p"] * 30 + ["https://good.example.net/p"] * 30}).astype({"page_id": "Int64"})
    pages = pd.concat([pages, more], ignore_index=True)
    labels = pd.DataFrame({"doc_id": [*range(100, 160), None, 9], "quality": [0] * 30 + [1] * 30 + [1, None], "toxic": [0] * 60 + [0, None]}).astype("Int64")
    return pages, labels


def frames(spark, pages, labels):
    plain = lambda f: [tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in f.itertuples(index=False)]
    return (
        spark.createDataFrame([(*r, "h", 1) for r in plain(pages)], "page_id long, url string, host string, rule int"),
        spark.createDataFrame(plain(labels), "doc_id long, quality int, toxic int"),
    )


def test_against_sql_on_the_table(spark):
    assert duck.spark_rows(U.op10_url_filter(spark, SF)) == duck.rows(U.SQL, SF)


def test_rules_and_reputation(spark):
    pages, labels = tables()
    got = U.judge(*frames(spark, pages, labels))
    assert duck.spark_rows(got) == duck.rows(U.SQL, pages=pages, labels=labels)
    by = {r.page_id: r for r in got.collect()}
    assert by[3].rule == "example.org/es/" and by[3].verdict == "block" and by[3].host == "example.org" and by[3].path == "/es/1"
    assert by[4].rule == "example.org/en/1" and by[5].rule is None and by[5].path == ""
    assert by[6].rule == "org/" and by[6].verdict == "allow"
    assert by[7].verdict == "allow" and by[8].verdict == "block"
    assert by[9].rule is None and by[9].verdict == "block" and by[11].verdict == "allow"
    assert by[0].host == by[2].host == "" and by[13].host == "y:"
    assert by[14].host == "user:pw@a.b.co.uk:8080" and by[16].host == "10.0.0.7:80"


def test_domains_and_suffixes(spark):
    hosts = ["user:pw@a.b.co.uk:8080", "co.uk", "10.0.0.7:80", "[::1]:80", "h.com:8080", "localhost", "a.b.example.net"]
    name = U._name(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(name, U._domain(name), U._suffix(name)).collect()
    assert [tuple(r) for r in got] == [
        ("a.b.co.uk", "b.co.uk", "co.uk"),
        ("co.uk", "co.uk", "co.uk"),
        ("10.0.0.7", "10.0.0.7", "(address)"),
        ("[::1]", "[::1]", "(address)"),
        ("h.com", "h.com", "com"),
        ("localhost", "localhost", "localhost"),
        ("a.b.example.net", "example.net", "net"),
    ]


def test_long_url_and_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/" + "x" * 5_000_000)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(U.judge(pages, labels).first().path) == 5_000_001
    plan = U.op10_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20 and "NestedLoop" not in plan and "Python" not in plan


def test_empty_tables(spark):
    pages, labels = frames(spark, *tables())
    assert U.judge(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in U.judge(pages, labels.limit(0)).collect()} == {"allow", "block"}
