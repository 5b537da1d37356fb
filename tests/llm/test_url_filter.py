"""Operator 4: hosts, paths and rules against SQL, the model on urls that its table does not hold."""

import duckdb
import numpy as np
import pytest

from classledger.llm import catalog, url_filter

from ..conftest import SF_ORACLE

URLS = [None, "", "no-scheme.org/x", "http://", "http://A.ORG", "http://a.example.org/es/1?x#y", "http://a.example.org/en/17", "https://x.com/de/1",
        "https://x.com/fr/1", "https://x.com", "https://com/de/", "ftp://É.COM/DE/#", "http://notcom/de/", "http://u:p@example.org:80/es/", "a://b://c.org/q",
        "http://x.org?://y", "http://example.org#/es/", "http://EXAMPLE.org/es/", "http://example.org/ES/", "http://xexample.org/es/x", "x" * 100_000 + "://a.com/de/"]

SQL = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {table}),
q AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, pre, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT q.page_id, q.host, q.path, max_by(r.h || r.pre, length(r.h || r.pre)) AS rule, max_by(r.v, length(r.h || r.pre)) AS verdict
FROM q LEFT JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.pre) GROUP BY 1, 2, 3"""


def compare(got, want):
    got = {r.page_id: r for r in got}
    assert len(got) == len(want)
    for page_id, host, path, rule, verdict in want:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.p_block >= url_filter.THRESHOLD else "allow")), r


def test_the_query_equals_sql_but_for_the_model(spark):
    want = duckdb.connect().execute(SQL.format(table=f"'{SF_ORACLE}/pages.parquet'")).fetchall()
    got = catalog.op4_url_filter(spark, SF_ORACLE).collect()
    compare(got, want)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_awkward_urls_equal_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string")
    compare(url_filter.judge_urls(df.repartition(3)).collect(), con.execute(SQL.format(table="pages")).fetchall())
    assert url_filter.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("host, path, blocked", [
    ("cheap-pills-now.example.edu", "/order", True), ("best-casino-slots.example.info", "/bonus", True), ("nude-cams.example.info", "/live", True),
    ("city-library.example.edu", "/catalog/history", False), ("physics-courses.example.edu", "/guide", False), ("news-times.example.info", "/en/politics", False)])
def test_urls_outside_the_table(host, path, blocked):
    weights, bias = url_filter.train(*url_filter.labelled())
    rows, buckets = url_filter.grams([host], [path])
    assert (url_filter._signal(weights, bias, rows, buckets, 1)[0] > np.log(url_filter.THRESHOLD / (1 - url_filter.THRESHOLD))) == blocked
