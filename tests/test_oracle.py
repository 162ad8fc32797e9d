"""Whole queries against their SQL at the smallest scale; the full set runs with verification.check."""

import pytest

import __spark_entry__ as entry_points
from verification.check import compare, connect
from verification.registry import ORACLE, QUERIES

END_TO_END = [
    "fetch_frontier", "detect_subpages", "nested_result", "report_txt", "compare_pivot", "fleet_rollup",
    "stream_checks", "stream_errors", "stream_parity", "stream_dedup", "stream_late",
]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", END_TO_END)
def test_query_agrees_with_sql(spark, con, small, name):
    verdict = compare(spark, con, name, small)
    assert verdict.startswith("ok ("), verdict


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    core = {n for n in entry_points.queries() if n in QUERIES}
    assert core == set(QUERIES) and core <= set(entry_points.oracle_sql())


def test_entry_has_a_stable_schema(spark):
    df = entry_points.entry(spark)
    assert df.columns == [
        "scan_id", "url", "raw_points", "max_points", "score", "band", "n_pass", "n_warning", "n_fail"]
    assert df.count() == 46


def test_subpage_scan_reads_every_served_page(spark, tmp_path):
    pages = [(i, f"https://s{i}.example/", "<body><p>some text</p><footer></footer></body>") for i in (0, 1, 2, 3, 10, 23)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["subpage_scan"](spark, str(tmp_path)).collect()
    # Pages 2, 3 and 23 link to nothing of their own site; their pages are read all the same.
    assert sorted((r.scan_id, r.path) for r in rows) == [
        (0, "/contact-us"), (0, "/docs"), (0, "/pricing"), (1, "/docs"), (1, "/docs/pricing"), (1, "/pricing"), (1, "/x"),
        (2, "/docs"), (2, "/pricing"), (3, "/docs"), (10, "/docs"), (10, "/pricing"), (23, "/docs"), (23, "/pricing"),
    ]
    assert all(r.text_len == 0 for r in rows if r.scan_id in (2, 3, 23))
    assert all(r.text_len > 0 for r in rows if r.scan_id in (0, 10))
