"""What the physical plans may and may not contain."""

import re

from pyspark.sql import functions as F

from crawlgauge.operators import audit, compare, reports, scoring, subpages
from crawlgauge.plans.session import materialize
from crawlgauge.sources.tables import fetch_frontier, resource_scan, site_table, spread, write_resources, write_site_table
from verification import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df):
    return plan(df).splitlines()


def stored(spark, small, tmp_path):
    write_resources(fx.resources(fx.pages(spark, small)).drop("kind"), str(tmp_path / "r"))
    return resource_scan(spark, str(tmp_path / "r"))


def exchanged_columns(df):
    """Names of the columns that enter each shuffle."""
    out = []

    def walk(node):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            attrs = node.output()
            out.append([attrs.apply(i).name() for i in range(attrs.size())])
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    root = df._jdf.queryExecution().executedPlan()
    walk(root.initialPlan() if root.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else root)
    return out


def test_audit_shuffles_no_body_and_runs_no_python(spark, small, tmp_path):
    res = stored(spark, small, tmp_path)
    audited = audit.audit(res, links=True)
    shuffles = exchanged_columns(audited)
    assert 0 < len(shuffles) <= 2
    for cols in shuffles:
        assert not {"body", "html", "headers"} & set(cols)
    assert "Python" not in plan(audited)
    for cols in exchanged_columns(subpages.audit_subpages(audited, res)):
        assert not {"body", "html", "headers"} & set(cols)


def test_probe_scan_reads_no_body(spark, small, tmp_path):
    res = stored(spark, small, tmp_path)
    text = audit.probe_rows(res)._jdf.queryExecution().toString()
    schema = re.search(r"ReadSchema: struct<([^\n]*)", text).group(1)
    assert "body" not in schema and "status" in schema
    assert "PartitionFilters: [isnotnull(kind" in text and "PushedFilters" in text


def test_probe_aggregation_is_hash_based(spark, small, tmp_path):
    res = stored(spark, small, tmp_path)
    probes = audit.probe_rows(res).groupBy("scan_id").agg(*audit.probe_aggs())
    assert "HashAggregate" in plan(probes) and "SortAggregate" not in plan(probes)


def test_registry_join_is_broadcast_and_frontier_needs_no_shuffle(spark, small):
    results = spark.createDataFrame([(1, "sitemap", "pass")], "scan_id bigint, key string, status string")
    assert "BroadcastHashJoin" in plan(compare.dim_join(results))
    sites = fx.pages(spark, small).select(F.col("page_id").alias("scan_id"), "url")
    assert "Exchange" not in plan(fetch_frontier(sites))


def test_one_check_reads_only_its_resources(spark, small, tmp_path):
    res = stored(spark, small, tmp_path)
    from crawlgauge.registry import BUILTIN

    only = tuple(c for c in BUILTIN if c.key == "sitemap")
    text = plan(audit.audit(res, only))
    assert "anchor" not in text and "/openapi.json" not in text


def test_bodies_are_parsed_only_when_linked(spark, small, tmp_path):
    res = stored(spark, small, tmp_path)
    audited = materialize(audit.audit(res, links=True), "audited-links")
    links = subpages.subpage_links(audited)
    kept = {(r.scan_id, r.path) for r in subpages.linked_resources(links, res).select("scan_id", "path").collect()}
    asked = {(r.scan_id, r.path) for r in links.collect()}
    served = {(r.scan_id, r.path) for r in res.filter("path <> '/' AND status = 200 AND error IS NULL").select("scan_id", "path").collect()}
    # No link of a served page is lost, and next to nothing else comes through.
    assert kept >= asked & served and len(kept - asked) <= 0.01 * len(served - asked) + 1
    assert not {p for _, p in kept} & {"/robots.txt", "/llms.txt", "/sitemap.xml", "/openapi.json"}
    # The filter is joined to the scan itself: what is read from the HTML comes above it.
    lines = plan(subpages.fetched_pages(links, res)).splitlines()
    probe = min(i for i, line in enumerate(lines) if "_word" in line and "BroadcastHashJoin" in line)
    assert any("_markup" in line for line in lines[:probe]) and not any("_markup" in line for line in lines[probe:])
    for cols in exchanged_columns(subpages.page_results(audited, res)):
        assert not {"body", "html", "headers"} & set(cols)


def test_filter_of_links_stays_small_and_loses_none(spark, monkeypatch):
    links = spark.range(20_000).select(F.col("id").alias("scan_id"), F.lit("/docs").alias("path"))
    monkeypatch.setattr(subpages, "LINK_BITS", 1 << 12)
    words = subpages.link_words(links)
    assert words.count() == (1 << 12) / 64
    monkeypatch.setattr(subpages, "LINK_BITS", 1 << 18)
    pages = links.unionByName(spark.range(20_000).select(F.col("id").alias("scan_id"), F.lit("/x").alias("path")))
    pages = pages.selectExpr("*", "200 AS status", "CAST(NULL AS STRING) AS error")
    kept = subpages.linked_resources(links, pages).groupBy("path").count().collect()
    counts = {r.path: r["count"] for r in kept}
    assert counts["/docs"] == 20_000 and 0 < counts.get("/x", 1) < 0.12 * 20_000


def test_pages_are_nested_with_one_exchange_and_the_matrix_with_one(spark, small, tmp_path):
    res = stored(spark, small, tmp_path)
    audited = materialize(audit.audit(res, links=True), "audited-nest")
    pages = subpages.page_results(audited, res)
    alone = len(exchanged_columns(reports.nest_results(audited)))
    both = len(exchanged_columns(reports.nest_results(audited, pages)))
    assert alone == 0 and both <= len(exchanged_columns(pages)) + 2
    scored = materialize(scoring.with_score(audited), "scored-matrix")
    compared = scored.selectExpr("scan_id DIV 3 AS compare_id", "CAST(scan_id % 3 AS INT) AS ord", "checks", "score")
    assert len(exchanged_columns(compare.compare_matrix(compared))) == 1
    results = materialize(audit.check_results(audited), "results-lookup")
    requested = spark.range(50).withColumnRenamed("id", "scan_id")
    assert all("key" not in cols for cols in exchanged_columns(compare.compare_lookup(requested, results)))


def test_comparing_starts_no_job(spark, small, tmp_path):
    sites = materialize(audit.assemble(stored(spark, small, tmp_path)), "sites-compare")
    scored, errors = scoring.with_score(audit.with_checks(sites)), audit.scan_errors(sites)
    asked = fx.compare_requests(fx.pages(spark, small))
    sc = spark.sparkContext
    sc.setJobGroup("no job", "building a plan")
    try:
        rows = compare.compare(asked, scored, errors)
        assert list(sc.statusTracker().getJobIdsForGroup("no job")) == []
        assert rows.count() > 0 and list(sc.statusTracker().getJobIdsForGroup("no job")) != []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_score_of_a_bucketed_table_needs_no_exchange(spark, small, tmp_path):
    res = fx.resources(fx.pages(spark, small)).drop("kind")
    path = str(tmp_path / "bucketed")
    write_site_table(res, "bucketed_crawl", path, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Tables too large for a broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = {tuple(r) for r in scoring.scan_scores(audit.audit(res)).collect()}
        for reopened in (False, True):
            if reopened:
                spark.sql("DROP TABLE bucketed_crawl")
            scores = scoring.scan_scores(audit.audit(site_table(spark, "bucketed_crawl", path, 4)))
            assert exchanged_columns(scores) == [] and "Broadcast" not in plan(scores)
            assert {tuple(r) for r in scores.collect()} == want
            errors = audit.scan_errors(audit.assemble(site_table(spark, "bucketed_crawl", path, 4), links=False))
            assert exchanged_columns(errors) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS bucketed_crawl")


def test_pages_in_one_row_group_are_shared_out(spark, tmp_path):
    confs = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in confs}
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.repeat(F.uuid(), 20).alias("html"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(4 * cores, "page_id").write.parquet(str(tmp_path / "many"))
    busy = lambda df: df.select(F.spark_partition_id()).distinct().count()
    try:
        for key, value in confs.items():
            spark.conf.set(key, value)
        one, many = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "many"))
        # As many splits as bytes, but only one of them holds the row group.
        assert one.rdd.getNumPartitions() >= cores > busy(one) == 1
        shared = spread(one, "page_id")
        assert busy(shared) > 1 and shared.count() == 400
        assert "Exchange" not in plan(spread(many, "page_id"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
