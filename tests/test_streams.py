"""The event table and the closing of scans, on hand-made arrivals."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crawlgauge.operators import audit, reports
from crawlgauge.operators.scoring import scan_scores
from crawlgauge.plans.session import materialize
from crawlgauge.registry import BUILTIN
from crawlgauge.sources import schemas
from crawlgauge.sources.tables import API_PATHS, KEY_PATHS, MCP_PATHS, TEXT_PATHS, resource_stream
from crawlgauge.streaming import audit_stream as st

AT = dt.datetime(2024, 1, 1)
PAGE = "<body><p>" + "word " * 200 + "$5</p></body>"
PATHS = ["/", *TEXT_PATHS, *API_PATHS, *KEY_PATHS, *MCP_PATHS]
FAR = AT + dt.timedelta(days=20000)


def row(scan, path, start=0.0, at=0.0, status=200, body=None, error=None):
    """A resource of a scan that started ``start`` minutes in and was fetched ``at`` minutes later."""
    begun = AT + dt.timedelta(minutes=start)
    return (scan, f"https://s{scan}.example", path, None if error else status, None, {}, body, error,
            begun + dt.timedelta(minutes=at), begun)


def site(scan, start=0.0, minutes=0.0, home=PAGE, **kw):
    """All resources of a scan, spread over its time."""
    bodies = {"/": home, "/robots.txt": "User-agent: *\nDisallow: /", "/sitemap.xml": "<url>", "/llms.txt": "# A\n> b"}
    n = len(PATHS) - 1
    return [row(scan, p, start, minutes * i / n, 200 if p in bodies else 404, bodies.get(p), **(kw if p == "/" else {}))
            for i, p in enumerate(PATHS)]


def beats(n=2):
    return [[(-1, "https://beat.example", "/robots.txt", 404, None, {}, None, None, FAR, FAR + dt.timedelta(seconds=i))] for i in range(n)]


@pytest.fixture
def play(spark, tmp_path):
    """Run a stream over steps of arriving rows; gives its output and the arrived rows as a table."""

    def run(build, steps, files=1, partitions="2"):
        for n, rows in enumerate(steps):
            spark.createDataFrame(rows, schemas.ARRIVING).coalesce(1).write.parquet(f"{tmp_path}/in/step={n:04}")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            stream = build(resource_stream(spark, f"{tmp_path}/in/step=*", files))
            for _ in range(2):
                # A restart from the checkpoint has nothing more to tell.
                query = st.run_to_sink(stream, f"{tmp_path}/out", f"{tmp_path}/state")
                query.awaitTermination()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        arrived = spark.read.schema(schemas.ARRIVING).parquet(f"{tmp_path}/in/step=*")
        return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"), arrived

    return run


def batch(arrived):
    return audit.assemble(arrived.filter("scan_id >= 0"), links=False)


def test_scans_of_any_length_close_as_in_batch(play):
    """Scans of 0, 0.5, 20, 40 and 110 minutes arrive in time order, a quarter of an hour a step, twice in part."""
    rows = [r for n, m in enumerate((0, 0.5, 20, 40, 110, 40)) for r in site(n, 7 * n, m)]
    ordered = sorted(rows, key=lambda r: r[8])
    steps, begin = [], AT
    while ordered:
        begin += dt.timedelta(minutes=15)
        steps.append([r for r in ordered if r[8] < begin] + rows[:3])
        ordered = [r for r in ordered if r[8] >= begin]
    assert len(steps) > 6
    out, arrived = play(st.completed_sites, [s for s in steps if s] + beats())
    want = {tuple(r) for r in scan_scores(audit.with_checks(batch(arrived))).collect()}
    assert {tuple(r) for r in scan_scores(out).collect()} == want and len(want) == 6
    reasons = {(r.scan_id, r.key): r.reason for r in audit.check_results(out).collect()}
    assert reasons == {(r.scan_id, r.key): r.reason for r in audit.check_results(audit.with_checks(batch(arrived))).collect()}
    assert "unreachable" not in {v for (_, k), v in reasons.items() if k in ("llms_txt", "sitemap")}


def test_one_event_table(play):
    steps = [
        site(1), site(2, 1, error="dns"), site(3, 2, 30)[1:], site(4, 3)[:1] + site(4, 3)[4:],
        # The homepage of scan 3 comes after the watermark, which takes effect a batch later.
        *beats(), site(3, 2, 30)[:1], *beats(),
    ]
    out, arrived = play(st.audit_events, steps)
    events = [r.asDict() for r in out.filter("scan_id >= 0").collect()]
    by_type = {t: [e for e in events if e["event_type"] == t] for t in ("check", "complete", "error")}
    sites = batch(arrived.filter("NOT (scan_id = 3 AND path = '/')"))
    audited = audit.with_checks(sites)
    want = {(r.scan_id, r.key, r.status, r.reason, r.points_earned, r.detail, r.action) for r in audit.check_results(audited).collect()}
    got = [tuple(e[c] for c in ("scan_id", "key", "status", "reason", "points_earned", "detail", "action")) for e in by_type["check"]]
    # All twelve of the usable scans, each once, of scan 4 without text files too; none of the failed ones.
    assert len(got) == len(set(got)) == 24 and set(got) == want
    assert {(e["scan_id"], e["url"], e["error"]) for e in by_type["error"]} == {
        (2, "https://s2.example", "dns"), (3, "https://s3.example", "homepage not fetched")}
    scores = {r.scan_id: (r.score, r.band) for r in scan_scores(audited).collect()}
    assert {e["scan_id"]: (e["score"], e["band"]) for e in by_type["complete"]} == scores and set(scores) == {1, 4}
    nested = {r.scan_id: json.loads(r.document) for r in reports.as_document(reports.nest_results(audited).withColumn("subpages", F.lit(None).cast("array<struct<page_type:string,page_url:string,checks:array<struct<key:string,status:string,detail:string,action:string>>>>"))).collect()}
    for e in by_type["complete"]:
        document = json.loads(e["document"])
        assert document == {k: v for k, v in nested[e["scan_id"]].items() if k != "subpages"}
        assert len(document["checks"]) == 12


def test_redelivered_resources_tell_their_checks_once(play):
    """A hot homepage and robots file, delivered many times over several steps."""
    hot = [r for r in site(1) if r[2] in ("/", "/robots.txt")]
    steps = [site(1) + hot * 40, hot * 40 + site(2, 1), *beats()]
    out, _ = play(st.audit_events, steps)
    checks = out.filter("scan_id >= 0 AND event_type = 'check'").groupBy("scan_id", "key").count().collect()
    assert len(checks) == 24 and {r["count"] for r in checks} == {1}


def test_late_rows_are_counted_over_many_batches(spark, play):
    """More batches than the progress of a stream is kept for, late rows several of one scan, and a restart."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    steps = [site(1), beats()[0]]
    late = 0
    one = tuple(c for c in BUILTIN if c.key == "sitemap")
    for n in range(16):
        rows = [row(1 + n % 3, p, 0.0, body=PAGE) for p in ["/", "/docs", "/robots.txt"][: 1 + n % 3]]
        # A path that no site takes in is not late either.
        steps.append([*rows, row(9, "/about", 0.0)])
        late += len(rows)
    out, arrived = play(lambda s: st.closed_scans(st.arriving(s), one), steps, partitions="1")
    found = {r.scan_id: r.n_late for r in st.late_resources(arrived, out).collect()}
    # The second step moved the watermark; by the third at the latest, rows of closed scans were dropped.
    assert out.filter("scan_id = 1").first().n_resources + found[1] == arrived.filter("scan_id = 1").count()
    taken = sum(r.n_resources for r in out.filter("scan_id > 0").collect())
    assert sum(found.values()) == len(site(1)) + late - taken and set(found) == {1, 2, 3}
    assert sum(found.values()) > 25
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_a_resource_without_start_is_a_scan_of_its_own_time(play):
    rows = [(*r[:9], None) for r in site(1)]
    out, arrived = play(st.completed_sites, [rows, *beats()])
    assert scan_scores(out).collect() == scan_scores(audit.with_checks(batch(arrived))).collect()


def test_judged_in_one_pass_as_kind_by_kind(spark, small):
    from verification import fixtures as fx

    resources = fx.resources(fx.pages(spark, small))
    one = audit.judged_rows(resources)
    homes = audit.home_rows(resources, links=False).withColumn("path", F.lit("/"))
    three = homes.unionByName(audit.text_rows(resources), allowMissingColumns=True).unionByName(
        audit.probe_rows(resources), allowMissingColumns=True)
    columns = three.columns
    assert sorted(map(repr, one.select(*columns).collect())) == sorted(map(repr, three.collect()))
    stored = materialize(resources.drop("kind"), "one-pass")
    assert audit.judged_rows(stored)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
