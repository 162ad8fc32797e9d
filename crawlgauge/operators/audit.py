"""From crawled resources to audited sites.

Every page and text file is judged on its own row, so that only reasons and a
few short arguments are shuffled, never a body. One aggregation by ``scan_id``
then brings a scan's rows together. Its aggregates are all ``max`` over
fixed-size state: any number of re-fetched copies of a resource shrinks to one
value before the exchange, and the latest fetch wins whatever the row order.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.functions.outcomes import (
    API_PATHS,
    BUILTIN_RULES,
    KEY_PATHS,
    MCP_PATHS,
    OUTCOME,
    header_any_case,
    outcome,
)
from crawlgauge.functions.urls import base_url, login_url, normalize_url
from crawlgauge.operators.links import with_subpage_links
from crawlgauge.operators.signals import PAGE_RULES, page_facts
from crawlgauge.registry import BUILTIN, HOME, LLMS, ROBOTS, SITE, SITEMAP, Check
from crawlgauge.sources.schemas import FINDING
from crawlgauge.sources.tables import (
    HOME_PATH,
    LLMS_PATH,
    PROBE_PATHS,
    ROBOTS_PATH,
    SITEMAP_PATH,
    TEXT_PATHS,
)

TEXT_STAGES = {ROBOTS: ROBOTS_PATH, LLMS: LLMS_PATH, SITEMAP: SITEMAP_PATH}
# Slot names of the probed paths in a site row, with the codes each may take below _CODES.
PROBE_SLOTS = {"api": API_PATHS, "gated": KEY_PATHS, "mcp": MCP_PATHS}
_CODES = 4


def rule_of(check: Check) -> Column:
    return (check.rule or BUILTIN_RULES[check.key])()


def of_stage(checks: tuple[Check, ...], stage: str) -> list[Check]:
    return [c for c in checks if c.stage == stage]


def only_kind(resources: DataFrame, kind: str) -> DataFrame:
    """Prune to one stored kind where the table is split by kind."""
    return resources.filter(F.col("kind") == kind) if "kind" in resources.columns else resources


def _requested_url() -> Column:
    return normalize_url(F.col("site_url"))


def home_rows(
    resources: DataFrame, checks: tuple[Check, ...] = BUILTIN, links: bool = True, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Homepages judged: (scan_id, fetched_at, home), and the columns ``carry``.

    Only what ``checks`` and ``links`` ask for is extracted from the page.
    """
    fetched = only_kind(resources, "home").filter(F.col("path") == HOME_PATH).select(
        "scan_id", "fetched_at", *carry, *_fetched_page()
    )
    facts, fields = _home_facts(fetched, checks, links)
    return facts.select("scan_id", "fetched_at", *carry, _home(fields, checks))


def _fetched_page() -> list[Column]:
    return [
        _requested_url().alias("url"),
        F.col("status"),
        F.col("error"),
        F.coalesce("final_url", _requested_url()).alias("final_url"),
        F.col("headers"),
        F.when(F.col("error").isNull(), F.coalesce("body", F.lit(""))).alias("html"),
    ]


def _home_facts(fetched: DataFrame, checks: tuple[Check, ...], links: bool) -> tuple[DataFrame, list[str]]:
    """Facts of pages, and the names of those that a judged homepage keeps."""
    facts = page_facts(fetched)
    fields = ["url", "status", "error"]
    if of_stage(checks, SITE):
        fields += ["final_url", "has_password", "text_len_all"]
    if links:
        facts = with_subpage_links(facts, base_url(F.col("url")))
        fields.append("links")
    return facts, fields


def _home(fields: list[str], checks: tuple[Check, ...]) -> Column:
    judged = [rule_of(c).alias(c.key) for c in of_stage(checks, HOME)]
    return F.struct(*fields, *judged).alias("home")


def _text_outcomes(checks: tuple[Check, ...]) -> list[Column]:
    return [
        F.when(F.col("path") == path, rule_of(c)).alias(c.key)
        for stage, path in TEXT_STAGES.items()
        for c in of_stage(checks, stage)
    ]


def text_rows(
    resources: DataFrame, checks: tuple[Check, ...] = BUILTIN, carry: tuple[str, ...] = ()
) -> DataFrame:
    """robots.txt, llms.txt and sitemap.xml judged: (scan_id, fetched_at, path, one outcome per key)."""
    paths = [TEXT_STAGES[s] for s in TEXT_STAGES if of_stage(checks, s)]
    rows = only_kind(resources, "text").filter(F.col("path").isin(paths))
    return rows.select("scan_id", "fetched_at", *carry, "path", *_text_outcomes(checks))


def judged_rows(
    resources: DataFrame, checks: tuple[Check, ...] = BUILTIN, carry: tuple[str, ...] = (), links: bool = False
) -> DataFrame:
    """All resources judged on their own row in one pass, bodies ending here: home, an outcome per text file and
    the code of a probe, each where the path is its own. Resources of other paths belong to no site."""
    wanted = [HOME_PATH, *TEXT_PATHS, *PROBE_PATHS]
    facts, columns = _one_pass(resources.filter(F.col("path").isin(wanted)), checks, carry, links, _probe_code())
    code = F.when(F.col("path").isin(PROBE_PATHS), F.col("code")).alias("code")
    return facts.select("scan_id", "fetched_at", "path", "site_url", *carry, *columns, code)


def document_rows(
    resources: DataFrame, checks: tuple[Check, ...] = BUILTIN, links: bool = True
) -> DataFrame:
    """Homepages and text files judged in one pass: (scan_id, fetched_at, home, one outcome per key)."""
    rows = resources
    if "kind" in resources.columns:
        rows = resources.filter(F.col("kind").isin("home", "text"))
    paths = [TEXT_STAGES[s] for s in TEXT_STAGES if of_stage(checks, s)]
    facts, columns = _one_pass(rows.filter(F.col("path").isin(HOME_PATH, *paths)), checks, (), links)
    return facts.select("scan_id", "fetched_at", *columns)


def _one_pass(
    rows: DataFrame, checks: tuple[Check, ...], carry: tuple[str, ...], links: bool, *codes: Column
) -> tuple[DataFrame, list[Column]]:
    """Facts of all rows, and the judged homepage and text files as columns of them."""
    is_home = F.col("path") == HOME_PATH
    # The page is read where there is one: the HTML of other paths is NULL, and so is what is found in it.
    page = [c if name != "html" else F.when(is_home, c).alias("html") for c, name in zip(_fetched_page(), _PAGE_COLUMNS)]
    fetched = rows.select(
        "scan_id", "fetched_at", "path", "site_url", *carry, *[c.alias("code") for c in codes], *page,
        F.when(F.col("path").isin(TEXT_PATHS), F.col("body")).alias("body"),
    )
    facts, fields = _home_facts(fetched, checks, links)
    return facts, [F.when(is_home, _home(fields, checks)).alias("home"), *_text_outcomes(checks)]


_PAGE_COLUMNS = ["url", "status", "error", "final_url", "headers", "html"]


def probe_rows(resources: DataFrame) -> DataFrame:
    """Probed paths as small codes: (scan_id, fetched_at, path, code). Reads no body."""
    return only_kind(resources, "probe").filter(F.col("path").isin(PROBE_PATHS)).select(
        "scan_id", "fetched_at", "path", _probe_code().alias("code")
    )


def _probe_code() -> Column:
    ok = F.col("error").isNull() & F.coalesce(F.col("status") == 200, F.lit(False))
    cors = header_any_case("Access-Control-Allow-Origin").isNotNull()
    json_type = F.coalesce(
        header_any_case("Content-Type").contains("json"), F.lit(False)
    )
    gated = F.col("error").isNull() & (
        F.coalesce(F.col("status").isin(401, 403), F.lit(False))
        | F.coalesce(login_url(F.coalesce("final_url", _requested_path())), F.lit(False))
    )
    return (
        F.when(F.col("path").isin(API_PATHS), F.when(ok & cors, 2).when(ok, 1).otherwise(0))
        .when(F.col("path").isin(MCP_PATHS), (ok & json_type).cast("int"))
        .otherwise(gated.cast("int"))
    )


def _requested_path() -> Column:
    return F.concat(base_url(_requested_url()), F.col("path"))


def _latest(value: Column, keep: Column | None = None) -> Column:
    packed = F.struct(F.col("fetched_at"), value.alias("value"))
    return F.max(packed if keep is None else F.when(keep, packed))["value"]


def home_aggs() -> list[Column]:
    return [_latest(F.col("home"), F.col("home").isNotNull()).alias("home")]


def text_aggs(checks: tuple[Check, ...] = BUILTIN) -> list[Column]:
    keys = [c.key for s in TEXT_STAGES for c in of_stage(checks, s)]
    return [_latest(F.col(k), F.col(k).isNotNull()).alias(k) for k in keys]


def probe_aggs() -> list[Column]:
    """Latest code per probed path, kept in one BIGINT so that aggregation stays hash-based.

    Fetch time in microseconds is scaled to leave room for the code, which also
    settles ties between fetches of the same instant.
    """
    stamped = F.coalesce(F.unix_micros("fetched_at"), F.lit(0)) * _CODES + F.col("code")
    return [
        F.max(F.when(F.col("path") == path, stamped)).alias(_probe(slot, i))
        for slot, paths in PROBE_SLOTS.items()
        for i, path in enumerate(paths)
    ]


def _probe(slot: str, i: int) -> str:
    return f"_{slot}_{i}"


def _probe_arrays() -> list[Column]:
    def code(name: str) -> Column:
        return F.coalesce(F.pmod(F.col(name), F.lit(_CODES)), F.lit(0)).cast("int")

    return [
        F.array(*[code(_probe(slot, i)) for i in range(len(paths))]).alias(slot)
        for slot, paths in PROBE_SLOTS.items()
    ]


def _site_rows(merged: DataFrame, checks: tuple[Check, ...], extra: list[str]) -> DataFrame:
    probed = _probe_arrays() if of_stage(checks, SITE) else []
    text_keys = [c.key for s in TEXT_STAGES for c in of_stage(checks, s)]
    absent = outcome("unreachable", "not fetched")
    return merged.select(
        "scan_id",
        *extra,
        "home",
        *[F.coalesce(k, absent).cast(OUTCOME).alias(k) for k in text_keys],
        *probed,
    )


def assemble(
    resources: DataFrame, checks: tuple[Check, ...] = BUILTIN, links: bool = True, failed: bool = True
) -> DataFrame:
    """One row per scan: the judged homepage, text-file outcomes and probe codes.

    ``failed`` asks for the scans of which only other resources arrived, and for the site URL of all.

    The many probe rows aggregate apart from the few document rows: their state
    is all integers and their scan never touches the body column.
    """
    if any(of_stage(checks, s) for s in TEXT_STAGES):
        documents = document_rows(resources, checks, links)
    else:
        documents = home_rows(resources, checks, links)
    by_scan = documents.groupBy("scan_id").agg(*home_aggs(), *text_aggs(checks))
    sites, extra = by_scan, []
    if failed:
        # A scan of which any resource arrived is a scan: two narrow columns of all rows.
        scans = resources.groupBy("scan_id").agg(F.max("site_url").alias("site_url"))
        sites, extra = scans.join(by_scan, "scan_id", "left"), ["site_url"]
    if of_stage(checks, SITE):
        probes = probe_rows(resources).groupBy("scan_id").agg(*probe_aggs())
        sites = sites.join(probes, "scan_id", "left")
    return _site_rows(sites, checks, extra)


def fold_events(events: DataFrame, keys: list[str], checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """The same site rows from one stream of judged rows, grouped by ``keys``.

    Also the site URL, how many resources were taken in, and the keys of text files that never came.
    """
    text_keys = [c.key for s in TEXT_STAGES for c in of_stage(checks, s)]
    merged = events.groupBy(*keys).agg(
        *home_aggs(), *text_aggs(checks), *probe_aggs(),
        F.max("site_url").alias("site_url"), F.count("*").alias("n_resources"),
    )
    names = [F.when(F.col(k).isNull(), F.lit(k)) for k in text_keys]
    absent = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    extra = [k for k in keys if k != "scan_id"] + ["site_url", "n_resources", "absent"]
    return _site_rows(merged.withColumn("absent", absent), checks, extra)


def scannable() -> Column:
    """The homepage was fetched and did not answer with an error status."""
    home = F.col("home")
    return F.coalesce(
        home.isNotNull() & home["error"].isNull() & (home["status"] < 400), F.lit(False)
    )


def scannable_sites(sites: DataFrame) -> DataFrame:
    return sites.filter(scannable())


def failure() -> Column:
    """Why a site is not scannable."""
    home = F.col("home")
    return F.coalesce(
        home["error"],
        F.concat(F.lit("HTTP status "), home["status"].cast("string")),
        F.lit("homepage not fetched"),
    )


def scan_errors(sites: DataFrame) -> DataFrame:
    """Sites without a usable homepage, with the reason; they get no checks."""
    home = F.col("home")
    url = home["url"]
    if "site_url" in sites.columns:
        url = F.coalesce(url, normalize_url(F.col("site_url")))
    return sites.filter(~scannable()).select("scan_id", url.alias("url"), failure().alias("error"))


# --- findings -------------------------------------------------------------------------------


# Arguments that a wording can name: {0} to {8}.
MAX_ARGS = 9


def _java_format(template: str) -> str:
    if re.search(r"\{(?:9|\d\d+)\}", template):
        raise ValueError(f"a wording names at most {MAX_ARGS} arguments: {template}")
    return re.sub(r"\{(\d)\}", lambda m: f"%{int(m[1]) + 1}$s", template.replace("%", "%%"))


VERDICT = "struct<status:string,earned:int,detail:string,action:string>"


def verdicts(checks: tuple[Check, ...]) -> Column:
    """Constant map from key.reason to status, points and wording."""
    table = {
        f"{c.key}.{name}": {
            "status": r.status,
            "earned": c.points(r.status),
            "detail": _java_format(r.detail),
            "action": _java_format(r.action),
        }
        for c in checks
        for name, r in c.reasons.items()
    }
    # One JSON literal, folded to a map by the optimizer.
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{VERDICT}>")


def worded(template: Column, args: Column) -> Column:
    values = [F.coalesce(F.try_element_at(args, F.lit(i)), F.lit("")) for i in range(1, MAX_ARGS + 1)]
    return F.call_function("format_string", template, *values)


def findings_of(checks: tuple[Check, ...] = BUILTIN) -> Column:
    """The findings of a site row as an array in registry order."""
    of_home = {c.key for c in of_stage(checks, HOME)}
    of_site = {c.key: rule_of(c) for c in of_stage(checks, SITE)}

    def judged(c: Check) -> Column:
        if c.key in of_home:
            return F.col("home")[c.key]
        return of_site.get(c.key, F.col(c.key))

    raw = F.array(
        *[
            F.struct(
                F.lit(i).alias("idx"),
                F.lit(c.key).alias("key"),
                F.lit(c.label).alias("label"),
                F.lit(c.points_max).alias("max"),
                F.lit(c.effort_level).alias("level"),
                F.lit(c.effort_time).alias("time"),
                judged(c).cast(OUTCOME).alias("o"),
            )
            for i, c in enumerate(checks)
        ]
    )
    paired = raw if not checks else F.transform(
        raw,
        lambda x: F.struct(
            x.alias("x"),
            F.try_element_at(
                verdicts(checks), F.concat_ws(".", x["key"], x["o"]["reason"])
            ).alias("v"),
        ),
    )
    none = F.array().cast(f"array<{FINDING}>")
    findings = none if not checks else F.transform(
        paired,
        lambda p: F.struct(
            p["x"]["idx"].alias("check_idx"),
            p["x"]["key"].alias("key"),
            p["x"]["label"].alias("label"),
            p["v"]["status"].alias("status"),
            p["x"]["o"]["reason"].alias("reason"),
            p["v"]["earned"].alias("points_earned"),
            p["x"]["max"].alias("points_max"),
            (p["x"]["max"] - p["v"]["earned"]).alias("points_lost"),
            worded(p["v"]["detail"], p["x"]["o"]["args"]).alias("detail"),
            worded(p["v"]["action"], p["x"]["o"]["args"]).alias("action"),
            p["x"]["level"].alias("effort_level"),
            p["x"]["time"].alias("effort_time"),
        ),
    )
    return findings


def with_checks(sites: DataFrame, checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """Add ``checks``: the findings of each scannable site as an array in registry order."""
    home = F.col("home")
    of_home = {c.key for c in of_stage(checks, HOME)}
    for_links = []
    if "links" in sites.schema["home"].dataType.names:
        own_page = [home[k].alias(k) for k in PAGE_RULES if k in of_home]
        for_links = [
            home["status"].alias("home_status"), home["links"].alias("links"), F.struct(*own_page).alias("page"),
        ]
    return scannable_sites(sites).select(
        "scan_id", home["url"].alias("url"), findings_of(checks).alias("checks"), *for_links
    )


def check_results(audited: DataFrame) -> DataFrame:
    """Long form: one row per scan and check."""
    return audited.select("scan_id", "url", F.inline("checks"))


def audit(
    resources: DataFrame, checks: tuple[Check, ...] = BUILTIN, links: bool = False
) -> DataFrame:
    """Resources to audited sites; ``links`` keeps what sub-page audits need."""
    return with_checks(assemble(resources, checks, links, failed=False), checks)
