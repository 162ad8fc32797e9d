"""The check rules: each turns the columns of one row into an outcome (reason, args)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgauge.functions import jsonld, robots, textrules
from crawlgauge.functions.text import str_array, strip
from crawlgauge.functions.urls import login_url

OUTCOME = "struct<reason:string,args:array<string>>"

# Thresholds of visible text, in characters.
EMPTY_TEXT, THIN_TEXT, SPARSE_LLMS = 200, 600, 80

# Paths probed for API descriptions, for sign-in walls and for MCP manifests.
API_PATHS = [
    "/openapi.json", "/swagger.json", "/api/docs",
    "/api-docs", "/.well-known/ai-plugin.json", "/.well-known/openai.json",
]
KEY_PATHS = ["/pricing", "/plans", "/docs", "/documentation"]
MCP_PATHS = ["/.well-known/mcp.json", "/mcp/manifest.json", "/.well-known/agent.json"]


def outcome(reason: str, *args: Column | str) -> Column:
    if not args:
        return F.expr(f"named_struct('reason', '{reason}', 'args', cast(array() as array<string>))")
    values = [F.lit(a) if isinstance(a, str) else a.cast("string") for a in args]
    return F.struct(F.lit(reason).alias("reason"), F.array(*values).alias("args"))


def choose(*branches: tuple[Column, Column], otherwise: Column) -> Column:
    """First branch whose condition holds."""
    (cond, value), *rest = branches
    chain = F.when(cond, value)
    for cond, value in rest:
        chain = chain.when(cond, value)
    return chain.otherwise(otherwise)


def _joined(names: Column) -> Column:
    return F.array_join(names, ", ")


def _failed() -> Column:
    return F.col("error").isNotNull()


def _answered() -> Column:
    return F.coalesce(F.col("status") == 200, F.lit(False))


# --- rules on one text file: columns status, error, body -------------------------------


def ai_crawler_access() -> Column:
    blocked = robots.robots_blocked(F.coalesce("body", F.lit("")))
    return choose(
        (_failed(), outcome("unreachable", F.col("error"))),
        (~_answered(), outcome("no_file")),
        (F.size(blocked) > 0, outcome("blocked", _joined(blocked))),
        otherwise=outcome("open", ", ".join(robots.AI_BOTS)),
    )


def llms_txt() -> Column:
    body = F.coalesce("body", F.lit(""))
    content = strip(body)
    found = textrules.llms_structure(body)
    parts = (_joined(found), F.array_join(textrules.llms_missing(found), "; "))
    return choose(
        (_failed(), outcome("unreachable", F.col("error"))),
        (~_answered(), outcome("missing")),
        (content == "", outcome("empty")),
        (F.size(found) >= 2, outcome("structured", *parts)),
        (F.char_length(content) > SPARSE_LLMS, outcome("unstructured", *parts)),
        otherwise=outcome("sparse", *parts),
    )


def sitemap() -> Column:
    n = textrules.sitemap_url_count(F.coalesce("body", F.lit("")))
    return choose(
        (_failed(), outcome("unreachable", F.col("error"))),
        (_answered() & (n > 0), outcome("ok", n)),
        (_answered(), outcome("malformed")),
        otherwise=outcome("missing"),
    )


# --- rules on a page: columns of operators.signals.page_facts ------------------------------


def structured_data() -> Column:
    items = F.col("ld_items")
    high, generic = F.col("ld_high"), F.col("ld_generic")
    also = F.when(
        F.size(generic) > 0, F.concat(F.lit(" Naming types too: "), _joined(generic), F.lit("."))
    ).otherwise(F.lit(""))
    og = F.when(F.col("has_og_title"), F.lit(" Open Graph tags too.")).otherwise(F.lit(""))
    shown = F.when(F.size(generic) > 0, generic).otherwise(jsonld.jsonld_types(items))
    ungradable = jsonld.has_unhashable(items) | (
        (F.size(high) == 0) & (F.size(generic) == 0) & jsonld.has_nonstring(items)
    )
    return choose(
        ((F.size(items) == 0) & F.col("has_og_title"), outcome("og_only")),
        (F.size(items) == 0, outcome("none")),
        (ungradable, outcome("check_exception", "a declared type is not a name")),
        (F.size(high) > 0, outcome("high_value", _joined(high), also, og)),
        otherwise=outcome("generic_only", _joined(shown)),
    )


def js_rendering() -> Column:
    n = F.col("text_len_body")
    return choose(
        (
            (n < EMPTY_TEXT) & (F.col("script_count") > 0),
            outcome("empty_csr", n, F.col("script_count")),
        ),
        (
            F.col("csr_root").isNotNull() & (n < THIN_TEXT),
            outcome("spa_thin", n, F.col("csr_root")),
        ),
        otherwise=outcome("ssr", n),
    )


def pricing_parsability() -> Column:
    return choose(
        (F.col("has_itemprop_price"), outcome("markup")),
        (F.col("n_prices") > 0, outcome("text_only", F.col("n_prices"))),
        otherwise=outcome("none"),
    )


def contact_parsability() -> Column:
    def part(n: str, what: str) -> Column:
        return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {what}")))

    found = F.array_compact(
        F.array(part("n_emails", "readable mail contacts"), part("n_phones", "readable phone contacts"))
    )
    return choose((F.size(found) > 0, outcome("found", _joined(found))), otherwise=outcome("none"))


def cookie_consent_wall() -> Column:
    providers = F.col("providers")
    return choose((F.size(providers) > 0, outcome("cmp", _joined(providers))), otherwise=outcome("none"))


def _header(*names: str) -> Column:
    """First non-empty header under the given spellings (lookups are case-sensitive)."""
    return F.coalesce(
        *[F.nullif(F.try_element_at("headers", F.lit(n)), F.lit("")) for n in names]
    )


def header_any_case(name: str) -> Column:
    """Value of a header under any spelling; NULL if absent or empty."""
    hits = F.map_filter("headers", lambda k, v: (F.lower(k) == name.lower()) & (v != ""))
    return F.try_element_at(F.map_values(hits), F.lit(1))


def content_freshness() -> Column:
    lm = _header("Last-Modified", "last-modified").isNotNull()
    etag = _header("ETag", "etag").isNotNull()
    return choose(
        (lm & etag, outcome("both")),
        (lm, outcome("lm_only")),
        (etag, outcome("etag_only")),
        otherwise=outcome("none"),
    )


# --- rules on the assembled site row: columns home, api, gated, mcp -------------------------


def named_hits(codes: Column, paths: list[str], at_least: int = 1) -> Column:
    """Paths whose probe code reaches ``at_least``, in probe order."""
    pairs = F.arrays_zip(str_array(paths).alias("path"), codes.alias("code"))
    return F.transform(F.filter(pairs, lambda p: p["code"] >= at_least), lambda p: p["path"])


def api_discoverability() -> Column:
    found = named_hits(F.col("api"), API_PATHS)
    cors = F.exists("api", lambda c: c >= 2)
    return choose(
        (cors, outcome("found_cors", _joined(found))),
        (F.size(found) > 0, outcome("found_no_cors", _joined(found))),
        otherwise=outcome("none"),
    )


def auth_wall() -> Column:
    home, gated = F.col("home"), named_hits(F.col("gated"), KEY_PATHS)
    return choose(
        (login_url(home["final_url"]), outcome("redirected", home["final_url"])),
        (home["has_password"] & (home["text_len_all"] < THIN_TEXT), outcome("gated_home")),
        (F.size(gated) > 0, outcome("gated_sub", _joined(gated))),
        (home["has_password"], outcome("login_form")),
        otherwise=outcome("open"),
    )


def mcp_discoverability() -> Column:
    found = named_hits(F.col("mcp"), MCP_PATHS)
    return choose((F.size(found) > 0, outcome("found", _joined(found))), otherwise=outcome("none"))


BUILTIN_RULES = {
    "ai_crawler_access": ai_crawler_access,
    "llms_txt": llms_txt,
    "structured_data": structured_data,
    "js_rendering": js_rendering,
    "pricing_parsability": pricing_parsability,
    "contact_parsability": contact_parsability,
    "api_discoverability": api_discoverability,
    "sitemap": sitemap,
    "cookie_consent_wall": cookie_consent_wall,
    "content_freshness": content_freshness,
    "auth_wall": auth_wall,
    "mcp_discoverability": mcp_discoverability,
}
