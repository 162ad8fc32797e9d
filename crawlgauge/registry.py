"""The ordered list of checks: points, effort, reasons and the wording of findings.

A reason decides the status of a check and the text shown for it. ``{0}`` and
so on in a text stand for the arguments the rule attaches to its outcome.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession

PASS, WARNING, FAIL = "pass", "warning", "fail"
NOTHING = "Nothing to do."

# Where a rule is evaluated: on the homepage row, on the row of one text file,
# or on the assembled site row.
HOME, ROBOTS, LLMS, SITEMAP, SITE = "home", "robots", "llms", "sitemap", "site"


@dataclass(frozen=True)
class Reason:
    status: str
    detail: str
    action: str = NOTHING


@dataclass(frozen=True)
class Check:
    key: str
    label: str
    points_max: int
    effort_level: str
    effort_time: str
    stage: str
    reasons: dict[str, Reason]
    rule: Callable[[], Column] | None = None

    def points(self, status: str) -> int:
        """Full points for a pass, half rounded down for a warning, none for a fail."""
        return {PASS: self.points_max, WARNING: self.points_max // 2, FAIL: 0}[status]


# Any rule may give up on a page; the page then gets half points.
EXCEPTION = "check_exception"
_GAVE_UP = Reason(WARNING, "The check could not be completed: {0}.", "")
_JSONLD_ADVICE = (
    "Publish a JSON-LD block in the page head. FAQPage, Product and SoftwareApplication "
    "tell an agent most about what is on offer."
)
_SSR_ADVICE = (
    "Render the important content on the server or at build time, then confirm it with "
    "the browser's view-source."
)
_LLMS_ADVICE = (
    "Write /llms.txt in Markdown: a '# ' title, a '> ' summary of the business, and links "
    "to the main pages."
)


def _check(key, label, points, level, time, stage, **reasons) -> Check:
    return Check(key, label, points, level, time, stage, {**reasons, EXCEPTION: _GAVE_UP})


# Keys, labels, points and effort of the built-in checks, in report order.
BUILTIN: tuple[Check, ...] = (
    _check(
        "ai_crawler_access", "AI Crawler Access", 20, "Easy", "15 min", ROBOTS,
        no_file=Reason(PASS, "There is no robots.txt, so nothing keeps crawlers out."),
        blocked=Reason(
            FAIL,
            "robots.txt shuts these agents out of the whole site: {0}.",
            "Drop the site-wide Disallow for them, or add an Allow group for each AI crawler.",
        ),
        open=Reason(PASS, "robots.txt admits every tracked AI crawler ({0})."),
        unreachable=Reason(
            WARNING,
            "robots.txt could not be read: {0}.",
            "Check that /robots.txt answers publicly.",
        ),
    ),
    _check(
        "llms_txt", "llms.txt File", 15, "Easy", "1 hour", LLMS,
        missing=Reason(FAIL, "The site publishes no llms.txt for language models.", _LLMS_ADVICE),
        empty=Reason(FAIL, "llms.txt is there but has no content.", _LLMS_ADVICE),
        structured=Reason(PASS, "llms.txt is laid out well; it has: {0}."),
        unstructured=Reason(
            WARNING,
            "llms.txt has text but little structure, so models may misread it.",
            "Add what is missing: {1}.",
        ),
        sparse=Reason(
            WARNING, "llms.txt is too short to explain the business.", _LLMS_ADVICE
        ),
        unreachable=Reason(FAIL, "llms.txt could not be read: {0}.", _LLMS_ADVICE),
    ),
    _check(
        "structured_data", "Structured Data (JSON-LD / Schema.org)", 20, "Medium", "2-4 hours", HOME,
        none=Reason(
            FAIL, "The page declares no structured data about the business.", _JSONLD_ADVICE
        ),
        og_only=Reason(WARNING, "Open Graph tags only; no JSON-LD.", _JSONLD_ADVICE),
        high_value=Reason(PASS, "JSON-LD declares types agents can act on: {0}.{1}{2}"),
        generic_only=Reason(
            WARNING,
            "JSON-LD declares only types that name the site: {0}.",
            "Keep these and add types that describe products, prices, questions or contacts.",
        ),
    ),
    _check(
        "js_rendering", "JavaScript Rendering (SSR Check)", 15, "Hard", "developer needed", HOME,
        empty_csr=Reason(
            FAIL,
            "Only {0} characters of text next to {1} script(s): the page is built in the browser.",
            _SSR_ADVICE,
        ),
        spa_thin=Reason(
            WARNING,
            "An application root (id '{1}') holds a page with only {0} characters of text.",
            _SSR_ADVICE,
        ),
        ssr=Reason(PASS, "{0} characters of text can be read without running scripts."),
    ),
    _check(
        "pricing_parsability", "Pricing Parsability", 15, "Medium", "2-4 hours", HOME,
        markup=Reason(PASS, "Prices carry itemprop markup."),
        text_only=Reason(
            WARNING,
            "{0} price(s) in the text, none with markup.",
            "Mark prices up with itemprop price and priceCurrency.",
        ),
        none=Reason(
            FAIL,
            "No price can be read from the page source.",
            "Show at least one price, or the pricing model, in the static page.",
        ),
    ),
    _check(
        "contact_parsability", "Contact Info Parsability", 10, "Easy", "30 min", HOME,
        found=Reason(PASS, "Contact details are in the text: {0}."),
        none=Reason(
            FAIL,
            "The text holds neither an e-mail address nor a phone number.",
            "Write an e-mail address or phone number out in the page footer.",
        ),
    ),
    _check(
        "api_discoverability", "API Discoverability & CORS", 10, "Hard", "developer needed", SITE,
        found_cors=Reason(PASS, "API descriptions open to other origins: {0}."),
        found_no_cors=Reason(
            WARNING,
            "API descriptions without CORS headers: {0}.",
            "Send Access-Control-Allow-Origin with these responses.",
        ),
        none=Reason(
            FAIL,
            "No API description at the usual places.",
            "Publish /openapi.json, or at least an ai-plugin.json with a contact URL.",
        ),
    ),
    _check(
        "sitemap", "Sitemap.xml", 10, "Easy", "30 min", SITEMAP,
        ok=Reason(PASS, "sitemap.xml lists {0} URL(s)."),
        malformed=Reason(
            WARNING,
            "sitemap.xml answers but lists no URL.",
            "Generate the sitemap again and validate it.",
        ),
        missing=Reason(
            FAIL,
            "There is no sitemap.xml.",
            "Generate one and name it in robots.txt.",
        ),
        unreachable=Reason(
            FAIL, "sitemap.xml could not be read: {0}.", "Check that /sitemap.xml answers publicly."
        ),
    ),
    _check(
        "cookie_consent_wall", "Cookie Consent Wall", 10, "Medium", "1-2 hours", HOME,
        cmp=Reason(
            WARNING,
            "A consent manager is in place ({0}); content behind it stays hidden from crawlers.",
            "Keep the main content in the static page, outside consent-gated scripts.",
        ),
        none=Reason(PASS, "No consent manager found in the page source."),
    ),
    _check(
        "content_freshness", "Content Freshness Headers", 10, "Easy", "30 min", HOME,
        both=Reason(PASS, "Last-Modified and ETag are both sent."),
        lm_only=Reason(WARNING, "Last-Modified is sent, ETag is not.", "Turn ETag on."),
        etag_only=Reason(
            WARNING, "ETag is sent, Last-Modified is not.", "Turn Last-Modified on."
        ),
        none=Reason(
            FAIL,
            "Neither Last-Modified nor ETag is sent.",
            "Turn both headers on in the web server or CDN.",
        ),
    ),
    _check(
        "auth_wall", "Authentication Wall", 15, "Medium", "varies", SITE,
        redirected=Reason(
            FAIL,
            "The homepage leads to a sign-in page: {0}.",
            "Serve the public pages without a sign-in.",
        ),
        gated_home=Reason(
            FAIL,
            "The homepage is a sign-in form with hardly any text.",
            "Serve an overview, prices and product pages without a sign-in.",
        ),
        gated_sub=Reason(
            WARNING,
            "Sign-in is required for: {0}.",
            "Offer at least a summary of these pages in public.",
        ),
        login_form=Reason(
            WARNING,
            "The homepage holds a sign-in form.",
            "Make sure prices, products and contacts need no sign-in.",
        ),
        open=Reason(PASS, "Neither the homepage nor the usual sub-pages ask for a sign-in."),
    ),
    _check(
        "mcp_discoverability", "MCP Agent Endpoint", 10, "Hard", "developer needed", SITE,
        found=Reason(PASS, "MCP manifest at: {0}."),
        none=Reason(
            FAIL,
            "No MCP manifest at the usual places.",
            "Publish /.well-known/mcp.json naming the tools an agent may call.",
        ),
    ),
)


def register_check(checks: tuple[Check, ...], check: Check) -> tuple[Check, ...]:
    """The registry with one more check at the end; totals and order follow from it."""
    if any(c.key == check.key for c in checks):
        raise ValueError(f"duplicate check key: {check.key}")
    if check.rule is None:
        raise ValueError("a registered check needs a rule")
    return (*checks, replace(check, reasons={**check.reasons, EXCEPTION: _GAVE_UP}))


def max_total(checks: tuple[Check, ...] = BUILTIN) -> int:
    return sum(c.points_max for c in checks)


DIM_SCHEMA = (
    "check_idx int, key string, label string, points_max int, effort_level string, effort_time string"
)


def check_dim(spark: SparkSession, checks: tuple[Check, ...] = BUILTIN) -> DataFrame:
    """The registry as a dimension table (one row per check, so always safe to broadcast)."""
    rows = [
        (i, c.key, c.label, c.points_max, c.effort_level, c.effort_time)
        for i, c in enumerate(checks)
    ]
    return spark.createDataFrame(rows, DIM_SCHEMA)
