"""robots.txt: which tracked AI crawlers are shut out of the whole site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgauge.functions.text import split_lines, str_array, strip

# Crawlers looked for in robots.txt.
AI_BOTS = ["GPTBot", "ClaudeBot", "anthropic-ai", "PerplexityBot", "ChatGPT-User"]
# Marker used when the wildcard group is blocked.
ALL_AGENTS = "*"


def _value(line: Column) -> Column:
    return strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))


def directives(body: Column) -> Column:
    """User-agent and Disallow lines as structs (is_agent, value), in file order."""
    lines = F.transform(split_lines(body), strip)
    relevant = F.filter(lines, lambda l: l.rlike("(?i)^(user-agent|disallow):"))
    return F.transform(
        relevant,
        lambda l: F.struct(
            l.rlike("(?i)^user-agent:").alias("is_agent"), _value(l).alias("value")
        ),
    )


def robots_blocked(body: Column) -> Column:
    """Sorted distinct blocked names; ``*`` stands for the wildcard group.

    A User-agent line replaces the current agent, so in a grouped block only the
    last agent is affected by the Disallow lines that follow.
    """

    start = F.struct(
        F.lit(None).cast("string").alias("agent"), str_array([]).alias("blocked")
    )

    def step(acc: Column, d: Column) -> Column:
        blocks = ~d["is_agent"] & d["value"].isin("/", "/*") & acc["agent"].isNotNull()
        return F.struct(
            F.when(d["is_agent"], d["value"]).otherwise(acc["agent"]).alias("agent"),
            F.when(blocks, F.array_union(acc["blocked"], F.array(acc["agent"])))
            .otherwise(acc["blocked"])
            .alias("blocked"),
        )

    agents = F.aggregate(directives(body), start, step, lambda acc: acc["blocked"])
    lowered = F.transform(agents, F.lower)
    bots = F.filter(str_array(AI_BOTS), lambda b: F.array_contains(lowered, F.lower(b)))
    wildcard = F.filter(str_array([ALL_AGENTS]), lambda a: F.array_contains(agents, a))
    return F.array_sort(F.concat(wildcard, bots))
