"""Registry of verification queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.operators import audit, subpages
from crawlgauge.operators.signals import PAGE_RULES, page_facts
from crawlgauge.plans.session import configure, materialize
from crawlgauge.registry import BUILTIN
from verification import fixtures as fx
from verification import oracle


class Data:
    """The tables a query may start from: lazy plans, each built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    @cached_property
    def pages(self) -> DataFrame:
        return fx.pages(self.spark, self.sf_dir)

    @cached_property
    def resources(self) -> DataFrame:
        return fx.resources(self.pages)

    @cached_property
    def homes(self) -> DataFrame:
        """Homepages after the fixture snippets, as (scan_id, url, html)."""
        return fx.homes(self.pages).withColumnRenamed("page_id", "scan_id")

    @cached_property
    def facts(self) -> DataFrame:
        return page_facts(self.homes)

    @cached_property
    def audited(self) -> DataFrame:
        """Audited sites without sub-page links."""
        return audit.audit(self.resources)

    def results_of(self, *keys: str) -> DataFrame:
        """Results of some checks only; nothing else is read or extracted."""
        checks = tuple(c for c in BUILTIN if c.key in keys)
        return audit.check_results(audit.audit(self.resources, checks))

    def stored(self) -> DataFrame:
        """Audited sites written to the shared folder, for queries that read them twice."""
        return materialize(audit.audit(self.resources, links=True), "audited")

    @cached_property
    def results(self) -> DataFrame:
        return audit.check_results(self.audited)

    @cached_property
    def errors(self) -> DataFrame:
        return audit.scan_errors(audit.assemble(self.resources, (), links=False))

    @cached_property
    def linked(self) -> DataFrame:
        """Audited sites with links, for the checks a sub-page shares with its homepage."""
        checks = tuple(c for c in BUILTIN if c.key in PAGE_RULES)
        return audit.audit(self.resources, checks, links=True)

    @property
    def subpages(self) -> DataFrame:
        """Audited sub-pages; the homepages with their links are stored, being read twice."""
        return subpages.audit_subpages(materialize(self.linked, "linked"), self.resources)

    def of_path(self, path: str) -> DataFrame:
        return self.resources.filter(F.col("path") == path)


_SHARED: dict[tuple, Data] = {}


def shared_data(spark: SparkSession, sf_dir: str) -> Data:
    """One Data per session and folder. It holds plans only, so no rows are kept between queries."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _SHARED:
        _SHARED[key] = Data(spark, sf_dir)
    return _SHARED[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Data under ``name`` with the SQL that must agree with it."""

    def register(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(shared_data(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle.sql(sql)
        return fn

    return register
