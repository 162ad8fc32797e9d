"""Sources: crawled pages, crawled resources, and the list of URLs a crawl has to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.functions.outcomes import API_PATHS, KEY_PATHS, MCP_PATHS
from crawlgauge.functions.urls import base_url, normalize_url
from crawlgauge.sources import schemas

HOME_PATH, ROBOTS_PATH, LLMS_PATH, SITEMAP_PATH = "/", "/robots.txt", "/llms.txt", "/sitemap.xml"
TEXT_PATHS = [ROBOTS_PATH, LLMS_PATH, SITEMAP_PATH]
PROBE_PATHS = [*API_PATHS, *KEY_PATHS, *MCP_PATHS]

# Fetch timeouts in seconds, by path.
TIMEOUTS = (
    {HOME_PATH: 10, ROBOTS_PATH: 6, LLMS_PATH: 6}
    | {p: 4 for p in API_PATHS}
    | {SITEMAP_PATH: 6}
    | {p: 5 for p in KEY_PATHS}
    | {p: 4 for p in MCP_PATHS}
)


def page_scan(spark: SparkSession, path: str) -> DataFrame:
    """Homepage snapshots stored as Parquet."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share a scan of few row groups out over all cores before CPU-heavy work.

    A file has as many splits as its bytes ask for, but the rows of a row group are all read by one of them: what
    counts is how many splits hold rows, which a count that reads no column tells. Reading is left alone wherever
    there is one for each core, which is every large table of ordinary row groups: bodies are then never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        busy = df.groupBy(F.spark_partition_id().alias("split")).count().count()
        if busy >= cores:
            return df
    return df.repartition(cores, key)


def resource_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetched resources stored as Parquet, ORC or JSON lines; filters on ``path`` reach the files."""
    return spark.read.format(fmt).schema(schemas.RESOURCES).load(path)


def resource_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The same table, with the start of each scan, read as a stream of arriving files."""
    return (
        spark.readStream.schema(schemas.ARRIVING)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def fetch_frontier(requests: DataFrame) -> DataFrame:
    """One row per URL a scan needs; the crawler that fetches them is outside this library."""
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("path_idx"), F.lit(p).alias("path"), F.lit(t).alias("timeout_s"))
            for i, (p, t) in enumerate(TIMEOUTS.items())
        ]
    )
    site = requests.select("scan_id", normalize_url(F.col("url")).alias("site"))
    rooted = site.select("scan_id", "site", base_url(F.col("site")).alias("base"), F.inline(wanted))
    target = F.when(F.col("path") == HOME_PATH, F.col("site")).otherwise(F.concat("base", "path"))
    return rooted.select("scan_id", "path_idx", "path", target.alias("url"), "timeout_s")


def kind_of(path: Column) -> Column:
    """The kind a resource is stored under."""
    return (
        F.when(path == HOME_PATH, "home")
        .when(path.isin(TEXT_PATHS), "text")
        .when(path.isin(PROBE_PATHS), "probe")
        .otherwise("page")
    )


def write_resources(resources: DataFrame, path: str, mode: str = "append") -> None:
    """Store resources so that audits read little: split by kind, clustered by path within files.

    Homepages and text files keep their bodies apart from the many small probes,
    whose bodies no check reads.
    """
    (
        resources.withColumn("kind", kind_of(F.col("path")))
        .sortWithinPartitions("kind", "path")
        .write.mode(mode)
        .partitionBy("kind")
        .parquet(path)
    )


def write_site_table(resources: DataFrame, name: str, path: str, buckets: int) -> None:
    """Store resources as a catalog table split by kind and bucketed by scan.

    Bodies move once, when they are stored; audits of the table then bring the rows of a scan together without any
    exchange, as all kinds of a scan lie in the bucket of its id. A bucket should fit a task: about a gigabyte.
    A scan that was fetched very often makes its bucket larger, never wrong.
    """
    (
        resources.select(*_columns(resources), kind_of(F.col("path")).alias("kind"))
        .repartition(buckets, "scan_id")
        .sortWithinPartitions("kind", "scan_id")
        .write.mode("overwrite")
        .partitionBy("kind")
        .bucketBy(buckets, "scan_id")
        .sortBy("scan_id")
        .option("path", path)
        .saveAsTable(name)
    )


def _columns(resources: DataFrame) -> list[str]:
    return [c.split()[0] for c in schemas.RESOURCES.split(", ") if c.split()[0] in resources.columns]


def site_table(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """A table of ``write_site_table``; it is entered into the catalog if another session stored it."""
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} ({schemas.RESOURCES}, kind STRING) USING parquet OPTIONS (path '{path}') "
            f"PARTITIONED BY (kind) CLUSTERED BY (scan_id) SORTED BY (scan_id) INTO {int(buckets)} BUCKETS"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)
