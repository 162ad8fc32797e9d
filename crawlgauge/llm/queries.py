"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.llm import alignment, bpe, decision_list, decontaminate, html_density, jaccard_join, lm, packing, pii_crf, search, sharding, token_files, weak_labels
from crawlgauge.llm.common import arrow_batches, materialize, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all texts."""
    arrow_batches(spark)
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a scorer trained on posterior labels."""
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_labels.classify(docs).select("doc_id", "score", "kept")


@query
def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, and the verdict of the rules learned from the labelled ones."""
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.learn_from(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules).select("doc_id", *decision_list.COUNTS, "base_failed", "kept")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the bytes they decode to, as digests."""
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    encoded = docs.select("doc_id", bpe.encode(F.col("text")).alias("ids"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


@query
def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    arrow_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_density.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE["op6_winnowing"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s
        FROM (SELECT *, least(13, len(w)) AS n FROM i WHERE len(w) > 0))
),
dw AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
hit AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (n, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""


@query
def op7_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    arrow_batches(spark)
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    placed = sharding.shard_documents(docs, n_shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the fixed patterns, and the spans that the CRF adds."""
    arrow_batches(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", pii_crf.find(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        own = F.filter("found", lambda s: s["base"] & (s["kind"] == kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("email", "ip", "card", "phone")),
        F.sha2(_joined_spans(base), 256).alias("base_sha256"),
        _joined_spans(F.col("found")).alias("spans"),
    )


@query
def op10_ranked_varbytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    arrow_batches(spark, 4000)
    folder = scratch_path(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), folder)
    return token_files.read_files(spark, folder, digest=True)


@query
def op11_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, and how common the links are."""
    arrow_batches(spark)
    aligned = alignment.align_documents(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    stored = materialize(
        aligned.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()),
        "aligned",
    )
    return alignment.with_link_counts(stored).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query
def op12_term_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    arrow_batches(spark)
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = _WORDS.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")
ORACLE["op12_term_owners"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
stats AS (SELECT count(*) AS nd, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY ALL),
s AS (
  SELECT q, r, CAST(sum(qtf * CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * nd) // l)))) AS BIGINT) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r), stats GROUP BY q, r
),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
      FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 10
"""


@query
def op13_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 4096 tokens."""
    arrow_batches(spark, 4000)
    placed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
