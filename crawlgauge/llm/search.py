"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners by how common they are, the rarest first. Items travel in bundles from owner to owner; at each
stage the accumulators that a bundle carries (partial integer scores of documents) are cogrouped with the owner's
postings, and contributions are added. After the last owner the best documents of every item are selected.

Documents come in blocks of bounded size, as read, so a stage works on one bundle in one block: a small dense table
of scores, whatever the size of the corpus or the number of postings of a term. The index is written once:

  block, term, docs, tfs, ns     documents of the block that hold a term, how often, and their lengths
  block, -1, docs, doc_ids, ns   all documents of the block

Accumulators stay few without losing a result. A term adds at most its weight times LARGEST. With ``rest`` the most
that later owners can add to an item, and ``theta`` the score of its k-th best document so far, a document with less
than ``theta - rest`` can no longer come among the k best, nor can one that no owner has scored yet once
``theta > rest``. Documents that reach the bound exactly stay, as ties are settled by doc_id.

Items are searched in sets whose terms fit VOCABULARY, so what tasks are sent is bounded; one set is usual.

Defined cases: null and empty texts, and texts without terms, are found by no item and find nothing; rows that share
an item_id or a doc_id are items and documents of their own (of equal doc_ids and scores any comes first); empty
tables give no rows; further columns do not matter. Long texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crawlgauge.llm.common import materialize

# Documents an item is answered with.
BEST = 10
# Owners by the largest share of all documents that hold one of their terms.
OWNERS = (0.005, 0.05, 1.0)
# Documents, and entries of postings, of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 2_000_000
# Items of a bundle, on average.
BUNDLE_ITEMS = 128
# Terms of items that a task is sent, on average.
VOCABULARY = 200_000
# No term counts for more than its weight times this: 10^9 * tf / (1000 * tf + 8 * m) stays below.
LARGEST = 1_000_000

_ACCUMULATORS = "bundle int, block long, item long, doc int, score long"
# Separators to spaces and A-Z to a-z; all bytes of other characters belong to words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text, A-Z lower-cased, repeats included."""
    return text.encode().translate(_FOLD).split() if text else []


# --- items ------------------------------------------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
            found = terms_of(text)
            rows += [(item, item_id, term.decode(), found.count(term)) for term in dict.fromkeys(found)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = [pa.int64(), batch.schema.field("item_id").type, pa.string(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "item_id", "term", "qtf"])


def item_terms(items: DataFrame) -> DataFrame:
    """Terms of all items with how often each occurs: item (a number per row), item_id, term, qtf."""
    kind = items.schema["item_id"].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return numbered.mapInArrow(_item_terms, f"item long, item_id {kind}, term string, qtf long")


# --- index ------------------------------------------------------------------------------------


def _block_rows(block: int, ids: list[list[int]], lengths: list[int], doc_ids: list[pa.Array]) -> pa.RecordBatch:
    n_docs = len(lengths)
    counts = np.fromiter(map(len, ids), np.int64, n_docs)
    flat = np.fromiter((i for own in ids for i in own), np.int64, int(counts.sum()))
    keys, tfs = np.unique(flat * n_docs + np.repeat(np.arange(n_docs), counts), return_counts=True)
    terms, docs = keys // n_docs, keys % n_docs
    first = np.flatnonzero(np.diff(terms, prepend=-1))
    # The documents themselves come last, under the term -1.
    offsets = pa.array(np.concatenate([first, [len(keys), len(keys) + n_docs]]).astype(np.int32))
    all_docs = np.arange(n_docs)
    ns = np.array(lengths, np.int64)
    known = pa.chunked_array(doc_ids).combine_chunks()
    id_offsets = np.zeros(len(first) + 2, np.int32)
    id_offsets[-1] = n_docs

    def lists(postings: np.ndarray, of_docs: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([postings, of_docs]).astype(np.int32)))

    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first) + 1, block)),
            pa.array(np.append(terms[first], -1).astype(np.int32)),
            lists(docs, all_docs),
            lists(tfs, np.zeros(n_docs, np.int64)),
            lists(ns[docs], ns),
            pa.ListArray.from_arrays(pa.array(id_offsets), known),
        ],
        ["block", "term", "docs", "tfs", "ns", "doc_ids"],
    )


def _index(numbers: dict[bytes, int], block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: list[list[int]] = []
        lengths: list[int] = []
        doc_ids: list[pa.Array] = []
        held = 0
        for batch in batches:
            for a in range(0, batch.num_rows, block_docs):
                part = batch.slice(a, block_docs)
                if ids and (len(ids) + part.num_rows > block_docs or held > BLOCK_POSTINGS):
                    yield _block_rows(block, ids, lengths, doc_ids)
                    block, ids, lengths, doc_ids, held = block + 1, [], [], [], 0
                doc_ids.append(part.column("doc_id"))
                for text in part.column("text"):
                    found = terms_of(text.as_py())
                    own = [n for n in map(numbers.get, found) if n is not None]
                    ids.append(own)
                    lengths.append(len(found))
                    held += len(own)
        if ids:
            yield _block_rows(block, ids, lengths, doc_ids)

    return run


def index_documents(docs: DataFrame, terms: list[str], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Postings of the given terms, numbered in their order, and the documents, in blocks. Blocks are distinct within
    one evaluation: store the table before using them."""
    numbers = {t.encode(): n for n, t in enumerate(terms)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _index(numbers, block_docs),
        f"block long, term int, docs array<int>, tfs array<int>, ns array<int>, doc_ids array<{kind}>",
    )


# --- stages -----------------------------------------------------------------------------------


def _add_owner(n_docs: int, n_terms: int, best: int):
    """Add an owner's contributions to the accumulators of one bundle in one block."""

    def run(key: tuple, carried: pa.Table, postings: pa.Table) -> pa.Table:
        def flat(column: str) -> np.ndarray:
            return postings.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)

        item, doc, score = (carried.column(c).to_numpy() for c in ("item", "doc", "score"))
        # What the items of the bundle need: one entry per item.
        wanted, first = np.unique(flat("items"), return_index=True)
        admits, floor, rest = (flat(c)[first] for c in ("admits", "floors", "rests"))
        items = np.union1d(item, wanted)
        docs, tfs, ns = flat("docs"), flat("tfs").astype(np.int64), flat("ns").astype(np.int64)
        width = 1 + max(int(doc.max(initial=-1)), int(docs.max(initial=-1)))
        table = np.zeros((len(items), width), np.int64)
        table[np.searchsorted(items, item), doc] = score
        held = table > 0
        share = 10**9 * tfs // (1000 * tfs + 8 * (25 + 75 * ns * n_docs // max(1, n_terms)))
        rows, weights = np.searchsorted(items, flat("items")), flat("weights")
        ends_p = np.cumsum(postings.column("docs").combine_chunks().value_lengths().to_numpy())
        ends_i = np.cumsum(postings.column("items").combine_chunks().value_lengths().to_numpy())
        start_p = start_i = 0
        for end_p, end_i in zip(ends_p.tolist(), ends_i.tolist(), strict=True):
            # One term: a document occurs once in its postings.
            own, added = docs[start_p:end_p], share[start_p:end_p]
            for i in range(start_i, end_i):
                table[rows[i], own] += weights[i] * added
            start_p, start_i = end_p, end_i
        at = np.searchsorted(items, wanted)
        closed = at[~admits]
        table[closed] = np.where(held[closed], table[closed], 0)
        # The k-th best here bounds the k-th best anywhere from below.
        if width >= best:
            floor = np.maximum(floor, np.partition(table[at], width - best, axis=1)[:, width - best])
        table[at] = np.where(table[at] >= (floor - rest)[:, None], table[at], 0)
        i, d = np.nonzero(table)
        n = len(i)
        return pa.table(
            {
                "bundle": pa.array(np.full(n, key[0].as_py(), np.int32)),
                "block": pa.array(np.full(n, key[1].as_py(), np.int64)),
                "item": pa.array(items[i]),
                "doc": pa.array(d.astype(np.int32)),
                "score": pa.array(table[i, d]),
            }
        )

    return run


def _best_of(scored: DataFrame, by: list[Column], best: int) -> DataFrame:
    """The first rows of every item; each task sends on as many at most."""
    place = F.row_number().over(W.partitionBy("item").orderBy(*by))
    return scored.withColumn("rank", place).filter(F.col("rank") <= best)


def _search_set(docs: DataFrame, queries: DataFrame, best: int, owners: tuple[float, ...], block_docs: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted(r.term for r in queries.select("term").distinct().collect())
    index = materialize(index_documents(docs, terms, block_docs), "search-index")
    documents = index.filter(F.col("term") == -1)
    lengths = documents.select(F.explode("ns").alias("n"))
    n_docs, n_terms = lengths.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    postings = index.filter(F.col("term") >= 0).drop("doc_ids")
    numbered = spark.createDataFrame([*enumerate(terms)], "number int, term string")
    df = postings.groupBy(F.col("term").alias("number")).agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    owner = reduce(
        lambda rest, o: F.when(F.col("df") <= owners[o] * n_docs, o).otherwise(rest),
        reversed(range(len(owners) - 1)),
        F.lit(len(owners) - 1),
    )
    weighed = numbered.join(df, "number").select("number", "term", weight.alias("w"), owner.alias("owner"))
    bundles = max(1, -(-queries.select("item").distinct().count() // BUNDLE_ITEMS))
    wanted = queries.join(weighed, "term").select(
        F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"),
        "item", "number", "owner", (F.col("qtf") * F.col("w")).alias("weight"),
    )
    wanted = materialize(wanted, "search-terms")

    carried = spark.createDataFrame([], _ACCUMULATORS)
    theta = spark.createDataFrame([], "item long, theta long")
    for o in range(len(owners)):
        later = F.sum(F.when(F.col("owner") > o, F.col("weight") * LARGEST).otherwise(0))
        now = F.sum(F.when(F.col("owner") >= o, F.col("weight") * LARGEST).otherwise(0))
        bounds = wanted.groupBy("item").agg(later.alias("rest"), now.alias("open")).join(theta, "item", "left")
        bounds = bounds.fillna(0, ["theta"])
        own = wanted.filter(F.col("owner") == o).join(bounds, "item")
        entry = F.struct("item", "weight", (F.col("open") >= F.col("theta")).alias("admits"), "theta", "rest")
        # As many entries as a bundle has items.
        listed = own.groupBy("bundle", "number").agg(F.collect_list(entry).alias("e"))
        listed = listed.select(
            "bundle", F.col("number").alias("term"), F.col("e")["item"].alias("items"), F.col("e")["weight"].alias("weights"),
            F.col("e")["admits"].alias("admits"), F.col("e")["theta"].alias("floors"), F.col("e")["rest"].alias("rests"),
        )
        right = postings.join(listed, "term")
        # What can no longer win is left behind before a bundle goes on.
        if o:
            carried = carried.join(bounds.select("item", "theta", "open"), "item")
            carried = carried.filter(F.col("score") + F.col("open") >= F.col("theta")).drop("theta", "open")
        scored = carried.groupBy("bundle", "block").cogroup(right.groupBy("bundle", "block")).applyInArrow(
            _add_owner(n_docs, n_terms, best), _ACCUMULATORS
        )
        carried = materialize(scored, "accumulators")
        leaders = _best_of(carried, [F.col("score").desc()], best)
        theta = leaders.groupBy("item").agg(F.min("score").alias("theta"), F.count("*").alias("n"))
        theta = theta.filter(F.col("n") == best).drop("n")
    places = documents.select("block", F.inline(F.arrays_zip("docs", "doc_ids"))).withColumnRenamed("docs", "doc")
    left = carried.join(theta, "item", "left").filter(F.col("score") >= F.coalesce("theta", F.lit(0)))
    found = left.join(places.withColumnRenamed("doc_ids", "doc_id"), ["block", "doc"])
    ranked = _best_of(found, [F.col("score").desc(), F.col("doc_id").asc()], best)
    names = queries.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, owners: tuple[float, ...] = OWNERS, block_docs: int = BLOCK_DOCS,
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """The ``best`` highest-scoring documents of every item (rows item_id, text): item_id, rank, doc_id, score."""
    queries = materialize(item_terms(items), "items")
    sets = max(1, -(-queries.count() // vocabulary))
    set_of = F.pmod(F.xxhash64("item"), F.lit(sets))
    found = [_search_set(docs, queries.filter(set_of == s), best, owners, block_docs) for s in range(sets)]
    return reduce(DataFrame.unionByName, found)
