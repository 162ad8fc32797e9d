"""N-gram Jaccard join through a token-group matrix, as connected components.

Two texts link when the Jaccard similarity of their word-shingle sets reaches NUM / DEN. The join works on
distinct sets (classes) and never lists the pairs of a group:

1. Tokens. A class is described by a few tokens: the shingles are dealt into parts by hash, and a token is the
   digest of one part. Parts outnumber the shingles in which two linked sets can differ, so linked sets
   have a token in common. Schemes depend on the size, and every class also speaks the scheme of the next
   larger sizes. Parts without shingles give no token; a class with too few filled parts repeats the scheme under
   the next seed, up to a seed that fills enough, so nothing is lost.
2. Groups. Of the smallest classes of its tokens, each class points to the one it shares most tokens with; the trees
   of these pointers hold similar classes and are cut by hash into groups of bounded size.
3. Matrix. Row token, column group, set where a member has the token: a column is the token union of its
   group. A cell holds the smallest and the largest component of these members. A row whose cells hold one
   component only is done. Linked sets share not one token but a number that follows from their sizes: a member
   has a link into a group only if that many of its tokens have there a member of another component. Groups are
   opened for such members only; a passage that many texts share gives too few tokens, and a large family opens
   nothing once it is one component.
4. Opened groups. The members let in, if in different components, are compared by parity sketches: the number of
   differing bits never exceeds the number of differing shingles, so a pair above the bound is no link. What is
   left is verified on the shingles themselves: first the closest pairs that connect the components of two groups as
   all pairs would, fewer than there are components, then, among the same members with the components as they are by
   then, the rest.

Defined cases: null and empty texts have an empty set and link with nothing, not even with each other; a text
with fewer than SHINGLE words has its whole sequence as its only shingle; equal texts and repeated rows are
one class; rows may share an id; a null id takes the smallest id of its component, if there is one. Shingles
and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlgauge.llm.common import materialize, word_codes

SHINGLE = 3
NUM, DEN = 90, 100
# Members of a group, on average; hashing spreads them evenly.
GROUP = 512
# Rows of a table that may be sent to every task; a row has under 50 bytes.
BROADCAST_ROWS = 400_000
# Classes of which a task remembers that it gave their tokens.
REMEMBERED = 500_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# --- sets -------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    codes, ends, words = word_codes(texts)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    flat = hashes[codes] if len(words) else np.empty(0, np.uint64)

    def combined(parts: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(parts[0]), len(parts), np.uint64)
        for i, part in enumerate(parts):
            total = _mixed(total * _ODD[0] + part + np.uint64(i))
        return total

    whole = combined([flat[i : len(flat) - size + 1 + i] for i in range(size)]) if len(flat) >= size else flat
    out = []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if end - start >= size:
            out.append(np.unique(whole[start : end - size + 1]))
        elif end > start:
            out.append(combined([flat[i : i + 1] for i in range(start, end)]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    """Digest of a set as a signed 64-bit number."""
    return int(np.int64(xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)))


# --- tokens -----------------------------------------------------------------------------------


def allowed(total: Column | int | np.ndarray, num: int = NUM, den: int = DEN):
    """Shingles in which two linked sets of ``total`` shingles together can differ, at most."""
    if isinstance(total, Column):
        return F.floor(total * (den - num) / F.lit(den + num))
    return total * (den - num) // (den + num)


@lru_cache(maxsize=8)
def _bounds(num: int, den: int) -> list[int]:
    """Smallest sizes of the buckets: a set links only within its bucket and the two beside it."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(out[-1] * den // num + 1)
    return out


def bucket_of(n: int, num: int = NUM, den: int = DEN) -> int:
    return bisect_right(_bounds(num, den), n) - 1


@lru_cache(maxsize=4096)
def parts_of(bucket: int, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """Parts of a scheme, and how many of them must hold shingles.

    Two linked sets, neither beyond the bucket, differ in fewer parts than must hold shingles, so one of these agrees.
    The parts exceed that number by twice the empty ones to be expected of the smallest sets that use the scheme.
    """
    bounds = _bounds(num, den)
    filled = allowed(2 * (bounds[bucket + 1] - 1), num, den) + 1
    return filled + math.ceil(2 * filled * math.exp(-bounds[max(0, bucket - 1)] / filled)), filled


@lru_cache(maxsize=1 << 16)
def tokens_needed(n: int, num: int = NUM, den: int = DEN) -> int:
    """Tokens that a set of ``n`` shingles shares with any set it links with, at least.

    Under a scheme that both speak they share as many as must be filled, less the shingles that differ. A partner
    is in the bucket below (the own scheme is common), in the same one (both schemes are) or in the one above.
    """
    bounds, own = _bounds(num, den), bucket_of(n, num, den)
    here, above = parts_of(own, num, den)[1], parts_of(own + 1, num, den)[1]
    longest, top = n * den // num, bounds[own + 1] - 1
    shared = [here + above - 2 * allowed(n + min(longest, top), num, den)]
    if n * num <= (bounds[own] - 1) * den:
        shared.append(here - allowed(n + bounds[own] - 1, num, den))
    if longest > top:
        shared.append(above - allowed(n + longest, num, den))
    return max(1, min(shared))


def tokens_of(tokens: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Digests of the non-empty parts under the scheme of the own and of the next bucket."""
    if not len(tokens):
        return np.empty(0, np.int64)
    own, out = bucket_of(len(tokens), num, den), []
    for scheme in (own, own + 1):
        (parts, needed), seed = parts_of(scheme, num, den), 0
        while True:
            at = (_mixed(tokens + np.uint64(seed)) % np.uint64(parts)).astype(np.int64)
            digest = np.zeros(parts, np.uint64)
            np.add.at(digest, at, _mixed(tokens ^ _ODD[1]))
            filled = np.bincount(at, minlength=parts) > 0
            name = (np.arange(parts, dtype=np.uint64) * _ODD[2]) + np.uint64(scheme * 1009 + seed)
            out.append(_mixed(digest ^ _mixed(name))[filled])
            if filled.sum() >= needed:
                break
            seed += 1
    return np.concatenate(out).view(np.int64)


def sketch_bits(n: int, num: int = NUM, den: int = DEN) -> int:
    """Bits of a parity sketch: sixteen or more for each shingle that may differ, a power of two.

    So few differing shingles then fall on one bit that hardly a pair beyond the threshold stays within the bound.
    """
    return max(64, 1 << (16 * allowed(2 * n, num, den)).bit_length())


def sketch_of(tokens: np.ndarray, num: int = NUM, den: int = DEN) -> bytes:
    """Parity of the shingles in each hash bucket; halves XORed give the sketch of half the bits."""
    bits = sketch_bits(max(1, len(tokens)), num, den)
    odd = np.bincount((_mixed(tokens ^ _ODD[2]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which every row of one array of sketches differs from every row of another."""
    out = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        out += np.bitwise_count(a[:, word][:, None] ^ b[:, word][None, :])
    return out


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of at least ``size`` bytes, all folded to that size, as rows of 64-bit words."""
    rows = []
    for sketch in sketches:
        row = np.frombuffer(sketch, np.uint64)
        while len(row) * 8 > size:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        rows.append(row)
    return np.stack(rows)


# --- passes over the texts --------------------------------------------------------------------


def _members(num: int, den: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch_of(s, num, den) if len(s) else None for s in sets], pa.binary()),
                    pa.array([tokens_needed(len(s), num, den) if len(s) else None for s in sets], pa.int64()),
                ],
                ["doc_id", "text_hash", "cls", "n_shingles", "sketch", "needed"],
            )

    return run


def _class_tokens(num: int, den: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies in one task give their tokens once, so a large group of copies shrinks before the shuffle.
        seen: set[int] = set()
        for batch in batches:
            sets = {class_of(s): s for s in shingle_sets(batch.column("text"), size) if len(s)}
            sets = {c: s for c, s in sets.items() if c not in seen}
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(sets)
            tokens = [tokens_of(s, num, den) for s in sets.values()]
            if tokens:
                owner = np.repeat(np.array(list(sets), np.int64), list(map(len, tokens)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(owner)], ["token", "cls"]
                )

    return run


def _class_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {class_of(s): s for s in shingle_sets(batch.column("text"), size) if len(s)}
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(sets), pa.int64()),
                        pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64())),
                    ],
                    ["cls", "shingles"],
                )

    return run


# --- graph ------------------------------------------------------------------------------------


def roots(parents: DataFrame, name: str) -> DataFrame:
    """(node, root) of a forest given as (node, parent) with parent < node, by pointer jumping."""
    current = parents
    while True:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = current.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
        )
        current = materialize(jumped, name)
        if current.filter("moved").isEmpty():
            return current.select("node", F.col("parent").alias("root"))
        current = current.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph; the root is the smallest node.

    Every node hangs below its smallest neighbour, trees are flattened and shrunk to their roots,
    and the rest of the edges goes on between roots: the graph at least halves every time.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    known: DataFrame | None = None
    edges = materialize(edges, "links")
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("parent"))
        forest = roots(both.groupBy("node").agg(F.min("parent").alias("parent")), "forest")
        if known is None:
            known = forest
        else:
            step = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = known.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            # A root that now hangs below another was no node of ``known`` before.
            known = materialize(moved.unionByName(forest.join(known, "node", "left_anti")), "components")
        at = lambda side: forest.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        joined = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
        ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        rest = joined.select(F.least(ra, rb).alias("a"), F.greatest(ra, rb).alias("b")).filter("a < b").distinct()
        edges = materialize(rest, "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if known is None else known


# --- the join ---------------------------------------------------------------------------------


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _distance(a: str, b: str) -> Column:
    """Differing bits of two sketches of 64-bit words; the larger sketch is folded to the smaller."""

    @F.arrow_udf("int")
    def bits(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            size = min(len(p), len(q))
            out.append(int(differing_bits(_folded([p], size), _folded([q], size))[0, 0]))
        return pa.array(out, pa.int32())

    return bits(F.col(a), F.col(b))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return pairs.join(left, "a").join(right, "b").filter(den * shared >= num * union).select("a", "b")


def _sets_for(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(cls, shingles) of the classes in ``pairs``, read from one document of each."""
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    needed = materialize(needed.join(classes.select("cls", "doc_id"), "cls"), "needed-classes")
    wanted = _sized(needed.select("doc_id").distinct())
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    found = texts.mapInArrow(_class_sets(size), "cls long, shingles array<long>")
    # Another row may bear the same id; a class keeps one copy of its set.
    own = found.join(_sized(needed.select("cls")), "cls", "left_semi")
    return materialize(own.groupBy("cls").agg(F.first("shingles").alias("shingles")), "class-sets")


def _undone(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """(token, cls, g, comp) of the tokens whose classes are in more than one component."""
    now = rows.select("token", "cls", "g").join(_sized(comp), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    bounds = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_tokens = materialize(bounds.filter("lo < hi").select("token"), "open-tokens")
    return now.join(_sized(open_tokens), "token", "left_semi")


def _let_in(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, g, h, n): members of g that may have a link into h, as bounded by their tokens there."""
    cells = rows.groupBy("token", F.col("g").alias("h")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    overlap = (
        rows.join(cells, "token")
        .filter((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp")))
        .groupBy("cls", "comp", "g", "h")
        .agg(F.count("*").alias("shared"))
    )
    let_in = overlap.join(classes.select("cls", "n", "needed"), "cls").filter("shared >= needed")
    let_in = materialize(let_in.select("cls", "g", "h", "n"), "let-in")
    # A link needs members let in on both sides.
    back = let_in.select(F.col("h").alias("g"), F.col("g").alias("h")).distinct()
    return materialize(let_in.join(_sized(back), ["g", "h"], "left_semi"), "members-let-in")


def _opened(let_in: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """(left, right): the members let in of every two groups that hold more than one component together."""
    now = let_in.join(_sized(comp), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    now = now.withColumns({"lo": F.least("g", "h"), "hi": F.greatest("g", "h")})
    cells = now.groupBy("lo", "hi").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    several = materialize(cells.filter("low < high").select("lo", "hi"), "open-groups")
    # Members are few beside classes: sent to the tasks, they leave the sketches of all other classes where they are.
    wanted = _sized(materialize(now.join(_sized(several), ["lo", "hi"], "left_semi"), "open-members"))
    member = F.struct("cls", "comp", "n", "sketch")
    return (
        wanted.join(classes.select("cls", "sketch"), "cls")
        .groupBy("lo", "hi")
        .agg(
            F.collect_list(F.when(F.col("g") <= F.col("h"), member)).alias("left"),
            F.collect_list(F.when(F.col("g") >= F.col("h"), member)).alias("right"),
        )
        .select("left", "right")
    )


def _forest(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the closest pairs that connect the components ``a`` and ``b`` as all pairs do."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    top, kept = list(range(len(names))), []
    order = np.argsort(bits, kind="stable")
    for at, x, y in zip(order.tolist(), codes[: len(a)][order].tolist(), codes[len(a) :][order].tolist(), strict=True):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x != y:
            top[y] = x
            kept.append(at)
            if len(kept) == len(names) - 1:
                break
    return np.array(kept, np.int64)


def _open_groups(num: int, den: int, nearest: bool):
    """Pairs of members, one of each group, that may link and are in different components.

    ``nearest`` keeps only the closest pairs that connect these components: a family of many components gives
    fewer pairs than it has members, not all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((2, 0), np.int64)]
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                sizes_a, sizes_b = ({len(m["sketch"]) for m in side} for side in (left, right))
                for x in sizes_a:
                    for y in sizes_b:
                        own = [m for m in left if len(m["sketch"]) == x]
                        other = [m for m in right if len(m["sketch"]) == y]
                        found.append(_candidates(own, other, min(x, y), num, den, nearest))
            pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _candidates(left: list[dict], right: list[dict], size: int, num: int, den: int, nearest: bool) -> np.ndarray:
    column = lambda rows, name: np.array([m[name] for m in rows], np.int64)
    n, m, own, comp = column(left, "n"), column(right, "n"), column(left, "comp"), column(right, "comp")
    bound = allowed(n[:, None] + m[None, :], num, den)
    near = (own[:, None] != comp[None, :]) & (np.abs(n[:, None] - m[None, :]) <= bound)
    if not near.any():
        return np.empty((2, 0), np.int64)
    bits = differing_bits(_folded([x["sketch"] for x in left], size), _folded([x["sketch"] for x in right], size))
    i, j = np.nonzero(near & (bits <= bound))
    if nearest:
        kept = _forest(own[i], comp[j], bits[i, j])
        i, j = i[kept], j[kept]
    return np.stack([column(left, "cls")[i], column(right, "cls")[j]])


def near_duplicates(
    docs: DataFrame, num: int = NUM, den: int = DEN, size: int = SHINGLE, group: int = GROUP
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its component).

    Further columns: text_hash, and component, the same number for all rows of a component and null for empty sets.
    """
    docs = docs.select("doc_id", "text")
    members = materialize(
        docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            _members(num, den, size), "doc_id long, text_hash long, cls long, n_shingles long, sketch binary, needed long"
        ),
        "members",
    )
    classes = materialize(
        members.filter("cls IS NOT NULL")
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
            F.first("needed").alias("needed"),
        ),
        "classes",
    )

    # Tokens that at least two classes share, with the smallest class of each.
    of_token = Window.partitionBy("token")
    tokens = docs.mapInArrow(_class_tokens(num, den, size), "token long, cls long")
    # One exchange by token serves both the copies of other tasks and the window.
    tokens = tokens.repartition("token").dropDuplicates(["token", "cls"])
    shared = materialize(
        tokens.withColumns({"first": F.min("cls").over(of_token), "last": F.max("cls").over(of_token)})
        .filter("first < last")
        .select("token", "cls", "first"),
        "shared-tokens",
    )

    # The first class that every class shares most tokens with, and the links that hold among these pairs.
    times = shared.filter("cls > first").groupBy("cls", "first").agg(F.count("*").alias("n"))
    most = times.groupBy("cls").agg(F.min(F.struct((-F.col("n")).alias("n"), "first")).alias("m"))
    sketch = lambda side: classes.select(F.col("cls").alias(side), F.col("sketch").alias(f"s{side}"), F.col("n").alias(f"n{side}"))  # noqa: E731,E501
    nearest = materialize(
        most.select(F.col("m.first").alias("a"), F.col("cls").alias("b"))
        .join(sketch("b"), "b")
        .join(sketch("a"), "a")
        .select("a", "b", (F.col("na") + F.col("nb")).alias("total"), _distance("sa", "sb").alias("bits")),
        "nearest",
    )
    plausible = nearest.filter(F.col("bits") <= allowed(F.col("total"), num, den)).select("a", "b")
    first_sets = _sets_for(docs, classes, plausible, size)
    first_links = materialize(_verified(plausible, first_sets, num, den), "first-links")

    # Groups of similar classes, and the matrix of tokens and groups.
    trees = roots(nearest.select(F.col("b").alias("node"), F.col("a").alias("parent")), "trees")
    placed = (
        shared.select("cls")
        .distinct()
        .join(trees.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    # Trees of more than one group are few; all others are one slice.
    slices = placed.groupBy("root").agg(F.ceil(F.count("*") / group).alias("slices")).filter("slices > 1")
    slices = _sized(materialize(slices, "slices"))
    placed = _sized(
        materialize(
            placed.join(slices, "root", "left").select(
                "cls",
                F.xxhash64("root", F.pmod(F.xxhash64("cls"), F.coalesce("slices", F.lit(1).cast("long")))).alias("g"),
            ),
            "groups",
        )
    )
    rows = materialize(shared.select("token", "cls").join(placed, "cls"), "matrix")

    comp_of = lambda links: materialize(
        components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp")), "components"
    )
    comp = comp_of(first_links)
    # Components only grow, so whoever may link later is let in now.
    let_in = _let_in(materialize(_undone(rows, comp), "undone"), classes)

    # First only the closest pairs that connect components, then, when most of them have merged, all that are left.
    links = first_links
    for nearest_only in (True, False):
        candidates = materialize(
            _opened(let_in, comp, classes).mapInArrow(_open_groups(num, den, nearest_only), "a long, b long").distinct(),
            "candidates",
        )
        more = _verified(candidates, _sets_for(docs, classes, candidates, size), num, den)
        links = materialize(links.unionByName(more), "links")
        if nearest_only:
            comp = comp_of(links)
    final = components(links)

    # The smallest document of every component, for all members of its classes.
    linked = final.select(F.col("node").alias("cls"), "root")
    linked = linked.unionByName(linked.select(F.col("root").alias("cls"), "root").distinct()).distinct()
    joined = materialize(classes.select("cls", "doc_id").join(linked, "cls", "left"), "rooted-classes")
    # Stored, so that a join by a root with many classes can be split; classes without links need no join.
    of_root = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_root = _sized(materialize(of_root, "smallest"))
    labels = (
        joined.filter("root IS NOT NULL")
        .join(of_root, "root")
        .select("cls", "root", "component_id")
        .unionByName(
            joined.filter("root IS NULL").select("cls", F.col("cls").alias("root"), F.col("doc_id").alias("component_id"))
        )
    )
    return members.join(labels, "cls", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "text_hash",
        F.col("root").alias("component"),
    )


def one_of_each(docs: DataFrame, num: int = NUM, den: int = DEN, size: int = SHINGLE) -> DataFrame:
    """Documents without near-duplicates: of each component the row with the smallest id, then text hash, stays.

    Of rows that agree in both, the smallest in the order of all columns stays. Documents with an empty set all stay.
    """
    found = near_duplicates(docs, num, den, size)
    rows = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    rows = materialize(rows, "component-rows")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "copies"))
    firsts = rows.filter("component IS NOT NULL").groupBy("component").agg(best.alias("m")).select("m.*")
    empty = rows.filter("component IS NULL").withColumn("copies", F.lit(1).cast("long"))
    columns = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), F.col("copies").alias("_copies")]
    kept = _sized(materialize(firsts.select(*columns).unionByName(empty.select(*columns)), "first-rows"))
    # Whole rows as one struct: no column of theirs can clash with the names used here.
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    own = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_th"))
    joined = whole.join(kept, own, "inner")
    single = joined.filter("_copies = 1").select("_row")
    copies = joined.filter("_copies > 1").groupBy("_id", "_th").agg(F.min("_row").alias("_row"))
    return single.unionByName(copies.select("_row")).select("_row.*")
