"""Quality rules as a learned decision list.

Every text is reduced to counts. Sequential covering learns rules from labelled counts: each rule is a
conjunction of thresholds, grown condition by condition for information gain on two thirds of the examples
and pruned backwards on the other third; accepted rules join the list and what they cover leaves the
examples. The list becomes one ordered Spark conditional expression.

Learning reads a bounded sample of the labelled rows (SAMPLE, the rows with the smallest hashes of their
ids); counts and verdicts cover all documents.

Defined cases: null and empty texts have zero counts; ratios over zero words or characters are 0; without
labels, or with labels of one class only, the list is empty and keeps everything; a document with two
labels is two examples; null labels are left out; further columns of the documents are kept, and a
column named like a count is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import materialize, word_codes

# Labelled rows that a list is learned from, at most.
SAMPLE = 20_000
# Share of a rule's cover that must be of the rejected class, on the growing and the pruning examples.
PRECISION = 0.97
# A rule must cover this share of the rejected examples at least.
SUPPORT = 0.005
MAX_CONDITIONS = 4
THRESHOLDS = 256

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks",
)
_COUNTS_TYPE = "struct<" + ", ".join(f"{name}: long" for name in COUNTS) + ">"

# --- counts -----------------------------------------------------------------------------------

_SYMBOL, _UPPER, _DIGIT, _SPACE, _REST, _MARK = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"#*$%&|<>")] = _SYMBOL
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x80:0xC0] = _REST  # bytes that continue a code point
_CLASS[list(b"!?")] = _MARK


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each text; ends has one more entry than there are texts."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def repeated_words(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in that text."""
    covered = np.zeros(len(codes), bool)
    if len(codes) >= 3:
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        start = np.flatnonzero(owner[2:] == owner[:-2])
        top = int(codes.max()) + 1
        pair = np.unique(codes[:-1].astype(np.int64) * top + codes[1:], return_inverse=True)[1]
        window = np.unique(pair[start] * top + codes[start + 2], return_inverse=True)[1]
        key = owner[start] * (int(window.max()) + 1 if len(window) else 1) + window
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = start[count[inverse] > 1]
        for shift in range(3):
            covered[again + shift] = True
    return _per_text(covered, ends)


def count_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of a batch of texts."""
    rows = [t or "" for t in texts.to_pylist()]
    raw = [t.encode() for t in rows]
    byte_ends = np.cumsum([0, *map(len, raw)])
    classes = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    of_class = {c: _per_text(classes == c, byte_ends) for c in (_SYMBOL, _UPPER, _DIGIT, _SPACE, _REST, _MARK)}
    codes, word_ends, _ = word_codes(texts, lower=False)
    lines = [[line for line in t.split("\n") if line.strip(" \t\n\v\f\r")] for t in rows]
    return {
        "n_words": np.diff(word_ends),
        "word_chars": np.diff(byte_ends) - of_class[_REST] - of_class[_SPACE],
        "n_symbols": of_class[_SYMBOL],
        "n_dup_lines": np.array([len(own) - len(set(own)) for own in lines], np.int64),
        "n_repeat_words": repeated_words(codes, word_ends),
        "n_lines": np.array([len(own) for own in lines], np.int64),
        "n_upper": of_class[_UPPER],
        "n_digits": of_class[_DIGIT],
        "n_marks": of_class[_MARK],
    }


def counts(text: Column) -> Column:
    """The counts of a text column as a struct."""

    @F.arrow_udf(_COUNTS_TYPE)
    def counted(texts: pa.Array) -> pa.Array:
        found = count_batch(texts)
        return pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in COUNTS], names=list(COUNTS))

    return counted(text)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the counts as columns."""
    kept = [c for c in docs.columns if c not in COUNTS]
    return docs.select(*kept, counts(F.col(text)).alias("_c")).select(*kept, "_c.*")


# --- features ---------------------------------------------------------------------------------


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules may ask for, as expressions over the counts."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "marks_per_word": _share("n_marks", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
        "upper_share": _share("n_upper", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
    }


# --- learning ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        values = columns[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def expression(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(lambda m, c: m & c.holds(columns), rule, np.ones(n, bool))


def _candidates(columns: dict[str, np.ndarray]) -> list[Condition]:
    """Thresholds half-way between neighbouring quantiles, both directions."""
    out = []
    for name, values in columns.items():
        cuts = np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS + 1)))
        for cut in (cuts[:-1] + cuts[1:]) / 2:
            out += [Condition(name, True, float(cut)), Condition(name, False, float(cut))]
    return out


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the highest information gain until the cover is pure."""
    candidates = _candidates(columns)
    held = np.stack([c.holds(columns) for c in candidates])
    rule: list[Condition] = []
    cover = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and not bad[cover].all():
        before = np.log2(bad[cover].mean())
        positives = held @ (cover & bad).astype(np.float64)
        totals = held @ cover.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(positives > 0, positives * (np.log2(positives / totals) - before), 0)
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        rule.append(candidates[best])
        cover &= held[best]
    return tuple(rule)


def _worth(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> float:
    cover = covered(rule, columns, len(bad))
    return float((bad[cover].sum() - (~bad[cover]).sum()) / max(1, cover.sum()))


def _prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions for as long as the pruning examples do not speak against it."""
    while len(rule) > 1 and _worth(rule[:-1], columns, bad) >= _worth(rule, columns, bad):
        rule = rule[:-1]
    return rule


def learn(columns: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules that reject; what none of them covers is kept."""
    n, needed = len(bad), max(2.0, SUPPORT * bad.sum())
    left, rules = np.ones(n, bool), []
    held_out = np.arange(n) % 3 == 2
    while bad[left].sum() >= needed:
        grown = left & ~held_out
        if not bad[grown].any() or bad[grown].all():
            break
        own = {k: v[grown] for k, v in columns.items()}
        rule = _grow(own, bad[grown])
        pruning = left & held_out
        shorter = _prune(rule, {k: v[pruning] for k, v in columns.items()}, bad[pruning])
        for rule in (shorter, rule):
            cover = covered(rule, columns, n) & left
            parts = [bad[cover & grown], bad[cover & pruning]]
            if rule and bad[cover].sum() >= needed and all(p.mean() >= PRECISION for p in parts if len(p)):
                break
        else:
            break
        rules.append(rule)
        left &= ~cover
    return rules


def labelled_counts(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled documents with their features; ``bad`` where the label is 0.

    Documents that fail the base rule are left out: the list never judges them.
    """
    drawn = (
        labels.select("doc_id", target)
        .filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", target)
        .limit(sample)
        .select("doc_id", (F.col(target) == 0).alias("bad"))
    )
    # At most ``sample`` rows, so they may be sent to every task. Stored: a filter on counts would else be pushed below
    # the join, and all texts be counted for it.
    joined = materialize(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "labelled")
    counted = with_counts(joined).filter(~base_failed())
    return counted.select("doc_id", "bad", *(c.alias(f"f_{k}") for k, c in features().items()))


def learn_from(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learn on the driver from a bounded number of rows, in an order of their own."""
    rows = labelled_counts(docs, labels, target, sample).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    if rows.empty:
        return []
    columns = {k: rows[f"f_{k}"].to_numpy(float) for k in features()}
    return learn(columns, rows["bad"].to_numpy(bool))


def verdict(rules: list[Rule]) -> Column:
    """True where the list keeps a document: one branch per rule, in order."""
    out = None
    for rule in rules:
        condition = reduce(lambda a, b: a & b, (c.expression() for c in rule))
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    """Too short, or mostly repeated words."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Documents with counts, base_failed and kept."""
    counted = with_counts(docs.drop("base_failed", "kept")).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))
