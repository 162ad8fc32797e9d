"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or not at all on every document. Documents with equal votes are counted together
(at most 3 ** labellers patterns, whatever the corpus), and expectation-maximisation over these counts estimates how
often each labeller votes what on good and on bad documents. The posterior of a document's votes labels a bounded
sample of distinct texts (SAMPLE on average, drawn by hash), on which a linear scorer over hashed words and word shapes is trained. The
scorer judges every document; no hand-made label is read.

Defined cases: null and empty texts have score 0 and are not kept; without documents nothing is learned and every
score is 0.5; equal texts have equal scores; further columns of the documents are kept, and columns named like
results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import word_codes
from crawlgauge.llm.decision_list import features, with_counts

# Distinct texts the scorer is trained on, on average.
SAMPLE = 8192
BUCKETS = 1 << 16
GOOD, BAD, NONE = 1, 0, -1
# A labeller looks for one fault, so it seldom votes bad on good documents: prior rate of that, and the weight of
# the prior in corpora. At this weight the rate is an assumption that the data hardly move.
FALSE_ALARM = 0.0005
PRIOR_WEIGHT = 10.0

# name: (feature, bad above, good below); None: never votes so.
LABELLERS: dict[str, tuple[str, float | None, float | None]] = {
    "symbols": ("symbols_per_word", 0.4, 0.1),
    "marks": ("marks_per_word", 0.3, 0.1),
    "repeats": ("repeat_share", 0.5, 0.3),
    "lines": ("dup_line_share", 0.5, 0.1),
    "capitals": ("upper_share", 0.5, 0.2),
    "digits": ("digit_share", 0.2, 0.05),
    "long_words": ("chars_per_word", 12.0, 9.0),
}


def votes() -> list[Column]:
    """One column per labeller over the features of a document."""
    out, have = [], features()
    for name, (feature, bad, good) in LABELLERS.items():
        value = have[feature]
        vote = F.when(F.col("n_words") == 0, NONE).when(value > bad, BAD).when(value <= good, GOOD).otherwise(NONE)
        out.append(vote.cast("int").alias(name))
    return out


# --- expectation-maximisation -----------------------------------------------------------------


@dataclass(frozen=True)
class LabelModel:
    """log P(vote | class): tables[j][class][vote + 1]; prior: log P(class)."""

    tables: np.ndarray
    prior: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of vote patterns (rows, labellers)."""
        logs = self.prior + sum(self.tables[j][:, patterns[:, j] + 1].T for j in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, BAD] - logs[:, GOOD], -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Fit to counted vote patterns.

    The first guess calls bad what any labeller votes bad on. What a labeller votes on good documents has a
    prior: its votes on all documents, with false alarms at their prior rate. Without it, the bad class would become
    whatever group of documents has the most correlated votes.
    """
    p = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)
    prior_tables = np.zeros((patterns.shape[1], 3))
    for j in range(patterns.shape[1]):
        for vote in (NONE, GOOD):
            prior_tables[j, vote + 1] = counts[patterns[:, j] == vote].sum() + 0.1
    prior_tables *= (1 - FALSE_ALARM) / prior_tables.sum(axis=1, keepdims=True)
    prior_tables[:, BAD + 1] = FALSE_ALARM
    model = None
    for _ in range(rounds):
        mass = np.stack([counts * (1 - p), counts * p])  # by class
        tables = np.zeros((patterns.shape[1], 2, 3))
        for j in range(patterns.shape[1]):
            for vote in (NONE, BAD, GOOD):
                tables[j, :, vote + 1] = mass[:, patterns[:, j] == vote].sum(axis=1) + 0.1
        tables[:, GOOD] += PRIOR_WEIGHT * counts.sum() * prior_tables
        tables /= tables.sum(axis=2, keepdims=True)
        prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
        model = LabelModel(np.log(tables), np.log(prior))
        new = model.posterior(patterns)
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
    return model


# --- the scorer -------------------------------------------------------------------------------

_CLASSES = [(re.compile(p), c) for p, c in ((r"[0-9]+", "9"), (r"[A-Z]{2,}", "AA"), (r"[a-z\x80-\U0010FFFF]+", "a"))]


def _buckets(word: bytes) -> tuple[int, int]:
    """Hash buckets of a word and of its shape."""
    text = word.decode()
    for pattern, name in _CLASSES:
        text = pattern.sub(name, text)
    shape = xxhash.xxh3_64_intdigest("shape " + text[:24]) % BUCKETS
    return xxhash.xxh3_64_intdigest(b"word " + word.lower()) % BUCKETS, shape


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words (two each), and where each text's words end."""
    codes, ends, words = word_codes(texts, lower=False)
    table = np.array([_buckets(w) for w in words], np.int64).reshape(-1, 2)
    return table[codes, 0], table[codes, 1], ends


def sparse_rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean bucket counts of every text as (buckets, values)."""
    words, shapes, ends = _hashed(texts)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        buckets, n = np.unique(np.concatenate([words[a:b], shapes[a:b]]), return_counts=True)
        out.append((buckets, n / max(1, b - a)))
    return out


def train_scorer(
    rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 80, rate: float = 0.5
) -> np.ndarray:
    """Logistic regression on soft labels by Adagrad; the last weight is the intercept."""
    weights, square = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    bucket = np.concatenate([b for b, _ in rows]) if rows else np.empty(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
    # Both classes weigh the same.
    weight = target / max(1e-9, target.sum()) + (1 - target) / max(1e-9, (1 - target).sum())
    for _ in range(steps if len(rows) else 0):
        logit = np.bincount(owner, weights=value * weights[bucket], minlength=len(rows)) + weights[-1]
        miss = weight * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - target)
        step = np.append(np.bincount(bucket, weights=value * miss[owner], minlength=BUCKETS), miss.sum())
        step += 1e-6 * weights
        square += step * step
        weights -= rate * step / np.sqrt(square)
    return weights


def score(text: Column, weights: np.ndarray) -> Column:
    """P(good) of a text column under a trained scorer."""
    weights = weights.astype(np.float32)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        words, shapes, ends = _hashed(texts)
        total = np.concatenate([[0.0], np.cumsum(weights[words].astype(float) + weights[shapes])])
        n = np.diff(ends)
        logit = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(1, n) + float(weights[-1])
        return pa.array(np.where(n > 0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))), 0.0))

    return scored(text)


# --- the classifier ---------------------------------------------------------------------------


def posterior(model: LabelModel) -> Column:
    """P(good) of the votes of a document, over the labellers' columns."""
    odds = F.lit(float(model.prior[GOOD] - model.prior[BAD]))
    for j, name in enumerate(LABELLERS):
        gain = model.tables[j, GOOD] - model.tables[j, BAD]
        vote = F.when(F.col(name) == BAD, float(gain[BAD + 1])).when(F.col(name) == GOOD, float(gain[GOOD + 1]))
        odds = odds + vote.otherwise(float(gain[NONE + 1]))
    return 1 / (1 + F.exp(-odds))


def _with_rows():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sparse_rows(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("t"),
                    batch.column("p"),
                    pa.array([b for b, _ in rows], pa.list_(pa.int64())),
                    pa.array([v for _, v in rows], pa.list_(pa.float64())),
                ],
                ["t", "p", "buckets", "shares"],
            )

    return run


def learn(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer, from the votes of all documents and the texts of a bounded sample."""
    names = list(LABELLERS)
    voted = with_counts(docs.select("text")).select(*votes(), F.xxhash64("text").alias("t"), "n_words")
    # One row per pattern of votes: at most 3 ** labellers. Copies have one pattern, so distinct texts add up.
    texts = F.approx_count_distinct(F.when(F.col("n_words") > 0, F.col("t")), 0.02)
    counted = voted.groupBy(*names).agg(F.count("*").alias("count"), texts.alias("texts")).orderBy(*names).collect()
    patterns = np.array([[r[n] for n in names] for r in counted], np.int64).reshape(-1, len(names))
    if not len(patterns):
        return np.zeros(BUCKETS + 1)
    counts = np.array([r["count"] for r in counted], float)
    model = expectation_maximisation(patterns, counts)
    # Copies of a text have one hash; they are drawn together and then count once.
    share = min(1.0, sample / max(1, sum(r["texts"] for r in counted)))
    code = F.xxhash64("text")
    drawn = (
        docs.select("text", code.alias("t"))
        .filter(F.col("text").rlike(r"[^\s]") & (F.pmod(code, F.lit(1 << 30)) < int(share * (1 << 30))))
        .groupBy("t")
        .agg(F.first("text").alias("text"))
    )
    labelled = with_counts(drawn).select("t", "text", *votes(), "n_words").filter("n_words > 0")
    rows = labelled.select("t", "text", posterior(model).alias("p"))
    table = rows.mapInArrow(_with_rows(), "t long, p double, buckets array<long>, shares array<double>")
    found = table.orderBy("t").toArrow()
    sparse = [
        (np.asarray(b), np.asarray(v))
        for b, v in zip(found["buckets"].to_pylist(), found["shares"].to_pylist(), strict=True)
    ]
    return train_scorer(sparse, np.asarray(found["p"].to_pylist(), float))


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents with score and kept."""
    docs = docs.drop("score", "kept")
    scored = docs.withColumn("score", score(F.col("text"), learn(docs, sample)))
    return scored.withColumn("kept", F.col("score") >= 0.5)
