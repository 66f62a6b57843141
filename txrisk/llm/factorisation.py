"""Quality of documents by a factorisation machine.

A document's features are its words, hashed into buckets and weighted by the
logarithm of their counts, statistics of its structure, and its recorded length.
The machine has a weight for every feature and, for every pair of features, the
product of their factors of low rank. The sum over all pairs is half of the
square of the summed factors less the sum of their squares, so a text is scored
in time linear in its features.

The machine learns on the driver from at most ``max_rows`` labelled rows, the
ones with the smallest hashes; rows with equal texts and labels count once among
them. Scores are probabilities of label 1.

Null texts are empty; they and texts without words are scored by their
statistics. A null recorded length is a feature of its own. Long texts are taken
whole. Repeated rows get the same score, a document with several labels learns
from each. Without labels of both kinds every score is the share of label 1,
with one row of each kind added. Null ids are scored and never learned from. An
empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.quality import repeated_words
from txrisk.session import materialize

BUCKETS = 1 << 12
RANK = 8
# The most labelled rows that are learned from.
LABELLED_ROWS = 4_000
EPOCHS = 20
ROWS_OF_A_STEP = 200
RATE = 0.02
SHRINK_WEIGHTS = 1e-4
SHRINK_FACTORS = 1e-3
SEED = 5
THRESHOLD = 0.3

STRUCTURE = (
    "words", "word_length", "distinct", "upper", "digits", "symbols", "stops", "not_ascii",
    "lines", "repeated_lines", "repeated_words", "short", "length", "no_length",
)
FURTHEST = 5.0

_ALL = bytes(range(256))


def _but(chars: bytes) -> bytes:
    return bytes(c for c in _ALL if c not in chars)


NOT_UPPER = _but(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
NOT_DIGIT = _but(b"0123456789")
NOT_SYMBOL = _but(b"#*$%&|<>=_~^{}[]\\/@+")
NOT_STOP = _but(b".,;:!?")
NOT_HIGH = bytes(range(128))
# Words whose buckets a task remembers.
REMEMBERED = 200_000


def structure(raw: bytes, words: list[bytes], distinct: int, n_chars: int | None) -> list[float]:
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    share = lambda table: len(raw.translate(None, table)) / size
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        distinct / n,
        share(NOT_UPPER),
        share(NOT_DIGIT),
        np.sqrt(share(NOT_SYMBOL)),
        share(NOT_STOP),
        share(NOT_HIGH),
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        repeated_words(words) / n,
        sum(len(w) == 1 for w in words) / n,
        np.log1p(max(n_chars or 0, 0)),
        float(n_chars is None),
    ]


def reader() -> Callable[[str | None, int | None], tuple[np.ndarray, np.ndarray, list[float]]]:
    """A function from text and recorded length to word buckets, their weights and the structure."""
    known: dict[bytes, int] = {}

    def read(text: str | None, n_chars: int | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        counts = Counter(words)
        if len(known) > REMEMBERED:
            known.clear()
        for word in counts:
            if word not in known:
                known[word] = zlib.crc32(word) % BUCKETS
        at = np.fromiter((known[w] for w in counts), np.int64, len(counts))
        weight = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        bucket, place = np.unique(at, return_inverse=True)
        value = np.bincount(place, weight, len(bucket)).astype(np.float64)
        value /= np.sqrt((value * value).sum()) or 1.0
        return bucket, value, structure(raw, words, len(counts), n_chars)

    return read


@dataclass(frozen=True)
class Machine:
    """Bias, weights and factors of all features; the mean and spread of the structure."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def standard(self, figures: np.ndarray) -> np.ndarray:
        return np.clip((figures - self.mean) / self.spread, -FURTHEST, FURTHEST)

    def score(self, bucket: np.ndarray, value: np.ndarray, figures: list[float]) -> float:
        z = self.standard(np.asarray(figures))
        at = np.concatenate([bucket, BUCKETS + np.arange(len(z))])
        x = np.concatenate([value, z])
        f = self.factors[at]
        summed = x @ f
        pairs = (summed @ summed - ((x * x) @ (f * f)).sum()) / 2
        return float(_probability(self.bias + x @ self.weights[at] + pairs))


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def learn(words: np.ndarray, figures: np.ndarray, good: np.ndarray) -> Machine:
    """Fit the logistic loss by Adam over small steps; ``words`` has a row of buckets for each text."""
    rng = np.random.default_rng(SEED)
    size = BUCKETS + figures.shape[1]
    share = (good.sum() + 1) / (len(good) + 2)
    bias = float(np.log(share / (1 - share)))
    mean, spread = np.zeros(figures.shape[1]), np.ones(figures.shape[1])
    if not len(good) or good.all() or not good.any():
        return Machine(bias, np.zeros(size), np.zeros((size, RANK)), mean, spread)
    mean, spread = figures.mean(axis=0), figures.std(axis=0)
    spread[spread < 1e-9] = 1.0
    blank = Machine(bias, np.zeros(size), np.zeros((size, RANK)), mean, spread)
    x = np.concatenate([words, blank.standard(figures)], axis=1).astype(np.float32)
    # one table: the first column holds the weights, the others the factors
    table = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.01, (size, RANK))], axis=1).astype(np.float32)
    shrink = np.array([SHRINK_WEIGHTS] + [SHRINK_FACTORS] * RANK, np.float32)
    first, second = np.zeros_like(table), np.zeros_like(table)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), ROWS_OF_A_STEP):
            rows = order[at : at + ROWS_OF_A_STEP]
            b, y = x[rows], good[rows]
            linear, f = table[:, 0], table[:, 1:]
            summed, squares = b @ f, b * b
            margin = bias + b @ linear + ((summed**2).sum(axis=1) - (squares @ (f * f)).sum(axis=1)) / 2
            off = ((_probability(margin) - y) / len(rows)).astype(np.float32)
            slope = np.concatenate(
                [(off @ b)[:, None], b.T @ (off[:, None] * summed) - f * (off @ squares)[:, None]], axis=1
            ) + shrink * table
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            table -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            bias -= RATE * float(off.sum())
    return Machine(bias, table[:, 0].astype(np.float64), table[:, 1:].astype(np.float64), mean, spread)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether the row is never learned from: its id's checksum is divisible by ``folds``, or null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def _share(rows: int, max_rows: int) -> Column:
    """Condition on ``pick`` that about ``max_rows`` of ``rows`` rows meet; all if there are fewer."""
    least, whole = -(1 << 63), 1 << 64
    top = least + int(whole * min(1.0, 1.2 * max_rows / max(rows, 1))) - 1
    return F.col("pick") <= F.lit(top)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    n_chars: str = "n_chars", max_rows: int = LABELLED_ROWS,
) -> Machine:
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("quality in (0, 1)").filter(~held_out("label_id")).distinct()
    known = known.withColumn("pick", F.xxhash64("label_id"))
    # bounded by max_rows, so it may be broadcast, and texts stay where they are
    chosen = known.filter(_share(known.count(), max_rows)).orderBy("pick", "quality").limit(2 * max_rows)
    source = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text"), F.col(n_chars).cast("long").alias("n_chars"))
    rows = source.join(F.broadcast(chosen.drop("pick")), "label_id").select(
        "quality", "text", "n_chars", F.xxhash64("text", "n_chars", "quality").alias("pick")
    )

    def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            got = [read(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pick"), batch.column("quality"),
                    pa.array([g[0] for g in got], pa.list_(pa.int32())),
                    pa.array([g[1] for g in got], pa.list_(pa.float64())),
                    pa.array([g[2] for g in got], pa.list_(pa.float64())),
                ],
                ["pick", "quality", "bucket", "value", "figures"],
            )

    read = rows.mapInArrow(
        read_rows, "pick bigint, quality int, bucket array<int>, value array<double>, figures array<double>"
    )
    once = materialize(read.dropDuplicates(["pick"]), "labelled")
    taken = once.filter(_share(once.count(), max_rows)).orderBy("pick").limit(max_rows).toArrow()
    words = np.zeros((taken.num_rows, BUCKETS), np.float32)
    for row, (bucket, value) in enumerate(zip(taken.column("bucket"), taken.column("value"), strict=True)):
        words[row, bucket.values.to_numpy()] = value.values.to_numpy()
    figures = np.array(taken.column("figures").to_pylist(), np.float64).reshape(-1, len(STRUCTURE))
    return learn(words, figures, taken.column("quality").to_numpy() == 1)


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    n_chars: str = "n_chars", max_rows: int = LABELLED_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1: good), a row for each row of ``docs``."""
    machine = fit(docs, labels, doc_id, text, n_chars, max_rows)
    source = docs.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"),
        F.col(n_chars).cast("long").alias("n_chars"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            scores = [
                machine.score(*read(t.as_py(), n)) for t, n in zip(batch.column("text"), batch.column("n_chars").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "score"],
            )

    id_type = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
