"""Quality rules: an isolation forest on rule statistics.

Five statistics are taken of every whole text: words, code points in words,
symbols, repeated lines and words in repeated windows. A forest of random splits
gives each document the length of its path; documents that few splits set apart
are anomalous. Every row labelled good is counted in every node of the forest, and
the threshold is calibrated on all labelled rows of both kinds. A base rule (too few words, or mostly repeated ones) rejects without the forest.

Null and empty texts have no words and fail the base rule; long texts are taken
whole. An empty table gives no rows. Repeated rows are judged alike; a document with several labels counts once for each. Without any
usable label of either kind only the base rule decides. Null ids and extra
columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.session import materialize

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

# The forest: trees, and the most cuts above a leaf.
TREES = 200
DEPTH = 12
SEED = 11
# Rejecting a good document weighs as much as keeping so many bad ones.
GOOD_WEIGHT = 10.0
# Scores are ordered within so many bins, and the bins among each other.
SCORE_BINS = 1 << 16

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 1_000_000:  # keeps the next product within 64 bits
        codes = np.unique(codes, return_inverse=True)[1]
    codes = codes * len(number) + ids[2:]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    windows = np.isin(codes, twice)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= windows
    return int(covered.sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    # continuation bytes of a code point are 0x80 to 0xBF
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [line for line in raw.split(b"\n") if line.strip()] if b"\n" in raw else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the five statistics (long), a row for each row of ``docs``."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{s} bigint" for s in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(t.as_py()) for t in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", *STATISTICS],
            )

    return source.mapInArrow(run, schema)


def features(statistics: np.ndarray) -> np.ndarray:
    """What the forest splits on: the statistics in proportion to the number of words."""
    n, chars, symbols, dup, repeated = statistics.astype(np.float64).T
    words = np.maximum(n, 1)
    return np.stack(
        [chars / words, np.sqrt(symbols / words), np.log1p(dup), np.sqrt(repeated / words)], axis=1
    )


def _usual_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search in a tree of ``n`` rows."""
    n = np.asarray(n, np.float64)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    """Trees as arrays of nodes: feature (-1: leaf), cut, left child, path length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int

    @staticmethod
    def counted(feature: np.ndarray, cut: np.ndarray, count: np.ndarray):
        """The trees of :func:`random_cuts`, cut off where a node holds one row at most.

        ``count`` has the rows at which a descent ended, by tree and place.
        """
        count, inner = count.copy(), feature.shape[1]
        for first in [(1 << d) - 1 for d in reversed(range(DEPTH))]:
            below = count[:, 2 * first + 1 : 4 * first + 3]
            count[:, first : 2 * first + 1] += below.reshape(len(count), -1, 2).sum(axis=2)
        split = np.zeros(count.shape, bool)
        split[:, :inner] = (feature >= 0) & (count[:, :inner] > 1)
        reached = np.zeros(count.shape, bool)
        reached[:, 0] = True
        for first in [(1 << d) - 1 for d in range(DEPTH)]:
            on = reached[:, first : 2 * first + 1] & split[:, first : 2 * first + 1]
            reached[:, 2 * first + 1 : 4 * first + 3] = np.repeat(on, 2, axis=1)
        trees = []
        for t in range(len(count)):
            places = np.flatnonzero(reached[t])
            at = split[t, places]
            up = np.where(at, places, 0)
            depth = np.floor(np.log2(places + 1))
            trees.append(
                (
                    np.where(at, feature[t, up], -1),
                    np.where(at, cut[t, up], 0.0),
                    np.where(at, np.searchsorted(places, 2 * up + 1), 0),
                    np.where(at, 0.0, depth + _usual_path(count[t, places])),
                )
            )
        return IsolationForest(trees, int(count[0, 0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; above one half a path is shorter than usual."""
        total = np.zeros(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            inner = np.arange(len(x))
            while len(inner := inner[feature[at[inner]] >= 0]):
                node = at[inner]
                at[inner] = left[node] + (x[inner, feature[node]] >= cut[node])
            total += path[at]
        usual = float(_usual_path(np.array(self.rows))) or 1.0
        return np.exp2(-total / len(self.trees) / usual)


def random_cuts(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none can be cut) and cut of the inner nodes of TREES full trees.

    The children of place i are 2 i + 1 and 2 i + 2. Cuts are drawn from the whole
    box ``low`` to ``high``, not from the rows, so what lies outside the values of
    the good rows is set apart.
    """
    rng = np.random.default_rng(SEED)
    lo, hi = (np.repeat(edge[None, None, :], TREES, axis=0) for edge in (low, high))
    features, cuts = [], []
    for _ in range(DEPTH):
        wide = hi > lo
        chosen = np.where(wide, rng.random(lo.shape), -1.0).argmax(axis=2)
        at = chosen[..., None]
        least, most = np.take_along_axis(lo, at, 2), np.take_along_axis(hi, at, 2)
        value = least + rng.random(least.shape) * (most - least)
        features.append(np.where(wide.any(axis=2), chosen, -1))
        cuts.append(value[..., 0])
        below, above = hi.copy(), lo.copy()
        np.put_along_axis(below, at, value, 2)
        np.put_along_axis(above, at, value, 2)
        lo = np.stack([lo, above], axis=2).reshape(TREES, -1, lo.shape[2])
        hi = np.stack([below, hi], axis=2).reshape(TREES, -1, hi.shape[2])
    return np.concatenate(features, axis=1).astype(np.int8), np.concatenate(cuts, axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return features(np.stack([batch.column(s).to_numpy() for s in STATISTICS], axis=1))


def _box(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and largest value of every feature; None without a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                for f in range(x.shape[1]):
                    yield pa.RecordBatch.from_pydict({"f": [f], "low": [x[:, f].min()], "high": [x[:, f].max()]})

    edges = rows.mapInArrow(run, "f bigint, low double, high double").groupBy("f")
    found = sorted(edges.agg(F.min("low"), F.max("high")).collect())
    return (np.array([r[1] for r in found]), np.array([r[2] for r in found])) if found else None


def _ends(rows: DataFrame, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many of the rows end at each place of each tree."""
    places = (1 << DEPTH + 1) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((TREES, places), np.int64)
        for batch in batches:
            x = _matrix(batch)
            row = np.arange(len(x))
            for t in range(TREES):
                at = np.zeros(len(x), np.int64)
                for _ in range(DEPTH):
                    f = feature[t, at]
                    at = np.where(f >= 0, 2 * at + 1 + (x[row, f] >= cut[t, at]), at)
                count[t] += np.bincount(at, minlength=places)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count.ravel()[used])], ["place", "n"])

    ended = rows.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(TREES * places, np.int64)
    count[ended.column("place").to_numpy()] = ended.column("n").to_numpy()
    return count.reshape(TREES, places)


def calibrate(scored: DataFrame, good_weight: float = GOOD_WEIGHT) -> float:
    """The threshold above which documents are rejected, from ``quality`` and ``score``.

    It makes most of the share of bad rows above it less ``good_weight`` times
    the share of good rows above it; infinite if no threshold gains. Scores are
    counted up to each one within its bin, on from the bins before.
    """
    cuts = scored.groupBy("score").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    cuts = materialize(cuts.withColumn("bin", F.floor(F.col("score") * SCORE_BINS)), "cuts")
    # at most SCORE_BINS + 1 rows in one window
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = cuts.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    before = bins.select("bin", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in "gb"])
    total = cuts.agg(F.sum("good"), F.sum("bad")).first()
    if not total[0] or not total[1]:
        return float("inf")
    upto = Window.partitionBy("bin").orderBy("score")
    above = lambda c, n, all_rows: 1 - (F.col(n) + F.sum(c).over(upto)) / all_rows
    gain = above("bad", "b", total[1]) - good_weight * above("good", "g", total[0])
    gains = cuts.join(F.broadcast(before), "bin").select("score", gain.alias("gain"))
    best = gains.orderBy(F.desc("gain"), "score").first()
    if best["gain"] <= 0:
        return float("inf")
    upper = cuts.filter(F.col("score") > best["score"]).agg(F.min("score")).first()[0]
    return (best["score"] + (best["score"] if upper is None else upper)) / 2


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )


def with_score(rows: DataFrame, forest: IsolationForest, name: str) -> DataFrame:
    """``rows`` with the forest's score of their statistics in a column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(forest.score(_matrix(batch)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, {name} double")


def fit(statistics: DataFrame, labels: DataFrame):
    """Forest and threshold from all labelled rows that pass the base rule.

    ``labels`` has ``doc_id`` and ``quality`` (1: good). The driver gets counts of
    the nodes, whose number is bounded, and no rows.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    usable = statistics.filter(~base_failed()).join(known, "doc_id").select("quality", *STATISTICS)
    usable = materialize(usable, "labelled")
    box = _box(usable)
    if box is None:
        return None, float("inf")
    feature, cut = random_cuts(*box)
    ends = _ends(usable.filter("quality = 1"), feature, cut)
    if not ends.any():
        return None, float("inf")
    forest = IsolationForest.counted(feature, cut, ends)
    return forest, calibrate(with_score(usable.select("quality", *STATISTICS), forest, "score"))


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``anomaly`` (0 to 1) and ``kept``.

    Without a forest ``anomaly`` is null.
    """
    stats = materialize(with_statistics(docs, doc_id, text), "statistics")
    forest, threshold = fit(stats, labels)
    stats = stats.withColumn("base_failed", base_failed())
    if forest is None:
        return stats.withColumn("anomaly", F.lit(None).cast("double")).withColumn(
            "kept", ~F.col("base_failed")
        )

    return with_score(stats, forest, "anomaly").withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold)
    )


def good_rows(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, columns as they are.

    Statistics are taken once of the labelled rows, for the forest, and once of
    every row where it is read; texts are not moved.
    """
    known = docs.join(labels.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_semi")
    forest, threshold = fit(materialize(with_statistics(known, doc_id, text), "statistics"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [text_statistics(t.as_py()) for t in batch.column(text)]
            s = np.array(s, np.int64).reshape(-1, len(STATISTICS))
            n, repeated = s[:, 0], s[:, 4]
            kept = (n >= MIN_WORDS) & (100 * repeated <= MAX_REPEATED_PERCENT * n)
            if forest is not None:
                kept &= forest.score(features(s)) <= threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
