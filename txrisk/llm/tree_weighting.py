"""Language-model scores by context-tree weighting.

A byte is eight binary decisions, the highest bit first. Every decision is
predicted at all contexts of 0 to 3 preceding bytes, at each by the
Krichevsky-Trofimov estimate of the training counts there. The weighted
probability of a context is half its own estimate's and half the product of its
longer contexts'; it gives the weights by which the estimates of all depths are
mixed. A longer context never seen in training adds no estimate of its own. The
sum of the logarithms is the score of a text, its code length in bits per byte
another column.

Documents are dealt into chunks. Each chunk asks for the words and byte strings
that occur in it; the model answers those, so no task and no driver holds the
model as a whole. Strings are weighed by the pair of bytes before the last one
of them, at most 65,536 to a pair however much text there is; only the 255
decisions after each single byte, added up over pairs, are collected.

Texts are lower-cased in A-Z. Null and empty texts have the end token only, no
bytes and the score 0. A null id counts as the empty text when documents are
held out. Repeated rows are trained on as often as they occur. Without training
documents all estimates are one half. Texts of any length are taken whole; a long
one is a chunk of its own size. An empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import in_chunks
from txrisk.session import materialize

DEPTH = 3
BITS = 8
NODES = (1 << BITS) - 1
HELD_OUT_OF = 10
SMOOTHING = 0.1
# Codes that are weighed at once; all of one pair, of which there are 65,536 at most.
CODES_AT_ONCE = 1 << 17
LN2 = float(np.log(2))
LN10 = float(np.log(10))

# The end of a text as a token; no word is empty.
END = b""


def held_out(doc_id: str = "doc_id") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(HELD_OUT_OF)) == 0


def _lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def codes_of(texts: list[bytes]) -> np.ndarray:
    """Each byte with the DEPTH bytes before it, as a number; zeros stand before a text."""
    pad = bytes(DEPTH)
    raw = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint32)
    codes = np.zeros(max(len(raw) - DEPTH, 0), np.uint32)
    for k in range(DEPTH + 1):
        codes = (codes << np.uint32(8)) | raw[k : k + len(codes)]
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    keep = np.zeros(len(codes) + 1, np.int64)
    np.add.at(keep, begin, 1)
    np.add.at(keep, begin + sizes, -1)
    return codes[np.cumsum(keep[:-1]) > 0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and byte strings of each chunk, counted over its training documents."""
    words: dict[int, Counter] = {}
    strings: dict[int, list] = {}

    def fold(held: list) -> list:
        codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
        found, at = np.unique(codes, return_inverse=True)
        return [(found, np.bincount(at, n, len(found)).astype(np.int64))]

    for batch in batches:
        groups: dict[tuple[int, bool], list[bytes]] = {}
        for chunk, held, text in zip(
            batch.column("chunk").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True
        ):
            groups.setdefault((chunk, held), []).append(_lower(text.as_py()))
        for (chunk, held), texts in groups.items():
            count = words.setdefault(chunk, Counter())
            for t in texts:
                if held:
                    for w in set(t.split()):
                        count[w] += 0
                    count[END] += 0
                else:
                    count.update(t.split())
                    count[END] += 1
            found, n = np.unique(codes_of(texts), return_counts=True)
            pile = strings.setdefault(chunk, [])
            pile.append((found, n * (not held)))
            if len(pile) > 16:
                strings[chunk] = fold(pile)
    for chunk, count in words.items():
        n = len(count)
        yield _rows(np.full(n, chunk, np.int32), list(count), [None] * n, np.fromiter(count.values(), np.int64, n))
    for chunk, pile in strings.items():
        (found, n), *_ = fold(pile)
        yield _rows(np.full(len(n), chunk, np.int32), [None] * len(n), found.astype(np.int64), n)


def _rows(chunk, word, code, n) -> pa.RecordBatch:
    arrays = [pa.array(chunk), pa.array(word, pa.binary()), pa.array(code, pa.int64()), pa.array(n)]
    return pa.RecordBatch.from_arrays(arrays, ["chunk", "word", "code", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series beyond 8, by the recurrence below."""
    x = np.asarray(x, np.float64).copy()
    less = np.zeros_like(x)
    while (small := x < 8).any():
        less[small] += np.log(x[small])
        x[small] += 1
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - less


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class _Level:
    """Decision ``k`` at all contexts of one depth, told apart by ``keys``."""

    def __init__(self, keys: np.ndarray, bit: np.ndarray, n: np.ndarray):
        self.keys, self.at = np.unique(keys, return_inverse=True)
        self.ones = np.bincount(self.at, n * bit, len(self.keys))
        self.zeros = np.bincount(self.at, n * (1 - bit), len(self.keys))
        self.log_e = log_kt(self.zeros, self.ones)
        self.log_w = self.log_e

    def weigh(self, longer: _Level, parent: np.ndarray) -> None:
        """Mix with the product over the longer contexts; ``parent`` places those here."""
        product = np.bincount(parent, longer.log_w, len(self.keys))
        self.log_w = np.logaddexp(self.log_e, product) - LN2

    def own_weight(self) -> np.ndarray:
        return np.exp(np.minimum(self.log_e - LN2 - self.log_w, 0))

    def estimate(self, bit: np.ndarray) -> np.ndarray:
        hits = np.where(bit == 1, self.ones[self.at], self.zeros[self.at])
        return (hits + 0.5) / (self.zeros[self.at] + self.ones[self.at] + 1)

    def seen(self) -> np.ndarray:
        return (self.zeros + self.ones)[self.at] > 0


def _levels(codes: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, dict[int, _Level]]:
    """Decision ``k``: its bit, its node, and its contexts of depth 2 to DEPTH, all of each pair."""
    byte = codes & 255
    bit = (byte >> (BITS - 1 - k)) & 1
    prefix = byte >> (BITS - k)
    levels: dict[int, _Level] = {}
    for depth in range(DEPTH, 1, -1):
        context = (codes >> 8) & ((1 << (8 * depth)) - 1)
        levels[depth] = _Level((context << 8) | prefix, bit, n)
        if depth < DEPTH:
            longer = levels[depth + 1]
            shorter = longer.keys & ((1 << (8 * (depth + 1))) - 1)
            levels[depth].weigh(longer, np.searchsorted(levels[depth].keys, shorter))
    return bit, (1 << k) | prefix, levels


def _by_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts ordered by pair, some whole pairs at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        codes, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
        held.append((codes, n))
        if sum(len(c) for c, _ in held) < CODES_AT_ONCE:
            continue
        codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
        pair = (codes >> 8) & 0xFFFF
        last = int(np.searchsorted(pair, pair[-1]))  # the last pair may go on
        if last:
            yield codes[:last], n[:last]
        held = [(codes[last:], n[last:])]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


SUMS = ("zeros", "ones", "log_w")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and weighted probabilities of all pairs of a task, added up by last byte and node."""
    sums = np.zeros((3, 256 * (NODES + 1)))
    for codes, n in _by_pairs(batches):
        for k in range(BITS):
            _, _, levels = _levels(codes, n, k)
            level = levels[2]
            at = ((level.keys >> 8) & 255) * (NODES + 1) + ((1 << k) | (level.keys & 255))
            for row, values in enumerate((level.zeros, level.ones, level.log_w)):
                sums[row] += np.bincount(at, values, sums.shape[1])
    sums = sums.reshape(3, 256, NODES + 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(256, dtype=np.int32))] + [pa.array(list(a), pa.list_(pa.float64())) for a in sums], ["last", *SUMS]
    )


def _added(table: pa.Table) -> pa.Table:
    sums = [np.sum(table.column(c).to_pylist(), axis=0).tolist() for c in SUMS]
    return pa.table({"last": pa.array([table.column("last")[0].as_py()], pa.int32())} | {c: [a] for c, a in zip(SUMS, sums, strict=True)})


def _answers(below: np.ndarray, root: np.ndarray):
    """The decimal logarithm of the byte's probability after its context.

    ``below`` and ``root`` have zeros, ones and own weight by node, the first by
    last byte as well.
    """

    def mixed(figures: np.ndarray, bit: np.ndarray, seen: np.ndarray, p: np.ndarray) -> np.ndarray:
        zeros, ones, own = figures
        estimate = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
        w = np.where(seen, own, 1.0)
        return w * estimate + (1 - w) * p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n in _by_pairs(batches):
            total, last = np.zeros(len(codes)), (codes >> 8) & 255
            for k in range(BITS):
                bit, node, levels = _levels(codes, n, k)
                p = levels[DEPTH].estimate(bit)
                for depth in range(DEPTH - 1, 1, -1):
                    w = np.where(levels[depth + 1].seen(), levels[depth].own_weight()[levels[depth].at], 1.0)
                    p = w * levels[depth].estimate(bit) + (1 - w) * p
                here = below[:, last, node]
                p = mixed(here, bit, levels[2].seen(), p)
                p = mixed(root[:, node], bit, here[0] + here[1] > 0, p)
                total += np.log(p)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total / LN10)], ["code", "log10_p"])

    return run


def _weighed(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros, ones and own weight, and the weighted probability, from SUMS over longer contexts."""
    zeros, ones, product = sums
    log_e = log_kt(zeros, ones)
    log_w = np.logaddexp(log_e, product) - LN2
    return np.stack([zeros, ones, np.exp(np.minimum(log_e - LN2 - log_w, 0))]), log_w


def tables(of_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_answers` needs of single bytes and of the root, from SUMS by last byte and node."""
    below, log_w = _weighed(of_last)
    root, _ = _weighed(np.stack([of_last[0].sum(axis=0), of_last[1].sum(axis=0), log_w.sum(axis=0)]))
    return below, root


def _score(chunk_docs: pa.Table, answers: pa.Table) -> pa.Table:
    is_word = answers.column("code").is_null().to_numpy()
    value, count = answers.column("value").to_numpy(), answers.column("count").to_numpy()
    words = dict(zip(answers.column("word").filter(pa.array(is_word)).to_pylist(), range(int(is_word.sum())), strict=True))
    word_value, word_known = value[is_word], count[is_word] > 0
    codes = answers.column("code").to_numpy(zero_copy_only=False)[~is_word].astype(np.int64)
    by_code, of_code = pd.Index(codes), value[~is_word]
    out = {c: [] for c in ("n_tokens", "n_known", "base", "score", "n_bytes")}
    for text in chunk_docs.column("text"):
        t = _lower(text.as_py())
        tokens = t.split()
        tokens.append(END)
        at = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        out["n_tokens"].append(len(tokens))
        out["n_known"].append(int(word_known[at].sum()))
        out["base"].append(float(word_value[at].sum()))
        out["score"].append(float(of_code[by_code.get_indexer(codes_of([t]).astype(np.int64))].sum()) if t else 0.0)
        out["n_bytes"].append(len(t))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
    return pa.table([chunk_docs.column("doc_id"), chunk_docs.column("held_out"), *arrays], ["doc_id", "held_out", *out])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: token counts, base score, score and bits per byte.

    ``base_score`` is the smoothed unigram log10 probability of words and end,
    ``score`` the tree's log10 probability of the bytes.
    """
    chunks = in_chunks(docs, doc_id, text).withColumn("held_out", held_out())
    id_type = chunks.schema["doc_id"].dataType.simpleString()
    counted = materialize(
        chunks.mapInArrow(_count, "chunk int, word binary, code bigint, n bigint"), "counts"
    )
    def with_total(key: str, name: str) -> DataFrame:
        """A row for each key and chunk with the key's count, one of them marked."""
        same, rows = f"over (partition by {key})", counted.filter(f"{key} is not null")
        return materialize(
            rows.selectExpr(key, "chunk", f"sum(n) {same} as n", f"row_number() over (partition by {key} order by chunk) = 1 as first"),
            name,
        )

    words, codes = with_total("word", "words"), with_total("code", "strings")
    n_all, n_distinct = (
        words.filter("first").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    )
    pair = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))
    by_pair = codes.filter("first").select("code", "n", pair.alias("pair"))
    by_pair = by_pair.repartition("pair").sortWithinPartitions("pair", "code")
    sums = "last int, zeros array<double>, ones array<double>, log_w array<double>"
    # 256 rows of three arrays of 256 numbers
    parts = by_pair.mapInArrow(_pair_sums, sums).groupBy("last").applyInArrow(_added, sums).toArrow().to_pydict()
    of_last = np.zeros((3, 256, NODES + 1))
    for row, name in enumerate(SUMS):
        for last, values in zip(parts["last"], parts[name], strict=True):
            of_last[row, last] = values
    model = by_pair.mapInArrow(_answers(*tables(of_last)), "code bigint, log10_p double")

    per_word = words.select(
        "chunk",
        "word",
        F.lit(None).cast("long").alias("code"),
        F.log10(F.col("n") + SMOOTHING).alias("value"),
        F.col("n").alias("count"),
    )
    per_code = codes.select("code", "chunk").join(model, "code").select(
        "chunk",
        F.lit(None).cast("binary").alias("word"),
        "code",
        F.col("log10_p").alias("value"),
        F.lit(0).cast("long").alias("count"),
    )
    scored = (
        chunks.groupBy("chunk")
        .cogroup(per_word.unionByName(per_code).groupBy("chunk"))
        .applyInArrow(
            _score,
            f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint,"
            " base double, score double, n_bytes bigint",
        )
    )
    divisor = float(np.log10(n_all + SMOOTHING * (n_distinct + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * divisor).alias("base_score"),
        "score",
        (F.col("score") * (-LN10 / LN2) / F.nullif(F.col("n_bytes"), F.lit(0))).alias("bits_per_byte"),
    )
