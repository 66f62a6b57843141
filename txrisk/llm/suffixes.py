"""Removal of repeated passages by suffix arrays from two-stage sorting.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else
as well. Every start belongs to one anchor, the eight bytes with the smallest
hash among its ``length`` bytes, and to a band of distances to it. Starts of one
band share a core of bytes that all their strings contain, so strings can only
be equal where cores are. Cores are counted over all texts; where one occurs
twice, the bands are told apart by their bytes, and bands with one core but
different bytes go into a suffix array.

The array is made in two stages. Suffixes smaller than their successors are
sorted directly; all others are induced from their successors by one scan over
the buckets of first bytes. Neighbours whose common prefix reaches ``length``
are repeated, and so is what occurs more than once with the same bytes.

Null and empty texts have no bytes. Copies of a text are compared once, counted
as often as they occur. Repeated rows are occurrences like any other. Matches
are within UTF-8 bytes and never cross texts. Long texts are cut into bands piece
by piece and never shortened. Equal strings count alike wherever they stand, so
there are no ties to settle. Null ids are kept; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import shuffle_parts, text_or_empty
from txrisk.session import materialize

LENGTH = 400
GRAM = 8
# Starts that a task cuts bands from at once, and that it sorts at once where the
# bands of one core allow.
STARTS_AT_ONCE = 1 << 20
STARTS_OF_A_SORT = 1 << 17


def band_width(length: int) -> int:
    return max(1, length // 2)


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first one highest."""
    n = len(raw) - GRAM + 1
    words = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM):
        words = (words << np.uint64(8)) | raw[k : k + n]
    return words


def bands(text: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Hash of the core, hash of all bytes, first start and number of starts of each band."""
    raw = np.frombuffer(text, np.uint8)
    out = []
    digest = xxhash.xxh3_64_intdigest
    width, grams = band_width(length), length - GRAM + 1
    for base in range(0, len(raw) - length + 1, STARTS_AT_ONCE):
        part = raw[base : base + STARTS_AT_ONCE + length - 1]
        mixed = words_at(part) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.uint64(0xFFFFFFFF)
        key = (mixed & ~low) | np.arange(len(mixed), dtype=np.uint64)
        starts, span = len(part) - length + 1, 1
        while 2 * span <= grams:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[:starts], key[grams - span : grams - span + starts])
        anchor = (key & low).astype(np.int64)
        band = (anchor - np.arange(starts)) // width
        first = np.flatnonzero(
            np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (band[1:] != band[:-1])])
        )
        count = np.diff(np.append(first, starts))
        near = base + anchor[first] - band[first] * width  # the last start the band could have
        for lo, n, at in zip((first + base).tolist(), count.tolist(), near.tolist(), strict=True):
            core = text[at : at - width + 1 + length]
            out.append((digest(core), digest(text[lo : lo + n - 1 + length], seed=1), lo, n))
    return out


def _sort_directly(text: bytes, words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Starts by their next ``length`` bytes: by eight bytes first, then within ties."""
    at = at[np.argsort(words[at], kind="stable")]
    w = words[at]
    same = w[1:] == w[:-1]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True):
        at[a:b] = sorted(at[a:b].tolist(), key=lambda p: text[p : p + length])
    return at


def suffix_order(parts: list[tuple[bytes, int]], length: int):
    """The order of the first ``n`` suffixes of each part, by two-stage sorting.

    Returns the joined bytes, the word at each place, the suffix array (places in
    the joined bytes), and the places where parts begin. A part ends with a
    sentinel smaller than any byte.
    """
    text = b"\0".join(p for p, _ in parts) + b"\0"
    raw = np.frombuffer(text, np.uint8)
    sizes = np.array([len(p) for p, _ in parts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    end = begin + sizes  # the sentinel of each part
    values = raw.astype(np.int16)
    values[end] = -1
    # a suffix is smaller than its successor if the next byte that differs is larger
    differs = np.flatnonzero(values[1:] != values[:-1])
    small = np.zeros(len(raw), bool)
    following = differs[np.minimum(np.searchsorted(differs, np.arange(len(raw))), len(differs) - 1)] if len(differs) else np.zeros(len(raw), np.int64)
    has = np.arange(len(raw)) <= following
    small[has] = values[following[has] + 1] > values[following[has]]
    small[end] = True
    # the wanted suffixes, and after the last of a part those it is induced from
    wanted = np.zeros(len(raw) + 1, np.int8)
    counts = np.array([n for _, n in parts])
    np.add.at(wanted, begin, 1)
    np.add.at(wanted, begin + counts, -1)
    wanted = np.cumsum(wanted[:-1]).astype(bool)
    ends_chain = np.flatnonzero(small)
    member = wanted.copy()
    last = begin + counts - 1
    to = ends_chain[np.searchsorted(ends_chain, last)]
    for a, b in zip(last.tolist(), to.tolist(), strict=True):
        member[a : b + 1] = True

    padded = np.concatenate([raw, np.zeros(GRAM - 1, np.uint8)])
    words = words_at(padded)
    sentinel = np.zeros(len(raw), bool)
    sentinel[end] = True
    direct = np.flatnonzero(member & small & ~sentinel)
    direct = _sort_directly(text, words, direct, length)
    direct_of = np.searchsorted(raw[direct], np.arange(257))
    pushed: list[list[np.ndarray]] = [[] for _ in range(256)]

    def before(places: np.ndarray) -> np.ndarray:
        """Their predecessors that are to be sorted."""
        p = places[places > 0] - 1
        return p[member[p] & ~sentinel[p]]

    def push(places: np.ndarray, above: int) -> None:
        p = before(places)
        p = p[raw[p] > above]
        p = p[np.argsort(raw[p], kind="stable")]
        cuts = np.flatnonzero(np.diff(raw[p])) + 1
        for piece in np.split(p, cuts):
            if len(piece):
                pushed[raw[piece[0]]].append(piece)

    push(np.flatnonzero(member & sentinel), -1)
    order = []
    for c in range(256):
        found = pushed[c]
        todo = np.concatenate(found) if found else np.zeros(0, np.int64)
        bucket = []
        while len(todo):  # a run of one byte is induced from within its bucket
            bucket.append(todo)
            p = before(todo)
            todo = p[raw[p] == c]
        bucket.append(direct[direct_of[c] : direct_of[c + 1]])
        bucket = np.concatenate(bucket)
        if len(bucket):
            order.append(bucket)
            push(bucket, c)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return words, order[wanted[order]], begin


def common_prefixes(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the next one in the order, ``length`` at most."""
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, length, GRAM):
        x = words[a[live] + k] ^ words[b[live] + k]
        stop = x != 0
        # leading zero bytes of what differs
        at = live[stop]
        left = x[stop]
        bytes_equal = np.zeros(len(left), np.int64)
        for j in range(1, GRAM):
            bytes_equal += (left >> np.uint64(8 * (GRAM - j))) == 0
        common[at] = k + bytes_equal
        live = live[~stop]
        if not len(live):
            break
    common[live] = length
    return np.minimum(common, length)


def repeated_starts(parts: list[tuple[bytes, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each part (bytes, number of starts) which starts have their string elsewhere too."""
    words, order, begin = suffix_order(parts, length)
    words = np.concatenate([words, np.zeros(length, np.uint64)])
    flag = np.zeros(len(words), bool)
    long = common_prefixes(words, order, length) >= length
    flag[order[:-1][long]] = True
    flag[order[1:][long]] = True
    return [flag[b : b + n] for b, (_, n) in zip(begin.tolist(), parts, strict=True)]


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"at": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _sorted_batches(length: int):
    """Bands ordered by core to the runs of repeated starts of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []
        starts = 0

        def done() -> pa.RecordBatch:
            flags = repeated_starts([(h[2], h[3]) for h in held], length)
            runs = pa.array([_runs(f) for f in flags], pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
            return pa.RecordBatch.from_arrays(
                [pa.array([h[i] for h in held], pa.int64()) for i in range(2)] + [runs],
                ["core", "whole", "runs"],
            )

        for batch in batches:
            for core, whole, band, n in zip(*(batch.column(c).to_pylist() for c in ("core", "whole", "bytes", "n")), strict=True):
                if held and held[-1][0] != core and starts >= STARTS_OF_A_SORT:
                    yield done()
                    held, starts = [], 0
                held.append((core, whole, band, n))
                starts += n
        if held:
            yield done()

    return run


def spans_of(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """The maximal spans covered by the strings that begin in ``runs``."""
    spans: list[tuple[int, int]] = []
    for r in sorted(runs, key=lambda r: r["at"]):
        lo, hi = r["at"], r["at"] + r["n"] - 1 + length
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], hi))
        else:
            spans.append((lo, hi))
    return spans


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of ``text`` without ``spans``."""
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return b"".join(kept)


def repeats_by_text(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """For every distinct text with repeated strings: ``key`` (its SHA-256) and the ``runs`` of their starts.

    Stored. Texts move only to give the bytes of bands that share a core with
    different ones, and only those that have such bands, once for all copies.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    texts = docs.select(text_or_empty(text).alias("text")).select(F.sha2("text", 256).alias("key"), "text")
    band = "struct<core:bigint,whole:bigint,at:int,n:int>"
    kinds = pa.list_(pa.struct([("core", pa.int64()), ("whole", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))

    def cut_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                found = np.array(bands(t.as_py().encode("utf-8", "surrogatepass"), length), np.uint64).reshape(-1, 4)
                signed = found.view(np.int64)
                rows.append([dict(zip(("core", "whole", "at", "n"), r, strict=True)) for r in signed.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, kinds)], ["key", "bands"])

    long_enough = texts.filter(F.octet_length("text") >= length)
    table = long_enough.mapInArrow(cut_bands, f"key string, bands array<{band}>")
    table = materialize(table.withColumn("row", F.monotonically_increasing_id()), "bands")
    rows = table.select("row", F.explode("bands").alias("b")).select("row", "b.*")
    cores = rows.groupBy("core").agg(
        F.count(F.lit(1)).alias("times"), F.min("whole").alias("a"), F.max("whole").alias("b")
    )
    # stored, so that the join below reads plain exchanges, whose hot keys can be split
    cores = materialize(
        cores.filter("times > 1").select("core", (F.col("a") == F.col("b")).alias("alike")), "cores"
    )
    repeated = materialize(rows.join(cores, "core"), "repeated")

    # one occurrence of each band that shares its core with a different one
    mixed = repeated.filter("not alike").groupBy("core", "whole").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "at", "n")).alias("one")
    )
    mixed = materialize(mixed, "mixed")
    keys = table.select("row", "key")
    wanted = mixed.groupBy(F.col("one.row").alias("row")).agg(
        F.collect_list(F.struct("core", "whole", "one.at", "one.n")).alias("wanted")
    )
    wanted = materialize(
        wanted.join(keys, "row").groupBy("key").agg(F.flatten(F.collect_set("wanted")).alias("wanted")),
        "wanted",
    )
    touched = texts.join(wanted, "key").dropDuplicates(["key"])

    def cut_out_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, bands_ in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                if bands_:
                    raw = t.as_py().encode("utf-8", "surrogatepass")
                    out += [(b["core"], b["whole"], raw[b["at"] : b["at"] + b["n"] - 1 + length], b["n"]) for b in bands_]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)],
                ["core", "whole", "bytes", "n"],
            )

    pieces = touched.select("text", "wanted").mapInArrow(
        cut_out_bands, "core bigint, whole bigint, bytes binary, n int"
    )
    found = (
        pieces.repartition(shuffle_parts(docs), "core")
        .sortWithinPartitions("core", "whole")
        .mapInArrow(_sorted_batches(length), "core bigint, whole bigint, runs array<struct<at:int,n:int>>")
    )
    found = found.join(mixed.select("core", "whole", "times"), ["core", "whole"]).select(
        "core", "whole", F.when(F.col("times") < 2, F.col("runs")).alias("runs")
    )
    found = materialize(found, "found")
    whole_band = F.array(F.struct(F.lit(0).alias("at"), F.col("n")))
    of_mixed = repeated.filter("not alike").join(found, ["core", "whole"]).withColumn(
        "runs", F.coalesce("runs", whole_band)
    )
    of_alike = repeated.filter("alike").withColumn("runs", whole_band)
    moved = F.expr("transform(runs, r -> named_struct('at', at + r.at, 'n', r.n))")
    runs = of_alike.select("row", moved.alias("runs")).unionByName(of_mixed.select("row", moved.alias("runs")))
    runs = runs.filter("size(runs) > 0").groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))
    by_key = runs.join(keys, "row").groupBy("key").agg(F.first("runs").alias("runs"))
    return materialize(by_key, "runs")


def _without(docs: DataFrame, text: str, length: int, runs: DataFrame, columns: str, cut) -> DataFrame:
    """``docs`` with its texts and their ``runs``, handed in batches to ``cut``.

    Texts move for this join only if the runs are too many to be sent to them.
    """
    key, found = "_text_key_", "_text_runs_"
    keyed = docs.withColumn(key, F.sha2(text_or_empty(text), 256))
    joined = keyed.join(runs.select(F.col("key").alias(key), F.col("runs").alias(found)), key, "left")
    return joined.select(*docs.columns, key, found).mapInArrow(lambda batches: map(cut, batches), columns)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``text``; a row for each row.

    ``text`` is what is left, without the rest of a character that a cut goes
    through; the digest is of all bytes left.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, digest, runs in zip(
            batch.column("text"), batch.column("_text_key_").to_pylist(), batch.column("_text_runs_").to_pylist(), strict=True
        ):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            spans = spans_of(runs or [], length)
            left = cut_out(raw, spans) if spans else raw
            digest = hashlib.sha256(left).hexdigest() if spans else digest
            out.append((len(raw), len(raw) - len(left), len(spans), digest, left.decode("utf-8", "ignore")))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
        )

    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string"
    return _without(source, "text", length, repeats_by_text(source, "text", length), schema, cut)


def without_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, least_words: int = 0
) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, columns as they are.

    A passage is a maximal span covered by repeated strings; one of fewer than
    ``least_words`` words stays. Where a cut goes through a character, the rest
    of the character goes too. A text that loses nothing stays as it is, null
    included.
    """
    names = docs.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for t, runs in zip(batch.column(text), batch.column("_text_runs_").to_pylist(), strict=True):
            value = t.as_py()
            if runs:
                raw = value.encode("utf-8", "surrogatepass")
                spans = [(a, b) for a, b in spans_of(runs, length) if len(raw[a:b].split()) >= least_words]
                value = cut_out(raw, spans).decode("utf-8", "ignore") if spans else value
            texts.append(value)
        kept = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(kept, names)

    return _without(docs, text, length, repeats_by_text(docs, text, length), docs.schema, cut)
