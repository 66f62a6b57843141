"""The training-data operators against brute force, on edge rows and small tables."""

import functools
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from txrisk.llm import (
    licenses,
    mixing,
    neighbours,
    pieces,
    quality,
    queries,
    sharding,
    simhash,
    suffixes,
    tree_weighting,
    warc,
)
from txrisk.session import materialize

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, h int, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def edge_docs(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["alpha", "Béta", "gamma,", "delta.", "漢字", "x" * 30, "Under the MIT License", "\t"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    base = text(120)
    near = base[:300] + "Z" + base[301:]
    texts = [None, "", " \n\t", "one", base, base, near, text(40), text(2000) + "a" * 900, "a" * 900, "a" * 1200]
    texts += [base + text(5), text(60), text(60) + "\nSPDX-License-Identifier: MIT or (GPL-2.0-only with x)\n"]
    rows = [(i, t, None, ["b", "a", None][i % 3], None, "c", 1, "r") for i, t in enumerate(texts)]
    rows += [(None, base, "en", "a", 3, "c", 1, "r"), (4, base, None, "b", None, "c", 1, "r"), (4, base, None, "b", None, "c", 1, "r")]
    return spark.createDataFrame(rows, DOCS)


def real_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(spark):
    return [edge_docs(spark), real_docs(spark)]


def fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=3):
    root = {f: f for f in set(fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return find


def key(row):
    return str([str(x) for x in row])


@pytest.mark.parametrize("which", [0, 1])
def test_simhash(spark, which):
    docs = both(spark)[which]
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    find = components([f for _, f in rows])
    smallest = {}
    for i, f in rows:
        if i is not None:
            smallest[find(f)] = min(i, smallest.get(find(f), i))
    want = [(i, f"{f:016x}", smallest.get(find(f))) for i, f in rows]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_crowded_postings_reach_the_same(spark, bits):
    rng = np.random.default_rng(bits)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 250:
        f = int(rng.choice(sorted(fps)))
        for b in rng.integers(0, 20, bits):
            f ^= 1 << int(b)
        fps.add(f)
    find = components(list(fps), bits)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    from txrisk.llm.common import connected_components

    for dense in (4, 10_000):
        found = simhash.links(df, bits, dense)
        assert all((r.a ^ r.b).bit_count() <= bits for r in found.collect())
        roots = {r.node: r.root for r in connected_components(found).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(roots.get(f, f), set()).add(find(f))
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len({find(f) for f in fps})


def test_neighbours_exact_where_small(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:100] = x[0]
    rows = [(i, [float(v) for v in r], "e") for i, r in enumerate(x)]
    bad = [(400, None, ""), (500, [0.0] * 8, ""), (600, [float("nan")] + [1.0] * 7, ""), (700, [1.0], ""), (None, [1.0] * 8, "")]
    df = spark.createDataFrame(rows + rows[:1] + bad, "vec_id bigint, embedding array<float>, part string")
    got = neighbours.search(df, "vec_id % 100 = 0").collect()
    assert {r.query_id for r in got} == {0, 100, 200}
    for q in (0, 100, 200):
        d = [(float(np.sqrt(((x[i].astype(float) - x[q]) ** 2).sum())), i) for i in range(300) if i != q]
        want = sorted(d)[:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert np.allclose([s for *_, s in mine], [s for s, _ in want])
    assert neighbours.search(df.limit(0), "vec_id % 100 = 0").count() == 0


def test_neighbours_recall(spark):
    """A search of 20,000 clustered vectors finds nine tenths of the true neighbours."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 32))
    x = (centres[rng.integers(0, 200, 20_000)] + 0.5 * rng.normal(size=(20_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = neighbours.search(df, "vec_id % 100 = 0").collect()
    wide, found = x.astype(float), {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 100):
        d = ((wide - wide[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(found) == 200 and hits >= 0.9 * 2_000


def naive_trees(rows):
    """Scores by context trees as dictionaries: byte strings of 0 to 3 bytes to counts by decision."""
    counts, longer = {}, {}
    for text, held in rows:
        padded = bytes(3) + text
        for at in range(len(text)):
            byte = padded[at + 3]
            for k in range(8):
                node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
                for depth in range(4):
                    context = padded[at + 3 - depth : at + 3]
                    counts.setdefault((context, node), [0, 0])[bit] += not held
                    if depth < 3:
                        longer.setdefault((context, node), set()).add(padded[at + 2 - depth : at + 3])

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def add(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    @functools.cache
    def weighted(context, node):
        own = kt(*counts[context, node])
        if len(context) == 3:
            return own
        return add(own, sum(weighted(c, node) for c in longer[context, node])) - math.log(2)

    scores = []
    for text, _ in rows:
        padded, total = bytes(3) + text, 0.0
        for at in range(len(text)):
            byte = padded[at + 3]
            for k in range(8):
                node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
                p = None
                for depth in range(3, -1, -1):
                    context = padded[at + 3 - depth : at + 3]
                    figures = counts[context, node]
                    estimate = (figures[bit] + 0.5) / (sum(figures) + 1)
                    if p is None:
                        p = estimate
                        continue
                    w = 1.0
                    if sum(counts[padded[at + 2 - depth : at + 3], node]):
                        w = math.exp(min(0, kt(*figures) - math.log(2) - weighted(context, node)))
                    p = w * estimate + (1 - w) * p
                total += math.log10(p)
        scores.append(total)
    return scores


def test_tree_scores_by_naive_trees(spark, monkeypatch):
    """Edge rows and a small corpus, by pairs a few codes at a time, against dictionaries."""
    docs = edge_docs(spark).filter("doc_id <> 8").unionByName(real_docs(spark).limit(12), allowMissingColumns=True)
    docs = materialize(docs, "trees")
    rows = docs.selectExpr("doc_id", "coalesce(text, '') text", "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 = 0 h").collect()
    scores = naive_trees([(r.text.encode().lower(), r.h) for r in rows])
    want = sorted((str(r.doc_id), round(s, 6)) for r, s in zip(rows, scores, strict=True))
    for at_once in (1 << 17, 50):
        monkeypatch.setattr(tree_weighting, "CODES_AT_ONCE", at_once)
        got = tree_weighting.score(docs).collect()
        assert len(got) == len(rows) > 20
        mine = sorted((str(r.doc_id), round(r.score, 6)) for r in got)
        for (i, x), (j, y) in zip(mine, want, strict=True):
            assert i == j and x == pytest.approx(y, rel=1e-9, abs=1e-5)


@pytest.mark.parametrize("which", [0, 1])
def test_tree_weighting(spark, which):
    docs = both(spark)[which]
    got = tree_weighting.score(docs).collect()
    rows = docs.selectExpr("doc_id", "coalesce(text, '') text", "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 = 0 h").collect()
    tokens = [[*r.text.encode().lower().split(), b""] for r in rows]
    c = Counter(t for r, ts in zip(rows, tokens, strict=True) if not r.h for t in ts)
    n, v = sum(c.values()), len(c)
    want = [
        (r.doc_id, r.h, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(np.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 4))
        for r, ts in zip(rows, tokens, strict=True)
    ]
    mine = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    if which:
        held = [r.bits_per_byte for r in got if r.held_out and r.bits_per_byte]
        assert np.mean(held) < 4.5  # bytes of equal probability cost 8


def test_tree_weighting_is_a_distribution():
    """Probabilities of the 256 bytes after any context sum to one."""
    import pyarrow as pa

    codes = tree_weighting.codes_of([b"abracadabra", b"banana", b"abba"])
    found, n = np.unique(codes, return_counts=True)
    train = dict(zip(found.tolist(), n.tolist(), strict=True))
    for context in (b"\0\0\0", b"bra", b"xan", b"zzz"):
        base = int.from_bytes(context, "big") << 8
        every = sorted(set(train) | {base + b for b in range(256)})
        every.sort(key=lambda c: ((c >> 8) & 0xFFFF, c))
        batch = pa.RecordBatch.from_arrays([pa.array(every), pa.array([train.get(c, 0) for c in every])], ["code", "n"])
        (sums,) = tree_weighting._pair_sums(iter([batch]))
        sums = np.array([sums.column(c).to_pylist() for c in tree_weighting.SUMS])
        t = pa.Table.from_batches(tree_weighting._answers(*tree_weighting.tables(sums))(iter([batch])))
        p = dict(zip(t.column("code").to_pylist(), t.column("log10_p").to_pylist(), strict=True))
        assert abs(sum(10 ** p[base + b] for b in range(256)) - 1) < 1e-9


@pytest.mark.parametrize("which", [0, 1])
def test_mixing(spark, which):
    docs = both(spark)[which]
    rows = mixing.mix(docs).collect()
    texts = [len(WORD.findall(r.text or "")) for r in docs.collect()]
    assert sorted(r["size"] for r in rows) == sorted(texts)
    total, by = sum(texts), {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    open_, target, left = set(order), {}, total
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in over} if over else share
        left -= sum(3 * size[s] for s in over)
        open_ = open_ - over if over else set()
    for s in order:
        largest = max(r["size"] for r in by[s])
        repeated = max(Counter((r.doc_id, r["size"]) for r in by[s]).values())
        assert abs(by[s][0].target - target[s]) < 1e-6 * max(1, target[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= largest * repeated
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(docs).collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in rows)


def test_mixing_many_sources(spark, monkeypatch):
    docs = real_docs(spark)
    want = sorted(map(key, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(key, mixing.mix(docs).collect())) == want


@pytest.mark.parametrize(("which", "length"), [(0, 400), (0, 32), (1, 400), (1, 64)])
def test_suffixes(spark, which, length):
    docs = both(spark)[which]
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    want = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for at in range(len(t) - length + 1):
            if count[t[at : at + length]] > 1:
                gone[at : at + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    got = [tuple(r) for r in suffixes.remove_repeats(docs, length=length).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    cut = suffixes.without_repeats(docs, length=length)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    assert sorted((r.doc_id, r.text or "") for r in cut.filter("doc_id is not null").collect()) == sorted(
        (w[0], w[5]) for w in want if w[0] is not None
    )


def test_passages_of_few_words_stay(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    long, short = words(60), words(40)
    own = [words(30) for _ in range(6)]
    texts = [f"{own[0]} {long} {own[1]}", f"{own[2]}\n{long}\n{own[3]}", f"{own[4]} {short}. {own[4]}", f"{own[5]}; {short} {own[5]}", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in suffixes.without_repeats(docs, length=240, least_words=50).collect()}
    assert got == {0: f"{own[0]}  {own[1]}", 1: f"{own[2]}\n\n{own[3]}", 2: texts[2], 3: texts[3], 4: None, 5: ""}
    everything = {r.doc_id: r.text for r in suffixes.without_repeats(docs, length=240).collect()}
    assert short not in everything[2] and short not in everything[3]


def test_two_stage_order_is_lexicographic():
    rng = np.random.default_rng(5)
    for _ in range(50):
        parts = []
        for _ in range(3):
            raw = bytes(rng.choice(list(b"aab"), rng.integers(20, 60)).tolist())
            parts.append((raw, len(raw) - 15))
        _, order, begin = suffixes.suffix_order(parts, 16)
        text = b"\0".join(p for p, _ in parts) + b"\0"
        assert len(order) == sum(n for _, n in parts)
        prefixes = [text[p : p + 16] for p in order]
        assert prefixes == sorted(prefixes)


@pytest.mark.parametrize("which", [0, 1])
def test_quality(spark, which):
    docs = both(spark)[which]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(docs, labels).collect()
    want = []
    for r in docs.collect():
        text = r.text or ""
        w = WORD.findall(text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        n, cover, seen, dup = Counter(grams), set(), set(), 0
        for i, g in enumerate(grams):
            cover |= {i, i + 1, i + 2} if n[g] > 1 else set()
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed))
    assert sorted((tuple(r)[:7] for r in rows), key=key) == sorted(want, key=key)
    assert all(not r.kept for r in rows if r.base_failed)
    good = quality.good_rows(docs, labels)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in rows)
    none = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)


def test_quality_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge(docs, labels).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_quality_on_labels_it_has_not_seen(spark):
    """Calibrated on four fifths of the labels, judged by the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("unseen", F.expr("crc32(string(doc_id)) % 5 = 0"))
    judged = quality.judge(docs, labels.filter("not unseen")).join(labels.filter("unseen"), "doc_id")
    good, bad = ([r.kept for r in judged.filter(f"quality = {q} and n_words >= 50").collect()] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_licenses(spark):
    for docs in both(spark):
        for r in licenses.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
            lower = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
            places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            assert (r.n_words, r.n_base) == (len(w), len(places))
            assert r.first_word == min((i for i, _ in places), default=None)
            assert r.last_word == max((i for i, _ in places), default=None)
            assert r.base_labels == ",".join(sorted({x for _, x in places}))
            assert r.labels == ",".join(sorted({x for _, x in places} | own_labels(w, r.text or "")))
            assert 0 <= r.score <= 1


def own_labels(words, text):
    """Labels of notices, leftmost and longest, and of tagged expressions, found word by word."""
    phrases = {**{p: x for p, (x, _) in licenses.NOTICES.items()}, **licenses.BASE_PHRASES}
    labels, at = set(), 0
    while at < len(words):
        here = [p.split() for p in phrases if words[at : at + len(p.split())] == p.split()]
        if here:
            longest = max(here, key=len)
            labels.add(phrases[" ".join(longest)])
            at += len(longest)
        else:
            at += 1
    for tag in licenses.TAGS:
        for rest in re.findall(re.escape(tag) + "([^\n]*)", text.lower()):
            try:
                labels |= licenses.evaluate(re.match(r"[a-z0-9.+:() \t-]*", rest)[0].strip())[0]
            except ValueError:
                pass
    return labels


def test_overlapping_notices(spark):
    texts = [
        "the apache license version 2 and the Mozilla Public License",
        "under the mit license cc by nc; SPDX-License-Identifier: MIT or (GPL-2.0-only with LLVM-exception)",
        "License-Expression: tbd\nlicense-expression: isc and (zlib or mit",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got == {
        0: ("apache-2,mpl", 0.9),
        1: ("cc-by-nc,gpl-2.0-only-with-llvm-exception|mit,mit", 1.0),
        2: ("", 0.5),
    }


def test_licence_expressions():
    assert licenses.postfix("mit or apache-2.0 and isc") == ["mit", "apache-2.0", "isc", "and", "or"]
    for text, labels, score in (
        ("mit and isc", {"mit", "isc"}, 1.0),
        ("mit or isc", {"isc|mit"}, 1.0),
        ("mit or (isc or mit)", {"isc|mit"}, 1.0),
        ("mit or isc and zlib", {"isc&zlib|mit"}, 1.0),
        ("(mit or odd) and gpl-2.0-only with classpath-exception-2.0", {"mit", "gpl-2.0-only-with-classpath-exception-2.0"}, 1.0),
        ("mit and odd", {"mit"}, 0.5),
        ("mit or odd", {"mit"}, 1.0),
        ("lgpl-2.1+ with odd", {"lgpl-2.1+"}, 0.5),
        ("odd", set(), 0.5),
        ("llvm-exception", set(), 1.0),
    ):
        assert licenses.evaluate(text) == (labels, score), text
    for wrong in ("", "mit or", "(mit", "mit)", "mit isc", "and mit", "()", "mit (isc)"):
        with pytest.raises(ValueError):
            licenses.evaluate(wrong)


def words(text):
    """A text with a blank before it, cut before each run of blanks."""
    blank = pieces.BLANK
    cut = re.compile(f"{blank}*[^{blank}]+|{blank}+")
    return cut.findall(blank + text.replace(" ", blank)) if text else []


@pytest.mark.parametrize("which", [0, 1])
def test_pieces(spark, which):
    docs = both(spark)[which]
    table = pieces.Pieces.load(queries.PIECE_MODEL)
    encoded = pieces.encode(docs, queries.PIECE_MODEL)
    got = [(r.doc_id, list(r.ids)) for r in encoded.collect()]
    want = [(r.doc_id, [i for w in words(r.text or "") for i in pieces.encode_long(w, table)]) for r in docs.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert encoded.filter("not round_trip").count() == 0
    back = pieces.decode(encoded, queries.PIECE_MODEL)
    assert sorted((r.doc_id, r.text) for r in back.filter("doc_id > 4").collect()) == sorted(
        (r.doc_id, r.text) for r in docs.filter("doc_id > 4").collect()
    )


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], pages.schema)
    placed = warc.in_order(pages.unionByName(odd))
    assert sorted(r.position for r in placed.collect()) == list(range(53))
    records = placed.selectExpr("position", "page_id").join(placed, ["position", "page_id"], "left_semi")
    from pyspark.sql import functions as F

    records = placed.select("position", "page_id", warc.record().alias("record"))
    damaged = records.select("position", "page_id", F.when(F.col("position") == 17, F.concat("record", F.lit("!"))).otherwise(F.col("record")).alias("record"))
    found = warc.audit(warc.manifest(records), warc.manifest(damaged)).collect()
    assert [r.position for r in found] == [17]
    assert warc.audit(warc.manifest(records), warc.manifest(records)).count() == 0
    lost = warc.audit(warc.manifest(records), warc.manifest(records.filter("position < 50"))).collect()
    assert sorted(r.position for r in lost) == [50, 51, 52] and all(r.found is None for r in lost)
    assert warc.audit(warc.manifest(records.limit(0)), warc.manifest(records.limit(0))).count() == 0


def test_sharding(spark):
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9) < 200
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(wrong)
    rows = sharding.place(edge_docs(spark).withColumnRenamed("h", "slot")).collect()
    assert len(rows) == 17 and all(r.shard is not None for r in rows)


def test_empty_tables(spark):
    empty = edge_docs(spark).limit(0)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for result in (
        simhash.near_duplicates(empty),
        simhash.first_of_each(empty),
        tree_weighting.score(empty),
        mixing.mix(empty),
        mixing.mixed_rows(empty),
        suffixes.remove_repeats(empty),
        suffixes.without_repeats(empty),
        quality.judge(empty, labels),
        quality.good_rows(empty, labels),
        licenses.scan(empty),
        pieces.encode(empty, queries.PIECE_MODEL),
        sharding.place(empty),
    ):
        assert result.count() == 0


def test_pipeline_stages(spark):
    docs = edge_docs(spark).unionByName(real_docs(spark), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == columns and docs.count() > 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_native_plans(spark):
    for query in (queries.op4_mixing, queries.op10_sharding):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_quality_counts_every_labelled_row(spark):
    """More rows than any sample held: each is in the forest's counts."""
    n = 30_000
    stats = spark.range(n).selectExpr(
        "id as doc_id", "100L as n_words", "400 + id % 97 as word_chars", "id % 7 as n_symbols",
        "0L as n_dup_lines", "0L as n_repeat_words",
    )
    forest, _ = quality.fit(stats, stats.selectExpr("doc_id", "1 as quality"))
    assert forest.rows == n
    cut = quality.calibrate(spark.range(n).selectExpr("int(id < 29990) as quality", f"id / {n}D as score"))
    assert 29989 / n < cut < 29990 / n


def test_distances_of_the_sample_are_held_in_small_blocks():
    from txrisk.llm import neighbours

    x = np.random.default_rng(1).standard_normal((500, 8))
    assert neighbours.NEAREST_BLOCK * neighbours.SAMPLE_ROWS * 8 <= 16 << 20
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert (np.sort(neighbours.nearest_in(x, 5)) == np.sort(np.argsort(d, axis=1)[:, :5])).all()
