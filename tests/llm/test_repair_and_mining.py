"""The factorisation machine, conversation repair and hard negatives against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.llm import conversations, factorisation, negatives, queries

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant", "system", "user", "assistant", None, "tool", "")
TEXTS = ("Hi.", "No", "Yes!", "  ", "", None, "Hi.", "x" * 40_000 + "?")


# -- conversations ---------------------------------------------------------


def allowed(state, initial):
    """Whether a turn may follow, by the initial of the last one (empty: none)."""
    return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state] and initial != ""


def with_insertions(best):
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    todo = list(best)
    while todo:
        cost, audit, said = best[state := todo.pop()]
        to = due[state]
        new = (cost + 3, audit + "I", [*said, ({"u": "user", "a": "assistant"}[to], "")])
        if to not in best or new[:2] < best[to][:2]:
            best[to] = new
            todo.append(to)
    return best


def repaired(rows):
    """Figures of one conversation from all its cheapest edits, state by state."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None
        faults.append(fault or ("truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    best = with_insertions({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        following = {}

        def offer(state, cost, audit, said):
            if state not in following or (cost, audit) < following[state][:2]:
                following[state] = (cost, audit, said)

        for state, (cost, audit, said) in best.items():
            offer(state, cost + 4, audit + "D", said)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if allowed(state, role[:1]):
                offer(role[:1], cost + more, audit + "K", [*said, (role, text)])
            for other in ("user", "assistant"):
                if allowed(state, other[0]):
                    offer(other[0], cost + more + 3, audit + "R", [*said, (other, text)])
        best = with_insertions(following)
    cost, audit, said = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, digest)


def repairs(table):
    damaged = {}
    for conv, turn, role, text in table:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = damaged.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)

    def order(row):
        digest = hashlib.md5(f"{len(row[1])}:{row[1]}{row[2]}".encode()).hexdigest()
        return (row[0] is not None, row[0] or 0, digest)

    return {conv: repaired(sorted(rows, key=order)) for conv, rows in damaged.items()}


def random_conversations():
    rnd = random.Random(5)
    table = [
        (conv, rnd.choice([t, t, t, None, t + 1]), rnd.choice(ROLES), rnd.choice(TEXTS))
        for conv in [*range(150), None]
        for t in range(rnd.choice([1, 2, 3, 5, 8]))
    ]
    # one conversation with a third of the rows, another of copies of one row
    table += [
        (1000, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Hi.", f"No {t}", f"Yes! {t}", " "]))
        for t in range(80)
        for _ in range(3)
    ]
    return table + [(2000, 5, "user", "Same.")] * 50


def in_order(figures):
    return {r.conv_id: tuple(r)[1:] for r in figures.collect()}


@pytest.mark.parametrize("rows_of_a_slice", [1 << 18, 40])
def test_conversations(spark, rows_of_a_slice):
    """Whole conversations, and ones cut into many slices."""
    table = random_conversations()
    df = spark.createDataFrame(
        [(*row, "other", 1) for row in table],
        "conv_id bigint, turn bigint, role string, text string, digest string, pos int",
    )
    damaged = conversations.damage(df)
    got = conversations.with_all(conversations.repair(damaged, rows_of_a_slice=rows_of_a_slice), df)
    assert in_order(got) == repairs(table)


def test_conversation_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{LARGER}/conversations.parquet").collect()]
    got = queries.op12_conversation_repair(spark, LARGER)
    assert got.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ]
    assert in_order(got) == repairs(table)


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([(7, 1, "user", "A.")], "conv_id int, turn int, role string, text string")
    assert conversations.repair(df.limit(0)).count() == 0
    (only,) = conversations.with_all(conversations.repair(df.limit(0)), df).collect()
    assert tuple(only) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    (alone,) = conversations.repair(df).collect()
    assert (alone.cost, alone.audit) == (3, "KI")


# -- hard negatives --------------------------------------------------------


def mined(rows):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not abs(x) < 2**19 for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        good.append((i, [math.floor(256 * x) for x in v], label))
    size = max((len(v) for _, v, _ in good), default=0)
    whole = np.array([v + [0] * (size - len(v)) for _, v, _ in good], object).reshape(len(good), size)
    out = []

    def order(s):
        return lambda j: (-s[j], good[j][0] is None, good[j][0] or 0)

    for a, (i, _, label) in enumerate(good):
        if i is None or i % 100:
            continue
        s = [int(x) for x in whole.dot(whole[a])]
        close = sorted((j for j in range(len(good)) if j != a and good[j][2] == label), key=order(s))
        for p in close[:5]:
            hard = [
                j for j in range(len(good)) if good[j][2] != label and 30 * s[p] <= 100 * s[j] <= 90 * s[p]
            ]
            hard = sorted(hard, key=order(s))[:10]
            out += [(i, good[p][0], n, good[j][0], s[p], s[j]) for n, j in enumerate(hard, 1)]
    return sorted(out, key=str)


def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    rows = [
        (i, (base[i % 30] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist(), int(rng.integers(0, 10)))
        for i in range(900)
    ]
    rows += [(i, rows[5][1], int(rng.integers(0, 3))) for i in range(900, 1300)]  # one common vector
    nan, inf = float("nan"), float("inf")
    return rows + [
        (100, rows[7][1], 2), (100, rows[7][1], 2), (None, rows[9][1], 1), (5, None, 1), (6, [nan] * 8, 1),
        (7, rows[3][1], None), (8, [None] * 8, 2), (200, [], 3), (300, [1.0, 2.0], 4), (9, [inf] * 8, 3),
        (400, [1e5] * 8, 3), (401, [9e4] * 8, 3), (402, [3e4] * 8, 4),
        (500, [5e5] * 8, 5), (501, [4.9e5] * 8, 5), (502, [2e5] * 8, 6), (503, [1e6] * 8, 6),
    ]


@pytest.mark.parametrize(("block_rows", "extent_rows"), [(2048, 1 << 16), (16, 64)])
def test_negatives(spark, block_rows, extent_rows):
    """All rows in one extent, and in twenty with blocks chosen by their bounds."""
    df = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>, label int")
    table = [tuple(r) for r in df.collect()]
    df = df.withColumns({"label": F.expr(queries.RELABELLED), "extent": F.lit(3), "row": F.lit("x")})
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, block_rows=block_rows, extent_rows=extent_rows)
    assert sorted(map(tuple, got.collect()), key=str) == mined(table)


def test_negatives_query(spark):
    table = spark.read.parquet(f"{LARGER}/embeddings.parquet").select("vec_id", "embedding", "label")
    got = queries.op13_hard_negatives(spark, LARGER)
    assert sorted(map(tuple, got.collect()), key=str) == mined([tuple(r) for r in table.collect()])
    assert negatives.mine(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_leave_blocks_out():
    """No product lies outside the bounds of its block; far blocks are not read for near scores."""
    rng = np.random.default_rng(2)
    q = np.floor(256 * rng.normal(size=(20, 6)))
    centres = 20 * rng.normal(size=(40, 6))
    blocks = [np.floor(256 * (c + 0.1 * rng.normal(size=(50, 6)))) for c in centres]
    low, high = (np.array([f(b, axis=0) for b in blocks]) for f in (np.min, np.max))
    least, most = negatives.bounds(q, low, high)
    for n, block in enumerate(blocks):
        products = q @ block.T
        assert (products.min(axis=1) >= least[:, n]).all() and (products.max(axis=1) <= most[:, n]).all()
    best = np.max([(q @ b.T).max(axis=1) for b in blocks], axis=0)
    need = negatives._wanted(q, [[(int(s), negatives.HIGH)] for s in best], low, high)
    assert need.any(axis=1).all() and need.mean() < 0.2


def test_hilbert_order_is_a_walk_over_neighbours():
    """Successive cells of the whole grid differ by one step in one dimension."""
    grid = np.array(np.meshgrid(*[range(4)] * 3)).reshape(3, -1).T
    order = sorted(range(len(grid)), key=negatives.hilbert_keys(grid).__getitem__)
    assert (np.abs(np.diff(grid[order].astype(int), axis=0)).sum(axis=1) == 1).all()


# -- factorisation machine -------------------------------------------------


def test_linear_time_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    size = factorisation.BUCKETS + len(factorisation.STRUCTURE)
    zero, one = np.zeros(len(factorisation.STRUCTURE)), np.ones(len(factorisation.STRUCTURE))
    machine = factorisation.Machine(
        0.3, rng.normal(size=size) * 0.1, rng.normal(size=(size, factorisation.RANK)) * 0.1, zero, one
    )
    bucket, value = np.array([3, 77, 1024]), np.array([0.2, 0.9, 0.4])
    figures = rng.normal(size=len(zero)).tolist()
    at = [*bucket.tolist(), *range(factorisation.BUCKETS, size)]
    x = [*value.tolist(), *figures]
    margin = machine.bias + sum(machine.weights[i] * v for i, v in zip(at, x, strict=True))
    for n in range(len(at)):
        for m in range(n):
            margin += float(machine.factors[at[n]] @ machine.factors[at[m]]) * x[n] * x[m]
    assert machine.score(bucket, value, figures) == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)


def test_factorisation_query(spark):
    """Held-out rows are judged as labelled; ids, folds and predictions as stated."""
    docs = {r.doc_id for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = queries.op11_factorisation(spark, LARGER).collect()
    assert {r.doc_id for r in got} == docs and len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    kept = [p for q, p in known if q == 1]
    gone = [1 - p for q, p in known if q == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(gone) >= 0.8 * len(gone) and len(gone) >= 5


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(factorisation.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [
        {r.doc_id: r.score for r in factorisation.judge(docs, given).collect()} for given in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_factorisation_odd_rows(spark):
    """Nulls, empty, long, repeated texts; other columns; no labels of one kind."""
    rows = [
        (None, None, None, 1), (1, "", 0, 1), (2, "word " * 400_000, None, 1), (3, "a b c", -5, 1),
        (3, "a b c", -5, 1), (4, "\t\n", 9, 1), (6, "x" * 100_000, 3, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, quality int")
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (3, 1), (3, 0), (4, 7), (6, None), (None, 1)], "doc_id bigint, quality int"
    )
    for known in (labels, labels.filter("quality = 1"), labels.limit(0)):
        got = factorisation.judge(docs, known).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        same = [r.score for r in got if r.doc_id == 3]
        assert same[0] == same[1] and next(r for r in got if r.doc_id is None).held_out
    assert factorisation.judge(docs.limit(0), labels).count() == 0
