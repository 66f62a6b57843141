"""Repair of the turn structure of conversations by prefix-doubling path ranking.

A conversation should read, by the initials of its roles, as ``(s?(ua)+)?``. Its
rows are kept, given another role or deleted, and empty turns are inserted, at
the least total cost; of the cheapest edits those come out whose initials
(``D``, ``I``, ``K``, ``R``) are the least string.

Rows are first reduced to what the edits depend on: turn, digest of role and
text, initial, faults and number of copies. They are cut by conversation and
turn into slices of even size, so a conversation of any length is spread over
tasks. In a slice

* the cost DP is a product of 4 x 4 matrices under minimum and plus, one for a
  row, taken for all rows at once by doubling; a conversation that goes on in
  the next slice hands on one matrix,
* arcs on which the cost to go is met are the optimal ones. Nodes are ranked by
  the audits that begin there, of one arc first, then of two, four and so on, by
  the ranks of the halves; pointers to the end of such an audit are doubled with
  them. An arc is chosen by its letter and the rank of its end, and the doubled
  pointers mark the path.

The digest of a repaired conversation is taken in order by one task, which holds
one row at a time.

Rows are ordered by turn, nulls first, and rows of one turn by the digest of
role and text. Null roles and texts count as one space, so a null text is blank
and a null role has no legal initial. A null ``conv_id`` is a conversation.
Repeated rows are duplicates. Texts may have any length. An empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.session import materialize

ROWS_OF_A_SLICE = 1 << 18

DELETE_COST = 4
REROLE_COST = 3
INSERT_COST = 3
TRUNCATED_COST = 3

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# Initials by code; any other initial has the code 3.
INITIALS = "sua"
OTHER = 3
LEGAL = np.zeros((4, 4), bool)
LEGAL[0, 1] = LEGAL[1, 2] = LEGAL[2, 1] = True

# States: nothing yet, after the system turn, after a user turn, after an answer.
STATES = 4
SPEAKS = np.array([2, 2, 3, 2])  # the state after the turn that is due
ACCEPTED = np.array([True, False, False, True])
# Where a row of each initial may be kept, and the state after it (-1: not).
KEPT_TO = np.full((4, STATES), -1)
KEPT_TO[0, 0] = 1
KEPT_TO[1, [0, 1, 3]] = 2
KEPT_TO[2, 2] = 3

FAR = np.int64(1) << 60
LETTERS = "DIKR"
D, I, K, R = range(4)  # noqa: E741


def _least_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of matrices under minimum and plus."""
    out = np.full(a.shape[:-2] + (a.shape[-2], b.shape[-1]), FAR)
    for k in range(a.shape[-1]):
        np.minimum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return out


def _insertions() -> np.ndarray:
    """Cheapest insertions that lead from one state to another."""
    cost = np.full((STATES, STATES), FAR)
    np.fill_diagonal(cost, 0)
    cost[np.arange(STATES), SPEAKS] = INSERT_COST
    return np.minimum(_least_plus(cost, cost), cost)


INSERTIONS = _insertions()
# Cost from each state to the end of a conversation.
ENDING = INSERTIONS[:, ACCEPTED].min(axis=1)


class _Slice:
    """The rows of one slice in order, and the pieces of conversations in it."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("pos")
        self.table = table
        ids = table.column("conv_id").combine_chunks()
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        self.rows = len(codes)
        new = np.concatenate([[True], codes[1:] != codes[:-1]])
        self.first = np.flatnonzero(new)
        self.after = np.append(self.first[1:], self.rows)
        self.piece = np.cumsum(new) - 1
        self.ids = ids.take(pa.array(self.first))
        column = lambda name: table.column(name).to_numpy()
        self.code, self.copies = column("code").astype(np.int64), column("copies")
        self.blank, self.first_seen = column("blank"), column("first_seen")
        self.alive = ~self.blank & self.first_seen
        self.truncated = self.alive & column("truncated")

    def edits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cost of deleting and of keeping each row, and the states after Keep and Rerole."""
        delete = DELETE_COST * self.copies
        keep = delete - DELETE_COST + TRUNCATED_COST * self.truncated
        kept_to = np.where(self.alive[:, None], KEPT_TO[self.code], -1)
        reroled_to = np.where(self.alive[:, None], SPEAKS[None, :], -1)
        return delete, keep, kept_to, reroled_to

    def costs(self) -> np.ndarray:
        """For each row the least costs from before it to the end of its piece, by states."""
        delete, keep, kept_to, reroled_to = self.edits()
        step = np.full((self.rows, STATES, STATES), FAR)
        at = np.arange(self.rows)
        for s in range(STATES):
            step[:, s, s] = delete
            for to, cost in ((kept_to[:, s], keep), (reroled_to[:, s], keep + REROLE_COST)):
                there = to >= 0
                r, t = at[there], to[there]
                step[r, s, t] = np.minimum(step[r, s, t], cost[there])
        total = _least_plus(np.broadcast_to(INSERTIONS, step.shape), step)
        shift, longest = 1, int((self.after - self.first).max(initial=0))
        while shift < longest:
            inside = np.flatnonzero(at + shift < self.after[self.piece])
            total[inside] = np.minimum(_least_plus(total[inside], total[inside + shift]), FAR)
            shift *= 2
        return total

    def paths(self, to_go: np.ndarray, final: np.ndarray) -> _Paths:
        """Ranks and pointers, given the cost to go at the end of each piece by state."""
        delete, keep, kept_to, reroled_to = self.edits()
        pieces = len(self.first)
        left = np.minimum((self.costs() + to_go[self.piece][:, None, :]).min(axis=2), FAR)
        # nodes: four for each row, then four for the end of each piece
        cost = np.concatenate([left, to_go]).ravel()
        following = np.arange(1, self.rows + 1)
        following[self.after - 1] = self.rows + np.arange(pieces)
        nodes = np.arange(len(cost))
        state, place = nodes % STATES, nodes // STATES
        target = np.full((len(cost), 4), -1)

        def arc(letter: int, at: np.ndarray, to: np.ndarray, price: np.ndarray) -> None:
            optimal = cost[at] == price + cost[to]
            target[at[optimal], letter] = to[optimal]

        of_rows = nodes[: self.rows * STATES]
        next_place = following[place[of_rows]] * STATES
        arc(D, of_rows, next_place + state[of_rows], delete[place[of_rows]])
        for letter, to, extra in ((K, kept_to, 0), (R, reroled_to, REROLE_COST)):
            to = to.ravel()
            there = of_rows[to >= 0]
            arc(letter, there, next_place[there] + to[there], keep[place[there]] + extra)
        open_end = nodes[(place < self.rows) | np.repeat(np.append(np.zeros(self.rows, bool), final), STATES)]
        open_end = open_end[(place[open_end] < self.rows) | ~ACCEPTED[state[open_end]]]
        arc(I, open_end, place[open_end] * STATES + SPEAKS[state[open_end]], np.int64(INSERT_COST))
        return _Paths(self, target)

    def pieces(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if self.rows else np.zeros(0, np.int64)


class _Paths:
    """Optimal arcs, ranked by the audits that begin with them."""

    def __init__(self, cut: _Slice, target: np.ndarray):
        self.cut, nodes = cut, np.arange(len(target))
        has = target >= 0
        ends = ~has.any(axis=1)
        letter = np.where(ends, -1, has.argmax(axis=1))
        ahead = np.where(ends, nodes, target[nodes, np.maximum(letter, 0)])
        rank, self.pointers = letter + 1, [ahead]
        while not ends[ahead].all():
            rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)[1]
            ahead = ahead[ahead]
            self.pointers.append(ahead)
        rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)[1]
        # an arc by its letter, then by the rank of the audits from its end
        order = np.where(has, np.arange(4) * (rank.max() + 1) + rank[np.maximum(target, 0)], FAR)
        self.letter = np.where(ends, -1, order.argmin(axis=1))
        self.end = ahead

    def exits(self) -> np.ndarray:
        """The state in which each piece is left, by the state in which it is entered."""
        enter = self.cut.first[:, None] * STATES + np.arange(STATES)
        return self.end[enter] % STATES

    def marked(self, entry: np.ndarray) -> np.ndarray:
        on_path = np.zeros(len(self.letter), bool)
        on_path[self.cut.first * STATES + entry] = True
        for ahead in reversed(self.pointers):
            on_path[ahead[on_path]] = True
        return on_path


SUMMARY = (
    "slice int, conv_id {id}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "head int, tail int, costs array<bigint>"
)
DECISION = (
    "conv_id {id}, closing boolean, turn bigint, digest string, kind int, audit string, "
    "inserted string, edit string, cost bigint"
)
CLOSED = "conv_id {id}, audit string, repaired_sha256 string"


def _schema(text: str, rows: DataFrame) -> str:
    return text.format(id=rows.schema["conv_id"].dataType.simpleString())


def _summarise(table: pa.Table) -> pa.Table:
    cut = _Slice(table)
    code, copies = cut.code, cut.copies
    same = cut.piece[1:] == cut.piece[:-1]
    illegal = copies - 1
    illegal[1:] += same & ~LEGAL[code[:-1], code[1:]]
    first = cut.costs()[cut.first].reshape(len(cut.first), STATES * STATES)
    flat = pa.ListArray.from_arrays(
        pa.array(np.arange(len(first) + 1) * STATES * STATES, pa.int32()), pa.array(first.ravel())
    )
    later = np.where(cut.first_seen, copies - 1, copies)
    return pa.table(
        {
            "slice": pa.array(np.full(len(first), table.column("slice")[0].as_py()), pa.int32()),
            "conv_id": cut.ids,
            "blank": cut.pieces(copies * cut.blank),
            "duplicate": cut.pieces(later * ~cut.blank),
            "truncated": cut.pieces(cut.truncated.astype(np.int64)),
            "illegal": cut.pieces(illegal),
            "head": code[cut.first].astype(np.int32),
            "tail": code[cut.after - 1].astype(np.int32),
            "costs": flat,
        }
    )


def _matched(cut: _Slice, known: pa.Table, name: str, otherwise: np.ndarray) -> np.ndarray:
    """Values of ``known`` by piece; a conversation without one lies in this slice alone."""
    values = {i: v for i, v in zip(known.column("conv_id").to_pylist(), known.column(name).to_pylist(), strict=True)}
    if not values:
        return np.broadcast_to(otherwise, (len(cut.first), *np.shape(otherwise))).copy()
    return np.array([otherwise if (v := values.get(i)) is None else v for i in cut.ids.to_pylist()])


def _paths(table: pa.Table, ends: pa.Table) -> tuple[_Slice, _Paths]:
    cut = _Slice(table)
    to_go = _matched(cut, ends, "to_go", ENDING)
    return cut, cut.paths(to_go, _matched(cut, ends, "final", np.array(True)))


def _exits(table: pa.Table, ends: pa.Table) -> pa.Table:
    cut, paths = _paths(table, ends)
    flat = pa.ListArray.from_arrays(
        pa.array(np.arange(len(cut.first) + 1) * STATES, pa.int32()),
        pa.array(paths.exits().ravel().astype(np.int32)),
    )
    number = np.full(len(cut.first), table.column("slice")[0].as_py())
    return pa.table({"slice": pa.array(number, pa.int32()), "conv_id": cut.ids, "exits": flat})


def _decide(table: pa.Table, ends: pa.Table) -> pa.Table:
    """The edit of each row with the turns inserted before it, and those that close a conversation."""
    cut, paths = _paths(table, ends)
    on_path = paths.marked(_matched(cut, ends, "entry", np.array(0)).astype(np.int64)).reshape(-1, STATES)
    letter = paths.letter.reshape(-1, STATES)
    insert = on_path & (letter == I)
    user, answer = insert[:, [0, 1, 3]].any(axis=1), insert[:, 2]
    inserted = np.array(["", "u", "a", "ua"])[user + 2 * answer]
    own = on_path & (letter != I) & (letter >= 0)
    state = own.argmax(axis=1)
    chosen = letter[np.arange(len(letter)), state]
    edit = np.where(chosen == R, np.where(SPEAKS[state] == 2, "U", "A"), np.array(list(LETTERS))[chosen])
    n, copies, closing = cut.rows, cut.copies.tolist(), inserted[cut.rows :] != ""
    price = DELETE_COST * cut.copies - DELETE_COST * (chosen[:n] != D) + REROLE_COST * (chosen[:n] == R)
    price += TRUNCATED_COST * (cut.truncated & (chosen[:n] != D))
    audit = [
        "I" * len(b) + LETTERS[c] + "D" * (k - 1)
        for b, c, k in zip(inserted[:n].tolist(), chosen[:n].tolist(), copies, strict=True)
    ]
    lengths = np.char.str_len(inserted)
    open_, none = np.flatnonzero(closing), [None] * int(closing.sum())
    ids = cut.ids.take(pa.array(cut.piece)), cut.ids.take(pa.array(open_))
    return pa.table(
        {
            "conv_id": pa.chunked_array(ids, ids[0].type),
            "closing": np.arange(n + len(open_)) >= n,
            "turn": pa.array(table.sort_by("pos").column("turn").to_pylist() + none, pa.int64()),
            "digest": pa.array(table.sort_by("pos").column("digest").to_pylist() + none, pa.string()),
            "kind": pa.array(np.zeros(n + len(open_)), pa.int32()),
            "audit": pa.array(audit + ["I" * len(b) for b in inserted[n:][open_].tolist()], pa.string()),
            "inserted": pa.array(np.concatenate([inserted[:n], inserted[n:][open_]]).tolist(), pa.string()),
            "edit": pa.array(edit[:n].tolist() + none, pa.string()),
            "cost": np.concatenate([price + INSERT_COST * lengths[:n], INSERT_COST * lengths[n:][open_]]),
        }
    )


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation from its decisions and texts in order."""
    names = ("conv_id", "closing", "turn", "digest", "kind", "audit", "inserted", "edit", "role", "text")
    started, key, audit, edit, out = False, None, [], None, []
    digest, lines = hashlib.sha256(), 0

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update((b"\n" if lines else b"") + role.encode() + b":" + text.encode("utf-8", "surrogatepass"))
        lines += 1

    def flush(id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], id_type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
            ["conv_id", "audit", "repaired_sha256"],
        )

    id_type = pa.int64()
    for batch in batches:
        id_type = batch.column("conv_id").type
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            conv, _, _, _, kind, letters, inserted, what, role, text = row
            if not started or conv != key:
                if started:
                    out.append((key, "".join(audit), digest.hexdigest()))
                started, key, audit, edit, digest, lines = True, conv, [], None, hashlib.sha256(), 0
            if kind == 0:
                audit.append(letters)
                for who in inserted:
                    line("user" if who == "u" else "assistant", "")
                edit = what
            elif edit in ("K", "U", "A"):
                line({"K": role, "U": "user", "A": "assistant"}[edit], text)
                edit = None  # further copies are deleted
        if out:
            yield flush(id_type)
    if started:
        out.append((key, "".join(audit), digest.hexdigest()))
        yield flush(id_type)


def _times(a: str, b: str) -> Column:
    """Product of two flat matrices under minimum and plus."""
    cells = [
        "least(" + ", ".join(f"{a}[{STATES * i + k}] + {b}[{STATES * k + j}]" for k in range(STATES)) + ")"
        for i in range(STATES)
        for j in range(STATES)
    ]
    return F.expr(f"transform(array({', '.join(cells)}), c -> least(c, {FAR}L))")


def _scan(pieces: DataFrame, value: str, longest: int, combine: Column, step: int) -> DataFrame:
    """Combine ``value`` of each piece with all pieces after (``step`` 1) or before it (-1)."""
    shift = 1
    while shift < longest:
        other = pieces.select(
            F.col("conv_id").alias("other_id"), (F.col("piece") - step * shift).alias("other_piece"), F.col(value).alias("b")
        )
        on = F.col("conv_id").eqNullSafe(F.col("other_id")) & (F.col("piece") == F.col("other_piece"))
        joined = pieces.withColumnRenamed(value, "a").join(other, on, "left")
        pieces = materialize(
            joined.withColumn(value, F.when(F.col("b").isNull(), F.col("a")).otherwise(combine)).drop(
                "a", "b", "other_id", "other_piece"
            ),
            "scan",
        )
        shift *= 2
    return pieces


def _neighbour(pieces: DataFrame, value: str, step: int, alias: str) -> DataFrame:
    other = pieces.select(
        F.col("conv_id").alias("other_id"), (F.col("piece") - step).alias("other_piece"), F.col(value).alias(alias)
    )
    on = F.col("conv_id").eqNullSafe(F.col("other_id")) & (F.col("piece") == F.col("other_piece"))
    return pieces.join(other, on, "left").drop("other_id", "other_piece")


def _cut_conversations(rows: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``to_go`` by state at the end of each piece of a cut conversation, ``final`` and ``entry``."""
    cut = pieces.filter("pieces > 1").select("slice", "conv_id", "piece", "costs")
    after = _neighbour(_scan(cut, "costs", longest, _times("a", "b"), 1), "costs", 1, "rest")
    ending = f"array({', '.join(f'{c}L' for c in ENDING)})"
    to_go = ", ".join(
        "least(" + ", ".join(f"rest[{STATES * i + k}] + {ENDING[k]}L" for k in range(STATES)) + ")" for i in range(STATES)
    )
    ends = materialize(
        after.select(
            "slice", "conv_id", "piece", F.expr(f"if(rest is null, {ending}, array({to_go}))").alias("to_go"),
            F.col("rest").isNull().alias("final"),
        ),
        "ends",
    )
    here = ends.select("slice").distinct()
    exits = (
        rows.join(here, "slice", "left_semi")
        .groupBy("slice")
        .cogroup(ends.groupBy("slice"))
        .applyInArrow(_exits, _schema("slice int, conv_id {id}, exits array<int>", rows))
    )
    same = ends["conv_id"].eqNullSafe(exits["conv_id"]) & (ends["slice"] == exits["slice"])
    linked = materialize(ends.join(exits, same).select(ends["conv_id"], "piece", "exits"), "exits")
    through = _scan(linked, "exits", longest, F.expr("transform(b, s -> a[s])"), -1)
    entries = _neighbour(through, "exits", -1, "before").select(
        F.col("conv_id").alias("entry_id"), F.col("piece").alias("entry_piece"),
        F.expr("if(before is null, 0, before[0])").alias("entry"),
    )
    on = F.col("conv_id").eqNullSafe(F.col("entry_id")) & (F.col("piece") == F.col("entry_piece"))
    return ends.join(entries, on).select("slice", "conv_id", "to_go", "final", "entry")


def _texts(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    said = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    return said.withColumn(
        "digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    )


def _ordered(texts: DataFrame, rows_of_a_slice: int) -> DataFrame:
    """Distinct rows without their texts, cut into numbered slices, with their first mention."""
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    initial = F.substring("role", 1, 1)
    code = F.lit(OTHER)
    for number, letter in enumerate(INITIALS):
        code = F.when(initial == letter, number).otherwise(code)
    marked = texts.select(
        "conv_id", "turn", "digest", code.cast("int").alias("code"), (last == "").alias("blank"),
        (~last.isin(*ENDS)).alias("truncated"),
    )
    names = marked.columns
    light = materialize(marked.groupBy(*names).agg(F.count(F.lit(1)).alias("copies")), "turns")
    slices = max(1, -(-light.count() // rows_of_a_slice))
    order = ("conv_id", "turn", "digest")
    stored = materialize(
        light.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .selectExpr("*", "spark_partition_id() as slice", "monotonically_increasing_id() as pos"),
        "slices",
    )
    first = stored.groupBy("conv_id", "digest").agg(F.min(F.struct("slice", "pos")).alias("f"))
    first = first.select("f.*", F.lit(True).alias("first_seen"))
    seen = stored.join(first, ["slice", "pos"], "left").withColumn("first_seen", F.coalesce("first_seen", F.lit(False)))
    return materialize(seen, "rows")


def repair(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    rows_of_a_slice: int = ROWS_OF_A_SLICE,
) -> DataFrame:
    """One row for each conversation: its faults, the cost, the audit and the repaired digest.

    Columns ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.
    """
    texts = _texts(conversations, conv_id, turn, role, text)
    rows = _ordered(texts, rows_of_a_slice)
    summary = rows.groupBy("slice").applyInArrow(_summarise, _schema(SUMMARY, rows))
    # a conversation has at most one piece in a slice
    in_order = "over (partition by conv_id order by slice)"
    pieces = materialize(
        materialize(summary, "pieces").selectExpr(
            "*", f"row_number() {in_order} as piece", "count(*) over (partition by conv_id) as pieces",
            f"lag(tail) {in_order} as before",
        ),
        "pieces",
    )
    longest = pieces.agg(F.max("pieces")).first()[0] or 1
    if longest > 1:
        ends = _cut_conversations(rows, pieces, longest)
    else:
        ends = rows.sparkSession.createDataFrame(
            [], _schema("slice int, conv_id {id}, to_go array<bigint>, final boolean, entry int", rows)
        )
    decisions = materialize(
        rows.groupBy("slice").cogroup(ends.groupBy("slice")).applyInArrow(_decide, _schema(DECISION, rows)), "edits"
    )

    lines = decisions.drop("cost").withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    spoken = texts.filter(F.rtrim("text", F.lit(WHITE)) != "").select(
        "conv_id", F.lit(False).alias("closing"), "turn", "digest", F.lit(1).alias("kind"),
        *[F.lit(None).cast("string").alias(n) for n in ("audit", "inserted", "edit")], "role", "text",
    )
    closed = (
        lines.unionByName(spoken)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "closing", "turn", "digest", "kind")
        .mapInArrow(_closed, _schema(CLOSED, rows))
    )

    legal = " or ".join(f"before = {a} and head = {b}" for a, b in zip(*np.nonzero(LEGAL), strict=True))
    faults = pieces.groupBy("conv_id").agg(
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
        F.expr(f"sum(illegal + int(before is not null and not ({legal})))").alias("illegal"),
    )
    costs = decisions.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    gaps = (
        rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)))
        .groupBy("conv_id")
        .agg(F.expr("coalesce(max(turn) - min(turn) + 1 - count(turn), 0)").alias("gaps"))
    )
    figures = [faults, costs, gaps, closed]
    merged = figures[0]
    for more in figures[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return merged.groupBy("conv_id").agg(
        *[F.max(n).alias(n) for n in names],
        F.max("audit").alias("audit"),
        F.max("repaired_sha256").alias("repaired_sha256"),
    )


def with_all(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """``repaired`` with a row for each ``conv_id`` of ``ids``; one without rows has nothing to repair."""
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = [F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n) for n in names]
    return (
        repaired.unionByName(ids.select("conv_id"), allowMissingColumns=True)
        .groupBy("conv_id")
        .agg(
            *nothing,
            F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
            F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults set by ``crc32(conv_id:turn) % 20``; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes its full stops and the like, 3
    repeats it, 4 gives it the role of the user.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    return (
        rows.filter("kind <> 0")
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn(
            "text",
            F.when(F.col("kind") == 1, "")
            .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
        .select("conv_id", "turn", "role", "text")
    )
