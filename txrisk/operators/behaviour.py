"""Behavioural features: what each transaction looks like against its user's past.

Two ways to the same columns:

* An ordinary user fits one task. One shuffle by user serves every window, and
  every window frame only grows, so the cost is linear in the user's rows. The
  trailing one-hour and 24-hour figures are differences of two growing frames
  rather than sliding frames, which Spark would re-aggregate for every row.

* A hot user does not fit one task. Its rows are range-partitioned in time
  order into slices of even size, whatever the distribution over users or over
  time. Each slice is processed by itself and then takes over the state left by
  the slices before it. The trailing figures come from one row per user, second
  and country, in day-sized groups bounded by the number of seconds in two days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import exact
from txrisk.functions.columns import great_circle_km
from txrisk.operators.skew import ROWS_PER_TASK, HotKeys, find_hot_keys
from txrisk.schemas import FEATURES, TRANSACTIONS
from txrisk.session import materialize

HOUR = 3600
DAY = 86400

HIGH_AMOUNT_FACTOR = 4
BURST_MINUTES = 5
BURST_TXNS_1H = 5

# Time order of one user's rows. The columns after the timestamp only decide
# ties, so that a recomputed task orders them as before.
TIME_ORDER = ("txn_ts", "txn_id", "amount", "txn_country", "device", "attempts")

# Led by the second, which follows from the timestamp: the range frames need it
# as their only order, and so share the sort of the row frames.
TIMELINE = ", ".join(("epoch", *TIME_ORDER))

# A number of the rows as they are stored, where there is one.
ROW_NUMBER = "row_no"

BEFORE = "rows between unbounded preceding and 1 preceding"

# The context handed to the next transaction.
CONTEXT = (
    "struct(txn_country as prev_country, txn_city as prev_city, lat as prev_lat, "
    "lon as prev_lon, txn_ts as prev_txn_ts, device as prev_device)"
)

# Most slices of hot users, and hence the bound on the slice states that are
# broadcast. Beyond it slices grow instead; the sort in a slice can spill.
MAX_SLICES = 20_000

# A slice this many times the average holds copies; sampled cuts stay below it.
UNEVEN = 4


def add_features(
    txns: DataFrame,
    hot: HotKeys | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    span: exact.Span | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Append the feature columns to transactions.

    ``hot`` lists the users with more than ``rows_per_task`` rows, ``span`` the
    magnitudes of the amounts. Without them they are looked up in ``txns``, which
    runs one job over the user column and one over the amounts. ``tasks`` is the
    number of tasks for the users that fit one; without it the session decides.
    A column ``row_no``, a number of the stored rows, is carried along.
    """
    if hot is None:
        hot = find_hot_keys(txns, "user_id", rows_per_task)
    if span is None:
        span = exact.span_of(txns, "amount")
    if hot:
        history = _whole_users(hot.without(txns, "user_id"), span, tasks).unionByName(
            _sliced_users(hot.only(txns, "user_id"), hot, rows_per_task, span)
        )
    else:
        history = _whole_users(txns, span, tasks)
    return _derive(history)


# -- shared pieces ---------------------------------------------------------


def _with_epoch(txns: DataFrame) -> DataFrame:
    return exact.with_limbs(txns.selectExpr("*", "unix_seconds(txn_ts) as epoch"), "amount")


def _with_moments(df: DataFrame, span: exact.Span) -> DataFrame:
    return exact.with_mean_and_deviation(df, span, "hist_avg_amount", "hist_std_amount")


def _with_country_stays(df: DataFrame, group: str) -> DataFrame:
    """Mark where a country enters and leaves a user's trailing 24 hours.

    Transactions of one country no more than 24 h apart form one stay. A stay
    counts from its first second until 24 h after its last one, so the distinct
    countries at any time are the stays begun minus the stays expired. Rows
    without a time sort first and form a stay of their own.

    The country is in the sort order, not in the partition key ``group``, so
    that this window shares the shuffle of the others.
    """
    seen = f"over (partition by {group} order by txn_country, epoch)"

    def apart(neighbour: str, gap: str) -> str:
        return (
            f"not ({neighbour}(txn_country) {seen} <=> txn_country and "
            f"coalesce({gap} <= {DAY}, {neighbour}(epoch) {seen} is null and epoch is null))"
        )

    begins = apart("lag", f"epoch - lag(epoch) {seen}")
    ends = apart("lead", f"lead(epoch) {seen} - epoch")
    return df.selectExpr(
        "*",
        f"int(txn_country is not null and {begins}) as stay_begins",
        f"int(txn_country is not null and {ends}) as stay_ends",
    )


def _trailing(group: str, begun: str, expired: str, seconds: int) -> str:
    """Sum of ``begun`` up to now less ``expired`` up to ``seconds`` + 1 ago."""
    frame = f"over (partition by {group} order by epoch range between unbounded preceding and"
    return (
        f"sum({begun}) {frame} current row) - "
        f"if(epoch is null, 0, coalesce(sum({expired}) {frame} {seconds + 1} preceding), 0))"
    )


def _with_trailing_figures(df: DataFrame, group: str, counted: str) -> DataFrame:
    countries = _trailing(group, "stay_begins", "stay_ends", DAY)
    return df.selectExpr(
        "*",
        f"{_trailing(group, counted, counted, HOUR)} as txns_1h",
        f"int({countries}) as countries_24h",
    )


# -- ordinary users --------------------------------------------------------


def _whole_users(txns: DataFrame, span: exact.Span, tasks: int | None) -> DataFrame:
    timeline = f"partition by user_id order by {TIMELINE}"
    if tasks is not None:
        txns = txns.repartition(tasks, "user_id")
    marked = _with_country_stays(_with_epoch(txns), "user_id")
    moments = exact.moments(span, "amount")
    with_past = marked.selectExpr(
        "*",
        f"lag({CONTEXT}) over ({timeline}) as prev",
        *[f"{sql} over ({timeline} {BEFORE}) as {name}" for name, sql in moments.items()],
    )
    figures = _with_trailing_figures(with_past, "user_id", "int(txn_id is not null)")
    return _with_moments(figures, span).drop("epoch", *exact.LIMBS, "stay_begins", "stay_ends")


# -- hot users -------------------------------------------------------------


def _sliced_users(
    txns: DataFrame, hot: HotKeys, rows_per_task: int, span: exact.Span
) -> DataFrame:
    slices = min(MAX_SLICES, -(-hot.rows // rows_per_task) + 1)
    stored = _store_slices(txns.selectExpr("*", "unix_seconds(txn_ts) as epoch"), slices)
    moments = exact.moments(span, "amount")
    counted = exact.with_limbs(stored, "amount")
    state = _state_before_slice(counted, moments)
    # One row per slice and user in it: each hot user adds at most one to the slices.
    if slices + hot.keys <= 2 * MAX_SLICES:
        state = F.broadcast(state)

    timeline = f"partition by slice, user_id order by {TIMELINE}, row_no"
    local = counted.selectExpr(
        "*",
        f"lag({CONTEXT}) over ({timeline}) as local_prev",
        *[f"{sql} over ({timeline} {BEFORE}) as local_{name}" for name, sql in moments.items()],
    )
    in_slice = "slice <=> at_slice and user_id <=> at_user"
    joined = local.join(state, F.expr(in_slice)).drop("at_slice", "at_user")
    merged = _with_moments(
        joined.selectExpr(
            "*",
            *[
                f"coalesce(state_{name}, {exact.zero(name)}) + coalesce(local_{name}, {exact.zero(name)}) as {name}"
                for name in moments
            ],
            "coalesce(local_prev, state_prev) as prev",
        ),
        span,
    )
    in_second = f"{in_slice} and epoch <=> at_epoch"
    return merged.join(_clock_figures(stored), F.expr(in_second)).select(
        *txns.columns, "prev", "hist_avg_amount", "hist_std_amount", "txns_1h", "countries_24h"
    )


def _store_slices(txns: DataFrame, slices: int) -> DataFrame:
    """Cut the rows by user and time order into numbered slices and store them.

    The slice number exists only once the range shuffle has run, and a second
    run could cut elsewhere, so it is stored before anything builds on it, and
    with it a row number that settles the order of complete copies. A group of
    copies too large for a slice shows as an uneven slice; a second cut then
    splits it by the stored row number.
    """
    order = ("user_id", *TIME_ORDER)
    if ROW_NUMBER in txns.columns:
        cut = txns.repartitionByRange(slices, *order, ROW_NUMBER)
    else:
        cut = txns.repartitionByRange(slices, *order).withColumn(
            ROW_NUMBER, F.monotonically_increasing_id()
        )
    stored = materialize(cut.withColumn("slice", F.spark_partition_id()), "sliced-users")
    sizes = stored.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if total and largest > UNEVEN * -(-total // slices):
        stored = materialize(
            stored.drop("slice")
            .repartitionByRange(slices, *order, ROW_NUMBER)
            .selectExpr("*", "spark_partition_id() as slice"),
            "sliced-copies",
        )
    return stored


def _state_before_slice(counted: DataFrame, moments: dict[str, str]) -> DataFrame:
    """For each slice and user: last context and amount moments of all earlier slices.

    One input row per slice and user, so a user's window is at most MAX_SLICES
    rows long.
    """
    per_slice = counted.groupBy("slice", "user_id").agg(
        F.expr(f"max_by({CONTEXT}, struct({TIMELINE}, row_no)) as last"),
        *[F.expr(f"{sql} as {name}") for name, sql in moments.items()],
    )
    slices = "partition by user_id order by slice"
    return per_slice.selectExpr(
        "slice as at_slice",
        "user_id as at_user",
        f"lag(last) over ({slices}) as state_prev",
        *[f"sum({name}) over ({slices} {BEFORE}) as state_{name}" for name in moments],
    )


def _clock_figures(stored: DataFrame) -> DataFrame:
    """Trailing figures per slice, user and second.

    They depend on the second only, so rows are first counted per user, second
    and country. Each day is then worked out together with the day before it,
    which covers every look-back.
    """
    ticks = stored.groupBy("user_id", "epoch", "txn_country").agg(F.count("txn_id").alias("n"))
    days = ticks.selectExpr("*", f"floor(epoch / {DAY}) as own_day").selectExpr(
        "*",
        "explode(if(own_day is null, array(own_day), array(own_day, own_day + 1))) as day",
    )
    marked = _with_country_stays(days, "day, user_id")
    figures = (
        _with_trailing_figures(marked, "day, user_id", "n")
        .filter("day <=> own_day")
        .groupBy("day", "user_id", "epoch")
        .agg(F.max("txns_1h").alias("txns_1h"), F.max("countries_24h").alias("countries_24h"))
    )
    # Joined by way of the distinct seconds of each slice: a crowded second is
    # spread over its slices instead of meeting in one join group.
    seconds = stored.selectExpr(
        "slice as at_slice", "user_id as at_user", "epoch as at_epoch"
    ).distinct()
    return seconds.join(figures, F.expr("at_user <=> user_id and at_epoch <=> epoch")).select(
        "at_slice", "at_user", "at_epoch", "txns_1h", "countries_24h"
    )


# -- row-local features ----------------------------------------------------


def _derive(history: DataFrame) -> DataFrame:
    """Travel figures and flags; no shuffle, no window."""
    distance = great_circle_km(
        F.col("prev.prev_lat"), F.col("prev.prev_lon"), F.col("lat"), F.col("lon")
    )
    travelled = history.select(
        "*",
        "prev.*",
        F.expr("round((unix_seconds(txn_ts) - unix_seconds(prev.prev_txn_ts)) / 60, 2)").alias(
            "mins_since_prev"
        ),
        F.round(distance, 2).alias("km_since_prev"),
    )
    derived = {
        # Speed uses the rounded figures. Rows follow in time, so the minutes are
        # never negative, and without elapsed time there is no speed.
        "kmh_since_prev": "round(try_divide(km_since_prev, mins_since_prev / 60), 2)",
        "is_high_amount": f"amount > avg_ticket * {HIGH_AMOUNT_FACTOR}",
        "is_new_device": "device <> primary_device",
        "is_new_country": "txn_country <> home_country and prev_country is not null",
        # Null on a user's first transaction unless the hour is crowded.
        "is_abnormal_freq": (
            f"mins_since_prev between 0 and {BURST_MINUTES} or txns_1h >= {BURST_TXNS_1H}"
        ),
    }
    names = TRANSACTIONS.names + FEATURES.names
    if ROW_NUMBER in history.columns:
        names = [*names, ROW_NUMBER]
    return travelled.selectExpr(
        *[f"{derived[name]} as {name}" if name in derived else name for name in names]
    )
