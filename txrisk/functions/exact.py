"""Exact running sums of doubles and of their squares, in built-in expressions.

A double is a whole number times a power of two. It is cut into limbs of 24 bits
at fixed places, and limbs of the same place are summed as whole numbers, so a
sum does not depend on the order of its terms and partial sums can be merged.
The square of a double is cut the same way, from the three exact products of its
halves. Only what a mean or deviation is read from the sums is rounded.

The places that occur are known from the smallest and the largest magnitude
(:class:`Span`), so ordinary amounts take a handful of sums and any double has a
place. A sum holds 2^36 rows. Amounts that are not finite are summed on the side
and give what plain arithmetic gives.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

BITS = 24
BASE = 1 << BITS
_POWER = f"{float(BASE)}D"
_SPLIT = f"{float((1 << 27) + 1)}D"

# Places of the limbs of an amount and of its square, from that of its magnitude.
_AMOUNT = (-3, 1)
_SQUARE = (-5, 2)

# Most places of squares whose digits are columns; amounts from 0.01 to 10^5 have ten.
MOST_COLUMNS = 12


@dataclass(frozen=True)
class Span:
    """Magnitudes that occur: an amount of magnitude s is from 2^(24 s) to 2^(24 s + 24)."""

    low: int = 0
    high: int = 0

    def join(self, other: Span) -> Span:
        return Span(min(self.low, other.low), max(self.high, other.high))

    @property
    def amounts(self) -> range:
        return range(self.low + _AMOUNT[0], self.high + _AMOUNT[1] + 1)

    @property
    def squares(self) -> range:
        return range(2 * self.low + _SQUARE[0], 2 * self.high + _SQUARE[1] + 1)


def _magnitude(amount: str) -> str:
    counts = f"{amount} <> 0 and abs({amount}) < double('Infinity')"
    return f"if({counts}, int(floor(log2(abs({amount})) / {BITS})), null)"


def span_of(df: DataFrame, amount: str) -> Span:
    """The magnitudes in a column; one job over that column, two numbers to the driver."""
    low, high = df.selectExpr(f"{_magnitude(amount)} as s").selectExpr("min(s)", "max(s)").first()
    return Span() if low is None else Span(low, high)


def span_of_all(*columns: tuple[DataFrame, str]) -> Span:
    return reduce(Span.join, (span_of(df, amount) for df, amount in columns))


def _limbs(value: str, places: tuple[int, int]) -> str:
    """Signed limbs of ``value`` at the places, the lowest first."""
    parts = [
        f"bigint(signum({value})) * bigint(floor((abs({value}) * pow(2D, {-BITS * u})) % {_POWER}))"
        for u in range(places[0], places[1] + 1)
    ]
    return f"array({', '.join(parts)})"


def with_limbs(df: DataFrame, amount: str) -> DataFrame:
    """Add the limbs of ``amount`` and of its square; the sums of :func:`moments` are over them."""
    scaled = df.selectExpr("*", f"{_magnitude(amount)} as ex_s").selectExpr(
        "*", f"{amount} * pow(2D, -12 * ex_s) * pow(2D, -12 * ex_s) as ex_f"
    )
    halves = scaled.selectExpr("*", f"ex_f * {_SPLIT} - (ex_f * {_SPLIT} - ex_f) as ex_h").selectExpr(
        "*", "ex_f - ex_h as ex_l"
    )
    products = halves.selectExpr(
        "*", "ex_h * ex_h as ex_hh", "2D * ex_h * ex_l as ex_hl", "ex_l * ex_l as ex_ll"
    )
    added = [_limbs(f"ex_{p}", _SQUARE) for p in ("hh", "hl", "ll")]
    two = f"zip_with({added[0]}, {added[1]}, (a, b) -> a + b)"
    return products.selectExpr(
        "*",
        f"if(ex_s is null, null, {_limbs('ex_f', _AMOUNT)}) as ex_x",
        f"if(ex_s is null, null, zip_with({two}, {added[2]}, (a, b) -> a + b)) as ex_q",
    ).drop("ex_f", "ex_h", "ex_l", "ex_hh", "ex_hl", "ex_ll")


LIMBS = ("ex_s", "ex_x", "ex_q")


def moments(span: Span, amount: str) -> dict[str, str]:
    """Aggregates that can be merged by adding them up, by column name."""
    sums = {"n": f"count({amount})", "odd": f"sum(if(abs({amount}) < double('Infinity'), 0D, {amount}))"}
    for i, place in enumerate(span.amounts):
        sums[f"x{i}"] = f"sum(coalesce(get(ex_x, {place - _AMOUNT[0]} - ex_s), 0L))"
    for i, place in enumerate(span.squares):
        sums[f"q{i}"] = f"sum(coalesce(get(ex_q, {place - _SQUARE[0]} - 2 * ex_s), 0L))"
    return sums


def zero(name: str) -> str:
    return "0D" if name == "odd" else "0L"


def _digits(limbs: str) -> str:
    """Carry through: ``digits`` from 0 to 2^24 - 1, the lowest first, and the last ``carry``."""
    return (
        f"aggregate({limbs}, named_struct('carry', 0L, 'digits', cast(array() as array<bigint>)), "
        f"(a, v) -> named_struct('carry', shiftright(a.carry + v, {BITS}), "
        f"'digits', array_append(a.digits, (a.carry + v) & {BASE - 1}L)))"
    )


def _leading(digits: str) -> str:
    """The four digits from the first that is not 0, in two halves, and how many follow."""
    return (
        f"aggregate(reverse({digits}), named_struct('upper', 0L, 'lower', 0L, 'taken', 0, 'rest', 0), "
        "(a, d) -> case when a.taken = 0 and d = 0 then a "
        f"when a.taken < 2 then named_struct('upper', a.upper * {BASE}L + d, 'lower', 0L, 'taken', a.taken + 1, 'rest', 0) "
        f"when a.taken < 4 then named_struct('upper', a.upper, 'lower', a.lower * {BASE}L + d, 'taken', a.taken + 1, 'rest', 0) "
        "else named_struct('upper', a.upper, 'lower', a.lower, 'taken', 4, 'rest', a.rest + 1) end, "
        f"a -> named_struct('m', a.upper * pow(2D, {BITS} * greatest(a.taken - 2, 0)) + a.lower, 'rest', a.rest))"
    )


def _from_arrays(df: DataFrame, span: Span, mean: str, deviation: str) -> DataFrame:
    """:func:`with_mean_and_deviation` over arrays of any number of digits."""
    sums = [f"x{i}" for i in range(len(span.amounts))]
    squares = [f"q{i}" for i in range(len(span.squares))]
    total = f"array({', '.join(f'coalesce({s}, 0L)' for s in sums)}, 0L, 0L)"
    size = len(sums) + 2
    # both begin at twice the lowest place of the sum
    of_squares = f"array(0L, {', '.join(f'coalesce({s}, 0L)' for s in squares)}, 0L, 0L)"
    low = span.amounts[0]
    products = (
        f"transform(sequence(0, {2 * size - 2}), t -> n * coalesce(get(ex_dq, t), 0L) - "
        f"aggregate(sequence(greatest(0, t - {size - 1}), least(t, {size - 1})), 0L, "
        "(a, j) -> a + ex_dx[j] * ex_dx[t - j]))"
    )
    carried = df.selectExpr("*", f"{total} as ex_t", f"{_digits(of_squares)}.digits as ex_dq").selectExpr(
        "*", f"{_digits('ex_t')} as ex_c"
    )
    # a negative sum is taken with the other sign
    signed = carried.selectExpr(
        "*",
        f"if(ex_c.carry < 0, {_digits('transform(ex_t, v -> -v)')}.digits, ex_c.digits) as ex_dx",
        "if(ex_c.carry < 0, -1D, 1D) as ex_sign",
    )
    led = signed.selectExpr(
        "*",
        f"{_leading('ex_dx')} as ex_m",
        f"{_leading(f'{_digits(f"concat({products}, array(0L, 0L, 0L))")}.digits')} as ex_v",
    )
    half_mean, half_root = f"pow(2D, 12 * (ex_m.rest + {low}))", f"pow(2D, 6 * (ex_v.rest + {2 * low}))"
    figures = led.selectExpr(
        "*",
        f"case when n = 0 then null when odd <> 0 then odd "
        f"else ex_sign * (ex_m.m / n) * {half_mean} * {half_mean} end as {mean}",
        f"case when n < 2 then null when odd <> 0 then double('NaN') "
        f"else sqrt(ex_v.m / n / (n - 1)) * {half_root} * {half_root} end as {deviation}",
    )
    return figures.drop("n", "odd", *sums, *squares, "ex_t", "ex_c", "ex_dx", "ex_dq", "ex_sign", "ex_m", "ex_v")


def _carried(limbs: list[str]) -> list[str]:
    """Each limb with what is carried into it; the lowest first."""
    sums: list[str] = []
    for limb in limbs:
        sums.append(f"({limb} + shiftright({sums[-1]}, {BITS}))" if sums else f"({limb})")
    return sums


def _digit_columns(limbs: list[str], name: str) -> list[str]:
    """Carry through: columns ``name`` and a number, digits from 0 to 2^24 - 1, the lowest first."""
    return [f"{s} & {BASE - 1}L as {name}{i}" for i, s in enumerate(_carried(limbs))]


def _top(name: str, size: int) -> str:
    """Place of the highest of the digits ``name`` that is not 0, -1 if there is none."""
    places = " ".join(f"when {name}{i} <> 0 then {i}" for i in reversed(range(size)))
    return f"case {places} else -1 end"


def _leading_of(name: str, size: int, top: str) -> str:
    """The four digits from ``top`` on as one double, made of two halves."""
    digits = f"array({', '.join(f'{name}{i}' for i in range(size))})"
    d = [f"coalesce(get({digits}, {top} - {i}), 0L)" for i in range(4)]
    upper, lower = f"({d[0]} * {BASE}L + {d[1]})", f"({d[2]} * {BASE}L + {d[3]})"
    return (
        f"case {top} when -1 then 0D when 0 then double({d[0]}) when 1 then double({upper}) "
        f"when 2 then {upper} * pow(2D, {BITS}) + {d[2]} else {upper} * pow(2D, {2 * BITS}) + {lower} end"
    )


def with_mean_and_deviation(df: DataFrame, span: Span, mean: str, deviation: str) -> DataFrame:
    """Mean and sample deviation from the columns of :func:`moments`, which are dropped.

    Null without a row (deviation: without two). The deviation is the root of
    n times the sum of squares less the square of the sum, both exact, over
    n (n - 1). Where few places occur, every digit is a column of its own: plain
    arithmetic, which takes half the time of functions of arrays. The expressions
    grow with the square of the places, so many places go through arrays.
    """
    if len(span.squares) > MOST_COLUMNS:
        return _from_arrays(df, span, mean, deviation)
    sums = [f"x{i}" for i in range(len(span.amounts))]
    squares = [f"q{i}" for i in range(len(span.squares))]
    total = [f"coalesce({s}, 0L)" for s in sums] + ["0L", "0L"]
    # both begin at twice the lowest place of the sum
    of_squares = ["0L"] + [f"coalesce({s}, 0L)" for s in squares] + ["0L", "0L"]
    size, size_q = len(total), len(of_squares)
    size_v = 2 * size + 2
    low = span.amounts[0]
    keep = [c for c in df.columns if c not in {"odd", *sums, *squares}]
    kept = [*[f"`{c}`" for c in keep], "odd"]

    def product(t: int) -> str:
        terms = [f"ex_d{j} * ex_d{t - j}" for j in range(max(0, t - size + 1), min(t, size - 1) + 1)]
        return f"n * {f'ex_u{t}' if t < size_q else '0L'} - ({' + '.join(terms)})"

    # a negative sum is taken with the other sign
    signed = df.selectExpr(
        *kept,
        *[f"{t} as ex_t{i}" for i, t in enumerate(total)],
        *_digit_columns(of_squares, "ex_u"),
        f"if(shiftright({_carried(total)[-1]}, {BITS}) < 0, -1L, 1L) as ex_sign",
    )
    digits = signed.selectExpr(
        *kept,
        "ex_sign",
        *_digit_columns([f"ex_sign * ex_t{i}" for i in range(size)], "ex_d"),
        *[f"ex_u{i}" for i in range(size_q)],
    )
    products = digits.selectExpr(
        *kept,
        "ex_sign",
        *[f"ex_d{i}" for i in range(size)],
        f"{_top('ex_d', size)} as ex_i",
        *[f"{product(t)} as ex_p{t}" for t in range(2 * size - 1)],
    )
    led = products.selectExpr(
        *kept,
        "ex_sign",
        "ex_i",
        f"{_leading_of('ex_d', size, 'ex_i')} as ex_m",
        *_digit_columns([f"ex_p{t}" for t in range(2 * size - 1)] + ["0L"] * 3, "ex_v"),
    )
    placed = led.selectExpr("*", f"{_top('ex_v', size_v)} as ex_j").selectExpr(
        *kept, "ex_sign", "ex_i", "ex_m", "ex_j", f"{_leading_of('ex_v', size_v, 'ex_j')} as ex_w"
    )
    half_mean = f"pow(2D, 12 * (greatest(ex_i - 3, 0) + {low}))"
    half_root = f"pow(2D, 6 * (greatest(ex_j - 3, 0) + {2 * low}))"
    return placed.selectExpr(
        *[c for c in kept if c not in ("`n`", "odd")],
        f"case when n = 0 then null when odd <> 0 then odd "
        f"else ex_sign * (ex_m / n) * {half_mean} * {half_mean} end as {mean}",
        f"case when n < 2 then null when odd <> 0 then double('NaN') "
        f"else sqrt(ex_w / n / (n - 1)) * {half_root} * {half_root} end as {deviation}",
    )
