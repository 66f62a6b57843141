"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371

# The label shown for each reason code.
REASON_LABELS = {
    "IMPOSSIBLE_TRAVEL": "Viagem impossivel",
    "VALUE_ABOVE_USER_PROFILE": "Valor fora do perfil",
    "NEW_DEVICE": "Dispositivo novo",
    "NEW_COUNTRY_FOR_USER": "Pais novo",
    "HIGH_ATTEMPT_COUNT": "Muitas tentativas",
    "UNUSUAL_TRANSACTION_HOUR": "Horario incomum",
    "ABNORMAL_FREQUENCY": "Frequencia anormal",
}


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance. Null if any coordinate is null or NaN.

    Rounding can push the half-chord of antipodes just above 1, where ``asin``
    is NaN, which would compare greater than every speed limit. They are half a
    turn apart.
    """
    north = F.sin(F.radians(lat2 - lat1) / 2)
    east = F.sin(F.radians(lon2 - lon1) / 2)
    chord = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    half_angle = F.when(~F.isnan(chord), F.nanvl(F.asin(F.sqrt(chord)), F.lit(math.pi / 2)))
    # Most transactions happen where the last one did; they skip the functions.
    same = (lat1 == lat2) & (lon1 == lon2) & ~F.isnan(lat1) & ~F.isnan(lon1)
    return F.when(same, 0.0).otherwise(
        half_angle * (2 * EARTH_RADIUS_KM)
    )


def on_or_after(day: Column, ts: Column, bound: Column) -> Column:
    """Date bound on ``day``, or on the date of ``ts`` where ``day`` is null.

    Spelled as a disjunction, not ``coalesce``, so that Catalyst can derive a
    filter on the partition column.
    """
    return (day >= bound) | (day.isNull() & (F.to_date(ts) >= bound))


def on_or_before(day: Column, ts: Column, bound: Column) -> Column:
    return (day <= bound) | (day.isNull() & (F.to_date(ts) <= bound))


def reason_label(code: Column) -> Column:
    """Label of a reason code; an unknown code shows with spaces."""
    labels = F.create_map(*[F.lit(x) for pair in REASON_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, code), F.replace(code, F.lit("_"), F.lit(" ")))


def total_of(amount: Column, decimals: int = 2) -> Column:
    """Aggregate: the total of a few hundred amounts, the same in whatever order they arrive.

    Exact decimals where all amounts have one; else doubles added by size, so
    that 1e25 counts and NaN and infinities give what plain addition gives.
    """
    exact = amount.cast("double").try_cast("decimal(38,6)")
    plain = F.aggregate(F.array_sort(F.collect_list(amount)), F.lit(0.0), lambda a, x: a + x)
    lost = F.count(amount) > F.count(exact)
    whole = F.when(~lost, F.round(F.try_sum(exact), decimals).cast("double"))
    return F.coalesce(whole, F.round(plain, decimals))
