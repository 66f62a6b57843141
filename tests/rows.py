"""Hand-made rows, and the features of a few transactions worked out row by row."""

import datetime as dt
import math
import statistics

from txrisk.schemas import ENRICHED, SCENARIOS_CSV, TRANSACTIONS, USERS

UTC = dt.timezone.utc
PLACES = {
    "BR": ("Sao Paulo", -23.5505, -46.6333),
    "JP": ("Tokyo", 35.6762, 139.6503),
    "US": ("New York", 40.7128, -74.0060),
}

HOMES = [  # user, device, average ticket
    ("user_00001", "mobile", 120.0),
    ("user_00002", "mobile", 150.0),
    ("user_00003", "web", 90.0),
    ("user_00004", "mobile", 200.0),
    ("user_00005", "mobile", 100.0),
]

# The six known cases: id, user, country, amount, device, attempts, time.
CASES = [
    ("scenario_normal_br", "user_00001", "BR", 85.90, "mobile", 1, "2026-05-20 10:00:00"),
    ("scenario_impossible_travel", "user_00001", "JP", 4200.0, "web", 4, "2026-05-20 11:00:00"),
    ("scenario_valor_alto", "user_00002", "BR", 3500.0, "mobile", 1, "2026-05-20 12:00:00"),
    ("scenario_device_novo", "user_00003", "BR", 110.0, "mobile", 1, "2026-05-20 13:00:00"),
    ("scenario_muitas_tentativas", "user_00004", "BR", 180.0, "mobile", 5, "2026-05-20 14:00:00"),
    ("scenario_horario_incomum", "user_00005", "BR", 240.0, "mobile", 1, "2026-05-20 03:10:00"),
]


def users(spark):
    city, lat, lon = PLACES["BR"]
    day = dt.date(2025, 1, 1)
    return spark.createDataFrame(
        [
            (i, user, "BR", city, lat, lon, "PADRAO", device, ticket, "MIDDLE", day)
            for i, (user, device, ticket) in enumerate(HOMES, 1)
        ],
        USERS,
    )


def write_users_csv(path, created_on="2025-01-01"):
    lines = ["user_seq,id,country,city,lat,lon,profile,device,ticket,income,created"]
    city, lat, lon = PLACES["BR"]
    for i, (user, device, ticket) in enumerate(HOMES, 1):
        lines.append(
            f"{i},{user},BR,{city},{lat},{lon},PADRAO,{device},{ticket},MIDDLE,{created_on}"
        )
    path.write_text("\n".join(lines) + "\n")


def write_cases_csv(path, extra=()):
    lines = [",".join(SCENARIOS_CSV.names)]
    for txn, user, country, amount, device, attempts, when in [*CASES, *extra]:
        city, lat, lon = PLACES[country]
        lines.append(f"{txn},{user},{country},{city},{lat},{lon},{amount},{device},{attempts},{when}")
    path.write_text("\n".join(lines) + "\n")


def at(text):
    return None if text is None else dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def txn(txn_id, user="u1", when="2026-05-20 10:00:00", country="BR", amount=10.0, device="mobile",
        attempts=1, ticket=100.0, hour=12, lat=None, lon=None):
    """One transaction as a dict; coordinates follow the country unless given."""
    city, known_lat, known_lon = PLACES.get(country, (None, None, None))
    moment = at(when) if isinstance(when, str) else when
    return dict(
        txn_id=txn_id, user_id=user, profile="PADRAO", home_country="BR", home_city="Sao Paulo",
        txn_country=country, txn_city=city, lat=known_lat if lat is None else lat,
        lon=known_lon if lon is None else lon, amount=amount, avg_ticket=ticket, device=device,
        primary_device="mobile", attempts=attempts, txn_ts=moment,
        process_date=moment.date() if moment else None, txn_hour=hour,
    )


def transactions(spark, rows):
    return spark.createDataFrame(
        [tuple(row[name] for name in TRANSACTIONS.names) for row in rows], TRANSACTIONS
    )


def enriched(spark, rows):
    """Enriched rows from partial dicts; what is left out is null."""
    return spark.createDataFrame(
        [tuple(row.get(name) for name in ENRICHED.names) for row in rows], ENRICHED
    )


def _order(row):
    return tuple((v is not None, v) for v in (
        row["txn_ts"], row["txn_id"], row["amount"], row["txn_country"], row["device"],
        row["attempts"]))


def brute_force(rows):
    """History features by comparing each row with every other row of its user."""
    out = {}
    seconds = {id(r): None if r["txn_ts"] is None else math.floor(r["txn_ts"].timestamp())
               for r in rows}
    for user in {r["user_id"] for r in rows}:
        own = sorted((r for r in rows if r["user_id"] == user), key=_order)
        for i, row in enumerate(own):
            prev = own[i - 1] if i else None
            amounts = [r["amount"] for r in own[:i] if r["amount"] is not None]
            now = seconds[id(row)]

            def within(r, span, now=now):
                then = seconds[id(r)]
                if now is None or then is None:
                    return now is None and then is None
                return now - span <= then <= now

            mins = None
            if prev is not None and now is not None and seconds[id(prev)] is not None:
                mins = math.floor((now - seconds[id(prev)]) / 60 * 100 + 0.5) / 100
            out.setdefault(row["txn_id"], []).append(
                dict(
                    prev_country=prev and prev["txn_country"],
                    prev_txn_ts=prev and prev["txn_ts"],
                    prev_device=prev and prev["device"],
                    prev_lat=prev and prev["lat"],
                    hist_avg_amount=statistics.fmean(amounts) if amounts else None,
                    hist_std_amount=statistics.stdev(amounts) if len(amounts) > 1 else None,
                    txns_1h=sum(within(r, 3600) for r in own if r["txn_id"] is not None),
                    countries_24h=len(
                        {r["txn_country"] for r in own if within(r, 86400)} - {None}
                    ),
                    mins_since_prev=mins,
                )
            )
    return out
