"""The same results in plain SQL, for a check in another engine.

Each text is self-contained and runs over the given tables. It states the
definitions directly (sliding frames, CASE sums, plain joins), so that it does
not share the shortcuts taken by the DataFrame code.
"""

from __future__ import annotations

from txrisk.functions.columns import REASON_LABELS
from txrisk.sources.files import COUNTRIES

_PLACES = ", ".join(
    f"({i}, '{code}', '{city}', {lat}::double, {lon}::double)"
    for i, (code, city, lat, lon) in enumerate(COUNTRIES)
)
_CODES = ", ".join(f"'{code}'" for code, *_ in COUNTRIES)

_TXN_COLUMNS = (
    "txn_id user_id profile home_country home_city txn_country txn_city lat lon amount "
    "avg_ticket device primary_device attempts txn_ts process_date txn_hour"
).split()
_FEATURE_COLUMNS = (
    "prev_country prev_city prev_lat prev_lon prev_txn_ts prev_device hist_avg_amount "
    "hist_std_amount txns_1h countries_24h mins_since_prev km_since_prev kmh_since_prev "
    "is_high_amount is_new_device is_new_country is_abnormal_freq"
).split()
_RISK_COLUMNS = "risk_score risk_reasons risk_level decision".split()
_ENRICHED_COLUMNS = _TXN_COLUMNS + _FEATURE_COLUMNS + _RISK_COLUMNS
_ALERT_COLUMNS = (
    "txn_id user_id txn_country amount risk_score risk_level decision risk_reasons "
    "process_date txn_ts"
).split()
_USER_COLUMNS = (
    "user_seq user_id home_country home_city home_lat home_lon profile primary_device "
    "avg_ticket income_band created_on"
).split()

_RULES = [
    ("IMPOSSIBLE_TRAVEL", 45, "kmh_since_prev > 900"),
    ("VALUE_ABOVE_USER_PROFILE", 25, "is_high_amount"),
    ("NEW_DEVICE", 10, "is_new_device"),
    ("NEW_COUNTRY_FOR_USER", 10, "is_new_country"),
    ("HIGH_ATTEMPT_COUNT", 20, "attempts >= 3"),
    ("UNUSUAL_TRANSACTION_HOUR", 8, "txn_hour < 6"),
    ("ABNORMAL_FREQUENCY", 12, "is_abnormal_freq"),
]

_USERS = f"""
geo(geo_idx, country, city, lat, lon) AS (VALUES {_PLACES}),
homes AS (
  SELECT c.*, g.country AS home_country, g.city AS home_city, g.lat AS home_lat,
         g.lon AS home_lon
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN geo g ON g.geo_idx = n.n_nationkey % 10
),
spent AS (
  SELECT user_id AS c_custkey, CAST(sum(CAST(round(value * 100) AS bigint)) AS bigint) AS cents,
         count(value) AS n
  FROM events GROUP BY user_id
),
users AS (
  SELECT CAST(h.c_custkey AS bigint) AS user_seq, 'user_' || h.c_custkey AS user_id,
         home_country, home_city, home_lat, home_lon,
         CASE WHEN h.c_custkey % 5 = 0 THEN 'VIAJANTE' ELSE 'PADRAO' END AS profile,
         CASE WHEN h.c_custkey % 2 = 0 THEN 'mobile' ELSE 'web' END AS primary_device,
         CAST((2 * cents + n) // (2 * n) AS double) / 100 AS avg_ticket,
         CASE WHEN c_acctbal < 0 THEN 'LOW' WHEN c_acctbal < 5000 THEN 'MIDDLE' ELSE 'HIGH' END
           AS income_band,
         DATE '2020-01-01' + CAST(h.c_custkey % 1000 AS int) AS created_on
  FROM homes h LEFT JOIN spent s ON s.c_custkey = h.c_custkey
)"""

_TXN = f"""{_USERS},
placed AS (
  SELECT e.event_id, 'tx_' || e.event_id AS txn_id, u.*, e.value AS amount, e.ts AS txn_ts,
         CASE WHEN e.event_type = 'error' AND (u.profile = 'VIAJANTE' OR k < 30)
                OR e.event_type = 'signup' AND u.profile = 'VIAJANTE'
              THEN ([{_CODES}])[k % 10 + 1] ELSE u.home_country END AS txn_country,
         CASE WHEN e.event_type <> 'error' OR k < 50 THEN u.primary_device
              WHEN u.primary_device = 'mobile' THEN 'web' ELSE 'mobile' END AS device,
         CASE e.event_type WHEN 'error' THEN 1 + k % 5 WHEN 'signup' THEN 1 + k % 2 ELSE 1 END
           AS attempts
  FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS int), 0) AS k
        FROM events) e
  JOIN users u ON u.user_id = 'user_' || e.user_id
),
txn AS (
  SELECT txn_id, user_id, profile, home_country, home_city, txn_country, g.city AS txn_city,
         g.lat, g.lon, amount, avg_ticket, device, primary_device,
         CAST(attempts AS bigint) AS attempts, txn_ts, CAST(txn_ts AS date) AS process_date,
         CAST(hour(txn_ts) AS bigint) AS txn_hour
  FROM placed LEFT JOIN geo g ON g.country = placed.txn_country
)"""

_SCENARIOS = f"""
ordered AS (
  SELECT o.*, ([{_CODES}])[CAST(o_orderkey % 10 + 1 AS int)] AS txn_country,
         o_orderdate + to_seconds((o_orderkey * 17) % 86400) AS txn_ts
  FROM orders o
),
scen AS (
  SELECT 'order_' || o_orderkey AS txn_id, u.user_id, u.profile, u.home_country, u.home_city,
         o.txn_country, g.city AS txn_city, g.lat, g.lon, o.o_totalprice AS amount,
         u.avg_ticket, CASE WHEN o_orderkey % 2 = 0 THEN 'mobile' ELSE 'web' END AS device,
         u.primary_device, CAST(1 + o_orderkey % 4 AS bigint) AS attempts, o.txn_ts,
         CAST(o.txn_ts AS date) AS process_date, CAST(hour(o.txn_ts) AS bigint) AS txn_hour
  FROM ordered o JOIN users u ON u.user_id = 'user_' || o.o_custkey
  LEFT JOIN geo g ON g.country = o.txn_country
)"""


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half = (
        f"sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"round(12742 * asin(CASE WHEN {half} > 1 THEN 1 ELSE {half} END), 2)"


def _scored(source: str) -> str:
    """CTEs ``feat`` and ``scored`` over a relation of transactions."""
    points = " + ".join(f"CASE WHEN {cond} THEN {pts} ELSE 0 END" for _, pts, cond in _RULES)
    codes = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, _, cond in _RULES)
    return f"""
timed AS (
  SELECT *, epoch_us(txn_ts) // 1000000 AS epoch FROM {source}
),
hist AS (
  SELECT *,
         lag(txn_country) OVER w AS prev_country, lag(txn_city) OVER w AS prev_city,
         lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon,
         lag(txn_ts) OVER w AS prev_txn_ts, lag(device) OVER w AS prev_device,
         lag(epoch) OVER w AS prev_epoch,
         avg(amount) OVER past AS hist_avg_amount,
         stddev_samp(amount) OVER past AS hist_std_amount,
         count(txn_id) OVER (PARTITION BY user_id ORDER BY epoch
           RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS txns_1h,
         count(DISTINCT txn_country) OVER (PARTITION BY user_id ORDER BY epoch
           RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS countries_24h
  FROM timed
  WINDOW w AS (PARTITION BY user_id ORDER BY txn_ts, txn_id),
         past AS (PARTITION BY user_id ORDER BY txn_ts, txn_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
trip AS (
  SELECT *,
         round((epoch - prev_epoch) / 60, 2) AS mins_since_prev,
         {_km("prev_lat", "prev_lon", "lat", "lon")} AS km_since_prev
  FROM hist
),
feat AS (
  SELECT *,
         CASE WHEN mins_since_prev > 0
              THEN round(km_since_prev / (mins_since_prev / 60), 2) END AS kmh_since_prev,
         amount > avg_ticket * 4 AS is_high_amount,
         device <> primary_device AS is_new_device,
         txn_country <> home_country AND prev_country IS NOT NULL AS is_new_country,
         mins_since_prev BETWEEN 0 AND 5 OR txns_1h >= 5 AS is_abnormal_freq
  FROM trip
),
pointed AS (
  SELECT *, CAST(least(100, {points}) AS bigint) AS risk_score,
         concat_ws(',', {codes}) AS risk_reasons
  FROM feat
),
levelled AS (
  SELECT *, CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH'
                 WHEN risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM pointed
),
scored AS (
  SELECT *, CASE risk_level WHEN 'CRITICAL' THEN 'BLOCK' WHEN 'LOW' THEN 'APPROVE'
                            ELSE 'REVIEW' END AS decision
  FROM levelled
),
alerts AS (SELECT * FROM scored WHERE risk_level IN ('MEDIUM', 'HIGH', 'CRITICAL'))"""


_EVENT_SCORES = f"WITH {_TXN}, {_scored('txn')}"
_TOP50 = (
    f"{_EVENT_SCORES}, top50 AS (SELECT * FROM alerts "
    "ORDER BY risk_score DESC, amount DESC, txn_id LIMIT 50)"
)


def _shown(name: str) -> str:
    if name in ("txn_ts", "prev_txn_ts"):
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"
    if name in ("process_date", "created_on"):
        return f"CAST({name} AS varchar) AS {name}"
    if name in ("hist_avg_amount", "hist_std_amount"):
        # plain avg and stddev_samp round at every step; what is compared is to 9 and 6 places
        return f"round({name}, {9 if name == 'hist_avg_amount' else 6}) AS {name}"
    return name


def _pick(ctes: str, columns, source: str, tail: str = "") -> str:
    return f"{ctes} SELECT {', '.join(map(_shown, columns))} FROM {source} {tail}".strip()


def _features(*columns: str) -> str:
    return _pick(_EVENT_SCORES, ("txn_id", *columns), "feat")


def _alerts(condition: str = "", tail: str = "") -> str:
    where = f"WHERE {condition}" if condition else ""
    return _pick(_EVENT_SCORES, _ALERT_COLUMNS, "alerts", f"{where} {tail}")


_LATEST = (
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY txn_ts DESC, txn_id DESC) "
    "AS recency FROM scored"
)


def _profile(rows, before=""):
    return f"""{_EVENT_SCORES}, {before}named AS (
  SELECT DISTINCT user_id, unnest(string_split(risk_reasons, ',')) AS reason
  FROM {rows} WHERE risk_level <> 'LOW'
),
reasons AS (
  SELECT user_id, string_agg(reason, ',' ORDER BY reason) AS top_reasons FROM named
  GROUP BY user_id
),
totals AS (
  SELECT user_id, count(*) AS total_transactions,
         count(*) FILTER (risk_level <> 'LOW') AS total_alerts,
         max(risk_score) AS max_risk_score,
         CAST(sum(CAST(amount AS decimal(18, 6))) AS double) AS exact_amount
  FROM {rows} GROUP BY user_id
),
profile AS (
  SELECT t.user_id, total_transactions, total_alerts, max_risk_score,
         round(exact_amount, 2) AS total_amount, coalesce(top_reasons, '') AS top_reasons
  FROM totals t LEFT JOIN reasons r ON r.user_id = t.user_id
)"""


_PROFILE = _profile("latest", f"latest AS (SELECT * FROM ({_LATEST}) WHERE recency <= 200),\n")

_ID = "CAST(substr(txn_id, 4) AS bigint)"


def _quality(users: str, txns: str, scored: str) -> str:
    checks = [
        ("usuarios_com_id_nulo", users, "user_id IS NULL"),
        ("usuarios_com_pais_residencia_nulo", users, "home_country IS NULL"),
        ("transacoes_com_usuario_nulo", txns, "user_id IS NULL"),
        ("transacoes_com_valor_invalido", txns, "amount IS NULL OR amount < 0"),
        ("transacoes_sem_data_hora", txns, "txn_ts IS NULL"),
        ("transacoes_sem_pais", txns, "txn_country IS NULL"),
        ("risk_score_fora_intervalo", scored,
         "risk_score IS NULL OR risk_score < 0 OR risk_score > 100"),
        ("risk_level_invalido", scored,
         "risk_level IS NULL OR risk_level NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')"),
        ("decision_invalida", scored,
         "decision IS NULL OR decision NOT IN ('APPROVE', 'REVIEW', 'BLOCK')"),
    ]
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) AS invalid_count FROM {source} WHERE {bad}"
        for name, source, bad in checks
    )
    return (
        "SELECT check_name, invalid_count, "
        "CASE WHEN invalid_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status, "
        f"'2024-02-01' AS process_date FROM ({counts}) ORDER BY check_name"
    )


_DIRTY = f"""{_EVENT_SCORES},
dirty_users AS (
  SELECT CASE WHEN user_seq % 7 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN user_seq % 11 = 0 THEN NULL ELSE home_country END AS home_country
  FROM users
),
dirty_txn AS (
  SELECT CASE WHEN {_ID} % 13 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN {_ID} % 17 = 0 THEN NULL WHEN {_ID} % 19 = 0 THEN -1 - amount
              ELSE amount END AS amount,
         CASE WHEN {_ID} % 23 = 0 THEN NULL ELSE txn_ts END AS txn_ts,
         CASE WHEN {_ID} % 29 = 0 THEN NULL ELSE txn_country END AS txn_country
  FROM txn
),
dirty_scored AS (
  SELECT CASE WHEN {_ID} % 31 = 0 THEN NULL WHEN {_ID} % 37 = 0 THEN 101
              ELSE risk_score END AS risk_score,
         CASE WHEN {_ID} % 41 = 0 THEN 'SEVERE' ELSE risk_level END AS risk_level,
         CASE WHEN {_ID} % 43 = 0 THEN NULL ELSE decision END AS decision
  FROM scored
)"""

_METRICS = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, count(*) AS value, CAST(NULL AS varchar) AS detail FROM {source}"
    for name, source in [
        ("users", "users"),
        ("transactions", "txn"),
        ("enriched_transactions", "scored"),
        ("alerts", "alerts"),
        ("alerts_medium", "alerts WHERE risk_level = 'MEDIUM'"),
        ("alerts_high", "alerts WHERE risk_level = 'HIGH'"),
        ("alerts_critical", "alerts WHERE risk_level = 'CRITICAL'"),
    ]
) + (
    " UNION ALL (SELECT 'largest_user' AS metric, count(*) AS value, user_id AS detail FROM txn "
    "GROUP BY user_id ORDER BY value DESC, user_id LIMIT 1)"
)

_LABELS = ", ".join(f"('{code}', '{label}')" for code, label in REASON_LABELS.items())

_SCENARIO_COLUMNS = _ALERT_COLUMNS + [
    "txns_1h", "countries_24h", "mins_since_prev", "km_since_prev", "kmh_since_prev",
    "is_abnormal_freq",
]


def sql() -> dict[str, str]:
    """One SQL text per registered query."""
    report = f"{_EVENT_SCORES} {_quality('users', 'txn', 'scored')}"
    return {
        "users_dim": _pick(f"WITH {_USERS}", _USER_COLUMNS, "users"),
        "geo_dim": f"WITH {_USERS} SELECT home_country, home_city, home_lat, home_lon, "
        "count(*) AS customers FROM homes GROUP BY ALL",
        "txn_canonical": _pick(f"WITH {_TXN}", _TXN_COLUMNS, "txn"),
        "txn_join_users": f"WITH {_TXN} SELECT txn_id, amount, user_id, profile, home_country, "
        "home_city, avg_ticket, primary_device FROM txn",
        "txn_join_geo_left": f"WITH {_USERS}, placed AS (SELECT event_id, "
        "CASE WHEN event_type = 'error' THEN 'ZZ' "
        f"ELSE ([{_CODES}])[CAST(event_id % 10 + 1 AS int)] END AS txn_country FROM events) "
        "SELECT event_id, txn_country, city AS txn_city, lat, lon "
        "FROM placed LEFT JOIN geo ON geo.country = placed.txn_country",
        "user_seq_assignment": "WITH dealt AS (SELECT 'tx_' || event_id AS txn_id, "
        "event_id % (SELECT max(c_custkey) + 1 FROM customer) AS user_seq FROM events) "
        "SELECT txn_id, user_seq FROM dealt JOIN customer ON c_custkey = user_seq",
        "range_spine": "SELECT 'tx_' || n AS txn_id, value AS amount FROM "
        "(SELECT unnest(range(min(event_id), max(event_id) + 1)) AS n FROM events) "
        "LEFT JOIN events ON event_id = n",
        "ts_interval_shift": "SELECT event_id, strftime(ts - to_hours(event_id % 120 * 6) "
        "- to_minutes(event_id % 48 * 30) - to_seconds(event_id % 120 * 30 + event_id % 59), "
        "'%Y-%m-%d %H:%M:%S.%f') AS txn_ts FROM events",
        "prev_txn_context": _features(
            "user_id", "prev_country", "prev_city", "prev_lat", "prev_lon", "prev_txn_ts",
            "prev_device",
        ),
        "haversine_km": _features("prev_lat", "prev_lon", "lat", "lon", "km_since_prev"),
        "geo_velocity": _features("mins_since_prev", "km_since_prev", "kmh_since_prev"),
        "hist_amount_stats": _features("hist_avg_amount", "hist_std_amount"),
        "txns_1h": _features("txns_1h"),
        "countries_24h": _features("countries_24h"),
        "high_amount": _features("amount", "avg_ticket", "is_high_amount"),
        "new_device": _features("device", "primary_device", "is_new_device"),
        "new_country": _features("txn_country", "home_country", "prev_country", "is_new_country"),
        "abnormal_frequency": _features("mins_since_prev", "txns_1h", "is_abnormal_freq"),
        "txn_hour_flag": f"WITH {_TXN} SELECT txn_id, txn_hour, txn_hour < 6 AS is_unusual_hour "
        "FROM txn",
        "features_all": _pick(_EVENT_SCORES, _TXN_COLUMNS + _FEATURE_COLUMNS, "feat"),
        "risk_flags": f"{_EVENT_SCORES} SELECT txn_id, " + ", ".join(
            f"coalesce({cond}, false) AS rule_{code.lower()}" for code, _, cond in _RULES
        ) + " FROM feat",
        "reason_columns": f"{_EVENT_SCORES} SELECT txn_id, " + ", ".join(
            f"CASE WHEN {cond} THEN '{code}' END AS reason_{code.lower()}"
            for code, _, cond in _RULES
        ) + " FROM feat",
        "risk_score": _pick(_EVENT_SCORES, ("txn_id", "risk_score"), "scored"),
        "risk_reasons": _pick(_EVENT_SCORES, ("txn_id", "risk_reasons"), "scored"),
        "risk_level_decision": _pick(
            _EVENT_SCORES, ("txn_id", "risk_score", "risk_level", "decision"), "scored"
        ),
        "alerts_only": _pick(_EVENT_SCORES, _ENRICHED_COLUMNS, "alerts"),
        "scenarios_scored": _pick(
            f"WITH {_USERS}, {_SCENARIOS}, {_scored('scen')}", _SCENARIO_COLUMNS, "scored"
        ),
        "txn_union_scenarios": _pick(
            f"WITH {_TXN}, {_SCENARIOS}, "
            "every AS (SELECT * FROM txn UNION ALL BY NAME SELECT * FROM scen), "
            f"{_scored('every')}",
            _ALERT_COLUMNS + ["prev_country", "prev_txn_ts"],
            "scored",
        ),
        "alerts_all": _alerts(),
        "alerts_ranked": _alerts(tail="ORDER BY risk_score DESC, amount DESC, txn_id"),
        "alerts_top50": _pick(_TOP50, _ALERT_COLUMNS, "top50"),
        "alerts_by_level": _alerts("risk_level = 'HIGH'"),
        "alerts_by_user": _alerts("user_id = 'user_10'"),
        "alerts_by_country": _alerts("txn_country = 'JP'"),
        "alerts_by_reason": _alerts("contains(risk_reasons, 'HIGH_ATTEMPT_COUNT')"),
        "alerts_min_amount": _alerts("amount >= 100"),
        "alerts_by_period": _alerts(
            "CAST(process_date AS varchar) BETWEEN '2024-01-10' AND '2024-01-20'"
        ),
        "alerts_by_decision": _alerts("decision = 'BLOCK'"),
        "alerts_filtered_all": _alerts(
            "risk_level = 'HIGH' AND user_id = 'user_10' AND txn_country = 'JP' "
            "AND contains(risk_reasons, 'IMPOSSIBLE_TRAVEL') AND amount >= 1 "
            "AND CAST(process_date AS varchar) BETWEEN '2024-01-02' AND '2024-01-29' "
            "AND decision = 'REVIEW'",
            "ORDER BY risk_score DESC, amount DESC, txn_id LIMIT 500",
        ),
        "alerts_per_level": f"{_EVENT_SCORES} SELECT risk_level, count(*) AS alerts FROM alerts "
        "GROUP BY risk_level ORDER BY risk_level",
        "txn_by_id": _pick(_EVENT_SCORES, _ENRICHED_COLUMNS, "scored", "WHERE txn_id = 'tx_777'"),
        "history_of_user": _pick(
            _EVENT_SCORES,
            ("user_id", "txn_id", "txn_ts", "amount", "risk_score", "risk_level"),
            f"({_LATEST})",
            "WHERE recency <= 20 AND user_id = 'user_10'",
        ),
        "profile_of_user": f"{_profile('scored')} SELECT * FROM profile "
        "WHERE user_id = 'user_10'",
        "user_history_last20": _pick(
            _EVENT_SCORES,
            ("user_id", "recency", "txn_id", "txn_ts", "amount", "risk_score", "risk_level"),
            f"({_LATEST})",
            "WHERE recency <= 20",
        ),
        "user_risk_profile": f"{_PROFILE} SELECT * FROM profile",
        "user_top_reasons": f"{_PROFILE} SELECT user_id, top_reasons FROM profile",
        "dashboard_kpis": f"{_TOP50} SELECT "
        "round(CAST(sum(CAST(amount AS decimal(18, 6))) AS double), 2) AS total_amount, "
        "count(*) FILTER (risk_level = 'CRITICAL') AS critical_alerts, "
        "count(DISTINCT user_id) AS users_affected, count(*) AS loaded_alerts FROM top50",
        "top10_score_series": f"{_TOP50} SELECT 'ID ' || txn_id AS label, risk_score FROM top50 "
        "ORDER BY risk_score DESC, amount DESC, txn_id LIMIT 10",
        "alerts_page": f"{_TOP50}, numbered AS (SELECT *, row_number() OVER "
        "(ORDER BY risk_score DESC, amount DESC, txn_id) AS position FROM top50) "
        "SELECT (position + 9) // 10 AS page, position, txn_id, risk_score, amount FROM numbered",
        "reasons_labeled": f"{_EVENT_SCORES}, labels(code, label) AS (VALUES {_LABELS}), "
        "named AS (SELECT txn_id, unnest(string_split(risk_reasons, ',')) AS code, "
        "generate_subscripts(string_split(risk_reasons, ','), 1) AS nth FROM alerts) "
        "SELECT txn_id, string_agg(code, ',' ORDER BY nth) AS risk_reasons, "
        "string_agg(coalesce(label, replace(code, '_', ' ')), ',' ORDER BY nth) AS reason_labels "
        "FROM named LEFT JOIN labels USING (code) GROUP BY txn_id",
        "alert_route": f"{_EVENT_SCORES} SELECT txn_id, coalesce(prev_country, '-') AS route_from, "
        "txn_country FROM alerts",
        "dq_report": report,
        "dq_report_sorted": report,
        "dq_report_dirty": f"{_DIRTY} {_quality('dirty_users', 'dirty_txn', 'dirty_scored')}",
        "job_metrics": f"{_EVENT_SCORES} {_METRICS}",
        "lake_roundtrip_users": _pick(f"WITH {_USERS}", _USER_COLUMNS, "users"),
        "lake_roundtrip_bronze": _pick(f"WITH {_TXN}", _TXN_COLUMNS, "txn"),
        "lake_roundtrip_silver": _pick(_EVENT_SCORES, _ENRICHED_COLUMNS, "scored"),
        "lake_roundtrip_gold": _pick(_EVENT_SCORES, _ENRICHED_COLUMNS, "alerts"),
        "lake_roundtrip_quality": report,
    }
