"""The same reports written as plain SQL for DuckDB, to check the Spark results.

Each query names only the benchmark tables (``events``, ``customer``,
``nation``, ``region``, ``part``); the banking tables are inlined as CTEs
as FIXTURES.md defines them (the four cards per customer are generated with
``unnest`` rather than a join). Types are cast where the engines differ
(DuckDB's ``year()`` and ``rank()`` are BIGINT, ``sum(int)`` is HUGEINT).
"""

from __future__ import annotations

# Fixed values, written out a second time so that an error in the library's own shows.
CREDIT_EDGES = (300, 579, 669, 739, 799, 850)
CREDIT_LABELS = ("Poor", "Fair", "Good", "Very Good", "Exceptional")
TIER_NAMES = ("Platinum", "Gold", "Silver", "Bronze", "Standard")
NUM_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# ---------------------------------------------------------------------------
# Adapter views (FIXTURES.md section 2)
# ---------------------------------------------------------------------------

_ADAPTERS = {
    "txn_raw": """
SELECT e.event_id AS id,
       e.ts - INTERVAL '1' MONTH * CAST(e.event_id % 120 AS INT) AS date,
       CASE WHEN e.event_id % 211 <> 0 THEN e.user_id END AS client_id,
       e.user_id * 10 + e.event_id % 5 AS card_id,
       CASE WHEN e.event_id % 53 = 0 THEN 'n.a.'
            WHEN e.event_id % 11 = 0 THEN CONCAT('-', CAST(e.value AS STRING))
            ELSE CAST(2 * e.value AS STRING) END AS amount,
       CASE e.event_id % 3 WHEN 0 THEN 'Swipe Transaction' WHEN 1 THEN 'Chip Transaction' ELSE 'Online Transaction' END AS use_chip,
       CASE WHEN e.event_id % 3 = 2 THEN 'ONLINE' ELSE n.n_name END AS merchant_city,
       CASE WHEN e.event_id % 3 = 2 THEN NULL ELSE r.r_name END AS merchant_state,
       CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE CAST(10000 + n.n_nationkey AS DOUBLE) END AS zip,
       e.event_id % 97 AS merchant_id,
       CAST(4990 + e.event_id % 40 AS INT) AS mcc,
       CASE WHEN e.event_type = 'error' THEN CASE e.event_id % 4 WHEN 0 THEN 'Bad PIN' WHEN 1 THEN 'Insufficient Balance' WHEN 2 THEN 'Technical Glitch' ELSE 'Bad CVV' END END AS errors
FROM events e LEFT JOIN nation n ON e.event_id % 25 = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "users_raw": """
SELECT c_custkey AS id,
       CAST(18 + c_custkey % 70 AS INT) AS current_age, CAST(60 + c_custkey % 11 AS INT) AS retirement_age,
       CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
       CONCAT('$', CAST(5000 + (c_custkey * 7919) % 40000 AS STRING)) AS per_capita_income,
       CONCAT('$', CAST(CASE WHEN c_custkey % 97 = 0 THEN 0 WHEN c_custkey % 101 = 0 THEN 400000 WHEN c_custkey % 103 = 0 THEN -90000 ELSE 10000 + (c_custkey * 7919) % 80000 END AS STRING)) AS yearly_income,
       CONCAT('$', CAST((c_custkey * 104729) % 150000 AS STRING)) AS total_debt,
       CAST(300 + (c_custkey * 37) % 551 AS INT) AS credit_score
FROM customer""",
    "cards": """
SELECT c.c_custkey * 10 + c.k AS id, c.c_custkey AS client_id,
       CAST(DATE '2005-01-01' + CAST((c.c_custkey * 13 + c.k) % 3000 AS INT) AS TIMESTAMP) AS acct_open_date,
       CAST(DATE '2012-01-01' + CAST((c.c_custkey * 7 + c.k * 31) % 4000 AS INT) AS TIMESTAMP) AS expires,
       CASE WHEN (c.c_custkey + c.k) % 5 = 0 THEN 'NO' ELSE 'YES' END AS has_chip,
       CASE c.k WHEN 0 THEN 'Credit' WHEN 3 THEN 'Debit (Prepaid)' ELSE 'Debit' END AS card_type,
       CASE WHEN (c.c_custkey * 3 + c.k) % 19 = 0 THEN 'Yes' ELSE 'No' END AS card_on_dark_web
FROM (SELECT c_custkey, unnest([0, 1, 2, 3]) AS k FROM customer) c""",
    "mcc_codes": """
SELECT CAST(5000 + p_partkey AS INT) AS code, p_type AS description FROM part""",
    "fraud_labels": """
SELECT event_id AS id, CASE WHEN event_id % 5 = 1 THEN NULL WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'Yes' ELSE 'No' END AS Target
FROM events""",
}

TXN_RAW_COLUMNS = [
    ("id", "bigint"), ("date", "timestamp_ntz"), ("client_id", "bigint"), ("card_id", "bigint"),
    ("amount", "string"), ("use_chip", "string"), ("merchant_city", "string"),
    ("merchant_state", "string"), ("zip", "double"), ("merchant_id", "bigint"), ("mcc", "int"),
    ("errors", "string"),
]
USERS_RAW_COLUMNS = [
    ("id", "bigint"), ("current_age", "int"), ("retirement_age", "int"), ("gender", "string"),
    ("per_capita_income", "string"), ("yearly_income", "string"), ("total_debt", "string"),
    ("credit_score", "int"),
]
TXN_FEATURE_COLUMNS = ["year", "month", "hour", "is_online", "is_refund", "is_high_value"]
USER_FEATURE_COLUMNS = ["years_to_retirement", "is_retired", "debt_to_income"]

# ---------------------------------------------------------------------------
# SQL fragments
# ---------------------------------------------------------------------------


def msum(x: str) -> str:
    return f"COALESCE(CAST(SUM(CAST({x} AS DECIMAL(24,6))) AS DOUBLE), 0.0)"


def mavg(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(24,6))) AS DOUBLE) / NULLIF(COUNT({x}), 0)"


def significant(x: str, digits: int = 11) -> str:
    return f"CASE WHEN ({x}) = 0 OR NOT isfinite({x}) THEN ({x}) ELSE CAST(printf('%.{digits - 1}e', {x}) AS DOUBLE) END"


def fmean(x: str) -> str:
    v = f"(CASE WHEN NOT isnan(CAST({x} AS DOUBLE)) THEN CAST({x} AS DOUBLE) END)"
    fin = f"(CASE WHEN isfinite({v}) THEN {v} END)"
    pos = f"bool_or({v} = 'inf'::DOUBLE)"
    neg = f"bool_or({v} = '-inf'::DOUBLE)"
    return (f"CASE WHEN {pos} AND {neg} THEN 'nan'::DOUBLE WHEN {pos} THEN 'inf'::DOUBLE "
            f"WHEN {neg} THEN '-inf'::DOUBLE ELSE {significant(f'AVG({fin})')} END")


def rnd(x: str, digits: int = 9) -> str:
    scale = f"{float(10 ** digits)!r}::DOUBLE"
    return f"round_even(({x}) * {scale}, 0) / {scale}"


ERR = "CASE WHEN errors <> 'No Errors' THEN 1 ELSE 0 END"
ERR_STATS = f"COUNT(*) AS transactions, CAST(SUM({ERR}) AS BIGINT) AS errors"
RATE = "CAST(errors AS DOUBLE) / transactions AS error_rate"


def _band_case(x: str, values) -> str:
    parts = [f"WHEN {x} > {lo} AND {x} <= {hi} THEN {v}"
             for lo, hi, v in zip(CREDIT_EDGES[:-1], CREDIT_EDGES[1:], values)]
    return "CASE " + " ".join(parts) + " END"


_BAND_INDEX = _band_case("credit_score", range(len(CREDIT_LABELS)))

_DERIVED = {
    "txn_clean": ("txn_raw", f"""
SELECT id, date, client_id, card_id,
       CASE WHEN isfinite(a) THEN a END AS amount,
       use_chip, merchant_city, COALESCE(merchant_state, 'ONLINE') AS merchant_state,
       CASE WHEN merchant_city = 'ONLINE' THEN 0.0::DOUBLE ELSE COALESCE(zip, 0.0::DOUBLE) END AS zip,
       merchant_id, mcc, COALESCE(errors, 'No Errors') AS errors
FROM (SELECT *, CASE WHEN regexp_full_match(amount, '{NUM_PATTERN}') THEN TRY_CAST(trim(amount) AS DOUBLE) END AS a
      FROM txn_raw)"""),
    "t": ("txn_clean", """
SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(hour(date) AS INTEGER) AS hour,
       CAST(COALESCE(merchant_city = 'ONLINE', false) AS INTEGER) AS is_online,
       CAST(COALESCE(amount < 0, false) AS INTEGER) AS is_refund,
       CAST(COALESCE(amount > 500, false) AS INTEGER) AS is_high_value
FROM txn_clean"""),
    "users_clean": ("users_raw", """
SELECT id, current_age, retirement_age, gender,
       CAST(replace(per_capita_income, '$', '') AS DOUBLE) AS per_capita_income,
       CAST(replace(yearly_income, '$', '') AS DOUBLE) AS yearly_income,
       CAST(replace(total_debt, '$', '') AS DOUBLE) AS total_debt,
       credit_score
FROM users_raw"""),
    "u": ("users_clean", """
SELECT *, CASE WHEN retirement_age - current_age < 0 THEN 0 ELSE retirement_age - current_age END AS years_to_retirement,
       CAST(COALESCE(current_age >= retirement_age, false) AS INTEGER) AS is_retired,
       round_even(
         CASE WHEN total_debt IS NULL OR yearly_income IS NULL THEN NULL
              WHEN yearly_income = 0 THEN CASE WHEN total_debt > 0 THEN 'inf'::DOUBLE
                                               WHEN total_debt < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END
              ELSE total_debt / yearly_income END * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS debt_to_income
FROM users_clean"""),
    "k": ("cards", """
SELECT *, CAST(floor(date_diff('microsecond', acct_open_date, expires) / 86400000000.0::DOUBLE) AS BIGINT) AS account_duration_days,
       CAST(COALESCE(has_chip = 'YES', false) AS INTEGER) AS is_chip_enabled
FROM cards"""),
}


def _deps(name: str) -> list[str]:
    if name in _ADAPTERS:
        return [name]
    parent, _ = _DERIVED[name]
    return _deps(parent) + [name]


def with_views(views: list[str], body: str) -> str:
    """``WITH`` clause holding ``views`` and whatever they build on, then ``body``."""
    order: list[str] = []
    for v in views:
        for d in _deps(v):
            if d not in order:
                order.append(d)
    ctes = []
    for name in order:
        sql = _ADAPTERS[name] if name in _ADAPTERS else _DERIVED[name][1]
        ctes.append(f"{name} AS ({sql}\n)")
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------


def _per_column_union(table: str, source: str, columns, value_sql: str, value_name: str) -> str:
    parts = [f"SELECT '{table}' AS \"table\", {i} AS position, '{c}' AS \"column\", "
             f"{value_sql.format(c=c)} AS {value_name} FROM {source}"
             for i, c in enumerate(columns)]
    return "\nUNION ALL ".join(parts)


def _quantiles_sql(source: str, value: str, probs, names) -> str:
    """One-row SELECT of numpy-linear quantiles of ``value`` over ``source``.

    The values at 0-based ranks floor((n - 1) p) and the next one (capped at
    n - 1) are picked with row_number(), then interpolated as numpy does:
    a + (b - a) t, or b - (b - a)(1 - t) when t >= 0.5. Nulls and NaN skipped.
    """
    ranked = (f"SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS rk, COUNT(*) OVER () AS n "
              f"FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source}) WHERE v IS NOT NULL AND NOT isnan(v)")
    picks, outs = ["max(n) AS n"], []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = f"((n - 1) * {float(p)!r}::DOUBLE)"
        prev = f"floor({pos})"
        nxt = f"least({prev} + 1, n - 1)"
        picks.append(f"max(CASE WHEN rk = {prev} THEN v END) AS a{i}")
        picks.append(f"max(CASE WHEN rk = {nxt} THEN v END) AS b{i}")
        t = f"(((n - 1) * {float(p)!r}::DOUBLE) - floor((n - 1) * {float(p)!r}::DOUBLE))"
        outs.append(f"CASE WHEN {t} >= 0.5 THEN b{i} - (b{i} - a{i}) * (1.0::DOUBLE - {t}) "
                    f"ELSE a{i} + (b{i} - a{i}) * {t} END AS {name}")
    return f"SELECT {', '.join(outs)} FROM (SELECT {', '.join(picks)} FROM ({ranked}))"


def _describe(source: str, columns) -> str:
    parts = []
    for c in columns:
        v = f"(CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END)"
        std = (f"CASE WHEN bool_or(isinf({v})) THEN 'nan'::DOUBLE "
               f"ELSE {significant(f'stddev_samp({v})')} END")
        q = _quantiles_sql(source, c, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
        parts.append(
            f"SELECT '{c}' AS \"column\", COUNT({v}) AS count, {fmean(v)} AS mean, {std} AS std, "
            f"MIN({v}) AS min, (SELECT p25 FROM ({q})) AS p25, (SELECT p50 FROM ({q})) AS p50, "
            f"(SELECT p75 FROM ({q})) AS p75, MAX({v}) AS max FROM {source}")
    return "\nUNION ALL ".join(parts)


def _bounds(source: str, column: str) -> str:
    q = _quantiles_sql(source, column, [0.25, 0.75], ["q1", "q3"])
    return (f"SELECT '{column}' AS \"column\", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lb, "
            f"q3 + 1.5 * (q3 - q1) AS ub FROM ({q})")


def _corr(columns) -> str:
    parts = []
    for a in columns:
        for b in columns:
            xa = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            r = f"covar_pop({xa}, {xb}) / NULLIF(stddev_pop({xa}) * stddev_pop({xb}), 0)"
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {rnd(r)} AS r FROM u")
    return "\nUNION ALL ".join(parts)


def _risk_sql() -> str:
    return f"""
pc AS (SELECT client_id, {ERR_STATS} FROM t GROUP BY client_id),
cc AS (SELECT client_id, MAX(CASE WHEN card_on_dark_web = 'Yes' THEN 1 ELSE 0 END) AS compromised
       FROM cards GROUP BY client_id),
ov AS (SELECT CAST(SUM({ERR}) AS DOUBLE) / COUNT(*) AS r FROM t),
b AS (SELECT u.id AS client_id, u.credit_score,
             CASE WHEN credit_score <= 579 THEN 'Poor' WHEN credit_score <= 669 THEN 'Fair' WHEN credit_score <= 739 THEN 'Good'
                  WHEN credit_score <= 799 THEN 'Very Good' WHEN credit_score <= 850 THEN 'Exceptional' ELSE 'Unknown' END AS credit_band,
             COALESCE(pc.transactions, 0) AS transactions,
             CAST(pc.errors AS DOUBLE) / pc.transactions AS error_rate,
             COALESCE(cc.compromised, 0) AS compromised
      FROM u LEFT JOIN pc ON u.id = pc.client_id LEFT JOIN cc ON u.id = cc.client_id),
s AS (SELECT b.*, CAST(
        CASE credit_band WHEN 'Poor' THEN 3 WHEN 'Fair' THEN 2 WHEN 'Good' THEN 1 ELSE 0 END
        + CASE WHEN error_rate > 1.5 * (SELECT r FROM ov) THEN 2
               WHEN error_rate > (SELECT r FROM ov) THEN 1 ELSE 0 END
        + CASE WHEN compromised = 1 THEN 2 ELSE 0 END AS INTEGER) AS risk_score
      FROM b),
risk AS (SELECT *, CASE WHEN risk_score >= 5 THEN 'High' WHEN risk_score >= 3 THEN 'Medium' ELSE 'Low' END AS risk_band
         FROM s)"""


def _tiers_sql() -> str:
    names = ", ".join(f"'{t}'" for t in TIER_NAMES)
    return f"""
SELECT client_id, total_spent, tier_rank, [{names}][tier_rank] AS tier FROM (
  SELECT client_id, total_spent,
         CAST(NTILE({len(TIER_NAMES)}) OVER (ORDER BY total_spent DESC, client_id) AS INTEGER) AS tier_rank
  FROM (SELECT client_id, {msum('amount')} AS total_spent FROM t WHERE client_id IS NOT NULL GROUP BY client_id))"""


def _build() -> dict[str, str]:
    txn_cols = [c for c, _ in TXN_RAW_COLUMNS]
    user_cols = [c for c, _ in USERS_RAW_COLUMNS]
    user_feature_cols = user_cols + USER_FEATURE_COLUMNS
    numeric_user_cols = [c for c in user_feature_cols if c != "gender"]
    q: dict[str, str] = {}

    q["parse_transactions"] = with_views(["txn_raw"], """
SELECT id, CASE WHEN id % 29 <> 0 AND id % 31 <> 0 THEN date_trunc('second', date) END AS date,
       CASE WHEN id % 37 <> 0 THEN client_id END AS client_id, card_id, CASE WHEN amount <> 'n/a' THEN amount END AS amount,
       use_chip, merchant_city, merchant_state, zip, merchant_id, mcc, errors
FROM txn_raw""")
    q["parse_failures"] = with_views(["txn_raw"], """
SELECT c."column", CASE c."column" WHEN 'date' THEN f.dates WHEN 'client_id' THEN f.clients ELSE 0 END AS failures
FROM (SELECT COUNT(*) FILTER (WHERE id % 29 = 0) AS dates, COUNT(*) FILTER (WHERE id % 37 = 0) AS clients FROM txn_raw) f,
     (VALUES ('id'), ('date'), ('client_id'), ('card_id'), ('merchant_id'), ('zip'), ('mcc'), ('(line)')) c("column")""")
    q["parse_users"] = with_views(["users_raw"], """
SELECT id, CASE WHEN id % 41 <> 0 AND id % 43 <> 0 THEN current_age END AS current_age, retirement_age, gender, per_capita_income, yearly_income,
       total_debt, CASE WHEN id % 47 <> 0 AND id % 53 <> 0 THEN credit_score END AS credit_score
FROM users_raw""")
    q["parse_cards"] = with_views(["cards"], """
SELECT id, client_id, CAST(date_trunc('month', acct_open_date) AS TIMESTAMP) AS acct_open_date,
       CASE WHEN id % 23 <> 0 THEN CAST(date_trunc('month', expires) AS TIMESTAMP) END AS expires,
       has_chip, card_type, CASE WHEN id % 29 <> 0 THEN card_on_dark_web END AS card_on_dark_web
FROM cards""")
    q["parse_mcc"] = with_views(["mcc_codes"], """
SELECT CASE WHEN code % 19 <> 0 THEN code END AS code, CASE WHEN code % 17 <> 0 THEN description END AS description FROM mcc_codes""")
    q["parse_labels"] = with_views(["fraud_labels"], "SELECT id, Target FROM fraud_labels")

    q["table_shape"] = with_views(["txn_raw", "users_raw"], f"""
SELECT 'transactions' AS "table", COUNT(*) AS "rows", {len(txn_cols)} AS "columns" FROM txn_raw
UNION ALL SELECT 'users', COUNT(*), {len(user_cols)} FROM users_raw""")

    info = []
    for table, src, cols in (("transactions", "txn_raw", TXN_RAW_COLUMNS), ("users", "users_raw", USERS_RAW_COLUMNS)):
        info += [f"SELECT '{table}' AS \"table\", {i} AS position, '{c}' AS \"column\", "
                 f"COUNT({c}) AS non_null, '{t}' AS dtype FROM {src}" for i, (c, t) in enumerate(cols)]
    q["table_info"] = with_views(["txn_raw", "users_raw"], "\nUNION ALL ".join(info))
    q["table_head"] = with_views(["txn_raw"], "SELECT * FROM txn_raw ORDER BY id LIMIT 5")
    q["users_head"] = with_views(["users_raw"], "SELECT * FROM users_raw ORDER BY id LIMIT 5")
    q["txn_features_head"] = with_views(["t"], f"SELECT id, {', '.join(TXN_FEATURE_COLUMNS)} FROM t ORDER BY id LIMIT 5")
    q["user_features_head"] = with_views(["u"], f"SELECT id, {', '.join(USER_FEATURE_COLUMNS)} FROM u ORDER BY id LIMIT 5")
    q["card_features_head"] = with_views(["k"], "SELECT id, account_duration_days, is_chip_enabled FROM k ORDER BY id LIMIT 5")
    q["null_counts"] = with_views(["txn_clean", "users_clean"], "SELECT * FROM (\n"
        + _per_column_union("transactions", "txn_clean", txn_cols, "COUNT(*) - COUNT({c})", "null_count")
        + "\nUNION ALL "
        + _per_column_union("users", "users_clean", user_cols, "COUNT(*) - COUNT({c})", "null_count")
        + ")")
    q["duplicate_rows"] = with_views(["users_clean"], """
SELECT 'users' AS "table", (SELECT COUNT(*) FROM users_clean) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM users_clean)) AS duplicates
UNION ALL SELECT 'users_age_gender', (SELECT COUNT(*) FROM users_clean)
  - (SELECT COUNT(*) FROM (SELECT DISTINCT current_age, retirement_age, gender FROM users_clean))""")
    q["describe_users"] = with_views(["u"], _describe("u", numeric_user_cols))
    q["describe_credit_score"] = with_views(["u"], _describe("u", ["credit_score"]))

    q["clean_transactions"] = with_views(["txn_clean"], "SELECT * FROM txn_clean")
    q["clean_users"] = with_views(["users_clean"], "SELECT * FROM users_clean")
    q["txn_features"] = with_views(["t"], "SELECT * FROM t")
    q["user_features"] = with_views(["u"], "SELECT * FROM u")
    q["card_features"] = with_views(["k"], "SELECT * FROM k")

    q["txn_by_channel"] = with_views(["t"], f"""
SELECT use_chip, COUNT(amount) AS transaction_count, {mavg('amount')} AS avg_amount, {msum('amount')} AS total_volume
FROM t WHERE use_chip IS NOT NULL GROUP BY use_chip ORDER BY total_volume DESC, use_chip""")
    q["txn_by_year"] = with_views(["t"], f"""
SELECT year, COUNT(amount) AS "count", {msum('amount')} AS total, {mavg('amount')} AS "avg"
FROM t WHERE year IS NOT NULL GROUP BY year ORDER BY year""")
    q["busiest_hours"] = with_views(["t"], """
SELECT hour, COUNT(amount) AS "count" FROM t WHERE hour IS NOT NULL GROUP BY hour ORDER BY "count" DESC, hour LIMIT 5""")
    for key, col in (("top_states", "merchant_state"), ("top_cities", "merchant_city")):
        q[key] = with_views(["t"], f"""
SELECT {col}, COUNT(amount) AS "count", {msum('amount')} AS total FROM t WHERE {col} IS NOT NULL
GROUP BY {col} ORDER BY total DESC, {col} LIMIT 10""")
    summary = f"""SELECT client_id, {msum('amount')} AS total_spent, {mavg('amount')} AS avg_transaction,
COUNT(amount) AS transaction_count FROM t WHERE client_id IS NOT NULL GROUP BY client_id"""
    q["customer_summary"] = with_views(["t"], summary)
    q["top_spenders"] = with_views(["t"], summary + " ORDER BY total_spent DESC, client_id LIMIT 5")
    q["most_active_customers"] = with_views(["t"], summary + " ORDER BY transaction_count DESC, client_id LIMIT 5")
    q["error_types"] = with_views(["t"], f"""
SELECT errors, COUNT(amount) AS "count", {mavg('amount')} AS avg_amount FROM t
WHERE errors <> 'No Errors' GROUP BY errors ORDER BY "count" DESC, errors""")

    q["amount_quantiles"] = with_views(["t"], _quantiles_sql("t", "amount", [0.25, 0.75], ["q1", "q3"]))
    q["income_quantiles"] = with_views(["u"], _quantiles_sql("u", "yearly_income", [0.25, 0.75], ["q1", "q3"]))
    q["iqr_bounds"] = with_views(["t", "u"], _bounds("t", "amount") + "\nUNION ALL " + _bounds("u", "yearly_income"))
    n_txn_features = len(txn_cols) + len(TXN_FEATURE_COLUMNS)
    q["amount_low_outliers"] = with_views(["t"], f"""
SELECT COUNT(*) AS "rows", {n_txn_features} AS "columns" FROM t WHERE amount < (SELECT lb FROM ({_bounds('t', 'amount')}))""")
    q["amount_high_outliers"] = with_views(["t"], f"""
SELECT COUNT(*) AS "rows", {n_txn_features} AS "columns" FROM t WHERE amount > (SELECT ub FROM ({_bounds('t', 'amount')}))""")
    q["income_high_outliers"] = with_views(["u"], f"""
SELECT * FROM u WHERE yearly_income > (SELECT ub FROM ({_bounds('u', 'yearly_income')}))""")
    q["income_low_outliers"] = with_views(["u"], f"""
SELECT * FROM u WHERE yearly_income < (SELECT lb FROM ({_bounds('u', 'yearly_income')}))""")

    q["gender_counts"] = with_views(["u"], """
SELECT gender, COUNT(*) AS "count" FROM u WHERE gender IS NOT NULL GROUP BY gender ORDER BY "count" DESC, gender""")
    q["gender_means"] = with_views(["u"], f"""
SELECT gender, {fmean('per_capita_income')} AS per_capita_income, {fmean('yearly_income')} AS yearly_income,
       {fmean('total_debt')} AS total_debt, {fmean('debt_to_income')} AS debt_to_income
FROM u WHERE gender IS NOT NULL GROUP BY gender ORDER BY gender""")
    bands = ", ".join(f"({i}, '{x}')" for i, x in enumerate(CREDIT_LABELS))
    q["credit_bands"] = with_views(["u"], f"""
SELECT b.band_order, b.credit_band, COALESCE(c.n, 0) AS "count"
FROM (VALUES {bands}) b(band_order, credit_band)
LEFT JOIN (SELECT band_order, COUNT(*) AS n FROM (SELECT {_BAND_INDEX} AS band_order FROM u)
           WHERE band_order IS NOT NULL GROUP BY band_order) c ON b.band_order = c.band_order
ORDER BY b.band_order""")
    q["retired_means"] = with_views(["u"], f"""
SELECT is_retired, {fmean('yearly_income')} AS yearly_income, {fmean('total_debt')} AS total_debt,
       {fmean('credit_score')} AS credit_score
FROM u WHERE is_retired IS NOT NULL GROUP BY is_retired ORDER BY is_retired""")
    q["user_correlations"] = with_views(["u"], _corr(
        ["per_capita_income", "yearly_income", "total_debt", "credit_score"]))

    q["label_counts"] = with_views(["fraud_labels"], """
SELECT Target, COUNT(*) AS "count" FROM fraud_labels WHERE Target IS NOT NULL GROUP BY Target ORDER BY "count" DESC, Target""")
    q["label_shares"] = with_views(["fraud_labels"], """
SELECT Target, COUNT(*) / (SELECT COUNT(*) FROM fraud_labels WHERE Target IS NOT NULL) AS proportion
FROM fraud_labels WHERE Target IS NOT NULL GROUP BY Target ORDER BY proportion DESC, Target""")

    q["overview"] = with_views(["t"], """
SELECT COUNT(*) AS transactions, MIN(date) AS first_date, MAX(date) AS last_date,
       COUNT(DISTINCT client_id) AS customers, COUNT(DISTINCT card_id) AS cards,
       COUNT(DISTINCT merchant_id) AS merchants FROM t""")
    q["revenue_growth"] = with_views(["t"], f"""
SELECT year, transactions, revenue, avg_amount, customers,
       (100 * (revenue - prev)) / NULLIF(prev, 0) AS growth_pct
FROM (SELECT *, LAG(revenue) OVER (ORDER BY year) AS prev FROM (
      SELECT year, COUNT(*) AS transactions, {msum('amount')} AS revenue, {mavg('amount')} AS avg_amount,
             COUNT(DISTINCT client_id) AS customers
      FROM t WHERE year IS NOT NULL GROUP BY year))
ORDER BY year""")
    q["heavy_spenders"], q["heavy_customers"] = q["top_spenders"], q["most_active_customers"]
    q["heavy_states"], q["heavy_cities"] = q["top_states"], q["top_cities"]
    q["overview_merged"], q["revenue_growth_merged"] = q["overview"], q["revenue_growth"]
    q["error_rate_by_type"] = with_views(["t"], """
SELECT errors, COUNT(*) AS "count",
       COUNT(*) / (SELECT COUNT(*) FROM t WHERE errors <> 'No Errors') AS share_of_errors,
       COUNT(*) / (SELECT COUNT(*) FROM t) AS share_of_transactions
FROM t WHERE errors <> 'No Errors' GROUP BY errors ORDER BY "count" DESC, errors""")
    q["high_risk_customers"] = with_views(["t"], f"""
SELECT client_id, transactions, errors, {RATE} FROM (
  SELECT client_id, {ERR_STATS} FROM t WHERE client_id IS NOT NULL GROUP BY client_id)
WHERE transactions >= 50 ORDER BY error_rate DESC, client_id""")
    q["high_value_errors"] = with_views(["t"], f"""
SELECT is_high_value, transactions, errors, {RATE} FROM (
  SELECT is_high_value, {ERR_STATS} FROM t GROUP BY is_high_value) ORDER BY is_high_value""")
    q["dark_web_cards"] = with_views(["t", "cards"], f"""
SELECT card_on_dark_web, cards, transactions, errors, avg_amount, {RATE} FROM (
  SELECT c.card_on_dark_web, COUNT(DISTINCT t.card_id) AS cards, COUNT(*) AS transactions,
         CAST(SUM({ERR}) AS BIGINT) AS errors, {mavg('t.amount')} AS avg_amount
  FROM t JOIN cards c ON t.card_id = c.id GROUP BY c.card_on_dark_web) ORDER BY card_on_dark_web""")
    q["unmatched_card_transactions"] = with_views(["t", "cards"], """
SELECT COUNT(DISTINCT card_id) AS cards, COUNT(*) AS transactions FROM t
WHERE NOT EXISTS (SELECT 1 FROM cards c WHERE c.id = t.card_id)""")
    q["channel_mix_by_year"] = with_views(["t"], """
SELECT year, use_chip, COUNT(*) AS transactions,
       COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY year) AS share
FROM t WHERE year IS NOT NULL AND use_chip IS NOT NULL GROUP BY year, use_chip ORDER BY year, use_chip""")
    q["channel_mix_wide"] = with_views(["t"], """
SELECT year, COUNT(*) FILTER (WHERE use_chip = 'Chip Transaction') AS chip,
       COUNT(*) FILTER (WHERE use_chip = 'Online Transaction') AS online,
       COUNT(*) FILTER (WHERE use_chip = 'Swipe Transaction') AS swipe,
       COUNT(*) FILTER (WHERE use_chip IS NULL OR use_chip NOT IN ('Chip Transaction', 'Online Transaction', 'Swipe Transaction')) AS other
FROM t WHERE year IS NOT NULL GROUP BY year ORDER BY year""")
    q["customer_tiers"] = with_views(["t"], _tiers_sql())
    q["tier_summary"] = with_views(["t"], f"""
SELECT tier_rank, tier, COUNT(*) AS customers, {msum('total_spent')} AS total_spent,
       {mavg('total_spent')} AS avg_spent
FROM ({_tiers_sql()}) GROUP BY tier_rank, tier ORDER BY tier_rank""")
    q["geography"] = with_views(["t"], f"""
SELECT merchant_state, transactions, revenue, merchants,
       CAST(transactions AS DOUBLE) / merchants AS txn_per_merchant,
       CAST(transactions AS DOUBLE) / (SELECT COUNT(*) FROM t WHERE merchant_state IS NOT NULL) AS share,
       CAST(RANK() OVER (ORDER BY transactions DESC) AS INTEGER) AS "rank"
FROM (SELECT merchant_state, COUNT(*) AS transactions, {msum('amount')} AS revenue,
             COUNT(DISTINCT merchant_id) AS merchants
      FROM t WHERE merchant_state IS NOT NULL GROUP BY merchant_state)
ORDER BY "rank", merchant_state""")
    q["geography_merged"] = q["geography"]
    q["merchant_categories"] = with_views(["t", "mcc_codes"], f"""
SELECT p.mcc, COALESCE(m.description, 'Unknown') AS description, p.transactions, p.errors,
       CAST(p.errors AS DOUBLE) / p.transactions AS error_rate
FROM (SELECT mcc, {ERR_STATS} FROM t GROUP BY mcc) p
LEFT JOIN mcc_codes m ON p.mcc = m.code ORDER BY error_rate DESC, p.mcc""")
    q["refund_summary"] = with_views(["t"], f"""
SELECT year, CAST(GROUPING(year) AS INTEGER) AS is_total, COUNT(*) AS transactions,
       CAST(SUM(is_refund) AS BIGINT) AS refunds,
       {msum('CASE WHEN is_refund = 1 THEN amount END')} AS refunded_amount,
       {msum('amount')} AS net_amount,
       CAST(SUM(is_refund) AS DOUBLE) / COUNT(*) AS refund_rate
FROM t GROUP BY ROLLUP (year) ORDER BY is_total, year""")
    q["refund_customers"] = with_views(["t"], """
SELECT client_id, transactions, refunds, refund_rate FROM (
  SELECT client_id, COUNT(*) AS transactions, CAST(SUM(is_refund) AS BIGINT) AS refunds,
         CAST(SUM(is_refund) AS DOUBLE) / COUNT(*) AS refund_rate
  FROM t GROUP BY client_id)
WHERE client_id IS NOT NULL AND refunds >= 5 AND refund_rate > 2.0 * (SELECT CAST(SUM(is_refund) AS DOUBLE) / COUNT(*) FROM t)
ORDER BY refund_rate DESC, client_id""")
    q["error_rate_by_hour"] = with_views(["t"], f"""
SELECT hour, transactions, errors, {RATE}, CAST(hour >= 2 AND hour < 6 AS INTEGER) AS night FROM (
  SELECT hour, {ERR_STATS} FROM t WHERE hour IS NOT NULL GROUP BY hour) ORDER BY hour""")
    q["error_rate_night"] = with_views(["t"], f"""
SELECT night, transactions, errors, {RATE} FROM (
  SELECT CAST(hour >= 2 AND hour < 6 AS INTEGER) AS night, {ERR_STATS} FROM t WHERE hour IS NOT NULL
  GROUP BY 1) ORDER BY night""")
    q["chip_vs_swipe_errors"] = with_views(["t"], f"""
SELECT use_chip, transactions, errors, {RATE} FROM (
  SELECT use_chip, {ERR_STATS} FROM t WHERE use_chip IS NOT NULL GROUP BY use_chip) ORDER BY use_chip""")
    q["dark_web_by_card_type"] = with_views(["k"], """
SELECT card_type, is_chip_enabled, cards, dark_web_cards, CAST(dark_web_cards AS DOUBLE) / cards AS dark_web_rate
FROM (SELECT card_type, is_chip_enabled, COUNT(*) AS cards,
             CAST(SUM(CASE WHEN card_on_dark_web = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS dark_web_cards
      FROM k GROUP BY card_type, is_chip_enabled) ORDER BY card_type, is_chip_enabled""")
    risk = with_views(["t", "u", "cards"], "")[:-1] + "," + _risk_sql() + "\n"
    q["customer_risk"] = risk + "SELECT * FROM risk"
    q["risk_band_counts"] = risk + "SELECT risk_band, COUNT(*) AS customers FROM risk GROUP BY risk_band ORDER BY risk_band"
    q["fraud_by_channel"] = with_views(["t", "fraud_labels"], """
SELECT t.use_chip, t.year, COUNT(*) AS labelled,
       CAST(SUM(CASE WHEN l.Target = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS fraud,
       CAST(SUM(CASE WHEN l.Target = 'Yes' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS fraud_rate
FROM fraud_labels l JOIN t ON l.id = t.id WHERE l.Target IS NOT NULL GROUP BY t.use_chip, t.year ORDER BY t.use_chip, t.year""")
    return q


ORACLE_SQL: dict[str, str] = _build()
