"""Reference answers in plain SQL over the given tables, for the side-by-side check."""

from __future__ import annotations

# The transaction view of FIXTURES.md, section 2.
TXN = """
iso(k, iso) AS (VALUES (0,'USA'),(1,'GBR'),(2,'DEU'),(3,'FRA'),(4,'IRN'),(5,'JPN'),(6,'CAN'),
  (7,'NGA'),(8,'BRA'),(9,'IND'),(10,'CHE'),(11,'RUS'),(12,'SGP'),(13,'AUS'),(14,'ESP'),(15,'ITA'),
  (16,'PAK'),(17,'NLD'),(18,'SWE'),(19,'MEX'),(20,'ZAF'),(21,'CUB'),(22,'ARE'),(23,'POL'),(24,'KOR')),
mcc(k, mcc) AS (VALUES (0,'5411'),(1,'7995'),(2,'5812'),(3,'6051'),(4,'5541'),(5,'4829'),(6,'5999'),
  (7,'5311'),(8,'4111'),(9,'5732')),
n AS (SELECT count(*) AS n FROM supplier),
e AS (SELECT ev.*, (ev.event_id * 7919 + ev.user_id * 31) % n.n AS s FROM events ev CROSS JOIN n),
txn AS (
SELECT e.event_id AS txn_id, e.ts AS ts, round(e.value * 200) AS amount,
  c.c_name AS sender_account, s.s_name AS receiver_account,
  i1.iso AS sender_country, i2.iso AS receiver_country, m.mcc AS mcc,
  concat('Merchant ', m.mcc) AS merchant_name,
  concat('4000', lpad(cast(e.user_id AS string), 8, '0'),
         lpad(cast(e.event_id % (1 + e.user_id % 12) AS string), 4, '0')) AS card_number,
  'Cust' AS sender_first_name, cast(e.user_id AS string) AS sender_last_name,
  concat('R', cast(e.s AS string)) AS receiver_first_name,
  cast(e.event_id % (1 + e.s % 40) AS string) AS receiver_last_name,
  e.event_type AS payment_format,
  CASE WHEN (e.value * 200 > 30000 AND e.event_id % 3 = 0) OR e.event_id % 97 = 0 THEN 1 ELSE 0 END AS label
FROM e JOIN customer c ON c.c_custkey = e.user_id
JOIN supplier s ON s.s_suppkey = e.s
JOIN iso i1 ON i1.k = c.c_nationkey JOIN iso i2 ON i2.k = s.s_nationkey
JOIN mcc m ON m.k = (e.event_id * 13 + cast(floor(e.value) AS bigint)) % 10)"""

NAMES = """
risky(code, name) AS (VALUES ('6012','Financial Institution Merchandise'),('7995','Gambling / Betting'),
  ('6211','Securities Dealers'),('5993','Cigar / Tobacco Stores'),('5912','Drug Stores / Pharmacies'),
  ('7801','Government-Licensed Casinos'),('6051','Non-Financial Institutions (Crypto/Currency)'),
  ('6010','Manual Cash Disbursements'),('4829','Wire Transfers / Money Orders'),
  ('7800','Government-Licensed Gambling'),('7802','State Lotteries')),
fatf(code, name) AS (VALUES ('IRN','Iran'),('PRK','North Korea'),('MMR','Myanmar'),('AFG','Afghanistan'),
  ('IRQ','Iraq'),('SYR','Syria'),('YEM','Yemen'),('LBY','Libya'),('SOM','Somalia'),('VEN','Venezuela'),
  ('NGA','Nigeria'),('PAK','Pakistan'),('HTI','Haiti'),('RUS','Russia'),('BLR','Belarus'),('CUB','Cuba'))"""

# One row per transaction with what every rule found.
RULED = (
    NAMES
    + """,
stats AS (SELECT avg(amount) AS mean, stddev_samp(amount) AS std FROM txn),
found AS (
SELECT t.*, r.name AS mcc_name, fs.name AS sender_fatf, fr.name AS receiver_fatf,
  t.sender_country <> t.receiver_country AS is_cross,
  fs.name IS NOT NULL OR fr.name IS NOT NULL AS is_fatf,
  count(*) OVER (PARTITION BY receiver_first_name, receiver_last_name) AS receiver_n,
  count(*) OVER (PARTITION BY card_number) AS card_n,
  (t.amount - stats.mean) / stats.std AS z
FROM txn t CROSS JOIN stats LEFT JOIN risky r ON r.code = t.mcc
LEFT JOIN fatf fs ON fs.code = t.sender_country LEFT JOIN fatf fr ON fr.code = t.receiver_country),
ruled AS (
SELECT found.*,
  CASE WHEN amount > 50000 THEN 25 WHEN amount > 10000 THEN 20 WHEN amount > 5000 THEN 10 ELSE 0 END AS p1,
  CASE WHEN amount > 50000 THEN 'Very Large Amount (>$50K)' WHEN amount > 10000 THEN 'Large Amount (>$10K)'
       WHEN amount > 5000 THEN 'Elevated Amount (>$5K)' END AS f1,
  CASE WHEN amount BETWEEN 9000 AND 9999 THEN 20 ELSE 0 END AS p2,
  CASE WHEN amount BETWEEN 9000 AND 9999 THEN 'Structuring Detected ($9K-$10K band)' END AS f2,
  CASE WHEN mcc_name IS NOT NULL THEN 20 ELSE 0 END AS p3,
  CASE WHEN mcc_name IS NOT NULL THEN concat('High-Risk MCC ', mcc, ' (', mcc_name, ')') END AS f3,
  CASE WHEN is_fatf AND is_cross THEN 30 WHEN is_fatf THEN 15 WHEN is_cross THEN 10 ELSE 0 END AS p4,
  CASE WHEN is_fatf THEN concat('FATF High-Risk Country (', coalesce(receiver_fatf, sender_fatf), ')')
       WHEN is_cross THEN 'Cross-Border Transaction' END AS f4,
  CASE WHEN amount % 1000 = 0 AND amount >= 5000 THEN 10
       WHEN amount % 500 = 0 AND amount >= 2000 THEN 5 ELSE 0 END AS p5,
  CASE WHEN amount % 1000 = 0 AND amount >= 5000 THEN 'Round Amount ($1,000 multiple)'
       WHEN amount % 500 = 0 AND amount >= 2000 THEN 'Round Amount ($500 multiple)' END AS f5,
  CASE WHEN receiver_n > 5 THEN 10 ELSE 0 END AS p6,
  CASE WHEN receiver_n > 5 THEN concat('High Receiver Velocity (', receiver_n, 'x same receiver)') END AS f6,
  CASE WHEN card_n > 10 THEN 5 ELSE 0 END AS p7,
  CASE WHEN card_n > 10 THEN concat('High Card Usage (', card_n, 'x same card)') END AS f7,
  CASE WHEN abs(z) > 2 THEN 15 ELSE 0 END AS p8,
  CASE WHEN abs(z) > 2 THEN concat('Statistical Anomaly (Z=', printf('%.2f', z), ')') END AS f8
FROM found)"""
)


def _scored(name: str, structuring: bool, high: int, medium: int) -> str:
    p2 = "p2" if structuring else "0"
    f2 = "f2" if structuring else "NULL"
    return f""",
{name}_sum AS (
SELECT ruled.*, least(100, p1 + {p2} + p3 + p4 + p5 + p6 + p7 + p8) AS score,
  concat_ws(' | ', f1, {f2}, f3, f4, f5, f6, f7, f8) AS flags,
  concat_ws(', ', CASE WHEN p1 >= 20 THEN concat('Large Amount +', p1) WHEN p1 > 0 THEN 'Elevated Amount +10' END,
    CASE WHEN {p2} > 0 THEN 'Structuring +20' END, CASE WHEN p3 > 0 THEN 'High-Risk MCC +20' END,
    CASE WHEN is_fatf THEN concat('FATF +', p4) WHEN is_cross THEN 'Cross-Border +10' END,
    CASE WHEN p5 > 0 THEN concat('Round Amount +', p5) END, CASE WHEN p6 > 0 THEN 'Receiver Velocity +10' END,
    CASE WHEN p7 > 0 THEN 'Card Velocity +5' END, CASE WHEN p8 > 0 THEN 'Z-Score Anomaly +15' END) AS parts
FROM ruled),
{name} AS (
SELECT s.*, CASE WHEN score >= {high} THEN 'HIGH' WHEN score >= {medium} THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN flags = '' THEN 'No flags' ELSE flags END AS flags_text,
  CASE WHEN parts = '' THEN 'No risk points scored' ELSE parts END AS breakdown_text,
  CASE WHEN round(z, 2) = 0 THEN 0.0 ELSE round(z, 2) END AS feature_zscore
FROM {name}_sum s)"""


V3 = TXN + "," + RULED + _scored("scored", True, 70, 40)
V2 = TXN + "," + RULED + _scored("scored", False, 61, 31)


def txn(body: str) -> str:
    return f"WITH {TXN}\n{body}"


def ruled(body: str) -> str:
    return f"WITH {TXN},{RULED}\n{body}"


def scored(body: str, more: str = "") -> str:
    return f"WITH {V3}{more}\n{body}"


_SCORED_COLUMNS = """txn_id, amount, sender_account, receiver_account, payment_format, label, score, risk_level,
  flags_text, breakdown_text, amount AS feature_amount, CAST(mcc_name IS NOT NULL AS int) AS feature_high_risk_mcc,
  CAST(is_cross AS int) AS feature_cross_border, CAST(is_fatf AS int) AS feature_fatf,
  CASE p5 WHEN 10 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS feature_round_amount, receiver_n AS feature_recv_velocity,
  card_n AS feature_card_velocity, feature_zscore"""

# Averages go through a decimal before rounding, so that halves are those of the decimal text.
def avg1(value: str) -> str:
    return f"CAST(round(CAST({value} AS decimal(28,8)), 1) AS double)"


def avg2(value: str) -> str:
    return f"CAST(round(CAST({value} AS decimal(28,8)), 2) AS double)"


ELEVATED = "coalesce(avg(CASE WHEN score >= 40 THEN score END), avg(score), 0)"


def _trend(period: str, label: str) -> str:
    return scored(
        f"""SELECT {label} AS label, score, high_count, avg_amount FROM (
SELECT {period} AS period, {avg1(ELEVATED)} AS score, count(*) FILTER (risk_level = 'HIGH') AS high_count,
  {avg2('avg(amount)')} AS avg_amount FROM scored WHERE ts IS NOT NULL GROUP BY 1)"""
    )


_CARD = """txn_id, concat('Row-', txn_id) AS reference, format('${:,.2f}', amount) AS amount, score, risk_level,
  flags_text, breakdown_text, feature_zscore,
  CAST(CASE WHEN flags_text = 'No flags' THEN 0 ELSE len(string_split(flags_text, '|')) END AS int) AS flag_count"""

_SHORT = "CASE WHEN length(flags_text) > 60 THEN concat(substr(flags_text, 1, 60), '...') ELSE flags_text END"

_ALERT_ID = "sha256(concat('batch-1-', txn_id))"

_ALERTS = f""",
alerts AS (SELECT {_ALERT_ID} AS alert_id, txn_id, ts, payment_format, concat('Row-', txn_id) AS reference, score,
  risk_level, flags_text FROM scored WHERE risk_level = 'HIGH'),
actions AS (
  SELECT alert_id, 'resolve' AS action, ts + INTERVAL 1 HOUR AS done_at, concat('checked ', txn_id) AS note
  FROM alerts WHERE payment_format IN ('purchase', 'signup')
  UNION ALL SELECT alert_id, 'escalate', ts + INTERVAL 2 HOUR, NULL
  FROM alerts WHERE payment_format IN ('error', 'signup')),
latest AS (SELECT alert_id, arg_max(action, done_at) AS last_action, max(done_at) FILTER (action = 'resolve') AS resolved_at,
  max(done_at) FILTER (action = 'escalate') AS escalated_at, arg_max(note, done_at) FILTER (action = 'resolve') AS resolution_note
  FROM actions GROUP BY 1),
state AS (SELECT a.*, CASE l.last_action WHEN 'resolve' THEN 'resolved' WHEN 'escalate' THEN 'escalated' ELSE 'open' END
  AS status, 'danger' AS severity, l.resolved_at, l.escalated_at, l.resolution_note
  FROM alerts a LEFT JOIN latest l USING (alert_id))"""

# Stand-ins for model outputs, computed the same way in both engines.
_PROB = "(txn_id * 37 % 1000) / 1000.0::double"
_RAW = "-(0.3::double + (txn_id * 53 % 700) / 1000.0::double)"


def _impact(k: int) -> str:
    return f"((txn_id * {k}) % 60) / 10.0::double - 2.0::double"


_STAND_INS = f""",
given AS (SELECT *, {_PROB} AS probability, {_RAW} AS anomaly_raw,
  {_impact(7)} AS i7, {_impact(11)} AS i11, {_impact(13)} AS i13 FROM scored),
rescaled AS (SELECT given.*, 1.0::double - (anomaly_raw - b.low) / (CASE WHEN b.high > b.low THEN b.high - b.low ELSE 1 END)
  AS anomaly FROM given CROSS JOIN (SELECT min(anomaly_raw) AS low, max(anomaly_raw) AS high FROM given) b),
modelled AS (SELECT *, least(greatest((0.30::double * anomaly + 0.70::double * probability) * 100, 0), 100) AS model
  FROM rescaled),
merged AS (SELECT *, CAST(round_even(least(greatest(0.60::double * score + 0.40::double * model, 0), 100), 0) AS int)
  AS final_score FROM modelled)"""

_ATTRIBUTIONS = """,
listed AS (
  SELECT txn_id, 0 AS pos, 'amount_usd' AS feature, 'Transaction Amount' AS label, i7 AS impact FROM merged
  UNION ALL SELECT txn_id, 1, 'is_new_payee', 'New / First-Time Payee', i11 FROM merged
  UNION ALL SELECT txn_id, 2, 'velocity_24hr', 'Account Velocity (24-hour)', i13 FROM merged),
placed AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(impact) DESC, pos) AS place FROM listed),
top3 AS (SELECT txn_id, place, feature, label, round(impact, 4) AS impact FROM placed
  WHERE place <= 3 AND abs(impact) > 0.001)"""

ORACLE: dict[str, str] = {
    "txn_canonical": txn(
        """SELECT txn_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, amount, sender_account, receiver_account,
  sender_country, receiver_country, mcc, merchant_name, card_number, sender_first_name, sender_last_name,
  receiver_first_name, receiver_last_name, payment_format, label FROM txn"""
    ),
    "mcc_normalise": txn(
        """SELECT txn_id, mcc AS plain, mcc AS with_fraction, mcc AS with_zero,
  concat('x', mcc) AS with_letter FROM txn"""
    ),
    "country_flags": (
        f"WITH {TXN},{NAMES}\n"
        """SELECT txn_id, sender_country AS sender, receiver_country AS receiver,
  sender_country <> receiver_country AS is_cross, fs.name IS NOT NULL AS sender_is_fatf,
  fr.name IS NOT NULL AS receiver_is_fatf, fr.name AS receiver_fatf_name, r.name AS mcc_name
FROM txn LEFT JOIN fatf fs ON fs.code = sender_country LEFT JOIN fatf fr ON fr.code = receiver_country
LEFT JOIN risky r ON r.code = mcc"""
    ),
    "display_fields": scored(
        f"""SELECT txn_id, concat(receiver_first_name, ' ', receiver_last_name, ' (', merchant_name, ')') AS receiver,
  concat(substr(card_number, 1, 4), 'XXXXXXXX', right(card_number, 4)) AS card,
  CAST(CASE WHEN flags_text = 'No flags' THEN 0 ELSE len(string_split(flags_text, '|')) END AS int) AS flag_count,
  {_SHORT} AS flags_short, format('${{:,.2f}}', amount) AS amount_text FROM scored"""
    ),
    "rule_amount": ruled("SELECT txn_id, p1 AS points, f1 AS flag FROM ruled"),
    "rule_structuring": ruled("SELECT txn_id, p2 AS points, f2 AS flag FROM ruled"),
    "rule_mcc": ruled("SELECT txn_id, p3 AS points, f3 AS flag FROM ruled"),
    "rule_geo": ruled("SELECT txn_id, p4 AS points, f4 AS flag FROM ruled"),
    "rule_round": ruled(
        "SELECT txn_id, p5 AS points, f5 AS flag, CASE p5 WHEN 10 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS value FROM ruled"
    ),
    "rule_receiver_freq": ruled("SELECT txn_id, receiver_n AS n, p6 AS points, f6 AS flag FROM ruled"),
    "rule_card_freq": ruled("SELECT txn_id, card_n AS n, p7 AS points, f7 AS flag FROM ruled"),
    "rule_zscore": ruled("SELECT txn_id, round(z, 6) AS z, p8 AS points, f8 AS flag FROM ruled"),
    "rules_v3": scored(
        f"SELECT {_SCORED_COLUMNS}, CAST(p2 > 0 AS int) AS feature_structuring FROM scored"
    ),
    "rules_v2": f"WITH {V2}\nSELECT {_SCORED_COLUMNS} FROM scored",
    "batch_stats": txn(
        "SELECT count(*) AS n, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 4) AS std FROM txn"
    ),
    "feat_amount": txn(
        """SELECT txn_id, amount AS amount_usd, round(least(greatest((amount - s.mean) / s.std, -5), 5), 6) AS amount_zscore,
  CAST(amount % 1000 = 0 AND amount >= 5000 AS int) AS is_round_1k,
  CAST(amount % 500 = 0 AND amount >= 2000 AND amount % 1000 <> 0 AS int) AS is_round_500,
  CAST(amount BETWEEN 9000 AND 9999 AS int) AS is_just_below_threshold
FROM txn CROSS JOIN (SELECT avg(amount) AS mean, stddev_samp(amount) AS std FROM txn) s"""
    ),
    "feat_time": txn(
        """SELECT txn_id, CAST(hour(ts) AS int) AS hour_of_day, CAST(isodow(ts) >= 6 AS int) AS is_weekend,
  CAST(hour(ts) >= 23 OR hour(ts) < 5 AS int) AS is_odd_hours FROM txn"""
    ),
    "feat_geo": (
        f"WITH {TXN},{NAMES}\n"
        """SELECT txn_id, CAST(sender_country <> receiver_country AS int) AS is_cross_border,
  CAST(sender_country IN (SELECT code FROM fatf) OR receiver_country IN (SELECT code FROM fatf) AS int)
  AS is_fatf_country FROM txn"""
    ),
    "feat_new_payee": txn(
        """SELECT txn_id, CAST(row_number() OVER (PARTITION BY sender_account, receiver_account ORDER BY ts, txn_id) = 1
  AS int) AS is_new_payee FROM txn"""
    ),
    "feat_payment_code": txn(
        """SELECT txn_id, CAST(dense_rank() OVER (ORDER BY payment_format) - 1 AS int) AS payment_format_encoded
FROM txn"""
    ),
    "feat_velocity": txn(
        """SELECT txn_id,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_1hr,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_6hr,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_24hr
FROM txn"""
    ),
    "kpis": scored(
        f"""SELECT count(*) AS total, count(*) FILTER (risk_level = 'HIGH') AS high,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low,
  {avg1(ELEVATED)} AS avg_score, count(*) FILTER (risk_level = 'HIGH') AS sar_candidates,
  {avg1("100.0::double * count(*) FILTER (risk_level = 'HIGH') / count(*)")} AS customer_risk_pct,
  {avg1("100.0::double * count(*) FILTER (risk_level <> 'LOW') / count(*)")} AS transaction_risk_pct,
  {avg1("100.0::double * count(*) FILTER (is_cross) / count(*)")} AS geographic_risk_pct,
  {avg1("100.0::double * count(*) FILTER (receiver_fatf IS NOT NULL) / count(*)")} AS fatf_pct,
  count(*) FILTER (is_cross) AS cross_border_count FROM scored"""
    ),
    "batch_kpis": scored(
        f"""SELECT count(*) AS total, count(*) FILTER (risk_level = 'HIGH') AS high,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low,
  {avg1('avg(score)')} AS avg_score, count(*) FILTER (risk_level = 'HIGH') AS sar_candidates,
  false AS model_available FROM scored"""
    ),
    "elevated_mean": scored(
        f"SELECT risk_level, round({ELEVATED}, 4) AS elevated_mean FROM scored GROUP BY risk_level"
    ),
    "level_summary": scored(
        f"""SELECT risk_level, count(*) AS count, {avg1('avg(score)')} AS avg_score, max(score) AS max_score,
  min(score) AS min_score FROM scored GROUP BY risk_level"""
    ),
    "histogram": scored(
        """SELECT concat(score // 10 * 10, '-', score // 10 * 10 + 10) AS range, score // 10 * 10 AS bucket_lo,
  count(*) AS count FROM scored GROUP BY score // 10"""
    ),
    "alert_feed": scored(
        """SELECT position, id, title, severity FROM (
SELECT 0 AS position, 'fatf' AS id,
  concat(count(*) FILTER (receiver_fatf IS NOT NULL), ' FATF high-risk jurisdiction transactions detected')
  AS title, 'danger' AS severity, count(*) FILTER (receiver_fatf IS NOT NULL) > 0 AS shown FROM scored
UNION ALL SELECT 1, 'sar', concat(count(*) FILTER (risk_level = 'HIGH'), ' SAR candidate(s) pending MLRO review'),
  'warning', count(*) FILTER (risk_level = 'HIGH') > 0 FROM scored
UNION ALL SELECT 2, 'anomaly', concat(count(*) FILTER (abs(feature_zscore) > 2),
  ' statistical anomalies detected (|Z|>2)'), 'warning', count(*) FILTER (abs(feature_zscore) > 2) > 0 FROM scored
UNION ALL SELECT 3, 'kyc', 'KYC Verification required for HIGH risk account holders', 'danger', true)
WHERE shown"""
    ),
    "trend_daily": _trend("CAST(ts AS date)", "strftime(period, '%Y-%m-%d')"),
    "trend_weekly": _trend("date_trunc('week', ts)", "concat('W/', strftime(period, '%m-%d'))"),
    "trend_monthly": _trend("date_trunc('month', ts)", "strftime(period, '%Y-%m')"),
    "trend_short": scored(
        f"""SELECT strftime(CAST(ts AS date), '%Y-%m-%d') AS day, {avg1(ELEVATED)} AS score
FROM scored GROUP BY CAST(ts AS date)"""
    ),
    "trend_view": scored(
        """SELECT span_days, CASE WHEN span_days >= 60 THEN 'monthly' WHEN span_days >= 14 THEN 'weekly' ELSE 'daily' END
  AS default_view FROM (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS span_days FROM scored)"""
    ),
    "trend_sequence": scored(
        f"""SELECT concat('Batch ', block + 1) AS label, {avg1(ELEVATED)} AS score,
  count(*) FILTER (risk_level = 'HIGH') AS high_count, {avg2('avg(amount)')} AS avg_amount FROM (
SELECT *, least(7, (row_number() OVER (ORDER BY txn_id) - 1) // greatest(1, count(*) OVER () // 8)) AS block FROM scored)
GROUP BY block"""
    ),
    "merchant_rollup": scored(
        f"""SELECT mcc, coalesce(any_value(mcc_name), 'Standard Merchant') AS description, count(*) AS count,
  any_value(mcc_name) IS NOT NULL AS is_high_risk, {avg1('avg(score)')} AS avg_score
FROM scored GROUP BY mcc ORDER BY count DESC, mcc LIMIT 12"""
    ),
    "country_rollup": scored(
        """SELECT receiver_country AS country, count(*) AS count, any_value(receiver_fatf) IS NOT NULL AS is_fatf
FROM scored GROUP BY receiver_country ORDER BY count DESC, country LIMIT 15"""
    ),
    "customer_profile": scored(
        """SELECT concat('Cust ', sender_last_name) AS customer, concat('Cust ', arg_min(sender_last_name, txn_id)) AS name,
  arg_min(sender_country, txn_id) AS country, arg_min(card_number, txn_id) AS card,
  arg_min(merchant_name, txn_id) AS employer, arg_min(mcc, txn_id) AS industry, max(score) AS risk_score,
  bool_or(is_fatf) AS has_fatf, count(*) FILTER (score >= 40) AS history_size, count(*) AS transactions,
  CASE WHEN max(score) >= 80 THEN 'Open' END AS case_status,
  strftime(min(ts) FILTER (score >= 80), '%Y-%m-%d') AS case_opened,
  CASE WHEN max(score) >= 80 THEN concat('Highest score ', max(score)) END AS case_description FROM scored GROUP BY sender_last_name"""
    ),
    "customer_history": scored(
        """SELECT concat('Cust ', sender_last_name) AS customer, txn_id, strftime(ts, '%Y-%m-%d') AS date,
  'Under Review' AS decision, score, flags_text FROM scored WHERE score >= 40"""
    ),
    "top_transactions": scored(
        """SELECT txn_id, concat('Row-', txn_id) AS reference, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_text,
  concat(receiver_first_name, ' ', receiver_last_name, ' (', merchant_name, ')') AS receiver, amount, score, risk_level,
  flags_text, breakdown_text, feature_zscore FROM scored"""
    ),
    "alert_cards_high": scored(
        f"SELECT {_CARD} FROM scored WHERE risk_level = 'HIGH'"
    ),
    "alert_cards_medium": scored(
        f"SELECT {_CARD} FROM scored WHERE risk_level = 'MEDIUM'"
    ),
    "anomalies": scored(
        """SELECT txn_id, concat('Row-', txn_id) AS reference, feature_zscore, score, substr(flags_text, 1, 80)
  AS flags_short, flags_text FROM scored WHERE abs(feature_zscore) > 2 ORDER BY abs(feature_zscore) DESC, txn_id LIMIT 20"""
    ),
    "fatf_listing": scored(
        """SELECT txn_id, receiver_country AS country, receiver_fatf AS country_name, format('${:,.2f}', amount) AS amount,
  score, risk_level, concat('Row-', txn_id) AS reference
FROM scored WHERE receiver_fatf IS NOT NULL"""
    ),
    "sar_candidates": scored(
        f"""SELECT txn_id, concat('Row-', txn_id) AS reference, score, feature_zscore,
  CAST(CASE WHEN flags_text = 'No flags' THEN 0 ELSE len(string_split(flags_text, '|')) END AS int) AS flag_count,
  {_SHORT} AS flags_short, flags_text, breakdown_text, amount, ts_text, row_number() OVER (ORDER BY txn_id) - 1 AS report_index
FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM scored) WHERE risk_level = 'HIGH'"""
    ),
    "network_edges": scored(
        """SELECT sender_account AS src, receiver_account AS dst, max(score) AS score FROM scored GROUP BY 1, 2
ORDER BY score DESC, src, dst LIMIT 25"""
    ),
    "network_nodes": scored(
        """SELECT id, substr(id, 1, 8) AS label, CASE WHEN max(score) >= 61 THEN 'high' WHEN max(score) >= 31 THEN 'medium'
  ELSE 'low' END AS risk FROM (
SELECT sender_account AS id, score FROM scored UNION ALL SELECT receiver_account, score FROM scored)
WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges) GROUP BY id""",
        """,
edges AS (SELECT sender_account AS src, receiver_account AS dst, max(score) AS score FROM scored GROUP BY 1, 2
  ORDER BY score DESC, src, dst LIMIT 25)""",
    ),
    "alerts_generated": scored(
        """SELECT alert_id, txn_id, reference, score, risk_level, flags_text, 'open' AS status, 'danger' AS severity
FROM alerts""",
        _ALERTS,
    ),
    "alerts_listing": scored(
        """SELECT alert_id, txn_id, score, status FROM state""",
        _ALERTS,
    ),
    "alerts_count": scored("SELECT count(*) AS total FROM state WHERE status = 'escalated'", _ALERTS),
    "alerts_after_actions": scored(
        """SELECT alert_id, txn_id, status, severity, strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at,
  resolution_note, strftime(escalated_at, '%Y-%m-%d %H:%M:%S') AS escalated_at FROM state""",
        _ALERTS,
    ),
    "export_views": scored(
        """SELECT v.name, CASE WHEN v.name <> 'training_data' THEN txn_id END AS txn_id, score, risk_level,
  amount AS feature_amount, CAST(is_fatf AS int) AS feature_fatf, receiver_n AS feature_recv_velocity, feature_zscore
FROM scored JOIN (VALUES ('all_transactions', NULL), ('high_risk', 'HIGH'), ('medium_risk', 'MEDIUM'),
  ('training_data', NULL)) v(name, level) ON v.level IS NULL OR v.level = risk_level"""
    ),
    "row_fields": scored(
        """SELECT txn_id, CASE WHEN txn_id % 10 <> 0 THEN amount END AS amount, CAST(score AS int) AS score,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, sender_account,
  CASE WHEN flags_text <> 'No flags' THEN string_split(flags_text, ' | ')[1] END AS first_flag FROM scored"""
    ),
    "alerts_fields": scored(
        """SELECT a.alert_id, s.amount, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts_text, s.receiver_country, s.risk_level,
  0::int AS attributions FROM alerts a JOIN scored s USING (txn_id)""",
        _ALERTS,
    ),
    "without_models": scored(
        """SELECT txn_id, CAST(score AS int) AS score, risk_level, 0::int AS attributions
FROM scored"""
    ),
    "model_store": scored(
        """SELECT 'late' AS model_version, positives + negatives AS dataset_rows, round(tp / predicted, 9) AS precision,
  round(tp / positives, 9) AS recall, round(2 * tp / (predicted + positives), 9) AS f1, false AS ready
FROM (SELECT (count(*) FILTER (probability >= 0.5 AND label = 1))::double AS tp,
  count(*) FILTER (probability >= 0.5) AS predicted, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 0) AS negatives FROM given)""",
        _STAND_INS,
    ),
    "forest_fixed": txn(
        """SELECT txn_id, round(-pow(2, -((CASE WHEN amount <= 10000 THEN 1.0::double WHEN amount <= 30000 THEN 2.5 ELSE 2.0 END
  + CASE WHEN sender_country = receiver_country THEN 1.0::double WHEN hour(ts) <= 12 THEN 2.0 ELSE 3.0 END) / 2)
  / (2 * (ln(7) + 0.5772156649015329::double) - 2 * 7 / 8.0::double)), 9) AS anomaly_raw FROM txn"""
    ),
    "gbt_residual": txn("SELECT count(*) AS n, 0::bigint AS off FROM txn"),
    "split_ratio": txn(
        """SELECT label, count(*) AS n, round(avg(CAST(('0x' || substr(md5(concat(txn_id, ':42')), 1, 8))::bigint
  / 4294967296.0::double < 0.2 AS double)), 4) AS test_share FROM txn GROUP BY label"""
    ),
    "lookup_txn": scored(
        "SELECT txn_id, score, risk_level, flags_text FROM scored WHERE txn_id = (SELECT max(txn_id) FROM txn)"
    ),
    "sar_context": scored("SELECT count(*) AS total, round(avg(score), 6) AS avg_score FROM scored"),
    "sar_facts": scored(
        f"""SELECT txn_id, concat('Row-', txn_id) AS reference, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date,
  format('${{:,.2f}}', amount) AS amount, merchant_name AS merchant, mcc,
  concat(substr(card_number, 1, 4), 'XXXXXXXX', right(card_number, 4)) AS card, sender_country, receiver_country,
  concat(receiver_first_name, ' ', receiver_last_name) AS receiver_name, score, risk_level, feature_zscore AS zscore,
  abs(feature_zscore) > 2 AS is_outlier, receiver_fatf IS NOT NULL AS receiver_is_fatf,
  mcc_name IS NOT NULL AS mcc_is_high_risk, coalesce(mcc_name, '') AS mcc_name,
  CAST(len(string_split(flags_text, '|')) AS int) AS flag_count, flags_text, breakdown_text, c.total AS batch_total,
  {avg1('c.avg_score')} AS batch_avg_score
FROM scored CROSS JOIN (SELECT count(*) AS total, avg(score) AS avg_score FROM scored) c WHERE risk_level = 'HIGH'"""
    ),
    "iso_rescale": scored("SELECT txn_id, round(anomaly, 9) AS anomaly FROM rescaled", _STAND_INS),
    "model_blend": scored("SELECT txn_id, round(model, 9) AS model FROM modelled", _STAND_INS),
    "rule_model_merge": scored(
        """SELECT txn_id, final_score, CASE WHEN final_score >= 70 THEN 'HIGH' WHEN final_score >= 40 THEN 'MEDIUM'
  ELSE 'LOW' END AS risk_level FROM merged""",
        _STAND_INS,
    ),
    "attribution_topn": scored(
        "SELECT txn_id, CAST(place - 1 AS int) AS place, feature, label, impact FROM top3", _STAND_INS + _ATTRIBUTIONS
    ),
    "attribution_penalty": scored(
        """SELECT txn_id, CAST(least(100, final_score + penalty) AS int) AS score,
  CASE WHEN least(100, final_score + penalty) >= 70 THEN 'HIGH' WHEN least(100, final_score + penalty) >= 40
    THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN reasons IS NULL THEN flags_text WHEN flags_text = 'No flags' THEN reasons
    ELSE concat(flags_text, ' | ', reasons) END AS flags_text,
  CASE WHEN penalty = 0 THEN breakdown_text WHEN breakdown_text = 'No risk points scored'
    THEN concat('ML Interpretability Penalty +', penalty)
    ELSE concat(breakdown_text, ', ML Interpretability Penalty +', penalty) END AS breakdown_text
FROM (SELECT m.*, coalesce(p.penalty, 0) AS penalty, p.reasons FROM merged m LEFT JOIN penalised p USING (txn_id))""",
        _STAND_INS
        + _ATTRIBUTIONS
        + """,
penalised AS (SELECT txn_id, least(40, sum(points)) AS penalty,
  string_agg(concat('AI Risk Indicator: ', label, ' (+', points, ' pts)'), ' | ' ORDER BY place) AS reasons FROM (
  SELECT *, least(30, CAST(trunc((impact - 1.0::double) * 15) AS int)) AS points FROM top3 WHERE impact >= 1.5)
  WHERE points > 0 GROUP BY txn_id)""",
    ),
    "weak_labels": scored(
        """SELECT txn_id, CAST(anomaly_raw < (SELECT quantile_cont(anomaly_raw, 0.02) FROM given) AS int) AS label
FROM given""",
        _STAND_INS,
    ),
    "classifier_metrics": scored(
        """SELECT round(tp / predicted, 9) AS precision, round(tp / positives, 9) AS recall,
  round(2 * tp / (predicted + positives), 9) AS f1, positives, negatives,
  round(negatives / positives, 9) AS positive_weight
FROM (SELECT (count(*) FILTER (probability >= 0.5 AND label = 1))::double AS tp,
  count(*) FILTER (probability >= 0.5) AS predicted, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 0) AS negatives FROM given)""",
        _STAND_INS,
    ),
}

ORACLE["feature_matrix"] = f"""WITH {TXN},{NAMES},
s AS (SELECT avg(amount) AS mean, stddev_samp(amount) AS std FROM txn)
SELECT txn_id, amount AS amount_usd, round(least(greatest((amount - s.mean) / s.std, -5), 5), 6) AS amount_zscore,
  CAST(amount % 1000 = 0 AND amount >= 5000 AS int) AS is_round_1k,
  CAST(amount % 500 = 0 AND amount >= 2000 AND amount % 1000 <> 0 AS int) AS is_round_500,
  CAST(amount BETWEEN 9000 AND 9999 AS int) AS is_just_below_threshold,
  CAST(hour(ts) AS int) AS hour_of_day, CAST(isodow(ts) >= 6 AS int) AS is_weekend,
  CAST(hour(ts) >= 23 OR hour(ts) < 5 AS int) AS is_odd_hours,
  CAST(sender_country <> receiver_country AS int) AS is_cross_border,
  CAST(sender_country IN (SELECT code FROM fatf) OR receiver_country IN (SELECT code FROM fatf) AS int) AS is_fatf_country,
  CAST(row_number() OVER (PARTITION BY sender_account, receiver_account ORDER BY ts, txn_id) = 1 AS int) AS is_new_payee,
  CAST(dense_rank() OVER (ORDER BY payment_format) - 1 AS int) AS payment_format_encoded,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_1hr,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_6hr,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_24hr,
  label
FROM txn CROSS JOIN s"""

FIXED_EDGES = {
    "amount_usd": [100, 500, 1000, 2000, 3000, 5000, 8000, 9000, 10000, 20000, 50000, 100000],
    "amount_zscore": [-0.9, -0.7, -0.5, -0.25, 0.05, 0.35, 0.75, 1.25, 2.15],
    "is_round_1k": [0], "is_round_500": [0], "is_just_below_threshold": [0], "hour_of_day": list(range(23)), "is_weekend": [0],
    "is_odd_hours": [0], "is_cross_border": [0], "is_fatf_country": [0], "is_new_payee": [0],
    "payment_format_encoded": list(range(10)), "velocity_1hr": [1, 2, 3, 5], "velocity_6hr": [1, 2, 3, 5, 8],
    "velocity_24hr": [1, 2, 3, 5, 8, 12],
}


def first_tree(depth: int = 3) -> str:
    """The first boosted tree, level by level: sums per (node, feature, bin), the best split of a node, its children."""
    cells = " UNION ALL ".join(
        f"SELECT txn_id, {i} AS feature, '{name}' AS name, len(list_filter({[float(e) for e in edges]}, lambda e: e < {name})) AS bin FROM f"
        for i, (name, edges) in enumerate(FIXED_EDGES.items())
    )
    thresholds = ", ".join(f"({i}, {b}, {float(e)!r}::DOUBLE)" for i, edges in enumerate(FIXED_EDGES.values()) for b, e in enumerate(edges))
    levels = []
    for k in range(depth):
        levels.append(
            f"""sums{k} AS (
  SELECT a.node, c.feature, c.name, c.bin, sum(r.g) AS g, sum(r.h) AS h
  FROM at{k} a JOIN r USING (txn_id) JOIN cells c USING (txn_id) GROUP BY ALL
), below{k} AS (
  SELECT *, sum(g) OVER up AS gl, sum(h) OVER up AS hl, sum(g) OVER every AS gt, sum(h) OVER every AS ht FROM sums{k}
  WINDOW up AS (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), every AS (PARTITION BY node, feature)
), gains{k} AS (
  SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain
  FROM below{k} WHERE hl >= 1 AND ht - hl >= 1
), best{k} AS (
  SELECT * FROM gains{k} WHERE gain > 1e-6
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) = 1
), at{k + 1} AS (
  SELECT a.txn_id, 2 * a.node + 1 + CAST(c.bin > b.bin AS int) AS node
  FROM at{k} a JOIN best{k} b ON b.node = a.node JOIN cells c ON c.txn_id = a.txn_id AND c.feature = b.feature
)"""
        )
    nodes = " UNION ALL ".join(f"SELECT node, sum(g) AS g, sum(h) AS h FROM at{k} JOIN r USING (txn_id) GROUP BY node" for k in range(depth + 1))
    best = " UNION ALL ".join(f"SELECT node, feature, name, bin, gain FROM best{k}" for k in range(depth))
    return f"""WITH f AS MATERIALIZED ({ORACLE["feature_matrix"]}),
r AS (SELECT txn_id, CASE label WHEN 1 THEN -4.0::DOUBLE ELSE 0.5::DOUBLE END AS g, CASE label WHEN 1 THEN 2.0::DOUBLE ELSE 0.25::DOUBLE END AS h FROM f),
cells AS MATERIALIZED ({cells}), thresholds(feature, bin, edge) AS (VALUES {thresholds}),
at0 AS (SELECT txn_id, 0 AS node FROM f), {", ".join(levels)}, nodes AS ({nodes}), best AS ({best})
SELECT n.node AS node_id, b.name AS feature, t.edge AS threshold, coalesce(b.gain, 0) AS gain, n.g AS gradient, n.h AS cover,
  CASE WHEN b.node IS NULL THEN -0.05::DOUBLE * n.g / (n.h + 1) ELSE 0 END AS value
FROM nodes n LEFT JOIN best b USING (node) LEFT JOIN thresholds t ON t.feature = b.feature AND t.bin = b.bin"""


ORACLE["gbt_first_tree"] = first_tree()

ORACLE["stream_scoring"] = ORACLE["rules_v3"]
ORACLE["stream_velocity"] = txn(
    """SELECT txn_id,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_1hr,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_6hr,
  count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS velocity_24hr,
  CAST(row_number() OVER (PARTITION BY sender_account, receiver_account ORDER BY ts, txn_id) = 1 AS int) AS is_new_payee
FROM txn"""
)

_FACTS = ORACLE["sar_facts"].removeprefix(f"WITH {V3}")


ORACLE["sar_texts"] = f"""WITH {V3},
facts AS ({_FACTS}),
now AS (SELECT max(ts) AS at FROM txn),
findings AS (SELECT txn_id, string_agg(concat(i, '. ', item), chr(10) ORDER BY i) AS listed FROM (
  SELECT txn_id, unnest(string_split(flags_text, ' | ')) AS item, unnest(range(1, len(string_split(flags_text, ' | ')) + 1)) AS i
  FROM facts) GROUP BY txn_id),
parts AS (SELECT txn_id, string_agg(concat(i, '. ', item), chr(10) ORDER BY i) AS listed FROM (
  SELECT txn_id, unnest(string_split(breakdown_text, ', ')) AS item, unnest(range(1, len(string_split(breakdown_text, ', ')) + 1)) AS i
  FROM facts) GROUP BY txn_id)
SELECT f.txn_id, reference, concat_ws(chr(10),
  concat('Draft SAR-', strftime(now.at, '%Y%m%d'), '-', substr(reference, 1, 10), ' of ', strftime(now.at, '%Y-%m-%d %H:%M:%S')),
  concat('Transaction ', reference, ', ', date, ', ', amount), concat('Route: ', sender_country, ' to ', receiver_country),
  concat('Payee: ', receiver_name, '; card ', card), concat('Merchant: ', merchant, '; code ', mcc),
  concat('Score: ', score, ' (', risk_level, '); mean ', printf('%.1f', batch_avg_score), ' of ', batch_total, ' rows'),
  concat('Found', chr(10), findings.listed), concat('Points', chr(10), parts.listed),
  CASE WHEN is_outlier THEN concat('Amount: ', printf('%.2f', zscore), ' standard deviations from the mean of the rows') END,
  CASE WHEN receiver_is_fatf THEN 'Payee country: on the list of high-risk countries' END,
  CASE WHEN mcc_is_high_risk THEN concat('Merchant code: on the high-risk list, ', mcc_name) END) AS report
FROM facts f CROSS JOIN now JOIN findings USING (txn_id) JOIN parts USING (txn_id)"""

ORACLE["scored_table"] = ORACLE["rules_v3"]
ORACLE["source_labelled_csv"] = txn(
    """SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, amount, sender_account, receiver_account, sender_country,
  receiver_country, payment_format, label FROM txn"""
)
ORACLE["source_sheet_csv"] = txn(
    """SELECT CAST(txn_id AS varchar) AS reference, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text,
  CASE WHEN payment_format <> 'signup' THEN amount END AS amount, concat(mcc, '.0') AS mcc,
  CASE WHEN payment_format IN ('error', 'click', 'view') THEN '' ELSE merchant_name END AS merchant_name FROM txn"""
)
ORACLE["source_json"] = txn(
    """SELECT CAST(txn_id AS varchar) AS reference, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, amount, mcc,
  sender_account, sender_country, receiver_country, '' AS receiver_account FROM txn"""
)


VELOCITIES = ", ".join(
    f"""count(*) OVER (PARTITION BY sender_account ORDER BY ts
    RANGE BETWEEN INTERVAL '{hours * 3600 * 1000000 - 1} microseconds' PRECEDING AND CURRENT ROW) AS velocity_{hours}hr"""
    for hours in (1, 6, 24)
)
ORACLE["stream_state_velocity"] = txn(f"SELECT txn_id, {VELOCITIES} FROM txn")
ORACLE["stream_state_late"] = f"""WITH {TXN},
passed AS (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 AS us FROM txn WHERE txn_id % 50 <> 0),
known AS (SELECT txn.*, txn_id % 50 = 0 AND epoch_us(ts) <= passed.us AS late FROM txn, passed)
SELECT txn_id, late, {VELOCITIES} FROM known WHERE NOT late
UNION ALL SELECT txn_id, late, NULL, NULL, NULL FROM known WHERE late"""

# The same rules, with statistics and frequencies of the deliveries before a row's own.
_BEFORE = "t.txn_id % 4 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
ROLLING = (
    RULED.replace(
        "stats AS (SELECT avg(amount) AS mean, stddev_samp(amount) AS std FROM txn)",
        "stats AS (SELECT d.d AS d, avg(amount) AS mean, stddev_samp(amount) AS std FROM range(4) d(d) LEFT JOIN txn ON txn_id % 4 < d.d GROUP BY d.d)",
    )
    .replace("PARTITION BY receiver_first_name, receiver_last_name)", f"PARTITION BY receiver_first_name, receiver_last_name ORDER BY {_BEFORE})")
    .replace("PARTITION BY card_number)", f"PARTITION BY card_number ORDER BY {_BEFORE})")
    .replace("FROM txn t CROSS JOIN stats", "FROM txn t JOIN stats ON stats.d = t.txn_id % 4")
)
ORACLE["stream_scoring_rolling"] = f"""WITH {TXN},{ROLLING}{_scored("scored", True, 70, 40)}
SELECT {_SCORED_COLUMNS.replace("feature_zscore", "coalesce(feature_zscore, 0.0) AS feature_zscore")},
  CAST(p2 > 0 AS int) AS feature_structuring FROM scored"""

ORACLE["stream_hybrid"] = scored(
    """SELECT txn_id, score, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  round(model, 6) AS model_score FROM final""",
    """,
walked AS (SELECT txn_id, score AS rules,
  -pow(2, -((CASE WHEN amount <= 10000 THEN 1.0::double WHEN amount <= 30000 THEN 2.5 ELSE 2.0 END
    + CASE WHEN sender_country = receiver_country THEN 1.0::double WHEN hour(ts) <= 12 THEN 2.0 ELSE 3.0 END) / 2)
    / (2 * (ln(7) + 0.5772156649015329::double) - 2 * 7 / 8.0::double)) AS raw,
  1 / (1 + exp(-(-1.0::double + CASE WHEN amount <= 10000 THEN -0.5 WHEN sender_country = receiver_country THEN 0.25 ELSE 1.5 END
    + CASE WHEN hour(ts) <= 12 THEN 0.3 ELSE -0.2 END))) AS probability FROM scored),
blended AS (SELECT *, least(greatest((0.30::double * least(greatest(1 - (raw + 0.8::double) / 0.4::double, 0), 1)
  + 0.70::double * probability) * 100, 0), 100) AS model FROM walked),
final AS (SELECT *, CAST(round_even(least(greatest(0.60::double * rules + 0.40::double * model, 0), 100), 0) AS int) AS score FROM blended)""",
)

ORACLE["lookup_by_key"] = scored(
    """SELECT how, txn_id, concat('Row-', txn_id) AS reference, sender_account, score, risk_level, flags_text
FROM scored JOIN (SELECT min(txn_id) AS low, max(txn_id) AS high, max_by(sender_account, txn_id) AS account FROM txn) k ON TRUE
JOIN (VALUES ('id'), ('reference'), ('account')) w(how) ON CASE how WHEN 'id' THEN txn_id = high
  WHEN 'reference' THEN txn_id = low ELSE sender_account = account END"""
)


def _view(name: str, query: str, label: str, **values: str) -> str:
    kinds = {"n": "BIGINT", "score": "DOUBLE", "high_count": "BIGINT", "avg_amount": "DOUBLE"}
    cells = ", ".join(f"CAST({values.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in kinds.items())
    return f"SELECT '{name}' AS view, {label} AS label, {cells} FROM ({ORACLE[query]})"


ORACLE["rollup_states"] = " UNION ALL ".join(
    [
        *(_view(t, t, "label", score="score", high_count="high_count", avg_amount="avg_amount") for t in ("trend_daily", "trend_weekly", "trend_monthly")),
        _view("kpis", "kpis", "'all'", n="total", score="avg_score", high_count="high"),
        _view("border", "kpis", "'all'", n="cross_border_count", score="fatf_pct"),
        _view("histogram", "histogram", '"range"', n='"count"'),
        _view("level_summary", "level_summary", "risk_level", n='"count"', score="avg_score", high_count="max_score"),
        _view("merchant_rollup", "merchant_rollup", "mcc", n='"count"', score="avg_score"),
        _view("country_rollup", "country_rollup", "country", n='"count"'),
    ]
)

ORACLE["alerts_incremental"] = ORACLE["alerts_after_actions"]

ORACLE["source_rejects"] = txn(
    """SELECT source, reason, txn_id FROM txn JOIN (VALUES ('csv', 1, 'no amount'), ('csv', 2, 'amount does not parse'),
  ('csv', 3, 'number of values'), ('csv', 4, 'number of values'), ('json', 5, 'no amount'), ('json', 6, 'not JSON or of other types'),
  ('stream', 5, 'no amount'), ('stream', 6, 'not JSON or of other types')) v(source, kind, reason) ON txn_id % 20 = kind"""
)
