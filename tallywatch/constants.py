"""Fixed values of the scoring contract: lookup tables, thresholds, weights and texts."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Merchant category codes that count as high risk.
HIGH_RISK_MCC = {
    "6012": "Financial Institution Merchandise",
    "7995": "Gambling / Betting",
    "6211": "Securities Dealers",
    "5993": "Cigar / Tobacco Stores",
    "5912": "Drug Stores / Pharmacies",
    "7801": "Government-Licensed Casinos",
    "6051": "Non-Financial Institutions (Crypto/Currency)",
    "6010": "Manual Cash Disbursements",
    "4829": "Wire Transfers / Money Orders",
    "7800": "Government-Licensed Gambling",
    "7802": "State Lotteries",
}

# FATF high-risk jurisdictions (ISO alpha-3 code, display name).
FATF_COUNTRIES = {
    "IRN": "Iran",
    "PRK": "North Korea",
    "MMR": "Myanmar",
    "AFG": "Afghanistan",
    "IRQ": "Iraq",
    "SYR": "Syria",
    "YEM": "Yemen",
    "LBY": "Libya",
    "SOM": "Somalia",
    "VEN": "Venezuela",
    "NGA": "Nigeria",
    "PAK": "Pakistan",
    "HTI": "Haiti",
    "RUS": "Russia",
    "BLR": "Belarus",
    "CUB": "Cuba",
}

# Display names of model features.
FEATURE_LABELS = {
    "amount_usd": "Transaction Amount",
    "amount_zscore": "Z-Score Anomaly",
    "is_round_1k": "Round Amount ($1K multiple)",
    "is_round_500": "Round Amount ($500 multiple)",
    "is_just_below_threshold": "Structuring (just-below $10K)",
    "is_high_risk_mcc": "High-Risk MCC",
    "is_cross_border": "Cross-Border Transaction",
    "is_fatf_country": "FATF High-Risk Jurisdiction",
    "velocity_1hr": "Account Velocity (1-hour)",
    "velocity_6hr": "Account Velocity (6-hour)",
    "velocity_24hr": "Account Velocity (24-hour)",
    "receiver_velocity": "Receiver Velocity",
    "card_velocity": "Card-Number Velocity",
    "hour_of_day": "Hour of Day",
    "is_weekend": "Weekend Transaction",
    "is_odd_hours": "Odd-Hours Transaction (11pm-5am)",
    "is_new_payee": "New / First-Time Payee",
    "payment_format_encoded": "Payment Format",
}

# Model input columns, in model order.
FEATURE_COLUMNS = [
    "amount_usd",
    "amount_zscore",
    "is_round_1k",
    "is_round_500",
    "is_just_below_threshold",
    "hour_of_day",
    "is_weekend",
    "is_odd_hours",
    "is_cross_border",
    "is_fatf_country",
    "is_new_payee",
    "payment_format_encoded",
    "velocity_1hr",
    "velocity_6hr",
    "velocity_24hr",
]

# Trailing ranges of the velocity features, in hours.
VELOCITY_HOURS = {"velocity_1hr": 1, "velocity_6hr": 6, "velocity_24hr": 24}

# Rule thresholds and points.
AMOUNT_TIERS = [  # (strictly above, points, flag, breakdown label)
    (50_000, 25, "Very Large Amount (>$50K)", "Large Amount"),
    (10_000, 20, "Large Amount (>$10K)", "Large Amount"),
    (5_000, 10, "Elevated Amount (>$5K)", "Elevated Amount"),
]
STRUCTURING_LOW, STRUCTURING_HIGH, STRUCTURING_POINTS = 9_000, 9_999, 20
MCC_POINTS = 20
CROSS_BORDER_POINTS, FATF_POINTS, FATF_CROSS_POINTS, GEO_CAP = 10, 15, 5, 30
ROUND_TIERS = [  # (multiple of, at least, points, feature value, flag)
    (1_000, 5_000, 10, 2, "Round Amount ($1,000 multiple)"),
    (500, 2_000, 5, 1, "Round Amount ($500 multiple)"),
]
RECEIVER_LIMIT, RECEIVER_POINTS = 5, 10
CARD_LIMIT, CARD_POINTS = 10, 5
ZSCORE_LIMIT, ZSCORE_POINTS = 2, 15
SCORE_CAP = 100
NO_FLAGS, NO_PARTS = "No flags", "No risk points scored"
FLAG_SEPARATOR, PART_SEPARATOR = " | ", ", "

# Roll-up thresholds and list lengths.
ELEVATED_SCORE = 40
CASE_SCORE = 80
NODE_HIGH, NODE_MEDIUM = 61, 31
MONTHLY_SPAN_DAYS, WEEKLY_SPAN_DAYS = 60, 14
SEQUENCE_BLOCKS = 8
ANOMALY_ROWS = 20
MERCHANT_ROWS, COUNTRY_ROWS, EDGE_ROWS = 12, 15, 25

# The most listed edges whose nodes are broadcast.
BROADCAST_EDGES = 10_000

# Model blend and attribution penalty.
ANOMALY_WEIGHT, CLASSIFIER_WEIGHT = 0.30, 0.70
RULE_WEIGHT, MODEL_WEIGHT = 0.60, 0.40
PENALTY_MIN_IMPACT, PENALTY_SLOPE, PENALTY_EACH, PENALTY_TOTAL = 1.5, 15, 30, 40
MIN_IMPACT, TOP_ATTRIBUTIONS = 0.001, 3

# Training parameters.
BOOST_ROUNDS, BOOST_DEPTH, BOOST_DEPTH_WEAK, BOOST_RATE = 200, 6, 5, 0.05
FOREST_TREES, FOREST_ROWS_PER_TREE = 100, 25_600
BOOST_BINS = 256  # a code is one byte
# Rows of which one task grows whole trees; trees between two refreshes of the margins, and between checkpoints of them.
BOOST_LOCAL_ROWS, BOOST_REFRESH, BOOST_CHECKPOINT = 131_072, 5, 50
HOLDOUT_SHARE, SPLIT_SEED, WEAK_LABEL_SHARE = 0.2, 42, 0.02
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleProfile:
    """One published set of rules: level thresholds and whether structuring counts."""

    name: str
    high: int
    medium: int
    structuring: bool


V2 = RuleProfile("v2", high=61, medium=31, structuring=False)
V3 = RuleProfile("v3", high=70, medium=40, structuring=True)
PROFILES = {p.name: p for p in (V2, V3)}
