"""Names, lists, thresholds and weights that define the results.

Everything in this module is data, stated in its natural order. The operators
fold it into column expressions.
"""

HOUR = 3_600_000_000
DAY = 24 * HOUR

# --- fixed values: registry order of the feature vectors -------------------
FRAUD_FEATURES = [
    "avg_transaction_amount_7d",
    "transaction_velocity_1h",
    "transaction_velocity_24h",
    "failed_login_attempts_24h",
    "account_age_days",
    "historical_fraud_flag",
    "device_risk_score",
    "device_fraud_count",
    "distinct_user_count",
    "amount",
    "geo_distance_from_last_tx",
    "time_of_day",
    "currency_risk",
]
AML_FEATURES = [
    "amount",
    "velocity_1h",
    "velocity_24h",
    "total_volume_24h",
    "avg_amount_30d",
    "std_amount_30d",
    "time_of_day",
    "is_cross_border",
    "account_age_days",
    "device_count_30d",
    "ip_count_30d",
    "new_device_flag",
    "kyc_completeness_score",
    "network_risk_score",
    "circular_transfer_flag",
    "shared_device_cluster_size",
    "high_risk_country_flag",
    "sanctions_proximity_score",
    "ip_country_mismatch",
    "historical_structuring_flag",
    "structuring_score_24h",
    "rapid_drain_flag",
]
MERCHANT_FEATURES = [
    "transaction_count_1h",
    "transaction_count_24h",
    "transaction_volume_24h",
    "unique_customers_24h",
    "avg_transaction_amount_30d",
    "std_transaction_amount_30d",
    "chargeback_rate_90d",
    "refund_rate_90d",
    "account_age_days",
    "fraud_transaction_rate",
    "high_risk_customer_ratio",
    "cross_border_ratio",
    "velocity_spike_flag",
    "mcc_risk_score",
    "avg_customer_risk_score",
]
REGISTRY = {"fraud": FRAUD_FEATURES, "aml": AML_FEATURES, "merchant": MERCHANT_FEATURES}
REGISTRY_VERSION = "1.0.0"

# --- fixed values: value used where a feature has no source ------------------
VECTOR_DEFAULTS = {
    "fraud": {"account_age_days": 365.0, "device_risk_score": 0.1, "distinct_user_count": 1.0},
    "aml": {"account_age_days": 365.0, "kyc_completeness_score": 1.0},
    "merchant": {},
}

# --- fixed values: population priors, registry order -------------------------
PRIOR_DEFAULTS = {
    "fraud": [50, 1, 5, 0, 90, 0, 0.1, 0, 1, 50, 0, 12, 0],
    "aml": [100, 1, 3, 300, 100, 50, 12, 0, 90, 1, 2, 0, 0.7, 0.1, 0, 1, 0, 0, 0, 0, 0, 0],
    "merchant": [5, 50, 5000, 20, 100, 50, 0.01, 0.03, 180, 0.005, 0.05, 0.1, 0, 0.1, 0.1],
}

# --- fixed values: currency and country lists --------------------------------
HIGH_RISK_CURRENCIES = ["IRR", "KPW", "SYP", "VEF", "ZWD", "SDG", "MMK", "CUP"]
MEDIUM_RISK_CURRENCIES = ["NGN", "GHS", "TZS", "UGX", "ETB"]
HIGH_RISK_COUNTRIES = [
    "IR", "KP", "MM", "SY", "YE", "AF", "PK", "NG", "AL", "BB", "BF", "CM", "CD", "GH", "HT", "JM", "JO", "ML", "MZ", "PA", "PH", "SN", "SS", "TZ", "TR", "UG",
    "VN", "ZA",
]
SANCTIONED_OVERRIDE = ["IR", "KP", "SY", "CU"]
SANCTIONED_PROXIMITY = ["IR", "KP", "SY", "CU", "VE"]
AML_BUMP_COUNTRIES = ["IR", "KP", "SY", "AF", "YE"]

# --- fixed values: decision thresholds ---------------------------------------
FRAUD_THRESHOLDS = {"approve": 0.60, "review": 0.75, "block": 0.90}
AML_THRESHOLDS = {"medium": 0.50, "high": 0.70, "critical": 0.85}
MERCHANT_THRESHOLDS = {"enhanced": 0.40, "restricted": 0.65, "blocked": 0.85}
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
DECISIONS = ["APPROVE", "MONITOR", "REVIEW", "BLOCK"]

# --- fixed values: heuristic feature weights (importance report) -------------
HEURISTIC_WEIGHTS = {
    "fraud": {
        "avg_transaction_amount_7d": 0.0, "transaction_velocity_1h": 0.15, "transaction_velocity_24h": 0.08,
        "failed_login_attempts_24h": 0.10, "account_age_days": 0.10, "historical_fraud_flag": 0.20,
        "device_risk_score": 0.12, "device_fraud_count": 0.10, "distinct_user_count": 0.05, "amount": 0.10,
        "geo_distance_from_last_tx": 0.08, "time_of_day": 0.04, "currency_risk": 0.08,
    },
    "aml": {
        "amount": 0.05, "velocity_1h": 0.10, "velocity_24h": 0.06, "total_volume_24h": 0.08,
        "avg_amount_30d": 0.0, "std_amount_30d": 0.04, "time_of_day": 0.02, "is_cross_border": 0.08,
        "account_age_days": 0.05, "device_count_30d": 0.04, "ip_count_30d": 0.04, "new_device_flag": 0.06,
        "kyc_completeness_score": 0.08, "network_risk_score": 0.10, "circular_transfer_flag": 0.15,
        "shared_device_cluster_size": 0.06, "high_risk_country_flag": 0.15, "sanctions_proximity_score": 0.18,
        "ip_country_mismatch": 0.08, "historical_structuring_flag": 0.12, "structuring_score_24h": 0.14,
        "rapid_drain_flag": 0.12,
    },
    "merchant": {
        "transaction_count_1h": 0.06, "transaction_count_24h": 0.04, "transaction_volume_24h": 0.06,
        "unique_customers_24h": 0.04, "avg_transaction_amount_30d": 0.0, "std_transaction_amount_30d": 0.05,
        "chargeback_rate_90d": 0.20, "refund_rate_90d": 0.10, "account_age_days": 0.08,
        "fraud_transaction_rate": 0.18, "high_risk_customer_ratio": 0.10, "cross_border_ratio": 0.06,
        "velocity_spike_flag": 0.10, "mcc_risk_score": 0.08, "avg_customer_risk_score": 0.08,
    },
}

# --- fixed values: heuristic base scores and mean-amount fallbacks --------------
FRAUD_BASE = 0.10
FRAUD_AVG_FALLBACK = 100.0
AML_BASE = 0.08
AML_AVG_FALLBACK = 200.0
MERCHANT_BASE = 0.10
MERCHANT_AVG_FALLBACK = 100.0

# --- fixed values: active learning ---------------------------------------------
AL_THRESHOLDS = {"fraud": [0.3, 0.7, 0.9], "aml": [0.4, 0.7, 0.85], "merchant": [0.3, 0.6, 0.85]}
AL_CONFIG = {
    "fraud": ("DISAGREEMENT", 100, 500),
    "aml": ("UNCERTAINTY", 80, 400),
    "merchant": ("ENTROPY", 50, 250),
}

# --- fixed values: maturity ------------------------------------------------------
EXPECTED_RATES = {"fraud": (0.01, 0.10), "aml": (0.005, 0.08), "merchant": (0.01, 0.10)}
MATURITY_ALPHA = {"COLD": 0.0, "WARMING": 0.3, "WARM": 0.7, "HOT": 1.0}
MATURITY_FLOOR = {"COLD": 0.1, "WARMING": 0.3, "WARM": 0.6, "HOT": 0.8}

# --- fixed values: label transfer between domains (source, target, decay) --------
TRANSFER_RULES = [
    ("fraud", "aml", 0.8),
    ("fraud", "merchant", 0.6),
    ("aml", "merchant", 0.7),
    ("merchant", "fraud", 0.5),
]

# --- fixed values: feature views for co-training ----------------------------------
FEATURE_VIEWS = {
    "fraud": {
        "transaction_view": ["amount", "geo_distance_from_last_tx", "time_of_day", "currency_risk"],
        "user_view": ["avg_transaction_amount_7d", "transaction_velocity_1h", "transaction_velocity_24h", "failed_login_attempts_24h", "account_age_days", "historical_fraud_flag"],
        "device_view": ["device_risk_score", "device_fraud_count", "distinct_user_count"],
    },
    "aml": {
        "transaction_view": ["amount", "velocity_1h", "velocity_24h", "total_volume_24h", "avg_amount_30d", "std_amount_30d", "time_of_day", "is_cross_border"],
        "entity_view": ["account_age_days", "device_count_30d", "ip_count_30d", "new_device_flag", "kyc_completeness_score"],
        "network_view": ["network_risk_score", "circular_transfer_flag", "shared_device_cluster_size", "high_risk_country_flag", "sanctions_proximity_score", "ip_country_mismatch", "historical_structuring_flag", "structuring_score_24h", "rapid_drain_flag"],
    },
    "merchant": {
        "velocity_view": ["transaction_count_1h", "transaction_count_24h", "transaction_volume_24h", "unique_customers_24h"],
        "aggregate_view": ["avg_transaction_amount_30d", "std_transaction_amount_30d", "chargeback_rate_90d", "refund_rate_90d", "account_age_days"],
        "risk_view": ["fraud_transaction_rate", "high_risk_customer_ratio", "cross_border_ratio", "velocity_spike_flag", "mcc_risk_score", "avg_customer_risk_score"],
    },
}

# --- fixed values: training defaults (trees, depth, rate, positive weight) --------
TRAINING = {"fraud": (500, 8, 0.05, 10.0), "aml": (600, 8, 0.03, 15.0), "merchant": (400, 7, 0.05, 12.0)}
CONTAMINATION = {"fraud": 0.05, "aml": 0.03, "merchant": 0.04}

# --- fixed values: alert channels ---------------------------------------------------
ALERT_CHANNELS = {"CRITICAL": ["SLACK", "PAGERDUTY", "KAFKA"], "WARNING": ["SLACK", "KAFKA"]}
ALERT_CHANNELS_OTHER = ["KAFKA"]
