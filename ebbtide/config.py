"""Configuration of the retention model (a frozen dataclass, passed to operators)."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference application's defaults for the
# results to agree; they are stated here as plain data, in their natural order.
# ---------------------------------------------------------------------------

FEATURE_COLUMNS = (
    "tenure_months", "monthly_charges", "total_charges", "contract_type",
    "internet_service", "payment_method", "region", "support_tickets",
    "payment_delays", "product_usage", "complaint_count", "customer_satisfaction_score",
)
NUMERIC_FEATURES = (
    "tenure_months", "monthly_charges", "total_charges", "support_tickets",
    "payment_delays", "product_usage", "complaint_count", "customer_satisfaction_score",
)
CATEGORICAL_FEATURES = ("contract_type", "internet_service", "payment_method", "region")
REQUIRED_COLUMNS = ("customer_id",) + FEATURE_COLUMNS
DEFAULT_VALUES = {
    "contract_type": "unknown",
    "internet_service": "unknown",
    "payment_method": "unknown",
    "region": "unknown",
}
RETENTION_ACTIONS = {
    "high_risk": "Call customer within 24 hours and offer a retention incentive",
    "low_risk": "Maintain regular engagement and service review",
}
DEFAULT_ACTION = "Review customer engagement"

# Column aliases used when a churn-like file is normalised (exact, case-sensitive).
COLUMN_ALIASES = {
    "customer_id": ["customer_id", "id", "customer", "client_id"],
    "tenure_months": ["tenure_months", "tenure", "tenure_month", "tenure_in_months"],
    "monthly_charges": ["monthly_charges", "monthly_charge", "monthly_fee", "monthly_cost"],
    "total_charges": ["total_charges", "total_charge", "total_spend", "lifetime_value"],
    "contract_type": ["contract_type", "contract", "subscription_type", "plan"],
    "internet_service": ["internet_service", "internet", "service_type", "connection_type"],
    "payment_method": ["payment_method", "payment", "billing_method", "payment_type"],
    "region": ["region", "territory", "area", "location"],
    "support_tickets": ["support_tickets", "support_calls", "tickets", "service_tickets"],
    "payment_delays": ["payment_delays", "late_payments", "delayed_payments", "billing_delays"],
    "product_usage": ["product_usage", "usage", "feature_usage", "activity_score"],
    "complaint_count": ["complaint_count", "complaints", "complaint_total", "issue_count"],
    "customer_satisfaction_score": ["customer_satisfaction_score", "satisfaction", "csat", "satisfaction_score"],
}
TARGET_ALIASES = ["churned", "churn", "attrition", "is_churned", "label", "status", "outcome"]

# Target vocabulary for the model-side encoder.
TARGET_VOCABULARY = {
    "1": 1, "true": 1, "yes": 1, "y": 1, "churned": 1, "churn": 1, "attrited": 1,
    "retained": 0, "no": 0, "false": 0, "0": 0, "n": 0, "inactive": 1, "active": 0,
}
# Upload-time id and target detection.
ID_COLUMN_NAMES = ["customer_id", "customerid", "id", "cust_id", "account_id", "accountid"]
TARGET_COLUMN_NAMES = ["churn", "churned", "churn_label", "attrition", "left", "exited",
                       "cancelled", "status", "class", "target"]
ACTIVE_COLUMN_NAMES = ["active", "is_active", "status_active"]
TRUTHY_TARGET_VALUES = ["1", "true", "yes", "churned", "churn", "exited", "left", "cancelled"]
TRUTHY_ACTIVE_VALUES = ["1", "true", "yes", "active"]
# Markers that make a file "churn-like" (I7); three or more must be present.
CHURN_MARKER_COLUMNS = ["tenure_months", "monthly_charges", "contract_type", "region",
                        "support_tickets", "customer_satisfaction_score", "churned"]
# Id aliases for arbitrary datasets (I16).
ARBITRARY_ID_ALIASES = ["id", "client_id", "customer"]
# Currency rates relative to USD.
CURRENCY_RATES = {"USD": 1.0, "EUR": 0.92, "GBP": 0.78, "INR": 83.5, "JPY": 158.0}
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥"}


@dataclass(frozen=True)
class RetentionConfig:
    company_name: str = "Example Company"
    target_column: str = "churned"
    risk_threshold: float = 0.6
    feature_columns: tuple = FEATURE_COLUMNS
    numeric_features: tuple = NUMERIC_FEATURES
    categorical_features: tuple = CATEGORICAL_FEATURES
    required_columns: tuple = REQUIRED_COLUMNS
    high_label: str = "high_risk"
    low_label: str = "low_risk"
    default_values: dict = field(default_factory=lambda: dict(DEFAULT_VALUES))
    retention_actions: dict = field(default_factory=lambda: dict(RETENTION_ACTIONS))
    sample_source_id: str = "sample_data"


DEFAULT_CONFIG = RetentionConfig()
