"""Column-role specs.  Every generic operator takes one of these."""
from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Must equal the reference application for identical results.
# Telecom customer CSV header (21 required columns), in the reference's order.
REQUIRED_CSV_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]
# Allowed values per categorical CSV column.
CSV_DOMAINS = {
    "gender": ["Male", "Female"],
    "Partner": ["Yes", "No"],
    "Dependents": ["Yes", "No"],
    "PhoneService": ["Yes", "No"],
    "MultipleLines": ["Yes", "No", "No phone service"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": ["Yes", "No", "No internet service"],
    "OnlineBackup": ["Yes", "No", "No internet service"],
    "DeviceProtection": ["Yes", "No", "No internet service"],
    "TechSupport": ["Yes", "No", "No internet service"],
    "StreamingTV": ["Yes", "No", "No internet service"],
    "StreamingMovies": ["Yes", "No", "No internet service"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaperlessBilling": ["Yes", "No"],
    "PaymentMethod": ["Electronic check", "Mailed check",
                      "Bank transfer (automatic)", "Credit card (automatic)"],
    "Churn": ["Yes", "No"],
}
# CSV name -> typed snake_case name.
CSV_TO_TYPED = {
    "customerID": "customer_id", "gender": "gender", "SeniorCitizen": "senior_citizen",
    "Partner": "partner", "Dependents": "dependents", "tenure": "tenure",
    "PhoneService": "phone_service", "MultipleLines": "multiple_lines",
    "InternetService": "internet_service", "OnlineSecurity": "online_security",
    "OnlineBackup": "online_backup", "DeviceProtection": "device_protection",
    "TechSupport": "tech_support", "StreamingTV": "streaming_tv",
    "StreamingMovies": "streaming_movies", "Contract": "contract",
    "PaperlessBilling": "paperless_billing", "PaymentMethod": "payment_method",
    "MonthlyCharges": "monthly_charges", "TotalCharges": "total_charges", "Churn": "churn",
}
TENURE_MAX = 72                 # months
SCORING_CHARGES_MAX = 1_000_000.0
VALIDATION_MESSAGE_LIMIT = 10   # messages before the "omitted" marker
AT_RISK_PROBABILITY = 0.70      # dashboard at-risk cut-off (strict)
TOP_CONTRIBUTORS = 5
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Roles:
    """Which column plays which part."""
    id: str
    binary: tuple
    multi: tuple
    numeric: tuple
    flag: tuple
    label: str
    domains: dict = field(default_factory=dict)   # categorical column -> allowed values
    time: str | None = None

    @property
    def categorical(self) -> tuple:
        return tuple(self.binary) + tuple(self.multi)

    @property
    def quality_columns(self) -> tuple:
        """Columns whose nulls count as missing cells (all but the id)."""
        return self.categorical + tuple(self.numeric) + tuple(self.flag) + (self.label,)

    @property
    def features(self) -> tuple:
        return tuple(self.binary) + tuple(self.multi) + tuple(self.numeric) + tuple(self.flag)


# Typed reference table (customer_records).
TELCO = Roles(
    id="customer_id",
    binary=("gender", "partner", "dependents", "phone_service", "paperless_billing"),
    multi=("contract", "internet_service", "multiple_lines", "online_security",
           "online_backup", "device_protection", "tech_support", "streaming_tv",
           "streaming_movies"),
    numeric=("tenure", "monthly_charges", "total_charges"),
    flag=("senior_citizen",),
    label="churn",
    domains={CSV_TO_TYPED[k]: tuple(v) for k, v in CSV_DOMAINS.items()
             if k not in ("PaymentMethod", "Churn")},
    time="created_at",
)

# Fixture derived from the driver tables (FIXTURES.md section 3.1).  The
# domains are the value sets the generator produces.
FIXTURE = Roles(
    id="customer_id",
    binary=("gender", "partner", "dependents", "phone_service", "paperless_billing"),
    multi=("contract", "internet_service", "online_security"),
    numeric=("tenure", "monthly_charges", "total_charges"),
    flag=("senior_citizen",),
    label="churn",
    domains={
        "gender": ("Male", "Female"),
        "partner": ("Yes", "No"),
        "dependents": ("Yes", "No"),
        "phone_service": ("Yes", "No"),
        "paperless_billing": ("Yes", "No"),
        "contract": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
        "internet_service": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
        "online_security": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
    },
    time="created_at",
)

# Raw (all-string) form of the fixture uses the reference CSV header names.
FIXTURE_CSV_NAMES = {v: k for k, v in CSV_TO_TYPED.items() if v in
                     set(FIXTURE.features) | {"customer_id", "churn"}}
