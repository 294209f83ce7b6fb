"""Column names, the readings schema and the fixed rule constants."""

from __future__ import annotations

# Canonical (snake case) column names of the readings table.
UDI = "udi"
PRODUCT_ID = "product_id"
TYPE = "type"
AIR = "air_temp_k"
PROCESS = "process_temp_k"
RPM = "rpm"
TORQUE = "torque_nm"
WEAR = "tool_wear_min"
LABEL = "machine_failure"
MODE_COLS = ["twf", "hdf", "pwf", "osf", "rnf"]

# Sensor order used by the statistics, limits and profile operators.
SENSORS = [AIR, PROCESS, RPM, TORQUE, WEAR]

# ---------------------------------------------------------------------------
# These must equal the reference application for equal results.
# ---------------------------------------------------------------------------

# Source CSV header -> our column name, in the file's column order.
CSV_COLUMNS = {
    "UDI": UDI,
    "Product ID": PRODUCT_ID,
    "Type": TYPE,
    "Air temperature [K]": AIR,
    "Process temperature [K]": PROCESS,
    "Rotational speed [rpm]": RPM,
    "Torque [Nm]": TORQUE,
    "Tool wear [min]": WEAR,
    "Machine failure": LABEL,
    "TWF": "twf",
    "HDF": "hdf",
    "PWF": "pwf",
    "OSF": "osf",
    "RNF": "rnf",
}
# Long display names of the five sensors (used in reports and limit checks).
SENSOR_LONG_NAMES = {
    AIR: "Air temperature [K]",
    PROCESS: "Process temperature [K]",
    RPM: "Rotational speed [rpm]",
    TORQUE: "Torque [Nm]",
    WEAR: "Tool wear [min]",
}
# Failure-mode rule thresholds.
TWF_WEAR = 200.0
HDF_TEMP_DIFF = 8.6
HDF_RPM = 1380.0
PWF_POWER_MIN = 3500.0
PWF_POWER_MAX = 9000.0
OSF_LIMITS = {"L": 11000.0, "M": 12000.0, "H": 13000.0}
# Mode codes, display names and diagnosis labels, in emission order.
MODE_NAMES = {
    "TWF": "Tool Wear Failure",
    "HDF": "Heat Dissipation Failure",
    "PWF": "Power Failure",
    "OSF": "Overstrain Failure",
    "RNF": "Random Failure",
}
DIAGNOSIS_LABELS = {
    "TWF": "Tool Wear (TWF)",
    "HDF": "Heat Dissipation (HDF)",
    "PWF": "Power Failure (PWF)",
    "OSF": "Overstrain (OSF)",
    "RNF": "Random Failure (RNF)",
}
# Maintenance tiers: quantiles of tool wear, and the fallback when there is no wear data.
HIGH_QUANTILE = 0.80
URGENT_QUANTILE = 0.95
FALLBACK_HIGH = 150.0
FALLBACK_URGENT = 200.0
TIER_ACTIONS = {
    "URGENT": "Replace tool immediately — TWF imminent",
    "HIGH": "Schedule accelerated inspection",
    "ROUTINE": "Schedule within next maintenance window",
}
# Condition text of a tier, and what its range is called with fitted and with fallback thresholds.
TIER_CONDITIONS = {
    "URGENT": "Tool wear >= {urgent:.2f} min ({of})",
    "HIGH": "Tool wear >= {high:.2f} and < {urgent:.2f} min ({of})",
    "ROUTINE": "Tool wear < {high:.2f} min",
}
TIER_RANGES = {"URGENT": ("Q95", "fallback"), "HIGH": ("Q80-Q95", "fallback range"), "ROUTINE": ("", "")}
# Texts of reliability warnings: feature and value, with the range or the z-score.
RANGE_WARNING = "%s=%.2f outside [%.2f, %.2f]"
Z_WARNING = "%s z=%.2f"
# Anomaly scoring.
HIGH_Z = 3.0
Z_SCALE = 4.0
Z_WEIGHT = 0.6
RANGE_WEIGHT = 0.4
MIN_STD = 1e-9
NEUTRAL_COMPONENT = 0.5
# Risk tier of a failure probability (percent) and confidence labels.
RISK_HIGH = 70.0
RISK_MEDIUM = 40.0
CONFIDENCE_HIGH = 80.0
CONFIDENCE_MEDIUM = 60.0
CERTAINTY_WEIGHT = 0.7
QUALITY_WEIGHT = 0.3
# Request payload aliases per logical field, first present key wins.
FIELD_ALIASES = {
    "RPM": ["RPM", "Rotational speed [rpm]"],
    "Torque": ["Torque", "Torque [Nm]"],
    "Wear": ["Wear", "ToolWear", "Tool wear [min]"],
    "AirTemp": ["AirTemp", "Air temperature [K]"],
    "ProcessTemp": ["ProcessTemp", "Process temperature [K]"],
    "Type": ["Type", "type", "MachineType", "machine_type", "ProductType", "product_type"],
}
# Order in which non-numeric fields are reported.
NUMERIC_FIELD_ORDER = ["AirTemp", "ProcessTemp", "RPM", "Torque", "Wear"]
# Machine type tokens after strip, upper case and removal of '-' and '_'.
TYPE_TOKENS = {
    "L": "L", "M": "M", "H": "H",
    "LARGE": "L", "MEDIUM": "M", "HIGH": "H",
    "LTYPE": "L", "MTYPE": "M", "HTYPE": "H",
}
# Short keys accepted by the operating-limit check.
LIMIT_KEYS = {
    "RPM": RPM,
    "Torque": TORQUE,
    "ToolWear": WEAR,
    "Wear": WEAR,
    "AirTemp": AIR,
    "ProcessTemp": PROCESS,
}
# Keyword router: (keywords, tool), first match wins.
ROUTES = [
    (["predict", "failure"], "predict_failure"),
    (["pattern", "analyze"], "analyze_patterns"),
    (["diagnose"], "diagnose_failure"),
    (["schedule", "maintenance"], "get_maintenance_schedule"),
    (["kpi", "performance"], "calculate_kpis"),
    (["statistic", "summary"], "statistical_summary"),
    (["limit", "threshold"], "check_operating_limits"),
]
# Trigger text of a mode; the numbers named here have one decimal, all others none.
ONE_DECIMAL = ["{wear}", "{temp_diff}"]
TRIGGERS = {
    "TWF": "Tool wear {wear} min exceeds 200 min threshold",
    "HDF": "Temp diff {temp_diff}K < 8.6K AND RPM {rpm} < 1380",
    "PWF": "Power {power}W outside 3500-9000W range",
    "OSF": "Wear×Torque {overstrain} minNm exceeds type {type} limit {limit}",
}
# Model names, in training order (a full tie goes to the first).
MODEL_NAMES = [
    "Random Forest",
    "Gradient Boosting",
    "Logistic Regression",
    "Decision Tree",
    "Neural Network MLP",
]
# ---------------------------------------------------------------------------

# Features the classifiers see, in a fixed order (one-hot type in H, L, M order).
NUMERIC_FEATURES = [AIR, PROCESS, RPM, TORQUE, WEAR]
ONE_HOT = ["type_h", "type_l", "type_m"]
FEATURES = NUMERIC_FEATURES + ONE_HOT
