"""Parameters of the retail domain: fixed dates, mappings and policy defaults."""

from __future__ import annotations

# Item families grouped into departments, one category.
DEPARTMENTS = {
    "SMALL": "SIZED",
    "MEDIUM": "SIZED",
    "LARGE": "SIZED",
    "ECONOMY": "STYLED",
    "STANDARD": "STYLED",
    "PROMO": "STYLED",
}
CATEGORY = "GOODS"

# Store -> state and state -> benefit-day flag column.
STATES = {
    "AFRICA": "EMEA",
    "AMERICA": "AMER",
    "ASIA": "APAC",
    "EUROPE": "EMEA",
    "MIDDLE EAST": "EMEA",
}
SNAP_COLUMNS = {"EMEA": "snap_emea", "AMER": "snap_amer", "APAC": "snap_apac"}
SNAP_DAYS = {"snap_emea": (1, 10), "snap_amer": (5, 14), "snap_apac": (11, 20)}

# Fixed values: (month, day) -> events of the calendar, slot 1 and slot 2.
EVENTS_1 = {
    (1, 1): ("NewYear", "National"),
    (2, 14): ("ValentinesDay", "Cultural"),
    (7, 4): ("SummerFair", "National"),
    (10, 31): ("Halloween", "Cultural"),
    (12, 25): ("Christmas", "National"),
}
EVENTS_2 = {(12, 25): ("WinterFestival", "Religious")}

# Three contiguous 30-day windows and the locked window after them.
FOLDS = [
    ("f1", "2001-04-02", "2001-05-01"),
    ("f2", "2001-05-02", "2001-05-31"),
    ("f3", "2001-06-01", "2001-06-30"),
]
LOCKED = ("locked", "2001-07-01", "2001-07-30")
HORIZON = 30

# Horizon slices of the metric cube (name, days, aggregate).
HORIZON_SPECS = [
    ("day_1_daily", 1, False),
    ("days_1_7_daily", 7, False),
    ("days_1_7_aggregate", 7, True),
    ("days_1_30_daily", 30, False),
    ("days_1_30_aggregate", 30, True),
]
SEGMENTS = ["demand_band", "store_id", "dept_id", "intermittency_class"]
MODELS = ["zero", "last_value", "seasonal_naive_7", "mean_28", "croston_sba"]
CROSTON_ALPHA = 0.1

# Weights of the balanced validation ranking.
RANK_HORIZON_WEIGHTS = {
    "day_1_daily": 0.5,
    "days_1_7_daily": 0.75,
    "days_1_7_aggregate": 1.25,
    "days_1_30_daily": 2.0,
    "days_1_30_aggregate": 2.0,
}
RANK_METRIC_WEIGHTS = {"mae": 2.0, "rmse": 1.0, "wape": 1.0, "rmsse": 2.0, "absolute_bias": 0.4}
RANK_FOLD_WEIGHT = 1.5
RANK_STABILITY_WEIGHT = 1.0

# Replenishment policy defaults.
POLICY = {
    "service_level": 0.95,
    "lead_time_days": 7,
    "review_period_days": 7,
    "low_stock_days": 10.0,
    "overstock_multiplier": 1.5,
    "holding_cost_per_unit_per_day": 0.02,
    "stockout_cost_per_unit": 5.0,
    "fixed_order_cost": 25.0,
    "scenario_count": 300,
    "critical_risk_threshold": 0.75,
    "weight_risk": 0.5,
    "weight_reorder_gap": 0.3,
    "weight_target_gap": 0.2,
    "urgent": 75.0,
    "high": 50.0,
    "medium": 25.0,
    "maximum_candidate_points": 301,
    "upper_quantile": 0.995,
    "upper_buffer": 1.1,
    "minimum_series_observations": 60,
}
LEAD_TIME_CHOICES = [3, 5, 7, 10, 14]
SERVICE_LEVEL_CHOICES = [0.9, 0.95, 0.975, 0.99]
STATUS_ORDER = ["STOCKOUT", "CRITICAL", "REORDER NOW", "LOW", "HEALTHY", "OVERSTOCK"]
PRIORITY_ORDER = ["URGENT", "HIGH", "MEDIUM", "LOW", "NONE"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

SERIES = ["store_id", "item_id"]
