"""Business rules of the store: fixed values that results depend on."""

# Months of each season.
SEASON_MONTHS = {
    "Summer": (3, 4, 5),
    "Monsoon": (6, 7, 8, 9),
    "Post-Monsoon": (10, 11),
    "Winter": (12, 1, 2),
}
UNKNOWN_SEASON = "Unknown"

# Integer code of each season in the feature frame (unknown = 0).
SEASON_CODES = {"Summer": 0, "Monsoon": 1, "Post-Monsoon": 2, "Winter": 3}

# Months with higher traffic because of festivals.
FESTIVAL_MONTHS = (1, 3, 8, 9, 10, 11)

# Fixed values: (season, category) pairs with a high disease risk.
PEAK_SEASONS = (
    ("Monsoon", "fever"),
    ("Monsoon", "antibiotic"),
    ("Monsoon", "hydration"),
    ("Winter", "respiratory"),
    ("Winter", "fever"),
    ("Summer", "hydration"),
    ("Post-Monsoon", "allergy"),
)

# Demand factor of a category in a season (others = 1.0).
SEASONAL_FACTORS = {
    ("Monsoon", "fever"): 1.8,
    ("Monsoon", "hydration"): 1.6,
    ("Monsoon", "antibiotic"): 1.5,
    ("Monsoon", "allergy"): 1.3,
    ("Winter", "respiratory"): 1.7,
    ("Winter", "fever"): 1.4,
    ("Winter", "supplement"): 1.3,
    ("Summer", "hydration"): 1.9,
    ("Summer", "painkiller"): 1.2,
    ("Post-Monsoon", "allergy"): 1.4,
}

# Share of the forecast kept as buffer per season.
SEASON_BUFFERS = {"Summer": 0.18, "Monsoon": 0.25, "Post-Monsoon": 0.15, "Winter": 0.20}
DEFAULT_BUFFER = 0.15
PEAK_BUFFER_EXTRA = 0.05  # added when the seasonal factor exceeds PEAK_FACTOR
PEAK_FACTOR = 1.3

# Replenishment.
DEFAULT_LEAD_DAYS = 5
SAFETY_FACTOR = 0.5
DEFAULT_STOCK_DAYS = 30
EXPIRY_DAYS = 60
OPENING_STOCK_DAYS = 45
DELIVERY_FACTOR = 1.2

# Alert thresholds, as stock / recommended stock.
CRITICAL_RATIO = 0.5
LOW_RATIO = 0.8
SEASONAL_RISK_RATIO = 0.9
SEASONAL_RISK_FACTOR = 1.5
OVERSTOCK_RATIO = 1.3

# Turnover classes, units per day (both bounds inclusive).
FAST_UNITS = 90
SLOW_UNITS = 45
SLOW_MOVER_LIMIT = 50.0

# Forecasting.
HORIZONS = (7, 30, 60)
WINDOW_ROWS = 30
TRAIN_SHARE = 0.8
BAND_SHARE = 0.15
NOISE_SHARE = 0.3

# Order of the feature columns; the first one is the target.
FEATURES = (
    "quantity_sold", "month", "day_of_week", "day_of_month", "quarter", "is_weekend",
    "week_sin", "week_cos", "season_encoded", "is_festival_month", "is_peak_disease_season",
    "lag_1", "lag_7", "lag_30", "rolling_mean_7", "rolling_mean_30", "rolling_std_7",
)
TABULAR_FEATURES = FEATURES[1:]

# Severity, label and icon per alert type.
ALERT_KINDS = {
    "CRITICAL": ("critical", "🔴 Critical", "🔴"),
    "SEASONAL_RISK": ("warning", "🌡️ Seasonal Risk", "🌡️"),
    "RESTOCK_SOON": ("warning", "🟠 Restock Soon", "🟠"),
    "LOW_STOCK": ("warning", "🟡 Low Stock", "🟡"),
    "OVERSTOCK": ("info", "📦 Overstock", "📦"),
}
SEVERITY_RANKS = {"critical": 0, "warning": 1, "info": 2}
HEALTHY_LABEL = "✅ Healthy"

# Alert texts (%s slots are filled in the order named in functions/alerts.py).
ALERT_TEXTS = {
    "CRITICAL": "Stock critically low — only %s%% of recommended. Order %s units urgently.",
    "SEASONAL_RISK": "High-season item at %s%% stock (demand ×%s). Consider early restocking.",
    "RESTOCK_SOON": "Stock below reorder point (%s). Place order for %s units.",
    "LOW_STOCK": "Stock at %s%% of recommended. Monitor closely.",
    "OVERSTOCK": "Overstocked by %s units. Risk of expiry — delay next order.",
}
NO_ALERTS = ("All products healthy", "No alerts generated.")

# The default catalog
# (product_id, product_name, category, base_demand, unit_price, lead_time_days).
DEFAULT_CATALOG = (
    ("P001", "Paracetamol 500mg", "fever", 120, 15.0, 3),
    ("P002", "ORS Powder", "hydration", 80, 12.0, 4),
    ("P003", "Cough Syrup 100ml", "respiratory", 60, 85.0, 5),
    ("P004", "Cetirizine 10mg", "allergy", 70, 25.0, 4),
    ("P005", "Dolo 650", "fever", 110, 30.0, 3),
    ("P006", "Azithromycin 500mg", "antibiotic", 40, 120.0, 6),
    ("P007", "Vitamin C 500mg", "supplement", 90, 45.0, 5),
    ("P008", "Ibuprofen 400mg", "painkiller", 55, 20.0, 4),
    ("P009", "Amoxicillin 250mg", "antibiotic", 45, 65.0, 6),
    ("P010", "Electral Powder", "hydration", 75, 18.0, 4),
    ("P011", "Insulin Glargine", "diabetes", 30, 450.0, 7),
    ("P012", "Antihistamine Tabs", "allergy", 65, 35.0, 4),
)
STORE_ID = "STORE_001"
