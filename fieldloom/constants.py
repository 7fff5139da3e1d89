"""Names, thresholds and edges that results depend on."""

# --- fixed values: column names -------------------------------------------------
MEASURES = [
    "prec", "surf_pre", "humidity", "tmp", "dp_tmp", "wb_tmp", "tmp_max", "tmp_min",
    "tmp_range", "surf_tmp", "wind", "wind_max", "wind_min", "wind_range",
]
ZERO_FILLED = ["prec", "surf_pre"]
CLIPPED = ["tmp", "dp_tmp", "wb_tmp", "tmp_max", "tmp_min", "surf_tmp"]
WEEKLY_SUMS = ["prec", "surf_pre"]
WEEKLY_SPREADS = ["humidity", "tmp", "wind"]
WEEKLY_MEANS = ["tmp_max", "tmp_min", "tmp_range", "surf_tmp", "wind_max", "wind_min", "wind_range"]
LOGGED = ["prec", "prec_week_max", "prec_roll_sum_4w"]
LAGGED = ["tmp", "humidity", "prec", "wind"]
UNUSED_BY_MODEL = ["wb_tmp", "dp_tmp", "surf_tmp", "wind_max", "dow_sin"]
MODEL_FEATURES = [
    "prec", "surf_pre", "humidity", "tmp", "tmp_max", "tmp_min", "tmp_range", "wind", "wind_min",
    "wind_range", "tmp_week_max", "tmp_week_min", "tmp_week_std", "humidity_week_max",
    "humidity_week_min", "humidity_week_std", "wind_week_max", "wind_week_min", "wind_week_std",
    "prec_week_max", "surf_pre_week_max", "week_sin", "week_cos", "pet", "deficit",
    "prec_roll_sum_4w", "deficit_roll_cum_4w", "aridity_index", "heat_shock", "tmp_anomaly",
    "region_mean_score", "region_zero_prob",
]
ENCODED = ["region_mean_score", "region_zero_prob"]
PANEL_FEATURES = [c for c in MODEL_FEATURES if c not in ENCODED]
PROFILE_FEATURES = [
    "prec", "surf_pre", "humidity", "tmp", "tmp_max", "tmp_min", "tmp_range", "wind", "wind_min",
    "wind_range", "tmp_week_max", "tmp_week_min", "tmp_week_std", "humidity_week_max",
    "humidity_week_min", "humidity_week_std", "wind_week_max", "wind_week_min", "wind_week_std",
    "prec_week_max", "surf_pre_week_max", "tmp_roll_mean_4w", "humidity_roll_mean_4w", "week_sin",
    "week_cos", "pet", "prec_roll_sum_4w", "water_shortage", "water_shortage_roll_cum_4w",
    "aridity_index", "heat_shock", "tmp_anomaly", "water_shortage_roll_cum_8w",
    "cross_shortage_x_anomaly", "is_dry_spell", "shortage_momentum", "cluster_id",
]
DROUGHT_FEATURES = [
    "prec", "tmp", "humidity", "water_shortage", "water_shortage_roll_cum_4w",
    "water_shortage_roll_cum_8w", "tmp_anomaly", "cross_shortage_x_anomaly", "is_dry_spell",
    "shortage_momentum", "aridity_index", "heat_shock",
]
COMPARED_FEATURES = [
    "prec", "tmp", "humidity", "wind", "prec_week_max", "tmp_week_max", "tmp_week_std",
    "water_shortage", "water_shortage_roll_cum_4w", "water_shortage_roll_cum_8w", "is_dry_spell",
    "shortage_momentum", "cross_shortage_x_anomaly", "aridity_index", "tmp_anomaly",
]
DENSITY_FEATURES = [
    "prec", "tmp", "humidity", "water_shortage", "water_shortage_roll_cum_4w", "tmp_anomaly",
    "is_dry_spell", "shortage_momentum",
]
BOX_FEATURES = [
    "prec", "surf_pre", "humidity", "tmp", "tmp_max", "tmp_min", "wind", "wind_min", "tmp_week_max",
    "tmp_week_min", "tmp_week_std", "humidity_week_max", "humidity_week_std", "wind_week_max",
    "wind_week_std", "prec_week_max",
]
CLUSTER_FEATURES_V51 = ["score_mean", "score_zero_prob", "score_std", "tmp_mean", "prec_mean"]
CLUSTER_FEATURES_V54 = [
    "tmp_mean", "tmp_std", "prec_mean", "prec_std", "humidity_mean", "humidity_std", "wind_mean",
    "wind_std",
]
RAW_PROFILE_COLUMNS = ["date", "region_id", "prec", "tmp", "humidity", "wind", "score"]

# --- fixed values: calendar with 366 slots a year --------------------------------
MONTH_OFFSETS = [0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335]
MONTH_LENGTHS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
SLOTS_PER_YEAR = 366
DEFAULT_LEAP_PHASE = 1

# --- fixed values: thresholds and sizes ------------------------------------------
Z_LIMIT = 3.5
KEEP_DAYS = 5474
PAD_WEEKS_V51 = 3
PAD_WEEKS_V54 = 7
WINDOW = 13
HORIZON = 5
FOLDS = 4
FOLD_STEP = 13
CLUSTERS = 10
CLUSTER_RESTARTS = 10
SEED = 42
PERCENTS = [0, 10, 25, 50, 75, 90, 95, 99, 100]
SEVERITY_BINS = [
    ("zero", None, 0.0), ("0-1", 0.0, 1.0), ("1-2", 1.0, 2.0), ("2-3", 2.0, 3.0),
    ("3-4", 3.0, 4.0), ("4-5", 4.0, 5.0),
]
SHARE_BINS = [
    ("zero", None, 0.0), ("0-0.5", 0.0, 0.5), ("0.5-1", 0.5, 1.0), ("1-2", 1.0, 2.0),
    ("2-3", 2.0, 3.0), ("3-4", 3.0, 4.0), ("4-5", 4.0, 5.0),
]
LEVELS = [
    ("safe", None, 0.0), ("mild", 0.0, 1.0), ("mod", 1.0, 2.0), ("sev", 2.0, 3.0),
    ("ext", 3.0, None),
]
