"""Domain constants of the prediction task.

FIXED VALUES: the lists, thresholds and norm tables below must equal the
values the original pipeline uses, otherwise features and cleaning rules
give different results. They are stated plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# result / key column names
KAPPA = "Kappa"
RMSE = "RMSE"
MAE = "MAE"
R2 = "R2"
SII = "sii"
PCIAT_TOTAL = "PCIAT-PCIAT_Total"
ID = "id"
ESTIMATOR = "estimator"
PARAMS = "params"
FEATURES = "features"
FOLD = "fold"
LABEL_COLUMNS = [SII, PCIAT_TOTAL]

# leakage columns dropped before modelling (questionnaire items)
LEAKAGE_COLUMNS = [
    "PCIAT-PCIAT_18", "PCIAT-PCIAT_17", "PCIAT-PCIAT_15", "PCIAT-PCIAT_01",
    "PCIAT-PCIAT_02", "PCIAT-PCIAT_03", "PCIAT-PCIAT_04", "PCIAT-PCIAT_05",
    "PCIAT-PCIAT_06", "PCIAT-PCIAT_07", "PCIAT-PCIAT_08", "PCIAT-PCIAT_09",
    "PCIAT-PCIAT_10", "PCIAT-PCIAT_20", "PCIAT-PCIAT_13", "PCIAT-PCIAT_16",
    "PCIAT-PCIAT_19", "PCIAT-PCIAT_14", "PCIAT-PCIAT_11", "PCIAT-PCIAT_12",
    "PCIAT-Season",
]

# categorical season columns coded with shared integer codes
SEASON_COLUMNS = [
    "Basic_Demos-Enroll_Season", "CGAS-Season", "Physical-Season",
    "Fitness_Endurance-Season", "FGC-Season", "BIA-Season", "PAQ_A-Season",
    "PAQ_C-Season", "SDS-Season", "PreInt_EduHx-Season",
]

# grip-strength columns clipped to [9, 60]
CLIP_COLUMNS = ["FGC-FGC_GSND", "FGC-FGC_GSD"]
CLIP_LOWER = 9.0
CLIP_UPPER = 60.0

# implausible-value rules: (column, operator, bound) -> value becomes NULL
RANGE_RULES = [
    ("BIA-BIA_Fat", "<", 5.0),
    ("BIA-BIA_Fat", ">", 60.0),
    ("BIA-BIA_BMR", ">", 4000.0),
    ("BIA-BIA_DEE", ">", 8000.0),
    ("BIA-BIA_BMC", "<=", 0.0),
    ("BIA-BIA_BMC", ">", 10.0),
    ("BIA-BIA_FFM", "<=", 0.0),
    ("BIA-BIA_FFM", ">", 300.0),
    ("BIA-BIA_FMI", "<", 0.0),
    ("BIA-BIA_ECW", ">", 100.0),
    ("BIA-BIA_LDM", ">", 100.0),
    ("BIA-BIA_LST", ">", 300.0),
    ("BIA-BIA_SMM", ">", 300.0),
    ("BIA-BIA_TBW", ">", 300.0),
]

# age-group step lookup: group i is the first threshold with age <= t
AGE_THRESHOLDS = [5, 6, 7, 8, 10, 12, 14, 17, 22]

# norms by age group 0..8
NORMS = {
    "BMI": [16.3, 15.9, 16.1, 16.8, 17.3, 19.2, 20.2, 22.3, 23.6],
    "GS_max": [9, 9, 9, 9, 16.2, 19.9, 26.1, 31.3, 35.4],
    "GS_min": [9, 9, 9, 9, 14.4, 17.8, 23.4, 27.8, 31.1],
    "CU": [1.0, 3.0, 5.0, 7.0, 10.0, 14.0, 20.0, 20.0, 20.0],
    "PU": [1.0, 2.0, 3.0, 4.0, 5.0, 7.0, 8.0, 10.0, 14.0],
    "TL": [8.0, 8.0, 8.0, 9.0, 9.0, 10.0, 10.0, 10.0, 10.0],
    "BMR": [934.0, 941.0, 999.0, 1048.0, 1283.0, 1255.0, 1481.0, 1519.0, 1650.0],
    "DEE": [1471.0, 1508.0, 1640.0, 1735.0, 2132.0, 2121.0, 2528.0, 2566.0, 2793.0],
    "FFM": [42.0, 43.0, 49.0, 54.0, 60.0, 76.0, 94.0, 104.0, 111.0],
}

# fitness zone columns (row-wise mean / min / max)
ZONE_COLUMNS = [
    "FGC-FGC_CU_Zone", "FGC-FGC_GSND_Zone", "FGC-FGC_GSD_Zone", "FGC-FGC_PU_Zone",
    "FGC-FGC_SRL_Zone", "FGC-FGC_SRR_Zone", "FGC-FGC_TL_Zone",
]

# columns dropped after the second group of derived features
DERIVED_DROP_COLUMNS = [
    "FGC-FGC_GSND", "FGC-FGC_GSD", "FGC-FGC_CU_Zone", "FGC-FGC_GSND_Zone",
    "FGC-FGC_GSD_Zone", "FGC-FGC_PU_Zone", "FGC-FGC_SRL_Zone", "FGC-FGC_SRR_Zone",
    "FGC-FGC_TL_Zone", "Physical-BMI", "BIA-BIA_BMI", "FGC-FGC_CU", "FGC-FGC_PU",
    "FGC-FGC_TL", "FGC-FGC_SRL", "FGC-FGC_SRR", "BIA-BIA_BMR", "BIA-BIA_DEE",
    "BIA-BIA_Frame_num", "BIA-BIA_FFM",
]

# columns binned by quantile edges (10 bins) over train and test together
BINNED_COLUMNS = [
    "PAQ_A-PAQ_A_Total", "BMR_norm", "DEE_norm", "GS_min", "GS_max", "BIA-BIA_FFMI",
    "BIA-BIA_BMC", "Physical-HeartRate", "BIA-BIA_ICW", "Fitness_Endurance-Time_Sec",
    "BIA-BIA_LDM", "BIA-BIA_SMM", "BIA-BIA_TBW", "DEE_BMR", "ICW_ECW",
]
N_BINS = 10

# series summary: columns, masks and thresholds of the per-series feature vector
SERIES_KEYS = ["enmo", "anglez", "light", "battery_voltage"]
SERIES_FLAG = "non-wear_flag"
SERIES_ACTIVE_COLUMN = "enmo"
SERIES_ACTIVE_THRESHOLD = 0.05
NIGHT_FROM_HOUR = 22   # night: hour >= 22 or hour <= 5
NIGHT_TO_HOUR = 5
DAY_FROM_HOUR = 7      # day: 7 <= hour <= 20
DAY_TO_HOUR = 20
NS_PER_HOUR = 3_600_000_000_000

# initial ordinal cut points and cross-validation settings
INITIAL_CUTS = [0.5, 1.5, 2.5]
N_FOLDS = 4
PSEUDO_CONFIDENCE = 0.9
PSEUDO_STD_QUANTILE = 0.25
PSEUDO_REFITS = 5
RFE_STEP = 5
METRIC_DECIMALS = 3
# ------------------------------------------------------------ end FIXED VALUES
