"""Fixed values that results depend on: physical constants, lists and thresholds."""

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.19492664455873  # one degree of arc on the sphere above

NEIGHBOR_RADII_KM = (25.0, 50.0, 100.0)
ANCHOR_RADIUS_KM = 50.0

# Linear humidity correction: slope * pm + rh_coef * rh + intercept.
CORRECTION_SLOPE = 0.524
CORRECTION_RH_COEF = -0.0862
CORRECTION_INTERCEPT = 5.75

# Study domain, grid and window.
BBOX = {"lat_min": 25.6, "lat_max": 36.7, "lon_min": -107.0, "lon_max": -93.3}
GRID_DEG = 0.1
DATE_START = "2021-01-01"
DATE_END = "2026-05-01"
TEMPORAL_CUTOFF = "2025-01-01"

# Coast reference points (lat, lon), south to north.
COAST_POINTS = [(25.97, -97.50), (27.80, -97.40), (28.93, -95.97), (29.30, -94.79), (29.70, -93.90)]

# Daily category upper bounds (2024 breakpoints) and the exceedance threshold.
AQI_UPPER_BOUNDS = [9.0, 35.4, 55.4, 125.4, 225.4]
AQI_CATEGORIES = ["Good", "Moderate", "USG", "Unhealthy", "Very Unhealthy", "Hazardous"]
EXCEEDANCE_CATEGORY = 2

# Regulatory feed rules.
REGULATORY_STATE = "48"
REGULATORY_PARAMETER = 88101
DAILY_DURATIONS = ["24-HR BLK AVG", "24 HOUR"]
DURATION_RANK = {"24-HR BLK AVG": 0, "1 HOUR": 1}
OTHER_DURATION_RANK = 2
MIN_OBSERVATION_PERCENT = 75

# Reconstructed mass of the reanalysis species (µg/m³ after scaling by 1e9).
SPECIES = {
    "DUSMASS25": "merra2_dust25",
    "OCSMASS": "merra2_oc",
    "BCSMASS": "merra2_bc",
    "SO4SMASS": "merra2_so4",
    "SSSMASS25": "merra2_ss25",
}
SPECIES_SCALE = 1e9
PROXY_WEIGHTS = {
    "merra2_so4": 1.375,
    "merra2_oc": 1.6,
    "merra2_bc": 1.0,
    "merra2_dust25": 1.0,
    "merra2_ss25": 1.0,
}

# Feature contract.
MET_COLUMNS = ["temperature", "humidity", "pressure", "wind_speed", "precipitation"]
PROXIMITY_COLUMNS = ["traffic_proximity", "superfund_proximity", "rmp_proximity", "diesel_pm_proximity"]
DEMOGRAPHIC_COLUMNS = ["ejf_score", "pct_people_of_color", "pct_low_income", "pct_ling_isolated"]
NEIGHBOR_COLUMNS = [
    "nbr_pm25_25km", "nbr_count_25km", "nbr_pm25_50km", "nbr_count_50km",
    "nbr_std_50km", "nbr_pm25_100km", "nbr_count_100km",
]
TIME_COLUMNS = [
    "month", "dow", "day_of_year", "month_sin", "month_cos",
    "dow_sin", "dow_cos", "doy_sin", "doy_cos",
]
PHYSICAL_FEATURES = [
    "humidity", "temperature", "pressure", "wind_speed", "precipitation",
    "traffic_proximity", "superfund_proximity", "rmp_proximity", "diesel_pm_proximity",
    "latitude", "longitude", "dist_to_nearest_sensor", "dist_to_coast",
    "nbr_pm25_25km", "nbr_count_25km", "nbr_pm25_50km", "nbr_count_50km",
    "nbr_std_50km", "nbr_pm25_100km", "nbr_count_100km",
    "hms_smoke", "aod", "cams_pm25",
    "month", "dow", "day_of_year",
    "month_sin", "month_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos",
    "temp_x_humidity", "wind_x_temp",
]
EXTRA_FEATURES = ["dust"]
FORECAST_FEATURES = ["geoscf_pm25"]
REANALYSIS_FEATURES = [
    "merra2_dust25", "merra2_oc", "merra2_bc", "merra2_so4", "merra2_ss25",
    "merra2_pm25_proxy", "merra2_pblh", "merra2_pblh_max", "merra2_pblh_min",
]

# Gridded stack: channels per source group.
GROUP_CHANNELS = {
    "aerosol": ["aod", "cams_pm25"],
    "smoke": ["hms_smoke"],
    "meteorology": ["temperature", "humidity", "pressure", "wind_speed",
                    "precipitation", "shortwave", "et0", "cloud_cover"],
    "static": ["elevation"],
    "temporal": ["doy_sin", "doy_cos"],
}
MET_EXTRA_COLUMNS = ["shortwave", "et0", "cloud_cover"]

# Folds and caps.
SENSOR_FOLDS = 10
BLOCK_FOLDS = 5
META_FOLDS = 4
KRIGE_NEIGHBORS = 16  # nearest training points of a kriged target
KRIGE_MIN_POINTS = 5
FRAME_DOY_PERIOD = 365.0
GRID_DOY_PERIOD = 365.25
