"""Outputs must carry exactly these numbers and texts."""

from __future__ import annotations

# Severity weight per violation name; any other name gets DEFAULT_SEVERITY.
SEVERITY_WEIGHTS = {
    "NO PARKING": "0.90",
    "DOUBLE PARKING": "1.00",
    "WRONG PARKING": "0.70",
    "PARKING NEAR BUS STOP": "0.85",
    "PARKING NEAR ROAD CROSSING": "0.80",
    "PARKING IN PEDESTRIAN CROSSING": "0.95",
    "PARKING NEAR TRAFFIC SIGNAL": "0.85",
    "PARKING ON FOOTPATH": "0.60",
    "PARKING NEAR FIRE HYDRANT": "0.75",
    "PARKING IN NO PARKING ZONE": "0.90",
    "PARKING ON YELLOW LINE": "0.70",
    "OBSTRUCTIVE PARKING": "0.95",
    "PARKING ON MAIN ROAD": "0.80",
    "PARKING NEAR HOSPITAL": "0.70",
    "PARKING NEAR SCHOOL": "0.75",
    "UNAUTHORIZED PARKING": "0.65",
}
DEFAULT_SEVERITY = "0.50"

# Valid coordinates, bounds included.
LAT_MIN, LAT_MAX = 12.7, 13.2
LNG_MIN, LNG_MAX = 77.3, 77.9

LOCAL_TIME_ZONE = "Asia/Kolkata"
NO_JUNCTION = "No Junction"
UNKNOWN = "UNKNOWN"
DEFAULT_HOUR = 12

# Weights of the priority score.
W_HOTSPOT, W_VIOLATION, W_RECURRENCE, W_SEVERITY = 0.40, 0.30, 0.20, 0.10

# Lower score limit, tier, recommended action.
TIERS = [
    (0.8, "IMMEDIATE", "Deploy patrol unit — critical hotspot with high recurrence"),
    (0.6, "HIGH", "Schedule enforcement sweep within 24 hours"),
    (0.4, "MODERATE", "Include in weekly enforcement rotation"),
    (0.2, "LOW", "Monitor — add to watch list for trend analysis"),
    (0.0, "MINIMAL", "No immediate action — periodic monitoring sufficient"),
]

# Model inputs.
FEATURE_COLUMNS = [
    "severity_mean",
    "hour_std",
    "weekday_pct",
    "vehicle_diversity",
    "unique_vehicles",
    "recurrence_score",
    "hotspot_density",
]

# Sentences of the score cards (printf templates).
STATION_HOTSPOTS = (
    "DBSCAN Cluster: Contains %d chronic hotspot grid cell(s) out of %d total spatial cells"
    " under jurisdiction."
)
STATION_NO_HOTSPOTS = (
    "DBSCAN Cluster: No high-intensity hotspot clusters detected in the %d spatial cells."
)
STATION_RECURRENCE = (
    "Vehicle Recurrence: %.1f%% of vehicle plates recorded here show repeat offences,"
    " indicating chronic parkers."
)
STATION_SEVERITY = (
    "Violation Severity: Average violation severity index is %.2f/1.0, influenced by"
    " traffic-blocking offences."
)
STATION_PEAK = (
    "Temporal Peak: Violation intensity peaks around hour %02d:00 IST, correlating with"
    " traffic congestion hours."
)
JUNCTION_CONTEXT = (
    "Spatial Context: Located in %d street-level hex cell(s) under %s Police Station jurisdiction."
)
JUNCTION_OFFENCE = (
    "Primary Offence: '%s' is the single most dominant violation type recorded here."
)
JUNCTION_RECURRENCE = (
    "Vehicle Recurrence: Plotted vehicle numbers reveal a %.1f%% repeat-offence rate in this zone."
)
JUNCTION_SEVERITY = (
    "Severity Index: Average severity weight of %.2f/1.0 indicates impact on traffic lanes."
)
JUNCTION_PROXY = (
    "Congestion Proxy: LightGBM model score is %.3f based on local spatial density predictors."
)

# Alert messages (printf templates).
ALERT_FIRED = (
    "Alert triggered! Cell violation count (%d) exceeds threshold (%d). Webhook dispatched."
)
ALERT_QUIET = "Alert threshold not crossed. Cell count (%d) is <= threshold (%d)."
ALERT_NOT_FOUND = "H3 cell index '%s' not found in data."

# Risk panel: lower limit, text. The last entry of each list is the fallback.
RISK_LABELS = [
    (0.8, "Critical Risk"),
    (0.6, "High Risk"),
    (0.4, "Moderate Risk"),
    (0.2, "Low Risk"),
    (None, "Minimal Risk"),
]
COVERAGE_FULL = "Chronic: Entire area is a high-intensity violation hotspot."
COVERAGE_HALF = "Clustered: Extensive hotspot grid cell coverage."
COVERAGE_SOME = "Partial: Scattered hotspot cells detected."
COVERAGE_NONE = "Clear: No active DBSCAN hotspots clusters present."
RECURRENCE_TEXTS = [
    (0.15, "High Recurrence: Indicates chronic illegal parking behavior."),
    (0.08, "Moderate: Noted repeat offences by local commuters."),
    (None, "Low Recurrence: Offences are mostly transient / first-time."),
]
SEVERITY_TEXTS = [
    (0.75, "Very High: Dominated by traffic-blocking & double-parking."),
    (0.50, "High: Significant lane obstruction and blockages."),
    (0.25, "Moderate: Mild traffic flow disruption."),
    (None, "Low Severity: Minor infractions with low flow disruption."),
]
RANK_BANDS = [
    (95, "#1 Citywide"),
    (90, "#2 Citywide"),
    (85, "#4 Citywide"),
    (80, "#7 Citywide"),
    (70, "#12 Citywide"),
    (60, "#18 Citywide"),
    (50, "#25 Citywide"),
    (None, "#38 Citywide"),
]
DENSITY_BANDS = [
    (0.8, "Critical Density"),
    (0.6, "Severe Density"),
    (0.4, "High Density"),
    (0.2, "Medium Density"),
    (None, "Low Density"),
]

# Messages of the quality report.
DUPLICATE_IDS = "Duplicate IDs: %d"
TOO_MANY_OUTLIERS = "Too many geo outliers: %,d (%.1f%%)"
SOME_OUTLIERS = "Geo outliers (outside Bengaluru bbox): %,d (%.1f%%)"
CREATED_NULL = "created_datetime NULL: %,d"
CLOSED_BEFORE_CREATED = "closed_datetime < created_datetime: %,d rows"
MANY_WITHOUT_JUNCTION = (
    "junction_name is 'No Junction' or NULL for %,d rows (%.1f%%) — "
    "use police_station or H3 as spatial grouping instead"
)

# Confidence of a score card: base, share that grows with the rows, rows at which it is full.
STATION_CONFIDENCE = (0.85, 0.13, 5000)
JUNCTION_CONFIDENCE = (0.80, 0.18, 1000)
