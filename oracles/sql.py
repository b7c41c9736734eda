"""SQL texts that recompute every query independently.

Shared relations are common table expressions; each query names the ones it needs. Doubles are
rounded to 6 digits, integers cast to BIGINT and dates to text, the form the queries are returned in.
"""

from __future__ import annotations

from kerbsight.functions import fixed
from kerbsight.sources.events import VIOLATIONS_SQL

DATE_FROM, DATE_TO, DRIFT_DATE = "2024-01-08", "2024-01-21", "2024-01-16"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _ladder(expr: str, steps) -> str:
    cases = " ".join(f"WHEN {expr} >= {limit} THEN {_text(t)}" for limit, t in steps[:-1])
    return f"CASE {cases} ELSE {_text(steps[-1][1])} END"


def _tier(expr: str) -> str:
    return _ladder(expr, [(limit, name) for limit, name, _ in fixed.TIERS])


def _action(expr: str) -> str:
    return _ladder(expr, [(limit, text) for limit, _, text in fixed.TIERS])


def _hex(edge: str, name: str) -> str:
    """Axial coordinates by three-axis rounding."""
    return f"""
  SELECT id, CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END::BIGINT AS {name}q,
         CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END::BIGINT AS {name}r
  FROM (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds
    FROM (SELECT *, floor(q + 5e-1) AS rq, floor(r + 5e-1) AS rr, floor(-q - r + 5e-1) AS rs
      FROM (SELECT id, (sqrt(3e0) / 3e0 * x - y / 3e0) / {edge} AS q, (2e0 / 3e0 * y) / {edge} AS r
        FROM (SELECT id, (longitude - 776e-1) * 10848e-2 AS x,
                     (latitude - 1295e-2) * 11057e-2 AS y FROM v))))"""


_STREET, _CITY = "2058e-4", "14095e-4"


def _centroid(edge: str, q: str, r: str) -> tuple[str, str]:
    lat = f"(1295e-2 + 15e-1 * {r} * {edge} / 11057e-2)"
    lng = f"(776e-1 + {edge} * sqrt(3e0) * ({q} + {r} / 2e0) / 10848e-2)"
    return lat, lng


def _mode(rel: str, key: str, col: str) -> str:
    """Most frequent non-null value per key, smallest among equals."""
    return f"""
  SELECT {key}, {col} AS v FROM (
    SELECT {key}, {col}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {col}) AS rn
    FROM {rel} WHERE {col} IS NOT NULL AND {key} IS NOT NULL GROUP BY {key}, {col}) WHERE rn = 1"""


def _vehicles(rel: str, key: str) -> str:
    return f"""
  SELECT {key}, count(*)::BIGINT AS unique_vehicles,
         count(*) FILTER (n > 1)::BIGINT AS repeat_vehicles,
         count(*) FILTER (n > 1) / count(*)::DOUBLE AS recurrence_score
  FROM (SELECT {key}, vehicle_number, count(*) AS n FROM {rel}
        WHERE {key} IS NOT NULL AND vehicle_number IS NOT NULL GROUP BY ALL) GROUP BY {key}"""


def _unit(value: str, rel: str, inner: str) -> str:
    low = f"(SELECT min({inner}) FROM {rel})"
    high = f"(SELECT max({inner}) FROM {rel})"
    return f"CASE WHEN {high} - {low} > 0 THEN ({value} - {low}) / ({high} - {low}) ELSE 5e-1 END"


def _heat(count: str, edge: str, key: str, rel: str, with_hour: bool) -> str:
    q, r = (f"any_value({key}q)", f"any_value({key}r)")
    lat, lng = _centroid(edge, q, r)
    hour = ", avg(hour_ist) AS avg_hour" if with_hour else ""
    col = "cell_street" if key == "s" else "cell_city"
    return f"""
  SELECT g.cell_id, g.violation_count, coalesce(a.v, 'UNKNOWN') AS top_violation,
         coalesce(b.v, 'UNKNOWN') AS police_station, lat, lng {", avg_hour" if with_hour else ""}
  FROM (SELECT {col} AS cell_id, {count}::BIGINT AS violation_count, {lat} AS lat, {lng} AS lng {hour}
        FROM {rel} WHERE {col} IS NOT NULL GROUP BY {col}) g
  LEFT JOIN ({_mode(rel, col, "primary_violation")}) a ON a.{col} = g.cell_id
  LEFT JOIN ({_mode(rel, col, "police_station")}) b ON b.{col} = g.cell_id"""


_SEVERITY = (
    "CASE primary_violation "
    + " ".join(f"WHEN {_text(k)} THEN {w}" for k, w in fixed.SEVERITY_WEIGHTS.items())
    + f" ELSE {fixed.DEFAULT_SEVERITY} END"
)
_LAT, _LNG = _centroid(_STREET, "sq", "sr")
_MODES = ("hour_ist", "primary_violation", "vehicle_type", "police_station")


def _mode_joins(key: str, columns) -> str:
    return "\n".join(
        f"LEFT JOIN ({_mode('f', key, c)}) m_{c} ON m_{c}.{key} = g.{key}" for c in columns
    )


def _is_test(cell: str) -> str:
    return f"(('0x' || substr(md5({cell}), 1, 4))::INT % 5 = 0)"


def _station_join(first: str) -> str:
    """Priority of stations, `first` being the leading component."""
    return f"""
  SELECT *, 4e-1 * {first} + 3e-1 * vol + 2e-1 * recurrence_score + 1e-1 * sev AS blend FROM (
    SELECT *, {_unit("ln(1 + violation_count)", "stations", "ln(1 + violation_count)")} AS vol,
           {_unit("severity_mean", "stations", "severity_mean")} AS sev FROM scored_stations)"""


# name, relations it reads, text
_RELATIONS: list[tuple[str, str, str]] = [
    ("v", "", VIOLATIONS_SQL.format(events="events")),
    (
        "parsed",
        "v",
        """
  SELECT *, CASE WHEN violation_type IS NULL THEN []::VARCHAR[]
                 WHEN NOT json_valid(violation_type) THEN [violation_type]
                 WHEN json_type(violation_type) = 'ARRAY' THEN from_json(violation_type, '["VARCHAR"]')
                 ELSE [violation_type ->> '$'] END AS names,
         CASE WHEN offence_code IS NULL OR NOT json_valid(offence_code) THEN []::INT[]
              WHEN json_type(offence_code) = 'ARRAY' THEN from_json(offence_code, '["INT"]')
              ELSE [offence_code::INT] END AS codes,
         CASE WHEN len(names) = 0 THEN 'UNKNOWN' ELSE names[1] END AS primary_violation,
         created_datetime + INTERVAL '330' MINUTE AS ist
  FROM v""",
    ),
    ("hs", "v", _hex(_STREET, "s")),
    ("hc", "v", _hex(_CITY, "c")),
    (
        "f",
        "parsed hs hc",
        f"""
  SELECT parsed.* EXCLUDE (junction_name), trim(coalesce(junction_name, 'No Junction')) AS junction_name,
         ({_SEVERITY})::DECIMAL(4, 2) AS severity, hour(ist) AS hour_ist, isodow(ist) - 1 AS dow,
         ist::DATE AS date_ist, sq, sr, cq, cr,
         concat('s:', sq, ':', sr) AS cell_street, concat('c:', cq, ':', cr) AS cell_city
  FROM parsed JOIN hs USING (id) JOIN hc USING (id)""",
    ),
    (
        "cells",
        "f",
        f"""
  SELECT g.* EXCLUDE (cell_street), g.cell_street AS cell_id, coalesce(m_hour_ist.v, 12) AS hour_peak,
         coalesce(m_primary_violation.v, 'UNKNOWN') AS top_violation,
         coalesce(m_vehicle_type.v, 'UNKNOWN') AS top_vehicle,
         coalesce(m_police_station.v, 'UNKNOWN') AS police_station,
         coalesce(unique_vehicles, 0) AS unique_vehicles,
         coalesce(recurrence_score, 0) AS recurrence_score
  FROM (SELECT cell_street, any_value(sq) AS sq, any_value(sr) AS sr, count(id) AS violation_count,
               sum(severity)::DOUBLE / count(*) AS severity_mean, sum(severity)::DOUBLE AS severity_sum,
               coalesce(stddev_samp(hour_ist), 0) AS hour_std,
               count(*) FILTER (dow < 5) / count(*)::DOUBLE AS weekday_pct,
               count(DISTINCT vehicle_type) AS vehicle_diversity,
               any_value({_LAT}) AS lat, any_value({_LNG}) AS lng
        FROM f GROUP BY cell_street) g
  {_mode_joins("cell_street", _MODES)}
  LEFT JOIN ({_vehicles("f", "cell_street")}) r ON r.cell_street = g.cell_street""",
    ),
    (
        "stations",
        "f",
        f"""
  SELECT g.*, coalesce(m_hour_ist.v, 12) AS hour_peak,
         coalesce(m_primary_violation.v, 'UNKNOWN') AS top_violation,
         coalesce(m_vehicle_type.v, 'UNKNOWN') AS top_vehicle,
         coalesce(unique_vehicles, 0) AS unique_vehicles,
         coalesce(recurrence_score, 0) AS recurrence_score
  FROM (SELECT police_station, count(id) AS violation_count,
               sum(severity)::DOUBLE / count(*) AS severity_mean, sum(severity)::DOUBLE AS severity_sum,
               count(DISTINCT cell_street) AS unique_cells_street,
               count(DISTINCT cell_city) AS unique_cells_city
        FROM f WHERE police_station IS NOT NULL GROUP BY police_station) g
  {_mode_joins("police_station", _MODES[:3])}
  LEFT JOIN ({_vehicles("f", "police_station")}) r ON r.police_station = g.police_station""",
    ),
    (
        "hot",
        "cells",
        """
  SELECT *, row_number() OVER (ORDER BY violation_count DESC, sq, sr) AS o FROM cells
  WHERE violation_count >= (SELECT quantile_cont(violation_count, 0.25) FROM cells)""",
    ),
    (
        "pairs",
        "hot",
        """
  SELECT a.o AS a, b.o AS b, a.cell_id AS a_id, b.cell_id AS b_id FROM hot a JOIN hot b
  ON (a.lat - b.lat) * (a.lat - b.lat) + (a.lng - b.lng) * (a.lng - b.lng) <= 4e-3 * 4e-3""",
    ),
    ("core", "pairs", "SELECT a FROM pairs GROUP BY a HAVING count(*) >= 3"),
    (
        "core_pairs",
        "pairs core",
        "SELECT p.a, p.b FROM pairs p JOIN core x ON x.a = p.a JOIN core y ON y.a = p.b",
    ),
    (
        "reach(src, dst)",
        "core core_pairs",
        """
  SELECT a, a FROM core
  UNION SELECT r.src, p.b FROM reach r JOIN core_pairs p ON p.a = r.dst""",
    ),
    (
        "named",
        "reach",
        """
  SELECT o, dense_rank() OVER (ORDER BY root) - 1 AS cid
  FROM (SELECT src AS o, min(dst) AS root FROM reach GROUP BY src)""",
    ),
    (
        "labels",
        "hot named pairs",
        """
  SELECT h.cell_id, coalesce(n.cid, (SELECT min(j.cid) FROM pairs p JOIN named j ON j.o = p.b
                                     WHERE p.a = h.o), -1) AS cluster_id
  FROM hot h LEFT JOIN named n ON n.o = h.o""",
    ),
    (
        "labelled",
        "cells labels",
        """
  SELECT c.*, coalesce(l.cluster_id, -1)::BIGINT AS cluster_id, coalesce(l.cluster_id, -1) >= 0 AS is_hotspot
  FROM cells c LEFT JOIN labels l USING (cell_id)""",
    ),
    (
        "spots",
        "labelled",
        """
  SELECT l.*, coalesce(rk, 0)::BIGINT AS hotspot_rank,
         CASE WHEN is_hotspot THEN violation_count / top::DOUBLE ELSE 0 END AS hotspot_density
  FROM labelled l LEFT JOIN (
    SELECT cluster_id, max(violation_count) AS top,
           row_number() OVER (ORDER BY sum(violation_count) DESC, cluster_id) AS rk
    FROM labelled WHERE is_hotspot GROUP BY cluster_id) USING (cluster_id)""",
    ),
    (
        "line",
        "spots",
        f"""
  SELECT regr_slope(ln(1 + violation_count), ln(1 + unique_vehicles)) AS slope,
         regr_intercept(ln(1 + violation_count), ln(1 + unique_vehicles)) AS icept
  FROM spots WHERE NOT {_is_test("cell_id")}""",
    ),
    (
        "predicted",
        "spots line",
        """
  SELECT s.*, round(icept + slope * ln(1 + unique_vehicles), 9) AS congestion_raw FROM spots s, line""",
    ),
    (
        "scored",
        "predicted",
        f"""
  SELECT *, {_unit("congestion_raw", "predicted", "congestion_raw")} AS congestion_score FROM predicted""",
    ),
    (
        "scored_stations",
        "stations scored",
        """
  SELECT s.*, m, x, p90, coalesce(hot_n, 0) AS hotspot_cells, coalesce(n, 0) AS total_cells,
         coalesce(p90, 0) AS congestion_score
  FROM stations s LEFT JOIN (
    SELECT police_station, avg(congestion_score) AS m, max(congestion_score) AS x,
           quantile_cont(congestion_score, 0.9) AS p90, count(*) FILTER (is_hotspot) AS hot_n,
           count(*) AS n FROM scored GROUP BY police_station) USING (police_station)""",
    ),
    (
        "blended",
        "scored",
        f"""
  SELECT *, 4e-1 * hotspot_density + 3e-1 * vol + 2e-1 * recurrence_score + 1e-1 * sev AS blend
  FROM (SELECT *, {_unit("ln(1 + violation_count)", "scored", "ln(1 + violation_count)")} AS vol,
               {_unit("severity_mean", "scored", "severity_mean")} AS sev FROM scored)""",
    ),
    (
        "queue",
        "blended",
        f"""
  SELECT *, {_tier("priority_score")} AS priority_tier, {_action("priority_score")} AS recommended_action
  FROM (SELECT *, {_unit("blend", "blended", "blend")} AS priority_score FROM blended)""",
    ),
    ("station_blend", "stations scored_stations", _station_join("congestion_score")),
    ("station_blend_count", "stations scored_stations", _station_join("vol")),
    (
        "cards",
        "scored_stations",
        """
  SELECT 'station' AS query_type, police_station AS name, congestion_score AS score, violation_count,
         hotspot_cells, total_cells, recurrence_score AS recurrence_rate,
         severity_mean AS severity_index, hour_peak AS peak_hour,
         85e-2 + 13e-2 * (least(violation_count, 5000) / 5000e0) AS confidence_score
  FROM scored_stations""",
    ),
    (
        "jrows",
        "f",
        """
  SELECT junction_name, cell_street AS cell_id, count(*) AS n_rows FROM f GROUP BY ALL""",
    ),
    (
        "jcards",
        "jrows scored",
        """
  SELECT 'junction' AS query_type, junction_name AS name,
         sum(congestion_score * violation_count) / sum(violation_count) AS score,
         sum(n_rows)::BIGINT AS violation_count, count(*) FILTER (is_hotspot) AS hotspot_cells,
         count(*) AS total_cells,
         sum(recurrence_score * violation_count) / sum(violation_count) AS recurrence_rate,
         sum(severity_mean * violation_count) / sum(violation_count) AS severity_index,
         first(hour_peak ORDER BY violation_count DESC, sq, sr) AS peak_hour,
         80e-2 + 18e-2 * (least(sum(n_rows), 1000) / 1000e0) AS confidence_score,
         first(police_station ORDER BY violation_count DESC, sq, sr) AS police_station,
         first(top_violation ORDER BY violation_count DESC, sq, sr) AS top_violation
  FROM jrows JOIN scored USING (cell_id) GROUP BY junction_name""",
    ),
    (
        "rules",
        "f",
        f"""
  SELECT cell_street AS cell_id, 2 * count(*) AS threshold FROM f WHERE date_ist < DATE '{DRIFT_DATE}' GROUP BY 1
  UNION ALL
  SELECT cell_city, count(*) FROM f WHERE date_ist < DATE '{DRIFT_DATE}' GROUP BY 1""",
    ),
    (
        "hourly",
        "f cells",
        """
  SELECT cell_id, date_trunc('hour', created_datetime) AS window_start, count(*) AS current_count,
         any_value(floor(c.violation_count * 2 / 720e0))::BIGINT AS threshold
  FROM f JOIN cells c ON c.cell_id = f.cell_street WHERE created_datetime IS NOT NULL
  GROUP BY cell_id, window_start""",
    ),
    (
        "slides",
        "f",
        """
  SELECT police_station, window_start, count(*) AS violations FROM (
    SELECT police_station, time_bucket(INTERVAL '10 minutes', created_datetime) AS window_start FROM f
    WHERE created_datetime IS NOT NULL AND police_station IS NOT NULL
    UNION ALL
    SELECT police_station, time_bucket(INTERVAL '10 minutes', created_datetime, INTERVAL '5 minutes') FROM f
    WHERE created_datetime IS NOT NULL AND police_station IS NOT NULL) GROUP BY ALL""",
    ),
    (
        "halves",
        "f line scored",
        f"""
  SELECT late, least(floor(s * 10), 9)::BIGINT AS bin FROM (
    SELECT late, round(greatest(0, least(1, (round(icept + slope * ln(1 + u), 9) - low) / (high - low))), 6) AS s
    FROM (SELECT cell_street, date_ist >= DATE '{DRIFT_DATE}' AS late, count(DISTINCT vehicle_number) AS u
          FROM f WHERE vehicle_number IS NOT NULL AND date_ist IS NOT NULL GROUP BY ALL), line,
         (SELECT min(congestion_raw) AS low, max(congestion_raw) AS high FROM scored))""",
    ),
]
_BY_NAME = {name.split("(")[0]: (name, deps.split(), text) for name, deps, text in _RELATIONS}


def _query(needs: str, select: str) -> str:
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for dep in _BY_NAME[name][1]:
                add(dep)

    for name in needs.split():
        add(name)
    ctes = [
        f"{name} AS ({text})" for name, _, text in _RELATIONS if name.split("(")[0] in wanted
    ]
    return f"WITH RECURSIVE {', '.join(ctes)}\n{select}" if ctes else select


def _r(*names: str) -> str:
    return ", ".join(f"round({n}::DOUBLE, 6) AS {n.split('.')[-1]}" for n in names)


def _b(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)


_QUEUE_FLAT = f"""cell_id, priority_tier, recommended_action, violation_count, is_hotspot, hotspot_rank,
  police_station, top_violation, top_vehicle,
  {_r("priority_score", "severity_mean", "recurrence_score", "congestion_score", "lat", "lng")},
  printf('%.3f', hotspot_density)::DOUBLE AS factor_hotspot_density, printf('%.3f', vol)::DOUBLE AS factor_violation_intensity,
  printf('%.3f', recurrence_score)::DOUBLE AS factor_recurrence, printf('%.3f', sev)::DOUBLE AS factor_severity"""
_CARD = (
    "query_type, name, violation_count, "
    + _b("hotspot_cells", "total_cells", "peak_hour")
    + ", "
    + _r("score", "recurrence_rate", "severity_index", "confidence_score")
)
_RECURRENCE = "unique_vehicles, repeat_vehicles, " + _r("recurrence_score")


def _printf(template: str, *args: str) -> str:
    return f"printf({_text(template)}, {', '.join(args)})"


def _sentences(cards: str, *texts: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT name, {i}::BIGINT AS position, {t} AS sentence FROM {cards}"
        for i, t in enumerate(texts)
    )


def _dq_row(check: str, status: str, value: str, pct: str, message: str) -> str:
    return (
        f"SELECT '{check}' AS \"check\", status, value::BIGINT AS value, pct::DOUBLE AS pct,"
        f" CASE WHEN status <> 'ok' THEN {message} END AS message"
        f" FROM (SELECT {status} AS status, {value} AS value, {pct} AS pct, * FROM m)"
    )


_DQ = (
    """WITH RECURSIVE v AS (%s), m AS (
  SELECT count(*) AS n, count(*) - count(DISTINCT id) - max((id IS NULL)::INT) AS dup,
    count(*) FILTER (NOT coalesce(latitude BETWEEN 12.7e0 AND 13.2e0 AND longitude BETWEEN 77.3e0 AND 77.9e0, false)) AS geo,
    count(*) FILTER (created_datetime IS NULL) AS cnull,
    count(*) FILTER (closed_datetime < created_datetime) AS bad,
    count(*) FILTER (closed_datetime IS NULL) AS clnull,
    count(*) FILTER (junction_name IS NULL OR lower(trim(junction_name)) = 'no junction') AS nj FROM v)
"""
    % VIOLATIONS_SQL.format(events="events")
    + "\nUNION ALL ".join(
        [
            _dq_row("duplicate_ids", "if(dup > 0, 'warning', 'ok')", "dup", "NULL", "printf('Duplicate IDs: %d', dup)"),
            _dq_row(
                "geo_outliers",
                "CASE WHEN geo / n::DOUBLE > 0.05 THEN 'error' WHEN geo > 0 THEN 'warning' ELSE 'ok' END",
                "geo",
                "round_even(geo * 100 / n::DOUBLE, 1)",
                "CASE WHEN geo / n::DOUBLE > 0.05 THEN 'Too many geo outliers: ' ELSE 'Geo outliers (outside Bengaluru bbox): ' END"
                " || format('{:,}', geo) || printf(' (%.1f%%)', geo * 100 / n::DOUBLE)",
            ),
            _dq_row(
                "created_datetime_null", "if(cnull > 0, 'warning', 'ok')", "cnull", "NULL",
                "'created_datetime NULL: ' || format('{:,}', cnull)",
            ),
            _dq_row(
                "closed_before_created", "if(bad > 0, 'warning', 'ok')", "bad", "NULL",
                "'closed_datetime < created_datetime: ' || format('{:,}', bad) || ' rows'",
            ),
            _dq_row("closed_datetime_null", "'ok'", "clnull", "round_even(clnull * 100 / n::DOUBLE, 1)", "NULL"),
            _dq_row(
                "no_junction", "if(nj / n::DOUBLE > 0.5, 'warning', 'ok')", "nj",
                "round_even(nj * 100 / n::DOUBLE, 1)",
                "printf('junction_name is ''No Junction'' or NULL for %s rows (%.1f%%) — use police_station"
                " or H3 as spatial grouping instead', format('{:,}', nj), nj * 100 / n::DOUBLE)",
            ),
            _dq_row(
                "summary", "if(geo / n::DOUBLE > 0.05, 'error', 'ok')", "if(dup = 0, 5, 4)", "NULL",
                "'1 errors'",
            ),
        ]
    )
)

_CORNERS = ", ".join(f"({i}, {60 * (i % 6) - 30})" for i in range(7))
_SHARE = "(violation_count / (SELECT max(violation_count) FROM heat)::DOUBLE)"
_PEAK = "(SELECT max(violation_count) FROM heat)"
_STREET_HEAT = _heat("count(id)", _STREET, "s", "f", True)
_CITY_HEAT = _heat("count(id)", _CITY, "c", "f", True)
_HEAT_COLUMNS = "cell_id, violation_count, top_violation, police_station, " + _r("lat", "lng")
_RANGE = f"date_ist BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'"
_STATION_PRIORITY = f"""{_r("priority_score")}, {_tier("priority_score")} AS priority_tier"""

ORACLES: dict[str, str] = {
    "scan_csv": _query(
        "v",
        """SELECT id::VARCHAR AS id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  violation_type, offence_code, created_datetime, closed_datetime, police_station, junction_name,
  vehicle_type, vehicle_number FROM v""",
    ),
    "sink_parquet_roundtrip": _query(
        "f",
        "SELECT id, primary_violation, cell_street, cell_city, coalesce(hour_ist, -1)::BIGINT AS hour_ist, date_ist::VARCHAR AS date_ist FROM f",
    ),
    "sink_csv_roundtrip": _query(
        "queue",
        f"""SELECT cell_id, {_r("priority_score")}, priority_tier, recommended_action, violation_count,
  is_hotspot, hotspot_rank, police_station, top_violation, {_r("lat", "lng")} FROM queue""",
    ),
    "scan_geojson": _query("f", f"SELECT {_HEAT_COLUMNS} FROM ({_CITY_HEAT})"),
    "parse_violation_types": _query(
        "parsed",
        "SELECT id, len(names)::BIGINT AS n, coalesce(array_to_string(names, '|'), '') AS names FROM parsed",
    ),
    "primary_violation": _query("parsed", "SELECT id, primary_violation FROM parsed"),
    "parse_offence_codes": _query(
        "parsed",
        "SELECT id, len(codes)::BIGINT AS n, coalesce(list_sum(codes), 0)::BIGINT AS code_sum FROM parsed",
    ),
    "coerce_timestamps": """SELECT event_id AS id, CASE event_id % 4 WHEN 2 THEN NULL
  WHEN 1 THEN date_trunc('second', ts) - INTERVAL '330' MINUTE ELSE date_trunc('second', ts) END AS created_datetime
  FROM events""",
    "time_features": _query(
        "parsed",
        """SELECT id, coalesce(hour(ist), -1)::BIGINT AS hour_ist, coalesce(isodow(ist) - 1, -1)::BIGINT AS day_of_week,
  coalesce(month(ist), -1)::BIGINT AS month, ist::DATE::VARCHAR AS date_ist FROM parsed""",
    ),
    "clean_junction": _query(
        "v", "SELECT id, trim(coalesce(junction_name, 'No Junction')) AS junction_name FROM v"
    ),
    "severity": _query(
        "parsed", f"SELECT id, primary_violation, ({_SEVERITY})::DOUBLE AS severity FROM parsed"
    ),
    "minmax_normalize": _query(
        "cells",
        f"""SELECT cell_id, round({_unit("violation_count", "cells", "violation_count")}, 6) AS scaled FROM cells""",
    ),
    "tier_case": _query(
        "scored",
        f"SELECT cell_id, {_tier('congestion_score')} AS tier, {_action('congestion_score')} AS action FROM scored",
    ),
    "dq_duplicate_ids": _query(
        "v",
        """SELECT (count(*) - count(DISTINCT id) - max((id IS NULL)::INT))::BIGINT AS duplicates FROM v""",
    ),
    "dq_duplicate_lineitem_keys": """SELECT (count(*) - (SELECT count(*) FROM
  (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)))::BIGINT AS duplicates FROM lineitem""",
    "dq_geo_outliers": _query(
        "v",
        """SELECT count(*) FILTER (NOT (latitude BETWEEN 12.7e0 AND 13.2e0
  AND longitude BETWEEN 77.3e0 AND 77.9e0)) AS geo_outliers FROM v""",
    ),
    "dq_closed_before_created": _query(
        "v", "SELECT count(*) FILTER (closed_datetime < created_datetime) AS bad_rows FROM v"
    ),
    "dq_shipped_before_ordered": """SELECT count(*) FILTER (l_shipdate < o_orderdate) AS bad_rows
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "dq_report": _DQ,
    "hex_bin": _query("f", "SELECT id, cell_street, cell_city FROM f"),
    "hex_centroid": _query(
        "f",
        f"SELECT DISTINCT cell_street AS cell_id, round({_LAT}, 6) AS lat, round({_LNG}, 6) AS lng FROM f",
    ),
    "hex_boundary": _query(
        "f",
        f"""SELECT cell_street AS cell_id, corner::BIGINT AS corner,
  round({_LNG} + {_STREET} * cos(radians(angle)) / 10848e-2, 6) AS lng,
  round({_LAT} + {_STREET} * sin(radians(angle)) / 11057e-2, 6) AS lat
  FROM (SELECT DISTINCT cell_street, sq, sr FROM f), (VALUES {_CORNERS}) c(corner, angle)""",
    ),
    "heatmap_street": _query("f", f"SELECT {_HEAT_COLUMNS}, {_r('avg_hour')} FROM ({_STREET_HEAT})"),
    "heatmap_city": _query("f", f"SELECT {_HEAT_COLUMNS}, {_r('avg_hour')} FROM ({_CITY_HEAT})"),
    "heatmap_date_range": _query(
        "f",
        f"""SELECT {_HEAT_COLUMNS} FROM (
  WITH g AS (SELECT * FROM f WHERE {_RANGE}) {_heat("count(*)", _STREET, "s", "g", False)})""",
    ),
    "heatmap_date_range_city": _query(
        "f",
        f"""SELECT {_HEAT_COLUMNS} FROM (
  WITH g AS (SELECT * FROM f WHERE date_ist >= DATE '{DATE_FROM}') {_heat("count(*)", _CITY, "c", "g", False)})""",
    ),
    "geojson_features": _query(
        "f",
        f"""SELECT 'Feature' AS type, 'Polygon' AS geometry_type, 7::BIGINT AS corners, true AS closed,
  {_HEAT_COLUMNS} FROM ({_STREET_HEAT})""",
    ),
    "density_bands": _query(
        "f",
        f"""SELECT cell_id, violation_count, round(share, 6) AS density, band::BIGINT AS band,
  {_ladder("share", fixed.DENSITY_BANDS)} AS band_label,
  floor(top * (band * 0.2e0) + 0.5e0)::BIGINT AS band_low,
  CASE WHEN band < 4 THEN floor(top * ((band + 1) * 0.2e0) + 0.5e0) ELSE -1 END::BIGINT AS band_high,
  floor(top * 0.25e0 + 0.5e0)::BIGINT AS tick_25, floor(top * 0.5e0 + 0.5e0)::BIGINT AS tick_50,
  floor(top * 0.75e0 + 0.5e0)::BIGINT AS tick_75, top AS tick_100
  FROM (SELECT *, CASE WHEN share < 0.2e0 THEN 0 WHEN share < 0.4e0 THEN 1 WHEN share < 0.6e0 THEN 2
                       WHEN share < 0.8e0 THEN 3 ELSE 4 END AS band
    FROM (SELECT cell_id, violation_count, max(violation_count) OVER () AS top,
                 violation_count / (max(violation_count) OVER ())::DOUBLE AS share FROM ({_STREET_HEAT})))""",
    ),
    "cell_features": _query(
        "cells",
        f"""SELECT cell_id, violation_count, {_r("severity_mean", "severity_sum", "hour_std", "weekday_pct",
        "recurrence_score", "lat", "lng")}, {_b("hour_peak", "vehicle_diversity", "unique_vehicles")},
  top_violation, top_vehicle, police_station FROM cells""",
    ),
    "station_features": _query(
        "stations",
        f"""SELECT police_station, violation_count, {_r("severity_mean", "severity_sum", "recurrence_score")},
  {_b("hour_peak", "unique_cells_street", "unique_cells_city", "unique_vehicles")},
  top_violation, top_vehicle FROM stations""",
    ),
    "temporal_profile": _query(
        "f",
        "SELECT cell_street AS cell_id, "
        + ", ".join(
            f"round(count(*) FILTER (hour_ist = {h}) / count(*)::DOUBLE, 6) AS hour_{h}" for h in range(24)
        )
        + " FROM f WHERE hour_ist IS NOT NULL GROUP BY cell_street",
    ),
    "recurrence_cell": _query(
        "f", f"SELECT cell_street AS cell_id, {_RECURRENCE} FROM ({_vehicles('f', 'cell_street')})"
    ),
    "recurrence_station": _query(
        "f", f"SELECT police_station, {_RECURRENCE} FROM ({_vehicles('f', 'police_station')})"
    ),
    "hot_cells": _query("hot", "SELECT cell_id, violation_count FROM hot"),
    "eps_neighbours": _query("pairs", "SELECT a_id AS a, b_id AS b FROM pairs"),
    "dbscan_clusters": _query("labelled", "SELECT cell_id, cluster_id, is_hotspot FROM labelled"),
    "hotspot_rank": _query("spots", "SELECT cell_id, cluster_id, hotspot_rank FROM spots"),
    "hotspot_density": _query(
        "spots", f"SELECT cell_id, cluster_id, {_r('hotspot_density')} FROM spots"
    ),
    "hotspot_summary": _query(
        "spots",
        f"""SELECT g.*, coalesce(a.v, 'UNKNOWN') AS top_violation, coalesce(b.v, 'UNKNOWN') AS top_station FROM (
  SELECT cluster_id, min(hotspot_rank) AS rank, sum(violation_count)::BIGINT AS total_violations,
         count(*) AS cell_count, round(avg(lat), 6) AS center_lat, round(avg(lng), 6) AS center_lng,
         round(avg(severity_mean), 6) AS avg_severity FROM spots WHERE is_hotspot GROUP BY cluster_id) g
  LEFT JOIN ({_mode("spots", "cluster_id", "top_violation")}) a USING (cluster_id)
  LEFT JOIN ({_mode("spots", "cluster_id", "police_station")}) b USING (cluster_id)""",
    ),
    "train_test_split": _query(
        "cells", f"SELECT cell_id, {_is_test('cell_id')} AS is_test FROM cells"
    ),
    "regression_metrics": _query(
        "predicted",
        f"""SELECT round(avg(abs(y - p)), 6) AS mae,
  round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2
  FROM (SELECT y, p, avg(y) OVER () AS m FROM (
    SELECT ln(1 + violation_count) AS y, congestion_raw AS p FROM predicted WHERE {_is_test("cell_id")}))""",
    ),
    "congestion_score": _query(
        "scored", f"SELECT cell_id, {_r('congestion_raw', 'congestion_score')} FROM scored"
    ),
    "station_congestion": _query(
        "scored_stations",
        f"""SELECT police_station, round(m, 6) AS congestion_score_mean, round(x, 6) AS congestion_score_max,
  round(p90, 6) AS congestion_score_p90, {_b("hotspot_cells", "total_cells")}, {_r("congestion_score")}
  FROM scored_stations""",
    ),
    "priority_queue": _query("queue", f"SELECT {_QUEUE_FLAT} FROM queue"),
    "priority_top50": _query(
        "queue",
        f"""SELECT {_QUEUE_FLAT} FROM (SELECT * FROM queue ORDER BY round(priority_score, 9) DESC, cell_id LIMIT 50)""",
    ),
    "station_priority": _query(
        "station_blend",
        f"""SELECT police_station, violation_count, {_r("congestion_score")}, {_STATION_PRIORITY},
  {_action("priority_score")} AS recommended_action FROM (
  SELECT *, {_unit("blend", "station_blend", "blend")} AS priority_score FROM station_blend)""",
    ),
    "station_priority_by_count": _query(
        "station_blend_count",
        f"""SELECT police_station, {_STATION_PRIORITY} FROM (
  SELECT *, {_unit("blend", "station_blend_count", "blend")} AS priority_score FROM station_blend_count)""",
    ),
    "tier_counts": _query("queue", "SELECT priority_tier, count(*) AS n FROM queue GROUP BY 1"),
    "queue_positions": _query(
        "queue",
        f"""SELECT cell_id, {_r("priority_score")},
  row_number() OVER (ORDER BY round(priority_score, 9) DESC, cell_id) AS position FROM queue""",
    ),
    "queue_filtered": _query(
        "queue",
        f"""SELECT cell_id, {_r("priority_score")}, priority_tier, police_station,
  CASE WHEN is_hotspot THEN hotspot_rank ELSE 0 END AS hotspot_rank FROM queue
  WHERE lower(police_station) = 'station 0' AND lower(priority_tier) = 'moderate'
  ORDER BY round(priority_score, 9) DESC, cell_id LIMIT 100""",
    ),
    "station_scorecard": _query("cards", f"SELECT {_CARD} FROM cards"),
    "station_lookup": _query("cards", f"SELECT {_CARD} FROM cards WHERE lower(name) = 'station 3'"),
    "station_factors": _query(
        "cards",
        _sentences(
            "cards",
            "CASE WHEN hotspot_cells > 0 THEN "
            + _printf(fixed.STATION_HOTSPOTS, "hotspot_cells", "total_cells")
            + " ELSE "
            + _printf(fixed.STATION_NO_HOTSPOTS, "total_cells")
            + " END",
            _printf(fixed.STATION_RECURRENCE, "recurrence_rate * 100"),
            _printf(fixed.STATION_SEVERITY, "severity_index"),
            _printf(fixed.STATION_PEAK, "peak_hour"),
        ),
    ),
    "junction_scorecard": _query(
        "jcards", f"SELECT {_CARD}, police_station, top_violation FROM jcards"
    ),
    "junction_lookup": _query(
        "jcards",
        f"""SELECT {_CARD}, police_station, top_violation FROM jcards
  WHERE contains(lower(name), 'junction 3') ORDER BY violation_count DESC, name LIMIT 1""",
    ),
    "junction_search": _query(
        "f",
        """SELECT junction_name, count(*) AS violation_count FROM f
  WHERE contains(lower(junction_name), 'junction') GROUP BY 1""",
    ),
    "junction_factors": _query(
        "jcards",
        _sentences(
            "jcards",
            _printf(fixed.JUNCTION_CONTEXT, "total_cells", "police_station"),
            _printf(fixed.JUNCTION_OFFENCE, "top_violation"),
            _printf(fixed.JUNCTION_RECURRENCE, "recurrence_rate * 100"),
            _printf(fixed.JUNCTION_SEVERITY, "severity_index"),
            _printf(fixed.JUNCTION_PROXY, "score"),
        ),
    ),
    "junction_cells_semi": _query(
        "jrows cells",
        """SELECT cell_id, violation_count FROM cells WHERE cell_id IN
  (SELECT cell_id FROM jrows WHERE junction_name = 'Junction 2')""",
    ),
    "threshold_alerts": _query(
        "rules cells",
        f"""SELECT r.cell_id, threshold, CASE WHEN violation_count IS NULL THEN 'not found' ELSE 'success' END AS status,
  coalesce(violation_count > threshold, false) AS alert_triggered, coalesce(violation_count, -1) AS current_count,
  CASE WHEN violation_count IS NULL THEN {_printf(fixed.ALERT_NOT_FOUND, "r.cell_id")}
       WHEN violation_count > threshold THEN {_printf(fixed.ALERT_FIRED, "violation_count", "threshold")}
       ELSE {_printf(fixed.ALERT_QUIET, "violation_count", "threshold")} END AS message
  FROM rules r LEFT JOIN cells c ON c.cell_id = r.cell_id""",
    ),
    "dashboard_stats": _query(
        "queue",
        """SELECT count(*) AS total_cells, sum(violation_count)::BIGINT AS total_violations,
  count(*) FILTER (priority_tier = 'IMMEDIATE') AS immediate_cells,
  count(*) FILTER (priority_tier = 'HIGH') AS high_cells,
  round(avg(congestion_score), 6) AS avg_congestion FROM queue""",
    ),
    "station_risk_panel": _query(
        "cards",
        f"""SELECT name, {_r("score")}, pct AS score_pct, {_ladder("score", fixed.RISK_LABELS)} AS risk_label,
  {_tier("score")} AS priority_tier, cover AS hotspot_pct,
  CASE WHEN cover = 100 THEN {_text(fixed.COVERAGE_FULL)} WHEN cover >= 50 THEN {_text(fixed.COVERAGE_HALF)}
       WHEN cover > 0 THEN {_text(fixed.COVERAGE_SOME)} ELSE {_text(fixed.COVERAGE_NONE)} END AS hotspot_text,
  {_ladder("recurrence_rate", fixed.RECURRENCE_TEXTS)} AS recurrence_text,
  {_ladder("severity_index", fixed.SEVERITY_TEXTS)} AS severity_text,
  printf('%02d:00', (peak_hour + 23) % 24) || '-' || printf('%02d:00', (peak_hour + 1) % 24) AS peak_window,
  {_ladder("pct", fixed.RANK_BANDS)} AS rank_band, rank() OVER (ORDER BY score DESC) AS score_rank
  FROM (SELECT *, floor(score * 100 + 0.5e0)::BIGINT AS pct,
     CASE WHEN total_cells > 0 THEN floor(hotspot_cells / total_cells::DOUBLE * 100 + 0.5e0) ELSE 0 END::BIGINT AS cover
     FROM cards)""",
    ),
    "city_totals": _query(
        "queue stations",
        """SELECT count(*) AS street_cells, (max(cluster_id) + 1)::BIGINT AS hotspot_clusters,
  count(*) FILTER (is_hotspot) AS hotspot_cells, (SELECT count(*) FROM f) AS total_rows,
  (SELECT count(DISTINCT cell_city) FROM f) AS city_cells, (SELECT count(*) FROM stations) AS stations,
  count(*) FILTER (priority_tier = 'IMMEDIATE') AS immediate, count(*) FILTER (priority_tier = 'HIGH') AS high,
  count(*) FILTER (priority_tier = 'MODERATE') AS moderate FROM queue""",
    ),
    "sliding_rate": _query(
        "slides", "SELECT *, round(violations / 10e0, 6) AS per_minute FROM slides"
    ),
    "running_peak_hour": _query(
        "f",
        """SELECT police_station, hour_ist::BIGINT AS peak_hour, n AS peak_violations FROM (
  SELECT police_station, hour_ist, count(*) AS n,
         row_number() OVER (PARTITION BY police_station ORDER BY count(*) DESC, hour_ist) AS rn
  FROM f WHERE police_station IS NOT NULL AND hour_ist IS NOT NULL
  GROUP BY police_station, hour_ist) WHERE rn = 1""",
    ),
    "cell_count_24h": _query(
        "f",
        """SELECT cell_street AS cell_id, date_trunc('hour', created_datetime) - h * INTERVAL '1' HOUR AS window_start,
  count(*) AS violations FROM f, range(24) t(h) WHERE created_datetime IS NOT NULL GROUP BY ALL""",
    ),
    "hourly_alerts": _query("hourly", "SELECT * FROM hourly WHERE current_count > threshold"),
    "score_drift": _query(
        "halves",
        """SELECT bin, coalesce(n_expected, 0) AS n_expected, coalesce(n_actual, 0) AS n_actual,
  round((p - q) * ln(p / q), 6) AS psi FROM (
  SELECT bin, n_expected, n_actual,
         greatest(coalesce(n_actual, 0) / (SELECT count(*) FROM halves WHERE late)::DOUBLE, 1e-4) AS p,
         greatest(coalesce(n_expected, 0) / (SELECT count(*) FROM halves WHERE NOT late)::DOUBLE, 1e-4) AS q
  FROM (SELECT bin, count(*) FILTER (NOT late) AS n_expected, count(*) FILTER (late) AS n_actual
        FROM halves GROUP BY bin))""",
    ),
}
# a stream over all input is its batch twin, and a stored table the one it was written from
ORACLES |= {
    "station_scorecard_stored": ORACLES["station_scorecard"],
    "heatmap_stored": _query("f", f"SELECT {_HEAT_COLUMNS} FROM ({_STREET_HEAT})"),
    "heatmap_date_range_stored": ORACLES["heatmap_date_range"],
    "heatmap_metadata": _query(
        "f",
        f"""SELECT 9::BIGINT AS resolution, '{DATE_FROM}' AS start, '{DATE_TO}' AS "end",
  count(DISTINCT cell_street)::BIGINT AS feature_count FROM f WHERE {_RANGE}""",
    ),
    "congestion_gbt_cells": _query("cells", "SELECT cell_id, true AS in_range FROM cells"),
    "congestion_gbt_nodes": _query("cells", "SELECT cell_id, true AS as_the_model FROM cells"),
    "congestion_gbt_model": """SELECT 0e0 AS low, 1e0 AS high, true AS fits_held_out_cells,
  7::BIGINT AS features, true AS shares_sum_to_100""",
    "priority_queue_gbt": f"SELECT * EXCLUDE (congestion_score) FROM ({ORACLES['priority_queue']})",
    "stream_peak_hour": ORACLES["running_peak_hour"],
    "stream_sliding_rate": ORACLES["sliding_rate"],
    "stream_cell_count_24h": ORACLES["cell_count_24h"],
    "stream_alerts": ORACLES["hourly_alerts"],
    "cell_features_by_day": ORACLES["cell_features"],
    "station_features_by_day": ORACLES["station_features"],
    "heatmap_date_range_by_day": ORACLES["heatmap_date_range"],
    "station_vehicles_sketch": _query(
        "f",
        """SELECT police_station, count(DISTINCT vehicle_number) AS unique_vehicles, true AS within_bound
  FROM f WHERE police_station IS NOT NULL AND vehicle_number IS NOT NULL GROUP BY police_station""",
    ),
    "closing_minutes_sketch": _query(
        "f",
        """SELECT police_station, count(*) AS n, true AS within_bound FROM f
  WHERE police_station IS NOT NULL AND created_datetime IS NOT NULL AND closed_datetime IS NOT NULL GROUP BY police_station""",
    ),
    "vehicle_drift_daily": _query(
        "f",
        f"""SELECT strftime(date, '%Y-%m-%d') AS date, CAST(total AS BIGINT) AS n, round(sum((p - q) * ln(p / q)), 6) AS psi FROM (
  SELECT d.date, total, greatest(coalesce(a.n, 0) / total, 1e-4) AS p, greatest(coalesce(e.n, 0) / (SELECT sum(n) FROM hist WHERE date IS NULL), 1e-4) AS q
  FROM (SELECT date, sum(n) AS total FROM hist WHERE date IS NOT NULL GROUP BY date) d CROSS JOIN (SELECT DISTINCT bin FROM hist) b
  LEFT JOIN hist a ON a.date = d.date AND a.bin = b.bin LEFT JOIN (SELECT bin, n FROM hist WHERE date IS NULL) e ON e.bin = b.bin) GROUP BY date, total""",
    ).replace("\nSELECT strftime", f""", each AS (
  SELECT cell_street, date_ist, count(DISTINCT vehicle_number) AS s FROM f
  WHERE cell_street IS NOT NULL AND date_ist IS NOT NULL AND vehicle_number IS NOT NULL GROUP BY ALL),
edges AS (SELECT list_distinct(quantile_disc(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM each WHERE date_ist < DATE '{DRIFT_DATE}'),
hist AS (
  SELECT CASE WHEN date_ist >= DATE '{DRIFT_DATE}' THEN date_ist END AS date, len(list_filter(e, lambda x: x < s)) AS bin, count(*) AS n
  FROM each, edges GROUP BY ALL)
SELECT strftime"""),
    "stream_alerts_live": ORACLES["hourly_alerts"],
    "stream_rate_without_copies": ORACLES["sliding_rate"],
    "scan_csv_mixed_headers": ORACLES["scan_csv"],
    "scan_csv_multiline": """SELECT event_id::VARCHAR AS id,
  'a "' || event_type || '",' || chr(10) || user_id || chr(10) AS junction_name FROM events""",
    "parse_dirty_json": """SELECT event_id AS id,
  CASE event_id % 8 WHEN 0 THEN '["A"] x' WHEN 1 THEN 'A|B' WHEN 2 THEN '99999999999' WHEN 3 THEN '112|x'
    WHEN 4 THEN '112' WHEN 5 THEN '99999999999' WHEN 6 THEN '1.5' ELSE '"A" "B"' END AS names,
  CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 7 THEN 0 ELSE 1 END::BIGINT AS n,
  CASE event_id % 8 WHEN 2 THEN 99999999999 WHEN 5 THEN 99999999999 WHEN 3 THEN 112 WHEN 4 THEN 112
    ELSE 0 END::BIGINT AS code_sum
  FROM events""",
    "coerce_zoned_timestamps": """SELECT event_id AS id, date_trunc('second', ts) + CASE event_id % 6
  WHEN 0 THEN INTERVAL '-330' MINUTE WHEN 2 THEN INTERVAL '180' MINUTE WHEN 3 THEN NULL
  ELSE INTERVAL '0' MINUTE END AS created_datetime FROM events""",
}
