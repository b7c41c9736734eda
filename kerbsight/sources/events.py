"""Violation records derived from an `events` table that has no coordinates of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The same text runs in other SQL engines, hence exact double literals and no functions
# whose results differ between engines. `{events}` is the input relation.
VIOLATIONS_SQL = """
SELECT event_id AS id,
  CASE WHEN event_id % 500 = 0 THEN 20e0
       ELSE 1280e-2 + 9e-2 * CAST(s % 4 AS DOUBLE) + 3e-2 * u * u * u END AS latitude,
  CASE WHEN event_id % 500 = 0 THEN 70e0
       ELSE 7740e-2 + 15e-2 * floor(CAST(s AS DOUBLE) / 4e0) + 3e-2 * w * w * w END AS longitude,
  CASE (event_id + user_id) % 20
       WHEN 0 THEN NULL WHEN 1 THEN 'MALFORMED' WHEN 2 THEN '"WRONG PARKING"' WHEN 3 THEN '[]'
       ELSE concat('["', CASE event_type WHEN 'click' THEN 'NO PARKING' WHEN 'view' THEN 'WRONG PARKING'
            WHEN 'error' THEN 'PARKING IN A MAIN ROAD' WHEN 'signup' THEN 'PARKING ON FOOTPATH'
            ELSE 'DOUBLE PARKING' END, '","OBSTRUCTIVE PARKING"]') END AS violation_type,
  CASE event_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN '112'
       ELSE '[112,104]' END AS offence_code,
  CASE WHEN event_id % 997 = 0 THEN NULL ELSE ts END AS created_datetime,
  CASE WHEN event_id % 3 = 0 THEN NULL
       ELSE ts + (event_id % 97 - 2) * INTERVAL '1' HOUR END AS closed_datetime,
  CASE WHEN event_id % 1009 = 0 THEN NULL
       WHEN event_id % 29 = 0 THEN concat('Station ', (s + 1) % 12)
       ELSE concat('Station ', s) END AS police_station,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'No Junction'
       ELSE concat('  Junction ', s % 6, ' ') END AS junction_name,
  CASE (user_id + event_id % 5) % 7
       WHEN 0 THEN 'CAR' WHEN 1 THEN 'SCOOTER' WHEN 2 THEN 'MOTOR CYCLE' WHEN 3 THEN 'LGV'
       WHEN 4 THEN 'MAXI-CAB' WHEN 5 THEN 'PASSENGER AUTO' ELSE NULL END AS vehicle_type,
  CASE WHEN event_id % 101 = 0 THEN NULL
       ELSE concat('KA', (event_id * event_id + user_id) % 3001) END AS vehicle_number
FROM (
  SELECT event_id, user_id, event_type, ts,
         CAST(floor(CAST((user_id % 12) * (event_id % 12) AS DOUBLE) / 12e0) AS BIGINT) AS s,
         CAST((event_id * 7919 + user_id * 31) % 997 AS DOUBLE) / 997e0 AS u,
         CAST((event_id * 104729 + user_id * 17) % 991 AS DOUBLE) / 991e0 AS w
  FROM {events}) AS b
"""


def violations_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    return spark.sql(VIOLATIONS_SQL, events=events)


def read_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violation records of a data folder, row by row, whatever its size."""
    return violations_from_events(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
