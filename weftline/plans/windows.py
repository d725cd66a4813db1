"""Windows over the event stream (group K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.registry import query, table
from weftline.streaming import windows


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def k01_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling_counts(table(spark, sf, "events"), "1 hour").selectExpr("window_start", "event_type", "n", "round(total, 4) as total")


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, sid""")
def k02_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(table(spark, sf, "events"), "30 minutes")


@query("""SELECT w AS window_start, event_type, count(*) AS n FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 15 minute, ts), time_bucket(INTERVAL 15 minute, ts) - INTERVAL 15 minute]) AS w FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2""")
def k03_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding_counts(table(spark, sf, "events"), "30 minutes", "15 minutes")
