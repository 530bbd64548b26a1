"""Monitoring queries over tables; the same plans run on streams. An extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.queries.base import query
from lodestone.streaming import monitor


@query("SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS start, method, count(*) AS n, round(avg(preprocess_ms + inference_ms + postprocess_ms), 6) AS mean_ms, count(*) FILTER (WHERE outcome = 'empty') AS abstained, count(*) FILTER (WHERE outcome = 'error') AS errors FROM runs GROUP BY 1, 2")
def ext_latency_windows(v):
    return monitor.windows(v.runs.withColumn("created_at", F.col("created_at").cast("timestamp")))


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k")
def ext_session_runs(v):
    e = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.sessions(e)
