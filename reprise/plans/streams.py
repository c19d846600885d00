"""Queries on the streaming operators, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.plans.audit import FOLD_SQL
from reprise.session import shared_folder, table
from reprise.streaming import audit, windows


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark, 'stream')}/stream-{uuid.uuid4().hex}"


def sp01_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertised, kept and superseded tokens of every request, folded from a stream of raw lines."""
    schema = table(spark, sf_dir, "connector_audit_raw").schema
    # A pattern, as a stream takes a plain path for a folder; the table may be a folder or a file.
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/connector_audit_raw.parque[t]")
    return audit.run_to_end(spark, audit.fold_stream(lines), _folder(spark), ["request_id"], "event_count")


def sp09_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour."""
    return windows.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour").select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("total", 4).alias("total"))


def sp10_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions, ended by half an hour without an event."""
    s = windows.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "30 minutes")
    return s.select("user_id", F.unix_micros("start").alias("start"), "n")


def sp07_still_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a finished warm request, as a restarted run would take them up."""
    done = table(spark, sf_dir, "request_metrics").where("arm = 'warm' AND error IS NULL")
    items = table(spark, sf_dir, "workload_items").select("item_id").distinct()
    return windows.new_only(items, done, ["item_id"])


def sp06_first_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's first request with an output."""
    r = table(spark, sf_dir, "request_metrics").withColumn("o", F.struct("started_at", "engine_request_id"))
    return windows.first_per_run(r, "run_id", "output_text", "o").select("run_id", "output_text", F.col("o.engine_request_id").alias("engine_request_id"))


QUERIES = {f.__name__: f for f in (sp01_stream_fold, sp06_first_payloads, sp07_still_to_do, sp09_tumbling, sp10_sessions)}
ORACLES = {
    "sp01_stream_fold": f"WITH {FOLD_SQL} SELECT request_id, advertised_tokens, advertised_boundary, advertise_count, materialized_tokens, superseded_tokens, event_count FROM folded",
    "sp06_first_payloads": "SELECT run_id, arg_min(output_text, (started_at, engine_request_id)) AS output_text, min((started_at, engine_request_id))[2] AS engine_request_id FROM request_metrics WHERE output_text IS NOT NULL GROUP BY 1",
    "sp07_still_to_do": "SELECT DISTINCT item_id FROM workload_items WHERE item_id NOT IN (SELECT item_id FROM request_metrics WHERE arm = 'warm' AND error IS NULL)",
    "sp09_tumbling": "SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sp10_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k",
}
