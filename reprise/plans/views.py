"""The driver's tables as the relations that operators work on, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.session import table

# Rows that come again differ in ingested_at only, so any of them will do.
SOURCES_SQL = "sources AS (SELECT DISTINCT ON (source_id) * FROM source_records)"
ITEMS_SQL = "items AS (SELECT DISTINCT ON (item_id) * FROM workload_items)"
REQUESTS_SQL = "requests AS (SELECT DISTINCT ON (engine_request_id) * FROM request_metrics)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_records").drop("ingested_at").dropDuplicates(["source_id"])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "workload_items").drop("ingested_at").dropDuplicates(["item_id"])


def requests(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct requests; only the columns named, so that no more is shuffled."""
    rows = table(spark, sf_dir, "request_metrics")
    return rows.select("engine_request_id", *(c for c in columns if c != "engine_request_id")).dropDuplicates(["engine_request_id"])


def arm_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rows of the cold and warm arms, in the order in which they started: (started_at, engine_request_id)."""
    rows = requests(spark, sf_dir, "item_id", "arm", "started_at", *columns).where("arm IN ('cold', 'warm')")
    return rows.withColumn("ordinal", F.struct("started_at", "engine_request_id"))
