"""Queries on raw event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.operators.quarantine import rejected_lines, valid_events
from reprise.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fail to load, with the first reason."""
    return rejected_lines(table(spark, sf_dir, "connector_audit_raw")).select("line_id", "reason")


def p2_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that load, as typed rows."""
    return valid_events(table(spark, sf_dir, "connector_audit_raw"))


def p2_valid_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed fields of lines that load, without their payloads."""
    return p2_valid_rows(spark, sf_dir).drop("payload")


def p2_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rejected_lines(table(spark, sf_dir, "connector_audit_raw"))
    return lines.groupBy("source_file", "line_format", "reason").agg(F.count("*").alias("n_lines"))


QUERIES = {"p2_found": p2_found, "p2_valid_rows": p2_valid_rows, "p2_valid_fields": p2_valid_fields, "p2_reason_counts": p2_reason_counts}
ORACLES: dict[str, str] = {}
