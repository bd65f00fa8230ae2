"""Spark session with the settings that the engine is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "vellum", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; ``conf`` adds or overrides settings (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
