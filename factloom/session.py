"""A session with settings that suit these queries."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "factloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override and add (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
