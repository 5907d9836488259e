"""The session the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "larkspur", **conf: str) -> SparkSession:
    """A session with ANSI mode, adaptive execution and UTC; conf: further settings, dots as two underscores."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
