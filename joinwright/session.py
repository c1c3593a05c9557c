"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "joinwright", **conf: str) -> SparkSession:
    """ANSI mode stays on and the time zone is UTC. Adaptive execution sizes shuffles and splits skewed joins."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
