"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stratagrade", **settings: str) -> SparkSession:
    conf = {
        "spark.sql.caseSensitive": "true",  # headers that differ in case only are different
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(name).config(map=conf | settings).getOrCreate()
