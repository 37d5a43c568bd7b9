"""A session with the settings the operators rely on; sizes are left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gridloom", **settings: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (conf | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
