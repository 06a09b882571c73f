"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "stemma", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and the given settings; the cluster's own settings stay."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    return builder.config(map=defaults | conf).getOrCreate()
