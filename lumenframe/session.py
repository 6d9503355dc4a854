"""A session with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("lumenframe")
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
