"""Sessions with the settings the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillstream.shipping import ship


def get_session(master: str | None = None, name: str = "quillstream", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; ``conf`` overrides, with dots written as __."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false"
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    ship(session)  # functions wrapped from here on find the package on executors
    return session
