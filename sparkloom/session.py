"""Session defaults used by tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", name: str = "sparkloom", **conf: str) -> SparkSession:
    """A local session; on a cluster, pass the session that the cluster gives instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
