"""Session defaults for tests, the benchmark and interactive use.

On a cluster the submitter's settings win; nothing in the library depends on
these values beyond ordinary Spark defaults.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "wayfold", cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session with adaptive execution, UTC and the web page off."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
