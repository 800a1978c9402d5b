"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "tessera", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine assumes; a cluster brings its own."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    return builder.config(map=settings | conf).getOrCreate()


def on_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers started for this session import the package from where it lies here.

    On a cluster the package is installed or sent with ``--py-files``; the path
    is then harmless.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
