"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Runtime settings the programs rely on. Anything the cluster sets at launch wins.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more (small) exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above unless the cluster has its own."""
    launched_with = spark.sparkContext.getConf()
    for key, value in RUNTIME_SETTINGS.items():
        if not launched_with.contains(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "tallyhouse") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@cache
def _temporary_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach.

    It lies under ``spark.checkpoint.dir``. Without that setting only a session on one machine
    goes on, with a local temporary folder; a cluster's executors could not read each other's.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        # local-cluster and every cluster manager run executors of their own.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _temporary_dir(spark.sparkContext.applicationId)
    return f"{shared.rstrip('/')}/tallyhouse/{purpose}-{uuid.uuid4().hex}"
