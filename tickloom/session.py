"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine relies on.  Sizes are starting points for a cluster: AQE
# coalesces or splits shuffle partitions at run time, so the initial partition
# count can stay generous without leaving tiny reduce tasks behind.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # one task per folder would cost more than listing it
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's settings; ``conf`` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path for tables the engine writes on its own behalf.

    It lies under the cluster's shared checkpoint folder, so executors on any
    host see it.  Only where the cluster names none (local runs, tests) is a
    machine-local folder made and set for the rest of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts share")
        base = tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
