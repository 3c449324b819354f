"""Session construction for tests and the benchmark.

On a cluster the caller owns the session; nothing in the library creates one.
These helpers only fill in settings that are *unset*, so cluster-provided
values (shuffle partitions, checkpoint dir, AQE knobs) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  Time zone matters because the
# provided tables store timestamps without zone and week keys are derived from
# them; AQE coalesces small shuffles and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "weekcast") -> SparkSession:
    """Local session for tests / bench.  ``master`` defaults to local[$BENCH_CPUS or *]."""
    cpus = os.environ.get("BENCH_CPUS", "*")
    builder = (SparkSession.builder
               .master(master or f"local[{cpus}]")
               .appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("WEEKCAST_DRIVER_MEMORY", "16g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the package defaults on an existing session where they are unset."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared filesystem); it
    is read from the session, or else from the folder given to the context.
    Only when both are unset (local tests) a fresh temporary folder is
    created and registered.
    """
    sc = spark.sparkContext
    key = "spark.checkpoint.dir"
    d = spark.conf.get(key, None) or sc.getConf().get(key, None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="weekcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:  # each call would add a fresh subfolder
        sc.setCheckpointDir(d)
    return d
