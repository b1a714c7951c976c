"""Spark session defaults for the engine.

On a cluster the session comes from the platform; ``configure`` only fills in
settings the session has left unset, so cluster-wide values always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the rule engine relies on.  Values already present in the session
# are never overwritten.
ENGINE_DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The full flagged table is ~250 columns wide; keep whole-stage codegen on.
    "spark.sql.codegen.maxFields": "100",
}


# Broadcast policy: never broadcast on a planner *estimate* (an aggregate by id
# can be estimated small and be huge); AQE broadcasts a join side only after
# measuring its real shuffle output, and keeps the shuffle join otherwise.
# Applied when the session still has Spark's built-in 10 MB static threshold.
BROADCAST_POLICY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
}


def _reach_package(spark: SparkSession) -> None:
    """Let the Python workers of a local master import this package wherever the driver was
    started; on a cluster the package is installed or shipped (``--py-files``)."""
    if spark.sparkContext.master.startswith("local"):
        home, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if home not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, home])


def configure(spark: SparkSession) -> SparkSession:
    """Apply ENGINE_DEFAULTS where the session has no value of its own."""
    _reach_package(spark)
    for key, value in ENGINE_DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10485760", "10MB") and \
            spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) in (None, ""):
        for key, value in BROADCAST_POLICY.items():
            spark.conf.set(key, value)
    # The timestamp rules (D6, D7) read hours in the session's zone: UTC, unless the
    # application was started with a zone of its own (then hours are that zone's).
    if not spark.sparkContext.getConf().contains("spark.sql.session.timeZone"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    ``spark.checkpoint.dir`` is a static setting, read from the session.  Only
    when it is unset (local tests) a scratch folder is registered through
    ``setCheckpointDir`` and reused for the rest of the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    existing = sc._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not sc.master.startswith("local"):
        # A machine-local folder is invisible to other executors and lost with them.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for cluster runs")
    local = tempfile.mkdtemp(prefix="fieldlens-ckpt-")  # tests / local runs only
    sc.setCheckpointDir(local)
    return sc._jsc.sc().getCheckpointDir().get()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fieldlens") -> SparkSession:
    """Local session for tests and the bench (UI off, no server opened)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FIELDLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**ENGINE_DEFAULTS, **BROADCAST_POLICY}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
