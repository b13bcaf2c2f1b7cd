"""Spark session helpers.

The library never creates its own cluster settings when a session already
exists: every operator takes the caller's ``SparkSession`` (or a DataFrame)
and only reads configuration from it.  ``get_session`` is a convenience for
tests, the bench and local runs.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "pagewise") -> SparkSession:
    """Return the active session, or build a local one tuned for small runs.

    AQE stays on so that shuffle partitions coalesce at run time and skewed
    join partitions (one huge document) are split by the skew-join rule.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("PAGEWISE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("PAGEWISE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # checkpoint files of materialised tables are removed once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAGEWISE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it this raises, because a machine-local folder would not
    be seen by the other machines.  Only a ``local[...]`` master (tests) gets
    a scratch folder of its own.
    """
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="pagewise-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


#: Bytes of a batch of rows that Spark hands to Python.
BATCH_BYTES = 4 << 20


def bounded_batches(df):
    """``df``, in a session whose batches for Python are bounded by bytes too:
    10,000 rows of long texts, twice in memory, may be gigabytes.  A cluster's
    own setting stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.sparkContext.getConf().get(setting, None) is None:
        df.sparkSession.conf.set(setting, str(BATCH_BYTES))
    return df


def stage(df, partition_by: list[str] | None = None):
    """Write ``df`` once as parquet into the shared checkpoint folder and
    return a DataFrame that reads it back.

    Columnar, so later branches prune columns and push filters; committed
    files survive a lost executor; the lineage ends here."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and return a
    DataFrame reading it back: later jobs neither re-plan nor recompute the
    upstream plan, and a lost executor does not force recomputation from
    the sources.  (Reliable ``checkpoint``, never a local one.)"""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df, how: str | None = None, columnar: bool = False):
    """Materialise a DataFrame that several branches of a plan read.

    ``how`` (default: the session setting ``pagewise.materialize``, else
    ``checkpoint``): ``checkpoint`` writes it once to the shared checkpoint
    folder and cuts the lineage (survives executor loss without going back
    to the sources; the files are removed once unreferenced when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on), as parquet
    if ``columnar`` (``stage``: for wide tables and texts -- compressed, and
    branches read the columns they need);
    ``persist`` caches it on the executors (memory, then disk; recomputed
    from lineage if an executor is lost; stays cached until the caller
    unpersists it); ``none`` leaves the plan as is."""
    from pyspark import StorageLevel
    mode = how or df.sparkSession.conf.get("pagewise.materialize", "checkpoint")
    if mode == "checkpoint":
        return stage(df) if columnar else cut_lineage(df)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df
