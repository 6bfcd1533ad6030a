"""Spark session and lineage helpers.

Every operator in this package is lazy and returns a DataFrame. The only
places that cut lineage are the helpers below, which write a reliable
checkpoint into the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "resolvr",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster, ``master`` stays None and the launcher decides; local runs
    pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # timestamp arithmetic below assumes UTC wall clock for NTZ casts
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Uses ``spark.checkpoint.dir`` (or a directory already set on the
    context). Only a local-mode session without one gets a private temp
    folder; a cluster session without a shared folder is an error, since a
    machine-local folder would not survive the loss of that machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no local context: the conf must name the folder
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS / object store) before running jobs that cut lineage")
    path = tempfile.mkdtemp(prefix="resolvr-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def importable(spark: SparkSession) -> None:
    """Lets the Python workers of a local session find this package as the
    driver does; on a cluster it is shipped with the job (``--py-files``)."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        known = sc.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: writes the rows to the shared checkpoint folder
    and returns a DataFrame that reads them back (lineage cut, survives
    executor loss, consistent across the branches that reuse it)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a fresh folder under the shared
    checkpoint folder and return a DataFrame reading it back: lineage cut,
    columnar re-reads with pruning and pushdown, survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for hand-off tables.
    Only Spark's writers create it, on the file system the folder names; the
    driver's own disk is never touched."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
