"""Session defaults and the shared checkpoint/work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (broadcast only
# when the measured side is under the threshold) and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(master: str | None = None, app: str = "rivulet",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, stream checkpoints and written tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file system).
    Only when it is unset and the master is local (tests) a private temporary folder is made
    and registered; on a cluster such a folder would differ on every machine, so it raises.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="rivulet-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def new_work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared work root (never reused between runs)."""
    root = work_root(spark)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith("/") or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


def materialize(df, name: str, with_path: bool = False):
    """Cut lineage by writing ``df`` as a table in the shared work folder and reading it
    back (one job; survives executor loss, unlike a cache)."""
    path = new_work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return (out, path) if with_path else out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote (staging tables, superseded snapshots) through
    the Hadoop file system of the path, so it works on cluster storage too."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, through its Hadoop file system; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def stream_session(spark: SparkSession) -> SparkSession:
    """A child session (same SparkContext, own SQL settings) for a streaming query.

    A stateful query fixes its number of state partitions from
    ``spark.sql.shuffle.partitions`` at its first start; one per core of the cluster
    (``defaultParallelism``) keeps every state partition busy without hundreds of idle
    tasks per micro-batch. The caller's session is left as it is."""
    child = spark.newSession()
    child.conf.set("spark.sql.shuffle.partitions",
                   str(max(1, spark.sparkContext.defaultParallelism)))
    child.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return child
