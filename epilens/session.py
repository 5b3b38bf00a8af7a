"""Session construction and shared-folder helpers.

Everything here is plain SparkSession configuration. AQE stays on so that
joins between two aggregates are re-planned from their *measured* size:
a side under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` becomes a
broadcast hash join, anything larger stays a sort-merge join (with skew
splitting). No operator in this package forces a broadcast of data whose
size grows with the input.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting point for ~100 TB of input on a large cluster. Scans: ~512 MB
# splits. The one large shuffle (orders x customers on the customer key, four
# narrow columns) is a few TB: 20,000 initial partitions keep each near
# 200 MB; everything after the first aggregate is small and AQE coalesces it
# to ~256 MB partitions. A partition over 512 MB and 5x the median is split
# by the skew join.
CLUSTER_CONF: dict[str, str] = {
    "spark.sql.files.maxPartitionBytes": "512MB",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    # coalesce to the advisory size, not to the default parallelism: no
    # swarm of near-empty tasks after the aggregates on a shared cluster
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "epilens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
    cluster: bool = False,
) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster pass ``master=None`` (spark-submit decides) and
    ``cluster=True`` for the large-input sizing above.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster names that folder; only in local mode, and only when it is
    unset, do we pick one of our own: on a cluster a machine-local folder
    would be read by other machines that don't have it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="epilens-ckpt-")
    sc.setCheckpointDir(path)
    # setCheckpointDir adds a per-application sub-folder; staged files sit
    # next to it under the named root.
    return path


_STAGED: list[tuple[SparkSession, str]] = []


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder. It
    stays until ``release_staging`` or the end of the program: lazy results
    may still read it."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "epilens-staging", f"{label}-{uuid.uuid4().hex}")
    if not _STAGED:
        atexit.register(_release_at_exit)
    _STAGED.append((spark, path))
    return path


def release_staging(spark: SparkSession) -> None:
    """Delete everything that this program staged through ``spark``; call it
    once the results are consumed."""
    jvm, sc = spark._jvm, spark.sparkContext
    for entry in [e for e in _STAGED if e[0] is spark]:
        path = jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _STAGED.remove(entry)


def _release_at_exit() -> None:
    for spark in {id(e[0]): e[0] for e in _STAGED}.values():
        if spark.sparkContext._jsc is not None:
            release_staging(spark)
