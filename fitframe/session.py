"""Session helpers: a local session for tests/bench and the checkpoint folder rule.

On a cluster the checkpoint folder is whatever the cluster names in
``spark.checkpoint.dir`` (a shared, fault-tolerant file system).  We only
pick our own folder when that setting is absent *and* Spark runs in local
mode, which is the test / bench situation.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "fitframe") -> SparkSession:
    """A local[N] session configured the way the tests and the bench expect."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FITFRAME_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, total_cores: int,
                 target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Session settings for a cluster run over ``input_bytes`` of input.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (at least 3 waves of the cluster's cores, at most 200k).  AQE then
    coalesces small ones and splits skewed ones, so every task's partition
    fits in executor memory.  Files are split at the same size.  The
    checkpoint folder must still be set by the cluster (a shared file
    system); it is not chosen here.
    """
    parts = max(3 * total_cores, min(200_000, -(-input_bytes // target_partition_bytes)))
    size = str(target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it from the session conf.

    Order: an already-set SparkContext folder, then ``spark.checkpoint.dir``
    from the session / SparkConf.  Only a local-mode session with neither
    gets a fresh folder of its own (tests).  A cluster session without the
    setting is an error: a machine-local folder would not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/...) before running operators that cut lineage")
    folder = tempfile.mkdtemp(prefix="fitframe-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: materialise ``df`` in the checkpoint folder.

    Used where two passes over the same rows must see identical partitions
    (global rank, running sums) and where a lost executor must not trigger a
    recomputation that could reorder rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHUFFLE = ("Exchange hashpartitioning", "Exchange rangepartitioning",
            "Exchange SinglePartition", "Exchange RoundRobinPartitioning")


def reuse_if_shuffled(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once when several passes will read it and its plan
    shuffles (e.g. a join whose dimension side was too big to broadcast).

    Fitted pipelines read the same joined table once per statistic; when
    that table is a scan plus broadcast joins, re-reading is cheaper than
    writing a copy, so ``df`` is returned as is.  When the planned physical
    plan contains a shuffle exchange, every pass would repeat it, so the
    (usually narrow) result is checkpointed once instead.
    """
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    except Exception:
        return df
    return cut_lineage(df) if any(m in plan for m in _SHUFFLE) else df
