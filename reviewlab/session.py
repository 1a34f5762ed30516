"""Session and scratch-space helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "reviewlab", cpus: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the ambient one."""
    parts = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    A local session (tests, the bench) that names none gets a fresh folder;
    on a cluster that is an error, as executors don't share local folders.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    d = sc.getCheckpointDir()
    if d:
        return d
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="reviewlab-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint root for written intermediate tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/reviewlab/{name}-{uuid.uuid4().hex[:12]}"


#: Spark removes a query's shuffle files as it ends; without it, once the driver's garbage collector finds them unused.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str, partition_by: tuple = (), codec: str = "zstd") -> None:
    """df as Parquet; the shuffle files of this one write go with it, as its readers have the table."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    w = df.write.option("compression", codec)
    conf.set(CLEANUP, "true")
    try:
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def spread(df: DataFrame, key: str, text: str) -> DataFrame:
    """df dealt out by key and text over spark.sql.shuffle.partitions tasks, before work on whole texts: a file
    of few row groups is read by as few tasks, however large it is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, text)


def written(df: DataFrame, name: str, partition_by: tuple = ()) -> DataFrame:
    """df as Parquet below the checkpoint root, read back: columns are pruned and filters
    pushed by its readers, and nothing is lost with an executor."""
    path = scratch_path(df.sparkSession, name)
    save(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
