"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where a local session without `spark.checkpoint.dir` keeps the folder it made.
OWN_FOLDER = "specengine.checkpoint.dir"
#: Setting and bytes of a batch for Python steps.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("specengine")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPECENGINE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python step gets at once by bytes, not by rows alone, unless the session says otherwise."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per session; Python steps import it there.

    The archive lies on the driver, which serves it to every executor, later ones too.
    """
    bound_batches(spark)
    if spark.conf.get("specengine.shipped", None):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="specengine-zip-")), "specengine.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("specengine", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("specengine.shipped", "true")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the cluster names in `spark.checkpoint.dir`.  Only a local
    session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="specengine-")
    spark.conf.set(OWN_FOLDER, folder)  # Spark's own setting can't be changed in a running session
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Store a frame in the shared folder, so that later reads see the same rows and places."""
    spark = df.sparkSession
    folder = checkpoint_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back.

    Unlike a checkpoint, the result has the sizes of its files: estimates of a
    loop over stored frames don't multiply from round to round.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than that (one file, one row group).

    A large input already has enough splits and is left alone, so this never
    adds a shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def spread_work(df: DataFrame, *keys: str) -> DataFrame:
    """Place compact rows on all shuffle partitions before a step that is heavy per row.

    Adaptive execution merges small shuffle partitions by bytes; a peptide is a
    few bytes but costs hundreds of microseconds to expand, so the number of
    partitions is fixed here.  The key is hashed once more, because a plain
    repartition by the key of the preceding aggregation would be dropped.
    """
    return df.repartition(shuffle_partitions(df), F.xxhash64(*keys))


def partitions_for(df: DataFrame, rows_per_task: int) -> int:
    """Partitions of at most about `rows_per_task` rows, at least one per core; the rows are counted.

    A number given to `repartition` is kept: adaptive execution would merge
    partitions up to a size in compressed bytes, whatever their rows need in
    memory.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
