"""Small tables kept between steps, and group statistics put on rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cols, keyed, matches

_local: dict[str, str] = {}  # application -> folder, for local sessions without a shared one


def _base(spark: SparkSession) -> str:
    """The folder all executors share, of the setting or of setCheckpointDir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    stated = spark.sparkContext._jsc.sc().getCheckpointDir()
    if stated.isDefined():
        return stated.get()
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return ""
    raise ValueError("set spark.checkpoint.dir: step tables need a folder that all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application that all executors see, below the cluster's checkpoint folder.

    Only a local session may go without one; it gets a temporary folder.
    """
    app, base = spark.sparkContext.applicationId, _base(spark)
    if not base:
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="tidewrack-")
        base = _local[app]
    return f"{base.rstrip('/')}/tidewrack/{app}/{name}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A shared folder for one table of its own, removed when the JVM ends."""
    folder = shared_folder(spark, uuid.uuid4().hex)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/{name}"


def settled(df: DataFrame) -> DataFrame:
    """The table written out and read back.

    Cuts the lineage in a way that survives lost executors, and gives Spark
    the table's true size: a join with it is broadcast only if it is small
    enough, and the other side is not shuffled first to find that out.
    """
    path = fresh_folder(df.sparkSession, "step")
    names = df.columns
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))]).schema
    return df.sparkSession.read.schema(plain).parquet(path).toDF(*names)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put one row of statistics per group on every row of the group.

    An aggregate joined back instead of a window over the whole group: a
    window would buffer each group in one task. The statistics are settled
    first (this runs them), so a few groups are broadcast and the rows stay
    where they are; with many groups it is a shuffle join, in which AQE
    splits hot groups. Without grouping keys the single row comes in as a
    scalar subquery.
    """
    values = [c for c in stats.columns if c not in by]
    if not by:
        one = stats.select(F.struct(*cols(values)).alias("_s")).scalar()
        return df.withColumn("_s", one).select(
            *cols(df.columns), *[F.col("_s").getField(v).alias(v) for v in values]
        )
    right = keyed(settled(stats), by)
    return df.join(right, matches(df, right, by), "left").select(*cols(df.columns), *cols(values))
