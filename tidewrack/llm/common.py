"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import fresh_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Byte table: A-Z to a-z, everything that is not 0-9, a-z or part of a non-ASCII character to a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see, below spark.checkpoint.dir; it goes when the JVM ends."""
    return fresh_folder(spark, "step")


def step_table(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a step table whose rows have gone into a later one."""
    spark = df.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the cheap way where the text is all ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows: those whose hash of the key columns is smallest.

    The table is counted first, and only the share of hashes that holds about
    so many rows is sorted, so that tasks do not each send ``rows`` rows. Rows
    that agree in the keys come or stay away together, up to the bound.
    """
    n = df.count()
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 32))
    found = df if n <= rows else df.filter(place < int((1 << 32) * min(1.0, 1.2 * rows / n)))
    return found.orderBy(place, *keys).limit(rows)


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def release_memory() -> None:
    """Give back what Arrow keeps of freed batches, in a worker that Spark uses again."""
    pa.default_memory_pool().release_unused()


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
