"""What operators need to know about the session they run in."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where it is unset (tests), one under the warehouse."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later stages don't compute it anew, and lost executors lose none of it."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)  # with the session
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of df (in any case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, with which Spark drops the shuffle files of finished queries."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of the maps below: two megabytes, whatever they are made from.
MAP_BITS = 1 << 24


def bitmap(at: Column, df: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits with the bits `at` of df's rows: built on executors, 4 KB a row, bounded on the driver.

    What a map holds in excess is for its user to tell, by a join of the rows in it.
    """
    rows = df.select(at.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    out = np.zeros(MAP_BITS // 8 + 8192, np.uint8)
    for r in rows:  # buckets are counted from 1; position 0 of bucket 1 is h = 1, and h = 0 is in bucket 0
        raw = np.frombuffer(r["m"], np.uint8)
        a = r["b"] * 4096
        out[a : a + len(raw)] |= raw
    return out


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    bucket, position = np.where(h > 0, 1 + (h - 1) // 32768, 0), np.where(h > 0, (h - 1) % 32768, 0)
    return ((bits[bucket * 4096 + position // 8] >> (position % 8).astype(np.uint8)) & 1).astype(bool)
