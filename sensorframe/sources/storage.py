"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession


#: Vectored reads keep, outside the heap, a buffer as large as a whole column chunk for every thread that ever read one from a local or
#: mounted file system. Plain reads take the chunk into the heap, where it is freed.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def dealt(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows dealt by ``key`` into as many parts as the session's shuffles have. Adaptive execution would join parts that look small when
    compressed until there are hardly more than cores, and a task's sorts and joins would hold that share of the input."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.options(**PLAIN_READS).schema(df.schema).parquet(path)


def told(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Row]:
    """The rows as :func:`written`, and aggregates of them that come with the write: no job of their own."""
    seen = Observation()
    out = written(df.observe(seen, *metrics), name)
    return out, Row(**seen.get)
