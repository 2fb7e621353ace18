"""Parquet tables of a directory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    stream = spark.readStream.schema(read(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(str(path))
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir.

    A local session, whose only executor is the driver, may do without one and
    gets a temporary folder; on a cluster there is no such folder to guess.
    """
    if top := spark.conf.get("spark.checkpoint.dir", None):
        return top.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='offermill-')}"


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """The rows dealt over all tasks of a shuffle by keys, before work that is much for each row.

    Small rows fill few splits of a file, and as many cores would do that work.
    Where rows become many more in the task that they are dealt to, `times` as
    many tasks keep each one's part small.
    """
    spark = df.sparkSession
    return df.repartition(times * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def kept(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder until the application ends, and read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_top(spark)}/offermill-kept-{uuid.uuid4().hex}")
    df.write.parquet(str(path))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(str(path))
