"""What the operators of this subpackage share: inputs, folders and folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Spark's setting of the bytes of a batch for Python, and the most that texts are sent in.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, as doc_id and text; a null text counts as empty.

    Other columns of the input, whatever their names, are left out here, so
    they can't clash with those that an operator makes.
    """
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def in_small_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session that sends rows to Python in batches of BATCH_BYTES at most.

    Whole texts make batches of many megabytes otherwise, which the JVM and each
    Python worker hold several times, and workers keep what they once took. The
    setting is read when the frame runs, so it stays with the session; one that the session has already stays as it is.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, below spark.checkpoint.dir. It is deleted when the application ends.

    A local session, whose only executor is the driver, may do without that
    setting and gets a temporary folder; on a cluster there is none to guess.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            top = f"file://{tempfile.mkdtemp(prefix='offermill-')}"
        _own[app] = f"{top.rstrip('/')}/offermill-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_own[app])
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: its lineage is cut and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = _own.get(spark.sparkContext.applicationId, "?")
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/offermill-" in name and root.rpartition("/")[2] in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Remembered(dict):
    """A function's results by argument. A memory of speed only: never trusted to be complete.

    Half of the limit at a time is in use; when that is full, it becomes the
    older half, from which what is asked for again is taken over.
    """

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.half, self.older = function, limit // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older[key] if key in self.older else self.function(key)
        self[key] = value
        return value


class Sent:
    """What is sent to tasks as it was made; what its start() adds there stays there."""

    made: tuple[str, ...] = ()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in self.made}
