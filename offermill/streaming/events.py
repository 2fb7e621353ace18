"""Price events from a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from offermill.operators.history import extended, price_events


def keep_events(stream: DataFrame, store: str, checkpoint: str, series: list[str], values: list[str], at: str, tie: str) -> StreamingQuery:
    """Puts each micro-batch of observations to the event table in `store`; the result is that of one batch over all.

    Versions are written beside each other and named by their batch, so a
    batch that is run again after a failure starts from the same version and
    replaces its own output; only the last two are kept, so that storage does
    not grow with the number of batches. Observations must come in order of
    time between batches; within one they may come in any.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n == 0:
            events = price_events(batch, series, values, at, tie)
        else:
            events = extended(spark.read.parquet(f"{store}/v{n - 1}"), batch, series, values, at, tie)
        events.write.mode("overwrite").parquet(f"{store}/v{n}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/v{n - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
