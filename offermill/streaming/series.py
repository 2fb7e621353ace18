"""Price events kept by an own state for each series."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from offermill.operators.history import MAX_GAP_DAYS
from offermill.sources.versions import VersionedTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeriesRuns(StatefulProcessor):
    """Runs of equal values of one series, from observations that come late by less than the watermark's delay.

    State: the run that the observations up to the watermark end in, and
    those beyond it, whose order can still change, as one value: each call of
    the store costs more than what it carries. Each batch gives
    the runs from that one on, anew where they were given before; all of them but
    those that later observations can change are closed. When a series has been
    silent for the gap, a timer closes its last run and the state goes, unless
    one of the `dated` values is there: such a run goes on after any gap.
    """

    def __init__(self, values: list[StructField], tie: StructField, gap: int, dated: list[str]):
        self.values, self.tie, self.gap = values, tie, gap
        self.dated = [i for i, f in enumerate(values) if f.name in dated]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("held", BinaryType())]))

    def close(self) -> None:
        pass

    def _goes_on(self, run: tuple, at: int) -> bool:
        return at - run[-3] <= self.gap or any(run[i] is not None for i in self.dated)

    def _runs(self, run: tuple | None, rows: list[tuple]) -> list[tuple]:
        """(values, first, last, n, number) of the runs of rows in order, going on with `run`."""
        out = [run] if run else []
        for at, _, *values in rows:
            if out and list(out[-1][:-4]) == values and self._goes_on(out[-1], at):
                *same, _, n, number = out[-1]
                out[-1] = (*same, at, n + 1, number)
            else:
                out.append((*values, at, at, 1, out[-1][-1] + 1 if out else 0))
        return out

    def _held(self) -> tuple[tuple | None, list[tuple]]:
        held = self.held.get()  # None: there is none
        return (None, []) if held is None else pickle.loads(held[0])

    def _given(self, key: tuple, runs: list[tuple], closed: int) -> Iterator[Row]:
        names = [*(f"key{i}__" for i in range(len(key))), *(f.name for f in self.values), "first__", "last__", "observations", "number", "closed", "since__", "since_number"]
        made = Row(*names)
        return (made(*key, *r, i < closed, runs[0][-4], runs[0][-1]) for i, r in enumerate(runs))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = ["micros__", self.tie.name, *(f.name for f in self.values)]
        new = [tuple(None if x != x else x for x in (r[c] for c in names)) for r in rows]
        run, old = self._held()
        ordered = sorted(old + new, key=lambda r: (r[0], r[1] is not None, r[1]))
        fixed = [r for r in ordered if r[0] <= timerValues.getCurrentWatermarkInMs() * 1000]
        settled, runs = self._runs(run, fixed), self._runs(run, ordered)
        self.held.update((pickle.dumps((settled[-1] if settled else None, ordered[len(fixed) :])),))
        if run or old:  # a series without a state has no timers
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if not any(runs[-1][i] is not None for i in self.dated):
            self.handle.registerTimer((runs[-1][-3] + self.gap) // 1000 + 1)
        yield from self._given(key, runs, len(settled) - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        runs = self._runs(*self._held())
        self.held.clear()
        if runs:
            yield from self._given(key, runs, len(runs))


def series_runs(stream: DataFrame, series: list[str], values: list[str], at: str, tie: str, delay: str, gap_days: float = MAX_GAP_DAYS, dated: tuple[str, ...] = ()) -> DataFrame:
    """A stream of the runs that each batch of observations changes: series, values, first_seen, last_seen, observations, number, closed, since and since_number.

    Runs of a series are in the order of (first_seen, number). These take the
    place of all of their series from (since, since_number) on. Observations later than `delay` behind the greatest time seen are
    left out; null values equal each other, null times are left out.
    """
    kinds = {f.name: f for f in stream.schema.fields}
    keys = [f"key{i}__" for i in range(len(series))]
    time = F.col(at).cast("timestamp")
    rows = stream.where(F.col(at).isNotNull()).select(*(F.col(s).alias(k) for s, k in zip(series, keys)), *values, tie, time.alias("time__"), F.unix_micros(time).alias("micros__"))
    long = lambda n: StructField(n, LongType())
    out = StructType([*(StructField(k, kinds[s].dataType) for s, k in zip(series, keys)), *(kinds[v] for v in values), long("first__"), long("last__"), long("observations"), long("number"), StructField("closed", BooleanType()), long("since__"), long("since_number")])
    processor = SeriesRuns([kinds[v] for v in values], kinds[tie], int(gap_days * 86_400_000_000), list(dated))
    runs = rows.withWatermark("time__", delay).groupBy(*keys).transformWithState(processor, out, "Update", "EventTime")
    moment = lambda c, name: F.timestamp_micros(c).cast(kinds[at].dataType).alias(name)
    return runs.select(*(F.col(k).alias(s) for s, k in zip(series, keys)), *values, moment("first__", "first_seen"), moment("last__", "last_seen"), "observations", "number", "closed", moment("since__", "since"), "since_number")


def replaced(series: list[str]):
    """A merge for VersionedTable: the runs of a batch in place of those of their series from `since` on; of a run that comes twice the closed one."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in (*series, "first_seen", "number", "closed", "since", "since_number")]
        once = new.groupBy(*series, "first_seen", "number").agg(F.max_by(F.struct(*rest, "closed"), F.struct("closed", "observations")).alias("r")).select(*series, "first_seen", "number", "r.*")
        if old is None:
            return once
        since = new.groupBy(*series).agg(F.min(F.struct("since", "since_number")).alias("since__")).toDF(*(f"_{s}" for s in series), "since__")
        same = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in series]
        before = F.col("since__").isNull() | (F.struct(F.col("first_seen").alias("since"), F.col("number").alias("since_number")) < F.col("since__"))
        kept = old.join(since, same, "left").where(before).select(*old.columns)
        return kept.unionByName(once.select(*old.columns))

    return merge


def keep_series(stream: DataFrame, table: VersionedTable, checkpoint: str, series: list[str], values: list[str], at: str, tie: str, delay: str, gap_days: float = MAX_GAP_DAYS, dated: tuple[str, ...] = (), keep: int = 2) -> StreamingQuery:
    """Keeps the events of a stream of observations in a versioned table; what has come so far is read, then the query ends.

    The table equals price_events over all observations that were not too
    late, however they were split into batches. A batch writes the buckets of
    its series only. One that is run again after a failure is found by its mark.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        staged = f"{table.path}/staged/{n}"
        batch.write.mode("overwrite").parquet(staged)  # the state is stepped once, though the batch is read twice
        changes = spark.read.schema(batch.schema).parquet(staged)
        if not changes.isEmpty():
            table.write(changes, replaced(series), mark=f"{checkpoint}#{n}")
            table.vacuum(keep)
        path = spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # states of several variables need it; the query keeps its own copy of the setting
    try:
        runs = series_runs(stream, series, values, at, tie, delay, gap_days, dated)
        return runs.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
