"""Metric streams: best metric, applied difficulty, early stop, wrong predictions, extraction.

The three metric streams keep one typed value per run (``transformWithState``). With ``idle`` (seconds, by the timestamps in
the column ``time``) a run that has sent nothing for so long when the stream's time has moved on has ended: an event-time
timer drops its state, and where the stream has something to say of an ended run it is emitted then; rows older than the
stream's time are not taken. State lives in RocksDB, on the executors' disks and in the checkpoint folder. A null (or NaN)
metric never improves and never takes over, as in the batch forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from qaspark.functions.carry import replay
from qaspark.functions.curriculum import UPDATE_ABOVE
from qaspark.operators.evaluate import wrong_predictions
from qaspark.operators.lookups import null_safe_join
from qaspark.session import exists

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Run(StatefulProcessor):
    """One typed value per run, and a timer that ends the run."""

    state = ""

    def __init__(self, idle_ms: int | None):
        self.idle_ms, self.timer, self.newest = idle_ms, None, 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"{self.state}, timer bigint")

    def seen(self) -> tuple | None:
        kept = self.kept.get() if self.kept.exists() else None
        self.timer, self.newest = kept[-1] if kept else None, 0
        return tuple(kept[:-1]) if kept else None

    def timed(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The frames, with their newest time noted."""
        for frame in frames:
            if self.idle_ms is not None and len(frame):
                self.newest = max(self.newest, int(frame[MILLIS].max()))
            yield frame

    def keep(self, value: tuple) -> None:
        """Store the value (after ``seen`` and the rows) and put the end of the run off."""
        end = None if self.idle_ms is None else max(self.newest + self.idle_ms, self.timer or 0)
        if end != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(end)
        self.kept.update((*value, end))

    def ended(self, key: Any, value: tuple) -> Iterator[pd.DataFrame]:
        """What the stream says of a run at its end."""
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value = self.seen()
        self.kept.clear()
        return self.ended(key, value) if value is not None else iter(())

    def close(self) -> None:
        pass


MILLIS = "at_millis"


def _streamed(rows: DataFrame, columns: list, run: str, processor: _Run, output: str, time: str) -> DataFrame:
    rows.sparkSession.conf.set(STORE_KEY, STORE)  # the only store that holds typed state and timers
    schema = StructType([rows.schema[run], *StructType.fromDDL(output).fields])
    if processor.idle_ms is None:
        return rows.select(run, *columns).groupBy(run).transformWithStateInPandas(processor, schema, "Append", "None")
    timed = rows.withWatermark(time, "0 seconds").select(run, *columns, time, F.unix_millis(time).alias(MILLIS))
    return timed.groupBy(run).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _milliseconds(idle: float | None) -> int | None:
    return None if idle is None else int(idle * 1000)


class _Best(_Run):
    state = "best double, epoch bigint"

    def __init__(self, run: str, idle_ms: int | None):
        super().__init__(idle_ms)
        self.run = run

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen()
        start, best_epoch = before or (0.0, 0)
        best = start
        for frame in self.timed(rows):
            for accuracy, epoch in zip(frame.eval_accuracy, frame.epoch):
                # Order inside a trigger is open, so equal values settle on the earlier epoch. NaN is never above.
                if accuracy > best or (accuracy == best and accuracy > start and epoch < best_epoch):
                    best, best_epoch = accuracy, epoch
        self.keep((float(best), int(best_epoch)))
        if before is None or best > start:
            yield pd.DataFrame({self.run: [key[0]], "best_accuracy": [float(best)], "best_epoch": [int(best_epoch)]})


def best_metric_stream(metrics: DataFrame, run: str = "run_id", idle: float | None = None, time: str = "time") -> DataFrame:
    """``run, best_accuracy, best_epoch`` each time a run improves; state is the best so far.

    A run's first rows give one even when it is still at 0, the value it starts from. A run that comes again after its
    end is a new one.
    """
    return _streamed(metrics, ["epoch", "eval_accuracy"], run, _Best(run, _milliseconds(idle)), "best_accuracy double, best_epoch bigint", time)


def latest_best(improvements: DataFrame, run: str = "run_id") -> DataFrame:
    """The last improvement of each run."""
    best = F.max(F.struct("best_accuracy", "best_epoch")).alias("b")
    return improvements.groupBy(run).agg(best).select(run, "b.best_accuracy", "b.best_epoch")


def _in_order(frames: Iterator[pd.DataFrame], value: str) -> tuple[list[int], list[float | None]]:
    """Epochs and values of one trigger's evaluations of a run, by epoch; the source's per-trigger limit bounds them."""
    rows = pd.concat(list(frames)).sort_values(["epoch", value], na_position="first")
    return rows.epoch.tolist(), [None if pd.isna(v) else v for v in rows[value].tolist()]


class _Applied(_Run):
    state = "applied double, last bigint"

    def __init__(self, run: str, threshold: float, idle_ms: int | None):
        super().__init__(idle_ms)
        self.run, self.threshold = run, threshold

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        in_force, last = self.seen() or (None, None)
        epochs, values = _in_order(self.timed(rows), "difficulty")
        late = [last is not None and epoch <= last for epoch in epochs]
        after = sum(late)  # late rows come first
        applied = [None] * after + replay(values[after:], in_force, self.threshold)
        if after < len(epochs):
            in_force, last = applied[-1], epochs[-1]
        self.keep((in_force, last))
        yield pd.DataFrame({
            self.run: pd.Series([key[0]] * len(epochs), dtype=object), "epoch": epochs, "difficulty": pd.Series(values, dtype="float64"),
            "applied": pd.Series(applied, dtype="float64"), "late": late})


def applied_difficulty_stream(log: DataFrame, threshold: float = UPDATE_ABOVE, run: str = "run_id", idle: float | None = None,
                              time: str = "time") -> DataFrame:
    """``run, epoch, difficulty, applied, late``: state is the difficulty in force and the last epoch.

    A row that comes after a later epoch of an earlier trigger changes nothing: it is passed on as ``late``, without
    an applied difficulty. A null difficulty leaves the one in force.
    """
    value = F.col("difficulty").cast("double").alias("difficulty")
    return _streamed(log, ["epoch", value], run, _Applied(run, threshold, _milliseconds(idle)),
                     "epoch bigint, difficulty double, applied double, late boolean", time)


class _Stop(_Run):
    state = "best double, counter bigint, stopped boolean, last bigint"

    def __init__(self, run: str, patience: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self.run, self.patience = run, patience

    def rows(self, key: Any, stops: list, lates: list, ended: list) -> pd.DataFrame:
        return pd.DataFrame({self.run: pd.Series([key[0]] * len(stops), dtype=object), "stop_epoch": pd.array(stops, dtype="Int64"),
                             "late_epoch": pd.array(lates, dtype="Int64"), "ended": ended})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, counter, stopped, last = self.seen() or (None, 0, False, None)
        stop, late = None, []
        for epoch, loss in zip(*_in_order(self.timed(rows), "eval_loss")):
            if last is not None and epoch <= last:
                late.append(epoch)
            elif loss is not None and (best is None or loss < best):
                best, counter = loss, 0
            else:
                counter += 1
                if counter >= self.patience and not stopped:
                    stopped, stop = True, epoch
            newest = epoch
        self.keep((best, counter, stopped, newest if last is None else max(last, newest)))
        if stop is not None or late:
            own = [stop] * (stop is not None)
            yield self.rows(key, own + [None] * len(late), [None] * len(own) + late, [False] * (len(own) + len(late)))

    def ended(self, key: Any, value: tuple) -> Iterator[pd.DataFrame]:
        if not value[2]:
            yield self.rows(key, [None], [None], [True])


def early_stop_stream(metrics: DataFrame, patience: int, run: str = "run_id", idle: float | None = None,
                      time: str = "time") -> DataFrame:
    """``run, stop_epoch, late_epoch, ended``: a stop once per run, when its patience runs out, and each late epoch.

    A row that comes after a later epoch of an earlier trigger is not counted; it gives a row with ``late_epoch`` and
    no stop. A loss that is null counts as one that did not improve. A run that ends before its patience does
    gives one row with ``ended``.
    """
    if patience <= 0:
        raise ValueError("patience must be positive; without it no run stops early")
    return _streamed(metrics, ["epoch", "eval_loss"], run, _Stop(run, patience, _milliseconds(idle)),
                     "stop_epoch bigint, late_epoch bigint, ended boolean", time)


def wrong_prediction_stream(predicted: DataFrame) -> DataFrame:
    """Wrong predictions as they arrive; no state."""
    return wrong_predictions(predicted)


def land_new_work(arrivals: DataFrame, done: DataFrame, checkpoint: str, path: str, key: str = "img_id",
                  work: Callable[[DataFrame], DataFrame] | None = None, after_landing: Callable[[int], None] | None = None) -> DataFrame:
    """Do the work of each image once and land it: not yet done, and not landed by an earlier batch of the stream.

    The stream itself keeps nothing. Every batch of arrivals drops the keys that are in ``done`` or have landed, applies
    ``work`` (keys to results; default: the keys) and writes its result as ``batch=<number>``, over what a broken try
    of the same batch left there. A batch whose commit was lost is run again with the same rows and the same earlier
    batches, so it lands the same images in the same place: each image once, whatever breaks between writing and
    committing. A null key is no work. ``after_landing`` is called between the two, with the batch number.

    Runs over all input that is there and returns what has landed.
    """
    spark = arrivals.sparkSession
    keys = arrivals.select(key)
    result = (work or (lambda fresh: fresh))(spark.createDataFrame([], keys.schema)).schema
    shape = StructType([*result.fields, *StructType.fromDDL("batch bigint").fields])

    def land(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        fresh = batch.filter(F.col(key).isNotNull()).distinct()
        fresh = null_safe_join(fresh, done.select(key), [key], "left_anti")
        if number and exists(own, path):
            landed = own.read.schema(shape).parquet(path).filter(F.col("batch") < number)
            fresh = null_safe_join(fresh, landed.select(key), [key], "left_anti")
        (work(fresh) if work else fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after_landing:
            after_landing(number)

    query = keys.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not exists(spark, path):
        return spark.createDataFrame([], result)
    return spark.read.schema(shape).parquet(path).drop("batch")


def drain_to_files(stream: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Run an append stream over all available input into Parquet and read it back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
