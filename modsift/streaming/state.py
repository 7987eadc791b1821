"""Keyed state over micro-batches: sustained breaches, training buffers, collection progress.

State lives in the query's checkpoint and is committed with the offsets of the micro-batch, so a batch that is run
again starts from the state before it, and a restart goes on where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from modsift.functions import scores as S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_state_store(df: DataFrame) -> None:
    """State with several variables and timers needs this store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _fields(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


# --- sustained breaches -----------------------------------------------------------------
class SustainedBreach(StatefulProcessor):
    """Per key: windows wait until the watermark has passed them, then join or end the run of breaches.

    A window that no row told of is a recovery, like one without breach.  One alert a run, when it has lasted
    ``min_seconds``.  Rows for a window that was judged already are late and change nothing.
    """

    def __init__(self, by: list[str], step: int, least: int):
        self.by, self.step, self.least = by, step, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _fields(start=LongType()), _fields(breach=BooleanType()))
        # The open run begins at ``first`` and its last window at ``last``; ``judged`` is the last window looked at.
        self.run = handle.getValueState("run", _fields(first=LongType(), last=LongType(), alerted=BooleanType(), judged=LongType()))

    def _run(self) -> tuple:
        return self.run.get() if self.run.exists() else (None, None, False, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        judged = self._run()[3]
        for frame in rows:
            for start, breach in zip(frame["started"].tolist(), frame["breached"].tolist()):
                if judged is None or start > judged:
                    self.waiting.updateValue((int(start),), (bool(breach),))
                    self.handle.registerTimer((int(start) + self.step) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.step
        first, last, alerted, judged = self._run()
        due = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= until)
        alerts = []
        for start, breach in due:
            self.waiting.removeKey((start,))
            if not breach:
                first, last, alerted = None, None, False
            else:
                if first is None or start != last + self.step:
                    first, alerted = start, False
                last = start
                if not alerted and last + self.step - first >= self.least:
                    alerts.append((*key, first, first + -(-self.least // self.step) * self.step))
                    alerted = True
            judged = start
        if due:
            self.run.update((first, last, alerted, judged))
        if alerts:
            yield pd.DataFrame(alerts, columns=[*self.by, "breach_start", "alert_at"])


def sustained_breach_alerts(windows: DataFrame, by: list[str], step_seconds: int, min_seconds: int) -> DataFrame:
    """(by, breach_start, alert_at) of a stream of windows (window_start, window_end, breach, by), from windows with a watermark.

    The alerts are the runs of ``windows.sustained_breach`` on the same windows as a table, each once, as of the first window
    end at which the run has lasted ``min_seconds``.  Windows beyond the watermark are not judged yet.
    """
    _use_state_store(windows)
    keys = [f"key{i}" for i in range(len(by))] or ["key0"]  # frames lose names that are no identifiers
    named = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("key0")]
    seconds = F.unix_seconds(F.col("window_start").cast("timestamp"))
    told = windows.select(*named, "window_end", seconds.alias("started"), F.coalesce("breach", F.lit(False)).alias("breached"))
    types = ", ".join(f"`{c}` {t}" for c, t in told.select(*keys).dtypes)
    alerts = told.groupBy(*keys).transformWithStateInPandas(
        SustainedBreach(keys, step_seconds, min_seconds), f"{types}, breach_start LONG, alert_at LONG", "Append", "EventTime"
    )
    back = [F.col(k).alias(c) for c, k in zip(by, keys)]
    return alerts.select(*back, F.timestamp_seconds("breach_start").alias("breach_start"), F.timestamp_seconds("alert_at").alias("alert_at"))


# --- training buffers --------------------------------------------------------------------------
class TrainingBuffer(StatefulProcessor):
    """Per buffer: samples are kept until ``size`` of them are a batch, which comes out whole."""

    def __init__(self, schema: StructType, size: int):
        self.schema, self.size = schema, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)
        self.count = handle.getValueState("count", _fields(batches=LongType(), kept=LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.fieldNames()
        batches, n_kept = self.count.get() if self.count.exists() else (0, 0)
        arrived = [row for frame in rows for row in frame[names].itertuples(index=False, name=None)]
        if n_kept + len(arrived) < self.size:
            if arrived:
                self.kept.appendList([_plain(row) for row in arrived])
            self.count.update((batches, n_kept + len(arrived)))
            return
        held = [*(tuple(row) for row in self.kept.get()), *arrived] if n_kept else arrived
        full = len(held) // self.size
        for i in range(full):
            out = pd.DataFrame(held[i * self.size : (i + 1) * self.size], columns=names)
            yield out.assign(buffer=key[0], batch_no=batches + i)[["buffer", "batch_no", *names]]
        rest = [_plain(row) for row in held[full * self.size :]]
        self.kept.put(rest) if rest else self.kept.clear()
        self.count.update((batches + full, len(rest)))


def _plain(row: tuple) -> tuple:
    """State takes Python's values: numpy's become those, missing ones None."""
    return tuple(None if v is None or (isinstance(v, float) and v != v) else v.item() if isinstance(v, np.generic) else v for v in row)


def training_batches_stream(samples: DataFrame, row_id: str, size: int = 1000, buffers: int = 1) -> DataFrame:
    """(buffer, batch_no, columns of the sample): whole batches of ``size`` valid samples, in the order they arrive.

    Samples are dealt to ``buffers`` by a hash of the id, as consumers that each fill a buffer of their own; an unfinished
    batch is carried over micro-batches and restarts.  Use as many buffers as the stream needs tasks.
    """
    _use_state_store(samples)
    names = [f"c{i}" for i in range(len(samples.columns))]  # frames lose names that are no identifiers
    kept = samples.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(samples.columns, names)])
    dealt = kept.withColumn("buffer", F.pmod(F.xxhash64(names[samples.columns.index(row_id)]), F.lit(buffers)).cast("int"))
    types = ", ".join(f"{n} {t}" for n, t in kept.dtypes)
    out = dealt.groupBy("buffer").transformWithStateInPandas(TrainingBuffer(kept.schema, size), f"buffer INT, batch_no LONG, {types}", "Append", "None")
    return out.select("buffer", "batch_no", *[F.col(n).alias(c) for c, n in zip(samples.columns, names)])


# --- collection progress ---------------------------------------------------------------------
class ProgressFlush(StatefulProcessor):
    """Per task: the running count, told at every ``every`` texts."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", _fields(collected=LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        now = before + sum(len(frame) for frame in rows)
        self.count.update((now,))
        told = np.arange(before // self.every + 1, now // self.every + 1, dtype=np.int64) * self.every
        if len(told):
            yield pd.DataFrame({"task": key[0], "collected": told})


def progress_flushes(texts: DataFrame, task: str, max_count: int, every: int = 10) -> DataFrame:
    """(task, collected, progress) rows of a stream of collected texts: one each time a task's count passes a multiple of ``every``."""
    _use_state_store(texts)
    kind = dict(texts.dtypes)[task]
    # Rows only count, so they travel without their other columns.
    told = texts.select(F.col(task).alias("task")).groupBy("task")
    told = told.transformWithStateInPandas(ProgressFlush(every), f"task {kind}, collected LONG", "Append", "None")
    return told.select(F.col("task").alias(task), "collected", S.progress_percent("collected", F.lit(max_count)).alias("progress"))
