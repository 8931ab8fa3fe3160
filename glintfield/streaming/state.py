"""Per-user state over streams of events: bounded values and falling edges, with the batch operators' rows.

Each user's state is one value in the state store, so a stream goes on from its checkpoint where it stopped. Events of a
micro-batch are walked in their order; earlier batches hold earlier events. With `forget_ms` a processing-time timer drops
the state of users who send nothing for so long; they begin anew. (A stream with timers has no end, so `drained` is for those without.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glintfield.operators.folds import applied

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Remembering(StatefulProcessor):
    """One value a key; `walk` gives the rows and the value after them."""

    kind = "double"

    def __init__(self, order: list[str], forget_ms: int | None = None):
        self.order, self.forget_ms = order, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"state {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, ignore_index=True)
        last, out = self.walk(self.state.get()[0] if self.state.exists() else None, batch)
        self.state.update((last,))
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class BoundedWalk(Remembering):
    def __init__(self, order: list[str], start: float, low: float, high: float, forget_ms: int | None = None):
        super().__init__(order, forget_ms)
        self.start, self.low, self.high = start, low, high

    def walk(self, before: float | None, batch: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        v = min(self.high, max(self.low, self.start)) if before is None else before
        values = []
        for m in batch["move"]:
            v = self.start if pd.isna(m) else applied((m, self.low, self.high), v)
            values.append(v)
        return v, batch.assign(value=values)


class FallingEdges(Remembering):
    kind = "boolean"

    def walk(self, before: bool | None, batch: pd.DataFrame) -> tuple[bool, pd.DataFrame]:
        was = [bool(before), *batch["wanted"].iloc[:-1]]
        return bool(batch["wanted"].iloc[-1]), batch[[w and not now for w, now in zip(was, batch["wanted"])]]


def with_state(events: DataFrame, key: str, processor: Remembering, schema: str) -> DataFrame:
    """The stream of the processor's rows; the session must keep state in RocksDB (see `prepared`)."""
    mode = "None" if processor.forget_ms is None else "ProcessingTime"
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream has to give now, as files in folder/rows; its checkpoint beside them lets a later run go on."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
