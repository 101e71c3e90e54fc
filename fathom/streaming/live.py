"""The accuracy gate and tracks on live streams, with state that survives restarts.

Each subscription's state is kept by key in the state store, with a time to live: a gate as one value, a
track as a list of its last points. Rows of a micro-batch are taken in the order of (ts, event_id), batches follow each other.
``run_to_end`` takes what has come until now and stops; begun again with the same checkpoint it goes on from there, and a
batch that was cut off is written again in the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fathom import model as M
from fathom.streaming.gate import EMITTED

TRACK = "user_id long, i int, event_id long, x double, y double, n long"
#: A state with a lifetime asks for batches without data for ever; a run that ends takes none.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")


class Gate(StatefulProcessor):
    """Delivers good fixes; once, after ``seconds`` without one, the best so far."""

    def __init__(self, accuracy: float, seconds: float, hours: int) -> None:
        self.accuracy, self.micros, self.hours = accuracy, int(seconds * 1_000_000), hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "start long, best double, best_id long, delivered boolean", self.hours * 3_600_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, best, best_id, delivered = self.state.get() if self.state.exists() else (None, None, None, False)
        f = _ordered(rows)
        out = []
        for event, ts, acc in zip(f.event_id, f.ts, f.accuracy, strict=True):
            micros = ts.value // 1000
            start = micros if start is None else start
            known = pd.notna(acc)
            if known and (best is None or acc < best):
                best, best_id = float(acc), int(event)
            if known and acc <= self.accuracy:
                delivered = True
                out.append((key[0], event, event, float(acc), "delivered"))
            elif not delivered and best is not None and micros - start >= self.micros:
                delivered = True
                out.append((key[0], event, best_id, best, "fallback"))
            else:
                out.append((key[0], event, None, None, "refining"))
        self.state.update((start, best, best_id, delivered))
        got = pd.DataFrame(out, columns=["user_id", "event_id", "emitted_id", "accuracy", "status"])
        yield got.astype({"emitted_id": "Int64", "accuracy": "float64"})

    def close(self) -> None:
        pass


class Track(StatefulProcessor):
    """Keeps the last ``most`` points whose distance from the point kept before is over ``least``."""

    def __init__(self, least: float, most: int, hours: int) -> None:
        self.least, self.most, self.hours = least, most, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        life = self.hours * 3_600_000
        self.points = handle.getListState("points", "event_id long, x double, y double", life)
        self.last = handle.getValueState("last", "n long, x double, y double, held int", life)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, x0, y0, held = self.last.get() if self.last.exists() else (0, None, None, 0)
        f = _ordered(rows)
        new = []
        for event, x, y in zip(f.event_id, f.x, f.y, strict=True):
            if x0 is None or (x - x0) * (x - x0) + (y - y0) * (y - y0) > self.least * self.least:
                x0, y0 = float(x), float(y)
                new.append((int(event), x0, y0))
        if not new:
            return
        n += len(new)
        points = ([tuple(p) for p in self.points.get()] if held else []) + new
        if len(points) > 2 * self.most:  # older points are dropped now and then, not at every one
            points = points[-self.most :]
            self.points.put(points)
        else:
            self.points.appendList(new)
        self.last.update((n, x0, y0, len(points)))
        kept = points[-self.most :]
        yield pd.DataFrame([(key[0], i, *p, n) for i, p in enumerate(kept)], columns=["user_id", "i", "event_id", "x", "y", "n"]).astype({"i": "int32"})

    def close(self) -> None:
        pass


def gate_stream(fixes: DataFrame, accuracy: float = M.GATE_ACCURACY, seconds: float = M.GATE_SECONDS, hours: int = 24) -> DataFrame:
    """What the gate does with each fix (user_id, event_id, ts, accuracy) of a stream; a subscription silent for ``hours`` begins anew."""
    by_user = fixes.select("user_id", "event_id", "ts", "accuracy").groupBy("user_id")
    return by_user.transformWithStateInPandas(Gate(accuracy, seconds, hours), EMITTED, "Append", "ProcessingTime")


def track_stream(fixes: DataFrame, least: float = 1.0, most: int = M.TRACK_LENGTH, hours: int = 24) -> DataFrame:
    """The whole track after each batch that adds to it; ``n`` counts the points ever kept, so the row of the greatest n is the last word."""
    by_user = fixes.select("user_id", "event_id", "ts", "x", "y").groupBy("user_id")
    return by_user.transformWithStateInPandas(Track(least, most, hours), TRACK, "Update", "ProcessingTime")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str) -> DataFrame:
    """Take all that is there, a folder for each batch; the rows of all batches so far."""
    spark: SparkSession = stream.sparkSession
    schema = stream.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = query.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}")).start()
    finally:  # the query has its own copy
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out).select(*schema.names)
