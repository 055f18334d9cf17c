"""Streaming forms of the window operators over (key, ts, value): an extension, tested against batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling(stream: DataFrame, key: str, ts: str, value: str, size: str = "250 milliseconds", late: str = "1 second") -> DataFrame:
    """Count and mean of fixed windows."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, size), key)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def hopping(stream: DataFrame, key: str, ts: str, value: str, size: str = "30 milliseconds", hop: str = "10 milliseconds", late: str = "1 second") -> DataFrame:
    """Level of overlapping frames: the root of the mean square."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, size, hop), key)
    return w.agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms")).select(key, F.col("window.start").alias("start"), "rms")


def phrases(stream: DataFrame, key: str, ts: str, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Sessions that a pause ends."""
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return w.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def assign(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, tolerance: str = "80 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Points joined with intervals that contain them within a tolerance, with state bounded by watermarks."""
    p = points.withWatermark(ts, late)
    i = intervals.withColumnRenamed(key, "__key").withWatermark(start, late)
    t = F.expr(f"INTERVAL {tolerance}")
    on = (F.col(key) == F.col("__key")) & (F.col(ts) >= F.col(start) - t) & (F.col(ts) <= F.col(end) + t)
    return p.join(i, on).drop("__key")


def segments(stream: DataFrame, key: str, ts: str, order: str, vector: str, norm: float, merge: float, late: str = "1 second", idle: str = "2 seconds") -> DataFrame:
    """Greedy segments by similarity with the running mean: (key, first, last, frames), as ``windows.similarity_segments`` of all rows.

    Rows wait until the watermark (``late`` behind the newest time) passes them, so they may come in any order
    within it; later ones are dropped. A segment is emitted when it closes, or when the watermark is ``idle`` past its
    last row. The state store must support this API (see ``prepare``).
    """
    kind, place = stream.schema[key].dataType.simpleString(), stream.schema[order].dataType.simpleString()
    rows = stream.select(key, ts, F.col(order).cast("long").alias("at"), F.col(vector).cast("array<double>").alias("x")).filter("at is not null and x is not null").withWatermark(ts, late)
    processor = Segments(key, ts, norm, merge, _millis(stream, idle))
    out = rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, first long, last long, frames long", "Append", "EventTime")
    return out.select(key, F.col("first").cast(place).alias("first"), F.col("last").cast(place).alias("last"), "frames")


def _millis(df: DataFrame, interval: str) -> int:
    return df.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {interval}) div 1000").alias("n")).first().n


class Segments(StatefulProcessor):
    """Waiting rows and the open segment of each key; a timer at the first waiting row's time, and one ``idle`` after the last row taken."""

    def __init__(self, key: str, ts: str, norm: float, merge: float, idle: int):
        self.key, self.ts, self.norm, self.merge, self.idle = key, ts, norm, merge, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, last long, count long, centre array<double>, until long")
        self.waiting = handle.getListState("waiting", "ms long, at long, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for frame in rows:
            ms = frame[self.ts].astype("datetime64[ms]").astype("int64")
            self.waiting.appendList(list(zip(ms.tolist(), frame["at"].tolist(), [list(map(float, x)) for x in frame["x"]], strict=True)))
            oldest = int(ms.min()) if oldest is None else min(oldest, int(ms.min()))
        if oldest is not None:
            self.handle.registerTimer(oldest + 1)
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] < watermark]
        now, out = tuple(self.open.get()) if self.open.exists() else None, []
        for ms, at, x in due:
            now, closed = self.step(now, ms, at, np.asarray(x))
            out += closed
        if due:
            left = waiting[len(due) :]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(left[0][0] + 1)
            else:
                self.waiting.clear()
        if now is not None and now[4] <= watermark and len(due) == len(waiting):
            out.append((now[0], now[1] + 1, now[2]))
            now = None
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            if now[4] > watermark:
                self.handle.registerTimer(now[4])
        yield self.frame(key, out)

    def step(self, now, ms: int, at: int, x: np.ndarray):
        """The open segment after a frame, and what the frame closes."""
        size = float(np.linalg.norm(x))
        if now is not None:
            start, _, count, centre, _ = now
            centre = np.asarray(centre)
            if size >= self.norm and float(x @ centre) / (size * np.linalg.norm(centre) + 1e-8) >= self.merge:
                return (start, at, count + 1, ((centre * count + x) / (count + 1)).tolist(), ms + self.idle), []
        closed = [] if now is None else [(now[0], now[1] + 1, now[2])]
        return ((at, at, 1, x.tolist(), ms + self.idle) if size >= self.norm else None), closed

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["first", "last", "frames"], dtype="int64")
        out.insert(0, self.key, pd.Series([key[0]] * len(rows), dtype=object))
        return out

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """Typed state needs the state store that keeps column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_segments(spark: SparkSession, path: str, out: str, checkpoint: str, norm: float, merge: float, schema: str = "key string, ts timestamp, frame long, x array<double>", **options) -> None:
    """All files that came to a folder since the last run, through ``segments`` into a folder of Parquet.

    The checkpoint holds what was read, the open segments and the watermark, so a stopped run goes on where it was.
    """
    prepare(spark)
    found = segments(spark.readStream.schema(schema).parquet(path), "key", "ts", "frame", "x", norm, merge, **options)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
