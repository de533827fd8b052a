"""The object map as a stream: frames are fused when the watermark has passed them, so that late ones are in their place.

State by scene: the objects, the frames that wait, and a counter of fused frames for the upkeep that is due every so many. Timers of event time
release frames, and forget a scene that has had none for a while, so that state doesn't grow with scenes that have ended.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.fusion import DETECTION, FIELDS, OBJECT, Rules, SceneMap

_WAITING = "frame_id long, det long, category string, points long, lo array<double>, hi array<double>, feat array<double>, contained boolean, at long"
_ROW = [c.split()[0] for c in _WAITING.split(", ")]
SNAPSHOT = f"scene_id long, frame_id long, {OBJECT}"


class _Fusion(StatefulProcessor):
    def __init__(self, rules: Rules, idle_ms: int | None) -> None:
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.objects = handle.getListState("objects", OBJECT)
        self.waiting = handle.getListState("waiting", _WAITING)
        self.counter = handle.getValueState("counter", "frames long, last long")  # frames fused, and the event time of the last one

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for f in rows:
            f = f.assign(at=f["ts"].astype("datetime64[ms]").astype("int64"))
            self.waiting.appendList([_plain(r) for r in f[_ROW].itertuples(index=False, name=None)])
            times |= {*f["at"].tolist()}
        for t in times:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        frames, last = tuple(self.counter.get()) if self.counter.exists() else (0, now)
        waiting = [dict(zip(_ROW, r)) for r in self.waiting.get()]
        due = sorted((r for r in waiting if r["at"] <= now), key=lambda r: (r["frame_id"], r["det"]))
        if due:
            world = SceneMap(self.rules, self.objects.get(), frames)
            for frame, rows in itertools.groupby(due, key=lambda r: r["frame_id"]):
                world.add(frame, list(rows))
                yield pd.DataFrame([(key[0], frame, *r) for r in world.rows()], columns=["scene_id", "frame_id", *FIELDS])
            self.objects.put(world.rows())
            self.waiting.put([tuple(r.values()) for r in waiting if r["at"] > now]) if len(due) < len(waiting) else self.waiting.clear()
            self.counter.update((world.frames, now))
            if self.idle_ms is not None:
                self.handle.registerTimer(now + self.idle_ms)
        elif self.idle_ms is not None and now - last >= self.idle_ms:  # frames that wait come later
            self.objects.clear()
            self.counter.clear()

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    return tuple(list(map(float, x)) if hasattr(x, "__len__") and not isinstance(x, str) else x.item() if hasattr(x, "item") else x for x in row)


def fused_stream(detections: DataFrame, rules: Rules = Rules(), late: str = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """The map (``SNAPSHOT``) of each scene after each of its frames, from a stream of detections (``DETECTION``) with the event time ``ts`` of their frame.

    Equal to ``fused_map(..., every_frame=True)`` on the same rows as long as none is later than ``late``; later ones are dropped. Frames of a scene
    have rising times. A scene without frames for ``idle_ms`` of event time is forgotten and begins anew. The session needs the RocksDB
    state store (``with_state_store``).
    """
    rows = detections.select(*DETECTION, "ts").withWatermark("ts", late)
    return rows.groupBy("scene_id").transformWithStateInPandas(statefulProcessor=_Fusion(rules, idle_ms), outputStructType=SNAPSHOT, outputMode="Update", timeMode="EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    """Set the state store that states of several kinds need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def snapshot_sink(snapshots: DataFrame, path: str, checkpoint: str):
    """A writer of snapshots: each batch is one folder ``batch=<number>`` under ``path``, written anew if the batch runs again, so that no frame is there twice."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return snapshots.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots that a sink has written."""
    return spark.read.schema(f"{SNAPSHOT}, batch long").parquet(path).drop("batch")


def last_snapshots(snapshots: DataFrame) -> DataFrame:
    """Each scene's objects after its last frame."""
    last = snapshots.groupBy("scene_id").agg(F.max("frame_id").alias("frame_id"))
    return snapshots.join(last, ["scene_id", "frame_id"])
