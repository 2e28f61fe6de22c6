"""Streaming edges: an append-only log sink, log sessions with state, and image ingestion.

Ingestion of image files as a stream is an extension.  Sinks are exactly-once by their checkpoint folder; sessions are
held in the state store, ``keep`` of them for each device, so the state needs no watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.masks import level_passes
from ..sources.sinks import log_json


def log_sink(events: DataFrame, path: str, checkpoint: str, least: str = "INFO") -> StreamingQuery:
    """Writes events (ts, level, category, message, session, data) of level ``least`` or above
    as JSON lines, as they come."""
    lines = log_json(events.where(level_passes("level", least)))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class NewestSessions(StatefulProcessor):
    """State of a device: its ``keep`` newest sessions with their last event and number of events since they were kept."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session string", "at bigint, events bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.sessions.iterator()}
        before = set(held)
        for df in rows:
            for session, at in zip(df["session"].tolist(), df["at"].tolist(), strict=True):
                last, n = held.get(session, (at, 0))
                held[session] = max(last, at), n + 1
        order = sorted(held.items(), key=lambda x: (-x[1][0], x[0]))
        for session, (at, n) in order[: self.keep]:
            self.sessions.updateValue((session,), (at, n))
        for session, _ in order[self.keep :]:
            if session in before:
                self.sessions.removeKey((session,))
        out = [(key[0], s, at, n, rank) for rank, (s, (at, n)) in enumerate(order[: self.keep], 1)]
        yield pd.DataFrame(out, columns=["device", "session", "at", "events", "rank"])

    def close(self) -> None:
        pass


def newest_sessions(events: DataFrame, keep: int = 5) -> DataFrame:
    """A stream of events (device, session, at) -> for each device with new events its ``keep`` newest sessions (device,
    session, at, events, rank), newest first, of equals the least name.

    A session that is dropped can come back by newer events only, so what is kept equals catalogs.newest of all events.  Needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    kind = events.schema["device"].dataType.simpleString()
    thin = events.select("device", F.col("session").cast("string").alias("session"), F.col("at").cast("bigint").alias("at"))
    return thin.groupBy("device").transformWithStateInPandas(NewestSessions(keep), f"device {kind}, session string, at bigint, events bigint, rank int", "Update", "None")


def image_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of (path, modificationTime, length, content) of image files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path).where(F.col("length") > 0)
