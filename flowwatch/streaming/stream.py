"""Structured Streaming forms of the monitors: keyed state, watermarks, late rows dropped."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowwatch.functions.exprs import q

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_traffic(events: DataFrame, ts: str, is_attack: Column, lateness: str = "10 minutes") -> DataFrame:
    """Benign and attack rows per minute; rows later than the watermark are dropped."""
    timed = events.select(q(ts).alias("ts"), is_attack.alias("a")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "1 minute")).agg(
        F.sum(F.when(~F.col("a"), 1).otherwise(0)).alias("benign"),
        F.sum(F.when(F.col("a"), 1).otherwise(0)).alias("attack"),
    ).select(F.col("window.start").alias("minute"), "benign", "attack")


class FoldProcessor(StatefulProcessor):
    """Runs a fold per key; its state is one JSON value, its output one row per event."""

    def __init__(self, fold, key: str, order_cols: Sequence[str], columns: Sequence[str]) -> None:
        self.fold, self.key, self.order_cols, self.columns = fold, key, list(order_cols), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", StructType([
            StructField("json", StringType()), StructField("seen", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One micro-batch of one key: bounded by the trigger (maxFilesPerTrigger and the like).
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order_cols)
        held = self.state.get()
        state = json.loads(held[0]) if held is not None else self.fold.start()
        seen = int(held[1]) if held is not None else 0
        state, events = self.fold.run(state, batch[self.columns])
        self.state.update((json.dumps(state), seen + len(batch)))
        yield pd.DataFrame({
            self.key: [key[0]] * len(events), "step": [seen + o + 1 for o, _, _ in events],
            "detectors": [list(d) for _, d, _ in events], "details": [m for _, _, m in events]})

    def close(self) -> None:
        pass


def stream_fold(events: DataFrame, key: str, order_cols: Sequence[str], fold, ts: str | None = None,
                lateness: str = "10 minutes", columns: Sequence[str] = ("score",)) -> DataFrame:
    """Drift events of a live score stream, keyed; needs the RocksDB state store provider.

    Control rows that re-arm a key travel in the same stream with ``rearm`` = 1.
    """
    kind = events.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, step long, detectors array<string>, details map<string,double>"
    keyed = events.withWatermark(ts, lateness) if ts else events
    return keyed.groupBy(key).transformWithStateInPandas(
        FoldProcessor(fold, key, order_cols, columns), schema, "Append", "EventTime" if ts else "None")


class BufferProcessor(StatefulProcessor):
    """Keeps the newest or a uniform set of rows per key and emits it after every batch."""

    def __init__(self, key: str, order_col: str, capacity: int, mode: str) -> None:
        if mode not in ("sliding", "reservoir"):
            raise ValueError("mode must be 'sliding' or 'reservoir'")
        self.key, self.order_col, self.capacity, self.mode = key, order_col, capacity, mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", StructType([
            StructField("rank", StringType()), StructField("idx", LongType()), StructField("body", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        for pdf in rows:
            pdf = pdf.sort_values(self.order_col)
            if "reset" in pdf.columns and (pdf["reset"] == 1).any():
                last = int(pdf.loc[pdf["reset"] == 1, self.order_col].max())
                held, pdf = [], pdf[pdf[self.order_col] >= last]
            held += list(zip(pdf["rank"], pdf[self.order_col].astype(int), pdf["body"]))
            place = (lambda r: -r[1]) if self.mode == "sliding" else (lambda r: r[0])
            held = sorted(held, key=place)[:self.capacity]
        self.rows.clear()
        if held:
            self.rows.put(held)
        yield pd.DataFrame({self.key: [key[0]] * len(held), "idx": [r[1] for r in held], "body": [r[2] for r in held]})

    def close(self) -> None:
        pass


def stream_buffer(events: DataFrame, key: str, order_col: str, row_id: str, body: Sequence[str], capacity: int,
                  mode: str = "sliding", seed: int = 42) -> DataFrame:
    """Replay buffer per key in state; the reservoir keeps the lowest hashes, so it can be merged."""
    rank = F.md5(F.concat(F.lit(f"{seed}:"), q(row_id).cast("string")))
    rows = events.select(key, q(order_col), rank.alias("rank"), F.to_json(F.struct(*[q(c) for c in body])).alias("body"),
                         *(["reset"] if "reset" in events.columns else []))
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(
        BufferProcessor(key, order_col, capacity, mode), f"`{key}` {kind}, idx long, body string", "Update", "None")
