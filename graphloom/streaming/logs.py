"""The log operators over streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.states import TRANSITIONS
from graphloom.scratch import shared_dir

_OUT = "assertion_id long, event_id long, from_state string, to_state string, error string"
_STATE = "state string, ts timestamp, event_id long"


def _replay(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, at, last = state.get if state.exists else (None, None, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for r in rows.itertuples():
        if at is not None and (r.ts, r.event_id) <= (pd.Timestamp(at), last):
            out.append((key[0], r.event_id, now, r.to_state, "duplicate_event" if r.event_id == last else "late"))
            continue
        allowed = r.to_state == "candidate" if now is None else r.to_state in TRANSITIONS.get(now, ())
        error = None if allowed else "no_start" if now is None else "illegal_transition"
        out.append((key[0], r.event_id, now, r.to_state, error))
        now, at, last = r.to_state, r.ts, r.event_id
    state.update((now, None if at is None else pd.Timestamp(at).to_pydatetime(), last))
    yield pd.DataFrame(out, columns=["assertion_id", "event_id", "from_state", "to_state", "error"])


def replay(events: DataFrame) -> DataFrame:
    """Each entry of a stream (assertion_id, event_id, to_state, ts) with the state before it and an error, as in a batch.

    Entries of a trigger are taken in the order of time. One that comes in a later trigger than a younger one is late and changes nothing;
    the state held per key is its last entry only.
    """
    return events.select("assertion_id", "event_id", "to_state", F.col("ts").cast("timestamp").alias("ts")).groupBy("assertion_id").applyInPandasWithState(_replay, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, key: str, delay: str) -> DataFrame:
    """The stream without repeated keys, remembered for the delay."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, window: str, delay: str, by: list[str]) -> DataFrame:
    """Entries by window and columns; later ones than the delay don't count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Everything the stream's source holds now, processed and written to the shared folder, as a table."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows").select(*stream.columns)
