"""Facts from a stream of saves: an extension that keeps the log append-only and the latest facts current."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.facts import resolve

CURRENT = "key string, domain string, as_of date, value_numeric double, seq long, superseded long, backdated long"


def current_facts(saves: DataFrame) -> DataFrame:
    """The current fact of each key after each batch: (CURRENT), in update mode.

    State per key is the latest dated save and two counters, whatever the number of saves.  All saves of a key in one
    trigger are put in order of seq together, however many Arrow batches they come in; saves without a date are left out,
    a missing number stays null.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        saves = pd.concat(list(batches)).dropna(subset=["as_of"]).sort_values("seq")
        days = (pd.to_datetime(saves["as_of"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy()
        if len(days):
            before = np.maximum.accumulate(np.concatenate([[held[1] if held else days[0]], days]))[:-1]
            leads = days >= before
            late = int((~leads).sum())
            replaced = int(leads.sum()) - (0 if held else 1)
            last = saves.iloc[int(np.flatnonzero(leads)[-1])] if leads.any() else None
            held = held or [None, None, None, None, 0, 0]
            if last is not None:
                number = None if pd.isna(last["value_numeric"]) else float(last["value_numeric"])
                held[:4] = [last["domain"], int(days[np.flatnonzero(leads)[-1]]), number, int(last["seq"])]
            held[4:] = [held[4] + replaced, held[5] + late]
        if held is not None:
            state.update(tuple(held))
            yield pd.DataFrame([{"key": key[0], "domain": held[0], "as_of": (pd.Timestamp("1970-01-01") + pd.Timedelta(days=held[1])).date(), "value_numeric": held[2], "seq": held[3], "superseded": held[4], "backdated": held[5]}])

    return saves.groupBy("key").applyInPandasWithState(step, CURRENT, "domain string, day long, value_numeric double, seq long, superseded long, backdated long", "update", "NoTimeout")


def append_log(saves: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of saves to a log of Parquet files; facts are resolved from the log when read."""
    return saves.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolved_log(spark, path: str, schema) -> DataFrame:
    return resolve(spark.read.schema(schema).parquet(path))


def windowed_counts(events: DataFrame, time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Saves per domain and window of time, with late ones up to a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "domain").agg(F.count(F.lit(1)).alias("saves")).select(F.col("window.start").alias("start"), "domain", "saves")
