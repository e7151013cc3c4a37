"""Streaming forms: duplicates by state, event windows, moving averages and throttled progress.

Event time and watermarks are this engine's own addition: sources are files that arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drop_seen_pairs(pairs: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First arrivals of each pair of texts of a file; state is bounded by the watermark if there is a time column."""
    keyed = pairs.withColumn("pair_key", F.sha2(F.concat_ws(":", F.length("src").cast("string"), "src", "tgt"), 256))
    if time is None:
        return keyed.dropDuplicates(["file_id", "pair_key"]).drop("pair_key")
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["file_id", "pair_key"]).drop("pair_key")


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events and their values by window and type; late events within the delay are counted."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def ema_by_key(events: DataFrame, key: str, value: str, order: str, alpha: float = 0.35) -> DataFrame:
    """Moving average of each key's values, kept between batches: key, n, mean, ema after each batch's values in order."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, now = state.get if state.exists else (0, 0.0, None)
        rows = pd.concat(list(batches)).sort_values(order)
        for x in rows[value].dropna():
            n, total = n + 1, total + float(x)
            now = float(x) if now is None else now * (1 - alpha) + float(x) * alpha
        state.update((n, total, now))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [total / n if n else None], "ema": [now]})

    kind = dict(events.dtypes)[key]
    return events.select(key, value, order).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, mean double, ema double", "n long, total double, ema double", "update", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, key: str, order: str, every: int = 50, always: tuple = ("file_start", "file_complete", "warning")) -> DataFrame:
    """Progress of each key: the first event, every ``every``-th, and the kinds that are always shown."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order).reset_index(drop=True)
        rows["n"] = range(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        yield rows[(rows["n"] == 1) | (rows["n"] % every == 0) | rows["event_type"].isin(always)][[key, order, "event_type", "n"]]

    kinds = dict(events.dtypes)
    return events.select(key, order, "event_type").groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, {order} {kinds[order]}, event_type string, n long", "n long", "append", GroupStateTimeout.NoTimeout)
