"""Events of a run as a table, and their delivery to callbacks."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import throttle

#: Kinds that progress displays never leave out.
ALWAYS = ("file_start", "file_complete", "warning")
# The order of a unit's events.
ORDER = {"file_start": 0, "tu_start": 1, "cleanup_proposed": 2, "warning": 3, "tu_removed_cleanup": 4, "split_proposed": 5, "verifier_result": 6, "tu_rejected": 7, "tu_split_applied": 8, "tu_skipped": 9, "file_complete": 10}


class Stopped(Exception):
    """A callback asks the run to stop."""


def run_events(units: DataFrame) -> DataFrame:
    """file_id, tu_index (-1 and a last place for the file's own), rank, ordinal, event, detail of a repair's units (see plans.repair)."""
    one = lambda event, detail=None: F.struct(F.lit(ORDER[event]).alias("rank"), F.lit(0).alias("ordinal"), F.lit(event).alias("event"), (F.lit("") if detail is None else detail).alias("detail"))
    several = lambda column, event: F.transform(column, lambda x, i: F.struct(F.lit(ORDER[event]).alias("rank"), i.alias("ordinal"), F.lit(event).alias("event"), x["rule"].alias("detail")))
    split = F.col("src_parts").isNotNull()
    rejected = F.when(F.col("pending"), "verifier_unavailable").when(F.col("verdict") == "FAIL", "verifier_fail").when(F.col("outputs") == 1, "user_rejected")
    skipped = F.coalesce("skip_reason", F.when(F.col("remove_reason").isNull(), F.col("split_skip")))
    found = F.array_compact(F.array(
        one("tu_start"),
        F.when(F.col("remove_reason").isNotNull(), one("tu_removed_cleanup", F.col("remove_reason"))),
        F.when(split, one("split_proposed", F.size("src_parts").cast("string"))),
        F.when(split & F.col("verdict").isNotNull(), one("verifier_result", F.col("verdict"))),
        F.when(split & rejected.isNotNull(), one("tu_rejected", rejected)),
        F.when(F.col("outputs") > 1, one("tu_split_applied", F.col("outputs").cast("string"))),
        F.when(skipped.isNotNull(), one("tu_skipped", skipped)),
    ))
    every = F.concat(found, several("actions", "cleanup_proposed"), several("warnings", "warning"))
    each = units.select("file_id", "tu_index", F.explode(every).alias("e")).select("file_id", "tu_index", "e.*")
    files = units.groupBy("file_id").agg(F.count("*").alias("n"), F.max("tu_index").alias("last"))
    ends = files.select("file_id", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("tu_index"), F.lit(ORDER["file_start"]).alias("rank"), F.lit(0).alias("ordinal"), F.lit("file_start").alias("event"), F.lit("").alias("detail")),
        F.struct((F.col("last") + 1).alias("tu_index"), F.lit(ORDER["file_complete"]).alias("rank"), F.lit(0).alias("ordinal"), F.lit("file_complete").alias("event"), F.col("n").cast("string").alias("detail")),
    )).alias("e")).select("file_id", "e.*")
    return each.unionByName(ends)


def shown(events: DataFrame, every: int = 50) -> DataFrame:
    """The events a display gets: first, last and every so many of a file, and the kinds that are always shown."""
    numbered = events.withColumn("place", F.struct("tu_index", "rank", "ordinal"))
    kept = throttle(numbered, ["file_id"], "place", every)
    return kept.unionByName(numbered.where(F.col("event").isin(*ALWAYS))).dropDuplicates(["file_id", "place"]).drop("place")


def deliver(events: DataFrame, callback: Callable[[dict], None], log: logging.Logger | None = None) -> int:
    """Calls back with each event in order, streamed a partition at a time. What a callback raises is logged, but ``Stopped`` ends the run."""
    n = 0
    for row in events.orderBy("file_id", "tu_index", "rank", "ordinal").toLocalIterator():
        try:
            callback(row.asDict())
        except Stopped:
            raise
        except Exception:  # noqa: BLE001  a display must not end a run
            (log or logging.getLogger("weftline")).warning("a callback failed", exc_info=True)
        n += 1
    return n


class Run:
    """A group of jobs that can be stopped from another thread. ``work`` is called with the session; a worker can be handed in."""

    def __init__(self, spark: SparkSession, name: str, work: Callable[[SparkSession], object]):
        self.spark, self.name, self.work = spark, name, work
        self.group = f"{name}-{uuid.uuid4().hex}"
        self.stopped = False

    def start(self) -> object:
        context = self.spark.sparkContext
        context.setJobGroup(self.group, self.name, interruptOnCancel=True)
        try:
            return self.work(self.spark)
        finally:
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(key, None)

    def stop(self) -> None:
        """Ends the jobs that run and those that the work has yet to start."""
        self.stopped = True
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.group)


def forecast(cost: Column, processed: Column, total: Column) -> Column:
    """A file's cost at its end, from the share of units that are through; the cost so far where none is."""
    share = F.least(F.lit(1.0), processed / total)
    return F.when((total > 0) & (processed > 0), cost / share).otherwise(cost)


def average_rate(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))


def instant_rates(ticks: DataFrame, by: list[str], time: str, total: str) -> DataFrame:
    """ticks with ``rate``: tokens gained since the tick before over the seconds since (null for the first, or if no time went by)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(time, total)
    gained = F.greatest(F.lit(0), F.col(total) - F.lag(total).over(w))
    gone = F.col(time).cast("timestamp").cast("double") - F.lag(F.col(time).cast("timestamp").cast("double")).over(w)
    return ticks.withColumns({"_gained": gained, "_gone": gone}).withColumn("rate", F.when(F.col("_gone") > 0, F.col("_gained") / F.col("_gone"))).drop("_gained", "_gone")
