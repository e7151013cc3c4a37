"""Run statistics, batch totals, cost and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.verify import cost


def run_stats(units: DataFrame) -> DataFrame:
    """One row a file and one over all (file_id null), in one pass.

    units: file_id, tu_index, outputs (0 removed, n parts), skip_reason, remove_reason, n_actions,
    n_warnings, confidence, verdict, tgt_lang, prompt_tokens, candidate_tokens.
    """
    yes = lambda c: F.count_if(c)
    total = F.sum(F.coalesce("outputs", F.lit(1))).alias("created")
    out = units.rollup("file_id").agg(
        F.count("*").alias("total"), yes(F.col("outputs") > 1).alias("split"), total,
        yes(F.col("skip_reason").isNotNull()).alias("skipped"), yes(F.col("remove_reason").isNotNull()).alias("removed"),
        yes((F.col("outputs") > 1) & (F.col("confidence") == "HIGH")).alias("high"), yes((F.col("outputs") > 1) & (F.col("confidence") == "MEDIUM")).alias("medium"),
        yes(F.col("verdict").isNotNull()).alias("checked"), yes(F.col("verdict") == "FAIL").alias("rejected"),
        F.sum("n_actions").alias("auto_actions"), F.sum("n_warnings").alias("warnings"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("candidate_tokens"), F.lit(0)).alias("candidate_tokens"),
        F.max_by("tgt_lang", F.when(F.col("tgt_lang").isNotNull(), F.col("tu_index"))).alias("tgt_lang"),
    )
    return out.withColumn("cost_usd", cost(F.col("prompt_tokens"), F.col("candidate_tokens")))


def running_totals(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"running_{c}": F.sum(c).over(upto) for c in columns})


def ema(values: F.Column, alpha: float = 0.35) -> F.Column:
    """Exponential moving average of an array of numbers in order, beginning with the first."""
    step = lambda acc, x: F.when(acc.isNull(), x).otherwise(acc * (1 - alpha) + x * alpha)
    return F.aggregate(values, F.lit(None).cast("double"), step)


def throttle(events: DataFrame, by: list[str], order: str, every: int = 50, seconds: float = 0.10, time: str | None = None) -> DataFrame:
    """Progress events that are shown: the first, the last, every ``every``-th, and those a pause after the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.row_number().over(w)
    show = (n == 1) | (n % every == 0) | F.lead(order).over(w).isNull()
    if time:
        show = show | (F.col(time).cast("timestamp").cast("double") - F.lag(F.col(time).cast("timestamp").cast("double")).over(w) >= seconds)
    return events.withColumn("_show", show).where("_show").drop("_show")


def column_width(column: str) -> F.Column:
    return F.least(F.greatest(F.max(F.length(F.col(column).cast("string"))) + 2, F.lit(12)), F.lit(80))


def observed(df: DataFrame, written: F.Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that has ``rows_read`` and ``rows_written`` (those for which ``written`` holds) once df was computed."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows_read"), F.count_if(written).alias("rows_written")), seen
