"""Proposals, decisions and their application; counts, filters and pages for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that decide, ranks of statuses, rules shown as one type, order of types.
DECISION_STATUS = {
    "accept": "accepted", "accepted": "accepted", "approve": "accepted", "approved": "accepted",
    "reject": "rejected", "rejected": "rejected", "decline": "rejected",
    "skip": "skipped", "skipped": "skipped", "pending": "pending",
}
STATUS_RANK = {"accepted": 0, "rejected": 1, "skipped": 2, "pending": 3}
SERVICE_MARKUP = ("remove_inline_tags", "remove_game_markup", "remove_percent_wrapped_tokens", "context_remove_game_markup", "context_remove_percent_wrapped_tokens")
TYPE_ORDER = ("service_markup", "dedup_tu", "normalize_spaces", "remove_line_breaks", "remove_garbage_segment", "split")
DETAIL_CAP = 1000


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def cleanup_proposals(actions: DataFrame) -> DataFrame:
    """One proposal an action, id ``cleanup:<unit>:<rule>:<ordinal>``. actions: file_id, tu_index, actions (array of struct)."""
    each = actions.select("file_id", "tu_index", F.posexplode("actions").alias("ordinal", "a"))
    return each.select("file_id", F.concat_ws(":", F.lit("cleanup"), "tu_index", "a.rule", "ordinal").alias("id"), F.lit("cleanup").alias("kind"), "tu_index", "ordinal", "a.*")


def split_proposals(splits: DataFrame) -> DataFrame:
    """id ``split:<unit>``. splits: file_id, tu_index, src_parts, tgt_parts, confidence, verdict, original_src, original_tgt."""
    return splits.select("file_id", F.concat_ws(":", F.lit("split"), "tu_index").alias("id"), F.lit("split").alias("kind"), "tu_index", "confidence", "verdict", "src_parts", "tgt_parts", "original_src", "original_tgt")


def check_type(kind: Column, rule: Column) -> Column:
    return F.when(kind == "split", "split").when(rule.isin(*SERVICE_MARKUP), "service_markup").otherwise(rule)


def type_rank(kind: Column) -> Column:
    return F.coalesce(lookup({t: k for k, t in enumerate(TYPE_ORDER)}, kind), F.lit(len(TYPE_ORDER)))


def counts_by_type(proposals: DataFrame) -> DataFrame:
    """check_type, n in the fixed order, then by name."""
    out = proposals.groupBy(check_type(F.col("kind"), F.col("rule")).alias("check_type")).agg(F.count("*").alias("n"))
    return out.orderBy(type_rank(F.col("check_type")), "check_type")


def cap_details(df: DataFrame, by: list[str], order: list[str], cap: int = DETAIL_CAP) -> DataFrame:
    """The first ``cap`` rows of each group: the feature of bounded reports; totals are ``detail_totals``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def detail_totals(df: DataFrame, by: list[str], cap: int = DETAIL_CAP) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*by).agg(n.alias("total"), F.least(n, F.lit(cap)).alias("stored"), F.greatest(n - cap, F.lit(0)).alias("omitted"))


def decision_status(decision: Column) -> Column:
    return lookup(DECISION_STATUS, F.lower(F.trim(decision)))


def latest_decisions(decisions: DataFrame, order: str = "seq") -> DataFrame:
    """The last valid decision of each id, with its last comment that is not empty."""
    valid = decisions.withColumn("new_status", decision_status(F.col("decision"))).where("new_status IS NOT NULL")
    said = F.when(F.coalesce("comment", F.lit("")) != "", F.col("comment"))
    return valid.groupBy("id").agg(F.max_by("new_status", order).alias("new_status"), F.max_by(said, F.when(said.isNotNull(), F.col(order))).alias("new_comment"))


def merge_decisions(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues with statuses and comments replaced by what was decided."""
    got = issues.join(latest_decisions(decisions), "id", "left")
    return got.withColumns({"status": F.coalesce("new_status", "status"), "comment": F.coalesce("new_comment", "comment")}).drop("new_status", "new_comment")


def unrecognized(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions for unknown ids or with unknown words."""
    known = decisions.join(issues.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    return known.where(F.col("known").isNull() | decision_status(F.col("decision")).isNull()).drop("known")


def ordered_issues(issues: DataFrame) -> DataFrame:
    rank = F.coalesce(lookup(STATUS_RANK, F.col("status")), F.lit(99))
    return issues.withColumn("rank", rank).orderBy("rank", "tu_index", "seq")


def status_counts(issues: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return issues.agg(F.count("*").alias("total"), *[n(s) for s in STATUS_RANK])


def selected_units(accepted: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Units that an accepted split or cleanup proposal names, within the file's units if totals (file_id, total_tus) are given. accepted: file_id, id."""
    index = F.split("id", ":")
    if totals is not None:
        return selected_units(accepted).join(totals, "file_id").where("tu_index < total_tus").drop("total_tus")
    return accepted.where(index[0].isin("split", "cleanup")).select("file_id", index[1].cast("long").alias("tu_index")).where("tu_index >= 0").distinct()


def apply_selection(units: DataFrame, accepted: DataFrame) -> DataFrame:
    """Units of accepted proposals only (left semi join)."""
    return units.join(selected_units(accepted), ["file_id", "tu_index"], "left_semi")


def search_text(columns: list[Column]) -> Column:
    """What a search looks in: non-blank fields, each cut to 1000 characters, in lower case."""
    cut = [F.when(F.trim(c.cast("string")) != "", F.substring(c.cast("string"), 1, 1000)) for c in columns]
    return F.lower(F.concat_ws(" ", *cut))


def review_page(proposals: DataFrame, types: list[str], status: str, query: str, page: int, order: list[str], size: int = 200) -> DataFrame:
    """A page (from 0) of the proposals of these types and status ('all', or one) whose search text has the query."""
    kept = proposals.where(F.col("check_type").isin(*types) if types else F.lit(False))
    if status != "all":
        kept = kept.where(F.col("status") == status)
    if query.strip():
        kept = kept.where(F.col("search_text").contains(query.strip().lower()))
    return kept.orderBy(*order).offset(page * size).limit(size)


def compact_plan(proposals: DataFrame, order: list[str], cap: int = DETAIL_CAP, texts: tuple = ("before_src", "after_src", "before_tgt", "after_tgt")) -> DataFrame:
    """Proposals in order; those after the first ``cap`` of a file keep id, kind, rule and message, not their texts.

    The place of the last one that keeps its texts is found by the ``cap`` least places of a file
    (partitions keep no more each), and compared with. Those places, one a file, are broadcast, so that
    texts are not dealt out by file; no file's proposals meet in one task.
    """
    place = F.struct(*order)
    by_file = Window.partitionBy("file_id").orderBy("_place")
    least = proposals.select("file_id", place.alias("_place")).withColumn("_n", F.row_number().over(by_file)).where(F.col("_n") <= cap)
    last = least.groupBy(F.col("file_id").alias("_file")).agg(F.max("_place").alias("_last"))
    keep = place <= F.col("_last")
    got = proposals.join(F.broadcast(last), F.col("file_id").eqNullSafe(F.col("_file")), "left")
    return got.select(*[F.when(keep, F.col(c)).otherwise("").alias(c) if c in texts else F.col(c) for c in proposals.columns])


def before_after(kind: Column, parts: tuple[Column, Column], before: tuple[Column, Column], after: tuple[Column, Column], original: tuple[Column, Column]) -> Column:
    """Struct before_src, after_src, before_tgt, after_tgt of an issue: a split's are the originals and the parts in lines, a cleanup's its own texts, or the originals where it has none before."""
    split, text = kind == "split", lambda c: F.coalesce(c, F.lit(""))
    out = []
    for side, p, b, a, o in zip(("src", "tgt"), parts, before, after, original, strict=True):
        out.append(F.when(split, text(o)).otherwise(F.coalesce(F.nullif(b, F.lit("")), text(o))).alias(f"before_{side}"))
        out.append(F.when(split, text(F.array_join(p, "\n"))).otherwise(text(a)).alias(f"after_{side}"))
    return F.struct(out[0], out[1], out[2], out[3])


def saved_types(saved: Column, available: Column) -> Column:
    """The saved types that are there; all that are there if none is."""
    both = F.array_intersect(saved, available)
    return F.when(F.size(both) > 0, both).otherwise(available)


def numbered_lines(parts: Column) -> Column:
    """Parts as numbered lines, for a sheet's cell."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")
