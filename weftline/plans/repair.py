"""The repair plan: units to proposals, repaired units and statistics.

``plan`` only proposes; ``repair`` with accepted ids applies those, and without them applies
everything. A unit outside the selection, or skipped, goes out as it came in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import split as S
from ..functions.verify import CACHE_KEY, TEMPLATE, VERDICTS, cache_key, is_unavailable, render_prompt, verify
from ..operators import review, units
from ..sinks.tmx import unit_xml
from .cleanup import Options, clean_pairs, clean_properties
from .storage import settled


@dataclass(frozen=True)
class Settings:
    cleanup: Options = field(default_factory=Options)
    split: bool = True
    short_pair_guard: bool = True
    noise_guard: bool = True
    dedup: bool = False
    model: str = ""
    #: What a verifier is asked, with places to fill (see functions.verify).
    template: str = TEMPLATE
    confidence_prop: str = units.CONFIDENCE_PROP
    verdict_prop: str = units.VERDICT_PROP
    #: Distinct splits to verify in a file, in order; None for all. Others are HIGH and ``unverified``.
    max_checks: int | None = None
    parallel: int = 4


@dataclass
class Result:
    units: DataFrame  # every unit with all that was found about it
    proposals: DataFrame
    output: DataFrame  # file_id, tu_index, part_index, unit, lead


def find_splits(df: DataFrame, settings: Settings) -> DataFrame:
    """df with src_parts, tgt_parts (null if no split is proposed) and split_skip."""
    able = F.col("skip_reason").isNull() & F.col("remove_reason").isNull() & ~F.col("is_duplicate")
    if not settings.split:
        none = F.lit(None).cast("array<string>")
        return df.withColumns({"src_parts": none, "tgt_parts": none, "split_skip": F.lit("split_disabled")})
    # text on both sides without tags or entities stays in column expressions
    bare = ~F.col("clean_src").rlike("[<&]") & ~F.col("clean_tgt").rlike("[<&]")
    df = df.withColumns({"_a": F.when(able & bare, S.split_text(F.col("clean_src"))), "_b": F.when(able & bare, S.split_text(F.col("clean_tgt")))})
    easy = bare & ((F.size("_a") < 2) | (F.size("_b") < 2) | (F.size("_a") == F.size("_b")))
    hard = able & ~easy & F.col("clean_src").rlike(r"[.!?…\n]") & F.col("clean_tgt").rlike(r"[.!?…\n]")
    df = settled(df.withColumns({"_easy": easy, "_hard": hard}))
    easy, hard = F.col("_easy"), F.col("_hard")
    df = df.withColumn("_p", S.split_pair(F.when(hard, F.col("clean_src")), F.when(hard, F.col("clean_tgt"))))
    plain_s, plain_t = F.when(easy, F.col("_a")).otherwise(F.col("_p.src_plain")), F.when(easy, F.col("_b")).otherwise(F.col("_p.tgt_plain"))
    df = df.withColumn("_why", F.when(plain_s.isNotNull() & plain_t.isNotNull(), S.guards(plain_s, plain_t, settings.short_pair_guard, settings.noise_guard)).otherwise("none"))
    good = able & F.col("_why").isNull()
    parts = lambda e, h: F.when(good, F.when(easy, F.col(e)).otherwise(F.col(h)))
    df = df.withColumns({"src_parts": parts("_a", "_p.src"), "tgt_parts": parts("_b", "_p.tgt")})
    few = F.coalesce(F.size("src_parts") < 2, F.lit(False))
    return df.withColumn("split_skip", F.when(able & F.col("src_parts").isNull(), "no_split_proposal").when(few, "proposal_less_than_two_parts")).drop("_a", "_b", "_p", "_why", "_easy", "_hard")


def known_before(df: DataFrame, plan: DataFrame) -> DataFrame:
    """df with plan_confidence and plan_verdict of its split proposals, by id; values that are none of the known ones are null. plan: file_id, id, confidence, verdict."""
    said = lambda c, values: F.when(F.upper(F.trim(c)).isin(*values), F.upper(F.trim(c)))
    own = plan.where(F.col("id").startswith("split:")).groupBy("file_id", F.split("id", ":")[1].cast("long").alias("tu_index")).agg(F.max(said(F.col("confidence"), ("HIGH", "MEDIUM"))).alias("plan_confidence"), F.max(said(F.col("verdict"), VERDICTS)).alias("plan_verdict"))
    return df.join(own, ["file_id", "tu_index"], "left")


def check_splits(df: DataFrame, settings: Settings, verifier: Callable | None, cache: DataFrame | None, plan: DataFrame | None = None) -> DataFrame:
    """df with confidence, verdict, verdict_summary, messages and token counts. Distinct candidates are called once; cached ones, and those a plan has judged, not at all.

    cache: key, verdict, summary. Verdicts of an unavailable verifier are not kept in it by callers
    (see ``new_cache_rows``).
    """
    long, text = F.lit(0).cast("long"), F.lit(None).cast("string")
    split = F.col("src_parts").isNotNull()
    df = known_before(df, plan) if plan is not None and {"confidence", "verdict"} <= set(plan.columns) else df.withColumns({"plan_confidence": text, "plan_verdict": text})
    reused = F.lit("The plan's verdict")
    if verifier is None:
        done = {"confidence": F.when(split, F.coalesce("plan_confidence", F.lit("HIGH"))), "verdict": F.when(split, F.col("plan_verdict")), "verdict_summary": F.when(split & F.col("plan_verdict").isNotNull(), reused)}
        return df.withColumns(done | {"messages": F.lit(None).cast("array<string>"), "prompt_tokens": long, "candidate_tokens": long, "cache_key": text}).drop("plan_confidence", "plan_verdict")
    columns = {"src_lang": F.col("src_lang"), "tgt_lang": F.col("tgt_lang"), "src_text": F.col("clean_src"), "tgt_text": F.col("clean_tgt"), "src_parts": F.col("src_parts"), "tgt_parts": F.col("tgt_parts"), "model": F.lit(settings.model)}
    df = df.withColumn("cache_key", F.when(split, cache_key({k: columns[k] for k in CACHE_KEY})))
    cached = cache.select(F.col("key").alias("cache_key"), F.col("verdict").alias("old_verdict"), F.col("summary").alias("old_summary")) if cache is not None else None
    todo = df.where("cache_key IS NOT NULL AND plan_confidence IS NULL AND plan_verdict IS NULL")
    if cached is not None:
        todo = todo.join(cached, "cache_key", "left_anti")
    first = todo.groupBy("cache_key").agg(F.min(F.struct("file_id", "tu_index", "src_lang", "tgt_lang", "clean_src", "clean_tgt", "src_parts", "tgt_parts")).alias("x")).select("cache_key", "x.*")
    if settings.max_checks is not None:
        first = first.withColumn("_n", units.number_in(["file_id"], ["tu_index"])).where(F.col("_n") <= settings.max_checks).drop("_n")
    first = first.withColumn("prompt", render_prompt(F.lit(settings.template), *(F.col(c) for c in ("src_lang", "tgt_lang", "clean_src", "clean_tgt", "src_parts", "tgt_parts"))))
    # written: paid calls are not made again when a plan is recomputed
    called = verify(settled(first, "calls"), verifier, settings.parallel).select("cache_key", F.col("file_id").alias("call_file"), F.col("tu_index").alias("call_unit"), F.col("verdict").alias("new_verdict"), F.col("summary").alias("new_summary"), "messages", "prompt_tokens", "candidate_tokens")
    df = df.join(settled(called, "answers"), "cache_key", "left")
    if cached is not None:
        df = df.join(cached, "cache_key", "left")
    else:
        df = df.withColumns({"old_verdict": text, "old_summary": text})
    paid = (F.col("call_file") == F.col("file_id")) & (F.col("call_unit") == F.col("tu_index"))
    known = F.col("plan_verdict").isNotNull() | F.col("plan_confidence").isNotNull()
    df = df.withColumns({"verdict": F.when(known, F.col("plan_verdict")).otherwise(F.coalesce("old_verdict", "new_verdict")), "verdict_summary": F.when(known, F.when(F.col("plan_verdict").isNotNull(), reused)).otherwise(F.coalesce("old_summary", "new_summary"))})
    df = df.withColumns({"prompt_tokens": F.when(paid & ~known, F.col("prompt_tokens")).otherwise(long), "candidate_tokens": F.when(paid & ~known, F.col("candidate_tokens")).otherwise(long)})
    confidence = F.when(split, F.coalesce("plan_confidence", F.when(F.col("verdict").isNull(), "HIGH").otherwise("MEDIUM")))
    return df.withColumn("confidence", confidence).drop("old_verdict", "old_summary", "new_verdict", "new_summary", "call_file", "call_unit", "plan_confidence", "plan_verdict")


def new_cache_rows(df: DataFrame) -> DataFrame:
    """key, verdict, summary to keep for later runs: real verdicts only."""
    return df.where(F.col("cache_key").isNotNull() & F.col("verdict").isNotNull() & ~is_unavailable(F.col("verdict"), F.col("verdict_summary"), F.col("messages"))).groupBy(F.col("cache_key").alias("key")).agg(F.min("verdict").alias("verdict"), F.min("verdict_summary").alias("summary"))


def repair(tu: DataFrame, headers: DataFrame, settings: Settings = Settings(), accepted: DataFrame | None = None, verifier: Callable | None = None, cache: DataFrame | None = None) -> Result:  # noqa: B008
    """tu, headers: see sources.tmx. accepted: file_id, id of proposals to apply, maybe with the confidence and verdict that the plan found; None applies all."""
    if "lead" not in tu.columns:
        tu = tu.withColumn("lead", F.lit(None).cast("string"))
    df = units.orient(tu, headers)
    first, second = F.get("tuvs", F.lit(0))["seg_xml"], F.get("tuvs", F.lit(1))["seg_xml"]
    if settings.dedup:
        df = df.withColumns({"_x": F.when(F.size("tuvs") == 2, first), "_y": F.when(F.size("tuvs") == 2, second)})
        df = units.mark_duplicates(df, "_x", "_y", "tu_index").drop("_x", "_y")
    else:
        df = df.withColumn("is_duplicate", F.lit(False))
    if accepted is not None:
        chosen = review.selected_units(accepted).withColumn("chosen", F.lit(True))
        df = df.join(chosen, ["file_id", "tu_index"], "left").withColumn("skip_reason", F.when(F.col("chosen").isNull(), "not_selected_for_apply").otherwise(F.col("skip_reason"))).drop("chosen")
    live = F.col("skip_reason").isNull()
    df = clean_pairs(settled(df).withColumns({"src_xml": F.when(live, F.col("src_xml")), "tgt_xml": F.when(live, F.col("tgt_xml"))}), settings.cleanup)
    df = df.withColumn("remove_reason", F.when(F.col("is_duplicate") & live, "dedup_tu").otherwise(F.col("remove_reason")))
    many = F.struct(F.lit("multilang_tu_skipped").alias("rule"), F.lit("WARN").alias("severity"), F.lit("Unit with more than two languages").alias("message"))
    df = df.withColumn("warnings", F.when(F.col("skip_reason") == "multilang_tu", F.array(many)).otherwise(F.col("warnings")))
    df = df.withColumn("new_props", F.when(live, clean_properties(F.col("props"), settings.cleanup)).otherwise(F.col("props")))
    df = check_splits(find_splits(df, settings), settings, verifier, cache, accepted)
    split = F.col("src_parts").isNotNull()
    pending = F.coalesce(is_unavailable(F.col("verdict"), F.col("verdict_summary"), F.col("messages")), F.lit(False))
    apply = split & ~F.coalesce(F.col("verdict") == "FAIL", F.lit(False)) & ~pending
    if accepted is not None:
        own = accepted.where(F.col("id").startswith("split:")).select("file_id", F.split("id", ":")[1].cast("long").alias("tu_index")).distinct().withColumn("split_accepted", F.lit(True))
        df = df.join(own, ["file_id", "tu_index"], "left")
        apply = apply & F.col("split_accepted").isNotNull()
        df = df.withColumn("split_skip", F.when(split & F.col("split_accepted").isNull(), "split_not_selected").otherwise(F.col("split_skip")))
    df = df.withColumns({"pending": split & pending, "outputs": F.when(F.col("remove_reason").isNotNull(), 0).when(apply, F.size("src_parts")).otherwise(1).cast("long"), "n_actions": F.size("actions").cast("long"), "n_warnings": F.size("warnings").cast("long")})
    df = settled(df)
    cleaned = review.cleanup_proposals(df.where(live))
    dup = df.where(F.col("remove_reason") == "dedup_tu").select("file_id", F.concat_ws(":", F.lit("cleanup"), "tu_index", F.lit("dedup_tu"), F.lit(0)).alias("id"), F.lit("cleanup").alias("kind"), "tu_index", F.lit("dedup_tu").alias("rule"))
    splits = review.split_proposals(df.where(split).withColumns({"original_src": F.col("clean_src"), "original_tgt": F.col("clean_tgt")}))
    proposals = cleaned.unionByName(dup, True).unionByName(splits, True)
    new = lambda v, i: F.struct(v["lang"].alias("lang"), v["attrs"].alias("attrs"), F.when(i == F.col("src_pos"), F.col("clean_src")).when(i == F.col("tgt_pos"), F.col("clean_tgt")).otherwise(v["seg_xml"]).alias("seg_xml"))
    touched = live & ((F.size("actions") > 0) | (F.to_json("new_props") != F.to_json("props")))
    kept = df.where("outputs = 1").where(~touched).select("file_id", "tu_index", F.lit(0).alias("part_index"), "lead", F.col("raw_xml").alias("unit"))
    edited = df.where("outputs = 1").where(touched).withColumns({"props": F.col("new_props"), "tuvs": F.transform("tuvs", new)}).select("file_id", "tu_index", F.lit(0).alias("part_index"), "lead", unit_xml(F.col("attrs"), F.col("props"), F.col("tuvs")).alias("unit"))
    parts = units.split_units(df.where("outputs > 1").withColumn("props", F.col("new_props")), settings.confidence_prop, settings.verdict_prop)
    parts = parts.select("file_id", "tu_index", "part_index", "lead", unit_xml(F.col("attrs"), F.col("props"), F.col("tuvs")).alias("unit"))
    return Result(df, proposals, kept.unionByName(edited).unionByName(parts))
