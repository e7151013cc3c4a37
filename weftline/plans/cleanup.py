"""The cleanup plan: rules in their fixed order over pairs, with actions, warnings and removals, in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.segments import plain_text, strip_ws
from ..functions.split import drop_inline_tags

ACTION = "struct<rule: string, message: string, before_src: string, after_src: string, before_tgt: string, after_tgt: string>"


@dataclass(frozen=True)
class Options:
    """One set of defaults for every surface: spaces, game markup, garbage and warnings on, the rest off."""

    normalize_spaces: bool = True
    remove_line_breaks: bool = False
    remove_percent_wrapped_tokens: bool = False
    remove_game_markup: bool = True
    remove_inline_tags: bool = False
    remove_garbage_segments: bool = True
    emit_warnings: bool = True


#: Rules in order: option and name, expression, message.
RULES = (
    ("remove_percent_wrapped_tokens", rules.strip_percent_tokens, "Percent tokens removed"),
    ("remove_game_markup", rules.strip_game_markup, "Game markup removed"),
    ("remove_inline_tags", drop_inline_tags, "Inline tags removed"),
    ("remove_line_breaks", rules.collapse_line_breaks, "Line breaks joined"),
    ("normalize_spaces", rules.normalize_spaces, "Spaces normalised"),
)


def clean_pairs(pairs: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """pairs (src_xml, tgt_xml, src_lang, tgt_lang, any others) with clean_src, clean_tgt, src_text, tgt_text, actions, remove_reason, warnings."""
    df = pairs.withColumns({"clean_src": F.col("src_xml"), "clean_tgt": F.col("tgt_xml")})
    stages = []
    for name, rule, message in RULES:
        if not getattr(options, name):
            continue
        df = df.withColumns({"_s": rule(F.col("clean_src")), "_t": rule(F.col("clean_tgt"))})
        changed = ~F.col("_s").eqNullSafe(F.col("clean_src")) | ~F.col("_t").eqNullSafe(F.col("clean_tgt"))
        action = F.struct(F.lit(name).alias("rule"), F.lit(message).alias("message"), F.col("clean_src").alias("before_src"), F.col("_s").alias("after_src"), F.col("clean_tgt").alias("before_tgt"), F.col("_t").alias("after_tgt"))
        stage = f"_{name}"
        df = df.withColumn(stage, F.when(changed, action)).withColumns({"clean_src": F.col("_s"), "clean_tgt": F.col("_t")}).drop("_s", "_t")
        stages.append(stage)
    df = df.withColumns({"src_text": strip_ws(plain_text(F.col("clean_src"))), "tgt_text": strip_ws(plain_text(F.col("clean_tgt")))})
    s, t = F.col("src_text"), F.col("tgt_text")
    df = df.withColumn("remove_reason", rules.garbage_reason(s, t) if options.remove_garbage_segments else F.lit(None).cast("string"))
    gone = F.when(F.col("remove_reason").isNotNull(), F.struct(F.lit("remove_garbage_segment").alias("rule"), F.col("remove_reason").alias("message"), F.col("clean_src").alias("before_src"), F.lit("").alias("after_src"), F.col("clean_tgt").alias("before_tgt"), F.lit("").alias("after_tgt")))
    actions = F.array_compact(F.array(*[F.col(c).cast(ACTION) for c in stages], gone.cast(ACTION)))
    none = F.array().cast("array<struct<rule: string, severity: string, message: string>>")
    found = F.when(F.col("remove_reason").isNull(), rules.warnings(s, t, F.col("src_lang"), F.col("tgt_lang"))).otherwise(none) if options.emit_warnings else none
    return df.withColumns({"actions": actions, "warnings": found}).drop(*stages)


def clean_properties(props: F.Column, options: Options = Options()) -> F.Column:  # noqa: B008
    """Service markup out of the context property; other properties stay."""
    game, percent = options.remove_game_markup, options.remove_percent_wrapped_tokens
    own = lambda p: F.lower(F.trim(p["type"])) == "x-contextcontent"
    return F.transform(props, lambda p: F.when(own(p), F.struct(p["type"].alias("type"), rules.clean_property(p["value"], game, percent).alias("value"))).otherwise(p))
