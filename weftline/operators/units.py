"""Translation units: orientation into pairs, eligibility, duplicates, split units and replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import base_lang, normalize_lang
from ..functions.chars import WS
from ..functions.segments import export_text, plain_text
from ..functions.tuv import named_lang

# Properties that describe the place of the whole unit, dropped from its parts.
CONTEXT_PROPS = (
    "x-context", "x-contextpre", "x-contextpost", "x-contextcontent", "x-prev-segment", "x-next-segment",
    "x-previous-segment", "x-following-segment", "x-concordance", "x-sdl-contextpre", "x-sdl-contextpost",
)
#: Properties that parts of a split get; a run may name them as its users know them.
CONFIDENCE_PROP, VERDICT_PROP = "x-split-confidence", "x-split-verdict"


def source_position(tuvs: Column, src_lang: Column) -> Column:
    """Place of the source variant: of the same language, else of the same base language, else the first of two."""
    langs = F.transform(tuvs, lambda v: normalize_lang(v["lang"]))
    bases = F.transform(tuvs, lambda v: base_lang(v["lang"]))
    known = src_lang != ""
    exact = F.when(known, F.array_position(langs, normalize_lang(src_lang)))
    near = F.when(known, F.array_position(bases, base_lang(src_lang)))
    return (F.coalesce(F.nullif(exact, F.lit(0)), F.nullif(near, F.lit(0)), F.when(F.size(tuvs) == 2, 1)) - 1).cast("int")


def orient(units: DataFrame, headers: DataFrame) -> DataFrame:
    """Units with src_pos, tgt_pos, src_lang, tgt_lang, src_xml, tgt_xml and skip_reason. headers: file_id, src_lang."""
    df = units.join(headers.select("file_id", F.col("src_lang").alias("header_lang")), "file_id", "left")
    df = df.withColumn("src_pos", source_position(F.col("tuvs"), F.coalesce("header_lang", F.lit(""))))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("tuvs") - 1, F.lit(0))), lambda i: i != F.col("src_pos"))
    df = df.withColumn("tgt_pos", F.when(F.size("tuvs") >= 2, F.get(places, F.lit(0))))
    src, tgt = F.get("tuvs", F.col("src_pos")), F.get("tuvs", F.col("tgt_pos"))
    df = df.withColumns({"src_lang": src["lang"], "tgt_lang": tgt["lang"], "src_xml": src["seg_xml"], "tgt_xml": tgt["seg_xml"]})
    reason = (
        F.when(F.col("corrupt").isNotNull(), "corrupt")
        .when(F.size("tuvs") < 2, "less_than_two_tuv")
        .when(F.size("tuvs") > 2, "multilang_tu")
        .when(F.col("src_pos").isNull(), "missing_src_tuv")
        .when(F.col("tgt_pos").isNull(), "missing_tgt_tuv")
        .when(F.col("src_xml").isNull() | F.col("tgt_xml").isNull(), "missing_seg")
    )
    return df.withColumn("skip_reason", reason).drop("header_lang")


def mark_duplicates(df: DataFrame, first: str, second: str, order: str, file: str = "file_id") -> DataFrame:
    """With ``is_duplicate``: whether an earlier row of the file has the same two texts; null texts are none.

    The earliest place of each pair is aggregated and joined back, so that a text many units
    share is no single task's window. Texts travel as 256-bit digests.
    """
    keyed = df.withColumn("_pair", F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.sha2(F.concat(F.length(first).cast("string"), F.lit(":"), F.col(first), F.col(second)), 256)))
    least = keyed.where("_pair IS NOT NULL").groupBy(file, "_pair").agg(F.min(order).alias("_first"))
    return keyed.join(least, [file, "_pair"], "left").withColumn("is_duplicate", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_pair", "_first")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order."""
    least = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(least, keys).where(F.col(order) == F.col("_first")).drop("_first")


def without_context(props: Column) -> Column:
    return F.filter(props, lambda p: ~F.lower(F.trim(p["type"])).isin(*CONTEXT_PROPS))


def split_units(df: DataFrame, confidence_prop: str = CONFIDENCE_PROP, verdict_prop: str = VERDICT_PROP) -> DataFrame:
    """A row for each part of an applied split, with part_index: attributes copied, context dropped, confidence and verdict added.

    df: units with src_pos, src_parts, tgt_parts, confidence, verdict (null if none).
    """
    prop = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    added = F.array_compact(F.array(prop(confidence_prop, F.col("confidence")), F.when(F.col("verdict").isNotNull(), prop(verdict_prop, F.col("verdict")))))
    parts = df.withColumn("props", F.concat(added, without_context(F.col("props"))))
    parts = parts.select("*", F.posexplode(F.arrays_zip("src_parts", "tgt_parts")).alias("part_index", "_p"))
    new = lambda v, i: F.struct(v["lang"].alias("lang"), v["attrs"].alias("attrs"), F.when(i == F.col("src_pos"), F.col("_p.src_parts")).otherwise(F.col("_p.tgt_parts")).alias("seg_xml"))
    return parts.withColumn("tuvs", F.transform("tuvs", new)).drop("_p")


def language_pairs(units: DataFrame, src_lang: str) -> DataFrame:
    """file_id, tu_index, source, target, target_lang: export texts of the first variants of exactly this source language and of each other one; pairs with a blank side go.

    All within a unit's row: nothing is shuffled.
    """
    tuvs = F.filter("tuvs", lambda v: v["seg_xml"].isNotNull())
    named = F.transform(tuvs, lambda v: F.struct(named_lang(v["attrs"]).alias("lang"), v["seg_xml"].alias("seg_xml")))
    langs = F.transform(F.col("named"), lambda v: v["lang"])
    first = units.select("file_id", "tu_index", named.alias("named")).select("file_id", "tu_index", F.filter("named", lambda v, i: F.array_position(langs, v["lang"]) == i + 1).alias("v"))
    source = F.get(F.filter("v", lambda x: x["lang"] == src_lang), F.lit(0))["seg_xml"]
    each = first.select("file_id", "tu_index", source.alias("s"), F.explode(F.filter("v", lambda x: x["lang"] != src_lang)).alias("t")).where("s IS NOT NULL")
    both = each.select("file_id", "tu_index", export_text(F.col("s")).alias("source"), export_text(F.col("t.seg_xml")).alias("target"), F.col("t.lang").alias("target_lang"))
    blank = lambda c: F.col(c).rlike(f"^[{WS}]*$")
    return both.where(~blank("source") & ~blank("target"))


def segments_by_language(units: DataFrame) -> DataFrame:
    """file_id, tu_index, segments (plain text by language; the last variant of a language wins, '' without a segment)."""
    each = F.transform("tuvs", lambda v, i: F.struct(v["lang"].alias("lang"), F.coalesce(plain_text(v["seg_xml"]), F.lit("")).alias("text")))
    langs = F.transform("each", lambda v: v["lang"])
    last = F.filter("each", lambda v, i: ~F.array_contains(F.slice(langs, i + 2, F.size("each")), v["lang"]))
    return units.select("file_id", "tu_index", each.alias("each")).select("file_id", "tu_index", F.map_from_entries(last).alias("segments"))


def target_language(units: DataFrame, headers: DataFrame) -> DataFrame:
    """file_id, tgt_lang: the first language of a file that is not its header's."""
    each = units.join(headers.select("file_id", "src_lang"), "file_id").select("file_id", "src_lang", "tu_index", F.posexplode(F.transform("tuvs", lambda v: v["lang"])).alias("pos", "lang"))
    return each.where("lang <> src_lang AND lang <> ''").groupBy("file_id").agg(F.min_by("lang", F.struct("tu_index", "pos")).alias("tgt_lang"))


def pair_specs(profiles: DataFrame) -> DataFrame:
    """file_id, source, target, suffix: the pairs a file can be exported to. profiles: see ``profile``, with src_lang."""
    safe = lambda c: F.translate(c, '\\/:*?"<>|', "_________")
    each = profiles.select("file_id", F.col("src_lang").alias("source"), F.explode(F.filter("languages", lambda x: x != F.col("src_lang"))).alias("target"))
    return each.withColumn("suffix", F.concat(safe(F.col("source")), F.lit("-"), safe(F.col("target"))))


def pair_tuvs(tuvs: Column, source: str, target: str) -> Column:
    """Variants of the two languages, or null unless both are there."""
    kept = F.filter(tuvs, lambda v: v["lang"].isin(source, target))
    have = F.transform(kept, lambda v: v["lang"])
    return F.when(F.size(F.array_except(F.array(F.lit(source), F.lit(target)), have)) == 0, kept)


def profile(units: DataFrame, headers: DataFrame) -> DataFrame:
    """file_id, tu_count, languages (source first, then by name), prop_types, inline_tags."""
    tags = F.flatten(F.transform("tuvs", lambda v: F.regexp_extract_all(F.coalesce(v["seg_xml"], F.lit("")), F.lit(r"<([A-Za-z][^\s/>]*)"), F.lit(1))))
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))  # noqa: E731  of names, few
    flat = units.select("file_id", F.transform("tuvs", lambda v: v["lang"]).alias("langs"), F.transform("props", lambda p: p["type"]).alias("types"), F.array_distinct(tags).alias("tags"))
    out = flat.groupBy("file_id").agg(F.count("*").alias("tu_count"), sets("langs").alias("langs"), sets("types").alias("prop_types"), sets("tags").alias("inline_tags"))
    out = out.join(headers.select("file_id", "src_lang"), "file_id", "left")
    src = F.filter("langs", lambda x: x == F.col("src_lang"))
    return out.select("file_id", "tu_count", F.concat(src, F.filter("langs", lambda x: (x != F.col("src_lang")) | F.col("src_lang").isNull())).alias("languages"), "prop_types", "inline_tags")


def number_in(partition: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
