"""Units as TMX: column expressions for the XML, and ordered writes of one file a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tuv import named_lang

HEADER = '<header creationtool="weftline" creationtoolversion="1" segtype="sentence" adminlang="en" datatype="plaintext" srclang="{src}"/>'
FORBIDDEN = '\\/:*?"<>|'


def attribute(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def attributes(attrs: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), attribute(e["value"]), F.lit('"'))), "")


def text(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def unit_xml(attrs: Column, props: Column, tuvs: Column) -> Column:
    """A unit's XML; no element is self-closing outside segments."""
    prop = lambda p: F.concat(F.lit('<prop type="'), attribute(p["type"]), F.lit('">'), text(p["value"]), F.lit("</prop>"))
    tuv = lambda v: F.concat(F.lit("<tuv"), attributes(v["attrs"]), F.lit(">"), F.coalesce(F.concat(F.lit("<seg>"), v["seg_xml"], F.lit("</seg>")), F.lit("")), F.lit("</tuv>"))
    return F.concat(F.lit("<tu"), attributes(attrs), F.lit(">"), F.array_join(F.transform(props, prop), ""), F.array_join(F.transform(tuvs, tuv), ""), F.lit("</tu>"))


def safe_name(name: Column) -> Column:
    return F.translate(name, FORBIDDEN, "_" * len(FORBIDDEN))


def _rows(units: DataFrame, prefixes: DataFrame, by: list[str]) -> DataFrame:
    """by, tu_index, part_index, value: a file's text without the ``>`` that each row ends with, so that nothing stands between rows that was not there before."""
    key = [F.col(c) for c in by]
    blank = lambda c: F.regexp_extract(c, r"(\s*)$", 1)
    lead = F.col("lead") if "lead" in units.columns else F.lit(None).cast("string")
    before = F.coalesce(F.nullif(F.when(F.col("tu_index") == 0, blank(lead)).otherwise(lead), F.lit("")), F.lit("\n"))
    body = units.select(*key, "tu_index", F.col("part_index").cast("int"), F.concat(before, F.regexp_replace("unit", ">$", "")).alias("value"))
    start = F.regexp_replace("prefix", r"\s+$", "")
    head = F.when(start.endswith(">"), F.regexp_replace(start, ">$", "")).otherwise(F.concat(start, F.lit("<!-- --")))
    indent = F.regexp_extract("prefix", r"(?m)^([ \t]*)<body", 1)
    ends = F.array(
        F.struct(F.lit(-1).cast("long").alias("tu_index"), head.alias("value")),
        F.struct(F.lit(2**62).alias("tu_index"), F.concat(F.lit("\n"), indent, F.lit("</body>\n</tmx")).alias("value")),
    )
    frame = prefixes.select("file_id", F.explode(ends).alias("e"))
    if by != ["file_id"]:
        frame = frame.join(units.select(*key).distinct(), "file_id")
    return body.unionByName(frame.select(*key, "e.tu_index", F.lit(0).alias("part_index"), "e.value"))


def write_tmx(units: DataFrame, prefixes: DataFrame, path: str) -> None:
    """units: file_id, tu_index, part_index, unit (XML), lead (what stood before the unit); prefixes: file_id, prefix (all before the first unit).

    One file for each file_id, below ``path/file=<name>/``: each is written by one task, in order, as
    the format asks for. Units stand apart as they did.
    """
    rows = _rows(units, prefixes, ["file_id"]).withColumn("file", safe_name(F.regexp_extract("file_id", r"([^/]+)$", 1)))
    rows.repartition("file").sortWithinPartitions("file", "file_id", "tu_index", "part_index").select("value", "file").write.option("lineSep", ">").partitionBy("file").text(path)


def pair_units(units: DataFrame, specs: DataFrame) -> DataFrame:
    """file_id, suffix, tu_index, part_index, lead, unit: for each pair of a file the units that hold both its languages, without their other variants.

    units: as read (tuvs, raw_xml, lead); specs: file_id, source, target, suffix (see operators.units.pair_specs).
    """
    tuvs = F.regexp_extract_all("raw_xml", F.lit(r"(?s)(<tuv[\s>].*?</tuv\s*>)"), F.lit(1))
    langs = F.transform("tuvs", lambda v: named_lang(v["attrs"]))
    each = units.withColumns({"_texts": tuvs, "_langs": langs}).join(specs.select("file_id", "source", "target", "suffix"), "file_id")
    each = each.where(F.array_contains("_langs", F.col("source")) & F.array_contains("_langs", F.col("target")))
    others = F.filter(F.arrays_zip("_texts", "_langs"), lambda z: (z["_langs"] != F.col("source")) & (z["_langs"] != F.col("target")))
    unit = F.aggregate(others, F.col("raw_xml"), lambda text, z: F.replace(text, z["_texts"], F.lit("")))
    return each.select("file_id", "suffix", "tu_index", F.lit(0).alias("part_index"), "lead", unit.alias("unit"))


def write_pair_tmx(units: DataFrame, specs: DataFrame, prefixes: DataFrame, path: str) -> None:
    """A file for each file and pair that has units, below ``path/file=<name>/pair=<suffix>/``; one scan for all pairs."""
    rows = _rows(pair_units(units, specs), prefixes, ["file_id", "suffix"]).withColumn("file", safe_name(F.regexp_extract("file_id", r"([^/]+)$", 1))).withColumnRenamed("suffix", "pair")
    rows.repartition("file", "pair").sortWithinPartitions("file", "pair", "file_id", "tu_index").select("value", "file", "pair").write.option("lineSep", ">").partitionBy("file", "pair").text(path)


def sheet_units(rows: DataFrame) -> DataFrame:
    """Rows of a sheet (see units_of_sheet) as units with the seven translation-tool properties."""
    fixed = [("client", " "), ("project", " "), ("domain", " "), ("subject", " "), ("corrected", "no"), ("aligned", "no")]
    prop = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    comment = F.when(F.col("comment") == "", " ").otherwise(F.col("comment"))
    props = F.array(*[prop(k, F.lit(v)) for k, v in fixed], prop("x-Comment", comment))
    tuv = lambda lang, side: F.struct(F.col(lang).alias("lang"), F.create_map(F.lit("xml:lang"), F.col(lang)).alias("attrs"), text(F.col(side)).alias("seg_xml"))
    attrs = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select("file_id", F.col("row_index").alias("tu_index"), F.lit(0).alias("part_index"), unit_xml(attrs, props, F.array(tuv("source_lang", "source"), tuv("target_lang", "target"))).alias("unit"))
