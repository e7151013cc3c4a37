"""TMX files as DataFrames of translation units, read in splits and without loss."""

from __future__ import annotations

import io
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _MAP = T.StringType(), T.MapType(T.StringType(), T.StringType())
_struct = lambda **kinds: T.StructType([T.StructField(n, k) for n, k in kinds.items()])
UNIT = _struct(attrs=_MAP, props=T.ArrayType(_struct(type=_S, value=_S)), tuvs=T.ArrayType(_struct(lang=_S, attrs=_MAP, seg_xml=_S)), corrupt=_S)
TUV = "struct<lang: string, attrs: map<string, string>, seg_xml: string>"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_TU = re.compile(r"<tu[\s>/]")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attrs(node) -> dict:
    return {k.replace(_XML, "xml:") if k.startswith(_XML) else _local(k): v for k, v in node.attrib.items()}


def inner_xml(node) -> str:
    """Content of an element: escaped text, children as XML, empty ones self-closing."""
    esc = lambda t: (t or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = [esc(node.text)]
    for child in node:
        tail, child.tail = child.tail, None
        out += [ElementTree.tostring(child, "unicode"), esc(tail)]
    return "".join(out)


def unit_of(node) -> dict:
    props = [{"type": p.get("type", ""), "value": "".join(p.itertext())} for p in node if _local(p.tag) == "prop"]
    tuvs = []
    for tuv in (x for x in node if _local(x.tag) == "tuv"):
        attrs = _attrs(tuv)
        seg = next((s for s in tuv if _local(s.tag) == "seg"), None)
        tuvs.append({"lang": attrs.get("xml:lang") or attrs.get("lang") or "", "attrs": attrs, "seg_xml": None if seg is None else inner_xml(seg)})
    return {"attrs": _attrs(node), "props": props, "tuvs": tuvs, "corrupt": None}


def parse_unit(chunk: str) -> dict:
    try:
        return unit_of(ElementTree.fromstring(chunk))
    except ElementTree.ParseError as error:
        # undeclared prefixes are the one thing a unit can't carry with it
        try:
            return unit_of(ElementTree.fromstring(re.sub(r"(</?|\s)(?!xml:)[A-Za-z_][\w.-]*:(?=[A-Za-z_])", r"\1", chunk)))
        except ElementTree.ParseError:
            return {"attrs": {}, "props": [], "tuvs": [], "corrupt": str(error)}


@F.pandas_udf(UNIT)
def parse_units(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_unit(x) for x in raw], columns=["attrs", "props", "tuvs", "corrupt"])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """file_id, at (order in the file), lead (what stands before the unit), raw_xml (null for the file's end)."""
    text = spark.read.option("lineSep", "</tu>").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value")
    start = F.regexp_instr("value", F.lit(r"<tu[\s>/]"))
    return rows.select("file_id", "block", "m", F.when(start > 0, F.substring("value", F.lit(1), start - 1)).otherwise(F.col("value")).alias("lead"), F.when(start > 0, F.concat(F.substring(F.col("value"), start, F.length("value")), F.lit("</tu>"))).alias("raw_xml"))


def read_tmx(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """file_id, tu_index, attrs, props, tuvs, raw_xml, lead, corrupt for each unit of the file or files.

    Files are read in splits at ``</tu>``. ``whole`` reads each file by one task instead: for other
    encodings than UTF-8, and for files with ``</tu>`` in comments. tu_index is dense and in order.
    """
    if whole:
        return _read_whole(spark, path)
    rows = read_chunks(spark, path).where("raw_xml IS NOT NULL")
    # a block's rows are consecutive; blocks are in order of their offsets
    blocks = rows.groupBy("file_id", "block").agg(F.min("m").alias("lo"), F.count("*").alias("n"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(blocks, ["file_id", "block"]).withColumn("u", parse_units("raw_xml")).select("file_id", (F.col("base") + F.col("m") - F.col("lo")).alias("tu_index"), "u.attrs", "u.props", "u.tuvs", "raw_xml", "lead", "u.corrupt")


def _read_whole(spark: SparkSession, path: str) -> DataFrame:
    kinds = f"file_id string, tu_index long, attrs map<string, string>, props array<struct<type: string, value: string>>, tuvs array<{TUV}>, raw_xml string, lead string, corrupt string"

    def run(batches):
        for batch in batches:
            for file_id, content in zip(batch["path"], batch["content"], strict=True):
                rows, inside = [], False
                for event, node in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
                    if event == "start":
                        inside = inside or node.tag == "body"
                    elif node.tag == "tu":
                        node.tail = None
                        rows.append({"file_id": file_id, "tu_index": len(rows), **unit_of(node), "raw_xml": ElementTree.tostring(node, "unicode"), "lead": "\n"})
                        node.clear()
                if not inside:
                    raise ValueError(f"{file_id}: no body")
                yield pd.DataFrame(rows, columns=["file_id", "tu_index", "attrs", "props", "tuvs", "raw_xml", "lead", "corrupt"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kinds)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """file_id, src_lang ('' if there is none), header (attributes), prefix (all before the first unit), has_body."""
    rows = read_chunks(spark, path).where("block = 0")
    first = rows.groupBy("file_id").agg(F.min_by("lead", "m").alias("prefix")).withColumn("prefix", F.regexp_replace("prefix", "^﻿", ""))
    tag = F.regexp_extract("prefix", r"(?s)<header\b([^>]*)>", 1)
    pairs = F.regexp_extract_all(tag, F.lit(r"""([\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^=]+)=", 1)), F.regexp_extract(p, r"""=\s*["'](.*)["']$""", 1)))
    out = first.withColumn("header", F.map_from_entries(entries))
    return out.select("file_id", F.coalesce(F.element_at("header", "srclang"), F.lit("")).alias("src_lang"), "header", "prefix", F.col("prefix").rlike(r"<body[\s>/]").alias("has_body"))


def require_bodies(headers: DataFrame) -> None:
    bad = [r["file_id"] for r in headers.where("NOT has_body").select("file_id").limit(10).collect()]
    if bad:
        raise ValueError(f"no body in {bad}")
