"""Pair tables (CSV and spreadsheets) and JSON states as DataFrames."""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import sys
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import settled

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


#: Characters of a chunk of lines, which is parsed by itself.
CHUNK = 1 << 17


def _records(text: str, inside: bool = False):
    """(start, end, cells) of each CSV record of whole lines. ``inside``: the lines begin within a quoted cell."""
    csv.field_size_limit(sys.maxsize)  # a cell may be of any length
    at = 0

    def lines():
        nonlocal at
        if inside:
            yield '"'
        for line in io.StringIO(text, newline=""):
            at += len(line)
            yield line

    rows = csv.reader(lines())
    while True:
        start = at
        if (cells := next(rows, None)) is None:
            return
        yield start, at, cells


def _scan(text: str, inside: bool) -> tuple[bool, int, int, int]:
    """Of lines that begin outside or inside a quoted cell: whether they end inside one, the records that begin in them, where the record that was open ends, and where one that stays open begins."""
    begun, head, end = 0, 0, "end"  # a record of its own only if no cell is open
    for start, at, _ in _records(text + end, inside):
        if at == len(text) + len(end):
            if inside and start == 0:
                return True, 0, len(text), len(text)
            return start < len(text), begun + (start < len(text)), head, start
        if inside and start == 0:
            head = at
        else:
            begun += 1
    raise AssertionError("the last record ends the text")


def _chunks(batches):
    """Runs of whole lines, numbered within their block of a file, with what _scan finds in them from both sides and the first record of a file."""

    def made(key, seq, lines):
        raw = b"".join(lines)
        text = raw.decode("utf-8")
        head = [None, None]
        if key[1] == 0 and seq == 0:
            text = text.removeprefix("\ufeff")
            head = ([c.strip() for c in next((cells for *_, cells in _records(text)), [])] + ["", ""])[:2]
        return (*key, seq, text, len(raw), *_scan(text, False), *_scan(text, True), *head)

    def each():
        key, seq, lines, size = None, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            *at, values = batch.columns
            ends = [tuple(c[k].as_py() for c in at) for k in (0, batch.num_rows - 1)]  # a block's lines follow each other
            keys = itertools.repeat(ends[0], batch.num_rows) if ends[0] == ends[1] else zip(*(c.to_pylist() for c in at), strict=True)
            for of, value in zip(keys, values.to_pylist(), strict=True):
                if of != key or size > CHUNK:
                    if lines:
                        yield made(key, seq, lines)
                    seq = seq + 1 if of == key else 0
                    key, lines, size = of, [], 0
                lines += [value, b"\n"]
                size += len(value) + 1
        if lines:
            yield made(key, seq, lines)

    for row in each():
        yield pa.RecordBatch.from_pylist([dict(zip(_CHUNK.names, row, strict=True))], schema=_CHUNK)


_CHUNK = pa.schema([("uri", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("bytes", pa.int64()), *((f"{side}_{n}", pa.bool_() if n == "open" else pa.int64()) for side in ("out", "in") for n in ("open", "begun", "head", "tail")), ("source_lang", pa.string()), ("target_lang", pa.string())])


def _placed(chunks: DataFrame) -> DataFrame:
    """uri, block, seq, head, tail, before (records that began earlier in the file), begun, bare (the file's end is no break), languages: where each chunk stands, by sums over the chunks of its file."""
    order = Window.partitionBy("uri").orderBy("block", "seq")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    # a chunk's end is open or not whatever its start; else it is as the start, or the contrary
    flips = F.sum((F.col("out_open") & ~F.col("in_open")).cast("long")).over(so_far)
    df = chunks.drop("text").withColumn("flips", flips)
    sure = F.when(F.col("out_open") == F.col("in_open"), F.struct(F.col("out_open").alias("open"), "flips"))
    df = df.withColumn("sure", F.coalesce(F.last(sure, True).over(so_far), F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("flips"))))
    ends_open = F.col("sure.open") != ((F.col("flips") - F.col("sure.flips")) % 2 == 1)
    df = df.withColumn("inside", F.lag(ends_open, 1, False).over(order))
    side = lambda n: F.when(F.col("inside"), F.col(f"in_{n}")).otherwise(F.col(f"out_{n}")).alias(n)
    lost = F.sum("bytes").over(Window.partitionBy("uri")) - F.col("size")  # 3 less with a byte order mark
    df = df.select("uri", "block", "seq", side("begun"), side("head"), side("tail"), lost.isin(1, -2).alias("bare"), *(F.first(c, True).over(so_far).alias(c) for c in ("source_lang", "target_lang")))
    return df.withColumn("before", F.coalesce(F.sum("begun").over(earlier), F.lit(0).cast("long")))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """file_id, row_index (from 2), source, target, source_lang, target_lang of CSV files whose headers hold two language codes; missing cells are ''.

    Files are read in splits, and in them by chunks of lines. Quoted cells may span lines, so each chunk is
    looked through as if it began outside and inside a cell; sums over a file's chunks tell which holds, and
    the numbers of its rows. Records that no chunk holds whole are put together of their pieces. Chunks are
    written, since Spark may cut a file otherwise when it reads it again.
    """
    of = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.option("lineSep", "\n").text(path).select(of("file_path"), of("file_block_start"), of("file_size"), F.col("value").cast("binary").alias("value"))
    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'boolean' if f.type == pa.bool_() else 'long'}" for f in _CHUNK)
    chunks = settled(lines.mapInArrow(_chunks, kinds), "lines")
    heads = chunks.where("block = 0 AND seq = 0")
    blank = spark.read.format("binaryFile").load(path).where("length <= 3").select("path")  # a byte order mark may be all there is
    bad = [_path_of(r["uri"]) for r in heads.where("source_lang = '' OR target_lang = ''").select("uri").take(1)]
    if few := [r["path"] for r in blank.collect()]:
        bad += set(few) - {_path_of(r["uri"]) for r in heads.where("size <= 3").select("uri").collect()}
    if bad:
        raise ValueError(f"{bad[0]}: the header needs two language codes")
    df = chunks.select("uri", "block", "seq", "text").join(_placed(chunks), ["uri", "block", "seq"])
    langs, n = ["source_lang", "target_lang"], F.length("text")
    whole = df.where("tail > head").select("uri", *langs, (F.col("before") + 1).alias("first"), F.substring("text", F.col("head") + 1, F.col("tail") - F.col("head")).alias("text"))
    piece = lambda at, text: F.struct(at.alias("at"), F.col("block"), F.col("seq"), text.alias("text"))
    ends = F.array(F.when(F.col("head") > 0, piece(F.col("before"), F.substring("text", F.lit(1), F.col("head")))), F.when(F.col("tail") < n, piece(F.col("before") + F.col("begun"), F.substring("text", F.col("tail") + 1, n))))
    cut = df.where((F.col("head") > 0) | (F.col("tail") < n)).select("uri", "bare", *langs, F.explode(F.array_compact(ends)).alias("e"))
    cut = cut.groupBy("uri", "bare", *langs, F.col("e.at").alias("first")).agg(F.array_sort(F.collect_list(F.struct("e.block", "e.seq", "e.text"))).alias("e"))
    text = F.array_join("e.text", "")
    # a cell that is never closed ends with the file
    cut = cut.select("uri", *langs, "first", F.when(F.col("bare"), F.regexp_replace(text, "\n\\z", "")).otherwise(text).alias("text"))

    def run(batches):
        for batch in batches:
            for uri, first, text, source_lang, target_lang in zip(*(batch[c] for c in ("uri", "first", "text", *langs)), strict=True):
                rows = [(at, *(r + ["", ""])[:2]) for at, (*_, r) in enumerate(_records(text), first) if at > 1]
                yield pd.DataFrame(rows, columns=["row_index", "source", "target"]).assign(file_id=_path_of(uri), source_lang=source_lang, target_lang=target_lang)

    return _numbered(whole.unionByName(cut).mapInPandas(run, "row_index long, source string, target string, file_id string, source_lang string, target_lang string"))


def _path_of(uri: str) -> str:
    """A file's name as Spark's binary files have it."""
    return re.sub(r"^(\w+):/+(?=/)", r"\1:", unquote(uri)) if re.match(r"\w+:///", uri) else unquote(uri)


def _numbered(df: DataFrame) -> DataFrame:
    return df.select("file_id", "row_index", "source", "target", "source_lang", "target_lang")


def pairs_of_sheet(rows: DataFrame) -> DataFrame:
    """The same of workbooks' first sheets (see read_sheet); their first rows are the headers."""
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    head = rows.where("row_index = 1").select("file_id", F.trim(cell(0)).alias("source_lang"), F.trim(cell(1)).alias("target_lang"))
    code = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(F.raise_error(F.lit("the header needs two language codes")))
    both = rows.where("row_index > 1").select("file_id", "row_index", cell(0).alias("source"), cell(1).alias("target")).join(head, "file_id")
    return both.select("file_id", "row_index", "source", "target", code("source_lang").alias("source_lang"), code("target_lang").alias("target_lang"))


def sheet_rows(content: bytes, name: str | None = None) -> list[list[str]]:
    """Values of a workbook's sheet (the first one, or by name) as text; '' for empty cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(_REL)]) for s in book.iter(f"{_NS}sheet")]
        target = next((t for n, t in sheets if n == name), sheets[0][1])
        target = target.lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    out = []
    for row in root.iter(f"{_NS}row"):
        at = int(row.get("r") or len(out) + 1)
        out += [[] for _ in range(at - 1 - len(out))]
        cells: list[str] = []
        for c in row.iter(f"{_NS}c"):
            letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
            k = 0
            for x in letters:
                k = k * 26 + ord(x) - 64
            k = k - 1 if letters else len(cells)
            cells += [""] * (k - len(cells))
            v = c.find(f"{_NS}v")
            if c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif c.get("t") == "s":
                value = strings[int(v.text)] if v is not None else ""
            else:
                value = (v.text or "") if v is not None else ""
            cells.append(value)
        out.append(cells)
    return out


def read_sheet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """file_id, row_index (from 1), cells (array of text) of each workbook's sheet; one task a workbook."""

    def run(batches):
        for batch in batches:
            for file_id, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(content, name)
                yield pd.DataFrame({"file_id": [file_id] * len(rows), "row_index": range(1, len(rows) + 1), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file_id string, row_index long, cells array<string>")


def units_of_sheet(rows: DataFrame, source_lang: str, target_lang: str, has_header: bool = True, source_column: int = 1, target_column: int = 2, comment_column: int | None = 3) -> DataFrame:
    """file_id, row_index, source, target, comment, source_lang, target_lang; rows blank in all three go. Columns count from 1."""
    columns = [c for c in (source_column, target_column, comment_column) if c is not None]
    if min(columns) < 1 or len(set(columns)) < len(columns):
        raise ValueError("columns are distinct and count from 1")
    if not source_lang.strip() or not target_lang.strip():
        raise ValueError("both languages are needed")
    cell = lambda k: F.lit("") if k is None else F.coalesce(F.get("cells", F.lit(k - 1)), F.lit(""))
    kept = rows.where("row_index > 1") if has_header else rows
    out = kept.select("file_id", "row_index", cell(source_column).alias("source"), cell(target_column).alias("target"), cell(comment_column).alias("comment"), F.lit(source_lang).alias("source_lang"), F.lit(target_lang).alias("target_lang"))
    return out.where("trim(source) <> '' OR trim(target) <> '' OR trim(comment) <> ''")


def decisions_of_sheet(rows: list[list[str]]) -> list[dict]:
    """id, decision, comment below the header row, which is looked for in the first 30 rows."""
    for k, row in enumerate(rows[:30]):
        names = [c.strip().lower() for c in row[:19]]
        if "id" in names and "decision" in names:
            at = {n: names.index(n) for n in ("id", "decision", "comment") if n in names}
            got = [{n: (r[i] if i < len(r) else "") for n, i in at.items()} for r in rows[k + 1 :]]
            return [{"id": g["id"], "decision": g["decision"], "comment": g.get("comment", "")} for g in got if g["id"]]
    return []


def decisions_of_json(text: str) -> list[dict]:
    """From a list or {"decisions": [...]}; malformed JSON gives none."""
    try:
        body = json.loads(text)
    except ValueError:
        return []
    rows = body.get("decisions", []) if isinstance(body, dict) else body
    return [{k: str(r.get(k) or "") for k in ("id", "decision", "comment")} for r in rows if isinstance(r, dict)]


def read_package(content: bytes, external: bytes | None = None, external_name: str = "") -> dict:
    """A review package: manifest, state (dicts), source (bytes), decisions.

    Decisions come from the package's decisions.json, else its report.xlsx, else the external file.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        manifest, state = (json.loads(z.read(n)) for n in ("manifest.json", "state.json"))
        source = z.read(manifest["source_name"])
        if "decisions.json" in names:
            decisions = decisions_of_json(z.read("decisions.json").decode("utf-8-sig"))
        elif "report.xlsx" in names:
            decisions = decisions_of_sheet(sheet_rows(z.read("report.xlsx"), "Review"))
        elif external is not None and external_name.endswith(".json"):
            decisions = decisions_of_json(external.decode("utf-8-sig"))
        elif external is not None:
            decisions = decisions_of_sheet(sheet_rows(external, "Review"))
        else:
            decisions = []
    return {"manifest": manifest, "state": state, "source": source, "decisions": decisions}
