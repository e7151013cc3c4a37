"""CSV, spreadsheets, JSON reports and review packages.

Spreadsheets and packages are for people to read; they are made on the driver from a
bounded number of rows (``MOST_ROWS``, a sheet's own limit).
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable
from datetime import UTC, datetime
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import before_after, check_type, numbered_lines

MOST_ROWS = 1_048_575
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
REVIEW_COLUMNS = ("id", "type", "tu", "before", "after", "decision", "comment")
DECISIONS = ("accept", "reject", "skip", "pending")


def write_pairs(pairs: DataFrame, source_lang: str, target_lang: str, path: str, whole: bool = False) -> None:
    """source, target as CSV with the languages as header: a byte order mark, quoted cells, CRLF after each row; breaks within cells stay as they are. A pair without rows gets no file.

    ``whole``: one file, not one of each partition. Partitions (in order, see orderBy) are written apart and their bytes joined, so no task holds or sorts them all.
    """
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = lambda a, b: F.concat(cell(a), F.lit(","), cell(b), F.lit("\r"))
    if whole:
        pairs.select(line(F.col("source"), F.col("target")).alias("value")).write.option("lineSep", "\n").text(f"{path}/_parts")
        quoted = ",".join('"' + c.replace('"', '""') + '"' for c in (source_lang, target_lang))
        return _join_parts(pairs.sparkSession, path, f"\ufeff{quoted}\r\n".encode())
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of a partition, which becomes a file
    head = F.when(first, F.concat(F.lit("\ufeff"), line(F.lit(source_lang), F.lit(target_lang)), F.lit("\n"))).otherwise("")
    pairs.select(F.concat(head, line(F.col("source"), F.col("target"))).alias("value")).write.option("lineSep", "\n").text(path)


def _join_parts(spark: SparkSession, path: str, head: bytes) -> None:
    """The files of ``path/_parts`` after ``head`` as one file below path, whole or not at all; their bytes pass through a buffer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at("_parts").getFileSystem(conf)
    found = [f.getPath() for f in fs.listStatus(at("_parts")) if f.getLen() and f.getPath().getName().startswith("part-")]
    if found:
        out = fs.create(at("_joined"), True)
        try:
            out.write(head)
            for part in sorted(found, key=lambda p: (int(p.getName().split("-")[1]), p.getName())):
                source = fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 22, False)
                finally:
                    source.close()
        finally:
            out.close()
        fs.rename(at("_joined"), at("part-00000.txt"))
    fs.delete(at("_parts"), True)


def pair_workbook(pairs: DataFrame, source_lang: str, target_lang: str, sheet: str = "Pairs") -> bytes:
    """source, target (in order of tu_index) as a workbook; more rows than a sheet holds are refused."""
    rows = rows_of(pairs.orderBy("tu_index").select("source", "target"))
    return workbook({sheet: [[source_lang, target_lang], *rows[1:]]})


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def _sheet(rows: list, locked: dict | None) -> str:
    width: dict[int, int] = {}
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for k, value in enumerate(row):
            value = _ILLEGAL.sub("", "" if value is None else str(value))
            width[k] = max(width.get(k, 0), len(value))
            cells.append(f'<c r="{_column(k)}{r}" t="inlineStr"{" s=\"1\"" if locked and r > 1 and k in locked["open"] else ""}><is><t xml:space="preserve">{escape(value)}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{min(max(12, n + 2), 80)}" customWidth="1"/>' for k, n in sorted(width.items()))
    guard = ""
    if locked:
        at = _column(locked["choice"])
        guard = f'<sheetProtection sheet="1" objects="1"/><dataValidations count="1"><dataValidation type="list" sqref="{at}2:{at}{max(2, len(rows))}"><formula1>"{",".join(DECISIONS)}"</formula1></dataValidation></dataValidations>'
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols>{cols}</cols><sheetData>{"".join(lines)}</sheetData>{guard}</worksheet>'


def workbook(sheets: dict[str, list], locked: dict | None = None) -> bytes:
    """Sheets by name, each a list of rows; ``locked``: columns open to edits and the one with decisions."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    app = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = range(1, len(sheets) + 1)
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{app}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{app}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{app}.worksheet+xml"/>' for k in n) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="s{k}"/>' for k, name in zip(n, sheets, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="s{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + f'<Relationship Id="style" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf applyProtection="1"><protection locked="0"/></xf></cellXfs></styleSheet>',
    } | {f"xl/worksheets/sheet{k}.xml": _sheet(rows, locked) for k, rows in zip(n, sheets.values(), strict=True)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def rows_of(df: DataFrame) -> list:
    """Header and rows for a sheet; more rows than a sheet holds are refused, not cut off."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("more rows than a sheet holds")
    return [df.columns, *map(list, rows)]


def report(summary: DataFrame, split: DataFrame, cleanup: DataFrame, warnings: DataFrame, checks: DataFrame) -> bytes:
    """The five-sheet report. summary: metric, value; the others as they are shown, ``tu`` counted from 1."""
    names = ("Summary", "Split Changes", "Auto Cleanup", "Warnings", "Verifier Checks")
    return workbook({n: rows_of(df) for n, df in zip(names, (summary, split, cleanup, warnings, checks), strict=True)})


def package(source: bytes, source_name: str, issues: DataFrame, settings: dict, now: datetime | None = None, progress: Callable[[int, int], None] | None = None, every: int = 200) -> bytes:
    """A review package: manifest, state, the source, and a sheet to decide in. issues: id, type, tu_index, before, after, ..., in order.

    ``progress`` is told (done, total) every so many rows and at the end. More issues than a sheet holds are refused.
    """
    digest = hashlib.sha256(source).hexdigest()
    rows = [r.asDict(recursive=True) for r in issues.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError("more issues than a review sheet holds")
    review = [REVIEW_COLUMNS]
    for k, r in enumerate(rows, 1):
        review.append((r["id"], r["type"], r["tu_index"] + 1, r["before"], r["after"], "pending", ""))
        if progress is not None and (k % every == 0 or k == len(rows)):
            progress(k, len(rows))
    manifest = {"package_id": digest[:16], "source_sha256": digest, "source_name": source_name, "created": (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ"), "settings": settings, "issues": len(rows)}
    state = {"issues": [r | {"status": "pending", "comment": ""} for r in rows]}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(manifest, ensure_ascii=False, sort_keys=True))
        z.writestr("state.json", json.dumps(state, ensure_ascii=False, default=str))
        z.writestr("report.xlsx", workbook({"Review": review}, {"open": {5, 6}, "choice": 5}))
        z.writestr(source_name, source)
    return out.getvalue()


def json_report(summary: dict, settings: dict, events: dict[str, list], totals: dict[str, int]) -> str:
    limits = {k: {"total": n, "stored": len(events.get(k, [])), "omitted": max(0, n - len(events.get(k, [])))} for k, n in totals.items()}
    return json.dumps({"summary": summary, "settings": settings, "events": events, "detail_event_limits": limits}, ensure_ascii=False, sort_keys=True, default=str)


#: Metrics of a summary, in order, by their names in the statistics of a run.
METRICS = (
    ("Input TMX", "input"), ("Output TMX", "output"), ("Total TU", "total"), ("Split TU", "split"), ("Output TU", "created"), ("Skipped TU", "skipped"),
    ("High Confidence", "high"), ("Medium Confidence", "medium"), ("Verifier Checked", "checked"), ("Verifier Rejected", "rejected"), ("Verifier Tokens In", "prompt_tokens"),
    ("Verifier Tokens Out", "candidate_tokens"), ("Verifier Tokens Total", "total_tokens"), ("Verifier Estimated Cost (USD)", "cost_usd"), ("AUTO Actions", "auto_actions"),
    ("AUTO Removed TU", "removed"), ("WARN Issues", "warnings"),
)


def summary_rows(stats: DataFrame) -> DataFrame:
    """file_id, place, metric, value of a run's statistics (input, output and the columns of stats.run_stats)."""
    full = stats.withColumn("total_tokens", F.col("prompt_tokens") + F.col("candidate_tokens")).withColumn("cost_usd", F.format_string("%.6f", "cost_usd"))
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("metric"), F.col(column).cast("string").alias("value")) for k, (name, column) in enumerate(METRICS)])
    return full.select("file_id", F.explode(each).alias("m")).select("file_id", "m.*")


def report_sheets(units: DataFrame, proposals: DataFrame, stats: DataFrame) -> tuple[DataFrame, ...]:
    """The five sheets' rows of one file's run, in order: summary, split changes, cleanup, warnings, checks. Units count from 1."""
    tu = (F.col("tu_index") + 1).alias("TU #")
    summary = summary_rows(stats).orderBy("place").select(F.col("metric").alias("Metric"), F.col("value").alias("Value"))
    splits = proposals.where("kind = 'split'").orderBy("tu_index")
    split = splits.select(tu, F.col("confidence").alias("Confidence"), F.coalesce("verdict", F.lit("")).alias("Verifier Verdict"), F.col("original_src").alias("Source Before"), F.col("original_tgt").alias("Target Before"), numbered_lines(F.col("src_parts")).alias("Source After Parts"), numbered_lines(F.col("tgt_parts")).alias("Target After Parts"))
    texts = [F.col(c).alias(n) for c, n in (("before_src", "Source Before"), ("after_src", "Source After"), ("before_tgt", "Target Before"), ("after_tgt", "Target After"))]
    cleanup = proposals.where("kind = 'cleanup'").orderBy("tu_index", "ordinal").select(tu, F.col("rule").alias("Rule"), F.col("message").alias("Message"), *texts, F.when(F.col("rule") == "remove_garbage_segment", F.col("message")).otherwise("").alias("Remove Reason"))
    warned = units.select("tu_index", F.posexplode("warnings").alias("k", "w")).orderBy("tu_index", "k").select(tu, F.col("w.rule").alias("Rule"), F.col("w.severity").alias("Severity"), F.col("w.message").alias("Message"))
    checks = units.where("verdict IS NOT NULL").orderBy("tu_index").select(tu, F.col("verdict").alias("Verdict"), F.col("verdict_summary").alias("Summary"), F.col("prompt_tokens").alias("Tokens In"), F.col("candidate_tokens").alias("Tokens Out"))
    return summary, split, cleanup, warned, checks


def digest_warning(package: dict, on_disk: bytes | None) -> str | None:
    """What to tell if the source beside a package (see sources.tables.read_package) is not the one in it."""
    want = package["manifest"].get("source_sha256", "").strip().lower()
    if on_disk is None or not want or (have := hashlib.sha256(on_disk).hexdigest()) == want:
        return None
    return f"{package['manifest'].get('source_name', '')} has changed: {want} in the package, {have} beside it. The package's source is used."


def overlaid(package: bytes, entries: dict[str, bytes]) -> bytes:
    """The package with these entries put in the place of its own, or added."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            if name not in entries:
                new.writestr(name, old.read(name))
        for name, body in entries.items():
            new.writestr(name, body)
    return out.getvalue()


def package_issues(proposals: DataFrame) -> DataFrame:
    """Proposals as a package's issues: id, type, tu_index, before, after, in order."""
    none = F.lit(None).cast("array<string>")
    column = lambda c: F.col(c) if c in proposals.columns else F.lit("")
    parts = tuple(F.col(c) if c in proposals.columns else none for c in ("src_parts", "tgt_parts"))
    texts = before_after(F.col("kind"), parts, *((column(f"{k}_src"), column(f"{k}_tgt")) for k in ("before", "after", "original")))
    both = lambda k: F.concat_ws("\n---\n", F.col(f"t.{k}_src"), F.col(f"t.{k}_tgt"))
    return proposals.withColumn("t", texts).select("id", check_type(F.col("kind"), F.col("rule")).alias("type"), "tu_index", both("before").alias("before"), both("after").alias("after")).orderBy("tu_index", "id")
