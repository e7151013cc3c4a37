"""Command line: repair TMX files in one go or by plan, review and apply; profile them; export and import pairs."""

from __future__ import annotations

import argparse
import importlib
import json
import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.verify import PRICE_IN, PRICE_OUT, cost
from .operators import events as E
from .operators.review import cap_details, detail_totals, merge_decisions, status_counts, unrecognized
from .operators.stats import run_stats
from .operators.units import language_pairs, pair_specs, profile
from .plans import state
from .plans.cleanup import Options
from .plans.repair import Result, Settings, new_cache_rows, repair
from .plans.storage import fresh_path, settled
from .sinks import tables
from .sinks.tmx import HEADER, sheet_units, write_pair_tmx, write_tmx
from .sources.settings import limit_or, load_env, logger, number_or, output_path, plain_path, read_template, report_path
from .sources.tables import pairs_of_sheet, read_package, read_pairs, read_sheet, units_of_sheet
from .sources.tmx import read_headers, read_tmx, require_bodies

ENV_FILES = (".env",)


class Misuse(Exception):
    """Options that do not go together; the command ends with 2."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("input", nargs="*", help="TMX files or patterns of them; with --from-sheet, workbooks")
    p.add_argument("--output", help="folder for the results of all inputs")
    p.add_argument("--output-dir", help="parent of one result folder for each input; without either, a folder named output beside it")
    p.add_argument("--dry-run", action="store_true", help="write no repaired files")
    p.add_argument("--log-file")
    p.add_argument("--whole", action="store_true", help="read each file by one task (other encodings than UTF-8)")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--profile", action="store_true", help="print what the files hold")
    mode.add_argument("--pairs", metavar="FORMAT", choices=("csv", "xlsx", "tmx", "parquet"), help="export pairs of the header's language with each other one")
    mode.add_argument("--from-sheet", metavar="SRC,TGT", help="make TMX files of workbooks with these languages")
    mode.add_argument("--from-pairs", action="store_true", help="make TMX files of CSV files with language codes as header")
    mode.add_argument("--plan", metavar="FOLDER", help="write the proposals there and change nothing")
    mode.add_argument("--apply", metavar="FOLDER", help="apply the accepted proposals of a plan")
    mode.add_argument("--apply-package", metavar="FILE", help="apply what a review package's decisions accept")
    p.add_argument("--package", metavar="FILE", help="with --plan and one input: a package to review it in")
    p.add_argument("--decisions", metavar="FILE", help="decisions beside a package (JSON or workbook)")
    for name in ("split", "split-short-pair-guard", "split-noise-guard", "cleanup-spaces", "cleanup-game", "cleanup-garbage", "cleanup-warnings"):
        p.add_argument(f"--no-{name}", action="store_true")
    for name in ("cleanup-tags", "cleanup-breaks", "cleanup-percent", "dedup"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--verifier", metavar="MODULE:NAME", help="a function that judges a split (see functions.verify.verify)")
    p.add_argument("--model", default=os.environ.get("WEFTLINE_MODEL", ""))
    p.add_argument("--parallel", default=os.environ.get("WEFTLINE_PARALLEL", "4"), help="calls in flight in a task")
    p.add_argument("--max-checks", default=os.environ.get("WEFTLINE_MAX_CHECKS", "1200"), help="distinct splits to verify in a file; 0 or 'none' for all")
    p.add_argument("--price-in", default=os.environ.get("WEFTLINE_PRICE_IN", ""), help="of a million tokens")
    p.add_argument("--price-out", default=os.environ.get("WEFTLINE_PRICE_OUT", ""))
    p.add_argument("--prompt-file", help="template of what the verifier is asked")
    p.add_argument("--verdict-cache", metavar="FOLDER", help="verdicts of earlier runs; new ones are added")
    p.add_argument("--resume-state", metavar="FOLDER", help="files that are done; these are left out, new ones are added")
    p.add_argument("--json-report", metavar="FILE")
    p.add_argument("--report-dir", metavar="FOLDER", help="JSON reports by input")
    p.add_argument("--xlsx-report", metavar="FILE")
    p.add_argument("--xlsx-report-dir", metavar="FOLDER", help="workbook reports by input")
    return p


def settings_of(a: argparse.Namespace) -> Settings:
    options = Options(
        normalize_spaces=not a.no_cleanup_spaces, remove_line_breaks=a.cleanup_breaks, remove_percent_wrapped_tokens=a.cleanup_percent, remove_game_markup=not a.no_cleanup_game,
        remove_inline_tags=a.cleanup_tags, remove_garbage_segments=not a.no_cleanup_garbage, emit_warnings=not a.no_cleanup_warnings,
    )
    more = {"template": read_template(a.prompt_file)} if a.prompt_file else {}
    return Settings(cleanup=options, split=not a.no_split, short_pair_guard=not a.no_split_short_pair_guard, noise_guard=not a.no_split_noise_guard, dedup=a.dedup, model=a.model, max_checks=limit_or(a.max_checks, 1200), parallel=limit_or(a.parallel, 4) or 4, **more)


def exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def checked(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """The inputs; ``Misuse`` for what cannot be run."""
    by_path: dict[str, str] = {}
    for p in a.input:
        if plain_path(p):
            by_path.setdefault(plain_path(p).lower(), p.strip())
    inputs = list(by_path.values())  # URIs stay URIs: Spark reads them
    if not inputs and not a.apply_package:
        raise Misuse("no input")
    for path in inputs:
        if not exists(spark, path):
            raise Misuse(f"no such file: {path}")
    if len(inputs) > 1:
        for name in ("output", "json_report", "xlsx_report", "resume_state", "package"):
            if getattr(a, name):
                raise Misuse(f"--{name.replace('_', '-')} goes with one input only")
    if a.package and not a.plan:
        raise Misuse("--package goes with --plan")
    s = settings_of(a)
    if not (s.split or s.dedup or any(vars(s.cleanup).values())):
        raise Misuse("nothing is switched on")
    return inputs


def verifier_of(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    try:
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as error:
        raise Misuse(f"no verifier {name}: {error}") from None


def raw_file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def reports(a: argparse.Namespace, result: Result, total: dict, settings: Settings, json_file: str | None, xlsx_file: str | None, source: str, output: str) -> None:
    if json_file:
        kinds = result.proposals.withColumn("event", F.when(F.col("kind") == "split", "split").otherwise(F.col("rule")))
        stored = cap_details(kinds.select("event", "file_id", "tu_index", "id"), ["event"], ["file_id", "tu_index"])
        found: dict = {}
        for r in stored.collect():  # at most the cap for each kind
            found.setdefault(r["event"], []).append(r["id"])
        totals = {r["event"]: r["total"] for r in detail_totals(kinds, ["event"]).collect()}
        os.makedirs(os.path.dirname(json_file) or ".", exist_ok=True)
        with open(json_file, "w", encoding="utf-8") as f:
            f.write(tables.json_report(total, {"split": settings.split, "dedup": settings.dedup, **vars(settings.cleanup)}, found, totals))
    if xlsx_file:
        stats = result.units.sparkSession.createDataFrame([{k: v for k, v in total.items() if v is not None and k != "file_id"}]).withColumns({"input": F.lit(source), "output": F.lit(output), "file_id": F.lit(source)})
        os.makedirs(os.path.dirname(xlsx_file) or ".", exist_ok=True)
        with open(xlsx_file, "wb") as f:
            f.write(tables.report(*tables.report_sheets(result.units, result.proposals, stats)))


def run_one(spark: SparkSession, a: argparse.Namespace, source: str, accepted: DataFrame | None, verifier, log) -> dict:
    """Plans or repairs one input (a file or a pattern): its statistics."""
    settings = settings_of(a)
    output = a.output or output_path(source, folder=a.output_dir)
    headers, tu = read_headers(spark, source), read_tmx(spark, source, a.whole)
    require_bodies(headers)
    if a.resume_state:
        files = tu.groupBy("file_id").agg(F.count("*").alias("total_tus")).withColumn("output", F.lit(output))
        state_path = f"{a.resume_state}/{safe_text(source)}"
        done = spark.read.parquet(state_path) if exists(spark, state_path) else spark.createDataFrame([], files.schema)
        left = state.to_do(files, done)
        if left.isEmpty():
            log.info("%s is done already", source)
            return {}
        tu, headers = tu.join(left.select("file_id"), "file_id", "left_semi"), headers.join(left.select("file_id"), "file_id", "left_semi")
    cache = state.read_cache(spark, a.verdict_cache) if a.verdict_cache else None
    result = repair(tu, headers, settings, accepted, verifier, cache)
    if a.plan:
        totals = result.units.groupBy("file_id").agg(F.count("*").alias("total_tus"))
        state.write_plan(state.plan_rows(result.proposals), totals, a.plan)
        if a.package:
            body = tables.package(raw_file(spark, source), os.path.basename(source), tables.package_issues(result.proposals), {"split": settings.split, **vars(settings.cleanup)})
            with open(a.package, "wb") as f:
                f.write(body)
    elif not a.dry_run:
        write_tmx(result.output, headers, output)
        if a.resume_state:
            state.done_rows(result.units, headers.select("file_id", F.lit(output).alias("output"))).select("file_id", "total_tus", "output").write.mode("append").parquet(state_path)
    if a.verdict_cache and verifier is not None:
        # settled first: the folder that is written is read for it
        state.write_cache(settled(state.merge_cache(cache, new_cache_rows(result.units)), "verdicts"), a.verdict_cache)
    total = run_stats(result.units).where("file_id IS NULL").withColumn("cost_usd", cost(F.col("prompt_tokens"), F.col("candidate_tokens"), number_or(a.price_in, PRICE_IN), number_or(a.price_out, PRICE_OUT))).first().asDict()
    json_file = a.json_report or (report_path(source, "verification.json", folder=a.report_dir) if a.report_dir else None)
    xlsx_file = a.xlsx_report or (report_path(source, "diff-report.xlsx", folder=a.xlsx_report_dir) if a.xlsx_report_dir else None)
    reports(a, result, total, settings, json_file, xlsx_file, source, output)
    E.deliver(E.shown(E.run_events(result.units).where("event IN ('file_start', 'file_complete')")), lambda e: log.info("%s %s %s", e["event"], unquote(e["file_id"]), e["detail"]), log)
    return total


def safe_text(name: str) -> str:
    return "".join("_" if c in '\\/:*?"<>|' else c for c in name)


def apply_package(spark: SparkSession, a: argparse.Namespace, verifier, log) -> dict:
    """Applies what the decisions of a package accept to the source in it."""
    external = raw_file(spark, a.decisions) if a.decisions else None
    package = read_package(raw_file(spark, a.apply_package), external, a.decisions or "")
    beside = os.path.join(os.path.dirname(a.apply_package), package["manifest"]["source_name"])
    if warning := tables.digest_warning(package, raw_file(spark, beside) if exists(spark, beside) else None):
        log.warning(warning)
    folder = fresh_path(spark, "package")
    source = f"{folder}/{package['manifest']['source_name']}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(package["source"])
    out.close()
    issues = spark.createDataFrame([(i["id"], i.get("tu_index"), i.get("status") or "pending", i.get("comment") or "", k) for k, i in enumerate(package["state"]["issues"])], "id string, tu_index long, status string, comment string, seq long")
    decided = spark.createDataFrame([(d["id"], d["decision"], d["comment"], k) for k, d in enumerate(package["decisions"])], "id string, decision string, comment string, seq long")
    merged = merge_decisions(issues, decided)
    counts = status_counts(merged).first().asDict() | {"unrecognized": unrecognized(issues, decided).count()}
    log.info("decisions: %s", counts)
    file_id = read_headers(spark, source).select("file_id")
    accepted = merged.where("status = 'accepted'").select(F.lit(file_id.first()["file_id"]).alias("file_id"), "id")
    a.output = a.output or output_path(a.apply_package, folder=a.output_dir)
    return run_one(spark, a, source, accepted, verifier, log) | {"decisions": counts}


def export(spark: SparkSession, a: argparse.Namespace, source: str) -> None:
    headers, tu = read_headers(spark, source), read_tmx(spark, source, a.whole)
    output = a.output or output_path(source, folder=a.output_dir)
    specs = pair_specs(profile(tu, headers).join(headers.select("file_id", "src_lang"), "file_id"))
    if a.pairs == "tmx":
        write_pair_tmx(tu, specs, headers, output)
        return
    langs = [r["source"] for r in specs.select("source").distinct().collect()]  # one a file at most
    for lang in langs:
        own = tu.join(headers.where(F.col("src_lang") == lang).select("file_id"), "file_id", "left_semi")
        pairs = language_pairs(own, lang)
        if a.pairs == "parquet":
            pairs.write.mode("append").partitionBy("target_lang").parquet(output)
            continue
        for row in pairs.select("target_lang").distinct().collect():  # languages, few
            one = pairs.where(F.col("target_lang") == row["target_lang"])
            name = f"{output}/{safe_text(lang)}-{safe_text(row['target_lang'])}"
            if a.pairs == "csv":
                tables.write_pairs(one.orderBy("file_id", "tu_index"), lang, row["target_lang"], name)
            else:
                os.makedirs(output, exist_ok=True)
                with open(f"{name}.xlsx", "wb") as f:
                    f.write(tables.pair_workbook(one, lang, row["target_lang"]))


def build(spark: SparkSession, a: argparse.Namespace, source: str) -> None:
    if a.from_sheet:
        src, _, tgt = a.from_sheet.partition(",")
        rows = units_of_sheet(read_sheet(spark, source), src.strip(), tgt.strip())
    else:
        rows = (pairs_of_sheet(read_sheet(spark, source)) if source.endswith((".xlsx", ".xlsm")) else read_pairs(spark, source)).withColumn("comment", F.lit(""))
    start = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4">\n'), F.replace(F.lit(HEADER), F.lit("{src}"), F.col("source_lang")), F.lit("\n<body>"))
    prefixes = rows.groupBy("file_id").agg(F.first("source_lang").alias("source_lang")).select("file_id", start.alias("prefix"))
    write_tmx(sheet_units(rows), prefixes, a.output or output_path(source, folder=a.output_dir))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    load_env(ENV_FILES)
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    log = logger(a.log_file)
    try:
        inputs = checked(spark, a)
        verifier = verifier_of(a.verifier)
        if a.apply_package:
            print(json.dumps(apply_package(spark, a, verifier, log), default=str))
            return 0
        accepted = None
        if a.apply:
            accepted = state.accepted_of(state.read_plan(spark, a.apply)[0])
        for source in inputs:
            if a.profile:
                headers = read_headers(spark, source)
                require_bodies(headers)
                profile(read_tmx(spark, source, a.whole), headers).show(truncate=False)
            elif a.pairs:
                export(spark, a, source)
            elif a.from_sheet or a.from_pairs:
                build(spark, a, source)
            else:
                print(json.dumps(run_one(spark, a, source, accepted, verifier, log), default=str))
    except Misuse as error:
        print(f"Error: {error}")
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
