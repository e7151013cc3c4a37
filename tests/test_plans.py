"""Plans, packages, state, settings, events and the command line."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import events, units
from weftline.plans import state
from weftline.plans.repair import Settings, repair
from weftline.sinks import tables as out_tables
from weftline.sources import settings, tables, tmx

TMX = """<?xml version="1.0" encoding="UTF-8"?>
<tmx version="1.4">
  <header srclang="en" adminlang="en" datatype="plaintext"/>
  <body>
    <tu creationid="u"><prop type="x-Note">n</prop><tuv xml:lang="en"><seg>Here is the first long sentence of it. Here is the second long sentence.</seg></tuv><tuv xml:lang="ru"><seg>Это первое длинное предложение текста. Это второе длинное предложение.</seg></tuv></tu>

    <tu><tuv xml:lang="en"><seg>two  spaces &amp; one<ph x="1"/></seg></tuv><tuv xml:lang="ru"><seg>два пробела</seg></tuv></tu>
    <!-- kept --><tu><tuv xml:lang="en"><seg>plain</seg></tuv><tuv xml:lang="ru"><seg>просто</seg></tuv><tuv xml:lang="de"><seg> </seg></tuv></tu>
  </body>
</tmx>
"""


@pytest.fixture()
def file(tmp_path):
    (tmp_path / "m.tmx").write_text(TMX, encoding="utf-8")
    return f"file://{tmp_path}/m.tmx"


def text_of(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("**/part-*"))).decode()


def test_untouched_files_come_out_as_they_were(spark, file, tmp_path):
    """Separators, comments and indents stay; the last line is the one thing that may differ."""
    assert cli.main([file, "--output", f"file://{tmp_path}/o", "--no-split", "--no-cleanup-spaces", "--no-cleanup-game", "--no-cleanup-garbage"], spark) == 0
    assert text_of(tmp_path / "o").split() == TMX.split() and "\n\n    <tu><tuv" in text_of(tmp_path / "o") and "\n    <!-- kept --><tu>" in text_of(tmp_path / "o")


def test_plan_then_apply_some_of_it(spark, file, tmp_path):
    plan = f"file://{tmp_path}/plan"
    assert cli.main([file, "--plan", plan, "--package", f"{tmp_path}/p.zip"], spark) == 0
    rows, totals = state.read_plan(spark, plan)
    assert {r.proposal_id for r in rows.collect()} == {"split:0", "cleanup:1:normalize_spaces:0"} and totals.first().total_tus == 3
    state.write_plan(rows.withColumn("accepted", F.col("kind") == "cleanup"), totals, f"{plan}2")
    assert cli.main([file, "--apply", f"{plan}2", "--output", f"file://{tmp_path}/a"], spark) == 0
    out = text_of(tmp_path / "a")
    assert "<seg>two spaces &amp; one" in out and "of it. Here" in out and out.count("<tu") - out.count("<tuv") == 3


def test_package_with_decisions_is_applied(spark, file, tmp_path, capsys):
    assert cli.main([file, "--plan", f"file://{tmp_path}/plan", "--package", f"{tmp_path}/p.zip"], spark) == 0
    (tmp_path / "d.json").write_text(json.dumps([{"id": "split:0", "decision": "accept"}, {"id": "nobody", "decision": "accept"}]))
    raw = (tmp_path / "p.zip").read_bytes()
    package = tables.read_package(raw)
    assert out_tables.digest_warning(package, TMX.encode()) is None and "has changed" in out_tables.digest_warning(package, b"x") and out_tables.digest_warning(package, None) is None
    (tmp_path / "q.zip").write_bytes(out_tables.overlaid(raw, {"decisions.json": (tmp_path / "d.json").read_bytes()}))
    assert cli.main(["--apply-package", f"{tmp_path}/q.zip", "--output", f"file://{tmp_path}/a"], spark) == 0
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said["split"] == 1 and said["decisions"]["accepted"] == 1 and said["decisions"]["unrecognized"] == 1
    assert text_of(tmp_path / "a").count(units.CONFIDENCE_PROP) == 2


def test_full_package_is_refused(spark, monkeypatch):
    monkeypatch.setattr(out_tables, "MOST_ROWS", 3)
    issues = spark.range(6).select(F.col("id").cast("string").alias("id"), F.lit("split").alias("type"), F.col("id").alias("tu_index"), F.lit("a").alias("before"), F.lit("b").alias("after"))
    with pytest.raises(ValueError):
        out_tables.package(b"x", "x.tmx", issues, {})
    told = []
    out_tables.package(b"x", "x.tmx", issues.limit(3), {}, progress=lambda n, m: told.append((n, m)), every=2)
    assert told == [(2, 3), (3, 3)]


def test_a_plans_verdict_is_not_asked_for_again(spark, file):
    tu, headers = tmx.read_tmx(spark, file), tmx.read_headers(spark, file)

    def never(row):
        raise AssertionError("called")

    for verdict, confidence, outputs in (("ok", "medium", 2), ("FAIL", "HIGH", 1), ("odd", "odd", 2)):
        accepted = spark.createDataFrame([(headers.first().file_id, "split:0", confidence, verdict)], "file_id string, id string, confidence string, verdict string")
        r = repair(tu, headers, Settings(), accepted, None if verdict == "odd" else never).units.where("tu_index = 0").first()
        assert (r.outputs, r.confidence, r.verdict) == (outputs, confidence.upper() if verdict != "odd" else "HIGH", verdict.upper() if verdict != "odd" else None)


def test_prompt_reaches_the_verifier_and_cache_and_state_are_kept(spark, file, tmp_path):
    got = repair(tmx.read_tmx(spark, file), tmx.read_headers(spark, file), Settings(template="{PAIR_COUNT} of {SRC_LANG}"), verifier=lambda r: {"verdict": "OK", "summary": r["prompt"]}).units.where("tu_index = 0").first()
    assert got.verdict_summary.startswith("2 of en\n\nAuto context JSON:")
    args = [file, "--output", f"file://{tmp_path}/o", "--verifier", "tests.test_plans:judge", "--verdict-cache", f"file://{tmp_path}/c", "--resume-state", f"file://{tmp_path}/s", "--xlsx-report", f"{tmp_path}/r.xlsx", "--json-report", f"{tmp_path}/r.json"]
    assert cli.main(args, spark) == 0
    assert state.read_cache(spark, f"file://{tmp_path}/c").count() == 1 and state.read_cache(spark, f"file://{tmp_path}/none").count() == 0
    sheet = tables.sheet_rows((tmp_path / "r.xlsx").read_bytes(), "Summary")
    assert len(sheet) == 18 and ["Split TU", "1"] in sheet and json.loads((tmp_path / "r.json").read_text())["summary"]["checked"] == 1
    assert cli.main(args, spark) == 0  # nothing is left to do
    assert cli.main([file, "--verifier", "tests.test_plans:nobody"], spark) == 2


def judge(row):
    return {"verdict": "OK", "summary": "fine", "prompt_tokens": 10, "candidate_tokens": 2}


def test_strict_plans(spark):
    bad = spark.createDataFrame([('{"input_path": "a", "total_tus": 1, "proposals": [{"proposal_id": "x", "color": 1}]}',)], "json string")
    with pytest.raises(Exception, match="color"):
        state.plan_of_json(bad).collect()


def test_exports_and_imports(spark, file, tmp_path):
    for kind in ("csv", "xlsx", "tmx", "parquet"):
        assert cli.main([file, "--pairs", kind, "--output", f"file://{tmp_path}/{kind}" if kind != "xlsx" else f"{tmp_path}/xlsx"], spark) == 0
    csv = tables.read_pairs(spark, f"file://{tmp_path}/csv/en-ru/*.txt").orderBy("row_index").collect()
    assert [(r.row_index, r.source) for r in csv][1:] == [(3, "two  spaces & one{ph: x=1}"), (4, "plain")]
    assert not (tmp_path / "csv" / "en-de").exists()  # its only pair is blank
    assert tables.sheet_rows((tmp_path / "xlsx" / "en-ru.xlsx").read_bytes())[3] == ["plain", "просто"]
    assert text_of(tmp_path / "tmx" / "file=m.tmx" / "pair=en-de").count("<tu>") == 1
    assert spark.read.parquet(f"file://{tmp_path}/parquet").count() == 3
    assert cli.main([f"{tmp_path}/xlsx/en-ru.xlsx", "--from-sheet", "en,ru", "--output", f"file://{tmp_path}/t"], spark) == 0
    assert text_of(tmp_path / "t").count("<seg>") == 6
    assert cli.main([f"file://{tmp_path}/csv/en-ru/*.txt", "--from-pairs", "--output", f"file://{tmp_path}/u"], spark) == 0
    assert text_of(tmp_path / "u").count("<seg>") == 6


def test_misuse(spark, file, tmp_path):
    (tmp_path / "n.tmx").write_text(TMX)
    both = [file, f"file://{tmp_path}/n.tmx"]
    assert all(cli.main(args, spark) == 2 for args in ([], [*both, "--output", "x"], [*both, "--json-report", "x"], [file, "--package", "x"]))


def test_settings(tmp_path):
    assert [settings.plain_path(p) for p in (' "a b" ', "file:///C:/d%20e.tmx", "FILE://host/s/f.tmx", "file:///x/y", "", None)] == ["a b", "C:/d e.tmx", "//host/s/f.tmx", "/x/y", "", ""]
    assert settings.distinct_paths(["b", "A", "a", " ", "B "]) == ["b", "A"]
    assert settings.output_path("/a/b.tmx") == "/a/output/b_repaired.tmx" and settings.output_path("/a/b.tmx", folder="/c") == "/c/b_repaired.tmx" and settings.cleaned_path("x/b.CSV", "o") == "o/b__cleaned.csv"
    assert settings.report_path("/a/b.tmx", "verification.json") == "/a/output/b.verification.json" and settings.report_path("/a/b.tmx", "diff-report.xlsx", folder="r") == "/a/r/b/b.diff-report.xlsx"
    (tmp_path / ".env").write_text("\ufeff# c\nA=1\nB = 'two words' \n=x\nC\nD=\"\n")
    env = {"A": "kept", "B": " "}
    assert settings.load_env([str(tmp_path / "no"), str(tmp_path / ".env")], env) == [str(tmp_path / ".env")] and env == {"A": "kept", "B": "two words", "D": '"'}
    assert [settings.number_or(x, 5.0) for x in ("", "x", "-1", "2.5", None)] == [5.0, 5.0, 5.0, 2.5, 5.0]
    assert [settings.limit_or(x, 7) for x in ("", "none", "0", "-3", "12", "x", None)] == [7, None, None, None, 12, 7, 7]
    log = settings.logger(str(tmp_path / "l.txt"), {settings.LOG_LEVEL: "error", settings.FILE_LOG_LEVEL: "INFO"})
    log.info("told")
    assert "[INFO] told" in (tmp_path / "l.txt").read_text() and log.handlers[0].level == logging.ERROR
    (tmp_path / "t.txt").write_text("\ufeffask {X}", encoding="utf-8")
    assert settings.read_template(str(tmp_path / "t.txt")) == "ask {X}"
    settings.logger()


def test_events_are_delivered_in_order_and_can_stop(spark, file):
    found = events.run_events(repair(tmx.read_tmx(spark, file), tmx.read_headers(spark, file)).units)
    seen = []

    def note(event):
        seen.append((event["event"], event["detail"]))
        if event["event"] == "warning":
            raise ValueError("a display's own trouble")

    n = events.deliver(found, note)
    assert n == len(seen) and seen[0] == ("file_start", "") and seen[-1] == ("file_complete", "3")
    assert [e for e in seen if e[0] in ("tu_split_applied", "tu_skipped")] == [("tu_split_applied", "2"), ("tu_skipped", "no_split_proposal"), ("tu_skipped", "multilang_tu")]
    shown = events.shown(found, every=1000).collect()
    assert {r.event for r in shown} >= {"file_start", "file_complete", "warning"} and len(shown) < n

    def stop(event):
        raise events.Stopped

    with pytest.raises(events.Stopped):
        events.deliver(found, stop)


def test_a_run_can_be_stopped(spark):
    import threading
    import time

    slow = events.Run(spark, "slow", lambda s: s.range(0, 2 * 10**10, 1, 4).select(F.sum(F.sqrt("id"))).collect())
    out = []
    t = threading.Thread(target=lambda: out.append(_outcome(slow)))
    t.start()
    time.sleep(3)
    slow.stop()
    t.join(90)
    assert out == ["stopped"] and slow.stopped and events.Run(spark, "quick", lambda s: s.range(3).count()).start() == 3


def _outcome(run):
    try:
        return run.start()
    except Exception:  # noqa: BLE001  Spark's own kinds of cancellation
        return "stopped"


def test_last_variant_of_a_language_wins_and_names_of_languages(spark):
    t = "tuvs array<struct<lang: string, attrs: map<string, string>, seg_xml: string>>"
    u = spark.createDataFrame([("f", 0, [("en", {"changeid": "x", "o-lang": "fr", "xml:lang": "en"}, "a"), ("en", {}, "b<ph/>&amp;"), ("ru", {}, None)])], f"file_id string, tu_index long, {t}")
    assert units.segments_by_language(u).first().segments == {"en": "b&", "ru": ""}
    from weftline.functions.tuv import named_lang

    got = u.select(F.transform("tuvs", lambda v: named_lang(v["attrs"])).alias("x")).first().x
    assert got[0] in ("fr", "en") and got[1:] == ["", ""]
