"""TMX in and out, the repair plan, review packages, verifier, statistics, streaming and the command line."""

import csv
import io
import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.functions import diff, verify
from weftline.operators import review, stats, units
from weftline.plans.cleanup import Options
from weftline.plans.repair import Settings, new_cache_rows, repair
from weftline.sinks import tables as out_tables
from weftline.sinks import tmx as out_tmx
from weftline.sources import tables, tmx
from weftline.streaming import progress

TMX = """<?xml version="1.0" encoding="UTF-8"?>
<tmx version="1.4"><header srclang="en" creationtool="t &amp; u" datatype="plaintext"/><body>
  <tu creationid="1"><prop type="x-Context">c</prop><prop type="x-Note">n &amp; m</prop><tuv xml:lang="en-US"><seg>This is the first long sentence of it. And here comes the second sentence too.</seg></tuv><tuv xml:lang="ru-RU"><seg>Это первое длинное предложение текста. А вот идёт второе предложение тоже.</seg></tuv></tu>
  <tu><tuv lang="ru"><seg>Привет  <ph x="1"/> мир &lt;b&gt;</seg></tuv><tuv lang="en"><seg>Hello  <ph x="1"/> world &lt;b&gt;</seg></tuv></tu>
  <tu><tuv xml:lang="en"><seg>a</seg></tuv><tuv xml:lang="ru"><seg>b</seg></tuv><tuv xml:lang="de"><seg>c</seg></tuv></tu>
  <tu><tuv xml:lang="en"><seg>12345</seg></tuv><tuv xml:lang="ru"><seg>двенадцать</seg></tuv></tu>
  <tu><tuv xml:lang="en"><seg>12345</seg></tuv><tuv xml:lang="ru"><seg>двенадцать</seg></tuv></tu>
  <tu><tuv xml:lang="en"><seg>Only one</seg></tuv></tu>
</body></tmx>
"""


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "memory.tmx"
    path.write_text("﻿" + TMX, encoding="utf-8")
    return f"file://{path}"


def run(spark, file, **settings):
    accepted, verifier, cache = (settings.pop(k, None) for k in ("accepted", "verifier", "cache"))
    return repair(tmx.read_tmx(spark, file), tmx.read_headers(spark, file), Settings(**settings), accepted, verifier, cache)


@pytest.mark.parametrize("whole", [False, True])
def test_tmx_scan_is_lossless(spark, file, whole):
    rows = tmx.read_tmx(spark, file, whole).orderBy("tu_index").collect()
    assert [r.tu_index for r in rows] == list(range(6)) and all(r.corrupt is None for r in rows)
    assert rows[0].attrs == {"creationid": "1"} and [(p.type, p.value) for p in rows[0].props] == [("x-Context", "c"), ("x-Note", "n & m")]
    assert rows[1].tuvs[0].seg_xml == 'Привет  <ph x="1" /> мир &lt;b&gt;' and rows[1].tuvs[0].lang == "ru"
    head = tmx.read_headers(spark, file).first()
    assert head.src_lang == "en" and head.has_body and head.prefix.startswith("<?xml")
    tmx.require_bodies(tmx.read_headers(spark, file))


def test_tmx_split_over_many_blocks_keeps_order(spark, tmp_path):
    units_ = "".join(f'<tu tuid="{k}"><tuv xml:lang="en"><seg>s{k} {"x" * 200}</seg></tuv></tu>\n' for k in range(3000))
    (tmp_path / "big.tmx").write_text(f'<tmx version="1.4"><header srclang="en"/><body>\n{units_}</body></tmx>')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = tmx.read_tmx(spark, f"file://{tmp_path}/big.tmx")
        assert df.select("tu_index", F.col("attrs")["tuid"].cast("long").alias("id")).where("tu_index = id").count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_corrupt_units_pass_through(spark, tmp_path):
    (tmp_path / "bad.tmx").write_text('<tmx><header/><body><tu><tuv xml:lang="en"><seg>a &nbsp; b</seg></tuv></tu></body></tmx>')
    r = run(spark, f"file://{tmp_path}/bad.tmx")
    row = r.units.first()
    assert row.skip_reason == "corrupt" and "&nbsp;" in r.output.first().unit


def test_repair_defaults(spark, file):
    r = run(spark, file)
    rows = {x.tu_index: x for x in r.units.collect()}
    assert (rows[0].src_lang, rows[0].tgt_lang, rows[0].outputs, rows[0].confidence) == ("en-US", "ru-RU", 2, "HIGH")
    assert rows[1].src_lang == "en" and rows[1].clean_src == 'Hello <ph x="1" /> world &lt;b&gt;' and rows[1].outputs == 1
    assert rows[2].skip_reason == "multilang_tu" and rows[2].warnings[0].rule == "multilang_tu_skipped"
    assert rows[3].remove_reason == rows[4].remove_reason == "numeric_only_side" and rows[5].skip_reason == "less_than_two_tuv"
    s = {x.file_id is None: x for x in stats.run_stats(r.units).collect()}[True]
    assert (s.total, s.split, s.created, s.removed, s.skipped, s.high, s.tgt_lang) == (6, 1, 5, 2, 2, 1, "ru")
    out = [x.unit for x in r.output.orderBy("tu_index", "part_index").collect()]
    assert len(out) == 5 and "x-Context" not in out[0] and "x-Note" in out[1] and units.CONFIDENCE_PROP in out[0]
    assert "<seg>And here comes the second sentence too.</seg>" in out[1]
    ids = {x.id for x in r.proposals.collect()}
    assert ids == {"split:0", "cleanup:1:normalize_spaces:0", "cleanup:3:remove_garbage_segment:0", "cleanup:4:remove_garbage_segment:0"}


def test_dedup_keeps_the_first(spark, file):
    r = run(spark, file, dedup=True, cleanup=Options(remove_garbage_segments=False))
    assert {x.tu_index: x.remove_reason for x in r.units.collect() if x.remove_reason} == {4: "dedup_tu"}
    assert "cleanup:4:dedup_tu:0" in {x.id for x in r.proposals.collect()}


def test_only_accepted_proposals_are_applied(spark, file):
    file_id = tmx.read_headers(spark, file).first().file_id
    accepted = spark.createDataFrame([(file_id, "cleanup:1:normalize_spaces:0")], "file_id string, id string")
    rows = {x.tu_index: x for x in run(spark, file, accepted=accepted).units.collect()}
    assert rows[1].n_actions == 1 and rows[0].outputs == 1 and rows[3].outputs == 1 and rows[0].skip_reason == "not_selected_for_apply"
    accepted = spark.createDataFrame([(file_id, "split:0")], "file_id string, id string")
    assert [x.outputs for x in run(spark, file, accepted=accepted).units.orderBy("tu_index").collect()] == [2, 1, 1, 1, 1, 1]


@pytest.mark.parametrize(("verdict", "outputs", "confidence", "pending"), [("OK", 2, "MEDIUM", False), ("FAIL", 1, "MEDIUM", False), ("down", 1, "MEDIUM", True)])
def test_verifier_decides(spark, file, verdict, outputs, confidence, pending):
    def check(row):
        if verdict == "down":
            raise OSError("no line")
        return {"verdict": verdict, "summary": "s", "prompt_tokens": 111, "candidate_tokens": 22}

    r = run(spark, file, verifier=check)
    row = r.units.where("tu_index = 0").first()
    assert (row.outputs, row.confidence, row.pending) == (outputs, confidence, pending)
    if verdict != "down":
        total = stats.run_stats(r.units).where("file_id IS NULL").first()
        assert (total.prompt_tokens, total.checked, total.rejected) == (111, 1, verdict == "FAIL") and total.cost_usd > 0
        kept = new_cache_rows(r.units).collect()
        assert len(kept) == 1
        again = run(spark, file, verifier=lambda row: 1 / 0, cache=spark.createDataFrame(kept)).units.where("tu_index = 0").first()
        assert (again.verdict, again.prompt_tokens, again.confidence) == (verdict, 0, "MEDIUM")
    else:
        assert new_cache_rows(r.units).count() == 0


def test_unverified_beyond_the_call_limit(spark, file):
    row = run(spark, file, verifier=lambda r: {"verdict": "FAIL"}, max_checks=0).units.where("tu_index = 0").first()
    assert row.verdict is None and row.confidence == "HIGH" and row.outputs == 2


def test_written_tmx_reads_back(spark, file, tmp_path):
    r = run(spark, file)
    out_tmx.write_tmx(r.output, tmx.read_headers(spark, file), f"file://{tmp_path}/out")
    again = tmx.read_tmx(spark, f"file://{tmp_path}/out/*/*.txt", whole=True).orderBy("tu_index").collect()
    assert len(again) == 5 and again[0].tuvs[1].seg_xml == "Это первое длинное предложение текста."
    assert [p.type for p in again[0].props] == [units.CONFIDENCE_PROP, "x-Note"]


def test_profile_and_pairs(spark, file):
    tu, head = tmx.read_tmx(spark, file), tmx.read_headers(spark, file)
    p = units.profile(tu, head).first()
    assert p.tu_count == 6 and p.languages == ["en", "de", "en-US", "ru", "ru-RU"] and p.inline_tags == ["ph"]
    got = {(r.tu_index, r.target_lang): r.source for r in units.language_pairs(tu, "en").collect()}
    assert set(got) == {(1, "ru"), (2, "ru"), (2, "de"), (3, "ru"), (4, "ru")}


def test_csv_pairs(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿en,ru\r\n"a, ""q""\nb",в\r\nonly\r\n', encoding="utf-8")
    rows = tables.read_pairs(spark, f"file://{tmp_path}/p.csv").orderBy("row_index").collect()
    assert [(r.row_index, r.source, r.target, r.target_lang) for r in rows] == [(2, 'a, "q"\nb', "в", "ru"), (3, "only", "", "ru")]
    (tmp_path / "bad.csv").write_text("en\nx\n")
    with pytest.raises(ValueError):
        tables.read_pairs(spark, f"file://{tmp_path}/bad.csv")
    out_tables.write_pairs(spark.createDataFrame(rows), "en", "ru", f"file://{tmp_path}/o")
    text = b"".join(p.read_bytes() for p in (tmp_path / "o").glob("*.txt")).decode("utf-8-sig")
    assert text.startswith('"en","ru"\r\n"a, ""q""\nb","в"\r\n')


def test_csv_is_read_in_splits_as_a_parser_reads_it_whole(spark, tmp_path):
    rng = random.Random(7)
    csv.field_size_limit(sys.maxsize)
    for k in range(6):
        body = "".join(rng.choice('ab,,""\n\n\ré"') for _ in range(rng.randint(0, 300)))
        (tmp_path / f"p {k}+%41.csv").write_text(("\ufeff" if k % 2 else "") + "en,ru\r\n" + body, encoding="utf-8", newline="")
    (tmp_path / "p long.csv").write_text('en,ru\n"' + "x\n" * 200_000 + '",y\n' + 'a,"b\n"\n' * 60_000, encoding="utf-8", newline="")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("50", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            name = "p [0-9]*.csv" if size == "50" else "p *.csv"
            df = tables.read_pairs(spark, f"file://{tmp_path}/{name}")
            got = {(r.file_id, r.row_index): (r.source, r.target, r.source_lang, r.target_lang) for r in df.collect()}
            want = {}
            for p in tmp_path.glob(name):
                rows = csv.reader(io.StringIO(p.read_bytes().decode("utf-8-sig"), newline=""))
                next(rows)
                want |= {(f"file:{p}", at): (*(r + ["", ""])[:2], "en", "ru") for at, r in enumerate(rows, 2)}
            assert got == want
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    (tmp_path / "empty.csv").write_bytes(b"\xef\xbb\xbf")
    with pytest.raises(ValueError):
        tables.read_pairs(spark, f"file://{tmp_path}/empty.csv")


def test_csv_of_many_partitions_is_one_file_in_order(spark, tmp_path):
    pairs = spark.range(1000, -1, -1, 7).select("id", F.concat(F.lit('s"'), "id").alias("source"), F.concat(F.lit("t\n"), "id").alias("target"))
    out_tables.write_pairs(pairs.repartition(5).sort("id"), "e\"n", "ru", f"file://{tmp_path}/o", whole=True)
    (one,) = (p for p in (tmp_path / "o").iterdir() if not p.name.startswith("."))
    assert one.read_bytes().decode() == '\ufeff"e""n","ru"\r\n' + "".join(f'"s""{k}","t\n{k}"\r\n' for k in range(1001))
    out_tables.write_pairs(pairs.where("id < 0"), "en", "ru", f"file://{tmp_path}/none", whole=True)
    assert not list((tmp_path / "none").glob("*.txt"))


def test_sheets_round_trip_and_become_units(spark, tmp_path):
    rows = [["Source", "Target", "Comment"], ["a <1>", "б", ""], ["", " ", ""], ["", "", "note\x01"]]
    (tmp_path / "s.xlsx").write_bytes(out_tables.workbook({"TMX": rows}))
    assert tables.sheet_rows((tmp_path / "s.xlsx").read_bytes()) == [*rows[:3], ["", "", "note"]]
    got = tables.units_of_sheet(tables.read_sheet(spark, f"file://{tmp_path}/s.xlsx"), "en", "ru")
    made = [r.unit for r in out_tmx.sheet_units(got).orderBy("tu_index").collect()]
    assert len(made) == 2 and "<seg>a &lt;1&gt;</seg>" in made[0] and '<prop type="x-Comment"> </prop>' in made[0] and ">note</prop>" in made[1]
    with pytest.raises(ValueError):
        tables.units_of_sheet(got, "en", "ru", source_column=1, target_column=1)


def test_review_package_and_decisions(spark, file):
    r = run(spark, file)
    issues = review.ordered_issues(r.proposals.withColumns({"status": F.lit("pending"), "seq": F.monotonically_increasing_id(), "type": review.check_type(F.col("kind"), F.col("rule"))}))
    issues = issues.select("id", "type", "tu_index", F.coalesce("before_src", "original_src").alias("before"), F.coalesce("after_src", F.array_join("src_parts", "\n")).alias("after"))
    raw = out_tables.package(TMX.encode(), "memory.tmx", issues, {"split": True})
    got = tables.read_package(raw)
    assert got["manifest"]["issues"] == 4 and got["source"] == TMX.encode() and {d["decision"] for d in got["decisions"]} == {"pending"}
    assert tables.decisions_of_json("nonsense") == [] and tables.decisions_of_json('{"decisions": [{"id": "a", "decision": "Accept"}]}')[0]["comment"] == ""
    decided = spark.createDataFrame([("split:0", "Approved", "", 0), ("split:0", "decline", "no", 1), ("gone", "accept", "", 2), ("split:1", "perhaps", "", 3)], "id string, decision string, comment string, seq long")
    held = spark.createDataFrame([("split:0", 0, "pending", "c"), ("split:1", 1, "pending", "c")], "id string, tu_index long, status string, comment string")
    assert sorted((x.id, x.status, x.comment) for x in review.merge_decisions(held, decided).collect()) == [("split:0", "rejected", "no"), ("split:1", "pending", "c")]
    assert sorted(x.id for x in review.unrecognized(held, decided).collect()) == ["gone", "split:1"]


def test_report_has_five_sheets(spark):
    one = spark.createDataFrame([("total", "6")], "metric string, value string")
    raw = out_tables.report(one, one, one, one, one)
    assert tables.sheet_rows(raw, "Warnings") == [["metric", "value"], ["total", "6"]]
    assert json.loads(out_tables.json_report({}, {}, {"w": [1, 2]}, {"w": 5}))["detail_event_limits"]["w"] == {"total": 5, "stored": 2, "omitted": 3}


def test_plan_details_are_capped(spark):
    df = spark.createDataFrame([("f", f"cleanup:{k}:r:0", k, "r", "a", "b", "c", "d") for k in range(5)], "file_id string, id string, tu_index long, rule string, before_src string, after_src string, before_tgt string, after_tgt string")
    assert [r.before_src for r in review.compact_plan(df, ["tu_index"], 2).orderBy("tu_index").collect()] == ["a", "a", "", "", ""]


def test_plan_details_are_not_dealt_out_by_file(spark):
    rows = [(file, k, "t" * 10) for file in ("f", None) for k in range(200)]
    df = spark.createDataFrame(rows, "file_id string, tu_index long, before_src string").repartition(8)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(c, v)
        got = review.compact_plan(df, ["tu_index"], 3, ("before_src",)).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert len({r.part for r in got}) == 8 and sorted(((r.file_id or "", r.tu_index) for r in got if r.before_src)) == [(f, k) for f in ("", "f") for k in range(3)]


def test_models_prompts_and_json(spark):
    models = spark.createDataFrame([("models/gemini-3.1-pro", ["generateContent"]), ("models/gemini-3-image", ["generateContent"]), ("models/gemini-2.5-pro", ["generateContent"]), ("models/gemini-3.0-a", ["generateContent"]), ("models/gemini-3.1-pro", ["generateContent"])], "name string, methods array<string>")
    assert [r.name for r in verify.pick_models(models).collect()] == ["gemini-3.1-pro", "gemini-3.0-a"]
    df = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ("{broken",)], "t string")
    assert [r.j for r in df.select(verify.lenient_json(F.col("t")).alias("j")).collect()] == ['{"a": 1}', None]


def test_difference_of_long_texts_is_whole(spark):
    words = [f"w{k}" for k in range(6000)]
    before, after = " ".join(words), " ".join([*words[:3000], "new", *words[3001:]])
    runs = spark.createDataFrame([(before, after)], "x string, y string").select(diff.diff_segments(True)("x", "y").alias("d")).first().d
    assert len(before) > diff.MOST_CHARS and [r.text for r in runs if r.kind != "equal"] == ["w3000", "new"]
    assert "".join(r.text for r in runs if r.kind != "insert") == before and "".join(r.text for r in runs if r.kind != "delete") == after


def test_differences(spark):
    assert diff.segments_of("one two", "one three", True) == [{"kind": "equal", "text": "one "}, {"kind": "delete", "text": "two"}, {"kind": "insert", "text": "three"}]
    assert diff.segments_of("", "x") == [{"kind": "insert", "text": "x"}]
    assert [x["kind"] for x in diff.line_diff("a\nb\nc", "a\nB\nc\nd")] == ["equal", "change", "equal", "insert"]
    row = spark.createDataFrame([("a<b", "a<c")], "x string, y string").select(diff.inline_diff()("x", "y").alias("h"), diff.clip(F.lit("x" * 20), 8).alias("c"), diff.visible_text(F.lit("a <b"), True).alias("v"), diff.diff_lines("x", "y").alias("l")).first()
    assert row.h == "a&lt;<del>b</del><ins>c</ins>" and row.c == "xxxx\n[...]\nxxxx" and row.v == "a·&lt;b" and row.l[0].kind == "change"


def stream(spark, tmp_path, df, build, mode):
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = build(source).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql("SELECT * FROM out").collect()


def test_stream_forms(spark, tmp_path):
    pairs = spark.createDataFrame([("f", "a", "b"), ("f", "a", "b"), ("g", "a", "b"), ("f", "a", "c")], "file_id string, src string, tgt string")
    assert len(stream(spark, tmp_path / "1", pairs, progress.drop_seen_pairs, "append")) == 3
    e = spark.createDataFrame([(1, k, "tu_start", float(k)) for k in range(1, 121)] + [(1, 130, "warning", 0.0)], "user long, n0 long, event_type string, value double")
    got = stream(spark, tmp_path / "2", e, lambda d: progress.throttled(d, "user", "n0"), "append")
    assert sorted(r.n for r in got) == [1, 50, 100, 121]
    got = stream(spark, tmp_path / "3", e.where("n0 <= 3"), lambda d: progress.ema_by_key(d, "user", "value", "n0"), "update")
    assert got[-1].n == 3 and abs(got[-1].ema - ((1 * 0.65 + 2 * 0.35) * 0.65 + 3 * 0.35)) < 1e-9


def test_command_line(spark, file, tmp_path, capsys):
    out = tmp_path / "repaired"
    assert cli.main([file, "--output", f"file://{out}", "--json-report", str(tmp_path / "r.json")], spark) == 0
    assert json.loads((tmp_path / "r.json").read_text())["summary"]["total"] == 6 and list(out.glob("*/*.txt"))
    assert cli.main([f"file://{tmp_path}/none.tmx"], spark) == 2
    assert cli.main([file, "--no-split", "--no-cleanup-spaces", "--no-cleanup-game", "--no-cleanup-garbage", "--no-cleanup-warnings"], spark) == 2
    assert "total" in capsys.readouterr().out and sys.modules["weftline.cli"]
