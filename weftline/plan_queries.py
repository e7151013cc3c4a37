"""Named queries that read and write files: the repair run, plans and their application, exports and round trips.

The inputs are TMX files made of the conversations, one for each of three file names, with headers,
tagged and escaped segments, context properties and units that are skipped for each reason.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import diff, rules, split, tuv, verify
from .functions.segments import escape
from .operators import events as E
from .operators import review, stats, units
from .plans import state
from .plans.cleanup import clean_properties
from .plans.repair import Result, Settings, repair
from .plans.storage import fresh_path, settled
from .queries import _GUARD, P, _esc, _t, conversation_units, pairs, q_collapse, q_game, q_parts, q_reason, q_spaces, q_strip, query
from .sinks import tables as out_tables
from .sinks import tmx as out_tmx
from .sources import settings as conf
from .sources import tables, tmx

PREFIX = '<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4">\n  <header srclang="en_us" adminlang="en" datatype="plaintext"/>\n  <body>\n    '


def _units(spark, sf_dir) -> DataFrame:
    """conversation_units with escaped segments."""
    u = conversation_units(spark, sf_dir)
    plain = F.transform("tuvs", lambda v: F.struct(v["lang"].alias("lang"), v["attrs"].alias("attrs"), escape(v["seg_xml"]).alias("seg_xml")))
    return u.withColumn("tuvs", plain)


def tmx_files(spark, sf_dir) -> str:
    """Writes the files; gives the pattern to read them by."""
    u = _units(spark, sf_dir)
    path = fresh_path(spark, "tmx")
    body = u.select("file_id", "tu_index", F.lit(0).alias("part_index"), out_tmx.unit_xml(F.col("attrs"), F.col("props"), F.col("tuvs")).alias("unit"), F.lit("\n    ").alias("lead"))
    out_tmx.write_tmx(body, u.select("file_id").distinct().withColumn("prefix", F.lit(PREFIX)), path)
    return f"{path}/*/*.txt"


def _name(c: str = "file_id"):
    return F.regexp_extract(c, "file=(f[0-9])", 1)


def _read(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Units and headers with short file names; tu_index is the place in the file."""
    path = tmx_files(spark, sf_dir)
    return tuple(df.withColumn("file_id", _name()) for df in (tmx.read_tmx(spark, path), tmx.read_headers(spark, path)))


def _run(spark, sf_dir, settings: Settings = Settings(), **more) -> Result:  # noqa: B008
    tu, headers = _read(spark, sf_dir)
    return repair(tu, headers, settings, **more)


def segments(unit) -> F.Column:
    return F.array_join(F.regexp_extract_all(unit, F.lit("(?s)<seg>(.*?)</seg>"), F.lit(1)), "|")


#: Units in the files' order, cleaned and split as a run does, in the oracle's own words.
_XS, _XT = _esc("src"), _esc("tgt")
_UN = lambda x: f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_RUN = f"""{P}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tu_index) - 1 AS place, {_XS} AS xs, {_XT} AS xt FROM p),
g AS (SELECT *, CASE WHEN k IN (5, 6) THEN xs ELSE {q_game('xs')} END AS s1, CASE WHEN k IN (5, 6) THEN xt ELSE {q_game('xt')} END AS t1 FROM n),
c AS (SELECT *, CASE WHEN k IN (5, 6) THEN s1 ELSE {q_spaces('s1')} END AS s2, CASE WHEN k IN (5, 6) THEN t1 ELSE {q_spaces('t1')} END AS t2 FROM g),
h AS (SELECT *, {_UN('s2')} AS us, {_UN('t2')} AS ut FROM c),
r AS (SELECT *, CASE k WHEN 5 THEN 'less_than_two_tuv' WHEN 6 THEN 'multilang_tu' END AS skip, CASE WHEN k NOT IN (5, 6) THEN {q_reason(q_strip('us'), q_strip('ut'))} END AS reason FROM h),
s AS (SELECT *, {q_parts('s2')} AS a, {q_parts('t2')} AS b FROM r),
o AS (SELECT *, CASE WHEN skip IS NULL AND reason IS NULL AND {_GUARD} = 'split' THEN len(a) ELSE 1 END AS parts FROM s),
u AS (SELECT file_id, place AS tu_index, k, skip, reason, a, b, s1, t1, s2, t2, xs, xt, us, ut, tgt_lang, CASE WHEN reason IS NOT NULL THEN 0 ELSE parts END AS outputs, src, tgt FROM o)"""
_ONE = "CASE k WHEN 5 THEN xt WHEN 6 THEN xs || '|' || xt || '|' || xt WHEN 4 THEN t2 || '|' || s2 ELSE s2 || '|' || t2 END"
_OUT = f"SELECT file_id, tu_index, 0 AS part_index, {_ONE} AS segs FROM u WHERE outputs = 1 UNION ALL SELECT file_id, tu_index, (unnest(range(len(a))))::INT, unnest(list_transform(list_zip(a, b), lambda z: z[1] || '|' || z[2])) FROM u WHERE outputs > 1"
#: Splits of the data have equal numbers of sentences: pairs whose numbers differ are left out on both sides.
_EVEN = "len(a) = len(b) OR len(a) < 2 OR len(b) < 2"


@query(f"WITH {_RUN} {_OUT.replace('FROM u WHERE', f'FROM u WHERE ({_EVEN}) AND')}")
def repair_output(spark, sf_dir):
    """Segments of the repaired files, read back from disk by a run over files."""
    r = _run(spark, sf_dir)
    return _even(r.output.select("file_id", "tu_index", "part_index", segments(F.col("unit")).alias("segs")), r.units)


def _even(df: DataFrame, found: DataFrame) -> DataFrame:
    """Without units whose sides have different numbers of sentences, which the SQL does not merge."""
    a, b = F.size(split.split_text(F.col("clean_src"))), F.size(split.split_text(F.col("clean_tgt")))
    odd = found.where(F.col("skip_reason").isNull()).where((a != b) & (a > 1) & (b > 1)).select("file_id", "tu_index")
    return df.join(odd, ["file_id", "tu_index"], "left_anti")


_IDS = f"""i AS (
  SELECT file_id, tu_index, 'cleanup' AS kind, 'remove_game_markup' AS rule, 1 AS o FROM u WHERE skip IS NULL AND (s1 <> xs OR t1 <> xt)
  UNION ALL SELECT file_id, tu_index, 'cleanup', 'normalize_spaces', 2 FROM u WHERE skip IS NULL AND (s2 <> s1 OR t2 <> t1)
  UNION ALL SELECT file_id, tu_index, 'cleanup', 'remove_garbage_segment', 3 FROM u WHERE reason IS NOT NULL
  UNION ALL SELECT file_id, tu_index, 'split', NULL, 4 FROM u WHERE outputs > 1),
q AS (SELECT file_id, tu_index, kind, rule, CASE kind WHEN 'split' THEN 'split:' || tu_index ELSE 'cleanup:' || tu_index || ':' || rule || ':' || (row_number() OVER (PARTITION BY file_id, tu_index, kind ORDER BY o) - 1) END AS id FROM i)"""


@query(f"WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')}, {_IDS} SELECT file_id, id, kind, coalesce(rule, '') AS rule FROM q")
def repair_proposals(spark, sf_dir):
    r = _run(spark, sf_dir)
    return _even(r.proposals.select("file_id", "tu_index", "id", "kind", F.coalesce("rule", F.lit("")).alias("rule")), r.units).drop("tu_index")


@query(f"""WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')}
SELECT file_id, count(*) AS total, count(*) FILTER (outputs > 1) AS split, sum(outputs)::BIGINT AS created, count(skip) AS skipped, count(reason) AS removed, count(*) FILTER (outputs > 1) AS high
FROM u GROUP BY ROLLUP (file_id)""")
def repair_stats(spark, sf_dir):
    r = _run(spark, sf_dir)
    return stats.run_stats(_even(r.units, r.units)).select("file_id", "total", "split", "created", "skipped", "removed", "high")


def _verifier(row: dict) -> dict:
    """A stand-in that judges by the number of parts and the source's length."""
    n = len(row["clean_src"])
    return {"verdict": ("OK", "FAIL", "warn", "?")[n % 4], "summary": "HTTP error 500" if n % 4 == 3 else "seen", "prompt_tokens": n, "candidate_tokens": len(row["src_parts"])}


@query(f"""WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')},
d AS (SELECT *, row_number() OVER (PARTITION BY a, b, s2, t2, tgt_lang ORDER BY file_id, tu_index) AS dup FROM u WHERE outputs > 1),
f AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tu_index) AS n FROM d WHERE dup = 1),
v AS (SELECT a, b, s2, t2, f.tgt_lang, f.file_id AS call_file, f.tu_index AS call_unit, CASE length(s2) % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'FAIL' ELSE 'WARN' END AS verdict FROM f WHERE n <= 3)
SELECT d.file_id, d.tu_index, verdict, CASE WHEN verdict IS NULL THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN call_file = d.file_id AND call_unit = d.tu_index THEN length(d.s2) ELSE 0 END AS prompt_tokens,
  verdict IS NOT NULL AND length(d.s2) % 4 = 3 AS pending, CASE WHEN verdict = 'FAIL' OR verdict IS NOT NULL AND length(d.s2) % 4 = 3 THEN 1 ELSE len(d.a) END AS outputs
FROM d LEFT JOIN v ON d.a = v.a AND d.b = v.b AND d.s2 = v.s2 AND d.t2 = v.t2 AND d.tgt_lang = v.tgt_lang""")
def repair_verified(spark, sf_dir):
    """Splits that a verifier judged: at most three distinct ones of a file are called, equal ones once."""
    tu, headers = _read(spark, sf_dir)
    even = _even(tu, repair(tu, headers, Settings(split=False)).units)
    r = repair(even, headers, Settings(max_checks=3), verifier=_verifier)
    return r.units.where("src_parts IS NOT NULL").select("file_id", "tu_index", "verdict", "confidence", "prompt_tokens", "pending", "outputs")


@query(f"""WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')}, {_IDS}, y AS (SELECT DISTINCT file_id, tu_index FROM q WHERE kind = 'cleanup' AND rule = 'normalize_spaces' OR kind = 'split' AND tu_index % 2 = 0),
z AS (SELECT u.* REPLACE (CASE WHEN y.file_id IS NULL THEN xs ELSE s2 END AS s2, CASE WHEN y.file_id IS NULL THEN xt ELSE t2 END AS t2, CASE WHEN y.file_id IS NULL THEN 1 WHEN outputs > 1 AND u.tu_index % 2 = 1 THEN 1 ELSE outputs END AS outputs) FROM u LEFT JOIN y ON y.file_id = u.file_id AND y.tu_index = u.tu_index)
{_OUT.replace('FROM u', 'FROM z')}""")
def plan_apply(spark, sf_dir):
    """A plan is written and read as JSON; what was accepted of it (spaces, and splits of even units) is applied."""
    tu, headers = (settled(df) for df in _read(spark, sf_dir))  # both runs read them
    first = repair(tu, headers)
    path = fresh_path(spark, "plan")
    rows = state.plan_rows(first.proposals, (F.col("rule") == "normalize_spaces") | (F.col("kind") == "split") & (F.col("tu_index") % 2 == 0))
    state.write_plan(rows.withColumn("accepted", F.coalesce("accepted", F.lit(False))), first.units.groupBy("file_id").agg(F.count("*").alias("total_tus")), path)
    plan, _ = state.read_plan(spark, path)
    r = repair(tu, headers, accepted=state.accepted_of(plan))
    return _even(r.output.select("file_id", "tu_index", "part_index", segments(F.col("unit")).alias("segs")), first.units)


@query(f"WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')}, {_IDS} SELECT file_id, id AS proposal_id, kind, tu_index, (rule = 'remove_garbage_segment') IS NOT TRUE AS accepted, CASE kind WHEN 'split' THEN 'HIGH' ELSE '' END AS confidence, count(*) OVER (PARTITION BY file_id) AS in_file FROM q")
def plan_json(spark, sf_dir):
    """A plan as one JSON text a file, and back."""
    r = _run(spark, sf_dir)
    kept = _even(r.proposals, r.units)
    rows = state.plan_rows(kept, F.coalesce(F.col("rule") != "remove_garbage_segment", F.lit(True)))
    totals = state.missing_total(kept)
    back = state.plan_of_json(settled(state.plan_json(rows, totals)))
    n = back.groupBy("file_id").agg(F.count("*").alias("in_file"))
    return back.join(n, "file_id").select("file_id", "proposal_id", "kind", "tu_index", "accepted", "confidence", "in_file")


_EVENTS = f"""e AS (
  SELECT file_id, 'tu_start' AS event, '' AS detail FROM u UNION ALL SELECT file_id, 'tu_removed_cleanup', reason FROM u WHERE reason IS NOT NULL
  UNION ALL SELECT file_id, 'split_proposed', len(a)::VARCHAR FROM u WHERE outputs > 1 UNION ALL SELECT file_id, 'tu_split_applied', len(a)::VARCHAR FROM u WHERE outputs > 1
  UNION ALL SELECT file_id, 'tu_skipped', coalesce(skip, 'no_split_proposal') FROM u WHERE outputs = 1
  UNION ALL SELECT file_id, 'cleanup_proposed', rule FROM q WHERE kind = 'cleanup'
  UNION ALL SELECT DISTINCT file_id, 'file_start', '' FROM u UNION ALL SELECT file_id, 'file_complete', count(*)::VARCHAR FROM u GROUP BY 1)"""


@query(f"WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')}, {_IDS}, {_EVENTS} SELECT file_id, event, detail, count(*) AS n FROM e GROUP BY ALL")
def run_events(spark, sf_dir):
    """Events of a run, but warnings, by kind and detail."""
    r = _run(spark, sf_dir)
    return E.run_events(_even(r.units, r.units)).where("event <> 'warning'").groupBy("file_id", "event", "detail").agg(F.count("*").alias("n"))


@query(f"""WITH {_RUN} SELECT file_id, tu_index, 'multilang_tu_skipped' AS rule, 'WARN' AS severity FROM u WHERE k = 6""")
def multilang_warnings(spark, sf_dir):
    r = _run(spark, sf_dir)
    return r.units.select("file_id", "tu_index", F.explode("warnings").alias("w")).where("w.rule = 'multilang_tu_skipped'").select("file_id", "tu_index", "w.rule", "w.severity")


@query(f"""WITH {_RUN} SELECT file_id, tu_index, k <> 5 AND k <> 6 AND row_number() OVER (PARTITION BY file_id, k IN (5, 6), xs, xt, k = 4 ORDER BY tu_index) > 1 AS removed FROM u""")
def repair_dedup(spark, sf_dir):
    """Duplicates of a file, by the raw text of both variants in order."""
    r = _run(spark, sf_dir, Settings(dedup=True, split=False))
    return r.units.select("file_id", "tu_index", (F.coalesce(F.col("remove_reason"), F.lit("")) == "dedup_tu").alias("removed"))


# ---- reading and writing ----


@query(f"""WITH {_RUN} SELECT file_id, tu_index, CASE k WHEN 5 THEN 'de-DE' WHEN 4 THEN 'de-DE,EN' WHEN 6 THEN 'en-US,de-DE,fr' ELSE 'en-US,de-DE' END AS langs, CASE k WHEN 5 THEN xt WHEN 4 THEN xt || '|' || xs WHEN 6 THEN xs || '|' || xt || '|' || xt ELSE xs || '|' || xt END AS segs, 'x-Context,x-Note' AS types FROM u""")
def tmx_scan(spark, sf_dir):
    """Units as the scan reads them from files."""
    tu, _ = _read(spark, sf_dir)
    return tu.select("file_id", "tu_index", F.array_join(F.transform("tuvs", lambda v: v["lang"]), ",").alias("langs"), F.array_join(F.transform("tuvs", lambda v: v["seg_xml"]), "|").alias("segs"), F.array_join(F.transform("props", lambda p: p["type"]), ",").alias("types"))


@query(f"WITH {P} SELECT DISTINCT file_id, 'en_us' AS src_lang, true AS has_body, '  ' AS indent, 'de-DE' AS tgt_lang FROM p")
def tmx_headers(spark, sf_dir):
    """Header, prefix and body indent of each file, and its first language that is not the header's (of units that begin with it)."""
    tu, headers = _read(spark, sf_dir)
    first = units.target_language(tu.withColumn("tuvs", F.filter("tuvs", lambda v: v["lang"] != "en-US")), headers)
    return headers.join(first, "file_id").select("file_id", "src_lang", "has_body", F.regexp_extract("prefix", r"(?m)^([ \t]*)<body", 1).alias("indent"), "tgt_lang")


@query(f"""WITH {_RUN}, l AS (SELECT file_id, tu_index, unnest(CASE k WHEN 5 THEN [['de-DE', tgt]] WHEN 4 THEN [['de-DE', tgt], ['EN', src]] WHEN 6 THEN [['en-US', src], ['de-DE', tgt], ['fr', tgt]] ELSE [['en-US', src], ['de-DE', tgt]] END) AS x FROM u) SELECT file_id, tu_index, x[1] AS lang, x[2] AS text FROM l""")
def tmx_segments(spark, sf_dir):
    """Plain text by language."""
    tu, _ = _read(spark, sf_dir)
    return units.segments_by_language(tu).select("file_id", "tu_index", F.explode("segments").alias("lang", "text"))


@query(f"""WITH {_RUN} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY tu_index) - 1 AS tu_index, 'en-US|de-DE' AS langs, xs || '|' || xt AS segs FROM u WHERE k NOT IN (4, 5)""")
def tmx_pair_files(spark, sf_dir):
    """One pair's units written as files with their separators, and read back."""
    tu, headers = _read(spark, sf_dir)
    path = fresh_path(spark, "pair-tmx")
    specs = headers.select("file_id", F.lit("en-US").alias("source"), F.lit("de-DE").alias("target"), F.lit("en-US-de-DE").alias("suffix"))
    out_tmx.write_pair_tmx(tu, specs, headers, path)
    back = tmx.read_tmx(spark, f"{path}/*/*/*.txt").withColumn("file_id", _name())
    return back.select("file_id", "tu_index", F.array_join(F.transform("tuvs", lambda v: v["lang"]), "|").alias("langs"), F.array_join(F.transform("tuvs", lambda v: v["seg_xml"]), "|").alias("segs"))


@query(f"""WITH {_RUN}, l AS (SELECT file_id, unnest(CASE k WHEN 5 THEN ['de-DE'] WHEN 4 THEN ['de-DE', 'EN'] WHEN 6 THEN ['en-US', 'de-DE', 'fr'] ELSE ['en-US', 'de-DE'] END) AS target FROM u) SELECT DISTINCT file_id, 'en-US' AS source, target, 'en-US-' || target AS suffix FROM l WHERE target <> 'en-US'""")
def pair_specs(spark, sf_dir):
    tu, headers = _read(spark, sf_dir)
    h = headers.withColumn("src_lang", F.lit("en-US"))
    return units.pair_specs(units.profile(tu, h).join(h.select("file_id", "src_lang"), "file_id"))


_ORDERED = f"WITH {P}, e AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY tu_index) + 1 AS row_index, src AS source, tgt AS target FROM p)"


@query(f"{_ORDERED} SELECT file_id, row_index, source, target, 'en-US' AS source_lang, 'de-DE' AS target_lang FROM e")
def csv_pairs(spark, sf_dir):
    """Pairs written as CSV with a byte order mark, CRLF lines and quoted breaks, a folder a file, and read back by file."""
    p, path = settled(pairs(spark, sf_dir)), fresh_path(spark, "csv")
    for name in ("f0", "f1", "f2"):
        one = p.where(F.col("file_id") == name).select(F.col("src").alias("source"), F.col("tgt").alias("target"), "tu_index")
        out_tables.write_pairs(one.orderBy("tu_index"), "en-US", "de-DE", f"{path}/file={name}", whole=True)
    return tables.read_pairs(spark, f"{path}/*/*.txt").withColumn("file_id", _name())


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(content)
    out.close()


@query(f"{_ORDERED} SELECT file_id, row_index, source, target, 'en-US' AS source_lang, 'de-DE' AS target_lang FROM e")
def sheet_pairs(spark, sf_dir):
    """The same by workbooks."""
    p, path = pairs(spark, sf_dir).withColumnsRenamed({"src": "source", "tgt": "target"}), fresh_path(spark, "sheets")
    for name in ("f0", "f1", "f2"):
        _put(spark, f"{path}/file={name}/p.xlsx", out_tables.pair_workbook(p.where(F.col("file_id") == name), "en-US", "de-DE"))
    return tables.pairs_of_sheet(tables.read_sheet(spark, f"{path}/*/*.xlsx")).withColumn("file_id", _name())


@query(f"{_ORDERED} SELECT row_index, {_esc('source')} || '|' || {_esc('target')} AS segs, 'client= ,project= ,domain= ,subject= ,corrected=no,aligned=no,x-Comment=' || CASE WHEN row_index % 2 = 0 THEN ' ' ELSE 'row ' || row_index END AS props FROM e WHERE file_id = 'f0'")
def sheet_units(spark, sf_dir):
    """A workbook with a comment column as units."""
    p = pairs(spark, sf_dir).where("file_id = 'f0'").orderBy("tu_index").select("src", "tgt").collect()  # a sheet's rows
    rows = [["Source", "Target", "Comment"], *([r.src, r.tgt, f"row {k}" if k % 2 else ""] for k, r in enumerate(p, 2)), ["", " ", ""]]
    path = f"{fresh_path(spark, 'sheet')}/s.xlsx"
    _put(spark, path, out_tables.workbook({"TMX": rows}))
    u = out_tmx.sheet_units(tables.units_of_sheet(tables.read_sheet(spark, path), "en", "de"))
    prop = F.regexp_extract_all("unit", F.lit('<prop type="([^"]*)">'), F.lit(1))
    value = F.regexp_extract_all("unit", F.lit('<prop type="[^"]*">([^<]*)</prop>'), F.lit(1))
    return u.select(F.col("tu_index").alias("row_index"), segments(F.col("unit")).alias("segs"), F.array_join(F.zip_with(prop, value, lambda a, b: F.concat(a, F.lit("="), b)), ",").alias("props"))


@query(f"WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')}, {_IDS} SELECT id, CASE WHEN kind = 'split' THEN 'accepted' WHEN rule = 'normalize_spaces' THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN kind = 'split' THEN 'good' ELSE '' END AS comment FROM q WHERE file_id = 'f0'")
def package_decisions(spark, sf_dir):
    """A review package of a file's proposals is written, decisions are laid over it, and it is read back and merged."""
    r = _run(spark, sf_dir)
    p = _even(r.proposals.where("file_id = 'f0'"), r.units)
    raw = out_tables.package(b"<tmx/>", "f0.tmx", out_tables.package_issues(p), {"split": True})
    words = {"split": ("Approve", "good"), "normalize_spaces": (" DECLINE ", "")}
    got = tables.read_package(raw)
    decided = [{"id": i["id"], "decision": words[i["type"]][0], "comment": words[i["type"]][1]} for i in got["state"]["issues"] if i["type"] in words]
    again = tables.read_package(out_tables.overlaid(raw, {"decisions.json": json.dumps({"decisions": [*decided, {"id": "lost", "decision": "accept"}]}).encode()}))
    issues = spark.createDataFrame([(i["id"], i["tu_index"], i["status"], i["comment"], k) for k, i in enumerate(again["state"]["issues"])], "id string, tu_index long, status string, comment string, seq long")
    d = spark.createDataFrame([(x["id"], x["decision"], x["comment"], k) for k, x in enumerate(again["decisions"])], "id string, decision string, comment string, seq long")
    return review.merge_decisions(issues, d).select("id", "status", "comment")


@query(f"WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')}, {_IDS} SELECT q.file_id, q.id, CASE kind WHEN 'split' THEN s2 WHEN 'cleanup' THEN CASE rule WHEN 'remove_game_markup' THEN xs WHEN 'normalize_spaces' THEN s1 ELSE s2 END END AS before_src, CASE kind WHEN 'split' THEN array_to_string(a, chr(10)) ELSE CASE rule WHEN 'remove_game_markup' THEN s1 WHEN 'normalize_spaces' THEN s2 ELSE '' END END AS after_src FROM q JOIN u USING (file_id, tu_index)")
def issue_texts(spark, sf_dir):
    """Before and after of each issue."""
    r = _run(spark, sf_dir)
    p = _even(r.proposals, r.units)
    c = {n: F.col(n) for n in p.columns}
    texts = review.before_after(c["kind"], (c["src_parts"], c["tgt_parts"]), (c["before_src"], c["before_tgt"]), (c["after_src"], c["after_tgt"]), (c["original_src"], c["original_tgt"]))
    return p.select("file_id", "id", texts.alias("t")).select("file_id", "id", "t.before_src", "t.after_src")


@query(f"WITH {_RUN.replace('FROM s),', f'FROM s WHERE {_EVEN}),')} SELECT file_id, metric, value FROM (SELECT file_id, count(*) AS n, count(*) FILTER (outputs > 1) AS s, sum(outputs)::BIGINT AS c, count(skip) AS k, count(reason) AS r FROM u GROUP BY 1) UNPIVOT (value FOR metric IN (n AS 'Total TU', s AS 'Split TU', c AS 'Output TU', k AS 'Skipped TU', r AS 'AUTO Removed TU'))")
def report_summary(spark, sf_dir):
    """Metrics of a report's first sheet that the SQL counts too, for each file."""
    r = _run(spark, sf_dir)
    s = stats.run_stats(_even(r.units, r.units)).where("file_id IS NOT NULL").withColumns({"input": F.col("file_id"), "output": F.lit("o")})
    rows = out_tables.summary_rows(s).where(F.col("metric").isin("Total TU", "Split TU", "Output TU", "Skipped TU", "AUTO Removed TU"))
    return rows.select("file_id", "metric", F.col("value").cast("long").alias("value"))


# ---- verdicts and state ----


@query("""WITH c AS (SELECT source AS src_lang, lang, CASE WHEN doc_id % 3 = 0 THEN ' ok' WHEN doc_id % 3 = 1 THEN 'Fail' ELSE 'perhaps' END AS verdict, doc_id FROM documents WHERE doc_id % 5 <> 0)
SELECT src_lang, CASE max_by(verdict, doc_id) WHEN ' ok' THEN 'OK' WHEN 'Fail' THEN 'FAIL' ELSE 'WARN' END AS verdict, CASE WHEN max(doc_id) % 2 = 0 THEN 'Cached verdict' ELSE 'said ' || max(doc_id) END AS summary FROM c GROUP BY 1""")
def verdict_cache(spark, sf_dir):
    """A verdict table that is written, read with its checks, and merged with newer rows one by one; malformed keys go."""
    d = _t(spark, sf_dir, "documents")
    empty = F.array().cast("array<string>")
    key = F.to_json(F.struct(F.lit("m").alias("model"), F.col("source").alias("src_lang"), F.lit("").alias("src_text"), empty.alias("src_parts"), F.lit("").alias("tgt_lang"), empty.alias("tgt_parts"), F.lit("").alias("tgt_text")))
    bad = F.when(F.col("doc_id") % 10 == 0, F.lit("no json")).otherwise(F.lit('{"src_parts": "x", "tgt_parts": []}'))
    verdict = F.when(F.col("doc_id") % 3 == 0, " ok").when(F.col("doc_id") % 3 == 1, "Fail").otherwise("perhaps")
    summary = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("said "), F.col("doc_id").cast("string")))
    rows = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, bad).otherwise(key).alias("key"), verdict.alias("verdict"), summary.alias("summary"))
    latest = rows.where("doc_id % 5 <> 0").groupBy("key").agg(F.max("doc_id").alias("doc_id"))
    new = rows.join(latest, ["key", "doc_id"]).select("key", "verdict", "summary")
    old = rows.join(latest, ["key", "doc_id"], "left_anti").dropDuplicates(["key"]).select("key", "verdict", "summary")
    path = fresh_path(spark, "cache")
    state.write_cache(old.unionByName(rows.where("doc_id % 5 = 0").select("key", "verdict", "summary")), path)
    merged = state.merge_cache(state.read_cache(spark, path), state.valid_cache(new))
    texts = {k: F.lit("") for k in ("src_text", "tgt_text", "tgt_lang")} | {"src_parts": empty, "tgt_parts": empty, "model": F.lit("m"), "src_lang": F.col("source")}
    names = d.select("source", verify.cache_key(texts).alias("key")).distinct()
    return merged.join(names, "key").select(F.col("source").alias("src_lang"), "verdict", "summary")


@query("SELECT source AS file_id, 'o/' || source AS output, count(*) AS total_tus FROM documents WHERE source <> 'src0' AND source <> 'src3' GROUP BY 1 UNION ALL SELECT source, 'o/' || source, count(*) FROM documents WHERE source = 'src3' GROUP BY 1")
def resume_state(spark, sf_dir):
    """Files that a state leaves to do: src0 is done; src3 had another number of units then, src5 another output."""
    files = _t(spark, sf_dir, "documents").groupBy(F.col("source").alias("file_id")).agg(F.count("*").alias("total_tus")).withColumn("output", F.concat(F.lit("o/"), F.col("file_id")))
    done = files.where("file_id IN ('src0', 'src3', 'src5')").select("file_id", F.when(F.col("file_id") == "src5", "other").otherwise(F.col("output")).alias("output"), (F.col("total_tus") + (F.col("file_id") == "src3").cast("int")).alias("total_tus"))
    return state.to_do(files, done).select("file_id", "output", "total_tus")


@query("SELECT lang AS file_id, max(doc_id) + 1 AS total_tus FROM documents GROUP BY 1")
def missing_totals(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("lang").alias("file_id"), F.col("doc_id").alias("tu_index"))
    return state.missing_total(d)


@query("SELECT lang AS file_id, doc_id AS tu_index FROM documents WHERE doc_id % 3 = 0 AND doc_id < 100 AND lang IS NOT NULL")
def selected_in_range(spark, sf_dir):
    """Units of accepted ids, within the number of units that the file has."""
    d = _t(spark, sf_dir, "documents").where("lang IS NOT NULL")
    ids = d.where("doc_id % 3 = 0").select(F.col("lang").alias("file_id"), F.concat(F.lit("cleanup:"), F.col("doc_id").cast("string"), F.lit(":x:0")).alias("id"))
    totals = d.select(F.col("lang").alias("file_id")).distinct().withColumn("total_tus", F.lit(100))
    return review.selected_units(ids, totals)


# ---- small functions ----


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 7 WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN user_id < 1 THEN NULL ELSE user_id END WHEN 3 THEN 7 ELSE NULL END AS most,
  CASE WHEN event_id >= 3600 THEN format('{:02d}:{:02d}:{:02d}', event_id // 3600, event_id % 3600 // 60, event_id % 60) ELSE format('{:02d}:{:02d}', event_id // 60, event_id % 60) END AS shown FROM events""")
def setting_values(spark, sf_dir):
    """Limits as settings spell them, and elapsed times."""
    text = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 5 == 1, " Unlimited ").when(F.col("event_id") % 5 == 2, F.col("user_id").cast("string")).when(F.col("event_id") % 5 == 3, "seven").otherwise("-4")
    return _t(spark, sf_dir, "events").select("event_id", conf.limit_column(text, 7).alias("most"), conf.elapsed(F.col("event_id")).alias("shown"))


@query("""WITH u AS (SELECT doc_id, 'https://x.org/' || lower(source) || '/' || doc_id || '.tmx' AS url FROM documents),
v AS (SELECT min(doc_id) AS doc_id, lower('/' || doc_id % 7 || '/M ' || doc_id % 7 || '.TMX') AS k FROM documents GROUP BY doc_id % 7)
SELECT 'file' AS kind, '/' || doc_id % 7 || '/M ' || doc_id % 7 || '.TMX' AS path, '/' || doc_id % 7 || '/output/M ' || doc_id % 7 || '_repaired.TMX' AS output, '/' || doc_id % 7 || '/r/M ' || doc_id % 7 || '/M ' || doc_id % 7 || '.diff-report.xlsx' AS report FROM v""")
def input_paths(spark, sf_dir):
    """File URIs, quoted and in both cases, as distinct paths with their outputs and reports."""
    ids = [r.doc_id for r in _t(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("doc_id")).groupBy("doc_id").count().orderBy("doc_id").collect()]  # seven
    raw = [x for k in ids for x in (f"file:///{k}/M%20{k}.TMX", f'"/{k}/m {k}.tmx"', "  ")]
    rows = [("file", p, conf.output_path(p), conf.report_path(p, "diff-report.xlsx", folder="r")) for p in conf.distinct_paths(raw)]
    return spark.createDataFrame(rows, "kind string, path string, output string, report string")


@query("WITH v(name, version) AS (VALUES ('gemini-3.5-pro', 3.5), ('gemini-3.1-flash', 3.1), ('gemini-3-pro', 3.0)) SELECT name, version::DOUBLE AS version FROM v")
def text_models(spark, sf_dir):
    """Models of a listing in pages."""
    names = ["gemini-3.5-pro", "gemini-3-pro", "gemini-2.5-pro", "gemini-3.9-nano-banana", "gemini-3-veo", "gemini-3-embed-2", "gemini-3.1-flash", "gemini-x", "other-4", "gemini-3-aqa", "gemini-3-voice"]
    pages = {None: {"models": [{"name": f"models/{n}", "supportedGenerationMethods": ["generateContent"]} for n in names[:6]], "nextPageToken": "b"}, "b": {"models": [{"name": f"models/{n}", "supportedGenerationMethods": ["generateContent", "x"]} for n in names[4:]] + [{"name": "models/gemini-4-count", "supportedGenerationMethods": ["countTokens"]}], "nextPageToken": None}}
    return verify.pick_models(verify.list_models(spark, pages.get))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 250) || chr(10) || '[...]' || chr(10) || right(text, 250) ELSE text END AS shown, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), ' ', '·') AS visible FROM documents")
def clipped_texts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", diff.clip(F.col("text"), 500).alias("shown"), diff.visible_text(F.col("text"), True).alias("visible"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT lang AS file_id, doc_id AS tu_index, source AS rule, CASE WHEN n <= 20 THEN text ELSE '' END AS before_src FROM d""")
def plan_details(spark, sf_dir):
    """Texts of the first 20 proposals of a file."""
    d = _t(spark, sf_dir, "documents").select(F.col("lang").alias("file_id"), F.col("doc_id").alias("tu_index"), F.col("source").alias("rule"), F.col("text").alias("before_src"))
    return review.compact_plan(d, ["tu_index"], 20, ("before_src",))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a,b,c' ELSE 'b' END AS types FROM documents")
def remembered_types(spark, sf_dir):
    """Saved filters that still exist; all types where none does."""
    saved = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("z"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("z"))).otherwise(F.array(F.lit("b")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(review.saved_types(saved, F.array(F.lit("a"), F.lit("b"), F.lit("c")))), ",").alias("types"))


@query("""WITH t AS (SELECT *, sum(greatest(event_id % 50, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total, lag(ts) OVER w AS before, min(ts) OVER (PARTITION BY user_id) AS began FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round((event_id % 50) / (epoch(ts) - epoch(before)), 3) AS rate, round(CASE WHEN ts > began THEN total / (epoch(ts) - epoch(began)) ELSE 0 END, 3) AS average, round(CASE WHEN total > 0 THEN total * 0.5 / least(1, total / 1000) ELSE 0 END, 3) AS forecast FROM t""")
def token_rates(spark, sf_dir):
    """Rates between ticks, average rates, and a forecast of cost at 1000 tokens."""
    e = stats.running_totals(_t(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 50), ["user_id"], ["ts", "event_id"], ["tokens"])
    began = e.groupBy("user_id").agg(F.min("ts").alias("began"))
    ticks = E.instant_rates(e, ["user_id"], "ts", "running_tokens").join(began, "user_id")
    gone = F.col("ts").cast("timestamp").cast("double") - F.col("began").cast("timestamp").cast("double")
    total = F.col("running_tokens")
    return ticks.select("user_id", "event_id", F.round("rate", 3).alias("rate"), F.round(E.average_rate(total, gone), 3).alias("average"), F.round(E.forecast(total * 0.5, total, F.lit(1000)), 3).alias("forecast"))


@query(f"""WITH {P}, x AS (SELECT file_id, tu_index, {q_parts(_esc(q_collapse('src')))} AS a FROM p)
SELECT file_id, tu_index, array_to_string(list_transform(a, lambda v, i: CASE WHEN i > 1 THEN '<ph x="1" />' ELSE '' END || v), chr(8227)) AS parts FROM x WHERE len(a) > 1""")
def tagged_split(spark, sf_dir):
    """Segments with a tag before each sentence after the first: tags go to the parts they lead."""
    p = pairs(spark, sf_dir).select("file_id", "tu_index", split.split_text(escape(rules.collapse_ws(F.col("src")))).alias("a")).where("size(a) > 1")
    xml = F.array_join(F.transform("a", lambda v, i: F.concat(F.when(i > 0, ' <ph x="1"/>').otherwise(""), v)), "")
    s = settled(p.select("file_id", "tu_index", xml.alias("xml")))
    return s.select("file_id", "tu_index", split.split_pair("xml", "xml").alias("s")).select("file_id", "tu_index", F.array_join("s.src", chr(8227)).alias("parts"))


@query(f"WITH {P} SELECT file_id, tu_index, 'c d x e' AS value, CASE WHEN k % 2 = 0 THEN '%a_1%' ELSE 'kept ^{{1}}^' END AS note FROM p")
def property_cleanup(spark, sf_dir):
    """Service markup out of the context property; other properties stay."""
    prop = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    props = F.array(prop(" X-ContextContent", F.lit("c <Color=#1>d ^{1 2}^ x$m(|y) &amp;lt;/color&amp;gt;e")), prop("x-Note", F.when(F.col("k") % 2 == 0, "%a_1%").otherwise("kept ^{1}^")))
    p = pairs(spark, sf_dir).select("file_id", "tu_index", clean_properties(props).alias("p"))
    return p.select("file_id", "tu_index", F.get("p", F.lit(0))["value"].alias("value"), F.get("p", F.lit(1))["value"].alias("note"))


@query(f"WITH {P} SELECT file_id, tu_index, CASE WHEN k = 5 THEN NULL WHEN k = 4 THEN NULL WHEN k = 6 THEN 'en-US,de-DE' ELSE 'en-US,de-DE' END AS kept, CASE k WHEN 5 THEN 'de-DE' WHEN 4 THEN 'de-DE' ELSE 'en-US' END AS named FROM p")
def pair_variants(spark, sf_dir):
    """Variants of one pair of languages, or nothing unless both are there; the language that exports read from attributes."""
    u = conversation_units(spark, sf_dir)
    kept = units.pair_tuvs(F.col("tuvs"), "en-US", "de-DE")
    return u.select("file_id", "tu_index", F.when(kept.isNotNull(), F.array_join(F.transform(kept, lambda v: v["lang"]), ",")).alias("kept"), tuv.named_lang(F.col("tuvs")[0]["attrs"]).alias("named"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS unavailable FROM documents")
def unavailable_answers(spark, sf_dir):
    """Answers that never came, by the summary or by an issue's message."""
    d = _t(spark, sf_dir, "documents")
    summary = F.when(F.col("doc_id") % 4 == 0, "Request FAILED: timeout").otherwise("fine")
    messages = F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("x"), F.lit("HTTP error 429"))).otherwise(F.array(F.lit("no candidate text")))
    verdict = F.when(F.col("doc_id") % 4 == 3, "FAIL").otherwise("WARN")
    return d.select("doc_id", verify.is_unavailable(verdict, summary, messages).alias("unavailable"))


@query("SELECT count(*) AS rows_read, count(*) FILTER (length(text) > 200) AS rows_written FROM documents")
def rows_read_and_written(spark, sf_dir):
    """Counts that a write observes on its way."""
    df, seen = stats.observed(_t(spark, sf_dir, "documents"), F.length("text") > 200)
    df.where(F.length("text") > 200).write.parquet(fresh_path(spark, "observed"))
    got = seen.get
    return spark.createDataFrame([(got["rows_read"], got["rows_written"])], "rows_read long, rows_written long")


@query(f"""WITH {P}, l AS (SELECT file_id, tu_index, 'same' AS a, {q_collapse('src')} AS s FROM p) SELECT file_id, tu_index, 'equal:same,change:' || s || '!,insert:more' AS kinds, 'same<ins>!</ins>' AS html FROM l""")
def line_differences(spark, sf_dir):
    """Lines equal, changed and added, and a difference as HTML."""
    s = settled(pairs(spark, sf_dir).select("file_id", "tu_index", rules.collapse_ws(F.col("src")).alias("s")).select("*", F.concat(F.lit("same\n"), F.col("s")).alias("x"), F.concat(F.lit("same\n"), F.col("s"), F.lit("!\nmore")).alias("y"), F.lit("same").alias("v"), F.lit("same!").alias("w")))
    return s.select("file_id", "tu_index", diff.diff_lines("x", "y").alias("l"), diff.inline_diff()("v", "w").alias("html")).select("file_id", "tu_index", F.array_join(F.transform("l", lambda r: F.concat(r["kind"], F.lit(":"), r["text"])), ",").alias("kinds"), "html")
