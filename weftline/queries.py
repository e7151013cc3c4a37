"""Named queries over the driver's tables, one for each group of operators, and DuckDB SQL for the same results.

Natural texts hold little dirt, so ``PAIRS`` adds some by fixed rules, in SQL that both engines read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import diff, rules, split, verify
from .functions.chars import ABBREVIATIONS, SCRIPTS
from .functions.segments import escape, probe_text
from .operators import review, stats, units
from .plans.cleanup import Options, clean_pairs
from .plans.storage import settled
from .sinks.tmx import safe_name

PAIRS = r"""
SELECT 'f' || CAST(conv_id % 3 AS STRING) AS file_id, conv_id * 100 + turn AS tu_index, k,
  CASE k WHEN 0 THEN '  ' || s || '  ' WHEN 1 THEN replace(s, ' ', '  ')
    WHEN 2 THEN s || '  %param_1%%  end ^{85 221 85}^x^{/color}^ Manual$m(a|b)'
    WHEN 3 THEN s || chr(92) || 't7' || chr(10) || chr(9) || 'tail' WHEN 4 THEN '12345'
    WHEN 5 THEN 'https://example.com/docs www.site.org' WHEN 6 THEN '!!! ...' WHEN 7 THEN 'Привет мир как дела' ELSE s END AS src,
  CASE k WHEN 8 THEN s WHEN 9 THEN 'ok' WHEN 7 THEN t || '  ' ELSE t END AS tgt,
  'en-US' AS src_lang, CASE WHEN k = 3 THEN 'ru_RU' ELSE 'de-DE' END AS tgt_lang
FROM (SELECT u.conv_id, u.turn, (u.conv_id + u.turn) % 10 AS k, u.text AS s, a.text AS t
      FROM {c} u JOIN {c} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') z
"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAIRS.replace("{c}", f"parquet.`{sf_dir}/conversations.parquet`"))


def xml_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumnsRenamed({"src": "src_xml", "tgt": "tgt_xml"})


P = f"p AS ({PAIRS.replace('{c}', 'conversations')})"


# ---- SQL building blocks for the oracles ----


def q_spaces(x: str) -> str:
    return f"trim(regexp_replace({x}, ' {{2,}}', ' ', 'g'), ' ')"


def q_then_spaces(x: str, y: str) -> str:
    return f"CASE WHEN {y} = {x} THEN {x} ELSE {q_spaces(y)} END"


def q_breaks(x: str) -> str:
    """Written-out escapes and control characters become one rare character; then it and white space round it a space."""
    y = x
    for letter in "tnrfv":
        y = f"replace({y}, chr(92) || '{letter}', chr(7))"
    y = f"translate({y}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), chr(7) || chr(7) || chr(7) || chr(7) || chr(7))"
    return q_then_spaces(x, f"regexp_replace({y}, '[ ' || chr(7) || ']*' || chr(7) || '[ ' || chr(7) || ']*', ' ', 'g')")


def q_percent(x: str) -> str:
    """The dirt's one token."""
    return q_then_spaces(x, f"replace({x}, '%param_1%%', ' ')")


def q_game(x: str) -> str:
    """The dirt's tokens: two in carets, and a variant."""
    return q_then_spaces(x, f"replace(replace(replace({x}, '^{{85 221 85}}^', ' '), '^{{/color}}^', ' '), '$m(a|b)', 'a')")


def q_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def q_collapse(x: str) -> str:
    return q_strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def q_reason(s: str, t: str) -> str:
    empty = lambda x: rf"regexp_matches({x}, '^[\s\pP\pS]*$')"
    number = lambda x: rf"(regexp_matches({x}, '\p{{Nd}}') AND NOT regexp_matches({x}, '[\pL\p{{Nl}}]'))"
    words = lambda x: f"string_split({q_collapse(x)}, ' ')"
    core = r"""regexp_replace(w, '^[.,;:!?()\[\]{}<>"'']+|[.,;:!?()\[\]{}<>"'']+$', '', 'g')"""
    ok = rf"regexp_matches({core}, '(?i)^(?:https?://|www\.)\S+$') OR regexp_matches({core}, '^(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}(?:/\S*)?$')"
    link = lambda x: f"(len(list_filter({words(x)}, lambda w: NOT ({ok}))) = 0)"
    return f"CASE WHEN {empty(s)} OR {empty(t)} THEN 'empty_source_or_target' WHEN {number(s)} OR {number(t)} THEN 'numeric_only_side' WHEN {link(s)} OR {link(t)} THEN 'link_only_side' END"


def q_count(x: str, chars: str) -> str:
    return f"length(regexp_replace({x}, '[^{chars}]', '', 'g'))"


def _re2(chars: str) -> str:
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", chars)


def q_parts(x: str) -> str:
    """Sentences of a text, as split.split_text cuts them."""
    x = q_strip(x)
    m = "\x01"
    stop = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    y = rf"""regexp_replace({x}, '([.!?…])(["''”»)\]]*(?:\s+|[A-ZА-ЯЁ]))', '\1{m}\2', 'g')"""
    y = rf"regexp_replace({y}, '((?i:{stop})|\.\.\.|…){m}', '\1', 'g')"
    y = rf"regexp_replace({y}, '{m}(\s*[A-Z]\.)', '\1', 'g')"
    y = rf"regexp_replace({y}, '((?:\r?\n){{2,}})', '{m}\1', 'g')"
    y = rf"regexp_replace({y}, '(\r?\n\s*[QAВО]\s*:)', '{m}\1', 'g')"
    head, tail = rf"regexp_extract({y}, '^((?s:.*)[\pL\pN_])', 1)", rf"regexp_extract({y}, '([^\pL\pN_]*)$', 1)"
    whole = f"({head} || replace({tail}, '{m}', ''))"
    return f"CASE WHEN {x} = '' THEN [] ELSE list_filter(list_transform(string_split({whole}, '{m}'), lambda v: {q_strip('v')}), lambda v: v <> '') END"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL that gives the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _both(name: str, rule, q):
    def run(spark, sf_dir):
        return pairs(spark, sf_dir).select("file_id", "tu_index", rule(F.col("src")).alias("clean_src"), rule(F.col("tgt")).alias("clean_tgt"))

    run.__name__ = name
    query(f"WITH {P} SELECT file_id, tu_index, {q('src')} AS clean_src, {q('tgt')} AS clean_tgt FROM p")(run)


_both("normalize_spaces", rules.normalize_spaces, q_spaces)
_both("collapse_line_breaks", rules.collapse_line_breaks, q_breaks)
_both("strip_percent_tokens", rules.strip_percent_tokens, q_percent)
_both("strip_game_markup", rules.strip_game_markup, q_game)

_CLEAN = f"""{P}, g AS (SELECT *, {q_game('src')} AS s1, {q_game('tgt')} AS t1 FROM p),
c AS (SELECT *, {q_spaces('s1')} AS s2, {q_spaces('t1')} AS t2 FROM g),
r AS (SELECT *, {q_reason(q_strip('s2'), q_strip('t2'))} AS remove_reason FROM c)"""


@query(f"WITH {_CLEAN} SELECT coalesce(remove_reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def garbage_classify(spark, sf_dir):
    done = clean_pairs(xml_pairs(spark, sf_dir))
    return done.groupBy(F.coalesce("remove_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_ACTIONS = f"""{_CLEAN}, a AS (
  SELECT file_id, tu_index, 'remove_game_markup' AS rule, 1 AS o FROM r WHERE s1 <> src OR t1 <> tgt
  UNION ALL SELECT file_id, tu_index, 'normalize_spaces', 2 FROM r WHERE s2 <> s1 OR t2 <> t1
  UNION ALL SELECT file_id, tu_index, 'remove_garbage_segment', 3 FROM r WHERE remove_reason IS NOT NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY file_id, tu_index ORDER BY o) - 1 AS ordinal FROM a)"""


def _proposals(spark, sf_dir) -> DataFrame:
    return review.cleanup_proposals(clean_pairs(xml_pairs(spark, sf_dir)))


@query(f"WITH {_ACTIONS} SELECT file_id, 'cleanup:' || tu_index || ':' || rule || ':' || ordinal AS id, tu_index, ordinal::INT AS ordinal, rule FROM x")
def proposal_ids(spark, sf_dir):
    return _proposals(spark, sf_dir).select("file_id", "id", "tu_index", "ordinal", "rule")


@query(f"WITH {_ACTIONS} SELECT CASE WHEN rule = 'remove_game_markup' THEN 'service_markup' ELSE rule END AS check_type, count(*) AS n FROM x GROUP BY 1")
def proposals_by_type(spark, sf_dir):
    return review.counts_by_type(_proposals(spark, sf_dir))


@query(f"WITH {_ACTIONS} SELECT rule, count(*) AS total, least(count(*), 20) AS stored, greatest(count(*) - 20, 0) AS omitted FROM x GROUP BY 1")
def detail_totals(spark, sf_dir):
    return review.detail_totals(_proposals(spark, sf_dir), ["rule"], 20)


@query(f"WITH {_ACTIONS} SELECT rule, tu_index FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY tu_index) AS n FROM x) WHERE n <= 20")
def detail_caps(spark, sf_dir):
    return review.cap_details(_proposals(spark, sf_dir), ["rule"], ["tu_index"], 20).select("rule", "tu_index")


@query(f"WITH {P}, m AS (SELECT file_id, tu_index, {q_count('src', r'\pL\pN')} AS a, {q_count('tgt', r'\pL\pN')} AS b FROM p) SELECT file_id, tu_index, round(b / a, 6) AS ratio FROM m WHERE a >= 6 AND b >= 2 AND (b / a < 0.35 OR b / a > 2.8)")
def length_anomaly(spark, sf_dir):
    p = pairs(spark, sf_dir).where(rules.length_anomaly(F.col("src"), F.col("tgt")))
    return p.select("file_id", "tu_index", F.round(rules.length_ratio(F.col("src"), F.col("tgt")), 6).alias("ratio"))


@query(f"WITH {P} SELECT file_id, tu_index FROM p WHERE lower(upper({q_collapse('src')})) = lower(upper({q_collapse('tgt')})) AND regexp_matches(src, '\\pL')")
def identical_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.where(rules.is_identical(F.col("src"), F.col("tgt"), F.col("src_lang"), F.col("tgt_lang"))).select("file_id", "tu_index")


@query("SELECT doc_id, " + ", ".join([f"{q_count('text', r'\pL')} AS alpha", f"{q_count('text', r'\p{Nd}')} AS digit", *[f"{q_count('text', _re2(c))} AS {n}" for n, c in SCRIPTS.items()]]) + " FROM documents")
def script_histogram(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", rules.script_histogram(F.col("text")).alias("h")).select("doc_id", "h.*")


_FOREIGN = {"latin": "+".join(q_count("{x}", _re2(c)) for n, c in SCRIPTS.items() if n != "latin"), "cyrillic": "+".join(q_count("{x}", _re2(c)) for n, c in SCRIPTS.items() if n != "cyrillic")}


def _q_mismatch(x: str, script: str) -> str:
    return f"({q_count(x, r'\pL')} >= 3 AND {q_count(x, _re2(SCRIPTS[script]))} = 0 AND {_FOREIGN[script].replace('{x}', x)} >= 3)"


@query(f"WITH {P}, m AS (SELECT file_id, tu_index, {_q_mismatch('src', 'latin')} AS src_mismatch, CASE WHEN tgt_lang = 'ru_RU' THEN {_q_mismatch('tgt', 'cyrillic')} ELSE {_q_mismatch('tgt', 'latin')} END AS tgt_mismatch FROM p) SELECT * FROM m WHERE src_mismatch OR tgt_mismatch")
def lang_mismatch(spark, sf_dir):
    p = pairs(spark, sf_dir)
    out = p.select("file_id", "tu_index", rules.lang_mismatch(F.col("src"), F.col("src_lang")).alias("src_mismatch"), rules.lang_mismatch(F.col("tgt"), F.col("tgt_lang")).alias("tgt_mismatch"))
    return out.where("src_mismatch OR tgt_mismatch")


_WARN = f"""{_CLEAN}, w AS (SELECT *, {q_count('s2', r'\pL\pN')} AS a, {q_count('t2', r'\pL\pN')} AS b FROM r WHERE remove_reason IS NULL)"""


@query(f"""WITH {_WARN}
SELECT rule, count(*) AS n FROM (
  SELECT 'length_anomaly' AS rule FROM w WHERE a >= 6 AND b >= 2 AND (b / a < 0.35 OR b / a > 2.8)
  UNION ALL SELECT 'lang_mismatch_source' FROM w WHERE {_q_mismatch('s2', 'latin')}
  UNION ALL SELECT 'lang_mismatch_target' FROM w WHERE CASE WHEN tgt_lang = 'ru_RU' THEN {_q_mismatch('t2', 'cyrillic')} ELSE {_q_mismatch('t2', 'latin')} END
  UNION ALL SELECT 'identical_source_target' FROM w WHERE lower(upper({q_collapse('s2')})) = lower(upper({q_collapse('t2')})) AND regexp_matches(s2, '\\pL')) GROUP BY 1""")
def warning_counts(spark, sf_dir):
    done = clean_pairs(xml_pairs(spark, sf_dir))
    return done.select(F.explode("warnings").alias("w")).groupBy("w.rule").agg(F.count("*").alias("n"))


_DUP = "d AS (SELECT *, row_number() OVER (PARTITION BY lang, text, source ORDER BY doc_id) AS n FROM documents)"


def _marked(spark, sf_dir) -> DataFrame:
    return units.mark_duplicates(_t(spark, sf_dir, "documents"), "text", "source", "doc_id", "lang")


@query(f"WITH {_DUP} SELECT lang, doc_id FROM d WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    return _marked(spark, sf_dir).where("NOT is_duplicate").select("lang", "doc_id")


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS n FROM documents) SELECT lang, doc_id, 'dedup_tu' AS reason FROM d WHERE n > 1")
def dedup_removed_rows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("other", F.lit(""))
    return units.mark_duplicates(d, "text", "other", "doc_id", "lang").where("is_duplicate").select("lang", "doc_id", F.lit("dedup_tu").alias("reason"))


@query(f"SELECT doc_id, len({q_parts('text')}) AS n_sentences FROM documents")
def sentence_split_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(split.split_text(F.col("text"))).alias("n_sentences"))


@query(f"WITH s AS (SELECT doc_id, {q_parts('text')} AS parts FROM documents) SELECT doc_id, (unnest(range(len(parts))))::INT AS part_index, unnest(parts) AS sentence FROM s")
def sentence_explode(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.split_text(F.col("text"))).alias("part_index", "sentence"))


_SPLIT = f"{P}, s AS (SELECT file_id, tu_index, {q_parts('src')} AS a, {q_parts('tgt')} AS b FROM p)"


def _q_short(v: str) -> str:
    return rf"len(regexp_extract_all({v}, '[\pL\pN]+')) <= 3"


_LETTER = r"[\pL\p{Nl}\p{No}]"
_NOISE = f"({q_collapse('z[1]')} = '' OR {q_collapse('z[2]')} = '' OR lower(upper({q_collapse('z[1]')})) = lower(upper({q_collapse('z[2]')})) OR NOT regexp_matches(z[1], '{_LETTER}') OR NOT regexp_matches(z[2], '{_LETTER}'))"
_NUMERIC = rf"regexp_matches(v, '\p{{Nd}}') AND NOT regexp_matches(v, '{_LETTER}')"
_GUARD = f"""CASE WHEN len(a) < 2 OR len(a) <> len(b) THEN 'count'
  WHEN len(list_filter(a, lambda v: {_NUMERIC})) + len(list_filter(b, lambda v: {_NUMERIC})) > 0 THEN 'numeric'
  WHEN len(list_filter(list_zip(a, b), lambda z: {_NOISE})) > 0 THEN 'noise'
  WHEN len(a) = 2 AND len(list_filter(a, lambda v: NOT {_q_short('v')})) + len(list_filter(b, lambda v: NOT {_q_short('v')})) = 0 THEN 'short' ELSE 'split' END"""


def _guarded(spark, sf_dir) -> DataFrame:
    s = pairs(spark, sf_dir).select("file_id", "tu_index", split.split_text(F.col("src")).alias("a"), split.split_text(F.col("tgt")).alias("b"))
    return s.withColumn("outcome", F.coalesce(split.guards(F.col("a"), F.col("b")), F.lit("split")))


@query(f"WITH {_SPLIT} SELECT {_GUARD} AS outcome, count(*) AS n FROM s GROUP BY 1")
def split_guards(spark, sf_dir):
    return _guarded(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_SPLIT}, g AS (SELECT *, {_GUARD} AS outcome FROM s WHERE len(a) = len(b)) SELECT file_id, tu_index, (unnest(range(len(a))))::INT AS part_index, unnest(a) AS src_part, unnest(b) AS tgt_part FROM g WHERE outcome = 'split'")
def aligned_split_pairs(spark, sf_dir):
    g = _guarded(spark, sf_dir).where("outcome = 'split'")
    return g.select("file_id", "tu_index", F.posexplode(F.arrays_zip("a", "b")).alias("part_index", "z")).select("file_id", "tu_index", "part_index", F.col("z.a").alias("src_part"), F.col("z.b").alias("tgt_part"))


# ---- decisions and review: labels stand in for people's decisions ----

_WORDS = "CASE WHEN toxic = 1 AND quality = 1 THEN 'maybe' WHEN quality = 1 THEN ' Accept ' WHEN toxic = 1 THEN 'decline' ELSE 'skip' END"
_DECISIONS = f"SELECT CASE WHEN doc_id % 17 = 0 THEN 'lost:' ELSE 'split:' END || doc_id AS id, {_WORDS} AS decision, CASE WHEN doc_id % 5 = 0 THEN 'see ' || doc_id ELSE '' END AS comment, doc_id AS seq FROM {{l}}"
_ISSUES = "SELECT lang AS file_id, 'split:' || doc_id AS id, doc_id AS tu_index, doc_id AS seq, 'pending' AS status, 'none' AS comment, source FROM {d}"
_I, _D = f"i AS ({_ISSUES.format(d='documents')})", f"d AS ({_DECISIONS.format(l='labels')})"
_STATUS = "CASE trim(lower(decision)) WHEN 'accept' THEN 'accepted' WHEN 'decline' THEN 'rejected' WHEN 'skip' THEN 'skipped' END"
_MERGED = f"{_I}, {_D}, v AS (SELECT *, {_STATUS} AS s FROM d), m AS (SELECT i.file_id, i.id, i.tu_index, i.seq, i.source, coalesce(v.s, i.status) AS status, CASE WHEN v.s IS NOT NULL AND v.comment <> '' THEN v.comment ELSE i.comment END AS comment FROM i LEFT JOIN v ON v.id = i.id AND v.s IS NOT NULL)"


def _issues(spark, sf_dir) -> DataFrame:
    return spark.sql(_ISSUES.format(d=f"parquet.`{sf_dir}/documents.parquet`"))


def _decisions(spark, sf_dir) -> DataFrame:
    return spark.sql(_DECISIONS.format(l=f"parquet.`{sf_dir}/labels.parquet`"))


def _merged(spark, sf_dir) -> DataFrame:
    return review.merge_decisions(_issues(spark, sf_dir), _decisions(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT id, tu_index, status, comment FROM m")
def decision_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("id", "tu_index", "status", "comment")


@query(f"WITH {_I}, {_D} SELECT id, decision FROM d WHERE id NOT IN (SELECT id FROM i) OR {_STATUS} IS NULL")
def unrecognized_decisions(spark, sf_dir):
    return review.unrecognized(_issues(spark, sf_dir), _decisions(spark, sf_dir)).select("id", "decision")


@query(f"WITH {_MERGED} SELECT count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'pending') AS pending FROM m")
def status_counts(spark, sf_dir):
    return review.status_counts(_merged(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT id, CASE status WHEN 'accepted' THEN 0 WHEN 'rejected' THEN 1 WHEN 'skipped' THEN 2 ELSE 3 END AS rank FROM m")
def issue_order(spark, sf_dir):
    return review.ordered_issues(_merged(spark, sf_dir)).select("id", "rank")


@query(f"WITH {_MERGED} SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT tu_index FROM m WHERE status = 'accepted')")
def apply_semi_join(spark, sf_dir):
    accepted = _merged(spark, sf_dir).where("status = 'accepted'").select("file_id", "id")
    d = _t(spark, sf_dir, "documents").select(F.col("lang").alias("file_id"), F.col("doc_id").alias("tu_index"))
    return review.apply_selection(d, accepted).select(F.col("tu_index").alias("doc_id"), F.col("file_id").alias("lang"))


@query(f"WITH {_MERGED} SELECT id, tu_index FROM m WHERE source IN ('src0', 'src3', 'src5', 'src7', 'src10', 'src15') AND status = 'accepted' AND contains(lower(concat_ws(' ', 'tu #' || (tu_index + 1), id, comment)), '1') ORDER BY tu_index LIMIT 5 OFFSET 5")
def review_search_page(spark, sf_dir):
    """The second page of five accepted issues of some types in which the search finds a 1."""
    m = _merged(spark, sf_dir).withColumn("check_type", F.col("source"))
    text = review.search_text([F.concat(F.lit("tu #"), F.col("tu_index") + 1), F.col("id"), F.col("comment")])
    return review.review_page(m.withColumn("search_text", text), ["src0", "src3", "src5", "src7", "src10", "src15"], "accepted", "1", 1, ["tu_index"], 5).select("id", "tu_index")


# ---- statistics ----

_UNITS = """SELECT lang AS file_id, doc_id AS tu_index, doc_id % 4 AS outputs, CASE WHEN doc_id % 7 = 0 THEN 'missing_seg' END AS skip_reason,
  CASE WHEN doc_id % 4 = 0 THEN 'empty_source_or_target' END AS remove_reason, doc_id % 3 AS n_actions, doc_id % 2 AS n_warnings,
  CASE WHEN doc_id % 5 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, CASE WHEN doc_id % 10 = 0 THEN 'OK' WHEN doc_id % 11 = 0 THEN 'FAIL' END AS verdict,
  source AS tgt_lang, n_chars AS prompt_tokens, n_chars % 100 AS candidate_tokens FROM {d}"""


@query(f"""WITH u AS ({_UNITS.format(d='documents')})
SELECT file_id, count(*) AS total, count(*) FILTER (outputs > 1) AS split, sum(outputs)::BIGINT AS created, count(skip_reason) AS skipped, count(remove_reason) AS removed,
  count(*) FILTER (outputs > 1 AND confidence = 'HIGH') AS high, count(*) FILTER (outputs > 1 AND confidence = 'MEDIUM') AS medium, count(verdict) AS checked, count(*) FILTER (verdict = 'FAIL') AS rejected,
  sum(n_actions)::BIGINT AS auto_actions, sum(n_warnings)::BIGINT AS warnings, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(candidate_tokens)::BIGINT AS candidate_tokens, arg_max(tgt_lang, tu_index) AS tgt_lang,
  round(sum(prompt_tokens) / 1e6 * 0.1 + sum(candidate_tokens) / 1e6 * 0.4, 6) AS cost_usd
FROM u GROUP BY ROLLUP (file_id)""")
def run_stats(spark, sf_dir):
    u = spark.sql(_UNITS.format(d=f"parquet.`{sf_dir}/documents.parquet`"))
    return stats.run_stats(u).withColumn("cost_usd", F.round("cost_usd", 6))


@query("SELECT event_type, round(greatest(sum(round(value)), 0) / 1e6 * 0.1 + greatest(sum(event_id % 7), 0) / 1e6 * 0.4, 9) AS cost_usd FROM events GROUP BY 1")
def cost_estimate(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.round("value")).alias("a"), F.sum(F.col("event_id") % 7).alias("b"))
    return e.select("event_type", F.round(verify.cost(F.col("a"), F.col("b")), 9).alias("cost_usd"))


@query("SELECT user_id, event_id, sum(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM events")
def running_tokens(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 97)
    return stats.running_totals(e, ["user_id"], ["ts", "event_id"], ["tokens"]).select("user_id", "event_id", "running_tokens")


@query("SELECT user_id, round(list_reduce(list(value::DOUBLE ORDER BY ts, event_id), lambda a, x: a * 0.65::DOUBLE + x * 0.35::DOUBLE), 6) AS ema FROM events WHERE value IS NOT NULL GROUP BY 1")
def ema_rate(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"].cast("double")).alias("v"))
    return e.select("user_id", F.round(stats.ema(F.col("v")), 6).alias("ema"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR n % 5 = 0 OR n = total")
def progress_throttle(spark, sf_dir):
    return stats.throttle(_t(spark, sf_dir, "events"), ["user_id"], "event_id", 5).select("user_id", "event_id")


@query("SELECT lang, least(greatest(max(length(text)) + 2, 12), 80) AS width FROM documents GROUP BY 1")
def column_width(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(stats.column_width("text").alias("width"))


# ---- verifier ----

_BODY = """'{"candidates":[{"content":{"parts":[{"text":' || CASE doc_id % 4 WHEN 0 THEN '"{\\"verdict\\":\\"ok\\",\\"issues\\":[],\\"summary\\":\\"fine\\"}"' WHEN 1 THEN '"```json {\\"verdict\\":\\"FAIL\\",\\"issues\\":[{\\"severity\\":\\"high\\",\\"type\\":\\"x\\",\\"message\\":\\"m\\"}],\\"summary\\":\\"bad\\"} ```"' WHEN 2 THEN '"no json here"' ELSE '"so: {\\"verdict\\":\\"perhaps\\"} end"' END || '}]}}],"usageMetadata":{"promptTokenCount":' || n_chars || ',"candidatesTokenCount":' || (doc_id % 9) || '}}'"""


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'FAIL' ELSE 'WARN' END AS verdict, CASE doc_id % 4 WHEN 0 THEN 'fine' WHEN 1 THEN 'bad' ELSE '' END AS summary, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS n_issues, n_chars AS prompt_tokens, n_chars + doc_id % 9 AS total_tokens FROM documents")
def verdict_parse(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    body = F.expr(_BODY.replace("\\", "\\\\"))
    r = d.select("doc_id", verify.parse_response(body).alias("r"))
    return r.select("doc_id", "r.verdict", "r.summary", F.size("r.issues").alias("n_issues"), "r.prompt_tokens", "r.total_tokens")


_JSON_PARTS = "'[' || array_to_string(list_transform({v}, lambda x: to_json(x)::VARCHAR), ',') || ']'"


@query(f"""WITH {_SPLIT}, j AS (SELECT file_id, tu_index, src, tgt, p.src_lang, p.tgt_lang, a, b, {_JSON_PARTS.format(v='a')} AS sj, {_JSON_PARTS.format(v='b')} AS tj,
  '[' || array_to_string(list_transform(list_zip(a, b), lambda z: '{{"src":' || to_json(z[1]) || ',"tgt":' || to_json(z[2]) || '}}'), ',') || ']' AS pairs FROM s JOIN p USING (file_id, tu_index) WHERE len(a) = len(b))
SELECT file_id, tu_index, 'Ask about ' || src_lang || ' and ' || tgt_lang || ': ' || src || ' = ' || tgt || ' in ' || len(a) || ' parts ' || sj || tj || pairs || chr(10) || chr(10) || 'Auto context JSON:' || chr(10) ||
  '{{"src_lang":' || to_json(src_lang) || ',"tgt_lang":' || to_json(tgt_lang) || ',"original":{{"src":' || to_json(src) || ',"tgt":' || to_json(tgt) || '}},"split_pairs":' || pairs || '}}' AS prompt FROM j""")
def prompt_render(spark, sf_dir):
    """What a verifier is asked, for whole texts and all places of the template."""
    s = pairs(spark, sf_dir).withColumns({"a": split.split_text(F.col("src")), "b": split.split_text(F.col("tgt"))}).where("size(a) = size(b)")
    template = "Ask about {SRC_LANG} and {TGT_LANG}: {ORIGINAL_SRC} = {ORIGINAL_TGT} in {PAIR_COUNT} parts {SRC_PARTS_JSON}{TGT_PARTS_JSON}{SPLIT_PAIRS_JSON}"
    return s.select("file_id", "tu_index", verify.render_prompt(F.lit(template), *(F.col(c) for c in ("src_lang", "tgt_lang", "src", "tgt", "a", "b"))).alias("prompt"))


# ---- units, exports, previews ----


def conversation_units(spark, sf_dir) -> DataFrame:
    """A unit for each user turn with an answer, its two or three variants in an array."""
    tuv = lambda lang, text: F.struct(F.lit(lang).alias("lang"), F.create_map(F.lit("xml:lang"), F.lit(lang)).alias("attrs"), F.col(text).alias("seg_xml"))
    prop = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    p = pairs(spark, sf_dir)
    three = F.when(F.col("k") == 6, F.array(tuv("en-US", "src"), tuv("de-DE", "tgt"), tuv("fr", "tgt"))).when(F.col("k") == 5, F.array(tuv("de-DE", "tgt"))).when(F.col("k") == 4, F.array(tuv("de-DE", "tgt"), tuv("EN", "src"))).otherwise(F.array(tuv("en-US", "src"), tuv("de-DE", "tgt")))
    props = F.array(prop("x-Context", F.lit("c")), prop("x-Note", F.col("tu_index").cast("string")))
    return p.select("file_id", "tu_index", "k", F.create_map(F.lit("creationid"), F.lit("u")).alias("attrs"), props.alias("props"), three.alias("tuvs"), F.lit(None).cast("string").alias("corrupt"))


def _headers(spark) -> DataFrame:
    return spark.createDataFrame([(f"f{k}", "en_us") for k in range(3)], "file_id string, src_lang string")


@query(f"WITH {P} SELECT file_id, tu_index, CASE WHEN k = 4 THEN 'EN' WHEN k <> 5 THEN 'en-US' END AS src_lang, CASE WHEN k <> 5 THEN 'de-DE' END AS tgt_lang, CASE k WHEN 5 THEN 'less_than_two_tuv' WHEN 6 THEN 'multilang_tu' END AS skip_reason FROM p")
def orientation(spark, sf_dir):
    return units.orient(conversation_units(spark, sf_dir), _headers(spark)).select("file_id", "tu_index", "src_lang", "tgt_lang", "skip_reason")


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


#: A tag and an entity in the midst of a text, as XML and as an export shows them.
_TAGGED = "regexp_replace({x}, '^([^ ]+) ', '{w}<ph x=\"1\" type=''a''/><b>bold &amp; so</b> ')"
_SHOWN = "regexp_replace({x}, '^([^ ]+) ', '{w}{{ph: x=1, type=a}}{{b}}bold & so ')"
_GROUP = chr(92) + "1"


@query(f"WITH {P}, x AS (SELECT *, {_SHOWN.format(x='src', w=_GROUP)} AS s, CASE WHEN k = 8 THEN ' ' || chr(160) || chr(8195) ELSE tgt END AS t FROM p), e AS (SELECT file_id, tu_index, s AS source, t AS target, 'de-DE' AS target_lang FROM x WHERE k NOT IN (4, 5) UNION ALL SELECT file_id, tu_index, s, t, 'fr' FROM x WHERE k = 6) SELECT * FROM e WHERE NOT regexp_matches(target, '^[' || chr(32) || chr(160) || chr(8195) || ']*$')")
def pair_export(spark, sf_dir):
    """Export texts of segments with tags and entities; blank targets, also of no-break spaces, go."""
    tag = lambda v: F.regexp_replace(v, "^([^ ]+) ", "$1<ph x=\"1\" type='a'/><b>bold &amp; so</b> ")
    u = conversation_units(spark, sf_dir)
    blank = F.lit(" \u00a0\u2003")
    made = F.transform("tuvs", lambda v: F.struct(v["lang"].alias("lang"), v["attrs"].alias("attrs"), F.when(v["lang"] == "en-US", tag(v["seg_xml"])).when(F.col("k") == 8, blank).otherwise(v["seg_xml"]).alias("seg_xml")))
    return units.language_pairs(u.withColumn("tuvs", made), "en-US")


@query(f"WITH {P} SELECT file_id, count(*) AS tu_count, concat_ws(',', CASE WHEN bool_or(k NOT IN (4, 5)) THEN 'en-US' END, CASE WHEN bool_or(k = 4) THEN 'EN' END, 'de-DE', CASE WHEN bool_or(k = 6) THEN 'fr' END) AS languages, 'x-Context,x-Note' AS prop_types FROM p GROUP BY 1")
def tmx_profile(spark, sf_dir):
    h = _headers(spark).withColumn("src_lang", F.lit("en-US"))
    return units.profile(conversation_units(spark, sf_dir), h).select("file_id", "tu_count", F.array_join("languages", ",").alias("languages"), F.array_join("prop_types", ",").alias("prop_types"))


@query(f"""WITH {_SPLIT}, g AS (SELECT s.*, {_GUARD} AS outcome, p.k FROM s JOIN p USING (file_id, tu_index))
SELECT file_id, tu_index, (unnest(range(len(a))))::INT AS part_index, unnest(a) AS src_seg, unnest(b) AS tgt_seg, 'x-split-confidence=HIGH,x-Note=' || tu_index AS props FROM g WHERE outcome = 'split'""")
def split_unit_rows(spark, sf_dir):
    """Units built from aligned parts: confidence added, context dropped."""
    u = conversation_units(spark, sf_dir)
    g = _guarded(spark, sf_dir).where("outcome = 'split'").select("file_id", "tu_index", F.col("a").alias("src_parts"), F.col("b").alias("tgt_parts"))
    ready = u.join(g, ["file_id", "tu_index"]).withColumns({"src_pos": F.lit(0), "confidence": F.lit("HIGH"), "verdict": F.lit(None).cast("string")})
    shown = F.array_join(F.transform("props", lambda p: F.concat(p["type"], F.lit("="), p["value"])), ",")
    return units.split_units(ready).select("file_id", "tu_index", "part_index", F.col("tuvs")[0]["seg_xml"].alias("src_seg"), F.col("tuvs")[1]["seg_xml"].alias("tgt_seg"), shown.alias("props"))


@query(f"WITH {P} SELECT file_id, tu_index, length(src) - length(replace(src, ' ', '')) AS spaces_before, length({q_spaces('src')}) - length(replace({q_spaces('src')}, ' ', '')) AS spaces_after FROM p")
def space_delta(spark, sf_dir):
    p = pairs(spark, sf_dir)
    d = diff.space_delta(F.col("src"), rules.normalize_spaces(F.col("src")))
    return p.select("file_id", "tu_index", d.alias("d")).select("file_id", "tu_index", F.col("d.before").alias("spaces_before"), F.col("d.after").alias("spaces_after"))


@query(f"SELECT doc_id, CASE WHEN length({q_collapse('text')}) > 180 THEN left({q_collapse('text')}, 177) || '...' ELSE {q_collapse('text')} END AS shown FROM documents")
def text_preview(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", diff.preview(F.col("text")).alias("shown"))


@query(r"SELECT page_id, translate(url, '\/:*?""<>|', '_________') AS name FROM pages".replace('""', '"'))
def safe_file_name(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


@query(r"""SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS bare FROM pages""")
def tag_probe(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", probe_text(F.col("html")).alias("bare"))


_JOIN = r"""CASE WHEN a = '' OR b = '' THEN a || b WHEN ends_with(a, ' ') OR starts_with(b, ' ') THEN rtrim(a, ' ') || ' ' || ltrim(b, ' ')
  WHEN regexp_matches(a, '\s$') OR regexp_matches(b, '^\s') OR contains('([{"' || chr(39), right(a, 1)) OR contains(',.;:!?)]}"' || chr(39), left(b, 1)) THEN a || b
  WHEN contains('.!?:;)]}…', right(a, 1)) AND regexp_matches(b, '^[\pL\pN]') OR regexp_matches(a, '\p{Ll}$') AND regexp_matches(b, '^\p{Lu}') THEN a || ' ' || b ELSE a || b END"""


@query(f"""WITH x AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[<&>]', ' ', 'g'), '([^ ]+ [^ ]+) ([^ ]+)', '\\1|~|\\2', 'g'), '|~|') AS parts FROM documents)
SELECT doc_id, trim(list_reduce(parts, lambda a, b: {_JOIN}), ' ') AS bare FROM x""")
def tag_removal(spark, sf_dir):
    """Inline tags out of segments in which a tag stands for every third word's space."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "[<&>]", " "), "([^ ]+ [^ ]+) ([^ ]+)", '$1<ph x="1"/>$2').alias("xml"))
    return d.select("doc_id", split.drop_inline_tags(F.col("xml")).alias("bare"))


@query(f"""WITH RECURSIVE {P}, s AS (SELECT file_id, tu_index, {q_parts(_esc('src'))} AS a, {q_parts(_esc('tgt'))} AS b FROM p),
o AS (SELECT *, len(a) > len(b) AS swap, CASE WHEN len(a) > len(b) THEN a ELSE b END AS l, CASE WHEN len(a) > len(b) THEN b ELSE a END AS t FROM s
  WHERE len(a) <> len(b) AND least(len(a), len(b)) >= 2 AND abs(len(a) - len(b)) <= 4 AND greatest(len(a), len(b)) <= floor(1.5 * least(len(a), len(b)))),
m AS (SELECT *, list_transform(l, lambda v: length(v)) AS have, list_transform(t, lambda v: length(v)) AS raw FROM o),
w AS (SELECT *, list_transform(raw, lambda v: greatest(1.0, v * (list_sum(have)::DOUBLE / list_sum(raw)))) AS want FROM m),
f AS (SELECT file_id, tu_index, 0 AS j, [0] AS cuts, 0::DOUBLE AS cost, 0::DOUBLE AS err FROM w
  UNION ALL SELECT f.file_id, f.tu_index, j + 1, list_append(cuts, n.z), cost + pow(list_sum(have[cuts[-1] + 1 : n.z]) - want[j + 1], 2), err + abs(list_sum(have[cuts[-1] + 1 : n.z]) - want[j + 1])
  FROM f JOIN w USING (file_id, tu_index), unnest(range(1, 60)) n(z) WHERE j < len(want) AND n.z > cuts[-1] AND n.z <= len(have) - (len(want) - j - 1) AND (j + 1 < len(want) OR n.z = len(have))),
c AS (SELECT f.*, row_number() OVER (PARTITION BY file_id, tu_index ORDER BY cost, list_reverse(cuts)) AS n FROM f JOIN w USING (file_id, tu_index) WHERE j = len(want)),
r AS (SELECT file_id, tu_index, swap, t, err / greatest(1, list_sum(have)) AS err, list_transform(range(1, len(cuts)), lambda i: list_reduce(l[cuts[i] + 1 : cuts[i + 1]], lambda x, y: CASE WHEN contains('([{{«', right(x, 1)) OR contains('.,!?:;)]}}»', left(y, 1)) THEN x || y ELSE x || ' ' || y END)) AS g FROM c JOIN w USING (file_id, tu_index) WHERE n = 1),
z AS (SELECT file_id, tu_index, a, b FROM s WHERE len(a) = len(b) AND len(a) > 1 UNION ALL SELECT file_id, tu_index, CASE WHEN swap THEN g ELSE t END, CASE WHEN swap THEN t ELSE g END FROM r WHERE err <= 0.45)
SELECT file_id, tu_index, array_to_string(a, chr(8227)) AS src_parts, array_to_string(b, chr(8227)) AS tgt_parts FROM z""")
def reconcile_dp(spark, sf_dir):
    """Both sides' sentences, the longer side's merged to the shorter side's number where that is allowed; the SQL tries all ways."""
    p = pairs(spark, sf_dir).select("file_id", "tu_index", escape(F.col("src")).alias("src"), escape(F.col("tgt")).alias("tgt"))
    s = settled(p).select("file_id", "tu_index", split.split_pair("src", "tgt").alias("s")).where("s.src IS NOT NULL")
    return s.select("file_id", "tu_index", F.array_join("s.src", chr(8227)).alias("src_parts"), F.array_join("s.tgt", chr(8227)).alias("tgt_parts"))


@query(rf"""WITH {P}, t AS (SELECT file_id, tu_index, regexp_extract_all(src, '[\pL\pN_]+|\s+|[^\pL\pN_\s]') AS v FROM p),
i AS (SELECT file_id, tu_index, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x, len(v) AS n FROM t),
r AS (SELECT *, regexp_matches(x, '^\s+$') AND regexp_replace(x, ' +', ' ', 'g') <> x OR regexp_matches(x, '^ ') AND i = 1 OR regexp_matches(x, ' $') AND i = n AS changed FROM i),
c AS (SELECT file_id, tu_index, i, changed, x, CASE WHEN NOT changed THEN x ELSE regexp_replace(CASE WHEN i = 1 THEN ltrim(CASE WHEN i = n THEN rtrim(x, ' ') ELSE x END, ' ') WHEN i = n THEN rtrim(x, ' ') ELSE x END, ' +', ' ', 'g') END AS y FROM r)
SELECT file_id, tu_index, coalesce(string_agg(CASE WHEN NOT changed THEN '=' || x ELSE '-' || x || CASE WHEN y <> '' THEN '+' || y ELSE '' END END, chr(8227) ORDER BY i), '') AS runs FROM c GROUP BY 1, 2""")
def diff_segments(spark, sf_dir):
    """What normalising spaces changes, by token; tokens of equal runs are shown apart."""
    p = settled(pairs(spark, sf_dir).select("file_id", "tu_index", "src", rules.normalize_spaces(F.col("src")).alias("after")))
    d = p.select("file_id", "tu_index", diff.diff_segments(by_token=True)("src", "after").alias("d"))
    sign = F.create_map(F.lit("equal"), F.lit("="), F.lit("delete"), F.lit("-"), F.lit("insert"), F.lit("+"))
    tokens = lambda r: F.when(r["kind"] == "equal", F.array_join(F.transform(F.regexp_extract_all(r["text"], F.lit(r"([\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s])"), F.lit(1)), lambda x: F.concat(F.lit("="), x)), chr(8227))).otherwise(F.concat(F.element_at(sign, r["kind"]), r["text"]))
    shown = F.transform("d", lambda r, i: F.concat(F.when((i > 0) & (r["kind"] != "insert") | (i > 0) & (F.get("d", i - 1)["kind"] != "delete"), F.lit(chr(8227))).otherwise(""), tokens(r)))
    return d.select("file_id", "tu_index", F.array_join(shown, "").alias("runs"))


@query(f"""WITH {P}, b AS (SELECT *, {q_breaks(q_game(q_percent('src')))} AS s1, {q_breaks(q_game(q_percent('tgt')))} AS t1 FROM p),
c AS (SELECT *, {q_spaces('s1')} AS s2, {q_spaces('t1')} AS t2 FROM b) SELECT file_id, tu_index, s2 AS clean_src, t2 AS clean_tgt, {q_reason(q_strip('s2'), q_strip('t2'))} AS remove_reason FROM c""")
def cleanup_all_rules(spark, sf_dir):
    done = clean_pairs(xml_pairs(spark, sf_dir), Options(remove_line_breaks=True, remove_percent_wrapped_tokens=True))
    return done.select("file_id", "tu_index", "clean_src", "clean_tgt", "remove_reason")

