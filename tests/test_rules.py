"""Cleanup, garbage and warning rules on known pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import chars, rules, segments, split
from weftline.plans.cleanup import Options, clean_pairs

OFF = dict(normalize_spaces=False, remove_game_markup=False, remove_garbage_segments=False, emit_warnings=False)
PAIR = "src_xml string, tgt_xml string, src_lang string, tgt_lang string"


def clean(spark, src, tgt="Некоторый текст", langs=("en-US", "ru-RU"), **options):
    return clean_pairs(spark.createDataFrame([(src, tgt, *langs)], PAIR), Options(**(OFF | options))).first()


def one(spark, rule, text):
    return spark.createDataFrame([(text,)], "x string").select(rule(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("rule", "text", "want"), [
    (rules.normalize_spaces, "  Hello    world\t\n", "Hello   world\t\n"),
    (rules.normalize_spaces, '  One  <ph x="a  b"/>  two  ', 'One <ph x="a  b"/> two'),
    (rules.normalize_spaces, '<ph x="1"/>  two  <ph x="2"/>', '<ph x="1"/>two<ph x="2"/>'),
    (rules.collapse_line_breaks, "Hero\nWars", "Hero Wars"),
    (rules.collapse_line_breaks, "Привет\n\n\tмир", "Привет мир"),
    (rules.collapse_line_breaks, "THE ESSENTIAL PRACTICES\\t7", "THE ESSENTIAL PRACTICES 7"),
    (rules.collapse_line_breaks, 'One<ph x="1"/>\n\tTwo\n', 'One<ph x="1"/> Two'),
    (rules.strip_game_markup, "Manual$m(s|s)", "Manuals"),
    (rules.strip_game_markup, "Durability: ^{85 221 85}^%param%%^{/color}^", "Durability: %param%%"),
    (rules.strip_game_markup, "&lt;Color=#51D052FF&gt;%param1%%&lt;/Color&gt;", "%param1%%"),
    (rules.strip_game_markup, "&amp;lt;Color=#51D052FF&amp;gt;x&amp;lt;/Color&amp;gt;", "x"),
    (rules.strip_percent_tokens, "Get %paramFloor%% bonus, crit 100%.", "Get bonus, crit 100%."),
    (rules.strip_percent_tokens, "% not a token % и 100%.", "% not a token % и 100%."),
    (rules.clean_property, "<Color=#fff>a</Color>  b ^{x}^", "a b"),
    (segments.plain_text, "a &lt;b&gt; <ph/>&#233;&#x1F600; &amp;amp; c", "a <b> é😀 &amp; c"),
    (segments.export_text, 'a\r\n<bpt i="1" t="x &amp; y">b</bpt><br/>', "a\n{bpt: i=1, t=x & y}b{br}"),
])
def test_text_rules(spark, rule, text, want):
    assert one(spark, rule, text) == want


def test_percent_then_game_then_spaces(spark):
    text = "года.%CR%Кожа нежным%X%увлажненной.  Готово^{cr}^ сейчас"
    got = clean(spark, text, "x", remove_percent_wrapped_tokens=True, remove_game_markup=True, normalize_spaces=True)
    assert got.clean_src == "года. Кожа нежным увлажненной. Готово сейчас"
    assert [a.rule for a in got.actions] == ["remove_percent_wrapped_tokens", "remove_game_markup"]


@pytest.mark.parametrize(("text", "want"), [
    ('One!<ph x="1" type="0"/>Two.', "One! Two."),
    ('co<ph x="1"/>operate', "cooperate"),
    ('Rock &amp; Roll<ph x="1"/>Night', "Rock &amp; Roll Night"),
    ('Title<ph x="1"/>Body', "Title Body"),
    ('<bpt i="1">&lt;rpr id="5"&gt;</bpt>Press Release<ept i="1">&lt;/rpr&gt;</ept>', "Press Release"),
    ('"<ph/>Quoted<ph/>"', '"Quoted"'),
    ("broken <b", "broken <b"),
])
def test_inline_tags(spark, text, want):
    assert one(spark, lambda c: split.drop_inline_tags(c), text) == want


@pytest.mark.parametrize(("src", "tgt", "reason"), [
    ("Need translation now.", '<ph id="1"/> !!!', "empty_source_or_target"),
    ('<ph id="1"/>', "text here", "empty_source_or_target"),
    ("12345", "text", "numeric_only_side"), ("²", "text", "numeric_only_side"), ("1a", "text", None),
    ("https://example.com/docs/setup", "text", "link_only_side"), ("see file.txt", "text", None), ("(file.txt)", "text", "link_only_side"),
    ("‍", "text", None), ("✨️", "text", None), ("✨ …", "text", "empty_source_or_target"),
])
def test_garbage(spark, src, tgt, reason):
    got = clean(spark, src, tgt, remove_garbage_segments=True)
    assert got.remove_reason == reason
    assert [a.rule for a in got.actions] == (["remove_garbage_segment"] if reason else [])


@pytest.mark.parametrize(("src", "tgt", "langs", "want"), [
    ("Save changes now", "Save changes now", ("en-US", "de-DE"), ["identical_source_target"]),
    ("STRASSE", "straße", ("en", "de"), ["identical_source_target"]),
    ("A very long source sentence indeed, you see.", "Коротко.", ("en-US", "ru-RU"), ["length_anomaly"]),
    ("Привет мир друзья", "Hello world friends", ("en-US", "ru-RU"), ["lang_mismatch_source", "lang_mismatch_target"]),
    ("漢字文章漢字文章", "漢字文章漢字文", ("en-US", "ru-RU"), ["lang_mismatch_source", "lang_mismatch_target"]),
    ("Latin letters", "Latin letterz", ("el-GR", "ar-SA"), ["lang_mismatch_source", "lang_mismatch_target"]),
    ("Καλημέρα κόσμε", "مرحبا بالعالم", ("el-GR", "ar-SA"), []),
    ("Hello", "Привет", ("en", "ru_RU"), []),
])
def test_warnings(spark, src, tgt, langs, want):
    assert [w.rule for w in clean(spark, src, tgt, langs, emit_warnings=True).warnings] == want


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(None, None, None, None, 1), ("", "", "", "", 2)], PAIR + ", warnings_of int")
    got = clean_pairs(df, Options(remove_line_breaks=True, remove_percent_wrapped_tokens=True, remove_inline_tags=True)).collect()
    assert got[1].remove_reason == "empty_source_or_target" and got[0].warnings_of == 1


def test_garbage_and_identity_are_told_without_reading_most_texts_through(spark):
    texts = ["İx", "ix", "i\u0307x", "Kelvin", "\u212aelvin", "ſs", "ß", "SS", "ss a", " SS\u00a0 a ", "1 a", "²³", "12 ٣", "12a", "www.a.org b.de/x", "b.de (www.x)", "b.de x", "x b.de", " ", "", ".", None, "Σας", "ΣΑΣ"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    whole = (rules.fold(segments.collapse_ws(a)) == rules.fold(segments.collapse_ws(b))) & a.rlike(r"\p{L}")
    rows = df.select("a", "b", rules.is_identical(a, b, F.lit("en"), F.lit("de")).alias("got"), F.coalesce(whole, F.lit(False)).alias("want"), rules.is_numeric(a).alias("n"), rules.is_link(a).alias("l")).collect()
    assert [r for r in rows if r.got != r.want] == [] and any(r.got and r.a != r.b for r in rows)
    assert {r.a for r in rows if r.n} == {"²³", "12 ٣"} and {r.a for r in rows if r.l} == {"www.a.org b.de/x", "b.de (www.x)"}
    long = spark.range(1).select(F.concat(F.lit("word "), F.repeat(F.lit("more words. "), 5_000_000)).alias("t"))
    began = time.time()
    assert long.select(rules.is_numeric(F.col("t")).alias("n"), rules.is_link(F.col("t")).alias("l")).first() == (False, False)
    assert time.time() - began < 10  # to split it into words takes longer, and gigabytes


def test_script_histogram_counts_as_the_expressions_do_in_one_look_at_a_character(spark):
    rng = random.Random(3)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(chr(c),) for c in [*range(1, 0x1200), *rng.sample(points, 5000)]] + [("".join(map(chr, rng.choices(points, k=60))),) for _ in range(50)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    classes = {"alpha": r"\p{L}", "digit": chars.DIGIT} | chars.SCRIPTS
    got = df.select("t", rules.script_histogram(F.col("t")).alias("h"), F.struct(*(rules.count_of(F.col("t"), c).alias(n) for n, c in classes.items())).alias("w"))
    assert [r for r in got.collect() if r.t is not None and r.h != r.w or r.t is None and any(x is not None for x in r.h)] == []
    with_table = got.select("h")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in with_table
