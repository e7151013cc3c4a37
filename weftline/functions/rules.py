"""Cleanup, garbage and warning rules as column expressions over segments and their plain texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars
from .chars import ALNUM, DIGIT, LETTER, SCRIPT_OF_LANGUAGE, SCRIPTS, WS, either
from .segments import collapse_ws, let, map_text, strip_ws, trim_ends

#: Stands for a break until white space round it is gone; XML text has no such character.
_BREAK = "\u0001"


def normalize_spaces(xml: Column) -> Column:
    """Plain spaces only: runs to one within each text run, none at the segment's ends."""
    return trim_ends(map_text(xml, lambda t: F.regexp_replace(t, " {2,}", " ")))


def _then_spaces(xml: Column, change) -> Column:
    """``change`` over text runs; spaces are normalised if it changed anything."""
    return let(xml, lambda x: let(map_text(x, change), lambda y: F.when(y == x, x).otherwise(normalize_spaces(y))))


def _where(test, change):
    """``change`` for texts that pass a cheap test; the others are left as they are."""
    return lambda xml: let(xml, lambda x: F.when(test(x), change(x)).otherwise(x))


def _one_line(text: Column) -> Column:
    """Control breaks and two-character escapes for them, marked first; then a mark and all white space round it is one space."""
    marked = F.regexp_replace(text, r"[\t\n\x0B\f\r]|\\[tnrfv]", _BREAK)
    return F.regexp_replace(marked, f"[{WS}]*{_BREAK}[{WS}{_BREAK}]*", " ")


def collapse_line_breaks(xml: Column) -> Column:
    """Control breaks and literal escapes for them, with white space round them, to one space."""
    return _where(lambda x: x.rlike(r"[\t-\r\\]"), lambda x: _then_spaces(x, _one_line))(xml)


def strip_percent_tokens(xml: Column) -> Column:
    return _where(lambda x: x.contains("%"), lambda x: _then_spaces(x, lambda t: F.regexp_replace(t, chars.PERCENT_TOKEN, " ")))(xml)


def _markup(text: Column, tags: tuple[str, ...]) -> Column:
    for form in (chars.CARET_TOKEN, *tags):
        text = F.regexp_replace(text, form, " ")
    return F.regexp_replace(text, chars.VARIANT, "$1")


def strip_game_markup(xml: Column) -> Column:
    """Caret tokens and escaped colour tags to a space, variants to their first form."""
    return _where(lambda x: x.contains("^{") | x.contains("$") | x.contains("&"), lambda x: _then_spaces(x, lambda t: _markup(t, (chars.ESCAPED_COLOUR,))))(xml)


def clean_property(text: Column, game: bool = True, percent: bool = False) -> Column:
    """Service markup out of a property's text, raw colour tags included."""
    out = _markup(text, (chars.BARE_COLOUR, chars.ESCAPED_COLOUR)) if game else text
    if percent:
        out = F.regexp_replace(out, chars.PERCENT_TOKEN, " ")
    return let(out, lambda o: F.when(o == text, text).otherwise(F.trim(F.regexp_replace(o, " {2,}", " "))))


def is_empty(text: Column) -> Column:
    """Nothing but white space, punctuation and symbols."""
    return text.rlike(rf"^[{WS}\p{{P}}\p{{S}}]*$")


def is_numeric(text: Column) -> Column:
    """At least one digit, and no letter or number that isn't one."""
    return ~text.rlike(rf"[{ALNUM}&&[^{DIGIT}]]") & text.rlike(f"[{DIGIT}]")  # most texts begin with a letter


def _is_link_word(word: Column) -> Column:
    """A URL, or labels of letters, digits and hyphens with dots between, the last of two letters or more, and maybe a path."""
    host = F.split(word, "/")[0]
    labels = F.split(host, r"\.")
    last = F.element_at(labels, -1)
    domain = (F.size(labels) > 1) & F.forall(labels, lambda x: x.rlike("^[A-Za-z0-9-]+$")) & last.rlike("^[A-Za-z]{2,}$")
    low = F.lower(word)
    url = F.lit(False)
    for start in chars.URL_START:
        url = url | (low.startswith(start) & (F.length(word) > len(start)))
    return url | domain


def is_link(text: Column) -> Column:
    """Every word, without punctuation round it, is a URL or a bare domain."""
    edge = either(chars.LINK_MARKS)
    bare = lambda w: F.regexp_replace(w, f"^{edge}+|{edge}+$", "")
    is_one = lambda w: let(bare(w), _is_link_word)
    first = lambda t: F.regexp_extract(strip_ws(t), f"^[^{WS}]*", 0)  # noqa: E731  most texts' first word is none
    every = lambda t: F.when(is_one(first(t)), F.forall(F.split(collapse_ws(t), " "), is_one)).otherwise(F.lit(False))
    return let(text, lambda t: F.when(t.contains(".") | t.contains("/"), every(t)).otherwise(F.lit(False)))


def garbage_reason(src: Column, tgt: Column) -> Column:
    """Why a pair of plain texts is removed, or null."""
    either = lambda p, test: test(p["s"]) | test(p["t"])
    reason = lambda p: F.when(either(p, is_empty), "empty_source_or_target").when(either(p, is_numeric), "numeric_only_side").when(either(p, is_link), "link_only_side")
    return let(F.struct(strip_ws(src).alias("s"), strip_ws(tgt).alias("t")), reason)


def normalize_lang(lang: Column) -> Column:
    return F.lower(F.replace(F.trim(lang), F.lit("_"), F.lit("-")))


def base_lang(lang: Column) -> Column:
    return F.substring_index(normalize_lang(lang), "-", 1)


def count_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def has_at_least(text: Column, characters: str, n: int) -> Column:
    """Whether this many characters of the class stand anywhere; looks no further than that."""
    return text.rlike(f"(?:[{characters}][^{characters}]*+){{{n}}}")


@lru_cache(1)
def _kinds() -> bytes:
    """For each code point which of the counted classes it is in, as the JVM's regular expressions tell: packed, since tasks get it."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    pattern = SparkContext._active_spark_context._jvm.java.util.regex.Pattern
    table = np.zeros(0x110000, np.uint16)
    for k, own in enumerate(_COUNTED.values()):
        members = pattern.compile(f"[^{own}]+").matcher(every).replaceAll("")
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] |= 1 << k
    return zlib.compress(table.tobytes())


@lru_cache(1)
def _table(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point's set of classes, and the classes of each number."""
    sets, which = np.unique(np.frombuffer(zlib.decompress(packed), np.uint16), return_inverse=True)
    return which.astype(np.uint8), (sets[:, None] >> np.arange(len(_COUNTED)) & 1).astype(np.int64)


#: What is counted: letters, digits and each script.
_COUNTED = {"alpha": r"\p{L}", "digit": DIGIT} | SCRIPTS


def script_histogram(text: Column) -> Column:
    """Struct of counts: letters, digits and each tracked script. Characters are looked up in a table, each once."""
    packed = _kinds()

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        number, classes = _table(packed)
        for texts in batches:
            counts = np.zeros((len(texts), len(_COUNTED)), np.int64)
            missing = texts.isna().to_numpy()
            for k, t in enumerate(texts):
                if t:
                    points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                    counts[k] = np.bincount(number[points], minlength=len(classes)) @ classes
            frame = pd.DataFrame(counts, columns=list(_COUNTED)).astype("Int32")
            frame[missing] = pd.NA
            yield frame

    return F.pandas_udf(count, ", ".join(f"{name} int" for name in _COUNTED))(text)


def expected_script(lang: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SCRIPT_OF_LANGUAGE.items() for x in pair])
    return F.coalesce(F.element_at(known, base_lang(lang)), F.lit("latin"))


def lang_mismatch(text: Column, lang: Column) -> Column:
    """True if none of the language's script but three letters or more of others are there."""

    def judge(x):
        found = F.lit(False)
        for name, own in SCRIPTS.items():
            others = "".join(c for n, c in SCRIPTS.items() if n != name)
            found = F.when(x["expected"] == name, ~x["text"].rlike(f"[{own}]") & has_at_least(x["text"], others, 3) & has_at_least(x["text"], r"\p{L}", 3)).otherwise(found)
        return found

    found = let(F.struct(text.alias("text"), expected_script(lang).alias("expected")), judge)
    return F.coalesce((base_lang(lang) != "") & found, F.lit(False))


def length_ratio(src: Column, tgt: Column) -> Column:
    """Target's by source's letters and numbers where both are long enough to tell, else null."""
    sizes = F.struct(count_of(src, ALNUM).alias("a"), count_of(tgt, ALNUM).alias("b"))
    return let(sizes, lambda x: F.when((x["a"] >= 6) & (x["b"] >= 2), x["b"] / x["a"]))


def is_anomalous(ratio: Column) -> Column:
    return F.coalesce((ratio < 0.35) | (ratio > 2.8), F.lit(False))


def length_anomaly(src: Column, tgt: Column) -> Column:
    return let(length_ratio(src, tgt), is_anomalous)


def fold(text: Column) -> Column:
    """Case folding, near enough: also tells ß and ss alike."""
    return F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss"))


def _begin_apart(a: Column, b: Column) -> Column:
    """Whether two texts begin with different ASCII letters or digits, case aside: then they differ, and need not be folded."""
    first = lambda t: F.lower(F.left(strip_ws(t), F.lit(1)))
    return let(F.struct(first(a).alias("a"), first(b).alias("b")), lambda x: (x["a"] != x["b"]) & x["a"].rlike("^[a-z0-9]$") & x["b"].rlike("^[a-z0-9]$"))


def is_identical(src: Column, tgt: Column, src_lang: Column, tgt_lang: Column) -> Column:
    """Equal texts in different languages that hold a letter."""
    x, y = base_lang(src_lang), base_lang(tgt_lang)
    same = ~_begin_apart(src, tgt) & (fold(collapse_ws(src)) == fold(collapse_ws(tgt))) & src.rlike(r"\p{L}")
    return F.coalesce((x != "") & (y != "") & (x != y) & same, F.lit(False))


def warnings(src: Column, tgt: Column, src_lang: Column, tgt_lang: Column) -> Column:
    """Array of struct(rule, severity, message) for a pair of plain texts."""
    warn = lambda rule, message: F.struct(F.lit(rule).alias("rule"), F.lit("WARN").alias("severity"), message.alias("message"))
    script = lambda lang: F.concat(F.lit("Letters of another script than that of "), lang)
    ratio = let(length_ratio(src, tgt), lambda r: F.when(is_anomalous(r), warn("length_anomaly", F.format_string("Target is %.2f times as long as source", r))))
    return F.array_compact(F.array(
        ratio,
        F.when(lang_mismatch(src, src_lang), warn("lang_mismatch_source", script(src_lang))),
        F.when(lang_mismatch(tgt, tgt_lang), warn("lang_mismatch_target", script(tgt_lang))),
        F.when(is_identical(src, tgt, src_lang, tgt_lang), warn("identical_source_target", F.lit("Source and target are the same text"))),
    ))
