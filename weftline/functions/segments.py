"""Segments: inner XML (escaped text and inline tags) and its plain text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WHITE, WS

#: A tag, a run of text, or a stray bracket.
_PART = r"(<[^>]+>|[^<]+|<)"
_REFERENCE = r"(&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|[^&]+|&)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: keeps nested rules' expressions from multiplying."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_tag(part: Column) -> Column:
    return part.startswith("<") & part.endswith(">")


def parts(xml: Column) -> Column:
    """Array of tags and text runs, in order."""
    return F.regexp_extract_all(xml, F.lit(_PART), F.lit(1))


def map_text(xml: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` over the text runs; tags stay as they are."""
    tagged = lambda x: F.array_join(F.transform(parts(x), lambda p: F.when(is_tag(p), p).otherwise(change(p))), "")
    return let(xml, lambda x: F.when(x.contains("<"), tagged(x)).otherwise(change(x)))


def trim_ends(xml: Column) -> Column:
    """Plain spaces off the start of the first and the end of the last text run, also next to a tag."""

    def cut(runs):
        texts = F.transform(runs, lambda p: ~is_tag(p))
        ends = F.struct((F.array_position(texts, F.lit(True)) - 1).alias("first"), (F.size(runs) - F.array_position(F.reverse(texts), F.lit(True))).alias("last"))
        one = lambda p, i, e: F.when((i == e["first"]) & (i == e["last"]), F.trim(p)).when(i == e["first"], F.ltrim(p)).when(i == e["last"], F.rtrim(p)).otherwise(p)
        return let(ends, lambda e: F.array_join(F.transform(runs, lambda p, i: F.when(is_tag(p), p).otherwise(one(p, i, e))), ""))

    return let(xml, lambda x: F.when(x.contains("<"), let(parts(x), cut)).otherwise(F.trim(x)))


def unescape(text: Column) -> Column:
    """The five XML entities and numeric references."""
    code = lambda r: F.when(r.rlike("^&#[xX]"), F.regexp_extract(r, "([0-9A-Fa-f]+);$", 1)).otherwise(F.conv(F.regexp_extract(r, "([0-9]+);$", 1), 10, 16))
    one = lambda r: F.when(r.rlike("^&#[xX]?[0-9A-Fa-f]+;$"), F.decode(F.unhex(F.lpad(code(r), 8, "0")), "UTF-32")).otherwise(r)
    numeric = lambda t: F.when(t.contains("&#"), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(1)), one), "")).otherwise(t)

    def named(t):
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    return let(text, lambda t: F.when(t.contains("&"), named(numeric(t))).otherwise(t))


def escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def strip_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def collapse_ws(text: Column) -> Column:
    """Runs of any white space to one space, none at the ends."""
    return strip_ws(F.regexp_replace(text, rf"[{WS}]+", " "))


def plain_text(xml: Column) -> Column:
    """Text of a segment, that of inline elements included."""
    return unescape(F.regexp_replace(xml, "<[^>]*>", ""))


def probe_text(xml: Column) -> Column:
    """A quick look at a segment's text: tags off, references resolved; null where CDATA would need a parser."""
    return F.when(~xml.contains("<![CDATA["), plain_text(xml))


def export_text(xml: Column) -> Column:
    """Text for tables: CRLF to LF, a tag as {name: key=value, key=value} before its text."""

    def one(p):
        name = F.regexp_extract(p, r"^</?([^\s/>]+)", 1)
        attrs = F.regexp_extract_all(p, F.lit(r'([^\s=<>/]+\s*=\s*(?:"[^"]*"|\'[^\']*\'))'), F.lit(1))
        pairs = F.array_join(F.transform(attrs, lambda a: F.concat(F.regexp_extract(a, r"^([^\s=]+)", 1), F.lit("="), unescape(F.regexp_extract(a, r"""["'](.*)["']$""", 1)))), ", ")
        shown = F.when(p.startswith("</"), "").otherwise(F.concat(F.lit("{"), name, F.when(F.size(attrs) > 0, F.concat(F.lit(": "), pairs)).otherwise(""), F.lit("}")))
        return F.when(is_tag(p), shown).otherwise(unescape(p))

    text = let(xml, lambda x: F.when(x.contains("<"), F.array_join(F.transform(parts(x), one), "")).otherwise(unescape(x)))
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))
