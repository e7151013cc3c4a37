"""Previews and differences of texts.

Differences are Python functions over Arrow batches. Their arguments must be columns that are computed
already (``plans.storage.settled``): rules are lambda expressions, which Spark cannot put under a Python function.
"""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import collapse_ws

MOST_CHARS = 20_000
_RUN = [T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]
SEGMENTS = T.ArrayType(T.StructType(_RUN))
LINES = T.ArrayType(T.StructType([*_RUN, T.StructField("runs", SEGMENTS)]))


def preview(text: Column, limit: int = 180) -> Column:
    """White space collapsed, cut with dots to the limit."""
    flat = collapse_ws(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def clip(text: Column, limit: int = 8000) -> Column:
    """First and last half of a long text, with a mark of what was left out."""
    half = limit // 2
    cut = F.concat(F.substring(text, 1, half), F.lit("\n[...]\n"), F.substring(text, -half, half))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def visible_text(text: Column, show_spaces: bool = False) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.replace(text, F.lit(" "), F.lit("·")) if show_spaces else text


def space_delta(before: Column, after: Column) -> Column:
    """Struct: plain spaces before and after."""
    spaces = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.struct(spaces(before).alias("before"), spaces(after).alias("after"))


def _clip(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most // 2] + " … " + text[-(most // 2) :]


def segments_of(before: str, after: str, by_token: bool = False) -> list[dict]:
    """Runs of equal, deleted and added text; tokens are words, runs of space and single other characters."""
    before, after = before or "", after or ""
    if not before or not after:
        return [{"kind": k, "text": t} for k, t in (("delete", before), ("insert", after)) if t]
    a, b = (re.findall(r"\w+|\s+|[^\w\s]", t) if by_token else t for t in (before, after))
    out: list[dict] = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        runs = [("equal", a[i:j])] if op == "equal" else [("delete", a[i:j]), ("insert", b[k:m])]
        for kind, run in runs:
            if run and out and out[-1]["kind"] == kind:
                out[-1]["text"] += "".join(run)
            elif run:
                out.append({"kind": kind, "text": "".join(run)})
    return out


def diff_segments(by_token: bool = False):
    """A function of two columns: the difference of the whole texts as an array of runs."""

    @F.pandas_udf(SEGMENTS)
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([segments_of(x, y, by_token) for x, y in zip(before, after, strict=True)])

    return run


def inline_html(segments: list[dict]) -> str:
    tag = {"equal": "{}", "delete": "<del>{}</del>", "insert": "<ins>{}</ins>"}
    return "".join(tag[s["kind"]].format(html.escape(s["text"])) for s in segments)


def inline_diff(most: int = MOST_CHARS):
    """A function of two columns: their difference as HTML with ``del`` and ``ins``."""

    @F.pandas_udf(T.StringType())
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([inline_html(segments_of(_clip(x or "", most), _clip(y or "", most))) for x, y in zip(before, after, strict=True)])

    return run


def line_diff(before: str, after: str) -> list[dict]:
    """Lines equal, deleted, added, or changed; changed lines carry their own runs."""
    a, b = (before or "").splitlines(), (after or "").splitlines()
    out: list[dict] = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        pairs = min(j - i, m - k) if op == "replace" else 0
        out += [{"kind": "equal", "text": x, "runs": []} for x in a[i:j]] if op == "equal" else []
        out += [{"kind": "change", "text": b[k + x], "runs": segments_of(a[i + x], b[k + x], True)} for x in range(pairs)]
        if op != "equal":
            out += [{"kind": "delete", "text": x, "runs": []} for x in a[i + pairs : j]]
            out += [{"kind": "insert", "text": x, "runs": []} for x in b[k + pairs : m]]
    return out


@F.pandas_udf(LINES)
def diff_lines(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([line_diff(x, y) for x, y in zip(before, after, strict=True)])
