"""Split verification: prompts, responses, verdicts, cost. The verifier itself is a pluggable callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Price of a million tokens, in and out.
PRICE_IN, PRICE_OUT = 0.10, 0.40
VERDICTS = ("OK", "WARN", "FAIL")
# Names of a template's places, filled in this order.
_FIELDS = ("SRC_LANG", "TGT_LANG", "ORIGINAL_SRC", "ORIGINAL_TGT", "SRC_PARTS_JSON", "TGT_PARTS_JSON", "SPLIT_PAIRS_JSON", "AUTO_CONTEXT_JSON", "PAIR_COUNT")
# Words in the names of models that do not judge text.
NOT_TEXT = ("image", "imagen", "banana", "nano", "veo", "video", "vision", "tts", "audio", "speech", "voice", "embedding", "embed", "aqa", "live")
#: What an answer says that never came.
_FAILED = ("request failed", "http error")
TEMPLATE = """Check whether these parts of a {SRC_LANG} text and of its {TGT_LANG} translation belong together, pair by pair.
Answer with JSON: {"verdict": "OK" | "WARN" | "FAIL", "issues": [...], "summary": "..."}.

Pairs: {PAIR_COUNT}
{SPLIT_PAIRS_JSON}

Source: {ORIGINAL_SRC}
Target: {ORIGINAL_TGT}"""
ENVELOPE = "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>, usageMetadata struct<promptTokenCount: bigint, candidatesTokenCount: bigint, totalTokenCount: bigint>"
ANSWER = "verdict string, issues array<struct<severity: string, type: string, message: string, src_index: bigint, tgt_index: bigint, suggestion: string>>, summary string"


def render_prompt(template: Column, src_lang: Column, tgt_lang: Column, src: Column, tgt: Column, src_parts: Column, tgt_parts: Column) -> Column:
    """The template with its places filled from a split; a template without a place for the whole context gets it at its end."""
    pairs = F.transform(F.arrays_zip(src_parts.alias("src"), tgt_parts.alias("tgt")), lambda p: F.struct(p["src"].alias("src"), p["tgt"].alias("tgt")))
    context = F.struct(src_lang.alias("src_lang"), tgt_lang.alias("tgt_lang"), F.struct(src.alias("src"), tgt.alias("tgt")).alias("original"), pairs.alias("split_pairs"))
    values = (src_lang, tgt_lang, src, tgt, F.to_json(src_parts), F.to_json(tgt_parts), F.to_json(pairs), F.to_json(context), F.size(src_parts).cast("string"))
    place = "{AUTO_CONTEXT_JSON}"
    text = F.when(template.contains(place), template).otherwise(F.concat(template, F.lit(f"\n\nAuto context JSON:\n{place}")))
    for name, value in zip(_FIELDS, values, strict=True):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.trim(text)


def lenient_json(text: Column) -> Column:
    """The text if it is a JSON object, else that within a code fence, else from the first to the last brace."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull() & F.trim(t).startswith("{"), t)
    return F.coalesce(ok(text), ok(fenced), ok(braces))


def normalize_verdict(verdict: Column) -> Column:
    up = F.upper(F.trim(verdict))
    return F.when(up.isin(*VERDICTS), up).otherwise("WARN")


def parse_response(body: Column) -> Column:
    """Struct: verdict, summary, issues, prompt_tokens, candidate_tokens, total_tokens of a response's JSON."""
    outer = F.from_json(body, ENVELOPE)
    text = F.array_join(F.transform(outer["candidates"][0]["content"]["parts"], lambda p: p["text"]), "")
    answer = F.from_json(lenient_json(text), ANSWER)
    usage = outer["usageMetadata"]
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return F.struct(
        normalize_verdict(answer["verdict"]).alias("verdict"),
        F.coalesce(answer["summary"], F.when(F.coalesce(text, F.lit("")) == "", "no candidate text"), F.lit("")).alias("summary"),
        F.coalesce(answer["issues"], F.array().cast("array<struct<severity: string, type: string, message: string, src_index: bigint, tgt_index: bigint, suggestion: string>>")).alias("issues"),
        n(usage["promptTokenCount"]).alias("prompt_tokens"),
        n(usage["candidatesTokenCount"]).alias("candidate_tokens"),
        F.coalesce(usage["totalTokenCount"], n(usage["promptTokenCount"]) + n(usage["candidatesTokenCount"])).alias("total_tokens"),
    )


def is_unavailable(verdict: Column, summary: Column, messages: Column | None = None) -> Column:
    """A WARN that only says that no answer came, in its summary or in an issue's message (an array of texts)."""
    says = lambda text, words: F.exists(F.lit(list(words)), lambda w: F.lower(F.coalesce(text, F.lit(""))).contains(w))
    out = says(summary, (*_FAILED, "no candidate text"))
    if messages is not None:
        out = out | F.coalesce(F.exists(messages, lambda m: says(m, _FAILED)), F.lit(False))
    return (verdict == "WARN") & out


def cost(tokens_in: Column, tokens_out: Column, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    return F.greatest(tokens_in, F.lit(0)) / 1e6 * price_in + F.greatest(tokens_out, F.lit(0)) / 1e6 * price_out


def model_version(name: Column) -> Column:
    return F.regexp_extract(name, r"^(?:models/)?gemini-([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def pick_models(models: DataFrame, least: float = 3.0) -> DataFrame:
    """Models that generate text, from this version on, newest first. models: name, methods (array)."""
    bare = F.regexp_replace("name", "^models/", "")
    other = F.exists(F.lit(list(NOT_TEXT)), lambda w: F.lower(bare).contains(w))
    kept = models.where(bare.startswith("gemini-") & F.array_contains("methods", "generateContent") & ~other)
    return kept.select(bare.alias("name"), model_version(bare).alias("version")).where(F.col("version") >= least).distinct().orderBy(F.desc("version"), "name")


def list_models(spark: SparkSession, fetch: Callable[[str | None], dict]) -> DataFrame:
    """name, methods of all pages. fetch gives a page by its token: {"models": [{"name", "supportedGenerationMethods"}], "nextPageToken"}; a token that comes again ends the list."""
    rows, token, seen = [], None, set()
    while token not in seen:
        seen.add(token)
        page = fetch(token)
        rows += [(m.get("name", ""), [*m.get("supportedGenerationMethods", ())]) for m in page.get("models", ())]
        token = page.get("nextPageToken") or None
        if token is None:
            break
    return spark.createDataFrame(rows, "name string, methods array<string>")


CACHE_KEY = ("src_lang", "tgt_lang", "src_text", "tgt_text", "src_parts", "tgt_parts", "model")


def cache_key(columns: dict[str, Column]) -> Column:
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(CACHE_KEY)])), 256)


def verify(candidates: DataFrame, verifier: Callable[[dict], dict], parallel: int = 4) -> DataFrame:
    """candidates (key, prompt and any columns) with verdict, summary, issues' messages and token counts of the verifier's answer.

    Distinct keys only should be given: each row is one call. ``parallel`` calls are in flight in a
    partition. A call that raises is a WARN with the summary "request failed".
    """
    extra = "verdict string, summary string, messages array<string>, prompt_tokens long, candidate_tokens long"

    def call(row: dict) -> dict:
        try:
            got = verifier(row)
        except Exception as error:  # noqa: BLE001  a verifier may raise anything
            got = {"verdict": "WARN", "summary": f"request failed: {type(error).__name__}"}
        verdict = str(got.get("verdict", "")).upper()
        return {"verdict": verdict if verdict in VERDICTS else "WARN", "summary": got.get("summary") or "", "messages": [str(i.get("message") or "") for i in got.get("issues") or ()], "prompt_tokens": int(got.get("prompt_tokens") or 0), "candidate_tokens": int(got.get("candidate_tokens") or 0)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for batch in batches:
                made = pd.DataFrame(list(pool.map(call, batch.to_dict("records"))), columns=["verdict", "summary", "messages", "prompt_tokens", "candidate_tokens"])
                yield pd.concat([batch.reset_index(drop=True), made], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in candidates.dtypes) + ", " + extra
    return candidates.mapInPandas(run, schema)
