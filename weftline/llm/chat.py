"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

Events are messages, calls or results. Calls and results are hash-joined by conversation and
call identifier. A call may depend on another call; calls are ordered topologically by
their depth below a call that depends on none, found by pointer doubling: a round joins
every call to the call its pointer shows and adds up depths, so rounds grow with the
logarithm of the longest chain, and no conversation is gathered. Arguments are parsed to
variants, checked against the tool's schema, and written with sorted keys and no spaces.

Only DataFrame functions are used. Joins are hash joins on (conversation, identifier), built
from the side with one row a key, so a hot conversation is spread out, and a hot identifier
is left to the run-time split of skewed joins.

Defined results: one row an event. A call identifier used by several calls belongs to the
first (by turn, then text); its repetitions are calls of their own that have no results and
the error ``duplicate_id``. Results without a call have no level and the error
``no_call``. A dependency that is not there is an error (``no_dependency``) and the call is
a root; calls on or below a cycle have no level and the error ``cycle``. Null identifiers
link to nothing. JSON leaves null fields out; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, table, written

EVENT = "conv_id long, turn long, role string, kind string, call_id string, name string, arguments string, depends_on string, content string"
#: For each tool its arguments: (type, required) or (type, required, limits). Types: string, integer, number, boolean,
#: object, array. Limits: max_length of strings, minimum and maximum of numbers, among (a list of values).
REPLY_TOOLS = {"reply": {"prompt": ("string", True, {"max_length": 300}), "turn": ("integer", True, {"minimum": 0})}}
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def _beyond(value: Column, arg: str, kind: str, limits: dict | None = None) -> Column:
    """Whether an argument of the right type breaks a limit."""
    limits = limits or {}
    get = F.try_variant_get(value, f"$.{arg}", {"integer": "bigint", "number": "double"}.get(kind, "string"))
    rules = {"max_length": lambda x: F.length(get) > x, "minimum": lambda x: get < x, "maximum": lambda x: get > x, "among": lambda x: ~get.isin(*x)}
    out = F.lit(False)
    for name, bound in limits.items():
        out = out | rules[name](bound)
    return F.coalesce(out, F.lit(False))


def _hash_join(many: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a hash table of ``one``, which has a row a key."""
    return many.join(one.hint("shuffle_hash"), on, "left")


def argument_errors(name: Column, arguments: Column, tools: dict) -> Column:
    """Sorted array of what is wrong with a call's arguments."""
    value = F.try_parse_json(arguments)
    checks = []
    for tool, spec in tools.items():
        own = [F.when(F.coalesce(F.size(F.array_except(F.json_object_keys(arguments), F.lit(list(spec)))) > 0, F.lit(False)), F.lit("unknown_argument"))]
        for arg, (kind, required, *limits) in spec.items():
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{arg}", "variant"))
            absent = got.isNull() | (got == "VOID")
            own.append(F.when(absent, F.lit(f"missing:{arg}") if required else F.lit(None)).when(~got.rlike(f"^({_TYPES[kind]})$"), F.lit(f"type:{arg}")).when(_beyond(value, arg, kind, *limits), F.lit(f"limit:{arg}")))
        checks.append(F.when(name == tool, F.array_compact(F.array(*own))))
    bad = F.when(value.isNull() | ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), F.array(F.lit("not_an_object")))
    return F.array_sort(F.coalesce(bad, *checks, F.array(F.lit("unknown_tool"))))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (null on or below a cycle), found (whether its dependency exists). calls: conv_id, call_id, depends_on; one row an identifier."""
    known = calls.select("conv_id", F.col("call_id").alias("depends_on"), F.lit(True).alias("found"))
    now = _hash_join(calls, known, ["conv_id", "depends_on"]).select("conv_id", "call_id", F.when(F.col("found"), F.col("depends_on")).alias("at"), F.when(F.col("found"), 1).otherwise(0).cast("long").alias("level"), F.coalesce("found", F.col("depends_on").isNull()).alias("found"))
    now = written(now, "levels")
    total = now.count()
    for _ in range(max(total, 1).bit_length() + 1):  # after these, who still points somewhere is on or below a cycle
        if now.where("at IS NOT NULL").isEmpty():
            break
        up = now.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("level").alias("more"))
        step = _hash_join(now, up, ["conv_id", "at"]).select("conv_id", "call_id", F.col("next").alias("at"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), "found")
        step = written(step, "levels")
        removed(now.sparkSession, now)
        now = step
    return now.select("conv_id", "call_id", F.when(F.col("at").isNull(), F.col("level")).alias("level"), "found")


def format_events(events: DataFrame, tools: dict) -> DataFrame:
    """conv_id, turn, role, kind, call_id, n_links, level, position, valid, errors, json for each event (see EVENT).

    n_links: a call's results, a result's calls. position: topological; a call's is twice its level, its results' one more.
    """
    e = events.select("conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "depends_on", "content")
    key = ["conv_id", "call_id"]
    order = F.struct("turn", "arguments", "name", "depends_on")
    linkable = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    calls = e.where((F.col("kind") == "call") & linkable)
    first = written(calls.groupBy(*key).agg(F.min(order).alias("x"), F.count("*").alias("n_calls")).select(*key, "n_calls", "x.*"), "calls")
    depth = levels(first.select(*key, "depends_on"))
    results = e.where((F.col("kind") == "result") & linkable).groupBy(*key).agg(F.count("*").alias("n_results"))
    info = first.select(*key, F.col("turn").alias("first_turn"), F.xxhash64("arguments", "name", "depends_on").alias("first_hash"), "n_calls")
    info = _hash_join(_hash_join(info, depth, key), results, key)
    both = _hash_join(e, info, key)
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    own = call & F.col("turn").eqNullSafe(F.col("first_turn")) & (F.xxhash64("arguments", "name", "depends_on") == F.col("first_hash"))
    linked = F.col("n_calls").isNotNull()
    duplicate = call & linked & ~own
    level = F.when((own | result) & linked, F.col("level"))
    errors = F.concat(
        F.when(call, argument_errors(F.col("name"), F.col("arguments"), tools)).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(duplicate, F.lit("duplicate_id")),
            F.when(result & ~linked, F.lit("no_call")),
            F.when(call & linked & ~F.col("found"), F.lit("no_dependency")),
            F.when((own | result) & linked & F.col("level").isNull(), F.lit("cycle")),
        )),
    )
    links = F.when(own, F.coalesce("n_results", F.lit(0))).when(result & linked, F.lit(1)).otherwise(F.lit(0)).cast("long")
    row = both.select("conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "depends_on", "content", links.alias("n_links"), level.alias("level"), F.array_join(F.array_sort(errors), ",").alias("errors"))
    position = F.col("level") * 2 + F.when(result, 1).otherwise(0)
    # fields in order of their names; the variant's own keys are kept sorted
    text = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "content", "conv_id", "depends_on", "kind", "level", "name", "role", "turn"))
    return row.select("conv_id", "turn", "role", "kind", "call_id", "n_links", "level", position.alias("position"), (F.col("errors") == "").alias("valid"), "errors", text.alias("json"))


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Plain conversations as events: a user's turn calls ``reply``, the assistant's next turn is its result, and a
    user's turn depends on the user's turn before it. Other turns are messages."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    name_of = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    before = conversations.where(user & known).select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("follows")).distinct()
    t = F.col("turn")
    return _hash_join(conversations.select("conv_id", "turn", "role", "text"), before, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(known & user, name_of(t)).when(known & assistant, name_of(t - 1)).alias("call_id"),
        F.when(user, "reply").alias("name"),
        F.when(user, F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")))).alias("arguments"),
        F.when(user & known & F.col("follows"), name_of(t - 2)).alias("depends_on"),
        F.when(~F.coalesce(user, F.lit(False)), F.col("text")).alias("content"),
    )


def op5_chat(spark, sf_dir: str) -> DataFrame:
    return format_events(events_of_turns(table(spark, sf_dir, "conversations")), REPLY_TOOLS)


OP5_SQL = r"""
WITH RECURSIVE u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
l AS (
  SELECT conv_id, turn, 0::BIGINT AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, l.level + 1 FROM l JOIN u ON u.conv_id = l.conv_id AND u.turn = l.turn + 2),
e AS (
  SELECT c.conv_id, c.turn, c.role, c.text,
    CASE c.role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE c.role WHEN 'user' THEN c.conv_id || '-' || c.turn WHEN 'assistant' THEN c.conv_id || '-' || (c.turn - 1) END AS call_id,
    l.level, r.role IS NOT NULL AS answered
  FROM conversations c
  LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = CASE c.role WHEN 'user' THEN c.turn WHEN 'assistant' THEN c.turn - 1 END
  LEFT JOIN conversations r ON c.role = 'user' AND r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant')
SELECT conv_id, turn, role, kind, call_id,
  CASE WHEN kind = 'call' THEN answered::BIGINT WHEN kind = 'result' AND level IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_links,
  level, level * 2 + CASE WHEN kind = 'result' THEN 1 ELSE 0 END AS position,
  NOT (kind = 'result' AND level IS NULL OR kind = 'call' AND length(text) > 300) AS valid,
  CASE WHEN kind = 'result' AND level IS NULL THEN 'no_call' WHEN kind = 'call' AND length(text) > 300 THEN 'limit:prompt' ELSE '' END AS errors,
  '{' || concat_ws(',',
    CASE WHEN kind = 'call' THEN '"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '}' END,
    '"call_id":' || to_json(call_id), CASE WHEN kind <> 'call' THEN '"content":' || to_json(text) END, '"conv_id":' || conv_id,
    CASE WHEN kind = 'call' AND level > 0 THEN '"depends_on":"' || conv_id || '-' || (turn - 2) || '"' END,
    '"kind":"' || kind || '"', '"level":' || level, CASE WHEN kind = 'call' THEN '"name":"reply"' END, '"role":' || to_json(role), '"turn":' || turn) || '}' AS json
FROM e
"""
