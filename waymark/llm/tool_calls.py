"""Chat formatting: tool calls and their results, linked, ordered, validated, and each message as one line of canonical JSON.

A message's text may be a JSON object with `tool_calls` ([{id, name, arguments}]), `tool_call_id` (what it answers) and `content`; any other
text is content. Calls and results are hash-joined by conversation and identifier. Order: a message's position is [its turn], or, where the
call it answers stands at its own turn or later, that message's position and then its turn; positions sort as arrays, so each result
follows its call (chains of such results take a round each, DEEPEST at most). Arguments are validated against the tool's schema: an
object with the required keys, no others than the known, each of its type and within its bounds. JSON is canonical: keys sorted, no
blanks, no escapes but those JSON needs, arguments parsed and nested.

No conversation is gathered in one place: rows stay rows, and the join key holds the identifier, so a conversation with a third of all rows is dealt like any other.

Defined results: null text: content null. Null role: role null. Text that isn't a JSON object: content as it is. Several calls with
one identifier in a conversation: the first by turn and place is linked, the others count as calls that nothing answers. Several results of one call: the first by turn
answers it, the others are `extra`. A result without a call: `orphan`. Results that answer each other in a circle: `cyclic`, at their turns (what hangs from a circle is placed after it). Unknown tool or broken arguments: not valid. Repeated rows: each a row.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import dropped, staged, table

_PARSED = "content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"

#: Tools by name: required keys, and for each key its type and bounds.
TOOLS = {
    "lookup": {"required": ["limit", "query"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 5}, "exact": {"type": "boolean"}}},
}

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def valid(schema: dict | None, value) -> bool:
    """Whether a parsed value meets a schema: type, enum, bounds, required and known keys, items."""
    if schema is None:
        return False
    kind = schema.get("type", "object" if "properties" in schema else None)
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return False
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if isinstance(value, dict) and "properties" in schema:
        known = schema["properties"]
        return all(k in value for k in schema.get("required", ())) and all(k in known and valid(known[k], v) for k, v in value.items())
    return all(valid(schema["items"], v) for v in value) if isinstance(value, list) and "items" in schema else True


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _parsed_arguments(text):
    try:
        return json.loads(text), True
    except (TypeError, ValueError):
        return text, False


_LINE = "row long, json string, n_valid int"


def _lines(tools: dict):
    def run(batches):
        for batch in batches:
            rows, out, n = [], [], []
            for m in batch.to_pylist():
                line, good = {"role": m["role"], "content": m["content"]}, 0
                if m["calls"]:
                    line["tool_calls"] = []
                    for c in m["calls"]:
                        arguments, read = _parsed_arguments(c["arguments"])
                        fine = read and valid(tools.get(c["name"]), arguments)
                        good += fine
                        line["tool_calls"].append({"id": c["id"], "name": c["name"], "arguments": arguments, "valid": fine})
                if m["answers"] is not None:
                    line["tool_call_id"] = m["answers"]
                rows.append(m["row"])
                out.append(canonical(line))
                n.append(good)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.string()), pa.array(n, pa.int32())], ["row", "json", "n_valid"])

    return run


def _circles(links: DataFrame) -> DataFrame:
    """row: what stands on a circle of links(row, up), a pointer a row. Pointers are doubled: a round that leaves as many rows and as many targets has only circles left as targets."""
    state, before = staged(links, "links"), None
    while True:
        held = state.select(F.col("row").alias("up"), F.col("up").alias("next"))
        old, state = state, staged(state.join(held, "up").select("row", F.col("next").alias("up")), "links")
        dropped(old)
        now = state.agg(F.count("*"), F.countDistinct("up")).first()
        if now[0] == 0 or now == before:
            return state.select(F.col("up").alias("row")).distinct()
        before = now


def formatted(messages: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """conv_id, turn, role, position, status (call, answer, extra, orphan, cyclic or plain), n_calls, n_valid, n_answered, answers_turn and json of every row of messages(conv_id, turn, role, text)."""
    p = F.when(F.col("text").rlike(r"^\s*\{"), F.from_json("text", _PARSED, {"mode": "PERMISSIVE"}))
    tagged = p["tool_calls"].isNotNull() | p["tool_call_id"].isNotNull()
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("p", p).withColumn("tagged", F.coalesce(tagged, F.lit(False)))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role",
        F.when(F.col("tagged"), F.col("p.content")).otherwise(F.col("text")).alias("content"),
        F.when(F.col("tagged"), F.filter("p.tool_calls", lambda c: c.isNotNull())).alias("calls"), F.when(F.col("tagged"), F.col("p.tool_call_id")).alias("answers"),
    )
    rows = staged(rows, "messages")
    calls = rows.select("row", "conv_id", "turn", F.posexplode("calls").alias("place", "call")).select("row", "conv_id", "turn", "place", F.col("call.id").alias("id")).where("id is not null")
    first = Window.partitionBy("conv_id", "id")
    calls = calls.withColumn("nth", F.row_number().over(first.orderBy("turn", "row", "place"))).where("nth = 1")
    results = rows.where("answers is not null").select("row", "conv_id", "turn", F.col("answers").alias("id"))
    results = results.withColumn("nth", F.row_number().over(first.orderBy("turn", "row")))
    c = calls.select(F.col("conv_id").alias("c_conv"), F.col("id").alias("c_id"), F.col("row").alias("call_row"), F.col("turn").alias("call_turn"))
    linked = results.join(c, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("id") == F.col("c_id")), "left").select("row", "turn", "nth", "call_row", "call_turn")
    linked = staged(linked, "linked")
    circle = staged(_circles(linked.where("call_row <> row").select("row", F.col("call_row").alias("up"))).union(linked.where("call_row = row").select("row")), "circles")
    # Positions: those of results that stand before their call come from the call's. path holds the turns from up (left out) to the row.
    late = linked.where("call_turn >= turn and call_row <> row").join(circle, "row", "left_anti")
    state = staged(late.select("row", F.col("call_row").alias("up"), F.array("turn").alias("path")), "late")
    while not state.join(state.select(F.col("row").alias("up")), "up", "left_semi").isEmpty():
        above = state.select(F.col("row").alias("up"), F.col("up").alias("next"), F.col("path").alias("more"))
        more = state.join(above, "up", "left").select("row", F.coalesce("next", "up").alias("up"), F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("more", "path")).alias("path"))
        old, state = state, staged(more, "late")
        dropped(old)
    moved = state.join(rows.select(F.col("row").alias("up"), F.array("turn").alias("own")), "up").select("row", F.concat("own", "path").alias("position"))
    answered = linked.where("nth = 1 and call_row is not null").groupBy(F.col("call_row").alias("row")).agg(F.count("*").cast("int").alias("n_answered"))
    lines = rows.select("row", "role", "content", "calls", "answers").mapInArrow(_lines(tools), _LINE)
    out = rows.select("row", "conv_id", "turn", "role", "answers", F.coalesce(F.size("calls"), F.lit(0)).alias("n_calls"))
    out = out.withColumn("n_calls", F.greatest("n_calls", F.lit(0))).join(lines, "row").join(answered, "row", "left").join(linked.select("row", "nth", "call_row", "call_turn"), "row", "left")
    out = out.join(moved, "row", "left")
    out = out.join(circle.select("row", F.lit(True).alias("circle")), "row", "left")
    status = F.when(F.col("circle"), "cyclic").when(F.col("answers").isNotNull() & F.col("call_row").isNull(), "orphan").when(F.col("answers").isNotNull() & (F.col("nth") > 1), "extra").when(F.col("answers").isNotNull(), "answer").when(F.col("n_calls") > 0, "call").otherwise("plain")
    return out.select("conv_id", "turn", "role", F.coalesce("position", F.array("turn")).alias("position"), status.alias("status"), "n_calls", "n_valid", F.coalesce("n_answered", F.lit(0)).alias("n_answered"), F.col("call_turn").alias("answers_turn"), "json")


def with_calls(conversations: DataFrame) -> DataFrame:
    """The table's plain turns in the operator's format: each assistant turn calls `lookup` for its first word, with the turn as limit, and each user turn but the first answers the call of the turn before."""
    word = F.coalesce(F.regexp_extract("text", r"(\S+)", 1), F.lit(""))
    call = F.to_json(F.struct(F.col("text").alias("content"), F.array(F.struct(F.concat_ws("-", F.lit("call"), F.col("turn")).alias("id"), F.lit("lookup").alias("name"), F.struct(word.alias("query"), F.col("turn").alias("limit")).alias("arguments"))).alias("tool_calls")))
    answer = F.to_json(F.struct(F.col("text").alias("content"), F.concat_ws("-", F.lit("call"), F.col("turn") - 1).alias("tool_call_id")))
    text = F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & (F.col("turn") > 0), answer).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", F.when((F.col("role") == "user") & (F.col("turn") > 0), "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(with_calls(table(spark, sf_dir, "conversations")))
