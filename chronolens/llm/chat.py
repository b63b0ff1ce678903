"""Chat formatting with tool-call linking.

A message states tool calls and results as JSON objects, alone or between
``<tool_call>`` / ``<tool_result>`` tags:

    {"tool_call": {"id": "c1", "name": "search", "arguments": {...}, "after": ["c0"]}}
    {"tool_result": {"id": "c1", "content": ...}}

Calls and results of a conversation are joined on (conversation, identifier).
A call comes after the calls named in ``after`` and after those whose result
its arguments refer to as ``"$id"``; its depth is the longest such chain, and
ordering by (depth, turn, place) is a topological order.  Arguments are
validated against the tool's JSON schema.  Messages are serialised as canonical
JSON: sorted keys, no white space, no escapes beyond those JSON demands.

Output is one row for each message, so no conversation is gathered anywhere;
only calls are joined.  The links of a conversation are ordered by removing
calls without open needs: in one task where there are at most ``GROUP_LINKS`` of
them, else in rounds over the cluster, one for each level, until no call
becomes ready.  Both end by themselves, however long a chain is, and leave
exactly the calls that are in a cycle or behind one.

Nothing here recurses over a message: JSON that the parser itself finds too
deep is plain text, and the rest is walked with explicit stacks.  Lone
surrogates, which UTF-8 can't hold, are written as escapes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.llm.scratch import Scratch

GROUP_LINKS = 100_000  # a conversation with more links between calls is ordered in rounds
_SURROGATE = re.compile("[\ud800-\udfff]")
_TAGGED = re.compile(r"<tool_(?:call|result)>(.*?)</tool_(?:call|result)>", re.S)

# Schemas of the tools that the stock query knows.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def storable(text: str) -> str:
    """text with its lone surrogates as escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Sorted keys, no white space; numbers that JSON can't hold are null; lone surrogates are escapes. Any depth."""
    out: list[str] = []
    stack: list = [value]
    scalar = json.JSONEncoder(ensure_ascii=False).encode
    while stack:
        x = stack.pop()
        if type(x) is _Written:
            out.append(x)
        elif isinstance(x, dict):
            stack.append(_Written("}"))
            items = sorted(x.items(), key=lambda kv: kv[0])
            for i in range(len(items) - 1, -1, -1):
                stack += (items[i][1], _Written(("," if i else "") + storable(scalar(items[i][0])) + ":"))
            stack.append(_Written("{"))
        elif isinstance(x, list):
            stack.append(_Written("]"))
            for i in range(len(x) - 1, -1, -1):
                stack.append(x[i])
                if i:
                    stack.append(_Written(","))
            stack.append(_Written("["))
        elif isinstance(x, float) and not math.isfinite(x):
            out.append("null")
        else:
            out.append(storable(scalar(x)))
    return "".join(out)


class _Written(str):
    """A piece of output on the stack."""


def parsed(text: str):
    """The JSON value of text; None if it is none, or nests deeper than the parser goes, or has numbers that it refuses."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, ()))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of the schema the value breaks: types, required and additional properties, items, enums, bounds, lengths and patterns.

    Recurses along the schema, so no deeper than it nests, whatever the value.
    """
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    elif isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{at}: out of bounds")
    return out


def _references(value) -> Iterator[str]:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x[:1] == "$" and len(x) > 1:
                yield storable(x[1:])
        elif isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)


def name_of(value) -> str:
    """An identifier or a tool's name as stored: strings as they are, other values as canonical JSON."""
    return storable(value) if isinstance(value, str) else canonical(value)


def tool_parts(text: str) -> tuple[list[dict], list[dict]]:
    """Calls and results that a message states."""
    if "tool_call" not in text and "tool_result" not in text:
        return [], []
    calls, results = [], []
    for piece in [text, *_TAGGED.findall(text)]:
        found = parsed(piece)
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict) and isinstance(c := x.get("tool_call"), dict) and c.get("id") is not None:
                calls.append(c)
            if isinstance(x, dict) and isinstance(r := x.get("tool_result"), dict) and r.get("id") is not None:
                results.append(r)
    return calls, results


PARTS = "conv_id long, turn long, mark long, kind string, place int, call_id string, name string, needs array<string>, valid boolean, errors array<string>"


def _parts(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                calls, results = tool_parts(text or "")
                for i, c in enumerate(calls):
                    arguments = c.get("arguments", {})
                    if isinstance(arguments, str) and (value := parsed(arguments)) is not None:
                        arguments = value
                    name = name_of(c.get("name"))
                    errors = [storable(x) for x in violations(arguments, schemas[name])] if name in schemas else ["$: no such tool"]
                    after = c.get("after") if isinstance(c.get("after"), list) else []
                    rows.append((conv, turn, mark, "call", i, name_of(c["id"]), name, sorted({*map(name_of, after), *_references(arguments)}), not errors, errors))
                rows += [(conv, turn, mark, "result", i, name_of(r["id"]), None, [], None, []) for i, r in enumerate(results)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string())]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "mark", "kind", "place", "call_id", "name", "needs", "valid", "errors"])

    return run


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, calls, results = [], [], []
        for role, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            c, r = tool_parts(text or "")
            message = {"role": role or "unknown", "content": text or ""}
            if c:
                message["tool_calls"] = c
            if r:
                message["tool_results"] = r
            out.append(canonical(message))
            calls.append(len(c))
            results.append(len(r))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string()), pa.array(calls, pa.int64()), pa.array(results, pa.int64())], names=["conv_id", "turn", "mark", "message", "n_calls", "n_results"])


def ordered_calls(calls: list[str], links: list[tuple[str, str]]) -> list[int | None]:
    """Depth of each call, from links (call, need): 0 without needs, else one more than the deepest need; None in or behind a cycle."""
    at = {c: i for i, c in enumerate(calls)}
    behind: list[list[int]] = [[] for _ in calls]
    open_ = [0] * len(calls)
    for call, need in links:
        behind[at[need]].append(at[call])
        open_[at[call]] += 1
    depth: list[int | None] = [0 if not n else None for n in open_]
    ready = [i for i, n in enumerate(open_) if not n]
    reached = [0] * len(calls)
    for i in ready:  # grows while it is walked
        for j in behind[i]:
            reached[j] = max(reached[j], depth[i] + 1)
            open_[j] -= 1
            if not open_[j]:
                depth[j] = reached[j]
                ready.append(j)
    return depth


def _order(table: pa.Table) -> pa.Table:
    """Depths in one conversation, from rows (conv_id, call_id, need)."""
    pairs = list(zip(table.column("call_id").to_pylist(), table.column("need").to_pylist(), strict=True))
    names = sorted({x for p in pairs for x in p})
    return pa.table([pa.array([table.column("conv_id")[0].as_py()] * len(names), pa.int64()), pa.array(names, pa.string()), pa.array(ordered_calls(names, pairs), pa.int32())], names=["conv_id", "call_id", "depth"])


def _rounds(scratch: Scratch, links: DataFrame) -> DataFrame:
    """The same over the cluster, one round for each level; calls in or behind a cycle have no row."""
    open_ = scratch.write(links)
    nodes = open_.select("conv_id", "call_id").unionAll(open_.select("conv_id", "need")).distinct()
    depth = scratch.write(nodes.join(open_, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0)))
    out, level = depth, 0
    while not depth.isEmpty():
        level += 1
        # links whose need was placed in the last round are done; calls with no open link left are next
        rest = scratch.write(open_.join(depth.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"))
        ready = open_.select("conv_id", "call_id").distinct().join(rest, ["conv_id", "call_id"], "left_anti")
        depth = scratch.write(ready.withColumn("depth", F.lit(level)))
        scratch.drop(open_)
        open_ = rest
        out = out.unionAll(depth)
        if level % 50 == 0:  # keeps the plan small
            out = scratch.write(out)
    return out


def linked_calls(conversations: DataFrame, schemas: dict = SCHEMAS, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", group_links: int = GROUP_LINKS) -> DataFrame:
    """One row for each call: conv_id, turn, mark (a hash of the message's text), place, call_id, name, valid, errors, result_turn, depth.

    Calls that share an identifier in a conversation all link to its first
    result (by turn, then place); a call without a result has result_turn
    null.  A call in or behind a cycle has depth null; an unknown identifier
    in ``after`` counts for nothing.  A null conversation or identifier links
    nothing: its calls have depth 0.  Messages that repeat state their calls as
    often; no rows give no rows.
    """
    scratch = Scratch(conversations.sparkSession, "tool-calls")
    text = F.col(f"`{text_col}`").cast("string")
    source = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.xxhash64(text).alias("mark"), text.alias("text"))
    parts = scratch.write(source.where(F.col("text").contains("tool_")).mapInArrow(_parts(schemas), PARTS))
    calls, results = parts.where("kind = 'call'").drop("kind"), parts.where("kind = 'result'")
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place")).alias("first")).select("conv_id", "call_id", F.col("first.turn").alias("result_turn"))
    nodes = calls.select("conv_id", F.col("call_id").alias("need")).distinct()
    links = scratch.write(calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct().join(nodes, ["conv_id", "need"], "left_semi"))
    sizes = links.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    depth = links.join(sizes.where(F.col("n") <= group_links), "conv_id", "left_semi").select("conv_id", "call_id", "need").groupBy("conv_id").applyInArrow(_order, "conv_id long, call_id string, depth int")
    large = links.join(sizes.where(F.col("n") > group_links), "conv_id", "left_semi").select("conv_id", "call_id", "need")
    if not large.isEmpty():
        # those that no round places keep depth null; a call of no link isn't here, and has depth 0
        placed = _rounds(scratch, large)
        stuck = large.select("conv_id", "call_id").distinct().join(placed, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(None).cast("int"))
        depth = depth.unionAll(placed.unionAll(stuck))
    ordered = depth.withColumn("linked", F.lit(True))
    met = calls.join(first, ["conv_id", "call_id"], "left").join(ordered, ["conv_id", "call_id"], "left")
    return met.select("conv_id", "turn", "mark", "place", "call_id", "name", "valid", "errors", "result_turn", F.when(F.col("linked"), F.col("depth")).otherwise(F.lit(0)).alias("depth"))


def format_chats(conversations: DataFrame, schemas: dict = SCHEMAS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group_links: int = GROUP_LINKS) -> DataFrame:
    """One row for each message: conv_id, turn, message (canonical JSON), n_calls, n_results, n_linked, n_valid, call_order.

    n_linked: the message's calls that have a result; n_valid: those whose
    arguments keep their schema; call_order: its call identifiers in the
    topological order, ties by place (those in cycles last).  A null role is
    "unknown", a null text is empty; a null turn or conversation stays null and
    links nothing.  Messages of one conversation and turn with other texts keep
    their own calls; rows that repeat are formatted as often.  Other columns,
    of any name, are not read; no rows give no rows.
    """
    text = F.col(f"`{text_col}`").cast("string")
    named = [F.col(f"`{c}`").cast(t).alias(n) for c, t, n in ((conv_col, "long", "conv_id"), (turn_col, "long", "turn"))]
    source = conversations.select(*named, F.xxhash64(text).alias("mark"), F.col(f"`{role_col}`").cast("string").alias("role"), text.alias("text"))
    messages = source.mapInArrow(_messages, "conv_id long, turn long, mark long, message string, n_calls long, n_results long")
    calls = linked_calls(conversations, schemas, conv_col, turn_col, text_col, group_links).dropDuplicates(["conv_id", "turn", "mark", "place"])
    order = F.sort_array(F.collect_list(F.struct(F.col("depth").isNull().alias("stuck"), "depth", "place", "call_id")))
    by_message = calls.groupBy("conv_id", "turn", "mark").agg(F.count("result_turn").alias("n_linked"), F.count_if("valid").alias("n_valid"), order.alias("o"))
    by_message = by_message.select("conv_id", "turn", "mark", "n_linked", "n_valid", F.transform("o", lambda x: x["call_id"]).alias("call_order"))
    met = messages.join(by_message, ["conv_id", "turn", "mark"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return met.select("conv_id", "turn", "message", "n_calls", "n_results", zero("n_linked"), zero("n_valid"), F.coalesce("call_order", F.array().cast("array<string>")).alias("call_order"))
