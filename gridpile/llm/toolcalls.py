"""Tool-call linking: calls and results joined by identifier, ordered by what they depend on, checked against schemas, as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: The part of JSON Schema that arguments are checked against, and keywords that state nothing.
_CHECKED = {"type", "required", "properties", "additionalProperties", "items", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems"}
_SILENT = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind]) if kind in _TYPES else False


def _same(a: Any, b: Any) -> bool:
    """Equality of JSON values: true is not 1, 1.0 is 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def problems(value: Any, schema: Any, at: str = "$") -> list[str]:
    """What is wrong with value by type (one or a list), required, properties, additionalProperties, items, enum, const, minimum,
    maximum, and the lengths of strings and arrays. Keywords beyond these are a problem each: what cannot be checked is not valid."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return [f"{at}: schema is no object"]
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [] if kinds is None else [kinds]
    if kinds and not any(_is(value, str(k)) for k in kinds):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    bad = [f"{at}: {k} is not supported" for k in sorted(map(str, schema)) if k not in _CHECKED | _SILENT]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        bad.append(f"{at}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        bad.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        bad += [f"{at}: {k} missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                bad += problems(value[k], known[k], f"{at}.{k}")
            elif (more := schema.get("additionalProperties", True)) is False:
                bad.append(f"{at}: {k} not allowed")
            elif more is not True:
                bad += problems(value[k], more, f"{at}.{k}")
    elif isinstance(value, list):
        for i, x in enumerate(value) if "items" in schema else ():
            bad += problems(x, schema["items"], f"{at}[{i}]")
        bad += [f"{at}: too few"] if len(value) < schema.get("minItems", 0) else []
        bad += [f"{at}: too many"] if len(value) > schema.get("maxItems", len(value)) else []
    elif isinstance(value, str):
        bad += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        bad += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    elif isinstance(value, int | float) and not isinstance(value, bool):
        bad += [f"{at}: below minimum"] if value < schema.get("minimum", value) else []
        bad += [f"{at}: above maximum"] if value > schema.get("maximum", value) else []
    return bad


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, UTF-8 characters as themselves and whole floats as integers; equal values give equal text."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if x != x or abs(x) == float("inf"):
                return None
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _levels(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(uid, level): the longest chain of prerequisites below each call; null for calls in or above a cycle. edges: (uid, before).

    A call with one prerequisite is followed along such calls by doubling, so a chain of any length takes log2 rounds; calls
    with several wait for all of theirs, a round for each such level. Calls that never become free are cyclic.
    """
    counts = edges.groupBy("uid").agg(F.count("*").alias("n"), F.min("before").alias("before"))
    nodes = ids.join(counts, "uid", "left").select("uid", F.coalesce("n", F.lit(0)).alias("n"), "before")
    # top: the call that the chain of single prerequisites starts from; d: how many calls above it
    hop = stored(nodes.select("uid", F.when(F.col("n") == 1, F.col("before")).otherwise(F.col("uid")).alias("top"), F.when(F.col("n") == 1, 1).otherwise(0).cast("bigint").alias("d")), "calls-hop")
    total = ids.count()
    reach = 1
    while reach <= total:
        nxt = hop.select(F.col("uid").alias("top"), F.col("top").alias("t2"), F.col("d").alias("d2"))
        moved = stored(hop.join(nxt, "top").select("uid", F.col("t2").alias("top"), (F.col("d") + F.col("d2")).alias("d"), (F.col("d2") > 0).alias("m")), "calls-hop")
        hop, more = moved.drop("m"), moved.where("m").limit(1).count()
        reach *= 2
        if not more:
            break
    roots = nodes.select(F.col("uid").alias("top"), F.col("n").alias("top_n"), F.lit(True).alias("known"))
    hop = hop.join(roots, "top", "left").where("top_n <> 1")  # a top with one prerequisite lies on a cycle
    done = stored(hop.where("top_n = 0").select("uid", F.col("d").alias("level")), "calls-levels")
    waiting = stored(hop.where("top_n > 1").select("uid", "top", "d"), "calls-waiting")
    while not waiting.isEmpty():
        heads = edges.join(waiting.where("uid = top").select("uid"), "uid", "left_semi")
        ready = heads.join(done.select(F.col("uid").alias("before"), "level"), "before", "left").groupBy("uid").agg(F.count("*").alias("n"), F.count("level").alias("k"), F.max("level").alias("level"))
        ready = stored(ready.where("n = k").select(F.col("uid").alias("top"), (F.col("level") + 1).alias("base")), "calls-ready")
        if ready.isEmpty():
            break
        done = stored(done.union(waiting.join(ready, "top").select("uid", (F.col("base") + F.col("d")).alias("level"))), "calls-levels")
        waiting = stored(waiting.join(ready, "top", "left_anti").select("uid", "top", "d"), "calls-waiting")
    return ids.join(done, "uid", "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call with its result: conv_id, call_id, tool, level, linked, valid, problems, json.

    calls: conv_id, call_id, tool, arguments (JSON text), after (array of call_ids whose results it needs). results: conv_id,
    call_id, content. Calls and results join by conversation and identifier, so one long conversation is no group of its
    own. Of calls or results that repeat an identifier the least (by tool and arguments, by content) stands. level orders
    calls topologically: it exceeds the level of every call in `after`; identifiers that no call has are ignored; calls on a
    cycle, or above one, have a null level. valid: the tool has a schema, arguments are a JSON text that meets it, all of it in keywords that `problems` knows. No schema or
    number ends the job: what cannot be read is a problem of its row. A null
    conv_id is a conversation; calls with a null call_id keep a row each, unlinked. Results without a call are left out.
    """
    # the identifiers themselves, a conversation's with its length in front: no two pairs of them read the same
    conv = F.coalesce(F.concat(F.length(F.col("conv_id").cast("string")).cast("string"), F.lit(":"), F.col("conv_id").cast("string")), F.lit("-"))
    uid = F.concat(conv, F.lit("|"), F.col("call_id"))
    base = calls.select(F.col("conv_id"), F.col("call_id").cast("string").alias("call_id"), "tool", "arguments", "after")
    named = base.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("tool", "arguments", "after")).alias("c")).select("conv_id", "call_id", "c.*")
    named = stored(named.withColumn("uid", uid), "calls")
    own = results.where("call_id is not null").groupBy("conv_id", F.col("call_id").cast("string").alias("call_id")).agg(F.min("content").alias("content"), F.lit(True).alias("has"))
    own = own.select(uid.alias("uid"), "content", "has")
    needs = named.select("uid", F.explode("after").alias("need"), "conv_id").where("need is not null")
    needs = needs.select("uid", F.concat(conv, F.lit("|"), F.col("need").cast("string")).alias("before")).distinct()
    edges = stored(needs.join(named.select(F.col("uid").alias("before")), "before", "left_semi").select("uid", "before"), "calls-edges")
    linked = named.join(own, "uid", "left").join(_levels(edges, named.select("uid")), "uid", "left").drop("uid", "after")
    loose = base.where("call_id is null").select("conv_id", "call_id", "tool", "arguments", F.lit(None).cast("string").alias("content"), F.lit(None).cast("boolean").alias("has"), F.lit(None).cast("bigint").alias("level"))
    rows = linked.select(*loose.columns).unionByName(loose)
    out = rows.drop("arguments", "content", "has").withColumns({"linked": F.lit(True), "valid": F.lit(True), "problems": F.lit(""), "json": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for r in b.to_pylist():
                try:
                    value, bad = json.loads(r["arguments"]) if r["arguments"] is not None else None, []
                    text = canonical({"arguments": value, "call_id": r["call_id"], "name": r["tool"], "result": r["content"]})
                except (ValueError, RecursionError):  # no JSON, nested too deep, or a number of too many digits
                    value, bad = r["arguments"], ["$: not JSON"]
                    text = canonical({"arguments": value, "call_id": r["call_id"], "name": r["tool"], "result": r["content"]})
                if not bad:
                    try:
                        bad = problems(value, schemas[r["tool"]]) if r["tool"] in schemas else ["$: no such tool"]
                    except (TypeError, ValueError, AttributeError, OverflowError, RecursionError):  # a schema that is not well formed
                        bad = ["$: schema cannot be read"]
                found.append((bool(r["has"]), not bad, "; ".join(bad), text))
            keep = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            yield pa.RecordBatch.from_arrays(
                [keep["conv_id"], keep["call_id"], keep["tool"], keep["level"], *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.bool_(), pa.bool_(), pa.string(), pa.string()))]],
                ["conv_id", "call_id", "tool", "level", "linked", "valid", "problems", "json"])

    order = ["conv_id", "call_id", "tool", "level", "linked", "valid", "problems", "json"]
    kinds = {f.name: f.dataType for f in out}
    from pyspark.sql.types import StructField, StructType

    return rows.mapInArrow(run, StructType([StructField(n, kinds[n]) for n in order]))


#: Production schemas of the query: the tool that user turns call. Calls of other tools that texts hold are reported as such.
REPLY = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
                   "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "system": {"type": "boolean"}}}}


#: Calls as assistants' texts hold them, by name and arguments or under `function`, and results as tools' texts hold them.
_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>,function:struct<name:string,arguments:string>>>"
_RESULT = "tool_call_id string, content string"


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a chat table (conv_id, turn, role, text).

    Calls that the texts hold: an assistant's text that is a JSON object with `tool_calls`, each with an id, a name and arguments
    (an object or its JSON text, also under `function`) and perhaps `after`; the result is a tool's text {"tool_call_id", "content"}.
    Besides, each user turn calls `reply` with its text under its turn's number, "turn-<n>"; the assistant turn that follows is the
    result, and it needs the call two turns before it, whose answer it has seen. A text that is no such JSON, or null, holds no
    calls; a held call without id stays, unlinked; equal identifiers in one conversation are settled as link_calls does. Other
    columns are ignored; an empty table gives no calls.
    """
    turn = F.col("turn").cast("bigint")
    name = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    user, assistant = conversations.where("role = 'user'"), conversations.where("role = 'assistant'")
    arguments = F.to_json(F.struct(F.col("text").alias("text"), turn.alias("turn")))
    asked = user.select("conv_id", name(turn).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), F.array(name(turn - 2)).alias("after"))
    # few texts hold calls: the others are not read as JSON
    held = assistant.where(F.contains("text", F.lit("tool_calls"))).select("conv_id", F.explode(F.from_json("text", _CALLS)["tool_calls"]).alias("c")).where("c is not null")
    held = held.select(
        "conv_id", F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("tool"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), F.col("c.after").alias("after"))
    answers = assistant.select("conv_id", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    found = conversations.where((F.col("role") == "tool") & F.contains("text", F.lit("tool_call_id"))).select("conv_id", F.from_json("text", _RESULT).alias("r")).where("r.tool_call_id is not null")
    found = found.select("conv_id", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    return asked.unionByName(held), answers.unionByName(found)
