"""Tool-call linking in chat logs.

Calls stand in assistant messages as `<tool_call>{"id", "name", "arguments", "after"}</tool_call>`, results are
messages of role `tool` with `{"id", "content"}`. Calls and results are hash-joined by (conversation, id),
ordered so that no call stands before one it names in `after`, checked against the tool's schema, and written
as canonical JSON, one row per event. No step gathers a conversation in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.texts import cut

CALL, RESULT = "call", "result"
_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
_TYPES: dict[str, tuple[type, ...]] = {
    "string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,),
    "object": (dict,), "null": (type(None),),
}
EVENT = "conv string, turn bigint, idx int, kind string, id string, name string, body string, after array<string>"


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def schema_errors(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """Violations of type, enum, minimum, maximum, maxLength, required, properties, additionalProperties, items."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds:
        fits = any(isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds)
        if not fits:
            return [f"{at}: not {'/'.join(kinds)}"]
    errors = []
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            errors.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            errors.append(f"{at}: above maximum")
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        errors.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                errors += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                errors.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            errors += schema_errors(x, schema["items"], f"{at}[{i}]")
    return errors


def _parse(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else canonical(value)


def events(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Calls and results of the messages, in `EVENT` columns; markup that is no JSON object gives an event without id."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, t, who, said in zip(*(col.to_pylist() for col in batch.columns)):
                if said is None:
                    continue
                if who == "assistant":
                    for i, m in enumerate(_CALL.finditer(said)):
                        x = _parse(m[1])
                        x = x if isinstance(x, dict) else {}
                        after = x.get("after")
                        after = [_text(a) for a in after if a is not None] if isinstance(after, list) else []
                        rows.append((c, t, i, CALL, _text(x.get("id")), _text(x.get("name")), canonical(x.get("arguments")), after))
                elif who == "tool":
                    x = _parse(said)
                    x = x if isinstance(x, dict) else {}
                    rows.append((c, t, 0, RESULT, _text(x.get("id")), None, canonical(x.get("content")), []))
            names = [f.split()[0] for f in EVENT.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names)

    source = messages.select(F.coalesce(F.col(conv).cast("string"), F.lit("")), F.col(turn).cast("bigint"), role, text)
    return source.mapInArrow(find, EVENT)


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level): 0 where the order of turns already respects `after`.

    Conversations in which a call names a later one are sorted by rounds: level k + 1 is open once all named
    calls have a level up to k. Calls on a cycle, or behind one, get no row.
    """
    key = ["conv", "id"]
    place = F.struct("turn", "idx")
    edges = calls.select(*key, place.alias("own"), F.explode(F.array_distinct("after")).alias("dep"))
    known = edges.join(calls.select("conv", F.col("id").alias("dep"), place.alias("named")), ["conv", "dep"])
    ahead = known.filter("named >= own").select("conv").distinct()
    mixed = cut(ahead)
    if mixed.isEmpty():
        return calls.select(*key, F.lit(0).alias("level"))
    out = calls.join(mixed, "conv", "left_anti").select(*key, F.lit(0).alias("level"))
    waiting = cut(calls.join(mixed, "conv", "left_semi").select(*key))
    open_edges = cut(known.join(mixed, "conv", "left_semi").select(*key, "dep"))
    level = 0
    while True:
        ready = cut(waiting.join(open_edges.select(*key).distinct(), key, "left_anti"))
        if ready.isEmpty():
            return out
        out = out.unionByName(ready.withColumn("level", F.lit(level)))
        waiting = cut(waiting.join(ready, key, "left_anti"))
        open_edges = cut(open_edges.join(ready.select("conv", F.col("id").alias("dep")), ["conv", "dep"], "left_anti"))
        level += 1


def link_calls(
    messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]], conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per call, and one per result without a call of its own.

    Columns: conv, level, turn, idx (the topological order inside the conversation), id, name, status, valid,
    errors, line. `status` is linked, unanswered, misplaced (the result stands before the call), cyclic,
    repeated (an earlier call or result has the id), orphan (a result without call) or nameless (no id).
    `valid` says whether the arguments fit the schema of the tool's name; unknown tools are not valid, results
    have null. `line` is canonical JSON. A null conversation counts as the one named by the empty string, null
    texts hold no events, null turns come first.
    """
    key = ["conv", "id"]
    found = cut(events(messages, conv, turn, role, text))
    named = found.filter("id IS NOT NULL")
    place = F.struct("turn", "idx")
    heads = named.groupBy(*key, "kind").agg(F.min(place).alias("head"))
    marked = named.join(heads, [*key, "kind"]).withColumn("repeated", place != F.col("head"))
    # rows of one kind, id and place are copies; one of them is enough
    first = marked.filter("NOT repeated").drop("repeated", "head").dropDuplicates([*key, "kind"])
    calls = first.filter(F.col("kind") == CALL)
    results = first.filter(F.col("kind") == RESULT).select(*key, F.col("turn").alias("r_turn"), F.col("body").alias("r_body"))
    levels = call_levels(calls).withColumnRenamed("level", "_level")
    both = calls.join(levels, key, "left").join(results, key, "full_outer")
    status = (
        F.when(F.col("kind").isNull(), "orphan").when(F.col("_level").isNull(), "cyclic").when(F.col("r_turn").isNull() & F.col("r_body").isNull(), "unanswered")
        .when(F.col("r_turn") < F.col("turn"), "misplaced").otherwise("linked")
    )
    linked = both.select(
        "conv", F.col("_level").alias("level"), F.coalesce("turn", "r_turn").alias("turn"), F.coalesce("idx", F.lit(0)).alias("idx"),
        "id", "name", status.alias("status"), "body", "r_body",
    )

    def alone(rows: DataFrame, why: str) -> DataFrame:
        own = F.col("kind") == CALL
        return rows.select(
            "conv", F.lit(None).cast("int").alias("level"), "turn", "idx", "id", "name", F.lit(why).alias("status"),
            F.when(own, F.col("body")).alias("body"), F.when(~own, F.col("body")).alias("r_body"),
        )

    rows = linked.unionByName(alone(marked.filter("repeated"), "repeated")).unionByName(
        alone(found.filter("id IS NULL"), "nameless")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, lines = [], [], []
            for row in batch.to_pylist():
                is_call = row["body"] is not None
                wrong = None
                event = {"id": row["id"], "status": row["status"]}
                if is_call:
                    arguments = json.loads(row["body"])
                    schema = schemas.get(row["name"])
                    wrong = ["$: unknown tool"] if schema is None else schema_errors(arguments, schema)
                    event |= {"name": row["name"], "arguments": arguments}
                if row["r_body"] is not None:
                    event["result"] = json.loads(row["r_body"])
                valid.append(None if wrong is None else not wrong)
                errors.append(wrong or [])
                lines.append(canonical(event))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())],
                [*batch.schema.names[:-2], "valid", "errors", "line"],
            )

    return rows.mapInArrow(
        write,
        "conv string, level int, turn bigint, idx int, id string, name string, status string, valid boolean, errors array<string>, line string",
    )
