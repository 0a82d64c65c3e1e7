"""Tool-call linking: join calls and results by identifier, order calls topologically, check arguments, canonical JSON.

Calls and results meet in an equi-join on conversation and call id. A call's level is one more than the highest level of the
calls it depends on; levels come from policy iteration over doubled pointers, all joins and partial aggregations, so no
conversation is gathered in one task. Arguments, and results that are JSON objects or arrays, are parsed as variants: object
keys come out sorted at every depth, and numbers in one form, which makes the JSON canonical; other results are JSON strings.

Defined results. Null or unparsable arguments: ``valid`` is false, the canonical arguments are null. A tool without a schema:
any object is valid. A result without a call: left out; a call without a result: ``linked`` false, result null. Several
results for one call: the one of the smallest turn, then text. Repeated calls with one id: each is returned, linked to the
same result. Dependencies on ids that don't exist, or on the call itself, are not waited for. Calls on a cycle, or behind
one: level null. Null identifiers: never linked. Empty tables: empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import stage

#: A tool's schema, in the words of JSON Schema: type, properties, required, additionalProperties (a bool), items, enum,
#: minimum, maximum, minLength, maxLength. A field that isn't required may also be null.
Schema = dict
_TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DOUBLE|DECIMAL\(.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def _path(field: str) -> str:
    """The variant path of a field, whatever characters its name has; a name with both quotes can't be written as one."""
    if "'" not in field:
        return f"$['{field}']"
    if '"' in field:
        raise ValueError(f"a field name with both kinds of quotes: {field}")
    return f'$["{field}"]'


def fits(value: Column, schema: Schema) -> Column:
    """Whether a variant fits a schema, at every depth; false for SQL null."""
    known = {"type", "properties", "required", "additionalProperties", "items", "enum", "minimum", "maximum", "minLength", "maxLength", "description", "title"}
    if unknown := schema.keys() - known:
        raise ValueError(f"not supported in a schema: {sorted(unknown)}")
    ok = value.isNotNull()
    if "type" in schema:
        ok = ok & F.schema_of_variant(value).rlike(f"^({_TYPES[schema['type']]})$")
    if "enum" in schema:
        ok = ok & F.to_json(value).isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for x in schema["enum"]])
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    for word, of, holds in (("minimum", number, lambda x, y: x >= y), ("maximum", number, lambda x, y: x <= y), ("minLength", F.length(text), lambda x, y: x >= y), ("maxLength", F.length(text), lambda x, y: x <= y)):
        if word in schema:
            ok = ok & holds(of, F.lit(schema[word]))
    fields = schema.get("properties", {})
    for field in {**fields, **dict.fromkeys(schema.get("required", ()))}:
        got = F.try_variant_get(value, _path(field), "variant")
        good = fits(got, fields.get(field) or {})
        ok = ok & (good if field in schema.get("required", ()) else got.isNull() | F.is_variant_null(got) | good)
    if schema.get("additionalProperties") is False:
        ok = ok & F.forall(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), lambda k: k.isin(list(fields)) if fields else F.lit(False))
    if "items" in schema:
        ok = ok & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: fits(x, schema["items"]))
    return F.coalesce(ok, F.lit(False))


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """Whether a variant is an object that fits the tool's schema; false for null."""
    ok = F.lit(True)
    for tool, schema in schemas.items():
        ok = F.when(name == tool, fits(arguments, schema)).otherwise(ok)
    return fits(arguments, {"type": "object"}) & ok


#: Stands for the level of a call that never gets one, where the highest of several is looked for.
_NEVER = 1 << 60


def _followed(ids: DataFrame, picks: DataFrame) -> DataFrame:
    """``conv``, ``id``, ``level`` (long) if every call waits for its pick alone; null on a cycle and behind one.

    Pointers are doubled until they reach a call without a pick: a chain of n calls takes log n rounds.
    """
    key = ["conv", "id"]
    state = stage(ids.join(picks.select(*key, F.col("dep").alias("to")), key, "left").select(*key, "to", F.col("to").isNotNull().cast("long").alias("far")), "pointers")
    done, waiting = [state.where(F.col("to").isNull())], state.where(F.col("to").isNotNull())
    longest = picks.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):  # more rounds than that need a cycle
        if waiting.isEmpty():
            break
        every = waiting
        for d in done:
            every = every.union(d)
        jump = every.select("conv", F.col("id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        moved = stage(waiting.join(jump, ["conv", "to"]).select(*key, F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far")), "pointers")
        done.append(moved.where(F.col("to").isNull()))
        waiting = moved.where(F.col("to").isNotNull())
    level = waiting.select(*key, F.lit(None).cast("long").alias("level"))
    for d in done:
        level = level.union(d.select(*key, F.col("far").alias("level")))
    return stage(level, "levels")


def levels(calls: DataFrame) -> DataFrame:
    """``conv``, ``id``, ``level`` of distinct calls (conv, id, deps array of ids); null on a cycle or behind one.

    Longest paths by policy iteration: each call follows one of its dependencies, the lengths of the paths that this gives come
    from doubled pointers, and a call with several dependencies switches to one whose path is longer. When no call switches, the
    paths are the longest. A call that follows a cycle has no level, and counts as the highest to those that depend on it; a
    cycle that no call follows yet makes its calls switch until they do.
    """
    key = ["conv", "id"]
    nodes = calls.where(F.col("conv").isNotNull() & F.col("id").isNotNull())
    ids = stage(nodes.select(*key).distinct(), "call-ids")
    edges = nodes.select(*key, F.explode("deps").alias("dep")).where(F.col("dep") != F.col("id")).distinct()
    edges = stage(edges.join(ids.withColumnRenamed("id", "dep"), ["conv", "dep"]), "call-edges")
    picks = stage(edges.groupBy(*key).agg(F.max("dep").alias("dep"), F.count(F.lit(1)).alias("choices")), "picks")
    level = _followed(ids, picks)
    several = picks.where(F.col("choices") > 1)
    if not several.isEmpty():
        forks = stage(edges.join(several.select(*key), key), "forks")
        while True:
            high = forks.join(level.select("conv", F.col("id").alias("dep"), F.coalesce("level", F.lit(_NEVER)).alias("high")), ["conv", "dep"])
            best = high.groupBy(*key).agg(F.max(F.struct("high", "dep")).alias("best")).join(level, key)
            switched = stage(best.where(F.col("best.high") + 1 > F.col("level")).select(*key, F.col("best.dep").alias("better")), "switched")
            if switched.isEmpty():
                break
            picks = stage(picks.join(switched, key, "left").select(*key, F.coalesce("better", "dep").alias("dep")), "picks")
            level = _followed(ids, picks)
    return level.select(*key, F.col("level").cast("int").alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """Calls (conv, id, turn, name, arguments, deps) with results (conv, id, turn, content): one row a call.

    ``level`` orders a conversation topologically (ties: turn, id); ``json`` is the call with its arguments and result as
    canonical JSON.
    """
    first = results.where(F.col("conv").isNotNull() & F.col("id").isNotNull()).groupBy("conv", "id").agg(F.min(F.struct("turn", "content")).alias("r")).select("conv", "id", F.col("r.content").alias("result"), F.lit(True).alias("linked"))
    rows = calls.join(levels(calls), ["conv", "id"], "left").join(first, ["conv", "id"], "left")
    parsed = rows.withColumn("_args", F.try_parse_json("arguments")).withColumn("_found", F.try_parse_json("result"))
    nested = F.schema_of_variant("_found").rlike(f"^({_TYPES['object']}|{_TYPES['array']})$")
    # a null field would be left out by to_json: the fields are written one by one
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.struct(c.alias("x")))).substr(F.lit(6), F.length(F.to_json(F.to_variant_object(F.struct(c.alias("x"))))) - 6), F.lit("null"))
    json = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("_args"), F.lit("null")), F.lit(',"id":'), text(F.col("id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), F.when(nested, F.to_json("_found")).otherwise(text(F.col("result"))), F.lit("}"))
    return parsed.select("conv", "id", "turn", "name", "level", F.coalesce("linked", F.lit(False)).alias("linked"), valid_arguments(F.col("name"), F.col("_args"), schemas).alias("valid"), json.alias("json"))


def calls_in_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages carry as JSON: ``{"tool_calls":[{"id","name","arguments","depends_on"}]}`` in a text,
    and texts of role ``tool`` with ``{"tool_call_id","content"}``. Other messages give neither."""
    v = messages.select("conv_id", "turn", "role", F.try_parse_json("text").alias("v"))
    each = v.select("conv_id", "turn", F.explode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("c"))
    get = lambda name, kind="string": F.try_variant_get("c", f"$.{name}", kind)
    calls = each.select(F.col("conv_id").alias("conv"), get("id").alias("id"), "turn", get("name").alias("name"), F.to_json(get("arguments", "variant")).alias("arguments"), F.coalesce(get("depends_on", "array<string>"), F.array().cast("array<string>")).alias("deps"))
    results = v.where(F.col("role") == "tool").select(F.col("conv_id").alias("conv"), F.try_variant_get("v", "$.tool_call_id", "string").alias("id"), "turn", F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(F.try_variant_get("v", "$.content", "variant"))).alias("content")).where(F.col("id").isNotNull())
    return calls, results


def calls_of_turns(messages: DataFrame, tool: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls: each user turn asks tool ``reply`` with its text, depends on the user turns two and four before, and
    the assistant turn behind it is the result; ids are ``conversation:turn``."""
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    turn = F.col("turn").cast("long")
    arguments = F.to_json(F.struct(F.col("text").alias("text"), turn.alias("turn")), {"ignoreNullFields": "false"})
    calls = messages.where(F.col("role") == "user").select(F.col("conv_id").alias("conv"), F.when(named, name(turn)).alias("id"), turn.alias("turn"), F.lit(tool).alias("name"), arguments.alias("arguments"), F.when(named, F.array(name(turn - 2), name(turn - 4))).otherwise(F.array().cast("array<string>")).alias("deps"))
    results = messages.where((F.col("role") == "assistant") & named).select(F.col("conv_id").alias("conv"), name(turn - 1).alias("id"), turn.alias("turn"), F.col("text").alias("content"))
    return calls, results


#: The schema of the tool that plain turns call.
REPLY_SCHEMA: dict[str, Schema] = {
    "reply": {
        "type": "object", "required": ["text", "turn"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}},
    }
}
