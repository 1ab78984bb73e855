"""Tool-call linking, with DataFrame functions only: calls and results are joined by identifier, put in topological
order, their arguments validated against schemas, and each exchange serialised as canonical JSON.

Canonical JSON has sorted keys, no white space and no escapes but the necessary ones; it comes from Spark's variant
type, which keeps the fields of objects sorted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.textops import remove, shared_folder, written

#: JSON types and the variant types that satisfy them.
KINDS = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT.*", "array": r"^ARRAY.*"}


def canonical(text: Column) -> Column:
    """Canonical JSON of a JSON text; null if it is not valid JSON, or names a key of an object twice.

    Numbers have the form of their value: ``1.0`` is ``1``, ``1e2`` is ``100.0``.
    """
    return F.to_json(F.try_parse_json(text))


def violations(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments (JSON text), as an array of strings in a fixed order; empty if nothing.

    A schema is a JSON Schema of an object: ``properties`` with ``type`` (any if absent), ``enum``, ``minLength``,
    ``maxLength``, ``pattern``, ``minimum`` and ``maximum``, ``required``, and ``additionalProperties`` (true if absent).
    Integers are numbers without a fraction, of up to 38 digits. Schemas are parameters of the query, compiled into one expression.
    """
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        checks = []
        properties = schema.get("properties", {})
        for field in sorted(properties):
            rule, has = properties[field], F.array_contains(keys, field)
            at = f'$["{field}"]' if "'" in field else f"$['{field}']"
            value = F.variant_get(parsed, at, "variant")
            right = F.coalesce(F.schema_of_variant(value).rlike(KINDS[rule["type"]]), F.lit(False)) if "type" in rule else F.lit(True)
            if field in schema.get("required", ()):
                checks.append(F.when(~has, f"{field}: missing"))
            checks.append(F.when(has & ~right, f"{field}: not {rule.get('type')}"))
            text, number = F.try_variant_get(parsed, at, "string"), F.try_variant_get(parsed, at, "double")
            length = F.char_length(text)
            if "enum" in rule:
                allowed = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in rule["enum"]]
                checks.append(F.when(has & ~F.coalesce(F.to_json(value).isin(allowed), F.lit(False)), f"{field}: not one of those allowed"))
            if "pattern" in rule:
                checks.append(F.when(has & right & ~text.rlike(rule["pattern"]), f"{field}: not of the pattern"))
            if "minimum" in rule:
                checks.append(F.when(has & right & (number < rule["minimum"]), f"{field}: too small"))
            if "maximum" in rule:
                checks.append(F.when(has & right & (number > rule["maximum"]), f"{field}: too large"))
            if "minLength" in rule:
                checks.append(F.when(has & right & (length < rule["minLength"]), f"{field}: too short"))
            if "maxLength" in rule:
                checks.append(F.when(has & right & (length > rule["maxLength"]), f"{field}: too long"))
        if not schema.get("additionalProperties", True):
            extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in properties]) if properties else F.array().cast("array<string>")))
            checks.append(F.when(F.size(extra) > 0, F.concat(F.array_join(extra, ","), F.lit(": not allowed"))))
        found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        out = F.when(name == tool, F.when(is_object, found).otherwise(F.array(F.lit("arguments: not an object")))).otherwise(out)
    return out


def topological(calls: DataFrame) -> DataFrame:
    """Adds ``position`` (gapless from 0 in each conversation; null on a cycle) to calls with conv_id, turn, call_id, after.

    ``after`` lists the calls that a call depends on. Where they all come earlier by turn, the order of turns is
    topological. Only conversations with a dependency on the same or a later turn are peeled in rounds, each of which
    takes the calls without an open dependency, whatever the number of levels; what remains when no call is free lies on
    or behind a cycle. Each round is a table in the shared folder. Unknown identifiers are no dependencies. Positions of long conversations are counted in parts of 256 turns.
    """
    edges = calls.select("conv_id", "turn", "call_id", F.explode("after").alias("dep")).where("call_id IS NOT NULL").distinct()
    known = calls.where("call_id IS NOT NULL").groupBy("conv_id", F.col("call_id").alias("dep")).agg(F.min("turn").alias("dep_turn"))
    edges = edges.join(known, ["conv_id", "dep"])
    late = edges.where("dep_turn >= turn").select("conv_id").distinct()
    if not late.isEmpty():
        spark, top = calls.sparkSession, f"{shared_folder(calls.sparkSession)}/levels-{uuid.uuid4().hex}"
        open_edges = written(edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "dep").distinct(), f"{top}/edges-0")
        todo = written(calls.join(late, "conv_id", "left_semi").where("call_id IS NOT NULL").select("conv_id", "call_id").distinct(), f"{top}/todo-0")
        i = 0
        while True:
            free = written(todo.join(open_edges, ["conv_id", "call_id"], "left_anti"), f"{top}/levels/level={i}")
            if free.isEmpty():
                break
            todo = written(todo.join(free, ["conv_id", "call_id"], "left_anti"), f"{top}/todo-{i + 1}")
            open_edges = written(open_edges.join(free.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti").select("conv_id", "call_id", "dep"), f"{top}/edges-{i + 1}")
            remove(spark, f"{top}/todo-{i}")
            remove(spark, f"{top}/edges-{i}")
            i += 1
        schema = todo.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
        level = spark.read.schema(f"{schema}, level int").parquet(f"{top}/levels").union(todo.withColumn("level", F.lit(None).cast("int")))
        calls = calls.join(level.withColumn("peeled", F.lit(True)), ["conv_id", "call_id"], "left").withColumn("cyclic", F.coalesce("peeled", F.lit(False)) & F.col("level").isNull())
    else:
        calls = calls.withColumn("level", F.lit(0)).withColumn("cyclic", F.lit(False))
    calls = calls.withColumn("level", F.coalesce("level", F.lit(0))).withColumn("part", F.floor(F.col("turn") / 256))
    group = ["conv_id", "cyclic", "level", "part"]
    counted = calls.groupBy(group).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id", "cyclic").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select(*[F.col(c).alias(f"_{c}") for c in group], F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(group).orderBy("turn", "call_id"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = calls.withColumn("own", own).join(counted, same)
    return placed.withColumn("position", F.when(~F.col("cyclic"), (F.col("before") + F.col("own") - 1).cast("long"))).drop("own", "before", "level", "part", "cyclic", "peeled", *[f"_{c}" for c in group])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every call with its result, and every result without a call.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after (array of call_id). ``results``: conv_id,
    turn, call_id, content. Identifiers hold within a conversation. Returned: conv_id, turn, call_id, status (``linked``,
    ``unanswered`` or ``orphan``), name, position, n_results, result_turn, errors (joined by ``; ``, empty if valid) and
    ``exchange``, canonical JSON of the call and its first result by turn. Of repeated results only the first is
    serialised and all are counted; repeated calls are rows of their own. Null identifiers link to nothing. Arguments that
    are not JSON are an error, and null in the exchange. Empty tables give no rows; further columns are not read.
    """
    first = F.min(F.struct("turn", "content")).alias("first")
    answers = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), first).withColumn("answered", F.lit(True))
    errors = F.array_join(violations(F.col("name"), F.col("arguments"), schemas), "; ")
    calls = topological(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after"))
    calls = calls.select("conv_id", "turn", "call_id", "name", "position", errors.alias("errors"), F.try_parse_json("arguments").alias("arguments"), F.lit(True).alias("called"))
    both = calls.join(answers, ["conv_id", "call_id"], "full")
    exchange = F.to_json(F.try_parse_json(F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", F.col("first.content").alias("result")))))
    return both.select(
        "conv_id",
        "turn",
        "call_id",
        F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked").alias("status"),
        "name",
        "position",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.col("first.turn").alias("result_turn"),
        "errors",
        exchange.alias("exchange"),
    )


#: How the conversations table is read: a user's turn calls ``ask``, or ``follow_up`` if an earlier user's turn may precede it.
SCHEMAS = {
    "ask": {"properties": {"text": {"type": "string", "minLength": 40}, "turn": {"type": "integer"}}, "required": ["text", "turn"], "additionalProperties": False},
    "follow_up": {"properties": {"after": {"type": "string"}, "text": {"type": "string", "minLength": 40, "maxLength": 2000}, "turn": {"type": "integer"}}, "required": ["after", "text", "turn"], "additionalProperties": False},
}


def of_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a table of conv_id, turn, role and text.

    A user's turn n is the call ``conv:n`` that depends on ``conv:n-2``; an assistant's turn n is the result of
    ``conv:n-1``. System turns and other roles are neither.
    """
    name = F.when(F.col("turn") < 2, "ask").otherwise("follow_up")
    ident = lambda back: F.concat_ws(":", "conv_id", F.col("turn") - back)
    after = F.when(F.col("turn") >= 2, ident(2))
    users = messages.where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    calls = users.select(
        "conv_id",
        "turn",
        ident(0).alias("call_id"),
        name.alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text"), after.alias("after"))).alias("arguments"),
        F.array_compact(F.array(after)).alias("after"),
    )
    answers = messages.where("role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    return calls, answers.select("conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))
