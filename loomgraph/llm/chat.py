"""Chat formatting with tool-call linking, DataFrame operations only.

Marks in a message's text (all optional):

* ``<tools>[{"name", "parameters"}, ...]</tools>`` in a system message: schemas,
  with JSON Schema's ``properties`` (``type``, ``enum``), ``required`` and
  ``additionalProperties``;
* ``<tool_call>{"id", "name", "arguments", "depends_on"}</tool_call>`` in an
  assistant message; a value ``"${id}"`` among the arguments also makes the call
  depend on the call of that id;
* ``<tool_response>{"tool_call_id" or "id", "content"}</tool_response>`` in a
  message of role ``tool``, or a whole text that is such an object.

Calls and results meet in a hash join by (conversation, identifier).  Calls get
topological levels by rounds over the dependency edges: a call's level is one
more than the highest of those it needs.  Arguments are validated against the
schema of the call's name.  Every message becomes one canonical JSON object:
keys in code point order, no white space, arguments as JSON again.

Work is spread by message, by call identifier and by edge, never by whole
conversation, so a conversation with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, table

_CALL, _RESULT, _TOOLS = "(?s)<tool_call>(.*?)</tool_call>", "(?s)<tool_response>(.*?)</tool_response>", "(?s)<tools>(.*?)</tools>"
_SCHEMA = "array<struct<name:string,parameters:struct<properties:map<string,struct<type:string,enum:array<string>>>,required:array<string>,additionalProperties:string>>>"
#: JSON Schema's names and the types a variant shows for them.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*", "null": "VOID"}


def _marked(text: str, mark: str):
    return F.regexp_extract_all(F.col(text), F.lit(mark), F.lit(1))


def calls_of(messages: DataFrame) -> DataFrame:
    """msg, conv, turn, place, id, name, arguments (variant), needs: the calls of assistant messages.

    A call that is no JSON object has a null id and name and never links.
    """
    raw = messages.where((F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))).select("msg", "conv", "turn", F.posexplode(_marked("text", _CALL)).alias("place", "body"))
    parsed = raw.withColumn("call", F.try_parse_json("body"))
    text = lambda path: F.try_variant_get("call", path, "string")
    arguments = F.coalesce(F.try_variant_get("call", "$.arguments", "variant"), F.parse_json(F.lit("{}")))
    named = F.regexp_extract_all(F.to_json(arguments), F.lit(r'"\$\{([^"}]*)\}"'), F.lit(1))
    listed = F.coalesce(F.try_variant_get("call", "$.depends_on", "array<string>"), F.array().cast("array<string>"))
    return parsed.select("msg", "conv", "turn", "place", text("$.id").alias("id"), text("$.name").alias("name"), arguments.alias("arguments"), F.array_distinct(F.concat(listed, named)).alias("needs"))


def results_of(messages: DataFrame) -> DataFrame:
    """conv, id, turn, place, result: the results in messages of role tool."""
    tool = messages.where(F.col("role") == "tool")
    bodies = F.when(F.contains("text", F.lit("<tool_response>")), _marked("text", _RESULT)).otherwise(F.array(F.coalesce("text", F.lit(""))))
    raw = tool.select("conv", "turn", "msg", F.posexplode(bodies).alias("place", "body")).withColumn("one", F.try_parse_json("body"))
    ident = F.coalesce(F.try_variant_get("one", "$.tool_call_id", "string"), F.try_variant_get("one", "$.id", "string"))
    return raw.select("conv", ident.alias("id"), "turn", "msg", "place", F.try_variant_get("one", "$.content", "variant").alias("result")).where("id IS NOT NULL")


def levels(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """call, level: Kahn's rounds over ``edges`` (call, needs); calls in or behind a cycle have level -1.

    ``calls`` has the column call.  Each round is one join and one aggregation
    over the edges that are left; there are as many rounds as levels.
    """
    left = keep(edges.join(calls.select(F.col("call").alias("needs")), "needs", "left_semi").select("call", "needs").distinct(), "chat-edges")
    waiting = calls.select("call")
    done, level = None, 0
    while not left.isEmpty():
        ready = keep(waiting.join(left.select("call").distinct(), "call", "left_anti").withColumn("level", F.lit(level)), "chat-level")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        waiting = keep(waiting.join(ready, "call", "left_anti"), "chat-waiting")
        left = keep(left.join(ready.select(F.col("call").alias("needs")), "needs", "left_anti").select("call", "needs"), "chat-edges")
        level += 1
    last = waiting.withColumn("level", F.lit(level if left.isEmpty() else -1))
    return last if done is None else done.unionByName(last)


def validity(arguments, schema):
    """Errors of an arguments variant against a schema struct, sorted; null without a schema.

    Arguments are checked at the top level: what is inside objects and arrays is not.
    """
    got = F.from_json(F.to_json(arguments), "map<string,variant>")
    text = F.from_json(F.to_json(arguments), "map<string,string>")
    props = F.coalesce(schema["properties"], F.from_json(F.lit("{}"), "map<string,struct<type:string,enum:array<string>>>"))
    names = F.coalesce(F.map_keys(got), F.array().cast("array<string>"))
    missing = F.transform(F.filter(F.coalesce(schema["required"], F.array().cast("array<string>")), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("missing:"), k))
    extra = F.when(schema["additionalProperties"] == "false", F.transform(F.filter(names, lambda k: ~F.array_contains(F.map_keys(props), k)), lambda k: F.concat(F.lit("unknown:"), k))).otherwise(F.array().cast("array<string>"))

    def fits(k):
        shown, type_ = F.schema_of_variant(F.element_at(got, k)), F.element_at(props, k)["type"]
        # a type is a name, or a list of them (as JSON text here)
        either = F.concat_ws("|", *[F.when((type_ == name) | F.contains(type_, F.lit(f'"{name}"')), types) for name, types in _KINDS.items()])
        pattern = F.when(either == "", ".*").otherwise(F.concat(F.lit("^("), either, F.lit(")$")))
        later = F.regexp_like(F.coalesce(F.element_at(text, k), F.lit("")), F.lit(r"^\$\{[^}]*\}$"))  # another call's result, not yet known
        return later | F.regexp_like(shown, pattern)

    known = F.filter(names, lambda k: F.array_contains(F.map_keys(props), k))
    wrong = F.transform(F.filter(known, lambda k: ~fits(k)), lambda k: F.concat(F.lit("type:"), k))
    outside = F.transform(F.filter(known, lambda k: F.coalesce(~F.array_contains(F.element_at(props, k)["enum"], F.element_at(text, k)), F.lit(False))), lambda k: F.concat(F.lit("enum:"), k))
    return F.when(schema.isNotNull(), F.array_sort(F.concat(missing, extra, wrong, outside)))


def format_chats(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv, turn, role, n_calls, n_linked, n_invalid, message (canonical JSON).

    A null text is null content; rows that repeat or tie in their turn stay as
    they are, one message each.  Of several calls or results with one
    identifier in a conversation the first (turn, row, place) links.  Calls in
    or behind a dependency cycle have level -1.  A call without a result has a
    null result, a call without a schema null errors.  Other columns do not
    matter; an empty table gives an empty table.
    """
    one = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    messages = keep(one.withColumn("msg", F.monotonically_increasing_id()), "chat-messages")
    calls = keep(calls_of(messages).withColumn("call", F.struct("msg", "place")), "chat-calls")

    owners = calls.where("id IS NOT NULL").groupBy("conv", "id").agg(F.min(F.struct("turn", "msg", "place")).alias("first")).select("conv", "id", F.struct("first.msg", "first.place").alias("call"))
    first = results_of(messages).groupBy("conv", "id").agg(F.min_by("result", F.struct("turn", "msg", "place")).alias("result"), F.lit(True).alias("answered"))
    linked = owners.join(first.hint("shuffle_hash"), ["conv", "id"]).select("call", "result", "answered")
    edges = calls.select("conv", "call", F.explode("needs").alias("id")).join(owners.withColumnRenamed("call", "needs"), ["conv", "id"]).select("call", "needs")
    level = levels(edges, calls)
    tools = messages.where((F.col("role") == "system") & F.contains("text", F.lit("<tools>"))).select("conv", "turn", "msg", F.explode(_marked("text", _TOOLS)).alias("body"))
    tools = tools.select("conv", "turn", "msg", F.posexplode(F.from_json("body", _SCHEMA)).alias("place", "tool")).where("tool.name IS NOT NULL")
    schemas = tools.groupBy("conv", F.col("tool.name").alias("name")).agg(F.min_by("tool.parameters", F.struct("turn", "msg", "place")).alias("schema"))
    full = calls.join(level, "call", "left").join(linked, "call", "left").join(schemas, ["conv", "name"], "left")
    full = full.withColumn("errors", validity(F.col("arguments"), F.col("schema")))
    shown = F.struct(F.col("arguments"), F.col("errors"), F.col("id"), F.col("level"), F.col("name"), F.col("result"))
    per = full.groupBy("msg").agg(  # the calls of one message
        F.transform(F.array_sort(F.collect_list(F.struct("level", "place", F.to_json(shown, {"ignoreNullFields": "false"}).alias("json")))), lambda c: c["json"]).alias("shown"),
        F.count("*").alias("n_calls"), F.count("answered").alias("n_linked"), F.sum((F.size("errors") > 0).cast("int")).alias("n_invalid"),
    )
    joined = messages.join(per, "msg", "left")
    content = F.when(F.col("n_calls") > 0, F.regexp_replace("text", _CALL, "")).otherwise(F.col("text"))
    rest = F.to_json(F.struct(content.alias("content"), F.col("role")), {"ignoreNullFields": "false"})
    message = F.concat(F.expr("substring(_rest, 1, length(_rest) - 1)"), F.lit(',"tool_calls":['), F.coalesce(F.array_join("shown", ","), F.lit("")), F.lit("]}"))
    out = joined.withColumn("_rest", rest).withColumn("message", message)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv", "turn", "role", zero("n_calls"), zero("n_linked"), zero("n_invalid"), "message")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


#: Holds for tables without tool calls, such as the given ones; tests cover calls by brute force.
OP7_SQL = """
SELECT conv_id, turn, role, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid,
       '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"tool_calls":[]}' AS message
FROM conversations
"""
