"""Chat formatting by tool-call linking, with DataFrame functions only.

Messages are (conv_id, turn, role, text). A text that is a JSON object with ``tool_calls`` (each ``id``, ``name`` and
``arguments``, an object or its JSON text) gives one call a list entry, and its ``content`` stays with the first of them;
one with ``tool_call_id`` (and ``content``) gives a result. An empty ``tool_calls`` gives a message with its content. With ``implicit``, plain exchanges are linked likewise: a user's turn is a call of ``message`` named after
its turn, and the turn after it, if an assistant's, its result. All other messages stay messages.

Calls and results of one conversation are hash-joined by identifier. Each side is first reduced to the first
event a identifier, so a repeated identifier cannot multiply rows; the other events of it link to that one. The
identifiers of over 1/HOT_SHARE of all events, if any, are joined by broadcast. The topological order is
(order_turn, order_rank): calls stand at their turn, and a result at the later of its own turn and its call's, after
it. Sorting a conversation by these keys, turn and seq never puts a result before its call, and so nothing that a
later message makes of that result either; as the keys need no other rows, a conversation of any length is ordered
without meeting in one task.

Arguments are checked against ``schemas``: name -> {"required": [...], "properties": {key: type}}, types string, integer, number,
boolean, object, array. Canonical JSON has keys in order, no spaces and every field.

A text is JSON only as a whole, so one with prose around an object is a plain message; of a repeated key the last value
counts. Arguments that are given and are no object (a list, a number, null, text that is no JSON) violate every schema; such text
stays as it is.

Cases: null, empty and non-JSON texts are plain messages (with null or empty content); a call without arguments has
null ones, which violate any required key; null roles stay null; events whose conv_id or identifier is null link
with nothing; repeated rows give repeated events; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import with_json
from .shared import lookup, write_table

#: The schema of plain messages.
MESSAGE_SCHEMAS = {"message": {"required": ["content"], "properties": {"content": "string"}}}

#: JSON type -> pattern of the names under which a variant reports it.
_TYPES = {
    "string": "STRING",
    "integer": "BIGINT|DECIMAL\\(\\d+,0\\)",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "object": "OBJECT.*",
    "array": "ARRAY.*",
}


def events(messages: DataFrame, implicit: bool = False) -> DataFrame:
    """conv_id, turn, seq, role, kind (call, result, message), call_id, name, arguments (canonical JSON), content."""
    rows = messages.select("conv_id", "turn", "role", "text")
    rows = with_json(rows, "json", F.when(F.ltrim("text").startswith("{"), F.col("text")))
    calls = F.try_variant_get("json", "$.tool_calls", "array<struct<id string, name string, arguments variant>>")
    result_id = F.try_variant_get("json", "$.tool_call_id", "string")
    rows = rows.withColumn("calls", calls).withColumn("result_id", result_id)
    rows = rows.withColumn("calls", F.when(F.size("calls") > 0, F.col("calls")))
    plain = F.col("calls").isNull() & F.col("result_id").isNull()
    told = F.size(F.try_variant_get("json", "$.tool_calls", "array<variant>")) == 0  # an empty list of calls
    content = F.coalesce(F.try_variant_get("json", "$.content", "string"), F.to_json(F.try_variant_get("json", "$.content", "variant")))
    content = F.when(plain & ~F.coalesce(told, F.lit(False)), F.col("text")).otherwise(content)
    rows = rows.select("conv_id", "turn", "role", plain.alias("plain"), "result_id", content.alias("content"), F.posexplode_outer("calls").alias("seq", "call"))
    raw = F.col("call.arguments")
    rows = with_json(rows, "nested", F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string")))  # arguments given as JSON text
    arguments = F.to_json(F.coalesce("nested", raw))
    asks, answers = F.lit(implicit) & F.col("plain") & (F.col("role") == "user"), F.lit(implicit) & F.col("plain") & (F.col("role") == "assistant")
    turn = F.col("turn").cast("string")
    kind = F.when(F.col("call").isNotNull() | asks, "call").when(F.col("result_id").isNotNull() | answers, "result").otherwise("message")
    call_id = F.when(asks, turn).when(answers, (F.col("turn") - 1).cast("string")).otherwise(F.coalesce("call.id", "result_id"))
    return rows.select(
        "conv_id",
        "turn",
        F.coalesce("seq", F.lit(0)).alias("seq"),
        "role",
        kind.alias("kind"),
        call_id.alias("call_id"),
        F.when(asks, F.lit("message")).otherwise(F.col("call.name")).alias("name"),
        F.when(asks & F.col("content").isNotNull(), F.to_json(F.struct("content"))).otherwise(arguments).alias("arguments"),
        F.when(~F.coalesce(asks, F.lit(False)) & (F.coalesce("seq", F.lit(0)) == 0), F.col("content")).alias("content"),
    )


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """The violations of a call's schema, as an array of texts in a fixed order."""
    value = F.try_parse_json(arguments)
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, schema in sorted(schemas.items()):
        properties = schema.get("properties", {})
        checks = []
        for key in schema.get("required", []):
            found = F.try_variant_get(value, f"$['{key}']", "variant")
            checks.append(F.when(found.isNull() | F.is_variant_null(found), F.lit(f"{key} is missing")))
        for key, kind in sorted(properties.items()):
            found = F.try_variant_get(value, f"$['{key}']", "variant")
            wrong = found.isNotNull() & ~F.is_variant_null(found) & ~F.schema_of_variant(found).rlike(f"^(?:{_TYPES[kind]})$")
            checks.append(F.when(wrong, F.lit(f"{key} is no {kind}")))
        known = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, sorted(properties))) if properties else F.array().cast("array<string>"))
        errors = F.concat(known, F.transform(F.array_sort(extra), lambda k: F.concat(k, F.lit(" is not allowed"))))
        out = F.when(name == tool, errors).otherwise(out)
    none = value.isNotNull() & ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(none & name.isin(*schemas), F.array(F.lit("arguments are no object"))).otherwise(out)


def link_calls(messages: DataFrame, schemas: dict[str, dict], implicit: bool = False) -> DataFrame:
    """conv_id, turn, seq, kind, call_id, linked_turn, order_turn, order_rank, valid, errors, json of every event of ``messages``."""
    # one key of both columns: a struct, so that no two pairs are written alike
    held = write_table(events(messages, implicit).withColumn("link", F.struct("conv_id", "call_id")), "events")
    tied = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & (F.col("kind") != "message")
    ends = held.filter(tied)
    groups = ends.groupBy("link").agg(
        F.min(F.when(F.col("kind") == "call", F.col("turn"))).alias("call_turn"),
        F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("result_turn"),
        F.count("*").alias("events"),
    )
    groups = write_table(groups, "identifiers")
    linked = lookup(ends, groups, "link", "events", ends.count(), hint="shuffle_hash").drop("events")
    rest = held.filter(~tied).withColumn("call_turn", F.lit(None).cast("long")).withColumn("result_turn", F.lit(None).cast("long"))
    rows = linked.withColumn("call_turn", F.col("call_turn").cast("long")).withColumn("result_turn", F.col("result_turn").cast("long")).unionByName(rest)
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    errors = F.when(is_call, argument_errors(F.col("name"), F.col("arguments"), schemas))
    errors = errors.when(is_result & F.col("call_turn").isNull(), F.array(F.lit("no call has this identifier")))
    rows = rows.withColumn("errors", F.coalesce(errors, F.array().cast("array<string>")))
    linked_turn = F.when(is_call, F.col("result_turn")).when(is_result, F.col("call_turn"))
    rows = rows.withColumn("linked_turn", linked_turn).withColumn("args", F.try_parse_json("arguments"))
    fields = F.struct(F.col("args").alias("arguments"), "call_id", "content", "kind", "linked_turn", "name", "role", "turn")
    return rows.select(
        "conv_id",
        "turn",
        "seq",
        "kind",
        "call_id",
        "linked_turn",
        F.when(is_result, F.greatest(F.col("turn").cast("long"), "call_turn")).otherwise(F.col("turn").cast("long")).alias("order_turn"),
        F.when(is_result, 1).otherwise(0).alias("order_rank"),
        (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"),
        F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"),
    )


ORACLE = """
WITH e AS (
  SELECT conv_id, turn, role, text,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS id
  FROM conversations
), l AS (
  SELECT e.*, CASE WHEN e.kind <> 'message' THEN
           (SELECT min(o.turn) FROM e o WHERE o.conv_id = e.conv_id AND o.id = e.id AND o.kind <> 'message' AND o.kind <> e.kind) END AS linked_turn
  FROM e
), v AS (
  SELECT *, CASE WHEN kind = 'call' AND text IS NULL THEN 'content is missing'
                 WHEN kind = 'result' AND linked_turn IS NULL THEN 'no call has this identifier' ELSE '' END AS errors
  FROM l
)
SELECT conv_id, turn, 0 AS seq, kind, CAST(id AS VARCHAR) AS call_id, CAST(linked_turn AS BIGINT) AS linked_turn,
       CAST(CASE WHEN kind = 'result' THEN greatest(turn, linked_turn) ELSE turn END AS BIGINT) AS order_turn,
       CASE WHEN kind = 'result' THEN 1 ELSE 0 END AS order_rank, errors = '' AS valid, errors,
       CAST(json_object('arguments', CASE WHEN kind = 'call' AND text IS NOT NULL THEN json_object('content', text) END,
                        'call_id', CAST(id AS VARCHAR), 'content', CASE WHEN kind <> 'call' THEN text END, 'kind', kind,
                        'linked_turn', linked_turn, 'name', CASE WHEN kind = 'call' THEN 'message' END,
                        'role', role, 'turn', turn) AS VARCHAR) AS json
FROM v
"""


#: The tool that ``calls_of_orders`` calls.
ORDER_SCHEMAS = {"order": {"required": ["key", "status"], "properties": {"key": "integer", "status": "string", "rush": "boolean"}}}


def calls_of_orders(orders: DataFrame) -> DataFrame:
    """Orders as messages (conv_id, turn, role, text) of agents: every customer is a conversation.

    An order is a call, in three of four also answered by a message after all calls. One call in five gives its
    arguments as JSON text, one in seven lacks its status, one in six has a misplaced one, one in nine a key more; every
    eleventh order is an empty list of calls.
    """
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    status = F.when(key % 7 == 0, "").otherwise(F.when(key % 6 == 0, ',"status":1').otherwise(F.concat(F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"'))))
    more = F.when(key % 9 == 0, ',"zone":null').otherwise("")
    arguments = F.concat(F.lit('{"rush":true,"key":'), text, status, more, F.lit("}"))
    given = F.when(key % 5 == 0, F.to_json(F.struct(arguments.alias("arguments")))).otherwise(F.concat(F.lit('{"arguments":'), arguments, F.lit("}")))
    call = F.concat(F.lit('{"content":"placing '), text, F.lit('","tool_calls":[{"id":"o'), (key % 50).cast("string"), F.lit('","name":"order",'), F.substring(given, 2, 10_000), F.lit("]}"))
    empty = F.concat(F.lit('{"tool_calls":[],"content":"nothing for '), text, F.lit('"}'))
    calls = orders.select(F.col("o_custkey").alias("conv_id"), key.alias("turn"), F.lit("assistant").alias("role"), F.when(key % 11 == 0, empty).otherwise(call).alias("text"))
    answer = F.concat(F.lit('{"tool_call_id":"o'), (key % 50).cast("string"), F.lit('","content":"done '), text, F.lit('"}'))
    answers = orders.filter("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("conv_id"), (key + 10_000_000).alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    return calls.unionByName(answers)


ORDERS_ORACLE = """
WITH c AS (
  SELECT o_custkey AS conv_id, o_orderkey AS turn, 'assistant' AS role, CASE WHEN o_orderkey % 11 = 0 THEN 'message' ELSE 'call' END AS kind,
         CASE WHEN o_orderkey % 11 <> 0 THEN 'o' || CAST(o_orderkey % 50 AS VARCHAR) END AS call_id,
         CASE WHEN o_orderkey % 11 = 0 THEN 'nothing for ' ELSE 'placing ' END || CAST(o_orderkey AS VARCHAR) AS content,
         CASE WHEN o_orderkey % 11 <> 0 THEN '{"key":' || CAST(o_orderkey AS VARCHAR) || ',"rush":true' || CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 6 = 0 THEN ',"status":1' ELSE ',"status":"' || o_orderstatus || '"' END
           || CASE WHEN o_orderkey % 9 = 0 THEN ',"zone":null' ELSE '' END || '}' END AS arguments,
         array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'status is missing' WHEN o_orderkey % 6 = 0 THEN 'status is no string' END,
           CASE WHEN o_orderkey % 9 = 0 THEN 'zone is not allowed' END], lambda x: x IS NOT NULL), '; ') AS wrong
  FROM orders
  UNION ALL
  SELECT o_custkey, o_orderkey + 10000000, 'tool', 'result', 'o' || CAST(o_orderkey % 50 AS VARCHAR), 'done ' || CAST(o_orderkey AS VARCHAR), NULL, '' FROM orders WHERE o_orderkey % 4 <> 0
), l AS (
  SELECT *, CASE WHEN kind <> 'message' THEN min(turn) FILTER (WHERE kind = 'call') OVER w END AS call_turn, CASE WHEN kind <> 'message' THEN min(turn) FILTER (WHERE kind = 'result') OVER w END AS result_turn
  FROM c WINDOW w AS (PARTITION BY conv_id, call_id)
), v AS (
  SELECT *, CASE kind WHEN 'call' THEN result_turn WHEN 'result' THEN call_turn END AS linked_turn,
         CASE WHEN kind = 'call' THEN wrong WHEN kind = 'result' AND call_turn IS NULL THEN 'no call has this identifier' ELSE '' END AS errors FROM l
)
SELECT conv_id, turn, 0 AS seq, kind, call_id, linked_turn, CASE WHEN kind = 'result' THEN greatest(turn, call_turn) ELSE turn END AS order_turn, CASE WHEN kind = 'result' THEN 1 ELSE 0 END AS order_rank,
       errors = '' AS valid, errors,
       '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":' || coalesce('"' || call_id || '"', 'null') || ',"content":"' || content || '","kind":"' || kind || '","linked_turn":' || coalesce(CAST(linked_turn AS VARCHAR), 'null')
       || ',"name":' || CASE WHEN kind = 'call' THEN '"order"' ELSE 'null' END || ',"role":"' || role || '","turn":' || CAST(turn AS VARCHAR) || '}' AS json
FROM v
"""
