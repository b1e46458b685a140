"""Tool-call linking for chat transcripts, on DataFrame functions alone.

Messages (conv_id, turn, role, text) become events:

- an assistant's text that is a JSON object with ``tool_calls`` (id, name,
  arguments, or id and ``function`` with the other two) holds one call for each;
  arguments may be an object or the JSON of one in a string; a tool's text that is
  a JSON object with ``tool_call_id`` (and ``content``) is the result of that call;
- a plain user turn is a call of the tool ``reply`` with the text as its
  argument, named by its turn; a plain assistant turn is the result of the call
  named by the turn before;
- all else is a note.  JSON that repeats a key is no JSON here.

Calls and results meet in hash joins on their identifier; of several with one
identifier the first (by turn, place and content) is linked, so a repeated
identifier makes no pairs, and events take their links up by their own name, which
is unique.  An event comes after its parent: a result after its call, any other
event after what the turn before holds.  Levels of this forest come from pointer
doubling, a number of joins that is logarithmic in the longest chain; events on a
cycle, or below one, have no level.  ``position`` numbers all events in an order
in which each comes after its parent: by conversation, level, turn, place and name.

Arguments are JSON values (VARIANT) and keep their types: they are checked against
the tool's schema, and each event is written as JSON with sorted keys at every
depth and no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.storage import stored

#: The schema of each tool: field to type ("string", "number", "integer", "boolean"), whether it must be there, and bounds of its length.
Schemas = dict[str, dict[str, dict]]
REPLY: Schemas = {"reply": {"text": {"type": "string", "required": True, "min_length": 1, "max_length": 100_000}}}

#: What a field's value may be, as VARIANT types.
_TYPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))


def events_of(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, place, role, copies, kind, call_id, tool, arguments, content``; equal messages are one event; ``arguments`` is canonical JSON."""
    one = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    parsed = one.withColumn("v", F.when(F.col("text").rlike(r"^[ \t\r\n]*\{"), F.try_parse_json("text")))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    spread = parsed.withColumn("calls", calls).withColumn("plain", F.coalesce(F.size("calls") <= 0, F.lit(True))).select("*", F.posexplode_outer("calls").alias("place", "call"))
    raw = F.coalesce(F.try_variant_get("call", "$.arguments", "variant"), F.try_variant_get("call", "$.function.arguments", "variant"))
    spelt = spread.withColumn("raw", raw).withColumn("given", F.when(F.schema_of_variant("raw") == "STRING", F.try_parse_json(F.try_variant_get("raw", "$", "string"))).otherwise(F.col("raw")))
    reply = F.col("role") == "user"
    is_call = F.coalesce(reply, F.lit(False)) | F.col("call").isNotNull()
    named = F.when(F.col("role") == "tool", _text(F.col("v"), "$.tool_call_id")).when((F.col("role") == "assistant") & F.col("plain"), F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")))
    own = F.when(reply, F.concat(F.lit("turn-"), F.col("turn").cast("string"))).when(F.col("call").isNotNull(), _text(F.col("call"), "$.id")).otherwise(named)
    kind = F.when(is_call, "call").when(named.isNotNull(), "result").otherwise("note")
    return spelt.select(
        "conv_id", "turn", F.coalesce("place", F.lit(0)).alias("place"), "role", "copies", kind.alias("kind"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), own).alias("call_id"),
        F.when(reply, "reply").otherwise(_text(F.col("call"), "$.name", "$.function.name")).alias("tool"),
        F.when(reply, F.to_json(F.struct("text"), {"ignoreNullFields": "true"})).when(is_call, F.to_json("given")).alias("arguments"),
        F.when(~is_call, F.when(F.col("role") == "tool", F.coalesce(_text(F.col("v"), "$.content"), F.to_json(F.try_variant_get("v", "$.content", "variant")), "text")).otherwise(F.col("text"))).alias("content"),
    )


def argument_errors(schemas: Schemas, tool: Column, arguments: Column) -> Column:
    """What is wrong with the arguments (VARIANT), sorted: missing, type, short, long, unknown, each with the field's name; or that they are no object."""
    nothing = F.array().cast("array<string>")
    keys = F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>"))
    found = F.when(tool.isNull() | ~tool.isin(list(schemas)), F.array(F.lit("unknown tool"))).when(keys.isNull(), F.array(F.lit("not an object")))
    for name, fields in sorted(schemas.items()):
        checks = []
        for field, rule in sorted(fields.items()):
            path = "$['" + field.replace("'", "\\'") + "']"
            kind = F.coalesce(F.schema_of_variant(F.try_variant_get(arguments, path, "variant")), F.lit("VOID"))
            there, text = kind != "VOID", F.when(kind == "STRING", F.try_variant_get(arguments, path, "string"))
            if rule.get("required"):
                checks.append(F.when(~there, f"missing {field}"))
            checks.append(F.when(there & ~kind.rlike(_TYPES[rule.get("type", "string")]), f"type {field}"))
            if "min_length" in rule:
                checks.append(F.when(F.length(text) < rule["min_length"], f"short {field}"))
            if "max_length" in rule:
                checks.append(F.when(F.length(text) > rule["max_length"], f"long {field}"))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(fields)))), lambda k: F.concat(F.lit("unknown "), k))
        found = found.when(tool == name, F.array_sort(F.concat(F.array_compact(F.array(*checks)) if checks else nothing, F.coalesce(extra, nothing))))
    return found


def levels(nodes: DataFrame) -> DataFrame:
    """``node, level`` of a forest given as ``node, parent`` (each node once): the number of ancestors.

    A parent that is no node counts as none.  Nodes on a cycle or below one
    have a null level.
    """
    ids = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("real"))
    root = F.lit(0).cast("long").alias("level")
    tops = nodes.where("parent is null").select("node", F.lit(None).cast("string").alias("up"), root)  # many, so they take no part in the join
    below = nodes.where("parent is not null").join(ids, "parent", "left").select("node", F.when(F.col("real"), F.col("parent")).alias("up"), F.when(F.col("real"), 1).otherwise(0).cast("long").alias("level"))
    at = stored(below.unionByName(tops), "levels")
    rounds = max(1, at.count()).bit_length()
    settled = at.where("up is null")
    rising = at.where("up is not null")
    for _ in range(rounds):
        if rising.isEmpty():
            break
        # only what still rises is joined; what it meets may have settled long ago
        above = settled.unionByName(rising).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        at = stored(rising.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        settled = settled.unionByName(at.where("up is null"))
        rising = at.where("up is not null")
    return settled.select("node", "level").unionByName(rising.select("node", F.lit(None).cast("long").alias("level")))


def json_text(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(text.alias("c")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def canonical_json(event: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and without nulls and spaces; the values are JSON."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), event[k]) for k in sorted(event))), F.lit("}"))


def _positions(events: DataFrame) -> DataFrame:
    """``node, position``: the place of each event in the order of conv_id, level (null last), turn, place and node, from 0.

    Ranges of the order are sorted and counted apart, so no conversation is one
    task's work.
    """
    key = ("conv_id", "last", "level", "turn", "place", "node")
    keyed = events.withColumn("last", F.col("level").isNull()).select(*key)
    placed = stored(keyed.repartitionByRange(*key).sortWithinPartitions(*key).select("node", F.monotonically_increasing_id().alias("at")), "positions")
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))  # a row for each range
    return placed.withColumn("part", part).join(F.broadcast(before.select("part", "before")), "part").select("node", (F.col("before") + nth).alias("position"))


def linked_events(messages: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row for each event of ``messages``, with its link, level, position, errors and JSON.

    ``conv_id, turn, place, role, kind, call_id, copies, linked, level, position,
    errors, record``.  Nulls: a null conv_id or turn gives an event without link
    and level (without conv_id no identifier either); a null role or text gives a
    note, or a call whose argument is missing.  Equal messages are one event with
    ``copies``; different messages of one turn are events of their own, of which
    the first (by place, role, content) stands for the turn.  Arguments that
    aren't an object, or are too large for a VARIANT, are an error.  An empty
    table gives no rows; other columns are ignored.
    """
    schemas = schemas or REPLY
    order = F.struct("turn", "place", "role", F.coalesce("arguments", F.lit("")).alias("a"), F.coalesce("content", F.lit("")).alias("c"))
    node = F.sha2(F.to_json(F.struct("conv_id", order.alias("o"), "call_id", "tool")), 256)
    events = stored(events_of(messages).withColumn("order", order).withColumn("node", node), "events")

    named = events.where("call_id is not null and conv_id is not null and turn is not null")
    first = lambda kind: named.where(F.col("kind") == kind).groupBy("call_id").agg(F.min(F.struct("order", "node")).alias("x")).select("call_id", F.col("x.node").alias(f"first_{kind}"))
    pairs = first("call").hint("shuffle_hash").join(first("result"), "call_id")
    # both ends of a link, by the event's own name: however often an identifier occurs, no name does twice
    ends = F.explode(F.array(F.struct(F.col("first_call").alias("node"), F.lit(None).cast("string").alias("caller")), F.struct(F.col("first_result").alias("node"), F.col("first_call").alias("caller"))))
    links = pairs.select(ends.alias("e")).select("e.node", "e.caller", F.lit(True).alias("linked"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    of_turn = events.where(whole).groupBy("conv_id", "turn").agg(F.min(F.struct("order", "node")).alias("x")).select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("x.node").alias("before"))
    chained = events.where(whole).join(of_turn, ["conv_id", "turn"], "left").select("node", "before")
    parents = chained.join(links.hint("shuffle_hash"), "node", "left").select("node", F.coalesce("caller", "before").alias("parent"), F.coalesce("linked", F.lit(False)).alias("linked"))
    parents = stored(parents, "parents")
    leveled = events.where(whole).drop("order").join(parents, "node").join(levels(parents.select("node", "parent")), "node", "left").drop("parent")
    rest = events.where(~whole).drop("order").withColumn("linked", F.lit(False)).withColumn("level", F.lit(None).cast("long"))
    every = stored(leveled.unionByName(rest), "leveled")
    placed = every.join(_positions(every), "node")
    errors = F.when(F.col("kind") == "call", argument_errors(schemas, F.col("tool"), F.try_parse_json("arguments"))).otherwise(F.array().cast("array<string>"))
    event = {"arguments": F.col("arguments"), "content": json_text(F.col("content")), "id": json_text(F.col("call_id")), "kind": json_text(F.col("kind")), "linked": F.col("linked").cast("string"), "role": json_text(F.col("role")), "tool": json_text(F.col("tool")), "turn": F.col("turn").cast("string")}
    return placed.select("conv_id", "turn", "place", "role", "kind", "call_id", "copies", "linked", "level", "position", F.array_join(errors, "; ").alias("errors"), canonical_json(event).alias("record"))


#: ``op10_tool_calls`` over plain conversations, where each turn holds one message and none is JSON.
ORACLE_SQL = """
WITH one AS (
  SELECT conv_id, turn, role, text, count(*) AS copies FROM conversations GROUP BY ALL
), kinds AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'note' END AS kind,
    CASE role WHEN 'user' THEN conv_id || ':turn-' || turn WHEN 'assistant' THEN conv_id || ':turn-' || (turn - 1) END AS call_id
  FROM one
), met AS (
  SELECT k.*, o.conv_id IS NOT NULL AS linked,
    turn - row_number() OVER (PARTITION BY k.conv_id ORDER BY turn) AS run
  FROM kinds k LEFT JOIN (SELECT DISTINCT conv_id, call_id, kind FROM kinds WHERE call_id IS NOT NULL) o
    ON o.call_id = k.call_id AND o.kind <> k.kind
), placed AS (
  SELECT *, turn - min(turn) OVER (PARTITION BY conv_id, run) AS level FROM met
)
SELECT conv_id, turn, 0 AS place, role, kind, call_id, copies, linked, level, row_number() OVER (ORDER BY conv_id, level, turn) - 1 AS position,
  CASE WHEN kind = 'call' AND length(text) < 1 THEN 'short text' WHEN kind = 'call' AND length(text) > 100000 THEN 'long text' ELSE '' END AS errors,
  CAST(CASE kind
    WHEN 'call' THEN json_object('arguments', json_object('text', text), 'id', call_id, 'kind', kind, 'linked', linked, 'role', role, 'tool', 'reply', 'turn', turn)
    WHEN 'result' THEN json_object('content', text, 'id', call_id, 'kind', kind, 'linked', linked, 'role', role, 'turn', turn)
    ELSE json_object('content', text, 'kind', kind, 'linked', linked, 'role', role, 'turn', turn) END AS VARCHAR) AS record
FROM placed
"""
