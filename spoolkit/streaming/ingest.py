"""Streams of captured calls and of transcripts.

``available_now`` runs what has arrived and stops, so a schedule of runs keeps
a table current; the checkpoint replaces file cursors.  Pairing calls with late
results needs a watermark, which is new here: a result later than it is an
orphan of the stream, while a batch over all files still pairs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolkit.functions.commands import cmd_head
from spoolkit.functions.text import CAPTURE_REDACTIONS, redact
from spoolkit.operators.sessionize import content_text

CAPTURE_SCHEMA = "ts string, session_id string, cwd string, tool string, ok boolean, exit_code int, is_error boolean, cmd_head string, input_digest string"


#: Where a response's text may be, in order, and tools that return exit codes.
_TEXTS = ("output", "stdout", "stderr", "content", "text", "message")
_SHELL = "(?i)^(bash|shell|terminal)$"


def response_text(response: Column) -> Column:
    """The first text of a response: itself, or the first of its fields that holds any, in turn as text, list or object."""
    plain = lambda v: F.nullif(content_text(v), F.lit(""))
    inner = lambda k: (F.nullif(F.try_variant_get(response, f"$.{k}.{n}", "string"), F.lit("")) for n in _TEXTS)
    nested = [F.coalesce(plain(F.try_variant_get(response, f"$.{k}", "variant")), *inner(k)) for k in _TEXTS]
    return F.coalesce(plain(response), *nested, F.lit(""))


def _field(value: Column, names: tuple[str, ...], shape: str) -> Column:
    """A field of an object by one of its names: at the top, or else the first in the object's JSON."""
    top = [F.try_variant_get(value, f"$.{n}", "string") for n in names]
    deep = F.nullif(F.regexp_extract(F.to_json(value), r'(?<!\\)"(?:' + "|".join(names) + r')"\s*:\s*' + shape, 1), F.lit(""))
    return F.coalesce(*top, deep)


def capture_rows(events: DataFrame) -> DataFrame:
    """Hook events (VARIANT ``event``) to capture rows.

    Strings are redacted; the input is digested after redaction (16 hex digits).
    A shell's exit code comes from the response's field at any depth, from its
    text, or from its error flag; other tools have 1 with the flag and 0 without.
    """
    at = lambda p, t="string": F.try_variant_get("event", p, t)
    tool = F.coalesce(at("$.tool_name"), at("$.tool"), F.lit("unknown"))
    given = F.coalesce(*(F.when(F.schema_of_variant(x).startswith("OBJECT"), x) for x in (at("$.tool_input", "variant"), at("$.input", "variant"))), F.parse_json(F.lit("{}")))
    response = F.coalesce(*(at(f"$.{k}", "variant") for k in ("tool_response", "tool_output", "result", "output")))
    staged = events.select(
        "ts", F.coalesce(at("$.session_id"), at("$.sessionId"), F.lit("unknown")).alias("session_id"), F.coalesce(at("$.cwd"), F.try_variant_get(given, "$.cwd", "string"), F.lit("unknown")).alias("cwd"),
        tool.alias("tool"), given.alias("given"), response.alias("response"), F.coalesce(at("$.is_error", "boolean"), F.lit(False)).alias("flag"),
    )
    r = F.col("response")
    is_error = F.col("flag") | F.coalesce(_field(r, ("is_error", "isError"), "(true|false)") == "true", F.lit(False))
    said = F.regexp_extract(response_text(r), r"(?i)^\s*Exit code\s+(-?\d+)\b", 1)
    structured = F.regexp_extract(F.trim(_field(r, ("exitCode", "exit_code"), r'"?(-?\d+)"?')), r"^(-?\d+)\z", 1)
    number = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    found = staged.withColumn("is_error", is_error).withColumn("exit_code", F.when(F.col("tool").rlike(_SHELL), F.coalesce(number(structured), number(said), F.col("is_error").cast("int"))).otherwise(F.col("is_error").cast("int")))
    text = lambda p: F.try_variant_get("given", p, "string")
    head = cmd_head(F.col("tool"), text("$.command"), F.coalesce(text("$.file_path"), text("$.path")))
    shown = lambda c: redact(c, CAPTURE_REDACTIONS)
    return found.select(
        "ts", shown(F.col("session_id")).alias("session_id"), shown(F.col("cwd")).alias("cwd"), shown(F.col("tool")).alias("tool"), ((F.col("exit_code") == 0) & ~F.col("is_error")).alias("ok"),
        "exit_code", "is_error", shown(head).alias("cmd_head"), F.substring(F.sha2(shown(F.to_json("given")), 256), 1, 16).alias("input_digest"),
    )


def appended(spark: SparkSession, source: str, table: str, checkpoint: str, keys: tuple[str, ...] = ("session_id", "ts", "input_digest")):
    """Append what has arrived in ``source`` to ``table`` by ``part`` of the day, rows that are there already (by ``keys``) left out.

    Each batch is made distinct and compared with the same days of the table
    only, so a batch that runs again adds nothing.  A day's folder takes the
    place of a rotated file.
    """
    rows = spark.readStream.schema(CAPTURE_SCHEMA).json(source).withColumn("day", F.coalesce(F.substring("ts", 1, 10), F.lit("none")))

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(list(keys))
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            days = batch.select("day").distinct()
            there = session.read.schema(new.schema).parquet(table).join(F.broadcast(days), "day", "left_semi").select(*keys)  # a batch has few days
            same = [new[k].eqNullSafe(there[k]) for k in keys]
            # sorted on both sides: columns of few values make a small file of many rows, which would be sent to every task
            new = new.join(there.hint("merge"), same, "left_anti")
        new.write.mode("append").partitionBy("day").parquet(table)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_captures(spark: SparkSession, source: str, table: str, checkpoint: str):
    """Append what has arrived in ``source`` (JSON lines of capture rows) to Parquet files in ``table``."""
    return append_stream(spark.readStream.schema(CAPTURE_SCHEMA).json(source), table, checkpoint)


def paired_stream(calls: DataFrame, results: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``call_id, what, call_ts, result_ts`` and the results' other columns: each call with its results within ``late`` after it, and each of either without a partner.

    ``what`` is paired, call or result.  Two streams (call_id, ts, ...) meet in a
    full outer join under their watermarks: a row without a partner is given out
    once, when the watermark has passed the time in which one could come, so the
    last ones wait for later rows.  A row that comes behind the watermark is
    dropped; its partner then is given out alone.  On batches it is a plain join,
    and nothing is late.
    """
    others = [c for c in results.columns if c not in ("call_id", "ts")]
    a = calls.select("call_id", F.col("ts").alias("call_ts")).withWatermark("call_ts", late).alias("c")
    b = results.select(F.col("call_id").alias("result_id"), F.col("ts").alias("result_ts"), *others).withWatermark("result_ts", late).alias("r")
    met = a.join(b, F.expr(f"call_id = result_id and result_ts >= call_ts and result_ts <= call_ts + interval {late}"), "fullOuter")
    what = F.when(F.col("call_ts").isNull(), "result").when(F.col("result_ts").isNull(), "call").otherwise("paired")
    return met.select(F.coalesce("call_id", "result_id").alias("call_id"), what.alias("what"), "call_ts", "result_ts", *others)


def append_stream(rows: DataFrame, table: str, checkpoint: str):
    """Append what a stream gives out now to Parquet files in ``table``, each row once, and stop."""
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by UTC day and type, final once the watermark has passed the day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
