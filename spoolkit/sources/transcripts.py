"""Transcripts (JSON lines) as a table of records, and episode tables.

Lines are parsed into VARIANT, so unions of types need no inference; a line
that isn't a JSON object is counted, never fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("user", "assistant", "system")


def path_parts(path: Column, root: str) -> dict[str, Column]:
    """project, source_kind and agent_id of a file below ``root``."""
    below = F.split(F.substring_index(path, root.rstrip("/").split("://")[-1].rstrip("/") + "/", -1), "/")
    name = F.element_at(below, -1)
    agent = F.regexp_extract(name, r"^agent-(.+)\.jsonl$", 1)
    parent = F.coalesce(F.try_element_at(below, F.lit(-2)), F.lit(""))
    kind = F.when(F.array_contains(below, "subagents"), "subagent").when(F.size(below) == 2, "session").otherwise("other")
    return {"project": F.when(F.size(below) > 1, F.element_at(below, 1)).otherwise("unknown"), "source_kind": kind, "agent_id": F.when((agent != "") & parent.startswith("wf_"), F.concat_ws("/", parent, agent)).when(agent != "", agent).otherwise("main")}


#: A transcript that grows may come as chunks ``name.part-<number>.jsonl``, which are one file in the order of their numbers.
CHUNK = r"[.]part-(\d+)[.]jsonl$"


def whole_file(path: Column) -> Column:
    return F.regexp_replace(path, CHUNK, ".jsonl")


def chunk_of(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, CHUNK, 1), F.lit("")).try_cast("int"), F.lit(0))


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """``file, chunk, block, line_no, line, parsed, is_record``: every non-blank line of the .jsonl files below ``root``; lines of a file are in order of chunk, block and line_no."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    line = F.regexp_replace("value", "^﻿", "")
    parsed = F.try_parse_json("line")
    return (
        lines.select(whole_file(F.col("_metadata.file_path")).alias("file"), chunk_of(F.col("_metadata.file_path")).alias("chunk"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), line.alias("line"))
        .where(F.trim("line") != "")
        .withColumn("parsed", parsed)
        .withColumn("is_record", F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False)))
    )


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """One row for each record; ``pos`` orders the records of a file."""
    lines = read_lines(spark, root).where("is_record")
    return records_of(lines.select("file", F.struct("chunk", "block", "line_no").alias("pos"), "parsed"), root)


def records_of(lines: DataFrame, root: str, *others: str) -> DataFrame:
    """Records of ``file, pos, parsed`` (VARIANT objects) below ``root``; ``others`` are columns that stay."""
    v = F.col("parsed")
    raw = F.coalesce(_text(v, "$.type"), _text(v, "$.message.role"))
    content = F.try_variant_get(v, "$.message.content", "variant")
    is_text = F.schema_of_variant(content) == "STRING"
    blocks = F.coalesce(F.when(~is_text, F.try_variant_get(content, "$", "array<variant>")), F.array().cast("array<variant>"))
    kept = lines.select(
        "file", "pos", *others,
        _text(v, "$.uuid").alias("uuid"), _text(v, "$.parentUuid").alias("parent_uuid"), _text(v, "$.promptId").alias("prompt_id"),
        _text(v, "$.sessionId").alias("session_id"), F.when(raw.isin(*KINDS), raw).otherwise("other").alias("kind"),
        _text(v, "$.timestamp").alias("ts"), F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)).alias("is_meta"), _text(v, "$.cwd").alias("cwd"), _text(v, "$.gitBranch").alias("git_branch"),
        F.coalesce(_text(v, "$.subtype"), _text(v, "$.type")).alias("subtype"), F.when(is_text, F.variant_get(content, "$", "string")).alias("plain"), blocks.alias("blocks"),
        F.try_variant_get(v, "$.toolUseResult", "variant").alias("tool_use_result"),
    )
    block_text = F.array_join(F.transform(F.filter("blocks", lambda b: _text(b, "$.type") == "text"), lambda b: _text(b, "$.text")), "\n")
    out = kept.withColumn("text", F.coalesce("plain", block_text))
    for name, column in path_parts(F.col("file"), root).items():
        out = out.withColumn(name, column)
    return out


def line_counts(spark: SparkSession, root: str) -> DataFrame:
    """``lines, rejected``: what a reader of ``root`` takes and leaves."""
    return read_lines(spark, root).agg(F.count("*").alias("lines"), F.count_if(~F.col("is_record")).alias("rejected"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lenient: objects only, as VARIANT; bad lines are dropped."""
    return read_lines(spark, path).where("is_record").select("parsed")


def read_episodes(spark: SparkSession, path: str, schema) -> DataFrame:
    """Strict: any malformed line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def read_episode_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, format, place, is_array, episode`` (VARIANT) of the .jsonl and .json files of a folder, strict.

    A .json file holds one episode or an array of them; a .jsonl file one a
    line.  Malformed JSON fails.
    """
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select(name.alias("file"), F.lit("jsonl").alias("format"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("place"), F.lit(False).alias("is_array"), "value").where(F.trim("value") != "").withColumn("episode", F.parse_json("value")).drop("value")
    whole = spark.read.option("pathGlobFilter", "*.json").option("wholetext", "true").text(path).select(name.alias("file"), F.parse_json("value").alias("v"))
    is_array = F.schema_of_variant("v").startswith("ARRAY")
    each = F.when(is_array, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    docs = whole.select("file", F.lit("json").alias("format"), is_array.alias("is_array"), F.posexplode(each).alias("nth", "episode")).select("file", "format", F.struct(F.lit(0).cast("long").alias("block"), F.col("nth").cast("long").alias("nth")).alias("place"), "is_array", "episode")
    return lines.unionByName(docs)


def write_episode_files(records: DataFrame, path: str) -> None:
    """The rows of ``read_episode_files`` back to text by file name (a folder each): lines as lines, in order, and .json files whole."""
    lines = records.where("format = 'jsonl'").select("file", "place", F.to_json("episode").alias("value"))
    one = F.array_sort(F.collect_list(F.struct("place", F.to_json("episode").alias("json"))))
    body = F.array_join(F.transform("xs", lambda x: x["json"]), ",\n")
    docs = records.where("format = 'json'").groupBy("file").agg(one.alias("xs"), F.bool_or("is_array").alias("is_array")).select("file", F.when(F.col("is_array"), F.concat(F.lit("[\n"), body, F.lit("\n]"))).otherwise(body).alias("value"))
    lines.repartitionByRange("file", "place").sortWithinPartitions("file", "place").select("file", "value").unionByName(docs).write.partitionBy("file").text(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON document, strict."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def replayable_witnesses(documents: DataFrame) -> DataFrame:
    """``cmd, cwd, mode, error_class`` of the replayable witnesses in ``documents`` (VARIANT ``doc``: witnesses, clusters, or arrays of either).

    A cluster's witness without a class takes its own mode, the cluster's class
    or the cluster's mode; those without a command are left out.
    """
    text = lambda v, p: F.try_variant_get(v, p, "string")
    each = documents.select(F.explode(F.when(F.schema_of_variant("doc").startswith("ARRAY"), F.try_variant_get("doc", "$", "array<variant>")).otherwise(F.array("doc"))).alias("d"))
    own = each.select(F.col("d").alias("w"), F.lit(None).cast("string").alias("fallback"))
    inner = each.select(F.explode(F.try_variant_get("d", "$.witnesses", "array<variant>")).alias("w"), F.coalesce(text("d", "$.errorClass"), text("d", "$.mode")).alias("fallback"))
    inherited = inner.select("w", F.coalesce(text("w", "$.errorClass"), text("w", "$.mode"), "fallback").alias("error_class"))
    every = own.select("w", text("w", "$.errorClass").alias("error_class")).unionByName(inherited)
    kept = every.where(F.coalesce(F.try_variant_get("w", "$.replayable", "boolean"), F.lit(False)))
    return kept.select(text("w", "$.cmd").alias("cmd"), text("w", "$.cwd").alias("cwd"), text("w", "$.mode").alias("mode"), "error_class").where("cmd <> ''")


def write_episodes(episodes: DataFrame, path: str) -> None:
    """Parquet by project, sorted by id within each file; a large project is dealt to several writers by ranges of ids."""
    episodes.repartitionByRange("project", "id").sortWithinPartitions("project", "id").write.partitionBy("project").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Ledger, attestation and history rows."""
    rows.write.mode("append").parquet(path)


def pull_requests(raw: DataFrame) -> DataFrame:
    """Recorded pull requests with ``merged`` and ``closed_unmerged``."""
    merged = (F.upper("state") == "MERGED") | F.col("mergedAt").isNotNull()
    return raw.withColumn("merged", F.coalesce(merged, F.lit(False))).withColumn("closed_unmerged", F.coalesce((F.upper("state") == "CLOSED") & ~merged, F.lit(False)))


def learning_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """Recorded sweeps and replications, by attempts; unreadable files are dropped."""
    found = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return found.where(F.col("file").rlike("^(sweep-k|rep-k10).*[.]json$")).orderBy("K", "file")
