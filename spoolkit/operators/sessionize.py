"""Records to prompt groups, steps and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.functions import commands, errors, text
from spoolkit.operators.ancestors import inherited

# User texts that aren't requests.
NOISE = r"(?i)^<(?:local-command|command-name|command-message|bash-input|bash-stdout)\b"
SLASH_COMMAND = r"^/[\w-]+(?:\s+.*)?\z"
HARNESS_ERROR = r"(?i)^\s*<tool_use_error>([\s\S]*?)</tool_use_error>\s*\z"
EXIT_CODE = r"^Exit code (\d+)(?:\s*\n---\n|\s*\n|\z)"


def is_noise(kind: Column, body: Column, is_meta: Column) -> Column:
    body = F.trim(F.coalesce(body, F.lit("")))
    return is_meta | ((kind == "user") & (body.rlike(NOISE) | body.rlike(SLASH_COMMAND)))


def _of(block: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(block, path, kind)


def is_useful(kind: Column, body: Column, blocks: Column) -> Column:
    return F.exists(blocks, lambda b: F.coalesce(_of(b, "$.type") == "tool_use", F.lit(False))) | ((kind == "assistant") & (F.length(F.trim(F.coalesce(body, F.lit("")))) > 0))


def orphans(session: Column) -> Column:
    """The group of a session's records that belong to no prompt."""
    return F.concat(F.lit("_orphan:"), F.coalesce(session, F.lit("unknown")))


def prompt_groups(records: DataFrame, most: int = 5000) -> DataFrame:
    """``records`` with their ``group``, its ``truncated`` flag, and noisy or useless groups left out.

    A record without prompt takes that of its nearest ancestor in the file;
    without any it belongs to its session's orphans.  At most ``most`` records
    of a group are kept, in file order.
    """
    found = inherited(records, "file", "uuid", "parent_uuid", "prompt_id").withColumnRenamed("value", "resolved")
    joined = records.join(found, ["file", "uuid"], "left").withColumn("group", F.coalesce("prompt_id", "resolved", orphans(F.col("session_id"))))
    return kept_groups(joined.drop("resolved"), most)


def kept_groups(grouped: DataFrame, most: int = 5000) -> DataFrame:
    """``grouped`` records with ``truncated``, at most ``most`` of a group, without noisy and useless groups."""
    group = W.partitionBy("file", "group")
    numbered = grouped.withColumn("nth", F.row_number().over(group.orderBy("pos")))
    kept = numbered.where(F.col("nth") <= most + 1).withColumn("truncated", F.max(F.col("nth") > most).over(group)).where(F.col("nth") <= most)
    noise, useful = is_noise(F.col("kind"), F.col("text"), F.col("is_meta")), is_useful(F.col("kind"), F.col("text"), F.col("blocks"))
    return kept.withColumn("all_noise", F.bool_and(noise).over(group)).withColumn("any_useful", F.bool_or(useful).over(group)).where("any_useful and not all_noise").drop("all_noise", "any_useful")


def content_text(content: Column) -> Column:
    """The text of a string or of a list of strings and blocks, joined by line breaks."""
    parts = F.transform(_of(content, "$", "array<variant>"), lambda b: F.coalesce(F.when(F.schema_of_variant(b) == "STRING", _of(b, "$")), _of(b, "$.text"), _of(b, "$.content")))
    return F.coalesce(F.when(F.schema_of_variant(content) == "STRING", _of(content, "$")), F.array_join(F.filter(parts, lambda x: x != ""), "\n"), F.lit(""))


def parse_result(content: Column, tool_use_result: Column, is_error: Column) -> Column:
    """struct(exit_code, body, interrupted, harness_error) of a tool's result."""
    body = content_text(content)
    harness = body.rlike(HARNESS_ERROR)
    interrupted = F.coalesce(_of(tool_use_result, "$.interrupted", "boolean"), F.lit(False))
    coded = body.rlike(EXIT_CODE)
    streams = F.array_join(F.filter(F.array(_of(tool_use_result, "$.stdout"), _of(tool_use_result, "$.stderr")), lambda x: x != ""), "\n")
    fallback = F.when((body == "") & _of(tool_use_result, "$.stdout").isNotNull(), streams).otherwise(body)
    pack = lambda code, out, i, h: F.struct(code.cast("int").alias("exit_code"), out.alias("body"), F.lit(i).alias("interrupted"), F.lit(h).alias("harness_error"))
    return (
        F.when(harness, pack(F.lit(None), F.regexp_extract(body, HARNESS_ERROR, 1), False, True))
        .when(interrupted, pack(F.lit(None), body, True, False))
        .when(coded, pack(F.try_to_number(F.nullif(F.regexp_extract(body, EXIT_CODE, 1), F.lit("")), F.lit("999999999")), F.regexp_replace(body, EXIT_CODE, ""), False, False))
        .otherwise(pack(F.when(F.coalesce(is_error, F.lit(False)), 1).otherwise(0), fallback, False, False))
    )


def steps_of(records: DataFrame) -> DataFrame:
    """One row for each tool call, with its result, and for each result without call, in time order.

    The first result of an identifier counts.  ``ok`` is null without result.
    """
    key = ["file", "group"]
    blocks = records.select(*key, "pos", "uuid", "parent_uuid", "ts", "tool_use_result", F.posexplode("blocks").alias("at", "block"))
    calls = blocks.where(_of(F.col("block"), "$.type") == "tool_use").select(*key, F.struct("pos", "at").alias("place"), "uuid", "parent_uuid", "ts", _of(F.col("block"), "$.id").alias("tool_id"), _of(F.col("block"), "$.name").alias("tool"), _of(F.col("block"), "$.input", "variant").alias("input"))
    result = parse_result(_of(F.col("block"), "$.content", "variant"), F.col("tool_use_result"), _of(F.col("block"), "$.is_error", "boolean"))
    first = F.row_number().over(W.partitionBy(*key, "tool_id").orderBy("r_place"))
    results = (
        blocks.where(_of(F.col("block"), "$.type") == "tool_result")
        .select(*key, F.struct("pos", "at").alias("r_place"), F.col("uuid").alias("r_uuid"), F.col("parent_uuid").alias("r_parent"), F.col("ts").alias("r_ts"), _of(F.col("block"), "$.tool_use_id").alias("tool_id"), result.alias("result"))
        .where("tool_id is not null")
        .withColumn("nth", first)
        .where("nth = 1")
        .drop("nth")
    )
    both = calls.join(results, [*key, "tool_id"], "full")
    lone = F.col("place").isNull()
    r = F.col("result")
    order = W.partitionBy(*key).orderBy(F.coalesce("ts", F.lit("")), lone, F.coalesce("place", "r_place"))
    return (
        both.select(
            *key, "place", "r_place", F.coalesce("uuid", "r_uuid").alias("uuid"), F.coalesce("parent_uuid", "r_parent").alias("parent_uuid"), F.when(lone, F.col("r_ts")).otherwise(F.col("ts")).alias("ts"),
            F.when(lone, "unknown").otherwise(F.col("tool")).alias("tool"), "input",
            F.when(r.isNotNull(), F.coalesce(r["exit_code"] == 0, F.lit(False)) & ~r["harness_error"] & ~r["interrupted"]).alias("ok"),
            r["exit_code"].alias("exit_code"), F.coalesce(r["interrupted"], F.lit(False)).alias("interrupted"), F.coalesce(r["harness_error"], F.lit(False)).alias("harness_error"),
            F.when(r.isNotNull() & ~(F.coalesce(r["exit_code"] == 0, F.lit(False)) & ~r["harness_error"] & ~r["interrupted"]), text.cap_middle(r["body"])).otherwise("").alias("error_text"),
            F.coalesce(F.octet_length(r["body"]), F.lit(0)).alias("bytes_out"),
        )
        .withColumn("i", F.row_number().over(order) - 1)
        .drop("place", "r_place")
    )


def described(steps: DataFrame) -> DataFrame:
    """``steps`` with command, head, signature, class, and whether a failure counts and was recovered from.

    A failing step is recovered from if a later step of the group with the same
    non-empty head succeeds.
    """
    command, path = _of(F.col("input"), "$.command"), F.coalesce(_of(F.col("input"), "$.file_path"), _of(F.col("input"), "$.path"))
    out = steps.withColumn("command", command).withColumn("path", path).withColumn("head", commands.cmd_head(F.col("tool"), F.col("command"), F.col("path"))).withColumn("found", errors.classify_error(F.col("error_text"))).withColumn("error_class", F.col("found.error_class"))
    failed = F.col("ok") == F.lit(False)
    benign = failed & errors.is_benign_nonzero(F.col("exit_code"), F.col("error_text"), F.col("command"))
    out = out.withColumn("benign", F.coalesce(benign, F.lit(False)))
    other = failed & ~F.col("benign") & ~errors.is_agent_fault(F.col("error_class"))
    out = out.withColumn("not_agent", F.coalesce(other, F.lit(False))).withColumn("counts", F.coalesce(failed & ~F.col("benign") & ~F.col("not_agent"), F.lit(False)))
    last_good = F.max(F.when(F.col("ok"), F.col("i"))).over(W.partitionBy("file", "group", "head"))
    out = out.withColumn("signature", F.when(F.col("counts"), commands.error_signature(F.col("tool"), F.col("head"), found=F.col("found")))).drop("found")
    return out.withColumn("recovered", F.when(F.col("counts"), (F.col("head") != "") & (F.coalesce(last_good, F.lit(-1)) > F.col("i"))))


def longest_runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys, longest``: the longest run of equal non-empty values in order."""
    w = W.partitionBy(*keys).orderBy(order)
    empty = F.coalesce(F.col(value), F.lit("")) == ""
    change = F.coalesce((F.lag(value).over(w) != F.col(value)) | empty, F.lit(True)).cast("int")
    runs = rows.withColumn("run", F.sum(change).over(w)).groupBy(*keys, "run").agg(F.sum(F.when(empty, 0).otherwise(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))


def patch_lines(patch: Column) -> Column:
    hunks = F.coalesce(_of(patch, "$", "array<variant>"), _of(patch, "$.hunks", "array<variant>"), F.array().cast("array<variant>"))
    size = lambda h: F.coalesce(F.size(_of(h, "$.lines", "array<variant>")), _of(h, "$.lines", "int"), F.coalesce(_of(h, "$.oldLines", "int"), F.lit(0)) + F.coalesce(_of(h, "$.newLines", "int"), F.lit(0)))
    return F.aggregate(hunks, F.lit(0), lambda a, h: a + F.greatest(F.lit(0), size(h)))


def episodes_of(records: DataFrame, steps: DataFrame) -> DataFrame:
    """One row for each group: ids, times, request, artifacts, signals, failure and witness."""
    key = ["file", "group"]
    d = described(steps)
    step = F.struct("i", "ts", "tool", "command", "path", "ok", "exit_code", "interrupted", "harness_error", "error_text", "bytes_out", "signature", "head", _of(F.col("input"), "$.cwd").alias("cwd"))
    failing = F.col("counts") & ~F.col("recovered")
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("signature"))))
    tool = F.lower("tool")
    patch = F.coalesce(_of(F.col("input"), "$.structuredPatch", "variant"), _of(F.col("input"), "$.structured_patch", "variant"))
    rolled = d.groupBy(*key).agg(
        F.array_sort(F.collect_list(step)).alias("steps"), F.count("*").alias("tool_calls"), F.count_if(F.col("ok") == F.lit(False)).alias("errored_tool_results"),
        F.count_if("benign").alias("benign_nonzero"), F.count_if("not_agent").alias("non_agent_faults"), F.count_if("harness_error").alias("harness_errors"), F.bool_or("interrupted").alias("interrupted"),
        names(F.col("counts")).alias("distinct_error_signatures"), names(F.col("counts") & F.col("recovered")).alias("recovered_signatures"), names(failing).alias("unrecovered_signatures"),
        F.array_sort(F.collect_set(F.when((tool == "write") & (F.col("path") != ""), F.col("path")))).alias("files_written"), F.array_sort(F.collect_set(F.when((tool == "edit") & (F.col("path") != ""), F.col("path")))).alias("files_edited"),
        F.sum(F.coalesce(patch_lines(patch), F.lit(0))).alias("lines_changed"),
        F.max(F.when(failing, F.struct("i", "signature", "error_class", "tool", "command", "exit_code", "harness_error", _of(F.col("input"), "$.cwd").alias("cwd")))).alias("last"),
    ).join(longest_runs(d, key, "i", "head").withColumnRenamed("longest", "repeat_command_max"), key, "left")
    valid_ts = F.when(F.try_to_timestamp("ts").isNotNull(), F.col("ts"))
    first = lambda c, cond=None: F.min_by(c, F.when(cond if cond is not None else F.col(c).isNotNull(), F.col("pos")))
    head = records.groupBy(*key).agg(
        first("session_id").alias("session_id"), F.first("project").alias("project"), F.first("agent_id").alias("agent_id"), F.first("source_kind").alias("source_kind"), first("cwd").alias("cwd"), first("git_branch").alias("git_branch"),
        F.min(valid_ts).alias("first_ts"), F.max(valid_ts).alias("last_ts"), F.coalesce(F.min_by("ts", "pos"), F.lit("1970-01-01T00:00:00.000Z")).alias("raw_ts"), (F.bool_or("is_sidechain") | (F.first("source_kind") == "subagent")).alias("is_sidechain"), F.bool_or("truncated").alias("truncated"), F.count("*").alias("n_records"),
        first("text", (F.col("kind") == "user") & (F.trim("text") != "")).alias("request"),
        F.bool_or((F.col("kind") == "system") & (F.col("subtype") == "compact_boundary")).alias("compacted"), F.count_if((F.col("kind") == "system") & (F.col("subtype") == "api_error")).alias("api_errors"),
    )
    millis = lambda c: F.unix_millis(F.try_to_timestamp(c))
    # without any valid time the first record's text stands, or the epoch
    head = head.withColumn("started", F.coalesce("first_ts", "raw_ts")).withColumn("ended", F.coalesce("last_ts", "first_ts", "raw_ts"))
    e = head.join(rolled, key, "left").withColumn("session_id", F.coalesce("session_id", F.lit("unknown"))).withColumn("prompt_id", F.col("group"))
    last, zero = F.col("last"), F.lit(0)
    bashlike = F.coalesce(F.lower(last["tool"]).isin("bash", "shell", "terminal"), F.lit(False))
    witness = F.when(bashlike, F.struct(F.lit("command").alias("kind"), last["command"].alias("cmd"), F.coalesce(last["cwd"], F.col("cwd"), F.lit("unknown")).alias("cwd"), last["exit_code"].alias("observed_exit_code"), ((F.trim(F.coalesce(last["command"], F.lit(""))) != "") & ~last["harness_error"]).alias("replayable"))).otherwise(
        F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("cmd"), F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("int").alias("observed_exit_code"), F.lit(False).alias("replayable")))
    return e.select(
        text.content_id("ep", {"agent_id": F.col("agent_id"), "prompt_id": F.col("prompt_id"), "session_id": F.col("session_id")}).alias("id"), "session_id", "prompt_id", "agent_id", "project", "source_kind", "file",
        F.coalesce("cwd", F.lit("unknown")).alias("cwd"), F.coalesce("git_branch", F.lit("")).alias("git_branch"), "started", "ended",
        F.greatest(zero, F.coalesce(millis("ended") - millis("started"), zero)).alias("duration_ms"), "is_sidechain", "n_records",
        F.struct(text.cap_head(F.col("request")).alias("text"), F.length(text.cap_head(F.col("request"))).alias("chars")).alias("request"), "steps",
        F.struct("files_written", "files_edited", F.coalesce("lines_changed", zero).alias("lines_changed")).alias("artifacts"),
        F.struct("truncated", F.coalesce("tool_calls", zero).alias("tool_calls"), F.coalesce("errored_tool_results", zero).alias("errored_tool_results"), F.coalesce("benign_nonzero", zero).alias("benign_nonzero"), F.coalesce("non_agent_faults", zero).alias("non_agent_faults"),
                 F.coalesce("harness_errors", zero).alias("harness_errors"), F.coalesce("interrupted", F.lit(False)).alias("interrupted"), "compacted", "api_errors", F.coalesce("repeat_command_max", zero).alias("repeat_command_max"),
                 "distinct_error_signatures", "recovered_signatures", "unrecovered_signatures").alias("signals"),
        F.when(last.isNotNull(), F.struct(last["signature"].alias("signature"), last["error_class"].alias("mode"), witness.alias("witness"))).alias("failure"),
    )


def deduplicated(episodes: DataFrame) -> DataFrame:
    """One episode for each (session, prompt, agent): a session file's first, then the one with more records, then by file."""
    order = W.partitionBy("session_id", "prompt_id", "agent_id").orderBy(F.col("source_kind") != "session", F.desc("n_records"), "file")
    return episodes.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def harvest(records: DataFrame, most: int = 5000, sidechains: bool = False) -> DataFrame:
    """Records to deduplicated episodes."""
    grouped = prompt_groups(records, most)
    found = deduplicated(episodes_of(grouped, steps_of(grouped)))
    return found if sidechains else found.where("not is_sidechain")


def harvest_counts(records: DataFrame, most: int = 5000) -> DataFrame:
    """``groups, duplicates, sidechains, episodes``; episodes + duplicates + sidechains = groups."""
    grouped = prompt_groups(records, most)
    every = episodes_of(grouped, steps_of(grouped)).select("session_id", "prompt_id", "agent_id", "source_kind", "n_records", "file", "is_sidechain")
    kept = deduplicated(every)
    a, b = every.agg(F.count("*").alias("groups")), kept.agg(F.count("*").alias("kept"), F.count_if("is_sidechain").alias("sidechains"))
    return a.crossJoin(b).select("groups", (F.col("groups") - F.col("kept")).alias("duplicates"), "sidechains", (F.col("kept") - F.col("sidechains")).alias("episodes"))
