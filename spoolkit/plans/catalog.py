"""Queries over the standard tables, each an operator on stand-in data, with the SQL that gives the same rows.

``events`` stands for steps (user = session, type = tool, ``error`` = failure),
``conversations`` for records, ``documents`` for texts, ``orders`` and
``lineitem`` for calls and results.  Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.functions import commands, errors, stats, text
from spoolkit.operators import clusters, labels, measure, planning, reports, sessionize
from spoolkit.operators.ancestors import inherited
from spoolkit.operators.components import connected_components

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: session, i (order in the session), tool, k, ok, signature."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", "user_id", "ts", "value", "k", F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"), F.concat_ws(":", F.lit("bash"), F.concat(F.lit("class"), F.col("k") % 7), F.concat(F.lit("head"), F.col("k") % 3), F.lit("")).alias("signature"))


STEPS = """steps AS (
  SELECT event_id, user_id, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS tool, event_type <> 'error' AS ok,
    'bash:class' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) || ':head' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) || ':' AS signature
  FROM events
)"""


def failures(spark, sf_dir):
    """Error events as failures of sessions; signatures of the heads 0 and 1 of a class have like texts, and seldom ones are the long tail."""
    e = steps(spark, sf_dir).where("not ok")
    v, k, text = F.col("value"), F.col("k"), lambda c: c.cast("string")
    rare = (k >= 90) & (F.col("event_id") % 3 == 0)
    signature = F.when(rare, F.concat(F.lit("bash:rare"), F.col("user_id") % 60, F.lit(":x:"))).otherwise(F.col("signature"))
    words = F.when(rare, F.concat(F.lit("only here"), F.col("user_id") % 60)).when(k % 3 < 2, F.concat(F.lit("alpha beta gamma delta epsilon class"), k % 7)).otherwise(F.concat(F.lit("another text of class"), k % 7))
    own = F.when(v > 60, F.array(signature)).when(v > 30, F.array(F.lit("bash:none::"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.lpad(text(F.col("event_id")), 9, "0").alias("id"), text(F.col("user_id")).alias("session_id"), text(F.col("user_id") % 10).alias("project"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("started"), F.concat(F.lit("/w/"), k % 4).alias("cwd"), (k * 1000).alias("duration_ms"),
        signature.alias("signature"), F.lit("bash").alias("tool"), F.element_at(F.split(signature, ":"), 2).alias("error_class"), F.struct(F.lit("command").alias("kind"), F.concat(F.lit("run "), k % 8).alias("cmd"), F.lit("/w").alias("cwd"), F.lit(1).alias("observed_exit_code"), (v > 50).alias("replayable")).alias("witness"),
        F.when(v > 90, "gold").when(v > 50, "strong").when(v > 10, "weak").otherwise("unknown").alias("tier"), words.alias("error_text"), own.alias("recovered_signatures"), (k % 3).cast("int").alias("errored"), F.lit("please").alias("request"),
    )


FAILURES = f"""{STEPS}, f AS (
  SELECT *, lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, strftime(ts, '%Y-%m-%d %H:%M') AS started, CASE WHEN k >= 90 AND event_id % 3 = 0 THEN 'bash:rare' || (user_id % 60) || ':x:' ELSE signature END AS sig
  FROM steps WHERE NOT ok
), g AS (
  SELECT *, CASE WHEN k >= 90 AND event_id % 3 = 0 THEN sig WHEN k % 3 < 2 THEN 'a' || (k % 7) ELSE 'b' || (k % 7) END AS kin FROM f
), sized AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY kin) >= 3 THEN kin ELSE 'tail' END AS c FROM g
)"""


@query(f"""WITH {FAILURES}, w AS (
  SELECT c, 'run ' || (k % 8) AS cmd, min(started || id) AS first FROM sized WHERE value > 50 GROUP BY ALL
), w5 AS (
  SELECT c, string_agg(cmd, ',' ORDER BY first) AS witnesses FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY c ORDER BY first) <= 5) GROUP BY c
), cwd AS (
  SELECT c, cwd FROM (SELECT c, '/w/' || (k % 4) AS cwd, count(*) AS n FROM sized GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, cwd) = 1
), rolled AS (
  SELECT c, min(sig) AS sig, string_agg(DISTINCT sig, ',' ORDER BY sig) AS merged, string_agg(id, '","' ORDER BY started, id) AS ids, count(*) AS size, count(*) FILTER (value > 90) AS tier_gold, count(*) FILTER (value > 50 AND value <= 90) AS tier_strong,
    count(*) FILTER (value > 10 AND value <= 50) AS tier_weak, count(*) FILTER (value <= 10) AS tier_unknown, count(DISTINCT user_id) AS sessions, count(DISTINCT user_id % 10) AS projects, min(started) AS first, max(started) AS last,
    CAST(sum(k * 1000) AS BIGINT) AS wasted_ms, CAST(sum(k % 3) AS BIGINT) AS wasted_steps, count(*) FILTER (value > 60) AS recovered FROM sized GROUP BY c
), p AS (
  SELECT *, ln(1 + size) + 2.0 + 0.7 * ln(1 + wasted_ms / 60000) + 1.5 * projects / max(projects) OVER () + (tier_gold + 0.7 * tier_strong + 0.3 * tier_weak + 0.1 * tier_unknown) / size AS priority FROM rolled
)
SELECT CASE WHEN c = 'tail' THEN 'cl_longtail' ELSE 'cl_sha256:' || substr(sha256('{{"members":["' || ids || '"],"signature":"' || sig || '"}}'), 1, 16) END AS id,
  CASE WHEN c = 'tail' THEN 'longtail' ELSE sig END AS signature, merged, CASE WHEN c = 'tail' THEN 'mixed' ELSE split_part(sig, ':', 2) END AS error_class, size, tier_gold, tier_strong, tier_weak, tier_unknown, sessions, projects, first, last, wasted_ms, wasted_steps, recovered,
  coalesce(witnesses, '') AS witnesses, cwd AS dominant_cwd, round(size / (SELECT count(*) FROM events), 4) AS recurrence_rate, round(priority, 6) AS priority,
  row_number() OVER (ORDER BY c = 'tail', round(priority, 6) DESC, size DESC, sig) AS rank FROM p LEFT JOIN w5 USING (c) JOIN cwd USING (c)""")
def failure_clusters(spark, sf_dir):
    """Clusters of the failures, ranked, with everything that a cluster holds."""
    found = clusters.rank_clusters(clusters.cluster_failures(failures(spark, sf_dir), table(spark, sf_dir, "events").count())).withColumn("priority", F.round("priority", 6))
    rank = F.row_number().over(W.orderBy("is_long_tail", F.desc("priority"), F.desc("size"), "signature")).cast("long")  # one row for each cluster
    return found.select(
        "id", "signature", F.array_join("merged_signatures", ",").alias("merged"), "error_class", "size", "tier_gold", "tier_strong", "tier_weak", "tier_unknown", "sessions", "projects", "first", "last", "wasted_ms", "wasted_steps", "recovered",
        F.array_join(F.transform("witnesses", lambda w: w["cmd"]), ",").alias("witnesses"), "dominant_cwd", "recurrence_rate", "priority", rank.alias("rank"),
    )


@query(f"""WITH {FAILURES}, t AS (SELECT * FROM sized WHERE c = 'tail')
SELECT string_agg(id, ',' ORDER BY started, id) AS members, count(*) AS size, min(split_part(sig, ':', 2)) AS error_class, count(DISTINCT user_id) AS sessions, 'lt_sha256:' || substr(sha256('{{"errorClass":"' || min(split_part(sig, ':', 2)) || '","members":["' || string_agg(id, '","' ORDER BY started, id) || '"],"tool":"bash"}}'), 1, 16) AS key
FROM t GROUP BY sig HAVING count(*) >= 2""")
def longtail_groups(spark, sf_dir):
    """Failures outside every cluster, grouped by like texts."""
    f = failures(spark, sf_dir)
    groups, _ = clusters.mine_long_tail(f, clusters.cluster_failures(f, 1))
    return groups.select(F.array_join("members", ",").alias("members"), "size", "error_class", "sessions", "key")


@query(f"""WITH {FAILURES}, c AS (SELECT c, count(*) FILTER (value > 50) AS good, count(*) AS n FROM sized GROUP BY c)
SELECT count(*) AS episodes, count(*) FILTER (event_type = 'error' OR value > 99) AS failures, count(*) FILTER (value > 90) AS tier_gold, count(*) FILTER (value > 50 AND value <= 90) AS tier_strong, count(*) FILTER (value > 10 AND value <= 50) AS tier_weak, count(*) FILTER (value <= 10) AS tier_unknown,
  (SELECT count(*) FROM c WHERE c <> 'tail' AND n >= 3 AND good >= 3) AS proposable, count(*) FILTER (event_id % 4 = 0) AS applied, count(*) FILTER (event_id % 4 = 1) AS queued, strftime(max(ts), '%Y-%m-%d') AS last_run FROM events""")
def status_summary(spark, sf_dir):
    e, v = table(spark, sf_dir, "events"), F.col("value")
    episodes = e.select(F.when(F.col("event_type") == "error", "fail").alias("label"), F.when(v > 90, "gold").when(v > 50, "strong").when(v > 10, "weak").otherwise("?").alias("tier"), (v > 99).alias("witnessed"))
    n = F.col("event_id") % 4
    ledger = e.select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), (n == 0).alias("applied"), F.when(n == 2, "skipped").alias("gate_decision"), F.when(n == 3, "already_applied").alias("reason"))
    return reports.status(episodes, clusters.cluster_failures(failures(spark, sf_dir), 1), ledger)


@query(f"""WITH {STEPS}, c AS (
  SELECT signature, count(*) AS size, count(DISTINCT user_id) AS projects, CAST(sum(k) AS BIGINT) AS wasted_ms,
    count(*) FILTER (value > 90) AS g, count(*) FILTER (value > 50 AND value <= 90) AS s, count(*) FILTER (value > 10 AND value <= 50) AS w, count(*) FILTER (value <= 10) AS u
  FROM steps WHERE NOT ok GROUP BY signature
), p AS (
  SELECT *, ln(1 + size) + 2.0 + 0.7 * ln(1 + wasted_ms / 60000) + 1.5 * projects / max(projects) OVER () + (g + 0.7 * s + 0.3 * w + 0.1 * u) / size AS priority FROM c
)
SELECT signature, size, projects, wasted_ms, round(priority, 6) AS priority, row_number() OVER (ORDER BY round(priority, 6) DESC, size DESC, signature) AS rank FROM p""")
def ranked_clusters(spark, sf_dir):
    """Which failure signatures recur, ranked."""
    v, tier = F.col("value"), lambda c, n: F.count_if(c).alias(f"tier_{n}")
    c = steps(spark, sf_dir).where("not ok").groupBy("signature").agg(
        F.count("*").alias("size"), F.count("*").alias("terminal"), F.countDistinct("user_id").alias("projects"), F.sum("k").alias("wasted_ms"),
        tier(v > 90, "gold"), tier((v > 50) & (v <= 90), "strong"), tier((v > 10) & (v <= 50), "weak"), tier(v <= 10, "unknown"), F.lit(False).alias("is_long_tail"), F.first("signature").alias("root"),
    )
    ranked = clusters.rank_clusters(c).withColumn("priority", F.round("priority", 6))
    # one row for each signature, so one window is as small as the report
    return ranked.select("signature", "size", "projects", "wasted_ms", "priority", F.row_number().over(W.orderBy(F.desc("priority"), F.desc("size"), "signature")).cast("long").alias("rank"))


def call_records(spark, sf_dir):
    """Events as records of tool calls and results: of each 13th event only the result, of each 11th only the call."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("text", F.col("event_id").cast("string"))
    bad, no_text = F.col("event_type") == "error", F.lit(None).cast("string")
    call = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), "text").alias("id"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("run"), F.col("k") % 3, F.lit(" go -v x")).alias("command")).alias("input")))
    body = F.when(bad, F.concat(F.lit("Exit code 1\n"), F.lit("command not found: tool"), F.col("k") % 7)).otherwise("done")
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), "text").alias("tool_use_id"), body.alias("content"), bad.alias("is_error")))
    kinds = F.array(F.struct(F.lit(0).alias("nth"), F.lit("assistant").alias("kind"), call.alias("block"), (F.col("event_id") % 13 != 0).alias("there")), F.struct(F.lit(1).alias("nth"), F.lit("user").alias("kind"), result.alias("block"), (F.col("event_id") % 11 != 0).alias("there")))
    each = e.select("*", F.explode(kinds).alias("r")).where("r.there")
    return each.select(
        F.concat(F.lit("u"), "user_id").alias("file"), F.lit("g").alias("group"), (F.col("event_id") * 2 + F.col("r.nth")).alias("pos"), F.concat(F.col("r.kind"), "text").alias("uuid"), no_text.alias("parent_uuid"), F.lit("p").alias("prompt_id"), F.col("user_id").cast("string").alias("session_id"), F.col("r.kind").alias("kind"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.lit(False).alias("is_sidechain"), F.lit(False).alias("is_meta"), F.lit("/w").alias("cwd"), F.lit("main").alias("git_branch"), no_text.alias("subtype"), F.array(F.parse_json("r.block")).alias("blocks"), F.lit(None).cast("variant").alias("tool_use_result"),
        no_text.alias("text"), F.lit("proj").alias("project"), F.lit("main").alias("agent_id"), F.lit("session").alias("source_kind"), F.lit(False).alias("truncated"),
    )


CALLS = """calls AS (
  SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 13 <> 0 AS has_call, event_id % 11 <> 0 AS has_result, event_type = 'error' AS bad FROM events WHERE event_id % 143 <> 0
), paired AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN has_call THEN 'Bash' ELSE 'unknown' END AS tool, CASE WHEN has_result THEN NOT bad END AS ok, CASE WHEN has_result THEN CAST(bad AS INTEGER) END AS exit_code,
    CASE WHEN has_result AND bad THEN 'command not found: tool' || (k % 7) ELSE '' END AS error_text, CASE WHEN NOT has_result THEN 0 WHEN bad THEN 23 + length(CAST(k % 7 AS VARCHAR)) ELSE 4 END AS bytes_out, CASE WHEN has_call THEN 'run' || (k % 3) || ' go' ELSE 'unknown' END AS head FROM calls
), judged AS (
  SELECT *, CASE WHEN ok = false THEN lower(tool) || ':command_not_found:' || head || ':tool' || (k % 7) END AS signature, CASE WHEN ok = false THEN coalesce(max(CASE WHEN ok THEN i END) OVER (PARTITION BY user_id, head) > i, false) END AS recovered FROM paired
)"""


@query(f"WITH {CALLS} SELECT event_id, user_id, CAST(i AS INTEGER) AS i, tool, coalesce(CAST(ok AS VARCHAR), 'none') AS ok, coalesce(exit_code, -1) AS exit_code, error_text, CAST(bytes_out AS INTEGER) AS bytes_out FROM paired")
def step_pairing(spark, sf_dir):
    """Calls with their results, calls without, and results without."""
    s = sessionize.steps_of(call_records(spark, sf_dir))
    return s.select(F.regexp_extract("uuid", "[0-9]+$", 0).cast("long").alias("event_id"), F.substring("file", 2, 20).cast("long").alias("user_id"), "i", "tool", F.coalesce(F.col("ok").cast("string"), F.lit("none")).alias("ok"), F.coalesce("exit_code", F.lit(-1)).alias("exit_code"), "error_text", "bytes_out")


@query(f"WITH {CALLS} SELECT event_id, head, signature, coalesce(ok = false, false) AS counts, coalesce(recovered, false) AS recovered FROM judged")
def recovery_rule(spark, sf_dir):
    """Heads, signatures, and which failures a later success of the same head makes good."""
    d = sessionize.described(sessionize.steps_of(call_records(spark, sf_dir)))
    return d.select(F.regexp_extract("uuid", "[0-9]+$", 0).cast("long").alias("event_id"), "head", "signature", "counts", F.coalesce("recovered", F.lit(False)).alias("recovered"))


@query(f"""WITH {STEPS}, c AS (
  SELECT *, CASE WHEN lag(tool) OVER w = tool THEN 0 ELSE 1 END AS change FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
n AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, max(n) AS longest FROM n GROUP BY user_id""")
def repeat_run_max(spark, sf_dir):
    return sessionize.longest_runs(steps(spark, sf_dir), ["user_id"], "event_id", "tool").withColumn("longest", F.col("longest").cast("long"))


@query("""WITH p AS (SELECT *, max(CASE WHEN role = 'user' AND turn % 4 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS start FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, start ORDER BY turn) AS nth FROM p)
SELECT conv_id, coalesce('p' || start, '_orphan:' || conv_id) AS prompt, count(*) FILTER (nth <= 3) AS records, max(nth) > 3 AS truncated FROM n GROUP BY conv_id, start HAVING bool_or(role = 'assistant' AND nth <= 3)""")
def group_cap(spark, sf_dir):
    """Turns as records, each fourth turn a prompt: groups along parent chains, three records at most."""
    turn, no_text = F.col("turn"), F.lit(None).cast("string")
    records = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("file"), turn.alias("pos"), turn.cast("string").alias("uuid"), F.when(turn > 0, (turn - 1).cast("string")).alias("parent_uuid"), F.when((F.col("role") == "user") & (turn % 4 == 0), F.concat(F.lit("p"), turn)).otherwise(no_text).alias("prompt_id"),
        F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("kind"), "text", F.lit(False).alias("is_meta"), F.array().cast("array<variant>").alias("blocks"),
    )
    return sessionize.prompt_groups(records, 3).groupBy(F.col("file").cast("long").alias("conv_id"), F.col("group").alias("prompt")).agg(F.count("*").alias("records"), F.bool_or("truncated").alias("truncated"))


@query(r"""SELECT conv_id, min(turn) FILTER (role = 'user' AND NOT regexp_matches(trim(text), '^/[\w-]+(?:\s+.*)?$')) AS first_turn, min_by(text, turn) FILTER (role = 'user' AND NOT regexp_matches(trim(text), '^/[\w-]+(?:\s+.*)?$')) AS request,
  count(*) FILTER (role = 'system') AS system_records FROM conversations GROUP BY conv_id""")
def prompt_requests(spark, sf_dir):
    real = (F.col("role") == "user") & ~sessionize.is_noise(F.col("role"), F.col("text"), F.lit(False))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.when(real, F.col("turn"))).alias("first_turn"), F.min_by("text", F.when(real, F.col("turn"))).alias("request"), F.count_if(F.col("role") == "system").alias("system_records"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_ms(ts) // 200 AS t, value, event_type FROM events), n AS (
  SELECT *, lead(t) OVER w - (t + CAST(floor(value * 100) AS BIGINT)) AS gap, lead(event_type) OVER w = 'view' AS scolds FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, CASE WHEN coalesce(scolds AND gap BETWEEN 0 AND 120000, false) OR event_type = 'error' THEN 'fail' ELSE 'unknown' END AS label,
  CASE WHEN coalesce(scolds AND gap BETWEEN 0 AND 120000, false) THEN 'weak' WHEN event_type = 'error' THEN 'strong' ELSE 'unknown' END AS tier FROM n""")
def request_and_rebuke(spark, sf_dir):
    """Events as episodes of sessions, labelled by rules and by the next request if it takes the answer back within two minutes."""
    at = F.floor(F.unix_millis(F.to_timestamp(F.col("ts").cast("string"))) / 200)
    text = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    none, bad = F.array().cast("array<string>"), F.col("event_type") == "error"
    episodes = table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 9, "0").alias("id"), F.col("user_id").alias("session_id"), text(at).alias("started"), text(at + F.floor(F.col("value") * 100)).alias("ended"), F.struct(F.when(F.col("event_type") == "view", " No, that is wrong").otherwise("go on").alias("text")).alias("request"),
        F.when(bad, F.struct(F.lit("s").alias("signature"))).alias("failure"), F.array().cast("array<struct<tool:string,command:string,exit_code:int>>").alias("steps"), F.struct(none.alias("files_written"), none.alias("files_edited")).alias("artifacts"),
        F.struct(F.lit(0).alias("api_errors"), F.lit(False).alias("interrupted"), F.lit(0).alias("repeat_command_max"), F.lit(0).alias("errored_tool_results")).alias("signals"),
    )
    return labels.label_sessions(episodes).select(F.col("id").cast("long").alias("event_id"), "outcome.label", "outcome.tier")


@query(f"""WITH {CALLS}, runs AS (
  SELECT user_id, head, i - row_number() OVER (PARTITION BY user_id, head ORDER BY i) AS run FROM judged
), longest AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, head, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY 1),
last AS (SELECT user_id, max_by(signature, i) AS failure, max_by(CASE WHEN has_call THEN 'run' || (k % 3) || ' go -v x' ELSE '' END, i) AS cmd FROM judged WHERE ok = false AND NOT recovered GROUP BY 1)
SELECT user_id, CAST(sum(CAST(has_call AS INTEGER) + CAST(has_result AS INTEGER)) AS BIGINT) AS n_records, count(*) AS tool_calls, count(*) FILTER (ok = false) AS errored, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS started, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS ended,
  epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS duration_ms, coalesce(string_agg(DISTINCT signature, ',' ORDER BY signature) FILTER (recovered), '') AS recovered, coalesce(string_agg(DISTINCT signature, ',' ORDER BY signature) FILTER (NOT recovered), '') AS unrecovered,
  max(longest) AS repeats, max(failure) AS failure, coalesce(max(cmd), '') AS witness, 'ep_sha256:' || substr(sha256('{{"agent_id":"main","prompt_id":"g","session_id":"' || user_id || '"}}'), 1, 16) AS id
FROM judged JOIN longest USING (user_id) LEFT JOIN last USING (user_id) GROUP BY user_id""")
def episode_rollup(spark, sf_dir):
    """One episode for each session: times, signals, failure and witness."""
    records = call_records(spark, sf_dir)
    e = sessionize.episodes_of(records, sessionize.steps_of(records))
    s = F.col("signals")
    joined = lambda name: F.array_join(s[name], ",")
    return e.select(F.col("session_id").cast("long").alias("user_id"), "n_records", s["tool_calls"].alias("tool_calls"), s["errored_tool_results"].alias("errored"), "started", "ended", "duration_ms", joined("recovered_signatures").alias("recovered"), joined("unrecovered_signatures").alias("unrecovered"), s["repeat_command_max"].cast("long").alias("repeats"), F.col("failure.signature").alias("failure"), F.coalesce("failure.witness.cmd", F.lit("")).alias("witness"), "id")


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY source <> 'src0', n_chars DESC, lpad(CAST(doc_id AS VARCHAR), 12, '0')) = 1")
def dedupe_preferred(spark, sf_dir):
    """Documents as episodes; those of one text are one, a session file's first."""
    e = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("session_id"), F.lit("p").alias("prompt_id"), F.lit("main").alias("agent_id"), F.when(F.col("source") == "src0", "session").otherwise("other").alias("source_kind"), F.col("n_chars").alias("n_records"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"))
    return sessionize.deduplicated(e).select("doc_id", "source", "n_chars")


def _sql_rewrites(column: str, rules) -> str:
    for pattern, to in rules:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return column


@query(f"SELECT doc_id, trim({_sql_rewrites('text', errors.NORMAL_FORM)}) AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", errors.normalize_error_text(F.col("text")).alias("normal"))


_case = " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, ps in errors.ERROR_RULES for p in ps)


@query(f"SELECT doc_id, CASE {_case} ELSE 'other' END AS error_class FROM documents")
def classify_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", errors.classify_error(F.col("text"))["error_class"].alias("error_class"))


@query(f"SELECT doc_id, {_sql_rewrites('text', [(p, to.replace(chr(92) + '$', '$') if chr(92) in to else to) for p, to in text.CAPTURE_REDACTIONS]).replace(chr(92) + '1=', '$1=')} AS redacted FROM documents")
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text"), text.CAPTURE_REDACTIONS).alias("redacted"))


@query("")
def redact_exemplars(spark, sf_dir):
    """What is shown of long-tail texts; its rules look ahead, which the SQL can't."""
    return table(spark, sf_dir, "documents").select("doc_id", text.redact_exemplar(F.col("text")).alias("shown"), text.redact(F.col("text")).alias("reported"))


@query("""SELECT p_partkey, 'go' || (p_size % 5) || ' --flag' AS head_form, regexp_replace('go' || (p_size % 5) || ' ' || p_brand, '\\b\\d+\\b', '<N>', 'g') AS head, 'bash:command_not_found:' || regexp_replace('go' || (p_size % 5) || ' ' || p_brand, '\\b\\d+\\b', '<N>', 'g') || ':tool' AS signature, 3 AS segments FROM part""".replace("\\\\", "\\"))
def command_heads(spark, sf_dir):
    """Commands with an assignment, a change of folder, flags, quotes and redirections: the head, the signature, and the number of segments."""
    go = F.concat(F.lit("go"), F.col("p_size") % 5)
    command = F.concat(F.lit("A_B=1 cd /tmp/x && "), go, F.lit(' --flag "'), "p_brand", F.lit('" third -z > out.txt 2>&1; echo "a; b | c"'))
    head = commands.cmd_head(F.lit("Bash"), F.col("command"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").withColumn("command", command).select("p_partkey", F.concat(go, F.lit(" --flag")).alias("head_form"), head.alias("head"), commands.error_signature(F.lit("Bash"), head, F.lit("command not found: tool")).alias("signature"), F.size(commands.command_segments(F.col("command"))).alias("segments"))


TOKENS = f"""toks AS (
  SELECT doc_id, lang, list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(trim({_sql_rewrites('text', errors.NORMAL_FORM)}), '(?i)<[A-Z][A-Z0-9_]*>', ' ', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS ws FROM documents
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM toks a JOIN toks b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.ws), len(b.ws)) >= 0.8 * greatest(len(a.ws), len(b.ws)) AND len(a.ws) > 0
  WHERE len(list_intersect(a.ws, b.ws)) >= 0.8 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))
)"""


def _token_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", text.tokens(F.col("text")).alias("words"))
    return clusters.similar_pairs(d, ["lang"], "doc_id", "words", 0.8)


@query(f"WITH {TOKENS} SELECT doc_id, len(ws) AS n_tokens, array_to_string(ws, ' ') AS words FROM toks")
def token_sets(spark, sf_dir):
    w = F.array_sort(text.tokens(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.array_join(w, " ").alias("words"))


@query(f"WITH {TOKENS} SELECT a, b FROM pairs")
def token_jaccard_pairs(spark, sf_dir):
    return _token_pairs(spark, sf_dir)


@query(f"""WITH RECURSIVE {TOKENS}, sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS v, a AS r FROM sym UNION SELECT reach.v, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT v AS vertex, min(r) AS component FROM reach GROUP BY v""")
def components(spark, sf_dir):
    """Texts of one language tied together by like words; equal sets hang on one of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", text.tokens(F.col("text")).alias("words"))
    return connected_components(clusters.similar_forest(d, ["lang"], "doc_id", "words", 0.8), "a", "b")


@query("""SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS label_pass, count(*) FILTER (quality = 0) AS label_fail, count(*) FILTER (quality = 1 AND toxic = 1) AS label_unknown,
  count(*) FILTER (doc_id % 4 = 0) AS tier_gold, count(*) FILTER (doc_id % 4 = 1) AS tier_strong, count(*) FILTER (doc_id % 4 = 2) AS tier_weak, count(*) FILTER (doc_id % 4 = 3) AS tier_unknown FROM labels""")
def tier_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 0, "fail").when(F.col("toxic") == 0, "pass").otherwise("?").alias("l"), F.element_at(F.array(*map(F.lit, labels.TIERS)), (F.col("doc_id") % 4).cast("int") + 1).alias("t"))
    return labels.tier_counts(rows, "l", "t")


USERS = f"""{STEPS}, users AS (
  SELECT user_id, count(*) FILTER (NOT ok) AS errored, max(k) FILTER (NOT ok) > 95 AS failed, bool_or(tool = 'purchase' AND value > 98) AS green, count(*) FILTER (tool = 'signup') > 10 AS edited,
    count(*) FILTER (tool = 'click' AND value < 1) AS api_errors, bool_or(tool = 'view' AND value < 0.5) AS interrupted FROM steps GROUP BY user_id
)"""


def _users(spark, sf_dir):
    c = F.count_if
    return steps(spark, sf_dir).groupBy("user_id").agg(
        c(~F.col("ok")).alias("errored"), F.coalesce(F.max(F.when(~F.col("ok"), F.col("k"))) > 95, F.lit(False)).alias("failed"), F.bool_or((F.col("tool") == "purchase") & (F.col("value") > 98)).alias("green"),
        (c(F.col("tool") == "signup") > 10).alias("edited"), c((F.col("tool") == "click") & (F.col("value") < 1)).alias("api_errors"), F.bool_or((F.col("tool") == "view") & (F.col("value") < 0.5)).alias("interrupted"),
    )


def _user_outcomes(spark, sf_dir):
    o = labels.label_rules(F.col("failed"), F.col("green"), F.col("edited"), F.col("api_errors"), F.col("interrupted"), F.lit(0), F.col("errored"))
    return _users(spark, sf_dir).withColumn("o", o)


LABELLED = f"""{USERS}, labelled AS (
  SELECT *, CASE WHEN failed THEN 'fail' WHEN green AND edited THEN 'pass' WHEN api_errors > 0 OR interrupted THEN 'fail' WHEN edited AND errored = 0 THEN 'pass' ELSE 'unknown' END AS label,
    CASE WHEN failed OR (green AND edited) THEN 'strong' WHEN api_errors > 0 OR interrupted OR (edited AND errored = 0) THEN 'weak' ELSE 'unknown' END AS tier FROM (SELECT * REPLACE (coalesce(failed, false) AS failed) FROM users)
)"""


@query(f"WITH {LABELLED} SELECT user_id, label, tier FROM labelled")
def label_rules(spark, sf_dir):
    return _user_outcomes(spark, sf_dir).select("user_id", "o.label", "o.tier")


@query(f"""WITH {LABELLED} SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'pass' ELSE label END AS label, CASE WHEN user_id % 5 = 0 THEN 'gold' ELSE tier END AS tier FROM labelled""")
def merged_outcomes(spark, sf_dir):
    gold = F.when(F.col("user_id") % 5 == 0, labels.outcome("pass", "gold", 1, "merge"))
    return _user_outcomes(spark, sf_dir).withColumn("m", labels.merge_outcomes(F.array("o", gold))).select("user_id", "m.label", "m.tier")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'fail' WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'unknown' END AS label,
  CASE WHEN o_orderstatus NOT IN ('P', 'F') THEN 'unknown' WHEN o_orderpriority LIKE '1%' OR o_custkey % 3 = 0 THEN 'weak' ELSE 'gold' END AS tier FROM orders""")
def factory_labels(spark, sf_dir):
    s = F.col("o_orderstatus")
    row = {"rework_attempt": F.lit(0), "terminal_state": F.when(s == "P", "needs-human").when(s == "F", "shipped").otherwise("open"), "tests_ok": F.lit(True), "override_applied": F.when(F.col("o_orderpriority").startswith("1"), "yes").otherwise("none"), "tests_source": F.when(F.col("o_custkey") % 3 == 0, "prose").otherwise("run"), "review_parse_ok": F.lit(True)}
    o = labels.factory_outcome(row)
    return table(spark, sf_dir, "orders").select("o_orderkey", o["label"].alias("label"), o["tier"].alias("tier"))


@query("""WITH prs AS (SELECT 'org/r' || (c_custkey % 3) AS repo, c_custkey AS number, 'b' || (c_custkey % 1000) AS ref, c_acctbal > 0 AS merged FROM customer),
ep AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'b' || (o_custkey % 1200) ELSE '' END AS branch, 'r' || (o_orderkey % 3) AS project, o_custkey % 1700 AS issue FROM orders),
bm AS (SELECT id, count(*) AS n, min(repo) AS repo, min(number) AS number, bool_and(merged) AS merged FROM ep JOIN prs ON branch = ref GROUP BY id),
im AS (SELECT id, count(*) AS n, min(repo) AS repo, min(number) AS number, bool_and(merged) AS merged FROM ep JOIN prs ON number = issue AND repo = 'org/' || project GROUP BY id)
SELECT ep.id, CASE WHEN bm.n = 1 THEN 'branch' WHEN bm.n IS NULL AND im.n = 1 THEN 'issue_repo' END AS rule, CASE WHEN bm.n = 1 THEN bm.number WHEN bm.n IS NULL AND im.n = 1 THEN im.number END AS number,
  CASE WHEN bm.n = 1 THEN CASE WHEN bm.merged THEN 'pass' ELSE 'fail' END WHEN bm.n IS NULL AND im.n = 1 THEN CASE WHEN im.merged THEN 'pass' ELSE 'fail' END END AS label,
  CASE WHEN bm.n > 1 THEN 'ambiguous_branch' WHEN bm.n IS NULL AND im.n > 1 THEN 'ambiguous_issue_repo' END AS reason FROM ep LEFT JOIN bm USING (id) LEFT JOIN im USING (id)""")
def pr_link_unique(spark, sf_dir):
    key = F.col("c_custkey")
    prs = table(spark, sf_dir, "customer").select(F.concat(F.lit("org/r"), key % 3).alias("repo"), key.alias("number"), F.concat(F.lit("b"), key % 1000).alias("headRefName"), (F.col("c_acctbal") > 0).alias("merged"), (F.col("c_acctbal") <= 0).alias("closedUnmerged"))
    ep = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("b"), F.col("o_custkey") % 1200)).otherwise("").alias("git_branch"), F.concat(F.lit("r"), F.col("o_orderkey") % 3).alias("project"), F.lit("/w").alias("cwd"), F.concat(F.lit("fix #"), F.col("o_custkey") % 1700, F.lit(" now")).alias("haystack"))
    return labels.link_pull_requests(ep, prs).select("id", "rule", "number", "label", "reason")


@query("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
c AS (SELECT a.event_id AS step_id, b.event_id AS row_id, abs(a.t - b.t) AS distance FROM a JOIN b USING (user_id) WHERE abs(a.t - b.t) <= 21600000000),
d AS (SELECT *, min(distance) OVER (PARTITION BY step_id) AS ms, min(distance) OVER (PARTITION BY row_id) AS mr FROM c),
e AS (SELECT *, count(*) FILTER (distance = ms) OVER (PARTITION BY step_id) AS ns, count(*) FILTER (distance = mr) OVER (PARTITION BY row_id) AS nr FROM d)
SELECT step_id, row_id, distance FROM e WHERE distance = ms AND distance = mr AND ns = 1 AND nr = 1""")
def nearest_capture(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.to_timestamp(F.col("ts").cast("string"))))
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("step_id"), "at")
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("row_id"), "at")
    return labels.mutual_nearest(a, b, ["user_id"], 21_600)


@query("SELECT item_id, CAST(('0x' || substr(sha256('s1' || item_id), 1, 4))::INTEGER % 100 AS INTEGER) AS bucket, CASE WHEN ('0x' || substr(sha256('s1' || item_id), 1, 4))::INTEGER % 100 < 40 THEN 'heldout' ELSE 'dev' END AS split FROM benchmark")
def heldout_split(spark, sf_dir):
    return measure.heldout_split(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "s1")


ARMS = "arms AS (SELECT user_id AS task, avg(CASE WHEN event_id % 2 = 0 THEN CAST(value > 50 AS INTEGER) END) AS before, avg(CASE WHEN event_id % 2 = 1 THEN CAST(value > 45 AS INTEGER) END) AS after, count(*) FILTER (event_id % 2 = 0) AS n_before, count(*) FILTER (event_id % 2 = 1) AS n_after FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 2 = 0) > 0 AND count(*) FILTER (event_id % 2 = 1) > 0)"


def _arms(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trial_id"), F.when(even, "before").otherwise("after").alias("arm"), (F.col("value") > F.when(even, 50).otherwise(45)).cast("int").alias("passed"))
    return measure.arm_means(rows)


@query(f"WITH {ARMS} SELECT task, n_before, n_after, round(before, 9) AS before, round(after, 9) AS after, round(after - before, 9) AS delta FROM arms")
def arm_means(spark, sf_dir):
    return _arms(spark, sf_dir).select("task", "n_before", "n_after", *(F.round(c, 9).alias(c) for c in ("before", "after", "delta")))


@query(f"WITH {ARMS} SELECT count(*) FILTER (b = 1 AND a < 1) AS regressions, count(*) FILTER (b = 0 AND a > 0) AS fixes FROM (SELECT CASE WHEN task % 3 = 0 THEN round(before) WHEN task % 3 = 1 THEN 0 ELSE before END AS b, after AS a FROM arms)")
def hard_regressions(spark, sf_dir):
    """Some rates before are 0 or 1, all others lie between; rates after aren't rounded."""
    third = F.col("task") % 3
    return measure.hard_regressions(_arms(spark, sf_dir).withColumn("before", F.when(third == 0, F.round("before")).when(third == 1, 0.0).otherwise(F.col("before"))))


_MIXED = "xor(t, (t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296)"
_DRAW = f"(xor({_MIXED}, {_MIXED} >> 14) / 4294967296.0)"


BOOTSTRAP = f"""{ARMS}, xs AS (SELECT round(after - before, 9) AS d, row_number() OVER (ORDER BY task) - 1 AS j, count(*) OVER () AS n FROM arms),
draws AS (SELECT i, i * n + j AS q, n FROM range(10000) r(i), (SELECT j, n FROM xs)),
s AS (SELECT i, n, (42 + (CAST(1831565813 AS HUGEINT) * (q + 1)) % 4294967296) % 4294967296 AS a FROM draws),
t AS (SELECT i, n, (xor(a, a >> 15) * (a | 1)) % 4294967296 AS t FROM s),
m AS (SELECT i, sum(xs.d) / max(t.n) AS m FROM (SELECT i, n, CAST(floor({_DRAW} * n) AS BIGINT) AS p FROM t) t JOIN xs ON xs.j = t.p GROUP BY i),
ci AS (SELECT (SELECT max(n) FROM xs) AS n, round((SELECT avg(d) FROM xs), 9) AS point, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi FROM m)"""


@query(f"WITH {BOOTSTRAP} SELECT n, point, lo, hi FROM ci")
def bootstrap_ci(spark, sf_dir):
    deltas = _arms(spark, sf_dir).select("task", F.round("delta", 9).alias("delta"))
    return stats.bootstrap_mean(deltas).select("n", *(F.round(c, 9).alias(c) for c in ("point", "lo", "hi")))


@query(f"""WITH {BOOTSTRAP}, hard AS (SELECT count(*) FILTER (before = 1 AND after < 1) AS regressions, count(*) FILTER (before = 0 AND after > 0) AS fixes FROM arms)
SELECT CASE WHEN regressions > 0 THEN 'regressed' WHEN n >= 60 AND lo > 0.02 THEN 'helped' WHEN lo <= 0 AND hi >= 0 AND hi - lo < 0.1 THEN 'no_effect' ELSE 'inconclusive' END AS verdict, n, point AS delta, lo, hi, regressions, fixes, n >= 60 AS powered FROM ci, hard""")
def verdict(spark, sf_dir):
    pairs = _arms(spark, sf_dir).withColumn("delta", F.round("delta", 9))
    return measure.judge(pairs, band=0.02).select("verdict", "n", *(F.round(c, 9).alias(c) for c in ("delta", "lo", "hi")), "regressions", "fixes", "powered")


@query("""WITH r AS (SELECT event_id // 2 AS cell, user_id % 7 AS task, event_id % 2 AS run, event_type <> 'signup' AS completed, value > 60 AS bad FROM events),
d AS (SELECT a.task, abs(CAST(a.bad AS INTEGER) - CAST(b.bad AS INTEGER)) AS delta FROM r a JOIN r b ON a.cell = b.cell AND a.task = b.task AND a.run = 0 AND b.run = 1 AND a.completed AND b.completed)
SELECT t.task AS task_id, count(delta) AS n, CAST(coalesce(quantile_disc(delta, 0.95), 0) AS DOUBLE) AS band95 FROM (SELECT DISTINCT task FROM r) t LEFT JOIN d USING (task) GROUP BY 1""")
def aa_band(spark, sf_dir):
    """Two control runs paired by place; the band that an effect has to clear."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("task_id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("run"), F.floor(F.col("event_id") / 2).alias("repeat"), (F.col("event_type") != "signup").alias("completed"), (F.col("value") > 60).alias("reproduced"))
    return measure.aa_band(rows)


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS arm, CAST(sum(CASE WHEN coalesce(value > 20, true) AND (user_id % 5 = 0 OR event_type <> 'error') THEN 1 ELSE 0 END) AS BIGINT) AS passes, count(*) AS n FROM events GROUP BY 1")
def trial_passes(spark, sf_dir):
    """Recorded trials scored by arm: what completed without the expected signature, or expects none."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("arm"), F.lit(None).cast("boolean").alias("completed"), (F.col("value") <= 20).alias("timed_out"), F.when(F.col("event_type") == "error", "it says: error").otherwise("fine").alias("output"), F.when(F.col("user_id") % 5 == 0, "").otherwise("error").alias("expected_signature"))
    return measure.arm_passes(measure.scored(rows))


@query("SELECT count(*) AS tasks_total, count(*) FILTER (c_mktsegment = 'BUILDING') AS tasks_helped, CAST(sum(c_nationkey * 2) AS BIGINT) AS gold_episodes, CAST(sum(c_custkey % 7) AS BIGINT) AS sandboxes, round(sum(c_custkey % 10 / 4.0), 1) AS elapsed_s FROM customer")
def benchmark_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "helped").otherwise("no_effect").alias("verdict"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 7).alias("sandboxes"), (F.col("c_custkey") % 10 / 4.0).alias("elapsed_s"))
    return measure.benchmark_totals(rows)


@query("""SELECT lang, n, round(greatest(0.0, c - h), 9) AS lo, round(least(1.0, c + h), 9) AS hi FROM (
  SELECT lang, n, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS c, 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) AS h FROM (
    SELECT lang, count(*) AS n, avg(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY lang))""")
def wilson_by_group(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("s"), F.count("*").alias("n"))
    w = stats.wilson(F.col("s"), F.col("n"))
    return d.select("lang", "n", F.round(w["lo"], 9).alias("lo"), F.round(w["hi"], 9).alias("hi"))


@query("""SELECT round(pb - pa, 9) AS diff, round(sqrt(p * (1 - p) * (1.0 / na + 1.0 / nb)), 9) AS se, round((pb - pa) / sqrt(p * (1 - p) * (1.0 / na + 1.0 / nb)), 7) AS z FROM (
  SELECT na, nb, sa / na AS pa, sb / nb AS pb, (sa + sb) / (na + nb) AS p FROM (
    SELECT count(*) FILTER (toxic = 0) AS na, count(*) FILTER (toxic = 1) AS nb, count(*) FILTER (toxic = 0 AND doc_id % 3 = 0) AS sa, count(*) FILTER (toxic = 1 AND doc_id % 3 = 0) AS sb FROM labels))""")
def two_proportion(spark, sf_dir):
    third = F.col("doc_id") % 3 == 0
    c = table(spark, sf_dir, "labels").agg(F.count_if((F.col("toxic") == 0) & third).alias("a"), F.count_if(F.col("toxic") == 0).alias("an"), F.count_if((F.col("toxic") == 1) & third).alias("b"), F.count_if(F.col("toxic") == 1).alias("bn"))
    t = stats.two_proportion(F.col("a"), F.col("an"), F.col("b"), F.col("bn"))
    return c.select(F.round(t["diff"], 9).alias("diff"), F.round(t["se"], 9).alias("se"), F.round(t["z"], 7).alias("z"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(1.96 * stddev_samp(value), 6) AS band95,
  round(quantile_cont(value, 0.95), 6) AS p95, round(list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS INTEGER)], 6) AS nearest95 FROM events GROUP BY event_type""")
def noise_band(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy("event_type").agg(stats.noise_band(F.col("value")).alias("b"), F.percentile("value", F.lit(0.95)).alias("p95"), F.expr("percentile_disc(0.95) within group (order by value)").alias("nearest95"))
    return b.select("event_type", "b.n", *(F.round(f"b.{c}", 6).alias(c) for c in ("mean", "sd", "band95")), F.round("p95", 6).alias("p95"), F.round("nearest95", 6).alias("nearest95"))


DAYS = "history AS (SELECT date_trunc('hour', ts) AS ts, 100 + CAST(sum(count(*)) OVER (ORDER BY date_trunc('hour', ts)) AS BIGINT) - 40 * (row_number() OVER (ORDER BY date_trunc('hour', ts)) % 2) AS episodes, count(*) FILTER (event_type = 'error') AS fails FROM events GROUP BY 1)"


@query(f"""WITH {DAYS}, n AS (SELECT *, coalesce(greatest(0, episodes - lag(episodes) OVER (ORDER BY ts)), 0) AS new FROM history)
SELECT strftime(ts, '%Y-%m-%d') AS date, max(ts) AS ts, max_by(episodes, ts) AS episodes, max_by(fails, ts) AS fails, round(max_by(fails, ts) / max_by(episodes, ts), 9) AS fail_rate, CAST(sum(new) AS BIGINT) AS new_episodes FROM n GROUP BY 1""")
def trend_daily(spark, sf_dir):
    hour = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("fail_labels"))
    w = W.orderBy("ts")  # one row for each hour
    history = hour.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "fail_labels", (100 + F.sum("n").over(w) - 40 * (F.row_number().over(w) % 2)).alias("episodes"))
    return reports.trend(history).withColumn("fail_rate", F.round("fail_rate", 9))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS episodes, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def timeline(spark, sf_dir):
    return reports.timeline(table(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("started"), F.when(F.col("event_type") == "error", "fail").alias("label")))


@query("SELECT source, count(*) AS episodes, count(*) FILTER (quality = 0) AS failures, round(count(*) FILTER (quality = 0) / count(*), 9) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def by_project(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("label", F.when(F.col("quality") == 0, "fail").otherwise("pass"))
    return reports.by_group(d, "source").withColumn("rate", F.round("rate", 9))


@query("SELECT event_type, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS pct FROM events GROUP BY event_type")
def share_rows(spark, sf_dir):
    return reports.share_rows(table(spark, sf_dir, "events"), "event_type").withColumn("pct", F.round("pct", 9))


@query(f"""WITH {LABELLED} SELECT count(*) AS episodes, count(*) FILTER (failed OR label = 'fail') AS failures, count(*) FILTER (failed) AS witnessed_failures, count(*) FILTER (NOT failed AND label = 'fail') AS weak_signal_failures,
  count(*) FILTER (label = 'pass') AS passes, count(DISTINCT user_id % 10) AS projects, count(DISTINCT user_id) AS sessions, count(*) FILTER (failed AND green) AS replayable_witnesses,
  count(*) FILTER (NOT failed AND label = 'fail' AND api_errors > 0) AS weak_api_error, count(*) FILTER (NOT failed AND label = 'fail' AND api_errors = 0 AND interrupted) AS weak_interrupted, CAST(0 AS BIGINT) AS weak_stuck_retry, CAST(0 AS BIGINT) AS weak_other,
  round(coalesce(count(*) FILTER (label = 'fail') / nullif(count(*) FILTER (label IN ('fail', 'pass')), 0), 0), 9) AS failure_rate FROM labelled""")
def atlas_totals(spark, sf_dir):
    u = _user_outcomes(spark, sf_dir).select((F.col("user_id") % 10).alias("project"), F.col("user_id").alias("session_id"), "o.label", F.col("failed").alias("witnessed"), F.col("green").alias("replayable"), "api_errors", "interrupted", F.lit(0).alias("repeats"))
    return reports.totals(u).withColumn("failure_rate", F.round("failure_rate", 9))


@query("""WITH c AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey) AS spent, row_number() OVER (ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, p_size, CAST(spent AS BIGINT) AS spent FROM c WHERE spent <= 2000 AND n <= 60""")
def budget_cutoff(spark, sf_dir):
    return measure.budgeted(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"], "p_size", 60, 2000)


@query("""WITH r AS (SELECT user_id, event_id // 1000 AS checkpoint, round(avg(value), 6) AS rate FROM events GROUP BY ALL), d AS (SELECT *, lag(rate) OVER (PARTITION BY user_id ORDER BY checkpoint) - rate AS drop FROM r)
SELECT user_id, checkpoint AS pivot, round(drop, 6) AS drop FROM d WHERE drop IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY drop DESC, checkpoint) = 1""")
def pivot_drop(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 1000).cast("long").alias("checkpoint")).agg(F.round(F.avg("value"), 6).alias("rate"))
    return measure.pivot_drop(r, ["user_id"]).withColumn("drop", F.round("drop", 6))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS is_object FROM events")
def props_json(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.schema_of_variant(v).startswith("OBJECT").alias("is_object"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("""SELECT conv_id, turn, 'ep_sha256:' || substr(sha256('{"agent_id":"main","prompt_id":"' || turn || '","session_id":"' || conv_id || '"}'), 1, 16) AS id FROM conversations""")
def content_id(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_id("ep", {"session_id": s("conv_id"), "prompt_id": s("turn"), "agent_id": F.lit("main")}).alias("id"))


_CLASSES = errors.ERROR_CLASSES


@query(f"""WITH c AS (SELECT p_partkey, ({list(_CLASSES)!r})[1 + p_partkey % {len(_CLASSES)}] AS cls, p_brand FROM part)
SELECT p_partkey, CASE WHEN cls IN ('user_rejected', 'tool_unavailable', 'stale_reference') THEN NULL WHEN cls IN {planning.SKILL!r} THEN 'skill' WHEN cls IN {planning.SCAFFOLDING!r} THEN 'scaffolding' ELSE 'context' END AS layer,
  CASE WHEN cls IN ('user_rejected', 'tool_unavailable', 'stale_reference') THEN NULL WHEN cls IN {planning.CONTEXT + planning.SKILL!r} THEN 'auto' ELSE 'human-gate' END AS requires,
  CASE WHEN cls IN {planning.SKILL!r} THEN '.claude/skills/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '/SKILL.md' END AS skill FROM c""")
def route_clusters(spark, sf_dir):
    cls = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("p_partkey") % len(_CLASSES)).cast("int") + 1)
    r = planning.route(cls, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", r["layer"].alias("layer"), r["requires"].alias("requires"), F.when(r["layer"] == "skill", r["surface"]).alias("skill"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR p_size > 20 THEN 'block' WHEN p_partkey % 3 = 0 THEN 'approve' ELSE 'human-gate' END AS decision FROM part""")
def gate_patches(spark, sf_dir):
    key = F.col("p_partkey")
    target = F.when(key % 4 == 0, "a/.ssh/id_rsa").otherwise(F.lit("docs/CLAUDE.md"))
    return table(spark, sf_dir, "part").select("p_partkey", planning.gate(target, F.lit(1), F.lit(1), F.col("p_size"), F.when(key % 3 == 0, "auto").otherwise("human-gate"), F.lit("skill")).alias("decision"))


@query("SELECT user_id AS witness_id, count(*) AS n, count(DISTINCT event_type) = 1 AS stable, round(coalesce(stddev_samp(CAST(event_type = 'error' AS INTEGER)), 0), 9) AS sd FROM events GROUP BY user_id")
def witness_stability(spark, sf_dir):
    code = F.when(F.col("event_type") == "error", 0).otherwise(F.ascii(F.substring("event_type", 2, 1)) + F.length("event_type") * 1000)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("witness_id"), code.alias("exit_code"))
    return measure.witness_stability(rows).withColumn("sd", F.round("sd", 9))


@query("""WITH p AS (SELECT avg(CAST(o_totalprice > 100000 AS INTEGER)) AS mean, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '5%'), t AS (SELECT o_custkey, avg(CAST(o_totalprice > 100000 AS INTEGER)) AS r FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1)
SELECT round(mean, 9) AS mean, n, (SELECT count(*) FROM t) AS tasks, round(greatest(0, mean - 1.96 * sqrt(greatest(mean * (1 - mean), 1e-4) / n)), 9) AS lo, round(least(1, mean + 1.96 * sqrt(greatest(mean * (1 - mean), 1e-4) / n)), 9) AS hi FROM p""")
def rollout_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.lit("m").alias("mode"), (F.col("o_totalprice") > 100000).alias("passed"), F.col("o_orderpriority").startswith("5").alias("excluded"))
    return measure.rollout_summary(rows).select(F.round("mean", 9).alias("mean"), "n", "tasks", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("""SELECT o_orderpriority AS mode, count(*) FILTER (o_orderstatus = 'F') AS kept, count(*) AS tried, round(avg(o_totalprice), 2) AS avg_gain,
  CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'reliable' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'never' ELSE 'flaky' END AS reliability FROM orders GROUP BY 1""")
def lesson_reliability(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mode"), (F.col("o_orderstatus") == "F").alias("kept"), F.col("o_totalprice").alias("gain"))
    return measure.lesson_reliability(rows).withColumn("avg_gain", F.round("avg_gain", 2))


@query("SELECT t.item_id, r.repeat, a.arm FROM benchmark t, range(1, 6) r(repeat), (VALUES ('before'), ('after')) a(arm)".replace("range(1, 6) r(repeat)", "(SELECT CAST(range AS INTEGER) AS repeat FROM range(1, 6)) r"))
def trial_plan(spark, sf_dir):
    return measure.plan_trials(table(spark, sf_dir, "benchmark").select("item_id"), repeats=3)


@query("""SELECT doc_id, CASE WHEN length(text) <= 2048 THEN text ELSE substr(text, 1, 1017) || ' …[truncated]… ' || right(text, 1016) END AS capped, substr(text, 1, 2048) AS request FROM documents""")
def capped_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.cap_middle(F.col("text")).alias("capped"), text.cap_head(F.col("text")).alias("request"))


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS node, c_custkey // 2 AS parent, CASE WHEN c_custkey < 20 THEN c_mktsegment END AS value FROM customer),
up AS (SELECT node, parent, value FROM n UNION ALL SELECT up.node, n.parent, n.value FROM up JOIN n ON up.value IS NULL AND n.node = up.parent)
SELECT node, max(value) AS value FROM up GROUP BY node""")
def parent_chains(spark, sf_dir):
    key = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(F.lit("f").alias("file"), key.cast("string").alias("uuid"), F.floor(key / 2).cast("string").alias("parent"), F.when(key < 20, F.col("c_mktsegment")).alias("prompt"))
    return inherited(nodes, "file", "uuid", "parent", "prompt").select(F.col("uuid").cast("long").alias("node"), "value")


@query("""SELECT n_name, r_name, count(*) AS orders, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def volume_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
