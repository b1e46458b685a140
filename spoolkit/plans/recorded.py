"""More queries over the standard tables: recorded trials, plans, captures, streams and schemas.

They are registered next to those of ``catalog``, whose conventions hold here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spoolkit.functions import errors, stats, text
from spoolkit.operators import labels, measure, planning, validation
from spoolkit.plans import catalog
from spoolkit.plans.catalog import query, table
from spoolkit.storage import new_path
from spoolkit.streaming import ingest


def _k(column: str = "props"):
    return F.get_json_object(column, "$.k").cast("long")


_SQL_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY x) - 1 AS task, least(1.0, greatest(0.0, x)) AS before FROM (SELECT n_nationkey / 10.0 - 0.3 AS x FROM nation)),
a AS (SELECT row_number() OVER (ORDER BY x) - 1 AS task, least(1.0, greatest(0.0, x)) AS after FROM (SELECT 1.2 - n_nationkey / 15.0 AS x FROM nation WHERE n_nationkey < 20))
SELECT CAST(task AS INTEGER) AS task, round(CAST(before AS DOUBLE), 9) AS before, round(CAST(after AS DOUBLE), 9) AS after, round(CAST(after - before AS DOUBLE), 9) AS delta FROM a JOIN b USING (task)""")
def positional_pairs(spark, sf_dir):
    """Two lists of rates paired by place, held to 0 and 1, as far as the shorter reaches."""
    key, bad = F.col("n_nationkey"), F.lit(float("nan"))
    rates = table(spark, sf_dir, "nation").agg(
        F.concat(F.array(bad), F.array_sort(F.collect_list(key / 10.0 - 0.3))).alias("before"), F.concat(F.array_sort(F.collect_list(F.when(key < 20, 1.2 - key / 15.0))), F.array(F.lit(float("inf")))).alias("after")
    )
    return measure.positional_pairs(rates).select("task", *(F.round(c, 9).alias(c) for c in ("before", "after", "delta")))


@query("SELECT item_id AS task_id, CAST(r.range AS INTEGER) AS repeat, run FROM benchmark, range(20) r, (VALUES ('a'), ('b')) v(run)")
def aa_trials(spark, sf_dir):
    """Two control runs of each task; thirty are asked for, twenty are the most."""
    return measure.aa_plan(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id")), 30)


@query("""WITH runs AS (SELECT c_custkey AS k, c_acctbal / 2 AS baseline, c_acctbal AS final FROM customer)
SELECT (SELECT bool_and(final > baseline) FROM runs) AS climbs, (SELECT k FROM runs WHERE k % 10 <> 0 ORDER BY final DESC, k LIMIT 1) AS best_k, (SELECT max(final) FROM runs WHERE k % 10 <> 0) AS best_final, round((SELECT avg(final) FROM runs WHERE k % 10 = 0), 6) AS mean_final""")
def scaling_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("K"), (F.col("c_acctbal") / 2).alias("baseline"), F.col("c_acctbal").alias("final"))
    return measure.scaling_summary(runs.where("K % 10 <> 0"), runs.where("K % 10 = 0")).withColumn("mean_final", F.round("mean_final", 6))


@query("SELECT 'f' || (user_id % 50) AS file, CAST(greatest(0, floor(max(value * 10 - 300))) AS BIGINT) AS position FROM events GROUP BY 1")
def cursor_merge(spark, sf_dir):
    """How far two runs have read each file; negative and non-finite positions are none."""
    e = table(spark, sf_dir, "events")
    name, at = F.concat(F.lit("f"), F.col("user_id") % 50).alias("file"), F.col("value") * 10 - 300
    half = lambda n: e.where(F.col("event_id") % 2 == n)
    broken = half(1).select(name, F.lit(float("nan")).alias("position")).distinct()
    return planning.merge_cursors(half(0).select(name, at.alias("position")), half(1).select(name, at.alias("position")).unionByName(broken))


@query("SELECT event_type AS mode, count(*) AS failures FROM events WHERE value <= 50 AND event_id % 5 <> 0 AND event_type <> 'view' GROUP BY 1 ORDER BY failures DESC, mode LIMIT 1")
def worst_mode(spark, sf_dir):
    """The mode with most failures that hasn't been tried."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), (F.col("value") > 50).alias("passed"), (F.col("event_id") % 5 == 0).alias("excluded"))
    return measure.worst_mode(rows, ["view"])


@query("""WITH r AS (SELECT o_totalprice / 1e6 AS baseline, o_totalprice / 1e6 + 0.1 + o_custkey % 3 / 100.0 AS final FROM orders), g AS (SELECT *, final - baseline AS gain FROM r)
SELECT count(*) AS runs, round(avg(baseline), 9) AS mean_baseline, round(min(baseline), 9) AS min_baseline, round(max(baseline), 9) AS max_baseline, round(avg(final), 9) AS mean_final, round(min(final), 9) AS min_final, round(max(final), 9) AS max_final,
  round(avg(gain), 9) AS mean_gain, round(min(gain), 9) AS min_gain, round(max(gain), 9) AS max_gain, max(final) - min(final) <= 0.15 AND min(gain) > 0 AS reproduced FROM g""")
def replication_summary(spark, sf_dir):
    price = F.col("o_totalprice") / 1e6
    found = measure.replication_summary(table(spark, sf_dir, "orders").select(price.alias("baseline"), (price + 0.1 + F.col("o_custkey") % 3 / 100.0).alias("final")))
    return found.select("runs", *(F.round(f"{f}_{c}", 9).alias(f"{f}_{c}") for c in ("baseline", "final", "gain") for f in ("mean", "min", "max")), "reproduced")


@query("""WITH w AS (SELECT user_id, event_id // 100 AS part, count(DISTINCT event_type) = 1 AS one FROM events GROUP BY ALL)
SELECT count(*) AS witnesses, count(*) FILTER (one) AS stable, count(*) FILTER (NOT one) AS unstable, round(count(*) FILTER (one) * CAST(100 AS DOUBLE) / count(*), 9) AS clean_pct FROM w""")
def stability_summary(spark, sf_dir):
    """How many witnesses always return the same exit code."""
    code = F.when(F.col("event_type") == "error", 0).otherwise(F.ascii(F.substring("event_type", 2, 1)) + F.length("event_type") * 1000)
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 100)).alias("witness_id"), code.alias("exit_code"))
    return measure.stability_summary(measure.witness_stability(rows)).withColumn("clean_pct", F.round(F.col("clean_pct").cast("double"), 9))


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND user_id % 5 <> 0")
def witnesses_to_replay(spark, sf_dir):
    """Witnesses whose mode or class is a timeout are left out."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "timeout").alias("mode"), F.when(F.col("user_id") % 5 == 0, "timeout").otherwise("usage_error").alias("error_class"))
    return measure.without_timeouts(rows).select("event_id")


@query(f"""SELECT event_id, event_id % 11 <> 0 AND {_SQL_K} % 3 = 0 AND event_type <> 'error' AS passed, event_id % 11 = 0 AS excluded, event_id % 22 = 0 AS retry, left(repeat('.', CAST({_SQL_K} * 20 AS INTEGER)) || CASE WHEN event_type = 'error' THEN 'no' ELSE 'total 1429 rows MARK' END, 800) AS output FROM events""")
def graded_attempts(spark, sf_dir):
    """Attempts graded by exit code and a marker in the whole output; those whose agent failed are excluded."""
    k = _k()
    rows = table(spark, sf_dir, "events").select(
        "event_id", (k % 3).alias("exit_code"), F.concat(F.expr("repeat('.', cast(get_json_object(props, '$.k') as int) * 20)"), F.when(F.col("event_type") == "error", "no").otherwise("total 1429 rows MARK")).alias("output"), F.lit("MARK").alias("marker"),
        F.when(F.col("event_id") % 22 == 0, "Too many requests").when(F.col("event_id") % 11 == 0, "crashed").alias("error"),
    )
    return measure.graded(rows).select("event_id", "passed", "excluded", "retry", "output")


@query(f"SELECT event_id AS trial_id, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS arm, {_SQL_K} AS repeat, CASE WHEN event_type = 'view' THEN 'unknown' WHEN value > 50 THEN 'pass' ELSE 'fail' END AS label, CASE WHEN event_type = 'view' THEN 'unknown' ELSE 'gold' END AS tier FROM events")
def gold_episodes(spark, sf_dir):
    """Completed trials as gold outcomes, others unknown."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("trial_id"), F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("arm"), _k().alias("repeat"), (F.col("event_type") != "view").alias("completed"), (F.col("value") > 50).cast("int").alias("passed"))
    return measure.gold_episodes(rows)


@query("SELECT c_custkey AS task_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def registry_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.when(F.col("c_mktsegment") == "BUILDING", "holdout").otherwise("train").alias("split"))
    return measure.tasks_of(rows, "holdout").select("task_id")


@query("SELECT p_partkey, 'print(\"' || p_name || '\")' || chr(10) AS code, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS lesson FROM part")
def answers_read(spark, sf_dir):
    """The code of a fenced answer, and the last line of another without bullets and quotes."""
    fenced = F.concat(F.lit('Here:\n```python\nprint("'), "p_name", F.lit('")\n```\nDone.'))
    said = F.when(F.col("p_partkey") % 3 == 0, " \n ").otherwise(F.concat(F.lit("First.\n- \""), "p_name", F.lit("\"\n\n")))
    return table(spark, sf_dir, "part").select("p_partkey", measure.fenced_code(fenced).alias("code"), measure.lesson_line(said).alias("lesson"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, min(n) OVER w AS low, max(n) OVER w AS high FROM n WINDOW w AS (PARTITION BY user_id))
SELECT user_id, string_agg(substr('▁▂▃▄▅▆▇█', CAST(floor((n - low) / CASE WHEN high > low THEN high - low ELSE 1 END * 7 + 0.5) AS INTEGER) + 1, 1), '' ORDER BY event_type) AS bars FROM s GROUP BY user_id""")
def sparklines(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: x["n"].cast("double"))
    return n.groupBy("user_id").agg(values.alias("xs")).select("user_id", text.sparkline(F.col("xs")).alias("bars"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 5 END AS INTEGER) AS lines FROM part")
def changed_lines(spark, sf_dir):
    """Nothing, one line more, one line for another, and two lines for three in between."""
    key, lines = F.col("p_partkey") % 4, lambda *xs: F.array_join(F.array("p_brand", *map(F.lit, xs), "p_name"), "\n")
    after = F.when(key == 0, lines("a", "b", "c", "")).when(key == 1, lines("a", "b", "new", "c", "")).when(key == 2, lines("a", "x", "c", "")).otherwise(lines("x", "y", "z", "c", ""))
    return table(spark, sf_dir, "part").select("p_partkey", text.changed_lines(lines("a", "b", "c", ""), after).alias("lines"))


@query("SELECT p_partkey, p_partkey % 7 <> 0 AND p_size >= 10 AND p_size + 1 <= 20 AS fits, CASE WHEN p_partkey % 5 = 0 THEN 'witness_replay' WHEN p_size > 10 THEN 'recurrence_probe' ELSE 'regression_only' END AS strategy, CASE WHEN p_partkey % 5 = 0 THEN 'auto' ELSE 'human-gate' END AS requires FROM part")
def budgets_and_contracts(spark, sf_dir):
    """Whether lines fit the budget, and the strongest evidence that there is."""
    key, size = F.col("p_partkey"), F.col("p_size")
    w = lambda cmd, good: F.struct(F.lit(cmd).alias("cmd"), F.lit(good).alias("replayable"))
    witnesses = F.when(key % 5 == 0, F.array(w("make", False), w("run", True))).otherwise(F.array(w("make", False), w("", True)))
    c = planning.eval_contract(witnesses, F.greatest(F.lit(0), size - 10), replayable=True)
    fits = planning.within_budget(F.when(key % 7 != 0, size - 10), F.lit(11))
    return table(spark, sf_dir, "part").select("p_partkey", fits.alias("fits"), c["strategy"].alias("strategy"), c["requires"].alias("requires"))


@query("SELECT p_partkey, p_brand AS signature FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def not_yet_applied(spark, sf_dir):
    """Clusters whose signature has no applied entry in the ledger."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("signature"), (F.col("p_size") > 48).alias("applied"))
    return planning.not_applied(rows.select("p_partkey", "signature"), rows.select("signature", "applied"))


@query("""WITH x AS (SELECT event_id, value / 20 - 2.5 AS x FROM events), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(x) / sqrt(2)) AS t FROM x),
c AS (SELECT *, 0.5 * (2 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x / 2)) AS upper FROM t)
SELECT event_id, round(CASE WHEN x = 0 THEN 0.5 WHEN x > 0 THEN upper ELSE 1 - upper END, 7) AS p FROM c""")
def normal_cdf(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(stats.norm_cdf(F.col("value") / 20 - 2.5), 7).alias("p"))


@query(f"SELECT count(*) FILTER (label IS NOT NULL) AS linked, count(*) FILTER (label = 'pass') AS gold_pass, count(*) FILTER (label = 'fail') AS gold_fail, count(*) FILTER (label IS NULL) AS unlinked FROM ({catalog.oracle_sql()['pr_link_unique']})")
def link_counts(spark, sf_dir):
    return labels.link_counts(catalog.pr_link_unique(spark, sf_dir))


@query(f"SELECT id, CASE WHEN l.label IS NOT NULL THEN l.label ELSE 'unknown' END AS label, CASE WHEN l.label IS NOT NULL THEN 'gold' ELSE 'unknown' END AS tier FROM ({catalog.oracle_sql()['pr_link_unique']}) l")
def gold_links(spark, sf_dir):
    """Episodes with the outcome of the pull request that they're linked with."""
    links = catalog.pr_link_unique(spark, sf_dir)
    episodes = links.select("id", labels.outcome("unknown", "unknown", 0, "transcript.insufficient").alias("outcome"))
    return labels.with_gold(episodes, links).select("id", "outcome.label", "outcome.tier")


_COMMANDS = (("pytest -q", True), ("npm test", True), ("npm testing", False), ("tsc -p x --noEmit", True), ("go test ./...", True), ("echo pytest", False), ("make test;ls", False), (" node --test ", True), ("tsc; x --noEmit", False))


@query(f"SELECT p_partkey, ({[good for _, good in _COMMANDS]!r})[1 + p_partkey % {len(_COMMANDS)}] AS verifies, ({list(errors.ERROR_CLASSES)!r})[1 + p_partkey % {len(errors.ERROR_CLASSES)}] NOT IN {tuple(errors.NOT_AGENT_FAULTS)!r} AS agent_fault FROM part")
def commands_and_faults(spark, sf_dir):
    """Which commands verify, and which classes of errors are the agent's fault."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % len(xs)).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", labels.is_verification(pick([c for c, _ in _COMMANDS])).alias("verifies"), errors.is_agent_fault(pick(errors.ERROR_CLASSES)).alias("agent_fault"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN ':not_object' ELSE (['cwd:required', 'cwd:type', 'cwd:empty', 'outcome.label:enum', 'zz:unknown_field'])[1 + o_orderkey % 5] END AS problems FROM orders")
def schema_errors(spark, sf_dir):
    """Orders as episode documents, each with one fault."""
    key = F.col("o_orderkey") % 5
    cwd = F.when(key == 0, "").when(key == 1, '"cwd":5,').when(key == 2, '"cwd":" ",').otherwise('"cwd":"/w",')
    more = F.when(key == 4, ',"zz":1').otherwise("")
    label = F.when(key == 3, "maybe").otherwise("pass")
    whole = F.concat(F.lit('{"id":"e","schema":"s","session_id":"s","prompt_id":"p","agent_id":"main",'), cwd, F.lit('"started":"2024-01-01T00:00:00Z","steps":[],"signals":{},"outcome":{"label":"'), label, F.lit('","tier":"gold"}'), more, F.lit("}"))
    documents = table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(F.when(F.col("o_orderkey") % 7 == 0, "[1]").otherwise(whole)).alias("document"))
    found = validation.with_episode_errors(documents, "document")
    return found.select("o_orderkey", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("problems"))


@query(f"""WITH e AS (SELECT *, {_SQL_K} AS k, event_type = 'error' AS bad FROM events), c AS (
  SELECT *, CASE event_id % 4 WHEN 0 THEN k % 3 WHEN 1 THEN -k ELSE CAST(bad AS BIGINT) END AS code FROM e)
SELECT event_id, CAST(code AS INTEGER) AS exit_code, bad AS is_error, code = 0 AND NOT bad AS ok, CASE WHEN event_id % 4 = 3 THEN 'Read' ELSE 'Bash' END AS tool, '<PATH>' AS cwd FROM c""")
def captured_calls(spark, sf_dir):
    """Hook events as capture rows: the exit code from a field, from the text, or from the error flag."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    kind, bad = F.col("event_id") % 4, F.col("event_type") == "error"
    response = F.when(kind == 0, F.concat(F.lit('{"meta":{"exitCode":'), F.col("k") % 3, F.lit("}}"))).when(kind == 1, F.concat(F.lit('{"stdout":"exit code -'), "k", F.lit(' here"}'))).otherwise(F.lit('"fine"'))
    body = F.concat(F.lit('{"session_id":"s","cwd":"/home/x/w","tool_name":"'), F.when(kind == 3, "Read").otherwise("Bash"), F.lit('","tool_input":{"command":"run go"},"tool_response":'), response, F.lit(',"is_error":'), bad.cast("string"), F.lit("}"))
    rows = ingest.capture_rows(e.select(F.col("event_id").alias("ts"), F.parse_json(body).alias("event")))
    return rows.select(F.col("ts").alias("event_id"), "exit_code", "is_error", "ok", "tool", "cwd")


@query(f"SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, strftime(ts, '%Y-%m-%d') AS ts, 'd' || ({_SQL_K} % 5) AS input_digest FROM events")
def streamed_captures(spark, sf_dir):
    """Captured calls appended by a stream, twice: what is there already isn't added again."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.lit("Bash").alias("tool"), F.concat(F.lit("d"), _k() % 5).alias("input_digest"))
    source, out = new_path(spark, "captures"), new_path(spark, "captured")
    rows.write.json(source)
    for _ in range(2):
        ingest.appended(spark, source, out, new_path(spark, "cursor")).awaitTermination()
    return spark.read.parquet(out).select("session_id", "ts", "input_digest")


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, sf_dir):
    """Events by day and type, as the stream counts them."""
    return ingest.daily_counts(table(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "event_type", "n")
