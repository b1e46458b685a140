"""Queries over transcripts and streams: harvests, live captures, late results.

They are registered next to those of ``catalog``, whose conventions hold here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolkit.operators import labels, ledger, measure, planning, proposals, reports, sessionize
from spoolkit.plans.catalog import query, table
from spoolkit.sources import transcripts
from spoolkit.storage import new_path, stored
from spoolkit.streaming import harvest, ingest, upsert


def _move(spark: SparkSession, source: str, target: str) -> None:
    """The one file in ``source`` to ``target``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, at = hadoop.Path(source), hadoop.Path(target)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    for f in fs.listStatus(folder):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), at)


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, chunk, line``: conversations as lines of transcripts, eight sessions' files in three chunks each.

    Each fourth turn, if a user's, is a prompt; others follow the turn before.  Of
    each tenth conversation a subagent has a copy, and of each tenth there is a copy
    outside the sessions' folder that has all turns from the first chunk on.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    session, turn = F.concat(F.lit("s"), "conv_id"), F.col("turn")
    uuid = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    prompt = F.when((F.col("role") == "user") & (turn % 4 == 0), F.concat(F.lit("p"), uuid(turn)))
    record = F.to_json(F.struct(
        uuid(turn).alias("uuid"), F.when(turn > 0, uuid(turn - 1)).alias("parentUuid"), prompt.alias("promptId"), session.alias("sessionId"), F.col("role").alias("type"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad(turn.cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
        F.lit("/w").alias("cwd"), F.struct(F.col("role").alias("role"), F.col("text").alias("content")).alias("message"),
    ))
    kind = F.col("conv_id") % 10
    own = F.struct(F.concat(F.lit("proj/f"), F.col("conv_id") % 8).alias("name"), F.least(F.lit(2), F.floor(turn / 3)).cast("int").alias("chunk"))
    copy = F.when(kind == 3, F.struct(F.lit("proj/subagents/agent-7").alias("name"), own["chunk"].alias("chunk"))).when(kind == 5, F.struct(F.lit("proj/deep/copy").alias("name"), F.lit(0).alias("chunk")))
    places = F.array_compact(F.array(F.when(~((kind == 5) & (turn > 5)), own), copy))
    return c.select("conv_id", "turn", record.alias("line"), F.explode(places).alias("at")).select(F.col("at.name").alias("file"), F.col("at.chunk").alias("chunk"), "conv_id", "turn", "line")


def _written(spark: SparkSession, lines: DataFrame) -> dict[int, list[tuple[str, str]]]:
    """Chunk to (file as written, name that it should have)."""
    out = new_path(spark, "chunks")
    named = lines.withColumn("name", F.concat_ws("@", F.regexp_replace("file", "/", "."), F.col("chunk").cast("string")))
    named.repartition("name").sortWithinPartitions("name", "conv_id", "turn").select("name", "line").write.partitionBy("name").text(out)
    names = [r.name for r in named.select("name").distinct().collect()]  # eight files and two copies
    found: dict[int, list[tuple[str, str]]] = {}
    for n in sorted(names):
        file, chunk = n.split("@")
        found.setdefault(int(chunk), []).append((f"{out}/name={n}", f"{file.replace('.', '/')}.part-{chunk}.jsonl"))
    return found


_GROUPS = """WITH p AS (SELECT *, max(CASE WHEN role = 'user' AND turn % 4 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS start FROM conversations),
g AS (SELECT conv_id, start, count(*) AS n, count(*) FILTER (conv_id % 10 <> 5 OR turn <= 5) AS n_own, min(turn) FILTER (conv_id % 10 <> 5 OR turn <= 5) AS low, max(turn) FILTER (conv_id % 10 <> 5 OR turn <= 5) AS high, bool_or(role = 'assistant' AND trim(text) <> '') AS good,
  bool_or(role = 'assistant' AND trim(text) <> '' AND (conv_id % 10 <> 5 OR turn <= 5)) AS good_own, min(turn) AS low_all, max(turn) AS high_all FROM p GROUP BY conv_id, start),
e AS (SELECT conv_id, start, CASE WHEN good_own THEN 'session' ELSE 'other' END AS source_kind, 'main' AS agent_id, CASE WHEN good_own THEN n_own ELSE n END AS n_records, CASE WHEN good_own THEN low ELSE low_all END AS a, CASE WHEN good_own THEN high ELSE high_all END AS b, false AS is_sidechain FROM g WHERE good_own OR (conv_id % 10 = 5 AND good)
UNION ALL SELECT conv_id, start, 'subagent', '7', n, low_all, high_all, true FROM g WHERE conv_id % 10 = 3 AND good)
SELECT 's' || conv_id AS session_id, CASE WHEN start IS NULL THEN '_orphan:s' || conv_id ELSE 'p' || conv_id || '-' || start END AS prompt_id, agent_id, source_kind, n_records, '2024-01-01T00:00:' || lpad(CAST(a AS VARCHAR), 2, '0') || 'Z' AS started, '2024-01-01T00:00:' || lpad(CAST(b AS VARCHAR), 2, '0') || 'Z' AS ended, is_sidechain FROM e"""

_SHOWN = ("session_id", "prompt_id", "agent_id", "source_kind", "n_records", "started", "ended", "is_sidechain")


@query(_GROUPS)
def streamed_harvest(spark, sf_dir):
    """Transcripts that arrive in three parts, harvested as a stream: the table after the last."""
    chunks = _written(spark, conversation_lines(spark, sf_dir))
    root, out, at = new_path(spark, "transcripts"), new_path(spark, "episodes"), new_path(spark, "progress")
    for k in sorted(chunks):
        for source, name in chunks[k]:
            _move(spark, source, f"{root}/{name}")
        harvest.harvest_stream(spark, root, out, at).awaitTermination()
    schema = sessionize.harvest(transcripts.read_records(spark, root)).schema
    return upsert.read_table(spark, out, schema).select(*_SHOWN)


@query(f"SELECT * FROM ({_GROUPS}) WHERE NOT is_sidechain")
def harvested_episodes(spark, sf_dir):
    """The same transcripts harvested at once, without the episodes of subagents' files."""
    root = new_path(spark, "transcripts")
    for files in _written(spark, conversation_lines(spark, sf_dir)).values():
        for source, name in files:
            _move(spark, source, f"{root}/{name}")
    return sessionize.harvest(transcripts.read_records(spark, root)).select(*_SHOWN)


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, CAST(ts AS DATE) AS day, event_type, {_K} AS k FROM events),
s AS (SELECT user_id || ':' || day AS id, user_id, event_id, CASE WHEN event_id % 4 <> 0 THEN t END AS at, min(t) OVER w AS a, max(t) OVER w AS b, k % 2 AS head FROM e WHERE event_type IN ('purchase', 'view') WINDOW w AS (PARTITION BY user_id, day)),
c AS (SELECT event_id AS row_id, user_id, t + k * 1000000 AS t, k % 2 AS head, k % 3 AS code, event_id % 7 > 1 AS ok FROM e WHERE event_type <> 'error' AND k % 5 <> 0),
near AS (SELECT s.id, s.event_id, c.row_id, c.t, c.code, coalesce(c.ok, false) AND c.code = 0 AS good, greatest(0, coalesce(s.at, s.a) - c.t, c.t - coalesce(s.at, s.b)) AS d FROM s JOIN c ON s.user_id = c.user_id AND s.head = c.head WHERE greatest(0, coalesce(s.at, s.a) - c.t, c.t - coalesce(s.at, s.b)) <= 300000000),
sides AS (SELECT *, min(d) OVER (PARTITION BY id, event_id) AS ds, min(d) OVER (PARTITION BY id, row_id) AS dr FROM near),
ties AS (SELECT *, count(*) FILTER (d = ds) OVER (PARTITION BY id, event_id) AS ns, count(*) FILTER (d = dr) OVER (PARTITION BY id, row_id) AS nr FROM sides),
m AS (SELECT * FROM ties WHERE d = ds AND d = dr AND ns = 1 AND nr = 1),
latest AS (SELECT id, arg_max(struct_pack(i := event_id, code := code, good := good), (t, event_id)) AS x, count(*) AS matched, count(*) FILTER (good) AS fixed FROM m GROUP BY id)
SELECT i.id, coalesce(matched, 0) AS matched, coalesce(fixed, 0) AS fixed, CASE WHEN x.good THEN 'pass' WHEN x.good IS NULL THEN 'unknown' ELSE 'fail' END AS label, CASE WHEN x IS NULL THEN 'unknown' ELSE 'strong' END AS tier,
  CASE WHEN x IS NULL THEN '' ELSE x.i || ':live PostToolUse exit code ' || x.code END AS evidence FROM (SELECT DISTINCT id FROM s) i LEFT JOIN latest ON latest.id = i.id""")
def promoted_episodes(spark, sf_dir):
    """Users' days as episodes, a fourth of the steps without a time, and what captured calls make of them."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = F.concat(F.lit("go"), F.col("k") % 2)
    step = F.struct(F.col("event_id").cast("int").alias("i"), F.when(F.col("event_id") % 4 != 0, shown(F.col("ts"))).alias("ts"), F.lit("Bash").alias("tool"), head.alias("head"), F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("boolean").alias("ok"))
    own = e.where("event_type in ('purchase', 'view')").withColumn("day", F.to_date("ts"))
    episodes = own.groupBy("user_id", "day").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.array_sort(F.collect_list(step)).alias("steps")).select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("id"), F.col("user_id").cast("string").alias("session_id"), F.lit("/home/w").alias("cwd"), shown(F.col("a")).alias("started"), shown(F.col("b")).alias("ended"), "steps",
        labels.outcome("unknown", "unknown", 0, "transcript.insufficient").alias("outcome"),
    )
    captured = e.where("event_type <> 'error'").select(
        F.col("user_id").cast("string").alias("session_id"), F.lit("<PATH>").alias("cwd"), F.lit("bash").alias("tool"), head.alias("cmd_head"), shown(F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 1_000_000)).alias("ts"),
        F.when(F.col("k") % 5 != 0, F.col("k") % 3).cast("int").alias("exit_code"), (F.col("event_id") % 7 > 1).alias("ok"),
    )
    found = labels.promoted(episodes, captured)
    hit = F.filter("steps", lambda s: s["outcome_confidence"] == "strong")
    said = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["step"].cast("string"), x["why"])), ",")
    return found.select("id", F.size(hit).cast("long").alias("matched"), F.size(F.filter(hit, lambda s: s["ok"])).cast("long").alias("fixed"), "outcome.label", "outcome.tier", said.alias("evidence"))


_LATE = f"""WITH e AS (SELECT event_id, epoch_us(ts) AS t, {_K} AS k FROM events WHERE event_type = 'purchase'), b AS (SELECT min(t) AS low, max(t) AS high FROM e),
p AS (SELECT event_id, k, least(2, CAST(floor((t - low) * 3.0 / (high - low)) AS BIGINT)) AS part, event_id % 11 <> 0 AS called FROM e, b),
x AS (SELECT *, event_id % 7 <> 0 AND NOT (event_id % 13 = 0 AND part = 0) AS answered FROM p)"""


@query(f"""{_LATE} SELECT event_id, 'paired' AS what, k AS minutes FROM x WHERE called AND answered AND k <= 10
UNION ALL SELECT event_id, 'call', NULL FROM x WHERE called AND NOT (answered AND k <= 10)
UNION ALL SELECT event_id, 'result', k FROM x WHERE answered AND NOT (called AND k <= 10)""")
def late_results(spark, sf_dir):
    """Calls and results as two streams that arrive in three parts: pairs within ten minutes, and what has no partner, once.

    Of each 13th call of the first part the result comes with the last one,
    behind the watermark: it is dropped, and its call is given out alone.
    """
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    t = F.unix_micros("ts")
    low, high = e.agg(F.min(t), F.max(t)).first()
    part = F.least(F.lit(2), F.floor((t - low) * 3.0 / max(1, (high or 0) - (low or 0)))).cast("int")
    after = F.col("ts") + F.make_dt_interval(mins=F.col("k").cast("int"))
    late = (F.col("call_id") % 13 == 0) & (F.col("part") == 0)
    parted = e.withColumn("part", part)
    calls = parted.where("call_id % 11 <> 0").select("call_id", "ts", "part")
    results = parted.where("call_id % 7 <> 0").select("call_id", after.alias("ts"), "k", F.when(late, 2).otherwise(F.col("part")).alias("part"))
    ends = spark.createDataFrame([(3,)], "part int").select(F.lit(None).cast("long").alias("call_id"), F.timestamp_micros(F.lit((high or 0) + 30 * 86_400_000_000)).alias("ts"), F.lit(None).cast("long").alias("k"), "part")  # moves the watermark past all others
    inputs, out, at = (new_path(spark, "calls"), new_path(spark, "results")), new_path(spark, "paired"), new_path(spark, "progress")
    for k in range(4):
        for path, rows in zip(inputs, (calls.unionByName(ends.drop("k")), results.unionByName(ends)), strict=True):
            rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(path)
        a, b = (spark.readStream.schema(s).parquet(p) for s, p in zip(("call_id long, ts timestamp", "call_id long, ts timestamp, k long"), inputs, strict=True))
        ingest.append_stream(ingest.paired_stream(a, b), out, at).awaitTermination()
    found = spark.read.parquet(out)
    return found.select("call_id", "call_ts", "k", "what").where("call_id is not null").select(F.col("call_id").alias("event_id"), "what", F.col("k").alias("minutes"))


@query("""WITH s AS (SELECT o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderpriority, o_orderkey) AS spent, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS n, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER () AS whole FROM orders)
SELECT o_orderkey, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= whole // 3""")
def budget_over_orders(spark, sf_dir):
    """Orders by priority and key, as far as a third of all their value goes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.floor("o_totalprice").cast("long").alias("cost"))
    whole = o.agg(F.sum("cost")).first()[0] or 0
    return measure.budgeted(o, ["o_orderpriority", "o_orderkey"], "cost", 1 << 40, whole // 3).select("o_orderkey", "spent")


@query(f"""WITH r AS (SELECT p_partkey AS rank, CASE WHEN p_partkey % 7 = 0 THEN 'usage_error' ELSE 'command_not_found' END AS cls, p_partkey % 5 > 0 AS seen, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 2 END AS lines FROM part),
l AS (SELECT *, CASE WHEN cls IN {tuple(planning.CONTEXT)!r} THEN 'context' WHEN cls IN {tuple(planning.SKILL)!r} THEN 'skill' WHEN cls IN {tuple(planning.SCAFFOLDING)!r} THEN 'scaffolding' ELSE 'context' END AS layer FROM r),
a AS (SELECT *, CASE WHEN layer = 'scaffolding' THEN 'layer_gated' WHEN NOT seen THEN 'no_causal_witness' END AS why FROM l),
c AS (SELECT *, CASE WHEN why IS NULL AND layer = 'context' THEN lines ELSE 0 END AS cost, why IS NULL AND layer = 'context' AS priced FROM a),
s AS (SELECT *, sum(cost) OVER (ORDER BY rank) AS spent FROM c), f AS (SELECT min(rank) AS cut FROM s WHERE priced AND spent > {planning.LINE_BUDGET}),
d AS (SELECT *, priced AND coalesce(rank >= cut, false) AS over FROM s, f), n AS (SELECT *, coalesce(sum(CAST(why IS NULL AND NOT over AS INTEGER)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acts FROM d)
SELECT CAST(rank AS INTEGER) AS rank, layer, CASE WHEN why IS NULL AND NOT over THEN 'auto_apply' END AS action, CASE WHEN over THEN 'budget_exceeded' ELSE why END AS reason FROM n WHERE acts < 150""")
def plan_cutoffs(spark, sf_dir):
    """Parts as ranked clusters: context patches until their lines are used up, and no more than 150 actions."""
    key = F.col("p_partkey")
    witness = F.array(F.struct(F.lit("make").alias("cmd"), F.lit("/w").alias("cwd"), F.lit(1).alias("code")))
    ranked = table(spark, sf_dir, "part").select(
        key.cast("long").alias("rank"), F.concat(F.lit("r"), key).alias("root"), F.col("p_brand").alias("signature"), F.lit("bash").alias("tool"), F.when(key % 7 == 0, "usage_error").otherwise("command_not_found").alias("error_class"),
        F.when(key % 5 > 0, witness).otherwise(F.slice(witness, 1, 0)).alias("witnesses"), F.lit(9).alias("size"), F.lit(9).alias("tier_gold"), F.lit(0).alias("tier_strong"), F.lit(False).alias("is_long_tail"), F.when(key % 3 == 0, 0).otherwise(F.col("p_size") % 2).alias("lines_added"),
    )
    return planning.plan(ranked, most=150).select("rank", "layer", "action", "reason")


_ENTRY = """'{"event_id":' || event_id || ',"k":' || coalesce(CAST(k AS VARCHAR), 'null') || ',"prev":' || %s || ',"seq":' || seq || ',"signature":"s-\\"' || (k %% 7) || '\\"","user_id":' || user_id || '}'"""
_CHAIN = f"""WITH RECURSIVE d AS (SELECT user_id, event_id, {_K} AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
c AS (SELECT *, CAST(NULL AS VARCHAR) AS prev, sha256({_ENTRY % "'null'"}) AS hash FROM d WHERE seq = 0
UNION ALL SELECT d.*, c.hash, sha256({(_ENTRY % """'"' || c.hash || '"'""").replace("event_id ||", "d.event_id ||").replace("CAST(k ", "CAST(d.k ").replace("(k %", "(d.k %").replace("|| seq ||", "|| d.seq ||").replace("|| user_id ||", "|| d.user_id ||")}) FROM c JOIN d ON d.user_id = c.user_id AND d.seq = c.seq + 1)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions in ledgers of their users, appended in two halves."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k"), F.concat(F.lit('s-"'), k % 7, F.lit('"')).alias("signature"))
    half = F.col("event_id") < (e.agg(F.avg("event_id")).first()[0] or 0)
    first = stored(ledger.appended(e.where(half), "user_id", ["event_id"]), "ledger")
    return first.unionByName(ledger.appended(e.where(~half), "user_id", ["event_id"], first))


@query(f"{_CHAIN} SELECT user_id, event_id, seq, prev, hash FROM c")
def ledger_chain(spark, sf_dir):
    return _ledger(spark, sf_dir).select("user_id", "event_id", "seq", "prev", "hash")


@query(f"""{_CHAIN}, b AS (SELECT *, event_id % 97 = 0 AS changed, lag(event_id % 101 = 0 AND event_id % 97 <> 0, 1, false) OVER (PARTITION BY user_id ORDER BY seq) AS after FROM c)
SELECT user_id, seq, concat_ws(',', CASE WHEN changed THEN 'hash' END, CASE WHEN after THEN 'link' END) AS faults FROM b WHERE changed OR after""")
def ledger_faults(spark, sf_dir):
    """Of each 97th row the contents were changed, of each 101st also the hash: the row itself, or the one after it, doesn't verify."""
    rows = stored(_ledger(spark, sf_dir), "ledger")
    changed, forged = F.col("event_id") % 97 == 0, (F.col("event_id") % 101 == 0) & (F.col("event_id") % 97 != 0)
    moved = rows.withColumn("k", F.when(changed | forged, F.col("k") + 1).otherwise(F.col("k")))
    head, tail = ledger._described(["user_id", "event_id", "k", "signature"])
    again = F.sha2(F.concat(head, ledger.json_value(F.col("prev")), tail), 256)
    found = ledger.faults(moved.withColumn("hash", F.when(forged, again).otherwise(F.col("hash"))), "user_id")
    return found.select("user_id", "seq", F.array_join("faults", ",").alias("faults"))


@query("""WITH r AS (SELECT user_id, event_id, coalesce(value > 30, false) AS kept, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
m AS (SELECT *, NOT kept AND NOT lag(kept, 1, true) OVER (PARTITION BY user_id ORDER BY n) AS second FROM r), e AS (SELECT user_id, min(n) AS last FROM m WHERE second GROUP BY user_id)
SELECT m.user_id, event_id, kept FROM m LEFT JOIN e ON e.user_id = m.user_id WHERE last IS NULL OR n <= last""")
def lesson_gate(spark, sf_dir):
    """Users' events as rounds of learning runs: what is kept, until two rejections in a row."""
    return measure.gated_rounds(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", 30).select("user_id", "event_id", "kept")


@query(f"""WITH e AS (SELECT event_id, {_K} AS k, lpad(CAST(event_id AS VARCHAR), 9, '0') AS id FROM events WHERE event_type = 'error'), c AS (SELECT *, row_number() OVER (PARTITION BY k % 20 ORDER BY event_id) AS n, 'last ' || k || ' ' || repeat('x', 232 - length(CAST(k AS VARCHAR))) AS said FROM e)
SELECT 'c' || (k % 20) AS root, CAST(n - 1 AS INTEGER) AS nth, id, 'ask ' || event_id AS request, CASE WHEN event_id % 4 = 0 THEN 'no step failed' WHEN event_id % 4 = 1 THEN 'direct' ELSE said || '…' END AS error FROM c WHERE n <= 2 AND k % 20 >= 5""")
def atlas_exemplars(spark, sf_dir):
    """The first two members of the fifteen leading clusters: the failure's own text, the last failing step's (in 240 characters), or the outcome's reason."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", k.alias("k"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("id"))
    said = F.concat(F.lit("last "), F.col("k"), F.lit(" "), F.expr("repeat('x', 232 - length(cast(k as string)))"), F.lit("   and more that is cut"))
    step = lambda ok, text: F.struct(F.lit(ok).alias("ok"), text.alias("error_text"), F.lit("s").alias("signature"))
    steps = F.when(F.col("event_id") % 4 == 0, F.array(step(True, F.lit("fine")))).otherwise(F.array(step(False, F.lit("first")), step(False, said), step(True, F.lit(""))))
    episodes = e.select("id", F.struct(F.concat(F.lit(" ask  "), "event_id").alias("text")).alias("request"), steps.alias("steps"), F.struct(F.lit("another").alias("signature"), F.when(F.col("event_id") % 4 == 1, "direct").alias("error_text")).alias("failure"), F.struct(F.lit("no step  failed").alias("reason")).alias("outcome"))
    found = e.groupBy((F.col("k") % 20).alias("priority")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "id"))), lambda x: x["id"]).alias("members"), F.count("*").alias("size")).withColumn("root", F.concat(F.lit("c"), "priority")).withColumn("signature", F.col("root"))
    return reports.cluster_exemplars(found, episodes).select("root", F.explode("exemplars").alias("x")).select("root", "x.nth", "x.id", "x.request", "x.error")


_ANSWERS = """WITH a AS (SELECT doc_id, text, split_part(text, ' ', 2) AS before, split_part(text, ' ', 2) || repeat(chr(10) || 'add', CAST(doc_id % 30 AS INTEGER)) AS after FROM documents),
c AS (SELECT *, CASE WHEN before = '' THEN 0 ELSE (length(text) - length(replace(text, before, ''))) / length(before) END AS times FROM a),
p AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN ':format' WHEN doc_id % 17 = 0 THEN ':invalid_json' WHEN doc_id % 23 = 0 THEN ':type' ELSE concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'rationale:required' END, CASE WHEN before = '' THEN 'edit.before:required' END, CASE WHEN after = '' THEN 'edit.after:required' END,
  CASE WHEN doc_id % 11 = 0 THEN ':criterion_supplied' END, CASE WHEN doc_id % 7 = 0 THEN 'layer:mismatch' END, CASE WHEN times > 1 THEN 'edit.before:anchor_ambiguous' END, CASE WHEN before = after THEN 'edit.after:unchanged' END, CASE WHEN doc_id % 30 > 20 THEN 'edit:line_budget_exceeded' END) END AS problems FROM c)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as targets, and answers that edit the second word of each."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split_part("text", F.lit(" "), F.lit(2)).alias("old"))
    n = F.col("doc_id")
    new = F.concat("old", F.expr("repeat('\nadd', cast(doc_id % 30 as int))"))
    said = F.to_json(F.struct(
        F.lit("one line").alias("summary"), F.when(n % 7 == 0, "skill").otherwise("context").alias("layer"), F.lit("CLAUDE.md").alias("target"), F.when(n % 5 != 0, 'it says "test": so').alias("rationale"), F.lit("fewer").alias("expectedEffect"),
        F.struct(F.col("old").alias("before"), new.alias("after")).alias("edit"), F.when(n % 11 == 0, F.array(F.struct(F.struct(F.lit(1).alias("my_check")).alias("deep")))).alias("notes"),
    ))
    body = F.when(n % 17 == 0, F.concat(F.lit("{"), said)).when(n % 23 == 0, F.concat(F.lit("["), said, F.lit("]"))).otherwise(said)
    answer = F.concat(F.lit(" \n```json\n"), body, F.lit("\n```\n"), F.when(n % 13 == 0, "Done.").otherwise(""))
    return d.select("doc_id", answer.alias("answer"), F.lit("context").alias("layer"), F.lit("CLAUDE.md").alias("target"), F.col("text").alias("target_text"), F.lit(20).alias("max_lines"), F.lit(False).alias("creates_file"),
                    F.concat(F.lit("cl"), n).alias("cluster_id"), F.lit("auto").alias("route_requires"), F.when(n % 3 == 0, "human-gate").otherwise("auto").alias("contract_requires"))


@query(f"{_ANSWERS} SELECT doc_id, problems FROM p")
def checked_proposals(spark, sf_dir):
    """What is wrong with each answer."""
    found = proposals.checked(_answers(spark, sf_dir))
    return found.select("doc_id", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("problems"))


@query(f"""{_ANSWERS} SELECT doc_id, 'sp_sha256:' || substr(sha256('{{"after":' || CAST(to_json(after) AS VARCHAR) || ',"before":' || CAST(to_json(before) AS VARCHAR) || ',"clusterId":"cl' || doc_id || '","layer":"context","target":"CLAUDE.md"}}'), 1, 16) AS patch_id,
  1 AS files_changed, CAST(doc_id % 30 AS INTEGER) AS lines_changed, CASE WHEN doc_id % 3 = 0 THEN 'human-gate' ELSE 'approve' END AS decision FROM p WHERE problems = ''""")
def proposed_patches(spark, sf_dir):
    """The patches of the answers that have no fault, with the gate's decision."""
    found = proposals.patches(proposals.checked(_answers(spark, sf_dir)))
    return found.select("doc_id", "patch_id", "files_changed", "lines_changed", "decision")
