"""Transcript streams, merged tables, ordered scans, ledgers and promotion, against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spoolkit.operators import ledger, measure, planning, scan, sessionize
from spoolkit.operators import labels as lab
from spoolkit.sources import transcripts
from spoolkit.streaming import harvest, ingest, upsert
from test_sessionize import RECORDS


def test_stream_equals_batch(spark, tmp_path):
    """Three runs over chunks, of which the second brings what a record of the first waits for; a run without news changes nothing."""
    root, table, progress = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "progress")
    (root / "proj" / "subagents").mkdir(parents=True)
    rest = [r for r in RECORDS if r["uuid"] not in ("c1", "c2")]  # a cycle never settles
    parts = [[*rest[:4], rest[5]], [rest[4], *rest[6:9]], rest[9:]]
    for k, part in enumerate(parts):
        (root / "proj" / f"one.part-{k}.jsonl").write_text("\n".join(["﻿" + json.dumps(part[0]), *map(json.dumps, part[1:]), "{broken", ""]))
        if k == 1:
            (root / "proj" / "subagents" / "agent-7.jsonl").write_text("\r\n".join(map(json.dumps, rest[:3])))
        harvest.harvest_stream(spark, str(root), table, progress).awaitTermination()
    want = sessionize.harvest(transcripts.read_records(spark, str(root)), sidechains=True)
    shown = lambda df: sorted(str(r) for r in df.select(sorted(want.columns)).collect())
    assert shown(upsert.read_table(spark, table, want.schema)) == shown(want)
    harvest.harvest_stream(spark, str(root), table, progress).awaitTermination()
    assert shown(upsert.read_table(spark, table, want.schema)) == shown(want)
    assert {r.is_sidechain for r in want.where("source_kind = 'subagent'").collect()} == {True}
    assert sessionize.harvest(transcripts.read_records(spark, str(root))).where("source_kind = 'subagent'").count() == 0


class Values:
    """Stands for a state store's handle, in memory."""

    def __init__(self):
        self.timers, self.states = [], {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Map())

    def getListState(self, name, *_):
        return self.states.setdefault(name, _List())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, _Value())

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):
        return 1_000


class _Map(dict):
    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v


class _List:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class _Value:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x

    def clear(self):
        self.x = None


def test_timers_of_the_stream():
    """A record that waits in vain becomes an orphan; a quiet group's state goes; no more than is needed of a long group is kept."""
    from pyspark.sql import Row

    h, p = Values(), harvest.PromptOfRecord(500)
    p.init(h)
    row = lambda n, uuid, parent, prompt=None: Row(chunk=0, line_no=n, uuid=uuid, parent_uuid=parent, prompt_id=prompt, session_id="s", line=f"l{n}")
    out = list(p.handleInputRows(("f",), iter([row(0, "a", None, "p"), row(1, "b", "a"), row(2, "y", "x"), row(3, "c", None)]), h))
    assert [(r.group, r.line) for r in out] == [("p", "l0"), ("p", "l1"), ("_orphan:s", "l3")] and h.timers == [1_500]
    out = list(p.handleInputRows(("f",), iter([row(4, "x", "b"), row(5, "z", "nowhere")]), h))
    assert [(r.group, r.line) for r in out] == [("p", "l4"), ("p", "l2")] and h.timers == [1_500]
    assert [(r.group, r.line) for r in p.handleExpiredTimer(("f",), h, None)] == [("_orphan:s", "l5")] and not h.states["waiting"].rows

    h, g = Values(), harvest.OpenGroup(3, 500)
    g.init(h)
    line = lambda n: Row(chunk=0, line_no=n, line=f"l{n}")
    assert [r.line for r in g.handleInputRows(("f", "p"), iter([line(0), line(1)]), h)] == ["l0", "l1"]
    assert [r.line for r in g.handleInputRows(("f", "p"), iter(map(line, range(2, 9))), h)] == ["l0", "l1", "l2", "l3"]
    assert list(g.handleInputRows(("f", "p"), iter([line(9)]), h)) == [] and len(h.timers) == 1
    assert list(g.handleExpiredTimer(("f", "p"), h, None)) == [] and not h.states["records"].rows and h.states["count"].x is None


class Counted(Values):
    """Counts the calls to states and timers."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("listTimers", "deleteTimer", "registerTimer"):
            Counted.calls += 1
        found = super().__getattribute__(name)
        if name.startswith("get") and name.endswith("State"):
            return lambda *a: _Counted(found(*a))
        return found


class _Counted:
    def __init__(self, state):
        self.state = state

    def __getattr__(self, name):
        Counted.calls += 1
        return getattr(self.state, name)


def test_state_calls_do_not_grow_with_records():
    """Records of a file, each after the one before, in two batches: all get the first's prompt, with as many calls for 20 as for 2,000."""
    from pyspark.sql import Row

    def calls(n):
        h, p, Counted.calls = Counted(), harvest.PromptOfRecord(500), 0
        p.init(h)
        rows = [Row(chunk=0, line_no=i, uuid=f"u{i}", parent_uuid=f"u{i - 1}" if i else None, prompt_id=None if i else "p", session_id="s", line="x") for i in range(n)]
        rows += [Row(chunk=0, line_no=n, uuid="u1", parent_uuid=None, prompt_id=None, session_id="s", line="x")]  # again, without a prompt: what was known stays
        rows += [Row(chunk=0, line_no=n + 1, uuid="z", parent_uuid="u1", prompt_id=None, session_id="s", line="x")]
        out = [r.group for part in (rows[: n // 2], rows[n // 2 :]) for r in p.handleInputRows(("f",), iter(part), h)]
        assert out == ["p"] * n + ["_orphan:s", "p"]
        return Counted.calls

    def group_calls(n):
        h, g, Counted.calls = Counted(), harvest.OpenGroup(5_000, 500), 0
        g.init(h)
        assert len(list(g.handleInputRows(("f", "p"), iter([Row(chunk=0, line_no=i, line="x") for i in range(n)]), h))) == n
        return Counted.calls

    assert calls(20) == calls(2_000) < 10
    assert group_calls(20) == group_calls(2_000) <= 4


def test_merge(spark, tmp_path):
    """Batches in any order, again, and overlapping give what all of them give at once; only touched buckets are rewritten."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i % 40, rng.choice(["session", "other"]), rng.randrange(50), f"f{i:03d}") for i in range(400)]
    schema = "session_id string, prompt_id long, source_kind string, n_records long, file string"
    every = spark.createDataFrame(rows, schema)
    order = harvest.preference()
    want = sorted(map(str, upsert.preferred(every, ["session_id", "prompt_id"], order).collect()))
    for turn, batches in enumerate(([(0, 200), (200, 400)], [(150, 400), (0, 10), (0, 10), (0, 300)], [(0, 400)])):
        path = str(tmp_path / f"t{turn}")
        for k, (a, b) in enumerate(batches):
            part = spark.createDataFrame(rows[a:b], schema)
            assert upsert.merge(part, path, ["session_id", "prompt_id"], order, f"b{k}", buckets=16) > 0
            assert upsert.merge(part, path, ["session_id", "prompt_id"], order, f"b{k}", buckets=16) == 0
        assert sorted(map(str, upsert.read_table(spark, path, every.schema).collect())) == want
    one = spark.createDataFrame([("a", 1, "session", 99, "z")], schema)
    assert upsert.merge(one, path, ["session_id", "prompt_id"], order, "one", buckets=16) == 1
    assert upsert.read_table(spark, path, every.schema).where("n_records = 99").count() == 1
    assert upsert.vacuum(spark, path) == 1 and upsert.read_table(spark, path, every.schema).count() == len(want)
    assert upsert.merge(one.limit(0), str(tmp_path / "e"), ["session_id", "prompt_id"], order, "x") == 0
    assert upsert.read_table(spark, str(tmp_path / "e"), every.schema).count() == 0


def test_scans(spark):
    rng = random.Random(2)
    rows = [(("hot" if i % 3 else "cold"), rng.randrange(30), i, rng.choice([None, 1, 2, 5])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x long, i long, v long").repartition(7)
    ordered, n, total = sorted(rows, key=lambda r: r[1:3]), 0, 0
    found = {r.i: r for r in scan.prefix_sums(df, ["v"], "x", "i").collect()}
    for r in ordered:
        assert (found[r[2]].n_before, found[r[2]].v_before) == (n, total)
        n, total = n + 1, total + (r[3] or 0)
    for g in ("hot", "cold"):
        mine = [r[2] for r in ordered if r[0] == g]
        assert [r.i for r in sorted(scan.positions(df, "g", "x", "i").where(F.col("g") == g).collect(), key=lambda r: r.pos)] == mine
        assert [r.i for r in sorted(scan.leading(df, "g", 7, "x", "i").where(F.col("g") == g).collect(), key=lambda r: r.nth)] == mine[:7]
    points = df.where("i % 5 = 0").groupBy("g", "x").agg(F.max("i").alias("p"))
    there = {(r.g, r.x): r.p for r in points.collect()}
    asked = df.select("g", F.when(F.col("i") != 7, F.col("x")).alias("x"), "i")
    for r in scan.neighbours(points, asked, ["g"], "x").collect():
        below, above = [x for g, x in there if g == r.g and r.x is not None and x < r.x], [x for g, x in there if g == r.g and r.x is not None and x >= r.x]
        assert (r.before and r.before.p) == (there[r.g, max(below)] if below else None) and (r.after and r.after.p) == (there[r.g, min(above)] if above else None)
    assert scan.prefix_sums(df.limit(0), ["v"], "x").count() == 0 and scan.neighbours(points, asked.limit(0), ["g"], "x").count() == 0


def test_cut_offs(spark):
    rows = [(i, c) for i, c in enumerate([3, 0, None, 4, 9, 1, 1])]
    df = spark.createDataFrame(rows, "i int, c int")
    got = lambda most, budget: [(r.i, r.spent) for r in measure.budgeted(df, ["i"], "c", most, budget).orderBy("i").collect()]
    assert got(9, 10) == [(0, 3), (1, 3), (2, 3), (3, 7)] and got(2, 10) == [(0, 3), (1, 3)] and got(9, 100)[-1] == (6, 18) and got(9, 2) == [] and got(0, 9) == []
    rounds = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.0), ("a", 3, None), ("a", 4, 1.0), ("b", 1, 0.0), ("b", 2, 1.0), ("b", 3, 0.0)], "run string, n int, gain double")
    assert sorted((r.run, r.n, r.kept) for r in measure.gated_rounds(rounds, "run", ["n"], "gain", 0.1).collect()) == [("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("b", 3, False)]


def test_ledger_equals_the_chain_of_one_run(spark):
    rows = [{"note": n, "ok": ok, "patch": f"p{i}"} for i, (n, ok) in enumerate([("a", True), (None, False), ('é "x"\n\t', None), ("a", True)])]
    df = spark.createDataFrame([("l", i, r["note"], r["ok"], r["patch"]) for i, r in enumerate(rows)], "l string, i int, note string, ok boolean, patch string")
    want = planning.chained([r | {"l": "l", "i": i} for i, r in enumerate(rows)])
    first = ledger.appended(df.where("i < 2"), "l", ["i"]).cache()
    whole = first.unionByName(ledger.appended(df.where("i >= 2"), "l", ["i"], first))
    assert [(r.seq, r.prev, r.hash) for r in whole.orderBy("seq").collect()] == [(w["seq"], w["prev"], w["hash"]) for w in want]
    assert ledger.faults(whole, "l").count() == 0
    changed = whole.withColumn("patch", F.when(F.col("seq") == 1, "other").otherwise(F.col("patch")))
    assert [(r.seq, r.faults) for r in ledger.faults(changed, "l").collect()] == [(1, ["hash"])]
    assert [(r.seq, r.faults) for r in ledger.faults(whole.where("seq <> 1"), "l").collect()] == [(2, ["link"])]


STEP = "struct<i:int,ts:string,tool:string,head:string,exit_code:int,ok:boolean>"


@pytest.mark.parametrize(
    ("ts", "captures", "label"),
    [
        ("00:00:30", [("00:00:31", 0, True)], "pass"),
        ("00:00:30", [("00:00:31", 0, False)], "fail"),
        ("00:00:30", [("00:00:31", 0, None)], "fail"),
        ("00:00:30", [("00:00:29", 1, False), ("00:00:31", 0, True)], None),  # as near
        (None, [("00:00:20", 3, False)], "fail"),  # inside the episode
        (None, [("00:00:20", 0, True), ("00:00:25", 0, True)], None),  # both inside
        (None, [("00:05:30", 0, True)], "pass"),  # three hundred seconds from the nearer end
        (None, [("00:05:31", 0, True)], None),
        (None, [("00:00:00", 0, True), ("00:02:00", 1, False)], "pass"),  # at the start
    ],
)
def test_promotion_distances(spark, ts, captures, label):
    at = lambda t: None if t is None else f"2026-01-01T{t}Z"
    e = spark.createDataFrame([("e", "s", "/tmp/p", at("00:00:00"), at("00:00:30"), [(0, at(ts), "Bash", "node", 1, False)])], f"id string, session_id string, cwd string, started string, ended string, steps array<{STEP}>").withColumn("outcome", lab.outcome("fail", "weak", 0.4, "transcript.weak_signal"))
    c = spark.createDataFrame([(at(t), "s", "<PATH>", "bash", ok, code, "node") for t, code, ok in captures], "ts string, session_id string, cwd string, tool string, ok boolean, exit_code int, cmd_head string")
    r = lab.promoted(e, c).first()
    if label is None:
        assert r.outcome.method == "transcript.weak_signal" and r.evidence == [] and r.steps[0].outcome_confidence is None
    else:
        code = captures[0][1]
        assert (r.outcome.label, r.outcome.tier, r.outcome.confidence) == (label, "strong", 0.95)
        assert [tuple(x) for x in r.evidence] == [(0, f"live PostToolUse exit code {code}")] and r.steps[0].outcome_confidence == "strong" and r.steps[0].exit_code == code


def test_pairs_of_batches(spark):
    calls = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:00') as t(call_id, ts)")
    results = spark.sql("select * from values (1, timestamp'2024-01-01 00:10:00', 'a'), (2, timestamp'2024-01-01 00:10:01', 'b'), (3, timestamp'2024-01-01 00:00:00', 'c') as t(call_id, ts, k)")
    found = sorted((r.call_id, r.what, r.k or "") for r in ingest.paired_stream(calls, results).collect())
    assert found == [(1, "paired", "a"), (2, "call", ""), (2, "result", "b"), (3, "result", "c")]


def test_a_pull_request_that_is_listed_twice_is_ambiguous(spark):
    """By branch and by issue alike; a text that names an issue twice is not."""
    prs = spark.createDataFrame([("o/r", 7, "b", True, False), ("o/r", 7, "b", True, False), ("o/r", 8, "c", True, False)], "repo string, number long, headRefName string, merged boolean, closedUnmerged boolean")
    episodes = spark.createDataFrame([("x", "b", "r", "/w", ""), ("y", None, "r", "/w", "see #7"), ("z", None, "r", "/w/r", "issue 8: #8 and #8")], "id string, git_branch string, project string, cwd string, haystack string")
    found = {r.id: (r.label, r.reason) for r in lab.link_pull_requests(episodes, prs).collect()}
    assert found == {"x": (None, "ambiguous_branch"), "y": (None, "ambiguous_issue_repo"), "z": ("pass", None)}


def test_links_stay_small_where_many_pull_requests_share_a_key(spark):
    """Who doesn't read the candidates carries none: an episode meets a count and one pull request, not a list."""
    from spoolkit.operators import labels as lab

    prs = spark.createDataFrame([("o/r", n, "b", True, False) for n in range(1, 41)] + [("o/R", 7, "x", False, True)], "repo string, number long, headRefName string, merged boolean, closedUnmerged boolean")
    rows = [(1, "b", "", "", ""), (2, "", "r", "/w/r", "#7 and #07"), (3, "", "r", "", "issue-8, #08"), (4, None, "r", "q", "#99"), (5, "none", "r", "", "#7 #8")]
    links = lab.link_pull_requests(spark.createDataFrame(rows, "id int, git_branch string, project string, cwd string, haystack string"), prs)
    found = {r.id: (r.rule, r.number, r.label, r.reason, r.candidates) for r in links.collect()}
    assert found[1] == (None, None, None, "ambiguous_branch", [f"o/r#{n}" for n in range(1, 41)])
    assert found[2] == (None, None, None, "ambiguous_issue_repo", ["o/R#7", "o/r#7"])
    assert found[3] == ("issue_repo", 8, "pass", None, None)
    assert found[4] == (None,) * 5
    assert found[5] == (None, None, None, "ambiguous_issue_repo", ["o/R#7", "o/r#7", "o/r#8"])
    assert "collect_list" not in links.drop("candidates")._jdf.queryExecution().optimizedPlan().toString()


def test_what_a_table_has_is_not_sent_to_every_task(spark, tmp_path, monkeypatch):
    """A second run adds nothing, null keys included, and sorts both sides instead of broadcasting the table."""
    frame = type(spark.range(1))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(40).selectExpr("if(id = 7, null, concat('2024-01-0', 1 + id % 2)) as ts", "if(id = 9, null, concat('s', id)) as session_id", "'Bash' as tool", "'d' as input_digest")
    rows.write.json(source)
    hints, plain = [], frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, name, *a: hints.append(name) or plain(self, name, *a))
    for k in range(2):
        ingest.appended(spark, source, out, str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(out).count() == 40
    assert "merge" in hints
