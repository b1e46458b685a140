import json

import pytest
from pyspark.sql import functions as F

from spoolkit.operators import clusters, labels, measure, planning, reports, sessionize, validation
from spoolkit.operators.ancestors import inherited
from spoolkit.operators.components import connected_components
from spoolkit.sources import transcripts


def call(i, uuid, parent, tool, inp, ts, **more):
    return {"uuid": uuid, "parentUuid": parent, "sessionId": "s1", "type": "assistant", "timestamp": ts, "cwd": "/w", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": tool, "input": inp}]}} | more


def result(i, uuid, parent, body, ts, error=False):
    return {"uuid": uuid, "parentUuid": parent, "sessionId": "s1", "type": "user", "timestamp": ts, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": body, "is_error": error}]}}


RECORDS = [
    {"uuid": "u1", "promptId": "p1", "sessionId": "s1", "type": "user", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "message": {"role": "user", "content": "please fix the build"}},
    call("t1", "a1", "u1", "Bash", {"command": "python3 -c 'import yaml'"}, "2024-01-01T00:00:01Z"),
    result("t1", "r1", "a1", "Exit code 1\nModuleNotFoundError: No module named 'yaml'", "2024-01-01T00:00:02Z", True),
    call("t2", "a2", "r1", "Bash", {"command": "pytest -q"}, "2024-01-01T00:00:03Z"),
    result("t2", "r2", "a2", [{"type": "text", "text": "Exit code 2\nAssertionError: x"}], "2024-01-01T00:00:04Z", True),
    call("t3", "a3", "r2", "Edit", {"file_path": "/w/a.py"}, "2024-01-01T00:00:05Z"),
    result("t3", "r3", "a3", "ok", "2024-01-01T00:00:06Z"),
    call("t4", "a4", "r3", "Bash", {"command": "pytest -q"}, "2024-01-01T00:00:07Z"),
    result("t4", "r4", "a4", "3 passed", "2024-01-01T00:00:08Z"),
    result("lost", "r5", "a4", "orphan", "2024-01-01T00:00:09Z"),
    call("t5", "a5", "r4", "Read", {"file_path": "/w/b.py"}, "2024-01-01T00:00:10Z"),
    {"uuid": "u2", "promptId": "p2", "sessionId": "s1", "type": "user", "timestamp": "2024-01-01T00:01:00Z", "message": {"role": "user", "content": "no, revert that"}},
    {"uuid": "b1", "parentUuid": "u2", "sessionId": "s1", "type": "assistant", "timestamp": "2024-01-01T00:01:01Z", "message": {"role": "assistant", "content": "done"}},
    {"uuid": "c1", "parentUuid": "c2", "sessionId": "s9", "type": "assistant", "timestamp": "2024-01-01T00:02:00Z", "message": {"role": "assistant", "content": "loop"}},
    {"uuid": "c2", "parentUuid": "c1", "sessionId": "s9", "type": "user", "timestamp": "2024-01-01T00:02:01Z", "message": {"role": "user", "content": "loop too"}},
    {"uuid": "n1", "promptId": "p9", "sessionId": "s1", "type": "user", "isMeta": True, "message": {"role": "user", "content": "<local-command>"}},
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "proj").mkdir()
    lines = ["﻿" + json.dumps(RECORDS[0]), *map(json.dumps, RECORDS[1:]), "{broken", "[1,2]", '"text"', ""]
    (root / "proj" / "one.jsonl").write_text("\n".join(lines))
    (root / "proj" / "subagents").mkdir()
    (root / "proj" / "subagents" / "agent-7.jsonl").write_text("\n".join(map(json.dumps, RECORDS[:3])))
    assert transcripts.line_counts(spark, str(root)).first().asDict() == {"lines": 22, "rejected": 3}
    return transcripts.read_records(spark, str(root))


@pytest.fixture(scope="module")
def episodes(records):
    return sessionize.harvest(records).cache()


def test_paths(records):
    assert {tuple(r) for r in records.select("project", "source_kind", "agent_id").distinct().collect()} == {("proj", "session", "main"), ("proj", "subagent", "7")}


def test_groups_and_cap(records):
    main = records.where("source_kind = 'session'")
    found = {r.group: r.n for r in sessionize.prompt_groups(main).groupBy("group").agg(F.count("*").alias("n")).collect()}
    assert found == {"p1": 11, "p2": 2, "_orphan:s9": 2}
    capped = sessionize.prompt_groups(main, 4).where("group = 'p1'")
    assert capped.count() == 4 and capped.where("truncated").count() == 4


def test_steps_and_episode(episodes):
    e = episodes.where("prompt_id = 'p1' and agent_id = 'main'").first()
    assert [(s.tool, s.ok, s.exit_code) for s in e.steps] == [("Bash", False, 1), ("Bash", False, 2), ("Edit", True, 0), ("Bash", True, 0), ("unknown", True, 0), ("Read", None, None)]
    assert e.signals.unrecovered_signatures == ["bash:module_not_found:python3:yaml"]
    assert e.signals.recovered_signatures == ["bash:test_failure:pytest:"]
    assert e.failure.signature == "bash:module_not_found:python3:yaml" and e.failure.witness.replayable and e.failure.witness.observed_exit_code == 1
    assert e.artifacts.files_edited == ["/w/a.py"] and e.request.text == "please fix the build"
    assert e.duration_ms == 10_000 and e.signals.errored_tool_results == 2 and e.id.startswith("ep_sha256:")
    assert episodes.where(F.size(validation.episode_errors(F.to_variant_object(F.struct("*")))) > 99).count() == 0 if "outcome" in episodes.columns else True


def test_dedupe_prefers_sessions(records):
    counts = sessionize.harvest_counts(records).first()
    assert counts.groups == counts.episodes + counts.duplicates + counts.sidechains


def test_order_does_not_matter(records, episodes):
    again = sessionize.harvest(records.repartition(3, "uuid"))
    key = lambda df: sorted((r.id, r.started, str(r.signals)) for r in df.collect())
    assert key(again) == key(episodes)


def test_labels_and_rebuke(episodes):
    out = {(r.prompt_id, r.agent_id): tuple(r.outcome)[:2] for r in labels.label_sessions(episodes).collect()}
    assert out[("p1", "main")] == ("fail", "weak")  # the next request takes it back
    assert out[("p2", "main")] == ("unknown", "unknown")
    gold = episodes.withColumn("outcome", labels.outcome("pass", "gold", 1, "merge"))
    assert labels.label_sessions(gold).where("outcome.tier <> 'gold'").count() == 0
    assert labels.label_sessions(gold, keep_better=False).where("outcome.tier = 'gold'").count() == 0


def test_clusters_reports_and_plan(spark, episodes):
    many = labels.label_sessions(episodes.where("agent_id = 'main'")).crossJoin(spark.range(5).withColumnRenamed("id", "n")).withColumn("id", F.concat("id", F.col("n").cast("string"))).withColumn("outcome", labels.outcome("fail", "strong", 0.8, "x")).drop("n").cache()
    failures = clusters.failures_of(many)
    ranked = clusters.rank_clusters(clusters.cluster_failures(failures, many.count()))
    row = ranked.first()
    assert (row.signature, row.size, row.tier_strong, row.is_long_tail) == ("bash:module_not_found:python3:yaml", 5, 5, False)
    assert len(row.members) == 5 and row.recurrence_rate == round(5 / 15, 4) and len(row.witnesses) == 1
    groups, loners = clusters.mine_long_tail(failures, ranked)
    assert groups.count() == 0 and loners.count() == 0
    numbered = ranked.withColumn("rank", F.lit(1)).withColumn("lines_added", F.lit(5))
    assert planning.plan(numbered).first().action == "auto_apply"
    assert planning.plan(numbered.withColumn("lines_added", F.lit(25))).first().reason == "budget_exceeded"
    t = reports.totals(reports.atlas_rows(many)).first()
    assert (t.episodes, t.witnessed_failures, t.replayable_witnesses) == (15, 5, 5)
    page = reports.render_html("<x>", {"days": reports.timeline(reports.atlas_rows(many))})
    assert "&lt;x&gt;" in page
    assert measure.trial_suite(ranked, many, row.root).count() == 1
    assert reports.cluster_exemplars(ranked, many).first().exemplars[0].request == "please fix the build"


def test_promotions(spark, episodes):
    rows = spark.createDataFrame([("2024-01-01T00:00:02Z", "s1", "/w", "bash", True, 1, False, "python3", "x"), ("2024-01-01T03:00:00Z", "s1", "/w", "bash", True, 1, False, "python3", "y")], "ts string, session_id string, cwd string, tool string, ok boolean, exit_code int, is_error boolean, cmd_head string, input_digest string")
    found = labels.promotions(labels.label_sessions(episodes), rows).collect()
    assert {(r.i, r.exit_code, r.distance) for r in found} == {(0, 1, 1_000_000)}


def test_long_chains_and_cycles(spark):
    n = 1000
    chain = spark.range(1, n).selectExpr("id as a", "id - 1 as b")
    assert connected_components(chain, "a", "b").groupBy("component").count().collect()[0].asDict() == {"component": 0, "count": n}
    nodes = spark.range(n).selectExpr("'f' as file", "cast(id as string) as u", "cast(id - 1 as string) as p", "case when id = 0 then 'top' end as v").union(spark.createDataFrame([("f", "x", "y", None), ("f", "y", "x", None)], "file string, u string, p string, v string"))
    found = {r.u: r.value for r in inherited(nodes, "file", "u", "p", "v").collect()}
    assert found[str(n - 1)] == "top" and found["x"] is None and found["y"] is None


def test_components_random(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.vertex: r.component for r in connected_components(df, "a", "b").collect()} == {v: find(v) for v in root}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def tail_of(spark, texts):
    rows = [(f"e{i}", t, "bash", "other", f"2024-01-01 00:00:{i:02}", "s", "p", "mail a@b.com") for i, t in enumerate(texts)]
    failures = spark.createDataFrame(rows, "id string, error_text string, tool string, error_class string, started string, session_id string, project string, request string")
    none = spark.createDataFrame([], "is_long_tail boolean, members array<string>")
    groups, loners = clusters.mine_long_tail(failures, none)
    found = groups.collect()
    assert all(r.exemplars[0].request == "mail <EMAIL>" and r.sessions == 1 for r in found)
    return sorted(r.members for r in found), [r["count"] for r in loners.where("tool is not null").collect()]


def test_long_tail_compares_whole_texts(spark):
    word = lambda n, c: " ".join(f"{c}{chr(97 + i // 26)}{chr(97 + i % 26)}word" for i in range(n))
    alike = [f"{word(40, c)} {word(200, 'z')}" for c in "abc"]  # alike only after 240 characters
    assert tail_of(spark, alike)[0] == [["e0", "e1", "e2"]]
    differ = [f"{word(40, 'q')} {word(200, c)}" for c in "abc"]  # alike only in the first 240
    assert tail_of(spark, differ)[0] == []


def test_long_tail_keeps_groups_of_two(spark):
    groups, loners = tail_of(spark, ["disk full while writing", "disk full while writing", "other thing entirely"])
    assert groups == [["e0", "e1"]] and loners == [1]


def test_validation(spark):
    good = '{"id":"e","schema":"s","session_id":"s","prompt_id":"p","agent_id":"a","cwd":"/","started":"2024-01-01T00:00:00Z","steps":[],"signals":{},"outcome":{"label":"pass","tier":"gold"}}'
    cases = {good: [], "[1]": [("", "not_object")], good.replace('"e"', "7"): [("id", "type")], good.replace('"cwd":"/"', '"cwd":" "'): [("cwd", "empty")], good.replace("2024-01-01T00:00:00Z", "soon"): [("started", "format")],
             good.replace('"steps":[]', '"steps":{}'): [("steps", "type")], good.replace('"signals":{},', ""): [("signals", "required")], good.replace('"gold"', '"best"'): [("outcome.tier", "enum")], good.replace('"label":"pass",', '"extra":1,'): [("outcome.label", "required"), ("outcome.extra", "unknown_field")],
             good.replace('"id"', '"odd":1,"id"'): [("odd", "unknown_field")], good.replace('{"label":"pass","tier":"gold"}', "3"): [("outcome", "type")]}
    df = spark.createDataFrame([(i, j) for i, j in enumerate(cases)], "i int, j string").select("i", validation.episode_errors(F.parse_json("j")).alias("e")).orderBy("i")
    for r, wanted in zip(df.collect(), cases.values(), strict=True):
        assert sorted((e.path, e.code) for e in r.e) == sorted(wanted)
        assert all(e.message for e in r.e)


def test_episode_files_and_witnesses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":"1"}\n\n{"id":"2"}\n')
    (tmp_path / "in" / "b.json").write_text('[{"id":"3"},{"id":"4"}]')
    (tmp_path / "in" / "c.json").write_text('{"id":"5"}')
    found = transcripts.read_episode_files(spark, str(tmp_path / "in"))
    ids = lambda df: [r.id for r in df.select("file", "place", F.try_variant_get("episode", "$.id", "string").alias("id")).orderBy("file", "place").collect()]
    assert ids(found) == ["1", "2", "3", "4", "5"]
    transcripts.write_episode_files(found, str(tmp_path / "out"))
    text = {d.name[5:]: "".join(p.read_text() for p in sorted(d.glob("part-*"))) for d in (tmp_path / "out").glob("file=*")}
    assert text["a.jsonl"] == '{"id":"1"}\n{"id":"2"}\n' and text["b.json"].split() == ["[", '{"id":"3"},', '{"id":"4"}', "]"]
    docs = ['[{"cmd":"x","replayable":true},{"cmd":"y"}]', '{"errorClass":"timeout","witnesses":[{"cmd":"z","replayable":true},{"cmd":"w","mode":"lint","replayable":true},{"cmd":"","replayable":true}]}']
    w = transcripts.replayable_witnesses(spark.createDataFrame([(d,) for d in docs], "d string").select(F.parse_json("d").alias("doc")))
    assert sorted((r.cmd, r.error_class) for r in w.collect()) == [("w", "lint"), ("x", None), ("z", "timeout")]


def test_promotion_and_gold_reach_the_episodes(spark):
    steps = "array<struct<i:int,ts:string,tool:string,head:string,exit_code:int,ok:boolean,cwd:string>>"
    rows = [("e1", "s", "2024-01-01T00:00:00Z", "/w", [(0, "2024-01-01T00:00:10Z", "Bash", "go", None, None, None), (1, "2024-01-01T00:05:00Z", "Bash", "end", 0, True, None)], ("unknown", "unknown", 0.0, "x")), ("e2", "t", "2024-01-01T00:00:00Z", "/w", [], ("pass", "gold", 1.0, "m"))]
    episodes = spark.createDataFrame(rows, f"id string, session_id string, started string, cwd string, steps {steps}, outcome struct<label:string,tier:string,confidence:double,method:string>")
    captures = spark.createDataFrame([("2024-01-01T00:00:12Z", "s", "<PATH>", "bash", False, 2, "go"), ("2024-01-01T00:05:01Z", "s", "<PATH>", "bash", True, 0, "end")], "ts string, session_id string, cwd string, tool string, ok boolean, exit_code int, cmd_head string")
    found = {r.id: r for r in labels.promoted(episodes, captures).collect()}
    assert [(s.exit_code, s.ok) for s in found["e1"].steps] == [(2, False), (0, True)]
    assert tuple(found["e1"].outcome) == ("pass", "strong", 0.95, "live_capture") and found["e2"].outcome.tier == "gold"
    links = spark.createDataFrame([("e1", "fail"), ("e2", None)], "id string, label string")
    assert {r.id: tuple(r.outcome)[:3] for r in labels.with_gold(episodes, links).collect()} == {"e1": ("fail", "gold", 1.0), "e2": ("pass", "gold", 1.0)}
