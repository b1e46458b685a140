import math

from pyspark.sql import functions as F

from spoolkit.operators import labels, measure, planning, reports
from spoolkit.streaming import ingest


def test_scoring_and_verdicts(spark):
    rows = [(f"t{i}", arm, 1, True, "boom sig" if arm == "before" else "fine", "sig") for i in range(60) for arm in ("before", "after")]
    results = spark.createDataFrame(rows, "trial_id string, arm string, repeat int, completed boolean, output string, expected_signature string")
    pairs = measure.arm_means(measure.scored(results))
    assert measure.judge(pairs, band=0.0, iters=50).first().verdict == "helped"
    assert measure.judge(pairs, iters=50).first().verdict == "inconclusive"  # an infinite band by default
    assert measure.judge(pairs.limit(10), band=0.0, iters=50).first().verdict == "inconclusive"
    worse = pairs.withColumn("before", F.lit(1.0)).withColumn("after", F.lit(0.0)).withColumn("delta", F.lit(-1.0))
    assert measure.judge(worse, iters=50).first().verdict == "regressed"
    flat = pairs.withColumn("after", F.col("before")).withColumn("delta", F.lit(0.0))
    assert measure.judge(flat, iters=50).first().verdict == "no_effect"
    gold = measure.gold_episodes(measure.scored(results.withColumn("completed", F.lit(False))))
    assert gold.where("tier = 'gold'").count() == 0


def test_calibration(spark):
    runs = spark.createDataFrame([(r, 0.5) for r in range(4) for _ in range(3)], "run int, value double")
    c = measure.calibrate(runs, iters=50).first()
    assert c.aa_clean and c.within and c.halfwidth_pct == 0
    s = measure.witness_stability(spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1)], "witness_id string, exit_code int"))
    assert measure.stability_summary(s).first().asDict() == {"witnesses": 2, "stable": 1, "unstable": 1, "clean_pct": 50.0}


def test_trend(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 10, 1), ("2024-01-01 05:00:00", 13, 2), ("2024-01-02 00:00:00", 18, 3)], "ts string, episodes long, fail_labels long").withColumn("ts", F.to_timestamp("ts"))
    points = reports.trend(rows)
    assert [(r.date, r.new_episodes) for r in points.collect()] == [("2024-01-01", 3), ("2024-01-02", 5)]
    assert reports.trend_summary(points).first().sparkline == "▁█"


def test_planning_pieces(spark):
    out = planning.chained([{"a": 1}, {"a": 2}])
    assert out[1]["prev"] == out[0]["hash"] and [r["seq"] for r in out] == [0, 1]
    assert out[0]["prev"] is None
    answer = '```json\n{"summary":"s","layer":"context","target":"CLAUDE.md","edit":{"before":"x","after":"y"},"rationale":"r","expectedEffect":"e"}\n```'
    ask = {"layer": "context", "target": "CLAUDE.md", "target_text": "a x b", "max_lines": 20}
    codes = lambda text, **more: planning.parse_proposal(text, ask | more)[1]
    assert codes(answer) == [] and planning.parse_proposal(answer, ask)[0]["edit"]["after"] == "y"
    assert codes(answer, target_text="x x") == [("edit.before", "anchor_ambiguous")] and codes(answer, target_text="") == [("edit.before", "anchor_not_found")]
    assert codes(answer.replace('"summary"', '"eval_contract":1,"summary"')) == [("", "criterion_supplied")]
    assert codes(answer + " more") == codes("none") == codes(None) == [("", "format")] and codes("```json\n{\n```") == [("", "invalid_json")] and codes("```json\n[]\n```") == [("", "type")]
    assert codes(answer, layer="skill", target="b") == [("layer", "mismatch"), ("target", "mismatch")]
    assert codes(answer.replace('"after":"y"', '"after":"x"')) == [("edit.after", "unchanged")]
    assert codes(answer, max_lines=1) == [("edit", "line_budget_exceeded")]
    assert codes(answer.replace('"before":"x"', '"before":""'), creates_file=True) == [] and ("edit.before", "new_file_anchor") in codes(answer, creates_file=True)
    assert planning.lines_changed("a\nb\nc", "a\nx\ny\nc") == 3 and planning.lines_changed("a\na", "a") == 1
    patch = planning.self_patch(planning.parse_proposal(answer, ask)[0], {"requires": "auto", "strategy": "witness_replay"}, {"id": "cl", "members": ["e"]}, "auto", ["CLAUDE.md"])
    assert patch["requires"] == "auto" and patch["blast_radius"] == {"surfaces": ["CLAUDE.md"], "files_changed": 1, "lines_changed": 2} and patch["id"].startswith("sp_sha256:")
    assert planning.self_patch(planning.parse_proposal(answer, ask)[0], {"requires": "human-gate"}, {}, "auto", [])["requires"] == "human-gate"
    assert planning.resolve_target("CLAUDE.md", None, "/home/u") == "/home/u/.claude/CLAUDE.md" and planning.resolve_target("../x", "/w/p") == "/w/x"
    b = planning.brief({"id": "c", "signature": "s", "size": 2, "terminal": 1}, [{"request": "mail a@b.com", "project": "p"}], "context", "/a/b.md", "text")
    assert b["exemplars"][0]["request"] == "mail <EMAIL>" and b["target"] == "/a/b.md" and b["terminal_rate"] == 0.5 and b["constraints"]["max_lines"] == 20
    budget = spark.createDataFrame([(15.0, 5.0), (15.0, 6.0), (None, 1.0), (float("nan"), 1.0), (-1.0, 1.0)], "a double, b double")
    assert [r.x for r in budget.coalesce(1).select(planning.within_budget(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False, False]
    cursors = [spark.createDataFrame(rows, "file string, position double") for rows in ([("a", 5.0), ("b", -2.0)], [("a", 3.5), ("c", float("inf"))])]
    assert {r.file: r.position for r in planning.merge_cursors(*cursors).collect()} == {"a": 5, "b": 0, "c": 0}
    assert planning.attestation({}, "helped", "s", "witness_replay", ["c"], [], ["0" * 64, "bad"])["parents"] == ["0" * 64]
    assert measure.keep_lessons([("a", 0.2), ("b", 0.0), ("c", 0.0), ("d", 1.0)], 0.1) == [("a", True), ("b", False), ("c", False)]


def test_factory_and_merge(spark):
    row = {k: F.lit(v) for k, v in {"rework_attempt": 0, "terminal_state": "shipped", "tests_ok": True, "override_applied": "none", "tests_source": "run", "review_parse_ok": True}.items()}
    one = spark.range(1)
    assert tuple(one.select(labels.factory_outcome(row).alias("o")).first().o)[:2] == ("pass", "gold")
    row["tests_source"] = F.lit("prose")
    assert tuple(one.select(labels.factory_outcome(row).alias("o")).first().o)[:2] == ("pass", "weak")
    merged = labels.merge_outcomes(F.array(labels.outcome("fail", "weak", 0.9, "a"), labels.outcome("pass", "strong", 0.1, "b"), labels.outcome("odd", "gold", 1, "c")))
    assert tuple(one.select(merged.alias("o")).first().o)[:2] == ("pass", "strong")
    assert one.select(labels.cap_sidechain(labels.outcome("pass", "gold", 1, "m")).alias("o")).first().o.tier == "strong"


def test_pivot_and_text_cleanup(spark):
    p = spark.createDataFrame([("k", 1, 0.9), ("k", 2, 0.5), ("k", 3, 0.1)], "k string, checkpoint int, rate double")
    assert measure.pivot_drop(p, ["k"]).first().pivot in (2, 3)
    one = spark.range(1)
    assert one.select(measure.lesson_line(F.lit('x\n- "Do this"\n')).alias("x")).first().x == "Do this"
    assert one.select(measure.fenced_code(F.lit("a\n```py\nx = 1\n```\nb")).alias("x")).first().x == "x = 1\n"
    assert math.isclose(measure.stats.rollout_band(11, 6), 0.1206, abs_tol=1e-3)


def test_streams_equal_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.json").write_text('{"ts":"2024-01-01T00:00:00Z","session_id":"s","exit_code":1,"cmd_head":"ls"}\n{"session_id":"t"}\n')
    ingest.stream_captures(spark, str(source), str(out), str(tmp_path / "cp")).awaitTermination()
    (source / "b.json").write_text('{"session_id":"u"}\n')
    ingest.stream_captures(spark, str(source), str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.session_id for r in spark.read.parquet(str(out)).collect()) == ["s", "t", "u"]
    for _ in range(2):  # what is there already isn't added again
        ingest.appended(spark, str(source), str(tmp_path / "days"), str(tmp_path / f"cp{_}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "days")).count() == 3


def test_capture_rows(spark):
    cases = [
        ('{"session_id":"s","tool_name":"Bash","cwd":"/Users/me/x","tool_input":{"command":"ls -la"},"tool_response":{"stdout":"exit code -2\\nboom"}}', ("s", "<PATH>", "Bash", False, -2, False, "ls")),
        ('{"tool":"bash","input":{"command":"go a","cwd":"w"},"tool_output":{"meta":{"exit_code":"3"},"is_error":true}}', ("unknown", "w", "bash", False, 3, True, "go a")),
        ('{"tool_name":"Shell","tool_input":{},"result":{"content":[{"type":"text","text":"fine"}]},"is_error":true}', ("unknown", "unknown", "Shell", False, 1, True, "shell")),
        ('{"tool_name":"Edit","tool_input":{"file_path":"/a/b.py"},"tool_response":{"exit_code":7}}', ("unknown", "unknown", "Edit", True, 0, False, "b.py")),
    ]
    rows = ingest.capture_rows(spark.createDataFrame([(str(i), j) for i, (j, _) in enumerate(cases)], "ts string, e string").select("ts", F.parse_json("e").alias("event"))).orderBy("ts").collect()
    for (_, wanted), r in zip(cases, rows, strict=True):
        assert (r.session_id, r.cwd, r.tool, r.ok, r.exit_code, r.is_error, r.cmd_head) == wanted and len(r.input_digest) == 16
    one = lambda j: ingest.capture_rows(spark.createDataFrame([("t", j)], "ts string, e string").select("ts", F.parse_json("e").alias("event"))).first().input_digest
    assert one('{"tool_input":{"a":"sk-aaaaaaaaaa"}}') == one('{"tool_input":{"a":"sk-bbbbbbbbbb"}}') != one('{"tool_input":{"a":"other"}}')


def test_split_and_power(spark):
    rows = [(i, s, 0.0, 1.0 if s == "dev" else 0.0) for s in ("dev", "heldout") for i in range(60)]
    pairs = spark.createDataFrame(rows, "task int, split string, before double, after double").withColumn("delta", F.col("after") - F.col("before"))
    assert measure.judge_split(pairs, band=0.0, iters=50).first().verdict == "overfit"
    assert measure.judge_split(pairs.withColumn("after", F.lit(1.0)).withColumn("delta", F.lit(1.0)), band=0.0, iters=50).first().verdict == "helped"
    two = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 1.0), (3, 1.0, 0.5)], "task int, before double, after double")
    assert tuple(measure.hard_regressions(two).first()) == (1, 1)
    trials = spark.createDataFrame([("t", a, None, late, out, sig) for a in ("before", "after") for late, out, sig in ((False, "boom", ""), (True, "", "x"), (False, "x", "x"), (None, "y", None))], "trial_id string, arm string, completed boolean, timed_out boolean, output string, expected_signature string")
    assert [r.passed for r in measure.scored(trials).where("arm = 'after'").coalesce(1).collect()] == [1, 0, 0, 1]
    assert measure.score_trials(trials, iters=50).first().verdict == "inconclusive"
    zipped = measure.positional_pairs(spark.createDataFrame([([0.5, 2.0, float("nan"), 0.25], [1.0, -1.0])], "before array<double>, after array<double>"))
    assert [(r.before, r.after) for r in zipped.orderBy("task").collect()] == [(0.5, 1.0), (1.0, 0.0)]
    assert measure.aa_plan(spark.createDataFrame([("t",)], "task_id string"), 30).count() == 40
    runs = spark.createDataFrame([(6, 0.3, 0.6), (10, 0.3, 0.7)], "K int, baseline double, final double")
    found = measure.scaling_summary(runs, runs).first()
    assert tuple(found)[:3] == (True, 10, 0.7) and math.isclose(found.mean_final, 0.65)
    w = spark.createDataFrame([("a", "timeout", None), ("b", None, "timeout"), ("c", None, None)], "cmd string, mode string, error_class string")
    assert measure.without_timeouts(w).count() == 1 and measure.without_timeouts(w, include=True).count() == 3


def test_graded_reads_the_whole_output(spark):
    rows = [(0, "x" * 900 + " DONE", "DONE", None), (0, "total 1429 rows, quota DONE", "DONE", None), (1, "DONE", "DONE", None), (0, "DONE", "DONE", "429"), (0, "", "DONE", "broken")]
    out = measure.graded(spark.createDataFrame(rows, "exit_code int, output string, marker string, error string").coalesce(1)).collect()
    assert [(r.passed, r.excluded, r.retry) for r in out] == [(True, False, False), (True, False, False), (False, False, False), (False, True, True), (False, True, False)]
    assert len(out[0].output) == 800


def test_similar_sets_meet_as_numbers(spark, monkeypatch):
    """All pairs of the definition, at several limits, and no set of words is shuffled for each word of its prefix."""
    import random

    from spoolkit.operators import clusters

    rng = random.Random(5)
    base = [rng.sample(range(400), rng.choice([3, 10, 60, 150])) for _ in range(12)]
    rows = [(0, None, ["x"]), (1, "p", []), (2, "p", None)]
    for n in range(3, 150):
        own = set(rng.choice(base))
        for _ in range(rng.randrange(0, max(2, len(own) // 5))):
            own.discard(rng.choice(sorted(own)))
            own.add(rng.randrange(400))
        rows.append((n, rng.choice("pq"), [f"w{x}" for x in sorted(own)]))
    rows += [(200 + n, k, w) for n, k, w in rows[3:20]]
    items = spark.createDataFrame(rows, "id long, k string, ws array<string>")
    joined = []
    near = clusters.jaccard
    monkeypatch.setattr(clusters, "jaccard", lambda a, b: joined.append(1) or near(a, b))
    for least in (0.5, 0.8, 1.0):
        sets = [(n, k, set(w)) for n, k, w in rows if k is not None and w]
        want = {(a, b) for a, k, x in sets for b, j, y in sets if a < b and k == j and len(x & y) / len(x | y) >= least}
        found = clusters.similar_pairs(items, ["k"], "id", "ws", least)
        assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)
        forest = {(r.a, r.b) for r in clusters.similar_forest(items, ["k"], "id", "ws", least).collect()}
        assert forest <= want
        reach = lambda edges: {frozenset((r.component,)) | {r.vertex} for r in clusters.connected_components(spark.createDataFrame(sorted(edges), "a long, b long"), "a", "b").collect()} if edges else set()
        assert reach(forest) == reach(want)
    # the words of a set are read for pairs that are left, of longs
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString() and len(joined) == 6


def test_a_document_is_made_once_for_its_checks(spark):
    from spoolkit.operators import validation

    rows = spark.range(3).select("id", F.parse_json(F.when(F.col("id") == 0, "[1]").when(F.col("id") == 1, '{"id":"e","zz":1}').otherwise("{}")).alias("document"))
    found = validation.with_episode_errors(rows, "document")
    assert found.columns == ["id", "document", "errors"]
    codes = {r.id: [(e.path, e.code) for e in r.errors] for r in found.collect()}
    assert codes[0] == [("", "not_object")] and ("zz", "unknown_field") in codes[1] and ("id", "required") in codes[2]
    # the document is parsed for the checks, and once more at most to drop empty arrays
    assert found.select("id", "errors")._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") + found.select("id", "errors")._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 2


def test_unlike_sets_hardly_meet(spark):
    """Sets that share frequent words but no more: neither their words nor pairs by a single word travel."""
    import random

    from spoolkit.operators import clusters

    rng = random.Random(5)
    rows = [(n, "p", [f"w{x}" for x in rng.sample(range(3000), 40)]) for n in range(4000)]
    rows += [(5000 + n, "p", rows[n][2][:38] + ["x", "y"]) for n in range(20)]
    context = spark.sparkContext
    items = spark.createDataFrame(rows, "id long, k string, ws array<string>")
    items.count()

    def stages() -> dict:
        context._jsc.sc().listenerBus().waitUntilEmpty()
        found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._gateway.jvm.double, 0), context._gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    found = clusters.similar_pairs(items, ["k"], "id", "ws", 0.8).collect()
    assert {(r.a, r.b) for r in found} == {(n, 5000 + n) for n in range(20)}
    assert sum(n for k, n in stages().items() if k not in before) < 60 * len(rows)


def test_forest_of_a_large_group(spark):
    """Near copies of one set are tied together by few pairs, not by all of them."""
    from spoolkit.operators import clusters

    rows = [(n, "p", [f"w{x}" for x in range(40)] + [f"own{n}"]) for n in range(60)]
    edges = clusters.similar_forest(spark.createDataFrame(rows, "id long, k string, ws array<string>"), ["k"], "id", "ws", 0.8)
    found = clusters.connected_components(edges, "a", "b").collect()
    assert {(r.vertex, r.component) for r in found} == {(n, 0) for n in range(60)}
    assert edges.count() == 59
