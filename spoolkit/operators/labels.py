"""Outcome labels: rules over an episode, the session's next request, merges, pull requests and live captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.functions.text import first_of
from spoolkit.operators.scan import neighbours
from spoolkit.storage import stored

LABELS, TIERS = ("pass", "fail", "unknown"), ("gold", "strong", "weak", "unknown")
# Requests that take the last answer back, and commands that verify.
REBUKE = r"(?i)^\s*(no[,.]|that'?s wrong|you (didn'?t|did not)|still (broken|failing)|undo|revert that|why did you)"
VERIFICATION = r"^(?:npm test|npm run test|pytest|cargo test|go test|make test|node --test)(?:\s|\z)|^tsc(?:\s+[^;&|]*)?\s--noEmit(?:\s|\z)"
REBUKE_SECONDS, CAPTURE_SECONDS = 120, 300
_EDITORS = "(?i)^(edit|write|applypatch|apply_patch)$"


def outcome(label: str, tier: str, confidence: float, method: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(tier).alias("tier"), F.lit(float(confidence)).alias("confidence"), F.lit(method).alias("method"))


def is_verification(command: Column) -> Column:
    return F.coalesce(F.trim(command).rlike(VERIFICATION), F.lit(False))


def edited_files(episode_artifacts: Column, steps: Column) -> Column:
    return (F.size(episode_artifacts["files_written"]) > 0) | (F.size(episode_artifacts["files_edited"]) > 0) | F.exists(steps, lambda s: F.coalesce(s["tool"].rlike(_EDITORS), F.lit(False)))


def label_rules(failed: Column, green: Column, edited: Column, api_errors: Column, interrupted: Column, repeats: Column, errored: Column) -> Column:
    """The outcome by the first of five rules."""
    weak = (api_errors > 0) | interrupted | (repeats >= 3)
    return (
        F.when(failed, outcome("fail", "strong", 0.8, "transcript.unrecovered_terminal_error"))
        .when(green & edited, outcome("pass", "strong", 0.8, "transcript.verified_green"))
        .when(weak, outcome("fail", "weak", 0.4, "transcript.weak_signal"))
        .when(edited & (errored == 0), outcome("pass", "weak", 0.4, "transcript.clean_edit"))
        .otherwise(outcome("unknown", "unknown", 0, "transcript.insufficient"))
    )


def weak_reasons(api_errors: Column, interrupted: Column, repeats: Column) -> Column:
    return F.array_compact(F.array(F.when(api_errors > 0, "API error observed"), F.when(interrupted, "episode was interrupted"), F.when(repeats >= 3, "same command repeated at least 3 times")))


def transcript_outcome() -> Column:
    """The outcome of a row of the episode table."""
    s, steps = F.col("signals"), F.coalesce(F.col("steps"), F.array())
    last = F.slice(steps, F.greatest(F.lit(1), F.size(steps) - 2), F.lit(3))
    green = F.exists(last, lambda x: F.coalesce(x["exit_code"] == 0, F.lit(False)) & is_verification(x["command"]))
    return label_rules(F.col("failure").isNotNull(), green, edited_files(F.col("artifacts"), steps), s["api_errors"], s["interrupted"], s["repeat_command_max"], s["errored_tool_results"])


def label_sessions(episodes: DataFrame, keep_better: bool = True) -> DataFrame:
    """``episodes`` with ``outcome``; a timely rebuke at the start of the session's next episode makes it fail/weak.

    ``keep_better``: an outcome that is there already stays if it ranks higher
    (so labelling anew doesn't erase gold); else it is replaced.
    """
    next_of = W.partitionBy("session_id").orderBy("started", "id")
    seconds = F.unix_millis(F.try_to_timestamp(F.lead("started").over(next_of))) - F.unix_millis(F.try_to_timestamp("ended"))
    rebuked = seconds.between(0, REBUKE_SECONDS * 1000) & F.lead("request.text").over(next_of).rlike(REBUKE)
    found = F.when(F.coalesce(rebuked, F.lit(False)), outcome("fail", "weak", 0.4, "transcript.user_rebuke")).otherwise(transcript_outcome())
    labelled = episodes.withColumn("found", found)
    if keep_better and "outcome" in episodes.columns:
        labelled = labelled.withColumn("found", merge_outcomes(F.array("outcome", "found")))
    return labelled.withColumn("outcome", F.col("found")).drop("found")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "gold", 3).when(tier == "strong", 2).when(tier == "weak", 1).when(tier == "unknown", 0)


def merge_outcomes(outcomes: Column) -> Column:
    """The best outcome: by tier, confidence, then method; invalid ones don't count."""
    valid = F.filter(outcomes, lambda o: o.isNotNull() & o["label"].isin(*LABELS) & o["tier"].isin(*TIERS))
    ranked = F.transform(valid, lambda o: F.struct((-tier_rank(o["tier"])).alias("r"), (-F.coalesce(o["confidence"], F.lit(0.0))).alias("c"), F.coalesce(o["method"], F.lit("")).alias("m"), o.alias("o")))
    return F.coalesce(F.try_element_at(F.array_sort(ranked), F.lit(1))["o"], outcome("unknown", "unknown", 0, "merge.insufficient"))


def cap_sidechain(o: Column) -> Column:
    """A subagent's gold counts as strong."""
    return o.withField("tier", F.when(o["tier"] == "gold", "strong").otherwise(o["tier"]))


def factory_outcome(row: dict[str, Column]) -> Column:
    """From terminal facts: gold, or weak where they can't be verified."""
    fails = (F.coalesce(row["rework_attempt"], F.lit(0)) > 0) | (row["terminal_state"] == "needs-human")
    passes = (row["terminal_state"] == "shipped") & row["tests_ok"]
    doubt = F.coalesce(row["override_applied"] != "none", F.lit(True)) | F.coalesce(row["tests_source"] == "prose", F.lit(False)) | F.coalesce(row["review_parse_ok"] == F.lit(False), F.lit(False))
    made = lambda label: F.when(doubt, outcome(label, "weak", 0.4, "factory.demoted_unverifiable")).otherwise(outcome(label, "gold", 1, "factory.terminal_state"))
    return F.when(F.coalesce(fails, F.lit(False)), made("fail")).when(F.coalesce(passes, F.lit(False)), made("pass")).otherwise(outcome("unknown", "unknown", 0, "factory.insufficient"))


def tier_counts(rows: DataFrame, label: str, tier: str) -> DataFrame:
    """One row with a count for each label and tier, zeros included."""
    return rows.select(first_of(F.col(label), LABELS).alias("l"), first_of(F.col(tier), TIERS).alias("t")).agg(*(F.count_if(F.col("l") == x).alias(f"label_{x}") for x in LABELS), *(F.count_if(F.col("t") == x).alias(f"tier_{x}") for x in TIERS))


def issue_number(branch: Column, number: Column) -> Column:
    found = F.regexp_extract(F.coalesce(branch, F.lit("")), r"(?i)(?:^|[^a-z0-9])issue[-_/]?(\d+)(?:\z|[^0-9])", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("long"), number.cast("long"))


def link_pull_requests(episodes: DataFrame, prs: DataFrame, haystack: str = "haystack") -> DataFrame:
    """``id, rule, repo, number, label, reason, candidates`` for each episode.

    ``episodes``: id, git_branch, project, cwd and a text in ``haystack``; ``prs``:
    repo, number, headRefName, merged, closedUnmerged.  The branch decides if it
    matches one pull request; if it matches none, so does an issue number in the
    text together with the repository's name.  References are taken out of the
    text first, so both are equi-joins.  Two matches are ambiguous, also where one
    pull request is listed twice.
    """
    pr = prs.withColumn("issue", issue_number(F.col("headRefName"), F.col("number"))).withColumn("short", F.lower(F.element_at(F.split(F.regexp_replace("repo", "/+$", ""), "/"), -1)))
    # by key there is one small row, whatever the number of pull requests: how many there are, and the one if it is alone
    packed = F.struct("repo", "number", "merged", "closedUnmerged")
    told = (F.count("*").alias("n"), F.min(packed).alias("one"))
    names = F.transform(F.array_sort(F.collect_list(packed)), lambda p: F.concat_ws("#", p["repo"], p["number"].cast("string")))
    of_branch = pr.where("headRefName <> ''").groupBy("headRefName").agg(*told)
    refs = F.regexp_extract_all(F.lower(haystack), F.lit(r"(?:issue[-_/]?|#)(\d+)(?!\d)"), F.lit(1))
    tail = lambda c: F.lower(F.element_at(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\\/]+$", ""), r"[\\/]"), -1))
    numbers = F.array_distinct(F.array_compact(F.transform(refs, lambda n: n.try_cast("long"))))
    named = episodes.select("id", F.explode(F.array_distinct(F.array(tail(F.col("project")), tail(F.col("cwd"))))).alias("short"), numbers.alias("issues"))
    asked = named.select("id", "short", F.explode("issues").alias("issue"))
    met = asked.join(pr.groupBy("short", "issue").agg(*told), ["short", "issue"]).dropDuplicates(["id", "short", "issue"])
    by_issue = met.groupBy("id").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    branch = F.nullif("git_branch", F.lit("")).alias("headRefName")
    both = episodes.select("id", branch).join(of_branch.withColumnsRenamed({"n": "branch_n", "one": "branch_one"}), "headRefName", "left").join(by_issue.withColumnsRenamed({"n": "issue_n", "one": "issue_one"}), "id", "left")
    rule = F.when(F.col("branch_n").isNotNull(), "branch").when(F.col("issue_n").isNotNull(), "issue_repo")
    found = both.withColumn("rule", rule).withColumn("n", F.coalesce("branch_n", "issue_n")).withColumn("one", F.when(F.col("n") == 1, F.coalesce("branch_one", "issue_one")))
    # the lists of candidates come by joins of their own, on a key with one row, so who doesn't read them doesn't make them
    ambiguous = F.col("n") > 1
    branch_names = pr.where("headRefName <> ''").groupBy("headRefName").agg(names.alias("branch_names"))
    issue_names = met.select("id", "short", "issue").join(pr, ["short", "issue"]).groupBy("id").agg(names.alias("issue_names"))
    found = found.join(branch_names, "headRefName", "left").join(issue_names, "id", "left")
    one = F.col("one")
    settled = F.coalesce(one["merged"] | one["closedUnmerged"], F.lit(False))
    return found.select(
        "id", F.when(settled, F.col("rule")).alias("rule"), F.when(settled, one["repo"]).alias("repo"), F.when(settled, one["number"]).alias("number"),
        F.when(settled, F.when(one["merged"], "pass").otherwise("fail")).alias("label"), F.when(ambiguous, F.concat(F.lit("ambiguous_"), "rule")).alias("reason"),
        F.when(ambiguous, F.coalesce("branch_names", "issue_names")).alias("candidates"),
    )


def with_gold(episodes: DataFrame, links: DataFrame) -> DataFrame:
    """``episodes`` whose linked ones (``link_pull_requests``) have the pull request's outcome: gold, confidence 1."""
    gold = links.where("label is not null").select("id", F.col("label").alias("gold_label"))
    found = F.when(F.col("gold_label").isNotNull(), F.struct(F.col("gold_label").alias("label"), F.lit("gold").alias("tier"), F.lit(1.0).alias("confidence"), F.lit("merge").alias("method")))
    return episodes.join(gold, "id", "left").withColumn("outcome", F.coalesce(found, "outcome")).drop("gold_label")


def link_counts(links: DataFrame) -> DataFrame:
    return links.agg(F.count_if(F.col("label").isNotNull()).alias("linked"), F.count_if(F.col("label") == "pass").alias("gold_pass"), F.count_if(F.col("label") == "fail").alias("gold_fail"), F.count_if(F.col("label").isNull()).alias("unlinked"))


def mutual_nearest(left: DataFrame, right: DataFrame, keys: list[str], seconds: int = CAPTURE_SECONDS, left_id: str = "step_id", right_id: str = "row_id", at: str = "at", scope: tuple[str, ...] = ()) -> DataFrame:
    """``left_id, right_id, distance`` of pairs that are each other's only nearest within ``seconds``.

    Equal ``keys``, and times in microseconds in ``at``; rows of ``right`` compete
    within each ``scope`` (columns of ``left``) alone.  Times fall into cells of
    that length, so a row meets only its own and the two next cells.
    """
    span = seconds * 1_000_000
    cell = F.floor(F.col(at) / span)
    a = left.select(*keys, *scope, left_id, F.col(at).alias("a_at"), cell.alias("cell"))
    b = right.select(*keys, right_id, F.col(at).alias("b_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = a.join(b, [*keys, "cell"]).withColumn("distance", F.abs(F.col("a_at") - F.col("b_at"))).where(F.col("distance") <= span).select(*scope, left_id, right_id, "distance")

    def only(rows: DataFrame, name: str, *side: str) -> DataFrame:
        best = rows.groupBy(*side).agg(F.min("distance").alias("best"))
        return rows.join(best, [*side]).withColumn("ties", F.count(F.when(F.col("distance") == F.col("best"), 1)).over(W.partitionBy(*side))).withColumn(name, (F.col("distance") == F.col("best")) & (F.col("ties") == 1)).drop("best", "ties")

    return only(only(near, "best_l", left_id), "best_r", *scope, right_id).where("best_l and best_r").select(*scope, left_id, right_id, "distance")


def captured_cwd(cwd: Column) -> Column:
    return F.regexp_replace(F.coalesce(cwd, F.lit("")), r"(?:/[A-Za-z0-9_.@%+,:=~-]+)+", "<PATH>")


_CAPTURE_KEYS = ["session_id", "cwd", "head", "tool"]


def promotions(episodes: DataFrame, captures: DataFrame) -> DataFrame:
    """``id, i, exit_code, good, captured, distance``: the live captures that settle a step's exit code; gold episodes are left out.

    A step and a capture of equal session, folder, head and tool match if each is
    the other's only nearest within ``CAPTURE_SECONDS``; captures look among the
    steps of one episode.  A step stands at its time, or without one anywhere
    from its episode's start to its end: a capture in between is at distance 0,
    any other at the distance of the nearer end.  ``captured`` and ``distance``
    are in microseconds.

    Both sides find their nearest by an ordered scan over all rows, so neither a
    session with most of the rows nor a long episode is one task's work.
    """
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    near = CAPTURE_SECONDS * 1_000_000
    keys = _CAPTURE_KEYS
    step = episodes.where("coalesce(outcome.tier, '') <> 'gold'").select("id", "session_id", micros("started").alias("from"), micros("ended" if "ended" in episodes.columns else "started").alias("to"), F.col("cwd").alias("ep_cwd"), F.explode("steps").alias("s"))
    own, start, end = micros("s.ts"), F.coalesce("from", "to"), F.coalesce("to", "from")
    steps = stored(step.select(
        "id", F.col("s.i").alias("i"), "session_id", captured_cwd(F.coalesce("s.cwd", "ep_cwd") if "cwd" in _fields(episodes, "steps") else F.col("ep_cwd")).alias("cwd"), F.col("s.head").alias("head"), F.lower("s.tool").alias("tool"),
        F.coalesce(own, start).alias("at"), F.coalesce(own, end).alias("to"), own.isNotNull().alias("timed"),
    ).where("head <> '' and at is not null"), "steps")
    rows = captures.where("exit_code is not null and cmd_head <> ''").select("session_id", captured_cwd(F.col("cwd")).alias("cwd"), F.col("cmd_head").alias("head"), F.lower("tool").alias("tool"), micros("ts").alias("at"), "exit_code", (F.coalesce("ok", F.lit(False)) & (F.col("exit_code") == 0)).alias("good")).where("at is not null")
    points = stored(rows.groupBy(*keys, "at").agg(F.count("*").alias("n"), F.min(F.struct("exit_code", "good")).alias("what")), "captures")
    # the next capture of the key, so that a second one inside a step's interval is seen
    following = neighbours(points.select(*keys, "at"), points.withColumn("at", F.col("at") + 1), keys, "at").withColumn("at", F.col("at") - 1).select(*keys, "at", "n", "what", F.col("after.at").alias("next"))
    found = neighbours(following, steps, keys, "at")
    b, a = F.col("before"), F.col("after")
    inside = F.coalesce(a["at"] <= F.col("to"), F.lit(False))
    to_b, to_a = F.col("at") - b["at"], F.when(inside, 0).otherwise(a["at"] - F.col("to"))
    take_b = F.coalesce(to_b < to_a, to_a.isNull())
    only = F.when(inside, (a["n"] == 1) & F.coalesce(a["next"] > F.col("to"), F.lit(True))).when(take_b, b["n"] == 1).otherwise((a["n"] == 1) & F.coalesce(to_a < to_b, F.lit(True)))
    chosen, distance = F.when(take_b & ~inside, F.struct(b["at"].alias("at"), b["what"].alias("what"))).otherwise(F.struct(a["at"].alias("at"), a["what"].alias("what"))), F.when(inside, F.lit(0)).otherwise(F.least(to_b, to_a))
    nearest = found.withColumn("chosen", chosen).withColumn("distance", distance.cast("long")).where(only & (F.col("distance") <= near)).select("id", "i", *keys, F.col("chosen.at").alias("at"), F.col("chosen.what").alias("what"), "distance")
    proposed = stored(nearest, "proposed")

    # the other way round: how far the nearest steps of the episode are from the capture, and how many they are
    scope = ["id", *keys]
    timed = steps.where("timed").groupBy(*scope, "at").agg(F.count("*").alias("n"))
    untimed = steps.where("not timed").groupBy(*scope).agg(F.count("*").alias("loose"), F.first("at").alias("from"), F.first("to").alias("until"))
    back = neighbours(timed, proposed, scope, "at").join(untimed, scope, "left")
    gaps = F.array(F.col("at") - F.col("before.at"), F.col("after.at") - F.col("at"), F.greatest(F.lit(0), F.col("from") - F.col("at"), F.col("at") - F.col("until")))
    gaps = F.when(F.col("loose").isNotNull(), gaps).otherwise(F.slice(gaps, 1, 2))
    least = F.array_min(gaps)
    many = lambda gap, n: F.when(F.coalesce(gap == least, F.lit(False)), n).otherwise(0)
    rivals = many(F.col("at") - F.col("before.at"), F.col("before.n")) + many(F.col("after.at") - F.col("at"), F.col("after.n")) + many(F.when(F.col("loose").isNotNull(), F.greatest(F.lit(0), F.col("from") - F.col("at"), F.col("at") - F.col("until"))), F.col("loose"))
    return back.where((F.col("distance") == least) & (rivals == 1)).select("id", "i", "what.exit_code", "what.good", F.col("at").alias("captured"), "distance")


def _fields(rows: DataFrame, name: str) -> list[str]:
    """The fields of an array of structs."""
    return rows.schema[name].dataType.elementType.fieldNames()


def promoted(episodes: DataFrame, captures: DataFrame) -> DataFrame:
    """``episodes`` with what live captures say (``promotions``).

    Matched steps have the captured ``exit_code`` and ``ok``, and
    ``outcome_confidence`` strong.  The outcome is that of the latest match (of
    several the last step): strong, confidence 0.95, with ``evidence`` (step,
    why); it is an empty list for other episodes.
    """
    found = promotions(episodes, captures)
    latest = F.max(F.struct("captured", "i", "exit_code", "good"))
    steps = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("exit_code", "good")))).alias("live"), latest.alias("latest"))
    names = [n for n in _fields(episodes, "steps") if n != "outcome_confidence"]
    live = lambda s: F.try_element_at("live", s["i"])
    fixed = lambda s: F.struct(*(F.coalesce(live(s)["exit_code"] if n == "exit_code" else live(s)["good"], s[n]).alias(n) if n in ("exit_code", "ok") else s[n].alias(n) for n in names), F.when(live(s).isNotNull(), "strong").alias("outcome_confidence"))
    good = F.col("latest.good")
    label = F.when(good, outcome("pass", "strong", 0.95, "live_capture")).when(good == F.lit(False), outcome("fail", "strong", 0.95, "live_capture"))
    why = F.concat(F.lit("live PostToolUse exit code "), F.col("latest.exit_code").cast("string"))
    evidence = F.when(F.col("latest").isNotNull(), F.array(F.struct(F.col("latest.i").alias("step"), why.alias("why")))).otherwise(F.array().cast("array<struct<step:int,why:string>>"))
    return episodes.join(steps, "id", "left").withColumn("steps", F.transform("steps", fixed)).withColumn("outcome", F.coalesce(label, "outcome")).withColumn("evidence", evidence).drop("live", "latest")
