"""Before/after measurement: suites, arms, verdicts, calibration, recorded rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.functions import stats
from spoolkit.operators.scan import positions, prefix_sums
from spoolkit.storage import stored


def heldout_bucket(key: Column, salt: str = "") -> Column:
    """A number from 0 to 99 from the first two bytes of sha256(salt + key)."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 4), 16, 10).cast("int") % 100).cast("int")


def heldout_split(rows: DataFrame, key: str, salt: str = "", percent: int = 40) -> DataFrame:
    return rows.withColumn("bucket", heldout_bucket(F.col(key).cast("string"), salt)).withColumn("split", F.when(F.col("bucket") < percent, "heldout").otherwise("dev"))


def trial_suite(clusters: DataFrame, episodes: DataFrame, root: str) -> DataFrame:
    """The distinct requests of a cluster's members, the first in input order, as trials."""
    members = clusters.where(F.col("root") == root).select(F.posexplode("members").alias("nth", "id"), F.col("signature").alias("expected_signature"))
    found = members.join(episodes.select("id", F.col("request.text").alias("prompt"), "cwd"), "id").where("trim(prompt) <> ''")
    first = F.row_number().over(W.partitionBy("prompt").orderBy("nth"))
    return found.withColumn("n", first).where("n = 1").select("id", "nth", "prompt", "cwd", "expected_signature")


def plan_trials(suite: DataFrame, repeats: int = 12) -> DataFrame:
    """Every trial in both arms, at least five times."""
    cells = F.explode(F.sequence(F.lit(1), F.lit(max(5, repeats)))).alias("repeat")
    return suite.select("*", cells).withColumn("arm", F.explode(F.array(F.lit("before"), F.lit("after"))))


def budgeted(plan: DataFrame, order: list[str], cost: str, most: int, budget: float) -> DataFrame:
    """The first cells that stay within a count and a budget, with what is ``spent`` so far; nothing after the first that doesn't fit.

    ``order`` decides between any two cells.  A null cost is none.
    """
    summed = stored(prefix_sums(plan, [cost], *order).withColumn("spent", F.col(f"{cost}_before") + F.coalesce(F.col(cost), F.lit(0))), "spent")
    first = summed.where(F.col("spent") > budget).agg(F.min("n_before").alias("cut"))  # one row
    kept = summed.crossJoin(F.broadcast(first)).where((F.col("n_before") < most) & F.coalesce(F.col("n_before") < F.col("cut"), F.lit(True)))
    return kept.select(*plan.columns, "spent")


def transcript(results: DataFrame) -> Column:
    """What a trial wrote: its recorded texts, joined by line breaks."""
    there = [F.col(c) for c in ("output", "stdout", "stderr", "transcript") if c in results.columns]
    return F.concat_ws("\n", *there)


def scored(results: DataFrame, exclude_incomplete: bool = False) -> DataFrame:
    """``passed``: completed, and what it wrote lacks the expected signature, if there is one.

    Where ``completed`` is null, a trial counts as complete unless it timed out
    or couldn't start (``timed_out``, ``spawn_error``, where recorded).
    """
    broken = [F.coalesce(F.col(c), F.lit(False)) for c in ("timed_out", "spawn_error") if c in results.columns]
    complete = F.coalesce(F.col("completed"), ~(broken[0] | broken[-1]) if broken else F.lit(True))
    rows = results.where(complete) if exclude_incomplete else results
    expected = F.coalesce(F.col("expected_signature"), F.lit(""))
    return rows.withColumn("passed", (complete & ((expected == "") | ~F.contains(transcript(results), expected))).cast("int"))


def arm_passes(rows: DataFrame) -> DataFrame:
    """``arm, passes, n`` of scored trials."""
    return rows.groupBy("arm").agg(F.sum("passed").alias("passes"), F.count("*").alias("n"))


def positional_pairs(rates: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``task, before, after, delta``: two arrays of rates paired by place, as far as the shorter reaches; values are held to 0 and 1 and non-finite ones left out first."""
    held = lambda c: F.transform(F.filter(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    both = rates.select(held(F.col(before)).alias("b"), held(F.col(after)).alias("a"))
    n = F.least(F.size("b"), F.size("a"))
    return both.select(F.posexplode(F.arrays_zip(F.slice("b", F.lit(1), n).alias("b"), F.slice("a", F.lit(1), n).alias("a"))).alias("task", "x")).select("task", F.col("x.b").alias("before"), F.col("x.a").alias("after"), (F.col("x.a") - F.col("x.b")).alias("delta"))


def aa_plan(tasks: DataFrame, n: int) -> DataFrame:
    """``task_id, run, repeat``: two control runs of each task, at most twenty times each."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(min(n, 20) - 1))).alias("repeat")
    return tasks.select("task_id", cells).withColumn("run", F.explode(F.array(F.lit("a"), F.lit("b"))))


def aa_band(results: DataFrame) -> DataFrame:
    """``task_id, n, band95`` of recorded control runs (task_id, run, repeat, completed, reproduced): the 95th percentile by nearest rank of differences between runs, 0 without any."""
    done = results.where("completed")
    side = lambda r: done.where(F.col("run") == r).select("task_id", "repeat", (~F.col("reproduced")).cast("int").alias(r))
    delta = side("a").join(side("b"), ["task_id", "repeat"]).select("task_id", F.abs(F.col("b") - F.col("a")).cast("double").alias("delta"))
    found = delta.groupBy("task_id").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.95) within group (order by delta)").alias("band95"))
    return results.select("task_id").distinct().join(found, "task_id", "left").select("task_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("band95", F.lit(0.0)).alias("band95"))


def arm_means(rows: DataFrame, task: str = "trial_id", arm: str = "arm", passed: str = "passed") -> DataFrame:
    """``task, before, after, n_before, n_after, delta`` of the tasks with both arms."""
    of = lambda a: F.when(F.col(arm) == a, F.col(passed))
    wide = rows.groupBy(F.col(task).alias("task")).agg(F.avg(of("before")).alias("before"), F.avg(of("after")).alias("after"), F.count(of("before")).alias("n_before"), F.count(of("after")).alias("n_after"))
    return wide.where("n_before > 0 and n_after > 0").withColumn("delta", F.col("after") - F.col("before"))


def hard_regressions(pairs: DataFrame) -> DataFrame:
    """``regressions, fixes``: tasks that always passed and don't now, and tasks that never passed and do now, at times at least."""
    return pairs.agg(F.count_if((F.col("before") == 1) & (F.col("after") < 1)).alias("regressions"), F.count_if((F.col("before") == 0) & (F.col("after") > 0)).alias("fixes"))


def judge(pairs: DataFrame, band: float = float("inf"), mde: float = 0.05, iters: int = 10_000, seed: int = 42) -> DataFrame:
    """``verdict, n, delta, lo, hi, regressions, fixes, powered`` of paired tasks."""
    ci = stats.bootstrap_mean(pairs, "delta", "task", iters, 0.05, seed)
    both = ci.crossJoin(hard_regressions(pairs))  # one row each
    found = stats.verdict(F.col("regressions"), F.col("n"), F.col("lo"), F.col("hi"), F.lit(band), mde)
    return both.select(found.alias("verdict"), "n", F.col("point").alias("delta"), "lo", "hi", "regressions", "fixes", (F.col("n") >= stats.POWER_FLOOR).alias("powered"))


def judge_split(pairs: DataFrame, **design) -> DataFrame:
    """``judge`` of the held-out tasks; ``overfit`` where only the others (``split`` = dev) are helped."""
    dev = judge(pairs.where("split = 'dev'"), **design).select(F.col("verdict").alias("dev_verdict"))
    held = judge(pairs.where("split = 'heldout'"), **design)
    over = (F.coalesce(F.col("dev_verdict"), F.lit("")) == "helped") & (F.col("verdict") != "helped")
    return held.crossJoin(dev).withColumn("verdict", F.when(over, "overfit").otherwise(F.col("verdict"))).drop("dev_verdict")  # one row each


def score_trials(results: DataFrame, **design) -> DataFrame:
    """The verdict on recorded trials; inconclusive without the power to tell."""
    found = judge(arm_means(scored(results)), **design)
    return found.withColumn("verdict", F.when(F.col("powered"), F.col("verdict")).otherwise("inconclusive"))


def benchmark_totals(results: DataFrame) -> DataFrame:
    """``tasks_total, tasks_helped, gold_episodes, sandboxes, elapsed_s`` of measured tasks (task_id, verdict, n, sandboxes, elapsed_s); each arm of n trials gives n gold episodes."""
    return results.agg(F.count("*").alias("tasks_total"), F.count_if(F.col("verdict") == "helped").alias("tasks_helped"), F.coalesce(F.sum(F.col("n") * 2), F.lit(0)).alias("gold_episodes"), F.coalesce(F.sum("sandboxes"), F.lit(0)).alias("sandboxes"), F.round(F.coalesce(F.sum("elapsed_s"), F.lit(0.0)), 1).alias("elapsed_s"))


def tasks_of(tasks: DataFrame, split: str | None = None, task_id: str | None = None) -> DataFrame:
    """The registry's tasks of a split (train or holdout), or one by its id."""
    found = tasks if split is None else tasks.where(F.col("split") == split)
    return found if task_id is None else found.where(F.col("task_id") == task_id)


def scaling_summary(sweep: DataFrame, replications: DataFrame) -> DataFrame:
    """``climbs, best_k, best_final, mean_final``: whether every run (K, baseline, final) ended above its baseline, the sweep's best, and the replications' mean."""
    every = sweep.select("baseline", "final").unionByName(replications.select("baseline", "final")).agg(F.coalesce(F.bool_and(F.col("final") > F.col("baseline")), F.lit(True)).alias("climbs"))
    best = sweep.agg(F.max(F.struct("final", (-F.col("K")).alias("k"))).alias("x")).select((-F.col("x.k")).alias("best_k"), F.col("x.final").alias("best_final"))
    mean = replications.agg(F.coalesce(F.avg("final"), F.lit(0.0)).alias("mean_final"))
    return every.crossJoin(best).crossJoin(mean)  # one row each


def without_timeouts(witnesses: DataFrame, include: bool = False) -> DataFrame:
    """Witnesses to replay: those of timeouts (``mode`` or ``error_class``) are left out unless asked for."""
    return witnesses if include else witnesses.where((F.coalesce("mode", F.lit("")) != "timeout") & (F.coalesce("error_class", F.lit("")) != "timeout"))


def calibrate(runs: DataFrame, iters: int = 10_000) -> DataFrame:
    """``mean, sd, halfwidth_pct, aa_clean, within`` of control runs (run, value).

    Clean if the interval of the differences of consecutive runs holds zero;
    within if 1.96 sd is at most ten points.
    """
    rates = runs.where("value is not null and not isnan(value)").groupBy("run").agg(F.avg("value").alias("rate"))
    step = rates.withColumn("delta", F.col("rate") - F.lag("rate").over(W.orderBy("run")))  # a handful of runs
    deltas = step.select(F.col("run").alias("task"), F.when(F.col("delta").isNull() & (F.count("*").over(W.partitionBy()) == 1), 0.0).otherwise(F.col("delta")).alias("delta"))
    ci = stats.bootstrap_mean(deltas, iters=iters)
    noise = rates.agg(stats.noise_band(F.col("rate")).alias("b"))
    half = F.when(F.col("b.sd") == 0, 0.0).otherwise(F.col("b.band95") * 100)
    return noise.crossJoin(ci).select("b.mean", "b.sd", half.alias("halfwidth_pct"), ((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("aa_clean"), (half <= 10).alias("within"))


def witness_stability(replays: DataFrame) -> DataFrame:
    """``witness_id, n, stable, sd`` of recorded exit codes (witness_id, exit_code)."""
    bad = (F.col("exit_code") != 0).cast("double")
    return replays.groupBy("witness_id").agg(F.count("*").alias("n"), (F.countDistinct("exit_code") == 1).alias("stable"), F.coalesce(F.stddev_samp(bad), F.lit(0.0)).alias("sd"))


def stability_summary(stability: DataFrame) -> DataFrame:
    return stability.agg(F.count("*").alias("witnesses"), F.count_if("stable").alias("stable"), F.count_if(~F.col("stable")).alias("unstable"), F.coalesce(F.count_if("stable") * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("clean_pct"))


def rollout_summary(attempts: DataFrame) -> DataFrame:
    """Pooled mean and Wald interval over recorded attempts (task_id, mode, passed, excluded), variance at least 1e-4, next to one clustered by task."""
    live = attempts.where("not coalesce(excluded, false)")
    by_task = live.groupBy("task_id").agg(F.avg(F.col("passed").cast("double")).alias("rate"), F.count("*").alias("k"))
    pooled = live.agg(F.avg(F.col("passed").cast("double")).alias("mean"), F.count("*").alias("n"))
    tasks = by_task.agg(F.count("*").alias("tasks"), F.coalesce(F.stddev_samp("rate") / F.sqrt(F.count("*")), F.lit(0.0)).alias("task_se"))
    half = 1.96 * F.sqrt(F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(1e-4)) / F.col("n"))
    return pooled.crossJoin(tasks).select("mean", "n", "tasks", F.greatest(F.lit(0.0), F.col("mean") - half).alias("lo"), F.least(F.lit(1.0), F.col("mean") + half).alias("hi"), F.greatest(F.lit(0.0), F.col("mean") - 1.96 * F.col("task_se")).alias("lo_by_task"), F.least(F.lit(1.0), F.col("mean") + 1.96 * F.col("task_se")).alias("hi_by_task"))


def worst_mode(attempts: DataFrame, tried: list[str]) -> DataFrame:
    """The mode with most failures that hasn't been tried."""
    failed = attempts.where("not passed and not coalesce(excluded, false)").where(~F.col("mode").isin(*tried) if tried else F.lit(True))
    return failed.groupBy("mode").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "mode").limit(1)


def pivot_drop(points: DataFrame, keys: list[str], checkpoint: str = "checkpoint", rate: str = "rate") -> DataFrame:
    """``keys, pivot, drop``: where the rate falls most from one checkpoint to the next, the first of equal ones."""
    w = W.partitionBy(*keys).orderBy(checkpoint)
    drops = points.withColumn("drop", F.lag(rate).over(w) - F.col(rate)).where("drop is not null")
    return drops.groupBy(*keys).agg(F.max(F.struct("drop", (-F.col(checkpoint)).alias("at"))).alias("x")).select(*keys, (-F.col("x.at")).alias("pivot"), F.col("x.drop").alias("drop"))


def replication_summary(runs: DataFrame) -> DataFrame:
    """Mean, least and largest of baseline, final and gain; reproduced if finals span at most 0.15 and every gain is positive."""
    gain = runs.withColumn("gain", F.col("final") - F.col("baseline"))
    each = [f(c).alias(f"{n}_{c}") for c in ("baseline", "final", "gain") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    out = gain.agg(F.count("*").alias("runs"), *each)
    return out.withColumn("reproduced", (F.col("max_final") - F.col("min_final") <= 0.15) & (F.col("min_gain") > 0))


def lesson_reliability(lessons: DataFrame) -> DataFrame:
    """``mode, kept, tried, avg_gain, reliability`` over replications."""
    out = lessons.groupBy("mode").agg(F.count_if("kept").alias("kept"), F.count("*").alias("tried"), F.avg("gain").alias("avg_gain"))
    return out.withColumn("reliability", F.when(F.col("kept") == F.col("tried"), "reliable").when(F.col("kept") == 0, "never").otherwise("flaky"))


def keep_lessons(rounds: list[tuple[str, float]], band: float) -> list[tuple[str, bool]]:
    """Gate a learning loop: a gain above the band is kept, two rejections in a row end it.  (Driver-side: a few rounds.)"""
    out, misses = [], 0
    for name, gain in rounds:
        kept = gain > band
        misses = 0 if kept else misses + 1
        out.append((name, kept))
        if misses == 2:
            break
    return out


def gated_rounds(rounds: DataFrame, run: str, order: list[str], gain: str, band: float) -> DataFrame:
    """``rounds`` of many learning runs with ``kept``: a gain above the band is kept, and two rejections in a row are a run's last rounds.

    A null gain is a rejection; ``run`` has no nulls and ``order`` decides between
    any two rounds of one.
    """
    kept = F.coalesce(F.col(gain) > band, F.lit(False))
    placed = stored(positions(rounds, run, *order).withColumn("kept", kept), "rounds")
    missed = placed.where("not kept").select(run, "pos")
    ends = missed.join(missed.select(run, (F.col("pos") + 1).alias("pos")), [run, "pos"], "left_semi").groupBy(run).agg(F.min("pos").alias("end"))
    return placed.join(ends, run, "left").where(F.coalesce(F.col("pos") <= F.col("end"), F.lit(True))).drop("pos", "end")


def gold_episodes(results: DataFrame) -> DataFrame:
    """Completed trials as gold outcomes, others unknown."""
    return results.select("trial_id", "arm", "repeat", F.when(~F.coalesce(F.col("completed"), F.lit(False)), "unknown").when(F.col("passed") == 1, "pass").otherwise("fail").alias("label"), F.when(F.coalesce(F.col("completed"), F.lit(False)), "gold").otherwise("unknown").alias("tier"))


#: Fixed value: what an agent's error says when it is throttled.
RATE_LIMITED = r"(?i)rate.?limit|quota|429|usage limit|overloaded|too many|capacity|try again"


def graded(attempts: DataFrame) -> DataFrame:
    """``passed``: exit code 0 and the marker in the whole output, of which 800 characters are shown.

    An attempt whose agent gave no answer (``error``, where recorded) is
    ``excluded``, not failed; ``retry`` tells whether it was throttled.
    """
    error = F.col("error") if "error" in attempts.columns else F.lit(None).cast("string")
    tested = attempts.withColumn("passed", error.isNull() & F.coalesce((F.col("exit_code") == 0) & F.contains("output", "marker"), F.lit(False))).withColumn("excluded", error.isNotNull())
    return tested.withColumn("retry", F.coalesce(error.rlike(RATE_LIMITED), F.lit(False))).withColumn("output", F.substring("output", 1, 800))


def fenced_code(answer: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(answer, r"```[\w+-]*\n([\s\S]*?)```", 1), F.lit("")), answer)


def lesson_line(answer: Column) -> Column:
    """The last non-empty line, without quotes and bullets."""
    lines = F.filter(F.transform(F.split(answer, "\n"), F.trim), lambda x: x != "")
    return F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), r"^[-*>\"'\s]+|[\"'\s]+$", "")
