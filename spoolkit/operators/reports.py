"""The failure atlas, the trend, and their rendering."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.functions.text import redact, shorten, sparkline
from spoolkit.operators.clusters import error_text_of, is_proposable
from spoolkit.operators.labels import TIERS


def share_rows(rows: DataFrame, name: str) -> DataFrame:
    """``name, count, pct``: each value's count and percentage."""
    n = rows.groupBy(name).agg(F.count("*").alias("count"))
    total = n.agg(F.sum("count").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(name, "count", (F.col("count") * 100.0 / F.col("total")).alias("pct")).orderBy(F.desc("count"), name)


def totals(episodes: DataFrame) -> DataFrame:
    """One pass over project, session_id, label, tier, witnessed, replayable, api_errors, interrupted and repeats."""
    fail = F.col("label") == "fail"
    weak = ~F.col("witnessed") & fail
    signal = F.when(F.col("api_errors") > 0, "api_error").when(F.col("interrupted"), "interrupted").when(F.col("repeats") >= 3, "stuck_retry").otherwise("other")
    return episodes.agg(
        F.count("*").alias("episodes"), F.count_if(F.col("witnessed") | weak).alias("failures"), F.count_if("witnessed").alias("witnessed_failures"), F.count_if(weak).alias("weak_signal_failures"),
        F.count_if(F.col("label") == "pass").alias("passes"), F.countDistinct("project").alias("projects"), F.countDistinct("session_id").alias("sessions"), F.count_if(F.col("witnessed") & F.col("replayable")).alias("replayable_witnesses"),
        *(F.count_if(weak & (signal == s)).alias(f"weak_{s}") for s in ("api_error", "interrupted", "stuck_retry", "other")),
        F.coalesce(F.count_if(fail) / F.nullif(F.count_if(F.col("label").isin("fail", "pass")), F.lit(0)), F.lit(0.0)).alias("failure_rate"),
    )


def atlas_rows(episodes: DataFrame) -> DataFrame:
    """The columns that the atlas needs, from the episode table."""
    return episodes.select("id", "project", "session_id", "started", F.col("outcome.label").alias("label"), F.col("outcome.tier").alias("tier"), F.col("failure").isNotNull().alias("witnessed"), F.coalesce("failure.witness.replayable", F.lit(False)).alias("replayable"), F.col("failure.mode").alias("error_class"), F.col("signals.api_errors").alias("api_errors"), F.col("signals.interrupted").alias("interrupted"), F.col("signals.repeat_command_max").alias("repeats"))


def status(episodes: DataFrame, clusters: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: episodes, failures (labelled or witnessed), tiers, proposable clusters, applied and queued patches, last run.

    ``episodes``: label, tier, witnessed; ``ledger``: ts, applied, gate_decision, reason.
    """
    known = F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("unknown")
    e = episodes.agg(F.count("*").alias("episodes"), F.count_if((F.coalesce("label", F.lit("")) == "fail") | F.col("witnessed")).alias("failures"), *(F.count_if(known == t).alias(f"tier_{t}") for t in TIERS))
    c = clusters.agg(F.count_if(is_proposable()).alias("proposable"))
    waiting = (F.col("applied") == F.lit(False)) & (F.coalesce("gate_decision", F.lit("")) != "skipped") & (F.coalesce("reason", F.lit("")) != "already_applied")
    d = ledger.agg(F.count_if("applied").alias("applied"), F.count_if(waiting).alias("queued"), F.coalesce(F.max("ts"), F.lit("never")).alias("last_run"))
    return e.crossJoin(c).crossJoin(d)  # one row each


def by_group(episodes: DataFrame, name: str) -> DataFrame:
    """``name, episodes, failures, rate``."""
    return episodes.groupBy(name).agg(F.count("*").alias("episodes"), F.count_if(F.col("label") == "fail").alias("failures")).withColumn("rate", F.col("failures") / F.col("episodes")).orderBy(F.desc("failures"), F.desc("episodes"), name)


def timeline(episodes: DataFrame, ts: str = "started") -> DataFrame:
    day = F.date_format(F.try_to_timestamp(ts), "yyyy-MM-dd")
    return episodes.withColumn("date", day).where("date is not null").groupBy("date").agg(F.count("*").alias("episodes"), F.count_if(F.col("label") == "fail").alias("failures")).orderBy("date")


def trend(history: DataFrame) -> DataFrame:
    """``date, ts, episodes, fails, fail_rate, new_episodes`` from snapshots (ts, episodes, fail_labels).

    History has one row for each run, so one ordered window over it is small.
    """
    rows = history.where("ts is not null").select("ts", F.greatest(F.lit(0), F.coalesce("episodes", F.lit(0))).cast("long").alias("episodes"), F.greatest(F.lit(0), F.coalesce("fail_labels", F.lit(0))).cast("long").alias("fails"))
    new = rows.withColumn("new", F.coalesce(F.greatest(F.lit(0), F.col("episodes") - F.lag("episodes").over(W.orderBy("ts"))), F.lit(0)))
    day = new.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.max_by(F.struct("ts", "episodes", "fails"), "ts").alias("x"), F.sum("new").alias("new_episodes"))
    return day.select("date", "x.ts", "x.episodes", "x.fails", F.when(F.col("x.episodes") > 0, F.col("x.fails") / F.col("x.episodes")).otherwise(0.0).alias("fail_rate"), "new_episodes").orderBy("date")


def trend_summary(points: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "episodes", "new_episodes")))
    return points.agg(F.count("*").alias("days"), F.avg("fail_rate").alias("mean_fail_rate"), ordered.alias("x")).select("days", "mean_fail_rate", F.element_at("x", -1)["episodes"].alias("total_episodes"), sparkline(F.transform("x", lambda r: r["new_episodes"].cast("double"))).alias("sparkline"))


def cluster_exemplars(clusters: DataFrame, episodes: DataFrame, per_cluster: int = 2, top: int = 15) -> DataFrame:
    """The leading clusters' first members, in order: request, error and signature, redacted and in 240 characters.

    The error is the failure's text, or that of the last step that isn't ok, or the outcome's reason.
    """
    shown = lambda c: shorten(redact(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    lead = clusters.orderBy(F.desc("priority"), F.desc("size"), "signature", "root").limit(top).select("root", F.posexplode(F.slice("members", 1, per_cluster)).alias("nth", "id"))
    texts = episodes.select("id", shown(F.col("request.text")).alias("request"), shown(error_text_of(episodes)).alias("error"), F.col("failure.signature").alias("signature"))
    return lead.join(texts, "id").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "request", "error", "signature"))).alias("exemplars"))


def render_html(title: str, tables: dict[str, DataFrame], rows: int = 200) -> str:
    """A page with the first rows of small aggregates; every value is escaped."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect()]
        out.append("</table>")
    return "\n".join(out)
