"""From ranked clusters to gated, recorded decisions.

Plans are prefix sums over ranges of ranks; ledgers are in ``operators.ledger``.
What concerns a single answer or patch (its attestation, the text of a brief) is a
small function, and says so.
"""

from __future__ import annotations

import hashlib
import json
import os.path
import posixpath
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolkit.functions.text import REPORT_REDACTIONS, slug
from spoolkit.operators.clusters import is_proposable, is_reviewable
from spoolkit.operators.scan import prefix_sums
from spoolkit.storage import stored

LINE_BUDGET = 20
# Where a class of errors is dealt with, and who decides.
CONTEXT = ("module_not_found", "command_not_found", "file_not_found")
SKILL = ("edit_no_match", "test_failure", "git_conflict", "runtime_error", "shell_syntax", "usage_error")
SCAFFOLDING = ("permission", "timeout", "network", "harness_precondition")
NO_ROUTE = ("user_rejected", "tool_unavailable", "stale_reference", "weights")
#: Files that no patch may touch.
PROTECTED = r"(?:^|/)(?:\.env|[^/]*\.key|id_[^/]*|settings\.json|package\.json|credentials[^/]*)\z|/\.ssh/|/\.git/"
#: Fixed value: keys by which an answer would judge itself.
CRITERION = re.compile(r"(^|_)(?:eval(?:_contract)?|command|test|check)(_|$)", re.IGNORECASE)


def within_budget(spent: Column, lines: Column) -> Column:
    """Whether ``lines`` more still fit the budget of lines; false for null, negative and non-finite numbers."""
    good = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0)
    return F.coalesce(good(spent) & good(lines) & (spent + lines <= LINE_BUDGET), F.lit(False))


def route(error_class: Column, tool: Column) -> Column:
    """struct(layer, surface, requires); a null layer where nothing may be patched."""
    name = F.when(F.lower(F.trim(tool)).isin("bash", "shell", "mixed", "unknown", ""), "general").otherwise(F.coalesce(F.nullif(slug(tool), F.lit("")), F.lit("general")))
    pack = lambda layer, surface, requires: F.struct(F.lit(layer).alias("layer"), surface.alias("surface"), F.lit(requires).alias("requires"))
    nothing = F.struct(F.lit(None).cast("string").alias("layer"), F.lit(None).cast("string").alias("surface"), F.lit(None).cast("string").alias("requires"))
    return (
        F.when(error_class.isin(*NO_ROUTE), nothing)
        .when(error_class.isin(*CONTEXT), pack("context", F.lit("CLAUDE.md"), "auto"))
        .when(error_class.isin(*SKILL), pack("skill", F.concat(F.lit(".claude/skills/"), name, F.lit("/SKILL.md")), "auto"))
        .when(error_class.isin(*SCAFFOLDING), pack("scaffolding", F.lit(".claude/settings.json"), "human-gate"))
        .otherwise(pack("context", F.lit("CLAUDE.md"), "human-gate"))
    )


def eval_contract(witnesses: Column, size: Column, replayable: bool = False) -> Column:
    """struct(strategy, strength, requires): the strongest evidence that there is.

    A cluster's witnesses are all replayable; of others, with the flag in a field
    ``replayable``, only those that are count.
    """
    pack = lambda s, t, r: F.struct(F.lit(s).alias("strategy"), F.lit(t).alias("strength"), F.lit(r).alias("requires"))
    usable = F.exists(witnesses, lambda w: (F.length(w["cmd"]) > 0) & (w["replayable"] if replayable else F.lit(True)))
    return F.when(usable, pack("witness_replay", "causal", "auto")).when(size > 0, pack("recurrence_probe", "behavioral", "human-gate")).otherwise(pack("regression_only", "regression_only", "human-gate"))


def plan(ranked: DataFrame, lines: str = "lines_added", most: int = 1 << 30, spent: int = 0, review: bool = False) -> DataFrame:
    """``ranked`` (in ``rank`` order, without ties) with ``action`` or ``reason``.

    Context patches share a budget of lines; once one doesn't fit, none after it
    does.  The scan ends with the ``most``-th action.  Both cut-offs are prefix
    sums over ranges of ranks, so the plan may be of any length.
    """
    routed = ranked.withColumn("route", route(F.col("error_class"), F.col("tool")))
    layer = F.col("route.layer")
    reason = (
        F.when(layer.isNull(), "layer_gated").when(F.lit(review) & is_reviewable(), F.lit(None)).when(~layer.isin("context", "skill"), "layer_gated")
        .when((F.size("witnesses") == 0) & is_reviewable(), "no_causal_witness").when(~is_proposable(), "not_proposable")
    )
    action = F.when(reason.isNull(), F.when(F.lit(review) & is_reviewable(), "review").otherwise("auto_apply"))
    priced = F.coalesce((F.col("action") == "auto_apply") & (F.col("layer") == "context"), F.lit(False))
    cost = F.when(priced, F.greatest(F.lit(0), F.coalesce(F.col(lines), F.lit(0)))).otherwise(0)
    rows = routed.withColumn("layer", layer).withColumn("action", action).withColumn("cost", cost.cast("long"))
    rows = rows.select("rank", "root", "signature", "layer", F.col("route.surface").alias("target"), "action", reason.alias("reason"), "cost")
    summed = stored(prefix_sums(rows, ["cost"], "rank").withColumnRenamed("n_before", "place"), "plan")
    first = summed.where(priced & (F.col("cost_before") + F.col("cost") + spent > LINE_BUDGET)).agg(F.min("place").alias("cut"))  # one row
    over = priced & F.coalesce(F.col("place") >= F.col("cut"), F.lit(False))
    settled = summed.crossJoin(F.broadcast(first)).withColumn("over", over).withColumn("acts", (F.col("action").isNotNull() & ~F.col("over")).cast("long"))
    counted = prefix_sums(settled, ["acts"], "rank").where(F.col("acts_before") < most)
    return counted.select(
        F.col("rank").cast("int").alias("rank"), "root", "signature", "layer", "target", F.when(F.col("acts") == 1, F.col("action")).alias("action"),
        F.when(F.col("over"), "budget_exceeded").otherwise(F.col("reason")).alias("reason"), F.col("cost").cast("int").alias("cost"),
    )


def gate(target: Column, surfaces: Column, files: Column, lines: Column, requires: Column, layer: Column) -> Column:
    """block, approve or human-gate."""
    path = F.lower(F.replace(F.coalesce(target, F.lit("")), F.lit("\\"), F.lit("/")))
    large = (surfaces > 1) | (files > 1) | (lines > LINE_BUDGET)
    return F.when(path.rlike(PROTECTED) | F.coalesce(large, F.lit(False)), "block").when((requires == "auto") & layer.isin("context", "skill"), "approve").otherwise("human-gate")


def not_applied(clusters: DataFrame, ledger: DataFrame) -> DataFrame:
    """The clusters whose signature has no applied entry in the ledger."""
    return clusters.join(ledger.where("applied").select("signature"), "signature", "left_anti")


def attestation(patch: dict, verdict: str, signature: str, strategy: str, checks: list[str], members: list[str], parents: list[str] | None = None, judged: bool = False) -> dict:
    """What was measured about a patch, with the hash of its description."""
    described = {"kind": "patch", "layer": patch.get("layer", ""), "patch_id": patch.get("patch_id", ""), "signature": signature, "target": patch.get("target", "")}
    passed = {"passed": verdict == "helped"} | ({} if strategy == "witness_replay" else {"note": "aggregate"})
    return {
        "artifact": {"hash": hashlib.sha256(canonical(described).encode()).hexdigest()},
        "evaluation": {"score": {"helped": 1.0, "regressed": 0.0}.get(verdict, 0.5), "method": "judge" if judged else "test", "checks": [{"name": c} | passed for c in checks if c.strip()], "evaluator": strategy},
        "parents": [p for p in parents or [] if re.fullmatch("[A-Fa-f0-9]{64}", p)], "derived_from": members,
    }


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def chained(decisions: list[dict], entries: int = 0, last: str | None = None) -> list[dict]:
    """The rows of a single run's ledger, each with its number and the hash of the row before, null in the first.  (``ledger.appended`` chains tables.)"""
    out = []
    for d in decisions:
        row = d | {"seq": entries, "prev": last}
        last = hashlib.sha256(canonical(row).encode()).hexdigest()
        out.append(row | {"hash": last})
        entries += 1
    return out


def lines_changed(before: str, after: str) -> int:
    """Lines left on both sides once a common beginning and end are taken off."""
    a, b = before.split("\n"), after.split("\n")
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
    return len(a) + len(b) - 2 * (head + tail)


def _keys(value: object) -> set[str]:
    """All keys of a JSON value, at any depth."""
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    return (set(value) if isinstance(value, dict) else set()).union(*map(_keys, inner))


def parse_proposal(answer: str | None, brief: dict) -> tuple[dict | None, list[tuple[str, str]]]:
    """(proposal, errors as (path, code)): an answer that is one fenced JSON object and nothing else, and fits its brief.

    ``brief``: layer, target, target_text, max_lines, creates_file.  The edit's
    anchor must occur once in the target, be empty for a new file, and differ
    from what replaces it; changed lines keep to the budget; no key may judge
    the proposal.
    """
    if not isinstance(answer, str):
        return None, [("", "format")]
    blocks = list(re.finditer(r"```json\s*\n([\s\S]*?)\n```", answer, re.IGNORECASE))
    if len(blocks) != 1 or (answer[: blocks[0].start()] + answer[blocks[0].end() :]).strip():
        return None, [("", "format")]
    try:
        p = json.loads(blocks[0][1])
    except ValueError:
        return None, [("", "invalid_json")]
    if not isinstance(p, dict):
        return None, [("", "type")]
    full = lambda v: isinstance(v, str) and v != ""
    found = [(k, "required") for k in ("summary", "layer", "target", "rationale", "expectedEffect") if not full(p.get(k))]
    edit, new_file = p.get("edit"), bool(brief.get("creates_file"))
    if not isinstance(edit, dict):
        found.append(("edit", "required"))
        edit = {}
    before, after = edit.get("before"), edit.get("after")
    if not isinstance(before, str) or (before == "" and not new_file):
        found.append(("edit.before", "required"))
    if not full(after):
        found.append(("edit.after", "required"))
    if new_file and before != "":
        found.append(("edit.before", "new_file_anchor"))
    if any(CRITERION.search(k) for k in _keys(p)):
        found.append(("", "criterion_supplied"))
    found += [(k, "mismatch") for k in ("layer", "target") if p.get(k) != brief.get(k)]
    if full(before) and (n := (brief.get("target_text") or "").count(before)) != 1:
        found.append(("edit.before", "anchor_ambiguous" if n else "anchor_not_found"))
    if isinstance(before, str) and isinstance(after, str):
        if before == after:
            found.append(("edit.after", "unchanged"))
        if brief.get("max_lines") is not None and lines_changed(before, after) > brief["max_lines"]:
            found.append(("edit", "line_budget_exceeded"))
    return (None if found else p), found


def resolve_target(surface: str, dominant_cwd: str | None, home: str = "", base: str = "/") -> str:
    """Where a surface lies: below the cluster's usual folder, or else below the home folder (its notes in ``.claude``)."""
    if dominant_cwd:
        root = posixpath.join(base, dominant_cwd)
    else:
        root = posixpath.join(base, home, ".claude" if surface == "CLAUDE.md" else "")
    return posixpath.normpath(posixpath.join(root, surface))


def self_patch(proposal: dict, contract: dict, cluster: dict, requires: str, surfaces: list[str], meta: dict | None = None) -> dict:
    """A proposal as a patch with its blast radius and the stricter of two gates; new files always need a human."""
    meta = meta or {}
    before, after = proposal["edit"]["before"], proposal["edit"]["after"]
    identity = {"after": after, "before": before, "clusterId": cluster.get("id", ""), "layer": proposal["layer"], "target": proposal["target"]}
    human = bool(meta.get("creates_file")) or "human-gate" in (requires, contract.get("requires"))
    evidence = {"cluster_id": cluster.get("id", ""), "strategy": contract.get("strategy", ""), "strength": contract.get("strength", ""), "recurrence": cluster.get("recurrence_rate"), "members": list(cluster.get("members") or []), "checks": list(contract.get("checks") or [])}
    return {
        "id": meta.get("id") or "sp_sha256:" + hashlib.sha256(canonical(identity).encode()).hexdigest()[:16], "author": meta.get("author") or "spoolkit", "layer": proposal["layer"], "target": proposal["target"],
        "diff": {"format": "before_after", "before": before, "after": after}, "rationale": proposal.get("rationale", ""), "eval_contract": contract.get("eval_contract"),
        "blast_radius": {"surfaces": list(surfaces), "files_changed": int(before != after), "lines_changed": lines_changed(before, after)},
        "requires": "human-gate" if human else "auto", "meta": meta | {"evidence": evidence},
    }


def redacted(value: object) -> object:
    """Every string of a JSON value with what reports cut out cut out."""
    if isinstance(value, str):
        for pattern, to in REPORT_REDACTIONS:
            value = re.sub(pattern, to, value)
        return value
    if isinstance(value, list):
        return [redacted(v) for v in value]
    return {k: redacted(v) for k, v in value.items()} if isinstance(value, dict) else value


def brief(cluster: dict, exemplars: list[dict], layer: str, target: str, target_text: str = "", must_not_touch: tuple[str, ...] = (), creates_file: bool = False) -> dict:
    """What a patch is asked for with: the failure, three exemplars, the target as it is (4,000 characters) and the constraints, all but the target redacted."""
    size = cluster.get("size") or len(exemplars)
    replayable = [w for w in cluster.get("witnesses") or [] if w.get("replayable", True)]
    asked = {
        "cluster_id": str(cluster.get("id", "")), "signature": str(cluster.get("signature", "")), "mode": str(cluster.get("error_class", "other")), "occurrences": size,
        "terminal_rate": (cluster.get("terminal") or 0) / size if size else 0, "projects": sorted({e["project"] for e in exemplars if isinstance(e.get("project"), str)}),
        "exemplars": [{k: e.get(k) or "" for k in ("request", "cmd", "error", "next")} for e in exemplars[:3]], "layer": layer, "target_text": target_text[:4000],
        "constraints": {"max_lines": LINE_BUDGET, "must_not_touch": list(must_not_touch), "style": "imperative, specific, no hedging"}, "witness": replayable[0] if replayable else None,
    }
    return redacted(asked) | {"target": target, "creates_file": creates_file}


def merge_cursors(a: DataFrame, b: DataFrame) -> DataFrame:
    """``file, position``: how far each file has been read, of two runs the farther; negative and non-finite positions count as 0."""
    every = a.select("file", "position").unionByName(b.select("file", "position")).where("file <> ''")
    sound = F.when(F.isnan(F.col("position").cast("double")) | (F.abs(F.col("position").cast("double")) == float("inf")), 0).otherwise(F.floor("position"))
    return every.groupBy("file").agg(F.greatest(F.lit(0), F.max(F.coalesce(sound, F.lit(0)))).cast("long").alias("position"))
