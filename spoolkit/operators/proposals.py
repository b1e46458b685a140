"""Answers to briefs as a table: what is wrong with each, and the patches of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolkit.functions.text import changed_lines, content_id
from spoolkit.operators.planning import CRITERION, gate
from spoolkit.storage import stored

_FENCED = r"(?i)```json\s*\n([\s\S]*?)\n```"
#: What a proposal must say, in the order in which it is asked for.
SAID = ("summary", "layer", "target", "rationale", "expectedEffect")
#: A key in JSON without spaces: a string before a colon.
_KEY = r'"((?:[^"\\]|\\.)*+)":'


def checked(answers: DataFrame) -> DataFrame:
    """``answers`` with ``summary, rationale, before, after`` and ``errors``: (path, code) of all that is wrong, in a fixed order.

    ``answers`` has ``answer`` and its brief's ``layer, target, target_text,
    max_lines`` (null: no limit) and ``creates_file`` (null: false).  An answer is one
    fenced JSON object and nothing else; its edit's anchor occurs once in the
    target, is empty for a new file and differs from what replaces it; changed
    lines keep to the limit; no key at any depth names a criterion of success.
    A null answer, or text around the block, is ``format`` alone; a block that is
    no JSON ``invalid_json``, and JSON that is no object ``type``.  Repeated rows
    are answers of their own, other columns stay.
    """
    blocks = F.regexp_extract_all("answer", F.lit(_FENCED), F.lit(1))
    around = F.regexp_replace("answer", _FENCED, "")
    rows = answers.withColumn("_block", F.when((F.size(blocks) == 1) & around.rlike(r"^\s*\z"), F.get(blocks, F.lit(0)))).withColumn("_json", F.try_parse_json("_block"))
    rows = stored(rows, "answers")  # parsed once: all fields below come from it
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_json", path, "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get("_json", path, "string"))
    rows = rows.select("*", *(text(f"$.{k}").alias(f"_{k}") for k in SAID), text("$.edit.before").alias("before"), text("$.edit.after").alias("after"), F.coalesce(kind("$.edit").startswith("OBJECT"), F.lit(False)).alias("_edit"), F.regexp_extract_all(F.to_json("_json"), F.lit(_KEY), F.lit(1)).alias("_keys"))
    rows = stored(rows, "answers")
    new, before, after = F.coalesce("creates_file", F.lit(False)), F.col("before"), F.col("after")
    anchored = F.coalesce(before != "", F.lit(False))
    target = F.coalesce("target_text", F.lit(""))
    times = F.when(anchored, (F.length(target) - F.length(F.replace(target, before, F.lit("")))) / F.length(before))
    wrong = [
        *((F.coalesce(F.col(f"_{k}"), F.lit("")) == "", k, "required") for k in SAID),
        (~F.col("_edit"), "edit", "required"),
        (before.isNull() | (~new & (before == "")), "edit.before", "required"),
        (F.coalesce(after, F.lit("")) == "", "edit.after", "required"),
        (new & F.coalesce(before != "", F.lit(True)), "edit.before", "new_file_anchor"),
        (F.exists("_keys", lambda k: k.rlike("(?i)" + CRITERION.pattern)), "", "criterion_supplied"),
        *((~F.col(f"_{k}").eqNullSafe(F.col(k)), k, "mismatch") for k in ("layer", "target")),
        (anchored & (times == 0), "edit.before", "anchor_not_found"),
        (anchored & (times > 1), "edit.before", "anchor_ambiguous"),
        (before == after, "edit.after", "unchanged"),
        (changed_lines(before, after) > F.col("max_lines"), "edit", "line_budget_exceeded"),
    ]
    error = lambda path, code: F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))
    every = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), error(p, k)) for c, p, k in wrong)))
    is_object = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    errors = F.when(F.col("_block").isNull(), F.array(error("", "format"))).when(F.col("_json").isNull(), F.array(error("", "invalid_json"))).when(~is_object, F.array(error("", "type"))).otherwise(every)
    return rows.withColumn("errors", errors).select(*answers.columns, F.col("_summary").alias("summary"), F.col("_rationale").alias("rationale"), "before", "after", "errors")


def patches(proposals: DataFrame) -> DataFrame:
    """The ``checked`` rows without errors as patches: all their columns and ``patch_id, files_changed, lines_changed, requires, decision``.

    They need ``cluster_id`` and what the route and the evidence ask for
    (``route_requires, contract_requires``: auto or human-gate).  The stricter of
    both holds, a new file always needs a human; ``decision`` is the gate's.
    """
    human = F.coalesce("creates_file", F.lit(False)) | F.coalesce(F.col("route_requires") == "human-gate", F.lit(False)) | F.coalesce(F.col("contract_requires") == "human-gate", F.lit(False))
    files = (F.col("before") != F.col("after")).cast("int")
    named = {"after": F.col("after"), "before": F.col("before"), "clusterId": F.coalesce("cluster_id", F.lit("")), "layer": F.col("layer"), "target": F.col("target")}
    made = stored(proposals.where(F.size("errors") == 0), "proposals").withColumn("patch_id", content_id("sp", named)).withColumn("files_changed", files).withColumn("lines_changed", changed_lines(F.col("before"), F.col("after"))).withColumn("requires", F.when(human, "human-gate").otherwise("auto"))
    return made.withColumn("decision", gate(F.col("target"), F.lit(1), F.col("files_changed"), F.col("lines_changed"), F.col("requires"), F.col("layer")))


def exemplars(clusters: DataFrame, episodes: DataFrame, most: int = 3) -> DataFrame:
    """``root, exemplars`` for briefs: of each cluster's first members the request, the command and error of the first step that isn't ok, and what the step after it said.

    ``clusters``: root, members (in order); ``episodes``: id, request.text, steps
    (ok, command, error_text), failure, outcome.  Without a failing step the
    command is the witness's and the rest the failure's text and the outcome's
    reason, where they are recorded; what is missing is empty.
    """
    def there(column: str, *path: str) -> Column:
        kind, name = episodes.schema[column].dataType, column
        for p in path:
            if p not in kind.fieldNames():
                return F.lit(None).cast("string")
            kind, name = kind[p].dataType, f"{name}.{p}"
        return F.col(name)

    steps = F.transform("steps", lambda s, i: F.struct(i.alias("at"), (s["ok"] == F.lit(False)).alias("bad"), s["command"].alias("command"), s["error_text"].alias("error_text")))
    first = F.get(F.filter(steps, lambda s: s["bad"]), F.lit(0))
    after = F.get(steps, first["at"] + 1)
    words = lambda *cs: F.coalesce(*cs, F.lit(""))
    texts = episodes.select(
        "id", words(F.col("request.text")).alias("request"), words(first["command"], there("failure", "witness", "cmd")).alias("cmd"), words(first["error_text"], there("failure", "error_text")).alias("error"), words(after["error_text"], there("outcome", "reason")).alias("next"),
    )
    lead = clusters.select("root", F.posexplode(F.slice("members", 1, most)).alias("nth", "id"))
    return lead.join(texts, "id").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("nth", "request", "cmd", "error", "next"))).alias("exemplars"))
