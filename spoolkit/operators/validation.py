"""All schema errors of a document as an array, none of them fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolkit.operators.labels import LABELS, TIERS

# The fields of an episode and of its outcome.
ROOT_FIELDS = ("id", "schema", "session_id", "prompt_id", "agent_id", "project", "cwd", "git_branch", "started", "ended", "duration_ms", "is_sidechain", "request", "steps", "artifacts", "signals", "outcome", "failure", "meta")
OUTCOME_FIELDS = ("label", "tier", "confidence", "reason", "source", "method", "evidence")
REQUIRED_TEXTS = ("id", "schema", "session_id", "prompt_id", "agent_id", "cwd", "started")


def episode_errors(document: Column) -> Column:
    """array of struct(path, code, message) of an episode as VARIANT.

    Codes: not_object, required, type, empty, format, enum, unknown_field.
    """
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    at = lambda p: F.try_variant_get(document, f"$.{p}", "variant")
    error = lambda path, code, said: F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(said).alias("message"))
    checks = []

    def needed(path: str, shape: str, noun: str) -> Column:
        found = kind(at(path))
        checks.append(F.when(found == "VOID", error(path, "required", f"`{path}` is required")).when(~found.startswith(shape), error(path, "type", f"`{path}` must be {noun}")))
        return F.when(found.startswith(shape), at(path))

    for path in REQUIRED_TEXTS:
        text = F.try_variant_get(needed(path, "STRING", "a string"), "$", "string")
        checks.append(F.when(F.trim(text) == "", error(path, "empty", f"`{path}` must not be empty")))
        if path == "started":
            checks.append(F.when((F.trim(text) != "") & F.try_to_timestamp(text).isNull(), error(path, "format", "`started` must be an ISO-8601 timestamp")))
    needed("steps", "ARRAY", "an array")
    needed("signals", "OBJECT", "an object")
    is_outcome = needed("outcome", "OBJECT", "an object").isNotNull()
    for name, allowed in (("label", LABELS), ("tier", TIERS)):
        path = f"outcome.{name}"
        n = len(checks)
        text = F.try_variant_get(needed(path, "STRING", "a string"), "$", "string")
        checks[n] = F.when(is_outcome, checks[n])
        checks.append(F.when(is_outcome & ~text.isin(*allowed), error(path, "enum", f"`{path}` must be one of: {', '.join(allowed)}")))

    def unknown(v: Column, known: tuple[str, ...], prefix: str) -> Column:
        path = lambda k: F.concat(F.lit(prefix), k)
        return F.transform(F.coalesce(unknown_fields(v, list(known)), F.array().cast("array<string>")), lambda k: F.struct(path(k).alias("path"), F.lit("unknown_field").alias("code"), F.concat(F.lit("unknown field `"), path(k), F.lit("`")).alias("message")))

    found = F.concat(F.array_compact(F.array(*checks)), F.when(is_outcome, unknown(at("outcome"), OUTCOME_FIELDS, "outcome.")).otherwise(F.array().cast("array<struct<path:string,code:string,message:string>>")), unknown(document, ROOT_FIELDS, ""))
    return F.when(kind(document).startswith("OBJECT"), found).otherwise(F.array(error("", "not_object", "episode must be a plain object")))


def with_episode_errors(rows: DataFrame, document: str) -> DataFrame:
    """``rows`` with ``errors`` (``episode_errors``) of a VARIANT column.

    The checks name the document many times.  A stage of arrays comes between it
    and them, which the optimizer doesn't merge with either, so what makes the
    document runs once for each row.
    """
    held = rows.withColumn("_held", F.explode(F.array(document)))
    return held.withColumn("errors", episode_errors(F.col("_held"))).drop("_held")


def unknown_fields(document: Column, known: list[str]) -> Column:
    """Keys of a VARIANT object outside ``known``."""
    return F.array_except(F.map_keys(F.try_variant_get(document, "$", "map<string,variant>")), F.array(*map(F.lit, known)))
