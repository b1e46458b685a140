"""Shell commands: segments, tokens, stable heads, and error signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoolkit.functions.errors import classify_error, rewritten

#: A stretch of a command without a separator outside quotes.
SEGMENT = r"""(?:"(?:\\[\s\S]|[^"\\])*(?:"|\z)|'[^']*(?:'|\z)|(?<!&)&(?!&)|[^;|&"'])+"""
TOKEN = r"""("(?:\\.|[^"\\])*"|'[^']*'|[^\s]+)"""
#: Assignments before a command, and redirections in it.
ASSIGNMENTS = r"^(?:\s*[A-Z_][A-Z0-9_]*=\S+\s+)+"
REDIRECTIONS = r"(?:\d+)?(?:>>?|<<?|>&)\s*(?:&\d+|[^\s;&|]+)|&>\s*[^\s;&|]+"
#: Rewrites of a head, in order.
HEAD_FORM = (
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"~/(?:[^\s]+)?", "<PATH>"),
    (r"(?:/[\w.@%+,:=~-]+)+", "<PATH>"),
    (r"(?i)\b[0-9a-f]{8,}\b", "<HASH>"),
    (r"\b\d+\b", "<N>"),
)


def command_segments(command: Column) -> Column:
    """The parts of a command between ``;``, ``|``, ``&&`` and ``||`` outside quotes, trimmed, without empty ones."""
    parts = F.regexp_extract_all(command, F.lit(SEGMENT), F.lit(0))
    return F.filter(F.transform(parts, F.trim), lambda x: F.length(x) > 0)


def normalize_command(command: Column) -> Column:
    """The first segment that isn't ``cd``, without assignments, sudo and redirections; null is empty."""
    bare = F.regexp_replace(command, ASSIGNMENTS, "")
    bare = F.regexp_replace(bare, r"^\s*sudo(?:\s+|\z)", "")
    segments = command_segments(F.regexp_replace(bare, REDIRECTIONS, ""))
    useful = F.filter(segments, lambda x: ~x.rlike(r"^cd(?:\s|\z)"))
    chosen = F.coalesce(F.try_element_at(useful, F.lit(1)), F.when(F.size(segments) > 0, "cd"), F.lit(""))
    return F.coalesce(F.trim(F.regexp_replace(chosen, r";+\s*\z", "")), F.lit(""))


def shell_tokens(command: Column) -> Column:
    """Tokens, those in quotes without them."""
    return F.transform(F.regexp_extract_all(command, F.lit(TOKEN), F.lit(1)), lambda x: F.regexp_replace(x, r"""^(['"])([\s\S]*)\1\z""", "$2"))


def basename(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(F.regexp_replace(path, r"[\\/]+\z", ""), r"[\\/]"), -1), F.lit(""))


def bash_head(command: Column) -> Column:
    """The first two tokens that aren't flags; ``-c`` also takes the next token away."""
    start = F.struct(F.array().cast("array<string>").alias("argv"), F.lit(False).alias("skip"))

    def step(acc: Column, token: Column) -> Column:
        full = F.size(acc["argv"]) >= 2
        flag = token.startswith("-")
        add = ~full & ~acc["skip"] & ~flag
        return F.struct(F.when(add, F.concat(acc["argv"], F.array(token))).otherwise(acc["argv"]).alias("argv"), (~acc["skip"] & (token == "-c")).alias("skip"))

    argv = F.aggregate(shell_tokens(normalize_command(command)), start, step, lambda acc: acc["argv"])
    return rewritten(F.array_join(argv, " "), HEAD_FORM)


def cmd_head(tool: Column, command: Column, path: Column) -> Column:
    """What a step is about: a shell command's head, a file's name, or the tool."""
    name = F.lower(tool)
    return F.coalesce(F.when(name == "bash", F.coalesce(bash_head(command), F.lit(""))).when(name.isin("edit", "write", "read"), basename(path)).otherwise(name), F.lit(""))


def error_signature(tool: Column, head: Column, text: Column | None = None, found: Column | None = None) -> Column:
    """tool:class:head:salient, from the text or from its class as already ``found``."""
    found = classify_error(F.coalesce(text, F.lit(""))) if found is None else found
    return F.concat_ws(":", F.coalesce(F.lower(tool), F.lit("")), found["error_class"], head, found["salient"])


def parse_signature(signature: Column) -> Column:
    """The four parts; further colons belong to the head."""
    parts = F.split(F.coalesce(signature, F.lit("")), ":")
    n = F.size(parts)
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    long = n > 4
    return F.struct(
        at(1).alias("tool"),
        at(2).alias("error_class"),
        F.when(long, F.array_join(F.slice(parts, F.lit(3), F.greatest(n - 3, F.lit(0))), ":")).otherwise(at(3)).alias("cmd_head"),
        F.when(long, F.element_at(parts, -1)).otherwise(at(4)).alias("salient"),
    )
