"""Error texts: classes, salient parts, normal form, and harmless exits."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The error classes in order of precedence, each with its patterns
# (Java syntax); group 1, where there is one, is the salient part.
ERROR_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("user_rejected", (r"(?i)The user doesn't want to proceed with this tool use", r"(?i)tool use was rejected")),
    ("tool_unavailable", (r"(?i)No such tool available:", r"(?i)tool exists but is not enabled in this context")),
    ("harness_blocked", (r"(?m)^Blocked:\s+([^\s:]+)",)),
    ("harness_precondition", (r"(?i)File has not been read yet\. Read it first before writing to it\.",)),
    ("stale_reference", (r"(?i)Task\s+\S+\s+is not running\s*\(status:\s*completed\)",)),
    ("wrong_invocation", (r"(?i)is a UI command, not a skill", r"(?i)Ask the user to run /[^\s]+ themselves")),
    ("edit_no_match", (r"(?i)String to replace not found", r"(?i)oldString.*not found")),
    ("module_not_found", (r"(?i)ModuleNotFoundError:\s*No module named\s*['\"]?([\w.\-]+)", r"(?i)Cannot find module\s*['\"]?([\w.\-/@]+)", r"(?i)ImportError")),
    ("command_not_found", (r"(?i)([\w.\-]+):\s*command not found", r"(?i)command not found:\s*([\w.\-]+)", r"(?im):\s*not found\s*$")),
    (
        "file_not_found",
        (
            r"(?i)File does not exist(?:\.|\b)",
            r"(?i)ENOENT(?:[^\r\n]*?['\"](?:[^'\"/\\]*[/\\])*([^'\"/\\]+)['\"])?",
            r"(?i)No such file or directory(?:[^\r\n]*?['\"](?:[^'\"/\\]*[/\\])*([^'\"/\\]+)['\"])?",
        ),
    ),
    ("permission", (r"(?i)EACCES", r"(?i)EPERM", r"(?i)Permission denied")),
    ("test_failure", (r"(?i)(\d+)\s+(?:tests?|specs?)\s+failed", r"(?im)^# fail\s+(\d+)", r"(?i)AssertionError", r"(?i)FAIL\s")),
    ("shell_syntax", (r"(?i)unexpected EOF", r"(?i)unexpected end of file", r"(?i)syntax error near")),
    ("type_error", (r"(?i)TS(\d{4})", r"(?i)TypeError")),
    ("syntax_error", (r"(?i)SyntaxError", r"(?i)ParseError", r"(?i)unexpected token")),
    (
        "runtime_error",
        (r"Traceback \(most recent call last\)[\s\S]*?\b(\w+Error): ", r"Traceback \(most recent call last\)", r"(\w+Error): ", r"(?m)^\s*at .+ \(.+:\d+:\d+\)"),
    ),
    ("usage_error", (r"(?im)^usage:\s*([^\s\[]+)", r"(?im)(?:^|\n)([\w.\-]+): (?:illegal|invalid) option")),
    ("network", (r"(?i)ENOTFOUND", r"(?i)ECONNREFUSED", r"(?i)ETIMEDOUT", r"(?i)getaddrinfo")),
    ("git_conflict", (r"(?i)CONFLICT", r"(?i)merge conflict", r"(?i)non-fast-forward")),
    ("timeout", (r"(?i)timed out", r"(?i)Command timed out")),
    ("lint", (r"(?i)eslint", r"(?i)prettier", r"(?i)lint error")),
)
ERROR_CLASSES = (*(name for name, _ in ERROR_RULES), "other")
#: Classes that say nothing about the agent.
NOT_AGENT_FAULTS = ("user_rejected", "tool_unavailable", "stale_reference")

# What output and commands look like.
ERROR_SHAPED = r"(?i)error|fail|not found|No such file|denied|Traceback|Exception|cannot|refused|invalid"
BENIGN_COMMAND = r"(?i)(?:^|[|;])\s*(?:grep\b|test\b|\[\s|diff\b|command\s+-v\b|which\b|pgrep\b|cmp\b)|\|\||;\s*true(?:\s|$)"
STACK_TRACE = r"(?:^|\n)\s*(?:at\s+\S+|File\s+[\"'][^\"']+[\"'],\s+line\s+\d+)"
DIRECTORY_LINE = r"^total \d+|^[-dlbcps][rwx-]{9}"
BANNER_LINE = r"^(?:---.*|===.*===|shell: .*)$"
PLAIN_LINE = r"^[\w./:@%+~=?,\-]+(?:\s+[\w./:@%+~=?,\-]+)*$"

# Rewrites of the normal form, in order.
NORMAL_FORM: tuple[tuple[str, str], ...] = (
    (r"/Users/[^/\s]+", "~"),
    (r"(?:/[\w.@%+,:=~-]+)+", "<PATH>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"(?i)\b[0-9a-f]{8,}\b", "<HASH>"),
    (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\b", "<TS>"),
    (r"\b\d{3,}\b", "<N>"),
    (r"\s+", " "),
)


def rewritten(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def literal_of(pattern: str) -> str:
    """The longest run of plain characters, in lower case, that every match of ``pattern`` holds outside groups and classes."""
    found, run, depth = [""], "", 0
    for piece in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?[a-z]+\)|\(\?[:=!]|[(){}]|[^\\\[(){}]", pattern):
        plain = piece if len(piece) == 1 and piece not in "(){}.^$|*+?" else piece[1] if len(piece) == 2 and piece[0] == "\\" and not piece[1].isalnum() else ""
        if piece.startswith("(") and not re.fullmatch(r"\(\?[a-z]+\)", piece) or piece == "{":
            depth += 1
        if piece in ("*", "?"):
            run = run[:-1]
        if depth == 0 and plain:
            run += plain.lower()
        else:
            found.append(run)
            run = ""
        if piece in (")", "}"):
            depth -= 1
    return max([*found, run], key=len)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def classify_error(text: Column) -> Column:
    """struct(error_class, salient): the first rule that matches; null text is ``other``.

    A pattern is tried only on texts that hold its literal part in some case.
    """

    def first(x: Column) -> Column:
        body, low = x["body"], x["low"]
        out = None
        for name, patterns in ERROR_RULES:
            for p in patterns:
                group = "(" in p.replace("(?", "").replace(r"\(", "")
                salient = F.lower(F.regexp_extract(body, p, 1)) if group else F.lit("")
                value = F.struct(F.lit(name).alias("error_class"), salient.alias("salient"))
                hit = F.contains(low, F.lit(literal_of(p))) & body.rlike(p)
                out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(F.struct(F.lit("other").alias("error_class"), F.lit("").alias("salient")))

    return bound(F.struct(text.alias("body"), F.lower(text).alias("low")), first)


def is_agent_fault(error_class: Column) -> Column:
    return ~error_class.isin(*NOT_AGENT_FAULTS)


def normalize_error_text(text: Column) -> Column:
    """Homes, paths, ids, hashes, times and numbers replaced, white space collapsed; null is empty."""
    return F.trim(rewritten(F.coalesce(text, F.lit("")), NORMAL_FORM))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def is_benign_nonzero(exit_code: Column, text: Column, command: Column) -> Column:
    """Whether exit code 1 or 2 with this output is an ordinary outcome, not an error."""
    output = _stripped(text)
    lines = F.filter(F.split(output, r"\r?\n"), lambda x: F.length(_stripped(x)) > 0)
    n = F.size(lines)
    plain = F.size(F.filter(lines, lambda x: _stripped(x).rlike(PLAIN_LINE)))
    mostly_plain = (n > 0) & (plain >= 0.8 * n)
    listing = F.exists(lines, lambda x: x.rlike(DIRECTORY_LINE))
    banner = (n > 0) & F.forall(lines, lambda x: _stripped(x).rlike(BANNER_LINE))
    short = mostly_plain & (n <= 40) & ~output.rlike(STACK_TRACE)
    by_command = F.coalesce(command.rlike(BENIGN_COMMAND), F.lit(False)) & (output.rlike("===.*===") | ((plain > 0) & mostly_plain))
    return F.coalesce(exit_code.isin(1, 2) & text.isNotNull() & ~output.rlike(ERROR_SHAPED) & ((output == "") | listing | banner | short | by_command), F.lit(False))
