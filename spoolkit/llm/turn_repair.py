r"""Repair of conversations with the fewest edits.

A conversation is right when its role initials read ``(s?(ua)+)?``: perhaps a
system row, then user and assistant in turn, or nothing.  A repair keeps (0),
re-roles to user or assistant (1) or deletes (2) each row, and inserts empty user
or assistant rows (5) anywhere.  Blank rows and duplicates must go; a truncated
row that stays costs 5 more.  Repairs are paths through a lattice of nodes (rows
done, grammar state) that is never laid out: Dijkstra's algorithm makes the
neighbours of a node when it is popped, by the key (cost, audit), where the audit
is the edits' initials; the first accepting end node popped is the cheapest repair,
of several the one of the least audit.  An audit's letters and the rows determine
its cost, so no audit of equal cost begins another, and the order of two audits
never changes when both grow by the same letters.

Rows are sorted in ranges of (conversation, turn, role, text), and a task streams
through its range with at most ``PIECE`` rows in memory.  A conversation that lies
within one range and one piece is repaired at once.  Any other is cut into pieces:
for each piece the search runs from each grammar state to each, and tables of
pieces are joined 64 at a time, level by level, so a conversation of any length is
never one task's work; then each level hands down which part of the audit its pieces
take.  Only the hash of the repaired text, which is defined over the whole text in
order, reads a conversation's pieces one after the other, as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolkit.llm.batches import bounded_batches
from spoolkit.llm.merkle_manifest import CRC_SQL
from spoolkit.llm.ordering import ranked
from spoolkit.storage import stored

# What edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: From each grammar state (start, after a system, user or assistant row) the state that an initial leads to.
NEXT = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ACCEPTING = ("0", "a")
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a piece, and pieces that are joined at a time.
PIECE, FAN = 64, 64

_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def fault_of(text: str, seen: bool) -> str:
    """``blank``, ``duplicate``, ``truncated`` or nothing: the first that holds."""
    if not _VISIBLE.search(text):
        return "blank"
    if seen:
        return "duplicate"
    return "" if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else "truncated"


def paths(rows: list[tuple[str, str]], start: str, ends: tuple[str, ...], every: bool = False) -> dict[str, tuple[int, str]]:
    """End state to (cost, audit) of the cheapest edits of ``rows`` (role, fault) from ``start``: of the best of ``ends``, or of each of them."""
    heap = [(0, "", 0, start)]
    done: set[tuple[int, str]] = set()
    found: dict[str, tuple[int, str]] = {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        moves = NEXT[state]
        steps = [(INSERT, "I", i, moves[x]) for x in ROLES if x in moves]
        if i < len(rows):
            role, fault = rows[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                if role[:1] in moves:
                    steps.append((KEEP + more, "K", i + 1, moves[role[:1]]))
                steps += [(REROLE + more, "R", i + 1, moves[x]) for x in ROLES if x in moves]
        for price, letter, j, then in steps:
            if (j, then) not in done:
                heapq.heappush(heap, (cost + price, audit + letter, j, then))
    return found


def repaired(rows: list[tuple[str, str]], audit: str, state: str) -> list[str]:
    """``role:text`` of what ``audit`` makes of ``rows`` (role, text) from ``state`` on."""
    out, at = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter != "K":
            role = next(ROLES[x] for x in ROLES if x in NEXT[state])
        state = NEXT[state][role[:1]]
        out.append(f"{role}:{text}")
    return out


def illegal_pairs(roles: list[str]) -> int:
    return sum(x[:1] + y[:1] not in ("su", "ua", "au") for x, y in zip(roles, roles[1:], strict=False))


def state_after(emitted: int, system: bool) -> str:
    """The grammar state after so many rows, the first of them a system row or not."""
    if not emitted:
        return "0"
    if system:
        emitted -= 1
        if not emitted:
            return "s"
    return "u" if emitted % 2 else "a"


def _first_is_system(rows: list[tuple[str, str]], audit: str) -> bool | None:
    """Whether the first row that ``audit`` leaves is a system row; None without any."""
    at = 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        return letter == "K" and rows[at][0][:1] == "s"
    return None


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "conv_id long, piece long, nth int, turn long, role string, text string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _whole(conv, rows: list[tuple]) -> tuple:
    """The digest of a conversation given as (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = min(paths([(r, f) for (_, r, _), f in zip(rows, faults, strict=True)], "0", ACCEPTING).values())
    text = "\n".join(repaired([(r, t) for _, r, t in rows], audit, "0"))
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal_pairs([r for _, r, _ in rows]), cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, conv_id, turn, role, text, real) to digests of whole conversations and rows of pieces."""
    schema = _schema(f"kind int, {_DIGEST}, piece long, nth int, turn long, role string, text string")
    out: list[tuple] = []
    size = 0
    piece = 0
    first = True
    held: list[tuple] = []
    conv, part, cut = object(), 0, False

    def settle(last: bool) -> None:
        """The rows held are a whole conversation, or (cut, or at an end of the range) a piece."""
        nonlocal piece, held, size
        if cut or first or last:
            here = (part << 33) + piece
            piece += 1
            if not held:
                out.append((1, conv, *[None] * 8, here, -1, None, None, None))
            for i, (turn, role, text) in enumerate(held):
                out.append((1, conv, *[None] * 8, here, i, turn, role, text))
                size += len(text)
        elif held:
            out.append((0, *_whole(conv, held), *[None] * 5))
        else:
            out.append((0, conv, 0, 0, 0, 0, 0, 0, "", _EMPTY, *[None] * 5))
        held = []

    began = False
    for batch in batches:
        for p, c, turn, role, text, real in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not began or c != conv:
                if began:
                    settle(False)
                    first = False
                conv, part, cut, began = c, p, False, True
            if real:
                if len(held) == PIECE:
                    cut = True
                    settle(False)
                held.append((turn, role, text))
        if len(out) > 2_000 or size > 4_000_000:
            yield _batch(out, schema)
            out, size = [], 0
    if began:
        settle(True)
    if out:
        yield _batch(out, schema)


def damaged(messages: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, real``, damaged by the CRC-32 of ``conv_id:turn``; a row that is dropped stays as one that isn't real; a null counts as a space."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"), hit.alias("hit"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select("conv_id", "turn", F.when(F.col("hit") != 0, F.col("role")).alias("role"), F.when(F.col("hit") != 0, F.col("text")).alias("text"), (F.col("hit") != 0).alias("real"))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of pieces to ``conv_id, piece, rows, blank, duplicate, truncated, illegal, head, tail, paths``."""
    schema = _schema("conv_id long, piece long, rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, paths string")

    def table(key: tuple, rows: list[tuple[str, str]]) -> tuple:
        found = {}
        for start in NEXT:
            for end, (cost, audit) in paths(rows, start, tuple(NEXT), every=True).items():
                found[start + end] = (cost, audit, _first_is_system(rows, audit) if start == "0" else None)
        faults = [f for _, f in rows]
        roles = [r for r, _ in rows]
        return (*key, len(rows), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal_pairs(roles), roles[0][:1] if rows else None, roles[-1][:1] if rows else None, json.dumps(found))

    key, rows = None, []
    for batch in batches:
        out = []
        for conv, piece, nth, role, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (conv, piece) != key:
                if key:
                    out.append(table(key, rows))
                key, rows = (conv, piece), []
            if nth >= 0:
                rows.append((role, fault))
        if out:
            yield _batch(out, schema)
    if key:
        yield _batch([table(key, rows)], schema)


def _joined(pieces: list[dict]) -> str:
    """The paths of consecutive pieces as one."""
    whole = {k: tuple(v) for k, v in json.loads(pieces[0]["paths"]).items()}
    for p in pieces[1:]:
        more: dict[str, tuple] = {}
        for b, (cost_b, audit_b, system_b) in json.loads(p["paths"]).items():
            for a, (cost, audit, system) in whole.items():
                if a[1] == b[0]:
                    found = (cost + cost_b, audit + audit_b, system if system is not None else system_b)
                    if a[0] + b[1] not in more or found[:2] < more[a[0] + b[1]][:2]:
                        more[a[0] + b[1]] = found
        whole = more
    return json.dumps(whole)


@F.udf(T.StringType())
def _join_paths(pieces):
    return _joined(pieces)


@F.udf(T.StructType().add("cost", "long").add("audit", "string").add("system", "boolean"))
def _cheapest(found):
    cost, audit, system = min((json.loads(found)["0" + e] for e in ACCEPTING if "0" + e in json.loads(found)), key=lambda x: (x[0], x[1]))
    return cost, audit, bool(system)


@F.udf(T.ArrayType(T.StructType().add("piece", "long").add("audit", "string").add("emitted", "long")))
def _parted(pieces, audit, emitted):
    """The part of the audit that each of the pieces takes, and how many rows are left before it."""
    out, at = [], 0
    for k, p in enumerate(pieces):
        end = at
        need = p["rows"]
        while need:
            need -= audit[end] != "I"
            end += 1
        if k + 1 == len(pieces):
            end = len(audit)
        part = audit[at:end]
        out.append((p["piece"], part, emitted))
        emitted += len(part) - part.count("D")
        at = end
    return out


def _of_pieces(rows: DataFrame) -> DataFrame:
    """The digests of conversations that come as ``conv_id, piece, nth, turn, role, text``."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = rows.withColumn("conv", conv)
    name = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    known = stored(rows.select("conv", "conv_id", "piece", "nth", "turn", "role", name.alias("name"), _ending(F.col("text")).alias("ending")), "known")
    firsts = known.where("nth >= 0").groupBy("conv", "role", "name").agg(F.min(F.struct("piece", "nth")).alias("first"))
    fault = F.when(F.col("ending") == "blank", "blank").when(F.struct("piece", "nth") > F.col("first"), "duplicate").otherwise(F.col("ending"))
    told = known.join(firsts, ["conv", "role", "name"], "left").select("conv_id", "piece", "nth", "role", fault.alias("fault"))
    ddl = "conv_id long, piece long, rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, paths string"
    tables = stored(told.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "nth").mapInArrow(_tables, ddl), "pieces").withColumn("conv", conv)

    level = ranked(tables.select("conv", "piece", "rows", "paths"), "conv", "piece").select("conv", "pos", "piece", "rows", "paths")
    levels = []
    while True:
        joined = level.groupBy("conv", F.floor(F.col("pos") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "rows", "paths"))).alias("pieces"))
        summed = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["rows"])
        table = stored(joined.select("conv", "up", F.transform("pieces", lambda p: F.struct(p["piece"].alias("piece"), p["rows"].alias("rows"))).alias("pieces"), summed.alias("rows"), _join_paths("pieces").alias("paths")), "joined")
        levels.append(table)
        if table.where("up > 0").isEmpty():
            break
        level = table.select("conv", F.col("up").alias("pos"), F.col("up").alias("piece"), "rows", "paths")
    best = stored(levels[-1].select("conv", _cheapest("paths").alias("best")).select("conv", "best.*"), "best")
    parts = best.select("conv", "system", F.lit(0).cast("long").alias("up"), "audit", F.lit(0).cast("long").alias("emitted"))
    for table in reversed(levels):
        parted = stored(table.join(parts, ["conv", "up"]).select("conv", "system", _parted("pieces", "audit", "emitted").alias("parts")), "parts")
        parts = parted.select("conv", "system", F.explode("parts").alias("p")).select("conv", "system", F.col("p.piece").alias("up"), "p.audit", "p.emitted")

    texts = rows.join(parts.withColumnRenamed("up", "piece"), ["conv", "piece"]).select("conv_id", "piece", "nth", "role", "text", "audit", "emitted", "system")
    made = stored(texts.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "nth").mapInArrow(_made, "conv_id long, piece long, text string"), "made")
    hashes = made.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_hashed, "conv_id long, repaired_sha256 string").withColumn("conv", conv)

    turns = known.where("nth >= 0 and turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # pairs across the borders of pieces, empty ones left out
    full = ranked(tables.where("rows > 0").select("conv", "piece", "head", "tail"), "conv", "piece")
    pairs = full.select("conv", "pos", "tail").join(full.select("conv", (F.col("pos") - 1).alias("pos"), "head"), ["conv", "pos"])
    across = pairs.groupBy("conv").agg(F.count_if(~F.concat("tail", "head").isin("su", "ua", "au")).alias("across"))
    counts = tables.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    none = F.lit(0).cast("long")
    every = counts.join(turns, "conv", "left").join(across, "conv", "left").join(best, "conv").join(hashes.drop("conv_id"), "conv")
    return every.select("conv_id", F.coalesce("gaps", none).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("across", none)).alias("illegal"), "cost", "audit", "repaired_sha256")


def _ending(text: Column) -> Column:
    """``blank``, ``truncated`` or nothing."""
    seen = F.rtrim(text, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.when(F.length(seen) == 0, "blank").when(~F.substring(seen, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of pieces with their audits to what they become, each row ended by a newline."""
    schema = _schema("conv_id long, piece long, text string")

    def made(key: tuple, rows: list[tuple[str, str]], audit: str, emitted: int, system: bool) -> tuple:
        return (*key, "".join(x + "\n" for x in repaired(rows, audit, state_after(emitted, system))))

    key, rows, how = None, [], ()
    for batch in batches:
        out = []
        for conv, piece, nth, role, text, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (conv, piece) != key:
                if key:
                    out.append(made(key, rows, *how))
                key, rows, how = (conv, piece), [], rest
            if nth >= 0:
                rows.append((role, text))
        if out:
            yield _batch(out, schema)
    if key:
        yield _batch([made(key, rows, *how)], schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of repaired text to the hash of each conversation, without the last newline."""
    schema = _schema("conv_id long, repaired_sha256 string")
    key, digest, newline = object(), None, b""
    for batch in batches:
        out = []
        for conv, _, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if digest is None or conv != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, newline = conv, hashlib.sha256(), b""
            if text:
                digest.update(newline + text[:-1].encode("utf-8", "surrogatepass"))
                newline = b"\n"
        if out:
            yield _batch(out, schema)
    if digest is not None:
        yield _batch([(key, digest.hexdigest())], schema)


def repair(messages: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each conversation of ``messages`` (conv_id, turn, role, text, and perhaps real).

    Rows go by turn (nulls first), those of one turn by role and by their text's
    hash.  A null role or text counts as one space, so such a row is blank or has
    no role that fits; a null conv_id is a conversation of its own.  Rows that
    aren't ``real`` only name their conversation: one without other rows gives
    zeros, an empty audit and the hash of the empty text.  Repeated rows are
    duplicates.  An empty table gives no rows; other columns are ignored.  A
    conversation's audit is one value, so it must stay below 2 GB.
    """
    bounded_batches(messages.sparkSession)
    space = F.lit(" ")
    real = F.col("real") if "real" in messages.columns else F.lit(True)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(real, F.col("turn").cast("long")).alias("turn"), F.when(real, F.coalesce("role", space)).alias("role"), F.when(real, F.coalesce("text", space)).alias("text"), real.alias("real"))
    tie, salt = F.md5(F.col("text").cast("binary")), F.monotonically_increasing_id()
    rows = rows.withColumn("tie", tie).withColumn("salt", salt)
    order = ("conv_id", "turn", "role", "tie", "salt")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "turn", "role", "text", "real")
    found = stored(ordered.mapInArrow(_streamed, f"kind int, {_DIGEST}, piece long, nth int, turn long, role string, text string"), "streamed", by="kind")
    digest = [x.split(" ")[0] for x in _DIGEST.split(", ")]
    at_once = found.where("kind = 0").select(*digest)
    return at_once.unionByName(_of_pieces(found.where("kind = 1").select("conv_id", "piece", "nth", "turn", "role", "text")))


def _sql() -> str:
    """The same repairs as a recursive query that carries the four states' best edits from row to row."""
    move = lambda x, cost, letter, line="''", given="TRUE": f"CASE WHEN {x} IS NOT NULL AND {given} THEN struct_pack(c := {x}.c + {cost}, a := {x}.a || '{letter}', t := {x}.t || {line}) END"
    kept = "chr(10) || role || ':' || text"

    def to(initial: str, *states: str) -> list[str]:
        role = ROLES[initial]
        alive, more = "NOT gone", f"CASE WHEN cut THEN {TRUNCATED} ELSE 0 END"
        return [m for x in states for m in (move(x, more, "K", kept, f"{alive} AND left(role, 1) = '{initial}'"), move(x, f"{REROLE} + {more}", "R", f"chr(10) || '{role}:' || text", alive))]

    least = lambda *xs: f"least({', '.join(xs)})"
    closed_u = least("su", *(move(x, INSERT, "I", "chr(10) || 'user:'") for x in ("s0", "ss", "sa")))
    closed_a = least("sa", move("nu", INSERT, "I", "chr(10) || 'assistant:'"))
    after_s = least(move("ss", DELETE, "D"), move("s0", f"CASE WHEN cut THEN {TRUNCATED} ELSE 0 END", "K", kept, "NOT gone AND left(role, 1) = 's'"))
    after_u = least(move("nu", DELETE, "D"), *to("u", "s0", "ss", "na"))
    after_a = least(move("na", DELETE, "D"), *to("a", "nu"))
    return f"""
WITH RECURSIVE crcs AS (
  SELECT t, {CRC_SQL} % 20 AS hit FROM (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS t FROM conversations)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, copy
  FROM conversations JOIN crcs ON t = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), range(2) copies(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged
), told AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS unended,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed
), rows AS (
  SELECT *, blank OR seen AS gone, unended AND NOT blank AND NOT seen AS cut FROM told
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id
), states AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS i, struct_pack(c := CAST(0 AS BIGINT), a := '', t := '') AS s0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS ss, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS su, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS sa FROM counts
  UNION ALL
  SELECT conv_id, n, i, {move("s0", DELETE, "D")}, {after_s}, {after_u}, {after_a}
  FROM (SELECT *, {closed_a} AS na FROM (SELECT s.conv_id, s.n, s.i + 1 AS i, s0, ss, su, sa, role, text, gone, cut, {closed_u} AS nu FROM states s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1))
), ended AS (
  SELECT conv_id, least(s0, {closed_a}) AS best FROM (SELECT *, {closed_u} AS nu FROM states WHERE i = n)
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


#: ``op11_turn_repair``.
ORACLE_SQL = _sql()
