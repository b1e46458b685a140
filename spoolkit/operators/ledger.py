"""Ledgers as hash chains: rows with their number, the hash of the row before, and their own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolkit.operators.scan import positions
from spoolkit.storage import stored


def json_value(value: Column) -> Column:
    """A column's value as JSON; null where it is null."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6)).otherwise(F.lit("null"))


def _described(columns: list[str]) -> tuple[Column, Column]:
    """The row's JSON with sorted keys and no spaces, before and after the value of ``prev``."""
    parts: list[Column] = []
    cut = 0
    for i, c in enumerate(sorted([*columns, "prev", "seq"])):
        parts.append(F.lit(("{" if i == 0 else ",") + f'"{c}":'))
        if c == "prev":
            cut = len(parts)
        else:
            parts.append(json_value(F.col(c)))
    parts.append(F.lit("}"))
    return F.concat(*parts[:cut]), F.concat(*parts[cut:])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (ledger, seq), the last three columns head, tail and the hash that the ledger ends with so far, to rows with prev and hash."""
    ledger, last = object(), None
    for batch in batches:
        keys, heads, tails, ends = (batch.column(i).to_pylist() for i in (0, -3, -2, -1))
        prevs, hashes = [], []
        for key, head, tail, end in zip(keys, heads, tails, ends, strict=True):
            if key != ledger:
                ledger, last = key, end
            prevs.append(last)
            last = hashlib.sha256((head + ("null" if last is None else f'"{last}"') + tail).encode()).hexdigest()
            hashes.append(last)
        kept = batch.columns[:-3]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], [*batch.schema.names[:-3], "prev", "hash"])


def appended(decisions: DataFrame, key: str, order: list[str], ledger: DataFrame | None = None) -> DataFrame:
    """``decisions`` as the next rows of their ledgers: all columns, and ``seq, prev, hash``.

    ``key`` names the ledger (no null), ``order`` decides between any two rows of
    one.  ``ledger`` has the rows so far.  ``hash`` is the SHA-256 of the row's
    JSON (sorted keys, no spaces, nulls as null) with ``prev`` and ``seq``.  Rows
    are numbered in ranges of all of them; the chain itself goes from row to row,
    so each ledger is hashed as one sorted stream, with one hash in memory.
    """
    columns = decisions.columns
    numbered = positions(decisions, key, *order)
    if ledger is not None:
        ends = ledger.groupBy(key).agg(F.max(F.struct("seq", "hash")).alias("end"))
        numbered = numbered.join(ends, key, "left").withColumn("seq", F.col("pos") + F.coalesce(F.col("end.seq") + 1, F.lit(0))).withColumn("end", F.col("end.hash"))
    else:
        numbered = numbered.withColumn("seq", F.col("pos")).withColumn("end", F.lit(None).cast("string"))
    head, tail = _described(columns)
    others = [c for c in columns if c != key]
    rows = numbered.select(key, *others, "seq", head.alias("_head"), tail.alias("_tail"), F.col("end").alias("_end"))
    schema = rows.drop("_head", "_tail", "_end").schema.add("prev", "string").add("hash", "string")
    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(_folded, schema)


def faults(ledger: DataFrame, key: str) -> DataFrame:
    """``key, seq, faults`` of rows that don't verify: ``hash`` (the row isn't what was hashed) and ``link`` (``prev`` isn't the hash of the row before).

    Each row is hashed by itself and meets the row before in a join, so a ledger
    of any length is verified in parallel.
    """
    columns = [c for c in ledger.columns if c not in ("seq", "prev", "hash")]
    head, tail = _described(columns)
    own = F.sha2(F.concat(head, json_value(F.col("prev")), tail), 256)
    rows = stored(ledger.select(key, "seq", "prev", "hash", (own == F.col("hash")).alias("sound")), "ledger")
    before = rows.select(key, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    linked = F.when(F.col("seq") == 0, F.col("prev").isNull()).otherwise(F.coalesce(F.col("prev") == F.col("before"), F.lit(False)))
    told = F.array_compact(F.array(F.when(~F.coalesce("sound", F.lit(False)), "hash"), F.when(~linked, "link")))
    return rows.join(before, [key, "seq"], "left").select(key, "seq", told.alias("faults")).where(F.size("faults") > 0)
