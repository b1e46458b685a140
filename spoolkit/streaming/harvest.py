"""Transcripts as a stream: open prompt groups in state, episodes in a table.

A transcript that grows comes as chunk files (``name.part-<number>.jsonl``); each is
read whole, so a line's number is its place.  Two stateful operators follow.

- By file: which prompt a record belongs to.  The state lists the records seen with their
  prompts, without their text; a batch appends what it has settled at once, and reads the
  list once, if at all, so a record costs no call to the state store.  A record whose
  parent hasn't come waits for it, at most ``quiet``, and then is an orphan.
- By file and group: the records of a group that is open.  Whenever records come, the
  group is given out as a whole (``most`` records and one more at most, so that it
  shows that it was cut).  A group without news for ``quiet`` is closed: its timer drops
  its state.

Each batch of groups becomes episodes by the operators that a batch harvest uses, and
is merged into the table by the same preference (``streaming.upsert``): an episode of
more records takes the place of what it was before.  So after each run the table has
what a harvest of all files so far gives.  A record that comes after its group was
closed starts it anew, and the larger part stays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spoolkit.operators.sessionize import episodes_of, kept_groups, steps_of
from spoolkit.sources.transcripts import chunk_of, records_of, whole_file
from spoolkit.storage import stored
from spoolkit.streaming.upsert import merge

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that starts the operators doesn't have the driver's path

_GROUPED = "file string, group string, chunk int, line_no int, line string"
_WAITING = "chunk int, line_no int, uuid string, parent_uuid string, session_id string, line string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Records that are added to a state's list in one call.
APPENDED = 10_000

KEYS = ["session_id", "prompt_id", "agent_id"]


def preference() -> list:
    """A session file's episode first, then the one with more records, then by file."""
    return [F.col("source_kind") != "session", -F.col("n_records"), F.col("file")]


class PromptOfRecord(StatefulProcessor):
    """Records of a file to records with their group."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("known", "uuid string, prompt string")
        self.waiting = handle.getListState("waiting", _WAITING)

    @staticmethod
    def _group(prompt: str, session: str | None) -> str:
        return prompt or f"_orphan:{session if session is not None else 'unknown'}"

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (file,) = key
        fresh: dict[str, str] = {}
        before: dict[str, str] | None = None  # what earlier batches settled, read when it is first asked for
        new: list[tuple[str, str]] = []

        def prompt_of(uuid: str) -> str | None:
            nonlocal before
            if fresh.get(uuid):
                return fresh[uuid]
            if before is None:
                before = {}
                for u, p in map(tuple, self.known.get() if self.known.exists() else ()):
                    if p or u not in before:
                        before[u] = p
            return before.get(uuid) or fresh.get(uuid, before.get(uuid))

        def settled(uuid: str | None, prompt: str) -> None:
            if uuid is not None:
                new.append((uuid, prompt))
                if prompt or uuid not in fresh:
                    fresh[uuid] = prompt

        later: dict[str, list[tuple]] = {}
        if self.waiting.exists():
            for r in self.waiting.get():
                later.setdefault(r[3], []).append(tuple(r))
        began_with = sum(map(len, later.values()))
        for r in rows:
            prompt = r.prompt_id if r.prompt_id is not None else "" if r.parent_uuid is None else prompt_of(r.parent_uuid)
            if prompt is None:
                later.setdefault(r.parent_uuid, []).append((r.chunk, r.line_no, r.uuid, r.parent_uuid, r.session_id, r.line))
                continue
            yield Row(file=file, group=self._group(prompt, r.session_id), chunk=r.chunk, line_no=r.line_no, line=r.line)
            settled(r.uuid, prompt)
            found = [(r.uuid, prompt)]
            while found:
                uuid, prompt = found.pop()
                for chunk, line_no, child, _, session, line in later.pop(uuid, ()):
                    yield Row(file=file, group=self._group(prompt, session), chunk=chunk, line_no=line_no, line=line)
                    settled(child, prompt)
                    found.append((child, prompt))
        for i in range(0, len(new), APPENDED):
            self.known.appendList(new[i : i + APPENDED])
        left = [x for xs in later.values() for x in xs]
        if left or began_with:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.waiting.clear()
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for chunk, line_no, _, _, session, line in map(tuple, self.waiting.get() if self.waiting.exists() else ()):
            yield Row(file=key[0], group=self._group("", session), chunk=chunk, line_no=line_no, line=line)
        self.waiting.clear()


class OpenGroup(StatefulProcessor):
    """Records of a group to the whole group so far."""

    def __init__(self, most: int, quiet_ms: int) -> None:
        self.most, self.quiet_ms = most, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", "chunk int, line_no int, line string")
        self.count = handle.getValueState("count", "n int, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        file, group = key
        was, due = self.count.get() or (0, None)
        n, new = was, []
        for r in rows:
            if n <= self.most:  # one more than is kept shows that the group was cut
                new.append((r.chunk, r.line_no, r.line))
                n += 1
        then = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(then)
        self.count.update((n, then))
        if new:
            self.records.appendList(new)
            for chunk, line_no, line in map(tuple, self.records.get()) if was else new:
                yield Row(file=file, group=group, chunk=chunk, line_no=line_no, line=line)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.records.clear()
        self.count.clear()
        return iter(())


def open_groups(spark: SparkSession, root: str, most: int = 5000, quiet_ms: int = DAY_MS) -> DataFrame:
    """``file, group, chunk, line_no, line``: the stream of groups that have news, each as a whole."""
    files = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("wholetext", "true").schema("value string").text(root)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", "^﻿|\r$", "")).where(F.trim("line") != "")
    parsed = F.try_parse_json("line")
    field = lambda p: F.try_variant_get(parsed, p, "string")
    narrow = lines.where(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))).select(
        whole_file(F.col("path")).alias("file"), chunk_of(F.col("path")).alias("chunk"), "line_no", field("$.uuid").alias("uuid"), field("$.parentUuid").alias("parent_uuid"), field("$.promptId").alias("prompt_id"), field("$.sessionId").alias("session_id"), "line"
    )
    grouped = narrow.groupBy("file").transformWithState(PromptOfRecord(quiet_ms), _GROUPED, "Append", "ProcessingTime")
    return grouped.groupBy("file", "group").transformWithState(OpenGroup(most, quiet_ms), _GROUPED, "Append", "ProcessingTime")


def harvest_stream(spark: SparkSession, root: str, table: str, checkpoint: str, most: int = 5000, quiet_ms: int = DAY_MS):
    """Merge the episodes of what has arrived below ``root`` into ``table`` and stop; sidechains are in the table, with their flag.

    One batch takes all that has arrived: with timers of processing time there is
    always one more batch to run, so ``availableNow`` wouldn't stop.  Timers that are
    due fire in the next run.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)

    def take(batch: DataFrame, number: int) -> None:
        groups = stored(batch, "open-groups")
        if groups.isEmpty():
            return
        lines = groups.select("file", "group", F.struct("chunk", "line_no").alias("pos"), F.try_parse_json("line").alias("parsed"))
        records = kept_groups(records_of(lines, root, "group"), most)
        merge(stored(episodes_of(records, steps_of(records)), "episodes"), table, KEYS, preference(), f"batch-{number}")

    try:
        return open_groups(spark, root, most, quiet_ms).writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", checkpoint).trigger(once=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
