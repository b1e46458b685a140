"""Harmonic packing of tokenised documents into sequences.

A slot of class k has ``capacity // k`` tokens, and a sequence of class k holds
exactly k pieces, so a worker fills the sequences of each class by counting,
without looking at other workers.  A rest of a document that would waste more
than ``WASTE`` of its slot is cut at the largest slot below its length; the
remainder is a piece of a later class, where slots lie closer together.

What a worker has left at its end (fewer than k pieces in each class) is laid
end to end and cut at the capacity; the very last stretch is cut into powers of
two, which need no padding.  No row moves between workers.

Nulls: a null text counts as empty, and an empty text still has its end token;
a null document id stays null.  Repeated rows are packed as often as they occur.
An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spoolkit.llm.batches import bounded_batches, texts_of
from spoolkit.llm.piece_encoder import encoder_of

CAPACITY = 4096
#: Largest part of its length that a piece may waste in its slot.
WASTE = 1 / 64
#: Sequence numbers of a worker: the number of its partition, then this many bits.
LOCAL_BITS = 40

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(length: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of ``length`` tokens."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity // k - rest <= waste * rest:
            out.append((k, rest))
            break
        piece = capacity // (k + 1)
        out.append((k + 1, piece))
        rest -= piece
    return out


def powers(length: int) -> list[int]:
    """``length`` as a sum of different powers of two, the largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Fills one worker's sequences; a piece is (document, first id, ids, ids of the document)."""

    def __init__(self, first: int, capacity: int = CAPACITY, waste: float = WASTE):
        self.next, self.capacity, self.waste = first, capacity, waste
        self.open: dict[int, list] = defaultdict(list)

    def close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for k, n in cuts(len(ids), self.capacity, self.waste):
            held = self.open[k]
            held.append((doc, start, ids[start : start + n], len(ids)))
            start += n
            if len(held) == k:
                yield from self.close(held)
                held.clear()

    def finish(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        tokens = sum(len(p[2]) for p in left)
        rooms = [self.capacity] * (tokens // self.capacity) + powers(tokens % self.capacity)
        at = 0
        for room in rooms:
            taken = []
            while room:
                doc, start, ids, total = left[at]
                n = min(room, len(ids))
                taken.append((doc, start, ids[:n], total))
                room -= n
                if n < len(ids):
                    left[at] = (doc, start + n, ids[n:], total)
                else:
                    at += 1
            yield from self.close(taken)
        self.open.clear()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = CAPACITY, waste: float = WASTE) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text).

    A piece is ``length`` ids of the document from ``start`` on; it lies in
    sequence ``sequence_id`` from ``offset`` on.  ``ids_crc32`` is that of its
    ids as little-endian unsigned 32-bit integers; ``doc_tokens`` counts the
    document's ids with the end id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())  # the vocabulary file, a few MB whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        end = np.array([end_id], "<u4")
        packer = Packer(TaskContext.get().partitionId() << LOCAL_BITS, capacity, waste)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1))), strict=True):
                rows += packer.add(doc, np.concatenate([ids, end]))
            if rows:
                yield _batch(rows)
        if rows := list(packer.finish()):
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(work, PIECE_SCHEMA)
