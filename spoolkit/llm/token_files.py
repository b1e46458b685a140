"""Token-id files: a concatenated id array with Elias-Fano coded boundaries.

A segment is one byte string::

    magic, id width, number of nulls among the document ids, documents, ids,
    first document id, then two Elias-Fano sequences (document ids less the
    first one, and document ends), then the ids

An Elias-Fano sequence of n values below u keeps floor(log2(u / n)) low bits of
each value in a packed array and the high parts in unary, 2 + log2(u / n) bits
a value.  ``select`` finds the i-th value from sampled positions of the ones,
so the offset of a document needs no table of 64-bit numbers.

Segments are rows of a Parquet table that Spark writes and reads, so they may
lie in any store and a lost executor's task is simply run again.  Ids take two
bytes where the vocabulary allows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolkit.llm.batches import bounded_batches, texts_of
from spoolkit.llm.piece_encoder import encoder_of
from spoolkit.storage import new_path

MAGIC = b"EFT1"
#: A segment is closed once it has this many ids; a document is never split.
SEGMENT_IDS = 1 << 17
#: The position of every so many-th one is kept.
SAMPLE = 256

_HEAD = struct.Struct("<4sBIIQq")
_SEQ = struct.Struct("<IQBII")
SEGMENT_SCHEMA = "part long, number long, local_start long, n_ids long, n_docs long, segment binary"


@dataclass
class EliasFano:
    """A non-decreasing sequence of ``n`` values, the largest below ``universe``."""

    n: int
    universe: int
    low_bits: int
    low: np.ndarray  # packed, uint8
    high: np.ndarray  # packed unary, uint8
    samples: np.ndarray  # uint32 positions of every SAMPLE-th one

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high + (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        window[: at % 8] = 0
        while (have := int(window.sum())) <= left:
            left -= have
            byte += 1
            window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        one = byte * 8 + int(np.flatnonzero(window)[left])
        first = i * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits) // 8 + 1], bitorder="little")[first % 8 :][: self.low_bits]
        return (one - i << self.low_bits) | int((bits.astype(np.int64) << np.arange(self.low_bits)).sum())

    def pack(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples.astype("<u4"))]
        return _SEQ.pack(self.n, self.universe, self.low_bits, len(parts[0]), len(parts[1])) + b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, universe, low_bits, a, b = _SEQ.unpack_from(data, at)
        at += _SEQ.size
        m = -(-n // SAMPLE)
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, universe, low_bits, low, high, np.frombuffer(data, "<u4", m, at + a + b)), at + a + b + 4 * m


class Segment:
    """A reader: documents in order, or the ids of the i-th one."""

    def __init__(self, data: bytes):
        magic, self.width, self.nulls, self.docs, self.n_ids, self.first = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.doc_ids, at = EliasFano.unpack(data, _HEAD.size)
        self.ends, at = EliasFano.unpack(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def offset(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offset(i) : self.ends.select(i)].astype("<u4")

    def rows(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        at = 0
        for i in range(self.docs):
            end = self.ends.select(i)
            doc = self.first + self.doc_ids.select(i - self.nulls) if i >= self.nulls else None
            yield doc, at, self.ids[at:end].astype("<u4")
            at = end


def make_segment(docs: list[int | None], arrays: list[np.ndarray], width: int) -> bytes:
    """``docs`` ascending, nulls first."""
    nulls = sum(d is None for d in docs)
    names = docs[nulls:]
    first = names[0] if names else 0
    ends = np.cumsum([len(a) for a in arrays])
    body = np.concatenate(arrays).astype(f"<u{width}").tobytes()
    head = _HEAD.pack(MAGIC, width, nulls, len(docs), int(ends[-1]), first)
    return head + EliasFano.of(np.array([d - first for d in names], np.uint64)).pack() + EliasFano.of(ends).pack() + body


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write its segments to ``path``.

    Texts are dealt out by ranges of doc_id (a null text is empty, null ids
    come first, equal ids in the order of their texts' hashes), so the segments
    of part p follow those of part p - 1.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())  # the vocabulary file, a few MB whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4")
        part, number, start, size = TaskContext.get().partitionId(), 0, 0, 0
        names: list[int | None] = []
        arrays: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            row = [part, number, start, size, len(names)]
            data = [pa.array([x], pa.int64()) for x in row] + [pa.array([make_segment(names, arrays, width)], pa.binary())]
            return pa.RecordBatch.from_arrays(data, ["part", "number", "local_start", "n_ids", "n_docs", "segment"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1))), strict=True):
                names.append(doc)
                arrays.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= SEGMENT_IDS:
                    yield close()
                    number, start, size, names, arrays = number + 1, start + size, 0, [], []
        if names:
            yield close()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(work, SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``.

    ``start`` counts the ids of all documents before it.  Only one number for
    each part (not for each document) is brought to the driver.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base: dict[int, int] = {}
    at = 0
    for r in sorted(totals):
        base[r.part] = at
        at += r.n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, local, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                first = base[part] + local
                rows = [(doc, first + a, len(ids), zlib.crc32(ids.tobytes())) for doc, a, ids in Segment(data).rows()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "local_start", "segment").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to new token files in the shared folder and read them back.

    An empty table writes no segment and gives no rows; repeated rows are kept.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file, end_id)
    return read_tokens(docs.sparkSession, path)
