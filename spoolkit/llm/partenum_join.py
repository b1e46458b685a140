"""Exact Jaccard join of shingle sets by PartEnum signatures.

Sizes fall into bands whose ends differ by the similarity's ratio, so similar
sets lie in one band or in neighbouring ones, and each set signs for its own
band and the next.  Similar sets of a band differ in at most k elements.  The
feature domain is dealt into k // 2 + 1 + s parts, so at least s + 1 of them
hold at most one differing element.  Each part is dealt into three again, and
every subset of two of the three signs: the one that leaves the differing
element out is equal in both sets.  A signature is the projection of the set on
such a subset.  Empty projections say little: a set with at most s parts that
have one doesn't sign with them, and as similar sets agree in s + 1 parts, a
full projection is still shared.  Only sets with more such parts sign with all.

Equal sets share one 64-bit name from the start.  Sets that share a signature
are compared in rounds so that large groups of near copies cost no pairs:

1. each set with the smallest name of each signature's group;
2. between sets that round 1 left in different components, the pair of each
   two components that looks closest (one for each tile of a group);
3. all remaining pairs between different components.

Rounds 2 and 3 take a group in square tiles of bounded size.  Before texts are
read again, a parity sketch (one bit for each hash class of elements) bounds
the difference from below, which loses no similar pair; what remains is
verified on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spoolkit.llm.batches import bounded_batches, texts_of
from spoolkit.llm.shingles import mix, set_hash, shingle_set
from spoolkit.operators.components import connected_components
from spoolkit.storage import stored

#: Members of a group that are compared with each other in one tile.
TILE = 512
#: Rows up to which document ids are broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000
#: Signature rows of a batch that goes back to Spark.
OUT_ROWS = 200_000

_U = np.uint64


@cache
def bands(percent: int) -> tuple[tuple[int, int, int, int], ...]:
    """(least size, largest size, k, s) of each band, up to 2^40 elements."""
    out, low = [], 1
    while low < 1 << 40:
        high = low * 100 // percent
        k = 2 * high * (100 - percent) // (100 + percent)
        s = 0
        if k:
            for _ in range(8):  # as many as leave few sets with more parts with an empty projection than that
                parts = k // 2 + 1 + s
                empty = parts * min(1.0, 3 * math.exp(-2 * low / (3 * parts)))
                s = min(k, math.ceil(empty + 2.5 * math.sqrt(empty)))
        out.append((low, high, k, s))
        low = high + 1
    return tuple(out)


@cache
def _lows(percent: int) -> np.ndarray:
    return np.array([b[0] for b in bands(percent)])


def band_of(size: int, percent: int) -> int:
    return int(np.searchsorted(_lows(percent), size, "right")) - 1


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a non-empty set."""
    own, out = band_of(len(elements), percent), []
    mixed, dealt = mix(elements), mix(elements + _U(77))
    for band in (own, own + 1):
        k, s = bands(percent)[band][2:]
        parts, thirds = (k // 2 + 1 + s, 3) if k else (1, 1)
        slots = parts * thirds
        slot = (dealt % _U(slots)).astype(np.min_scalar_type(slots))
        order = np.argsort(slot, kind="stable")
        held, first = np.unique(slot[order], return_index=True)
        sums, counts = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        sums[held] = np.add.reduceat(mixed[order], first)
        counts[held] = np.diff(first, append=len(elements))
        if thirds > 1:  # each subset of two is a part without one of its thirds
            sums = (sums.reshape(parts, 3).sum(axis=1, dtype=np.uint64)[:, None] - sums.reshape(parts, 3)).ravel()
            counts = (counts.reshape(parts, 3).sum(axis=1)[:, None] - counts.reshape(parts, 3)).ravel()
        full = counts > 0
        bare = int((~full).reshape(parts, thirds).any(axis=1).sum())
        which = np.flatnonzero(full) if bare <= s else np.arange(slots)
        out.append(mix(sums[which] + mix(which.astype(np.uint64) + _U(band << 32))))
    return np.concatenate(out).view(np.int64)


def sketch_of(elements: np.ndarray, percent: int) -> bytes:
    """One parity bit for each of a power of two of hash classes."""
    k = bands(percent)[band_of(len(elements), percent)][2]
    bits = 64 << max(0, (8 * k // 64).bit_length())
    odd = np.bincount((mix(elements + _U(991)) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint64)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def most_apart(a, b, percent: int):
    """The largest symmetric difference that similar sets of these sizes can have."""
    return (a + b) * (100 - percent) // (100 + percent)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, name, sketch`` of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in texts_of(batch.column(1))]
            columns = [batch.column(0).cast(pa.int64()), pa.array([len(e) for e in sets], pa.int64()), pa.array([set_hash(e) for e in sets], pa.int64()), pa.array([sketch_of(e, percent) if len(e) else None for e in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "name", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, name long, sketch binary")


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``sig, name``; a task signs once for equal sets that follow each other closely."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, names, rows = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(names))], ["sig", "name"])

        for batch in batches:
            for text in texts_of(batch.column(0)):
                elements = shingle_set(text, width)
                name = set_hash(elements)
                if not name or name in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(name)
                sigs.append(signatures(elements, percent))
                names.append(np.full(len(sigs[-1]), name, np.int64))
                rows += len(sigs[-1])
                if rows > OUT_ROWS:
                    yield out()
                    sigs, names, rows = [], [], 0
        if rows:
            yield out()

    return docs.where("doc_id is not null").select("text").mapInArrow(work, "sig long, name long")


def _sieved(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches don't rule them out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            hit = []
            for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
                size = min(len(x), len(y)) // 8
                if np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum() <= most_apart(na[i], nb[i], percent):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.int64()), pa.array([b[i] for i in hit], pa.int64())], ["a", "b"])

    of = lambda end: sets.select(F.col("name").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of ``pairs`` (stored) whose sets are similar."""
    wanted = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    ids = stored(sets.join(wanted, "name").select("doc_id"), "wanted")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(e) for e in found], pa.int64()), pa.array([e.tobytes() for e in found], pa.binary())], ["name", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ea, eb = (c.to_pylist() for c in batch.columns)
            hit = []
            for i, (x, y) in enumerate(zip(ea, eb, strict=True)):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.int64()), pa.array([b[i] for i in hit], pa.int64())], ["a", "b"])

    held = stored(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text").mapInArrow(elements, "name long, elements binary").dropDuplicates(["name"]), "sets")
    of = lambda end: held.select(F.col("name").alias(end), F.col("elements").alias(f"e_{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "e_a", "e_b").mapInArrow(compare, "a long, b long")


def _across(rows: DataFrame, sets: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs ``a, b`` of one group and of different components that their sketches allow.

    ``rows``: sig, low, name, component.  With ``best``, a tile returns one pair
    for each two components, the one whose sketches differ least.  Near copies
    share many groups; most of these have the same smallest name, so tiles are
    dealt out by it and a pair is handed on once for each.
    """
    blocks = F.when(F.col("size") <= TILE, 1).otherwise(F.pow(F.lit(2), F.ceil(F.log2(F.col("size") / TILE)))).cast("int")
    placed = rows.withColumn("size", F.count("*").over(W.partitionBy("sig"))).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    narrow = placed.select("*", other).select("low", "sig", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "name", "component")
    # near copies share many groups, so a sketch travels once for all groups of one smallest name
    gathered = narrow.groupBy("low", "x", "y", "block", "name", "component").agg(F.collect_list("sig").alias("sigs"))
    tiles = gathered.join(sets.select("name", "n", "sketch"), "name").select("low", "x", "y", "block", "name", "n", "component", "sketch", "sigs")

    def found(x: int, y: int, held: list[tuple]) -> list[tuple[int, int]]:
        """The pairs of a tile: ``held`` has block, name, n, component, sketch and sigs of its members."""
        block, name, n, component = (np.array([r[i] for r in held], np.int64) for i in range(4))
        words = np.array([len(r[4]) // 8 for r in held])
        stacked: dict[int, np.ndarray] = {}
        members: dict[int, list[int]] = {}
        for i, r in enumerate(held):
            for sig in r[5]:
                members.setdefault(sig, []).append(i)
        out: dict[tuple, tuple] = {}
        done: set[tuple] = set()
        for at in members.values():
            if len(at) < 2 or tuple(at) in done:
                continue
            done.add(tuple(at))
            at = np.array(at)
            size = int(words[at].min())
            if size not in stacked:
                stacked[size] = np.stack([_folded(r[4], size) if len(r[4]) // 8 >= size else np.zeros(size, np.uint64) for r in held])
            bits = stacked[size]
            left, right = at[block[at] == x], at[block[at] == y]
            for i in left:
                js = right[right > i] if x == y else right
                js = js[component[js] != component[i]]
                js = js[np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent]
                if not len(js):
                    continue
                apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1)
                ok = apart <= most_apart(n[js], n[i], percent)
                for j, d in zip(js[ok].tolist(), apart[ok].tolist(), strict=True):
                    pair = (min(int(name[i]), int(name[j])), max(int(name[i]), int(name[j])))
                    of = (min(int(component[i]), int(component[j])), max(int(component[i]), int(component[j]))) if best else pair
                    out[of] = min(out.get(of, (1 << 30, pair)), (d, pair))
        return sorted({pair for _, pair in out.values()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            lows, xs, ys, *rest = (c.to_pylist() for c in batch.columns)
            pairs = []
            for k, row in zip(zip(lows, xs, ys, strict=True), zip(*rest, strict=True), strict=True):
                if k != key:
                    if len(held) > 1:
                        pairs += found(key[1], key[2], held)
                    key, held = k, []
                held.append(row)
            if pairs:
                yield batch_of(pairs)
        if len(held) > 1 and (pairs := found(key[1], key[2], held)):
            yield batch_of(pairs)

    return tiles.repartition("low", "x", "y").sortWithinPartitions("low", "x", "y", "name").mapInArrow(work, "a long, b long").distinct()


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, name, sketch of every row; doc_id, name, component of the rows with an id and words)."""
    bounded_batches(docs.sparkSession)
    every = stored(_sets(docs, width, percent), "documents")
    full = every.where("n > 0 and doc_id is not null")
    sets = stored(full.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    group = W.partitionBy("sig")
    shared = stored(
        _signed(docs, width, percent).withColumn("low", F.min("name").over(group)).withColumn("high", F.max("name").over(group)).where("low < high").select("sig", "name", "low").distinct(),
        "signatures",
    )

    candidates = stored(_sieved(shared.where("name <> low").select(F.col("low").alias("a"), F.col("name").alias("b")).distinct(), sets, percent), "pairs")
    links = stored(_verified(candidates, docs, sets, width, percent), "links")
    labels = stored(connected_components(links, "a", "b").withColumnRenamed("vertex", "name"), "labels")
    rest = shared.where("name <> low")  # the pairs with the smallest name are done
    for best in (True, False):
        named = rest.join(labels, "name", "left").select("low", "sig", "name", F.coalesce("component", "name").alias("component"))
        split = named.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("sig")
        candidates = stored(_across(named.join(split, "sig", "left_semi"), sets, percent, best), "pairs")
        if candidates.isEmpty():
            break
        new = stored(_verified(candidates, docs, sets, width, percent), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = stored(connected_components(links, "a", "b").withColumnRenamed("vertex", "name"), "labels")

    return every, full.select("doc_id", "name").join(labels, "name", "left").select("doc_id", "name", F.coalesce("component", "name").alias("component"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * intersection >= ``percent`` * union of
    their sets of ``width``-word shingles; a component is named by its
    smallest doc_id.  A null or wordless text has an empty set and is linked
    with nothing.  A row with a null doc_id is linked with nothing and has a
    null component.  Rows with the same id and different texts share a
    component.  An empty table gives no rows; other columns are ignored.
    """
    every, named = _classes(docs, width, percent)
    heads = named.groupBy("component").agg(F.min("doc_id").alias("head"))
    of_id = stored(named.join(heads, "component").select("doc_id", "head").distinct(), "heads")
    again = of_id.groupBy("doc_id").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low < high").select("low", "high")
    if not again.isEmpty():  # one id with several texts ties their components together
        tied = connected_components(again, "low", "high").select(F.col("vertex").alias("head"), F.col("component").alias("tied"))
        of_id = of_id.join(tied, "head", "left").select("doc_id", F.coalesce("tied", "head").alias("head")).distinct()
    return every.join(of_id, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("head", "doc_id").alias("component_id"))


def _named(docs: DataFrame, column: str, width: int) -> DataFrame:
    """``docs`` with the name of each text's set, 0 without words, in ``column``."""
    at, names = docs.columns.index("text"), [*docs.columns, column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([set_hash(shingle_set(t, width)) for t in texts_of(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(column, LongType())]))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that of its smallest doc_id.

    Rows without an id and texts without words are linked with nothing and
    stay.  Rows of one id with different texts are texts of their own, each
    kept or not by its own group; of rows of one id whose texts have equal sets
    one stays.  An empty table gives no rows; all columns are kept as they are.
    """
    every, named = _classes(docs, width, percent)
    named = stored(named, "named")
    heads = named.groupBy("component").agg(F.min(F.struct("doc_id", "name")).alias("head")).select("component", "head.doc_id", "head.name")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = stored(named.join(heads.select("component", F.col("doc_id").alias("head")), "component").where(F.col("doc_id") != F.col("head")).select("doc_id"), "gone")
        if gone.count() <= BROADCAST_ROWS:
            gone = F.broadcast(gone)
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    column = next(f"set_{i}" for i in range(len(docs.columns) + 1) if f"set_{i}" not in {c.lower() for c in docs.columns})
    marked = stored(_named(docs, column, width), "named")
    free = (F.col(column) == 0) | F.col("doc_id").isNull()
    kept = marked.where(~free).join(heads.select("doc_id", F.col("name").alias(column)), ["doc_id", column], "left_semi").dropDuplicates(["doc_id", column])
    return kept.unionByName(marked.where(free)).select(*docs.columns)
