"""Near-duplicate vectors by spherical k-means and blocked cosine products; exact.

Equal vectors form one class from the start.  Centroids are fitted on a sample
of at most ``SAMPLE`` classes and every class is at home in its nearest cell.
Cells are dealt into units of about ``unit`` classes by hash, and units are
numbered.  A class visits each unit of a smaller number whose cell can't be
ruled out: a vector within the angle of ``least`` of it can lie nearer to that
cell's centroid than to its own home's only if its own distance to the plane
between the two is at most the sine of that angle.  So two linked classes meet
exactly once, in the unit with the smaller number.  Vectors that form no clusters
rule out little, and the work is then that of all pairs.

Units meet their visitors in tiles of bounded size; a tile works through its
visitors in blocks and returns link counts and spanning forests of its links,
never all pairs.  Cosines are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.llm.batches import bounded_batches
from spoolkit.llm.shingles import set_hash
from spoolkit.operators.components import connected_components
from spoolkit.storage import stored

#: Classes on which centroids are fitted, at most.
SAMPLE = 16_384
#: Classes of a unit: at least, at most, and about this share of all; cells at most (units take what this leaves).
LEAST_UNIT, MOST_UNIT, SHARE, MAX_CELLS = 64, 16_384, 12, 4_096
#: Lengths of vectors, by frequency, that get centroids; units of others visit each other all.
LENGTHS = 16
#: Units whose members visit together, and visitors that are compared together.
VISITING, BLOCK = 2, 1_024
#: Slack of the bound, for rounding.
SLACK = 1e-6
ROUNDS = 8


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    scale = np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    rows = rows / scale
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; ``rows`` are unit vectors in a fixed order.

    Seeds are drawn far from those before (by squared distance, with a fixed
    random state), so that clusters seldom share a centroid.
    """
    draw = np.random.default_rng(0)
    seeds = [0]
    far = np.maximum(0, 2 - 2 * rows @ rows[0])
    for _ in range(1, k):
        total = float(far.sum())
        seeds.append(int(np.searchsorted(np.cumsum(far), draw.random() * total)) if total > 1e-9 else int(draw.integers(len(rows))))
        seeds[-1] = min(seeds[-1], len(rows) - 1)
        far = np.minimum(far, np.maximum(0, 2 - 2 * rows @ rows[seeds[-1]]))
    centroids = rows[seeds].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(rows[i : i + 2048] @ centroids.T).argmax(axis=1) for i in range(0, len(rows), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def _vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, name, dims, vector``: name 0 where a vector links with nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, dims, held = [], [], []
            for x in batch.column(1).to_pylist():
                x = None if x is None or None in x else np.array(x, np.float64)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                x = x + 0.0 if good else None  # minus zero becomes zero
                names.append(set_hash(np.concatenate([x, [len(x)]]).view(np.uint64) * np.arange(1, 2 * len(x) + 3, 2, dtype=np.uint64)) if good else 0)
                dims.append(len(x) if good else 0)
                held.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names, pa.int64()), pa.array(dims, pa.int32()), pa.array(held, pa.binary())], ["vec_id", "name", "dims", "vector"])

    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).mapInArrow(work, "vec_id long, name long, dims int, vector binary")


def _homes(classes: DataFrame, held) -> DataFrame:
    """``classes`` with ``home``, the nearest cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            home = np.zeros(len(dims), np.int32)
            for d in set(dims) & set(held.value):
                at = [i for i, x in enumerate(dims) if x == d]
                home[at] = (unit(np.frombuffer(b"".join(vectors[i] for i in at)).reshape(len(at), d)) @ held.value[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], ["name", "size", "dims", "vector", "home"])

    return classes.select("name", "size", "dims", "vector").mapInArrow(work, "name long, size long, dims int, vector binary, home int")


def may_visit(cos: np.ndarray, home: np.ndarray, gaps: np.ndarray, least: float) -> np.ndarray:
    """Rows by cells: whether a vector at home in the cell may have a cosine of ``least`` or more with the row."""
    reach = np.sqrt(max(0.0, 1 - least * least)) if least > 0 else 2.0
    return cos[np.arange(len(home)), home][:, None] - cos <= reach * gaps[home] + SLACK


def _placed(homes: DataFrame, centroids, units: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """A row for each class and each tile in which it is compared; ``units``: the first unit of each cell, and how many it has.

    A first pass finds which groups of units visit which unit; the classes at
    home in a unit then go to those groups (and their own) alone, so copies of
    a class are as many as its unit has visiting groups, not as there are groups.
    """
    held = homes.sparkSession.sparkContext.broadcast((units, VISITING))  # at most MAX_CELLS numbers for each number of dimensions

    def located(batch: pa.RecordBatch, gaps: dict[int, np.ndarray]) -> Iterator[tuple[tuple, int, list[int]]]:
        """Each class, its unit, and the units that it visits."""
        units, _ = held.value
        names, sizes, dims, vectors, home = (c.to_pylist() for c in batch.columns)
        may = {}
        for d in set(dims) & set(gaps):
            at = [i for i, x in enumerate(dims) if x == d]
            cos = unit(np.frombuffer(b"".join(vectors[i] for i in at)).reshape(len(at), d)) @ centroids.value[d].T
            may |= dict(zip(at, may_visit(cos, np.array(home)[at], gaps[d], least), strict=True))
        for i, (name, size, d, vector, h) in enumerate(zip(names, sizes, dims, vectors, home, strict=True)):
            first, count = units.get(d, (np.zeros(1, np.int64), np.ones(1, np.int64)))
            mine = int(first[h]) + (name * 0x9E3779B97F4A7C15 % (1 << 64) >> 20) % int(count[h])
            cells = np.flatnonzero(may[i]) if i in may else np.zeros(1, np.int64)
            yield (d, name, size, vector), mine, [u for c in cells[first[cells] < mine].tolist() for u in range(int(first[c]), min(mine, int(first[c] + count[c])))]

    def gaps_of() -> dict[int, np.ndarray]:
        return {d: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) for d, c in centroids.value.items()}

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, visiting = gaps_of(), held.value[1]
        for batch in batches:
            seen = set()
            for (d, *_), mine, to in located(batch, gaps):
                seen.add((d, mine, mine // visiting))
                seen.update((d, u, mine // visiting) for u in to)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*sorted(seen), strict=True)], ["dims", "unit", "other"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = gaps_of()
        for batch in batches:
            rows = [(d, mine, mine, name, size, vector) for (d, name, size, vector), mine, _ in located(batch, gaps)]
            if rows:
                yield batch_of(rows, ("dims", "unit", "mine", "name", "size", "vector"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, visiting = gaps_of(), held.value[1]
        names = ("dims", "unit", "other", "visits", "mine", "name", "size", "vector")
        for batch in batches:
            out: list[tuple] = []
            for (d, name, size, vector), mine, to in located(batch, gaps):
                out += [(d, u, mine // visiting, 1, mine, name, size, vector) for u in to]
                if len(out) >= 20_000:
                    yield batch_of(out, names)
                    out = []
            if out:
                yield batch_of(out, names)

    def batch_of(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
        kinds = {"name": pa.int64(), "size": pa.int64(), "vector": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int32())) for c, n in zip(zip(*rows, strict=True), names, strict=True)], list(names))

    groups = homes.mapInArrow(asked, "dims int, unit int, other int").groupBy("dims", "unit").agg(F.collect_set("other").alias("others"))
    residents = homes.mapInArrow(at_home, "dims int, unit int, mine int, name long, size long, vector binary").join(groups, ["dims", "unit"])
    columns = ("dims", "unit", "other", "visits", "mine", "name", "size", "vector")
    residents = residents.select("*", F.explode("others").alias("other"), F.lit(0).alias("visits")).select(*columns)
    return residents.unionByName(homes.mapInArrow(visits, "dims int, unit int, other int, visits int, mine int, name long, size long, vector binary"))


def _tile(names: np.ndarray, sizes: np.ndarray, link: np.ndarray, n: int) -> list[tuple]:
    """(name, null, linked vectors) and (name, name, null) of the links ``link`` of the first n rows with all others."""
    a, b = np.nonzero(link)
    if not len(a):
        return []
    b = b + (len(names) - link.shape[1])
    counts = np.zeros(len(names), np.int64)
    np.add.at(counts, a, sizes[b])
    np.add.at(counts, b, sizes[a])
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    out = [(int(names[i]), None, int(counts[i])) for i in np.flatnonzero(counts)]
    return out + [(int(names[i]), int(names[label[i]]), None) for i in np.flatnonzero(label != np.arange(len(names)))]


def _links(placed: DataFrame, least: float) -> DataFrame:
    block = BLOCK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, names, sizes, waiting = None, np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def rows_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), unit(np.frombuffer(b"".join(r[2] for r in rows)).reshape(len(rows), -1))

        def visited() -> list[tuple]:
            if not waiting or not len(names):
                return []
            their_names, their_sizes, theirs = rows_of(waiting)
            return _tile(np.concatenate([names, their_names]), np.concatenate([sizes, their_sizes]), home @ theirs.T >= least, len(names))

        def within() -> list[tuple]:
            out = []
            for i in range(0, len(names), block):
                link = home[: i + block] @ home[i : i + block].T >= least
                link &= np.arange(len(link))[:, None] < np.arange(i, i + link.shape[1])[None, :]  # each pair once
                out += _tile(names[: i + block], sizes[: i + block], link, i)
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "n"])

        residents: list[tuple] = []

        def settled(key: tuple) -> list[tuple]:
            nonlocal home, names, sizes, residents
            if not residents:
                return []
            names, sizes, home = rows_of(residents)
            own, residents = residents[0][3] == key[2], []
            return within() if own else []

        for batch in batches:
            out: list[tuple] = []
            for d, u, other, visits, mine, name, size, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, u, other) != key:
                    if key:
                        out += settled(key) + visited()
                    key, waiting, residents = (d, u, other), [], []
                    names = np.zeros(0, np.int64)
                if visits:
                    out += settled(key)
                    waiting.append((name, size, vector))
                    if len(waiting) == block:
                        out += visited()
                        waiting = []
                else:
                    residents.append((name, size, vector, mine // visiting))
            if out:
                yield batch_of(out)
        if key and (out := settled(key) + visited()):
            yield batch_of(out)

    visiting = VISITING
    keys = ("dims", "unit", "other")
    return placed.repartition(*keys).sortWithinPartitions(*keys, "visits", "name").mapInArrow(work, "a long, b long, n long")


def near_duplicates(rows: DataFrame, least: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Null or zero vectors and those with null or non-finite components link
    with nothing, as do vectors of different lengths.  A row without an id is
    counted as a neighbour and has no component of its own name.  Repeated rows
    are vectors of their own.  An empty table gives no rows; other columns are
    ignored.
    """
    bounded_batches(rows.sparkSession)
    every = stored(_vectors(rows, id_column, vector_column), "vectors")
    classes = stored(every.where("name <> 0").groupBy("name").agg(F.count("*").alias("size"), F.first("dims").alias("dims"), F.first("vector").alias("vector")), "classes")
    centroids: dict[int, np.ndarray] = {}
    each: dict[int, int] = {}
    lengths = classes.groupBy("dims").count().where(F.col("count") > LEAST_UNIT).orderBy(F.desc("count"), "dims").collect()  # less common lengths are one unit
    for place, r in enumerate(lengths):
        each[r.dims] = min(MOST_UNIT, max(LEAST_UNIT, r["count"] // SHARE))
        k = min(MAX_CELLS, -(-r["count"] // each[r.dims]))
        if k < 2 or place >= LENGTHS:
            continue
        # names are hashes, so a range of them is a sample; its size is bounded whatever the table's
        span = min((1 << 63) - 1, int(min(1.0, 0.9 * SAMPLE / r["count"]) * float(1 << 63)))
        sample = classes.where((F.col("dims") == r.dims) & (F.col("name") >= -span) & (F.col("name") <= span)).select("name", "vector").limit(SAMPLE).collect()
        sample.sort(key=lambda x: x.name)
        if len(sample) >= k:
            centroids[r.dims] = spherical_kmeans(unit(np.frombuffer(b"".join(bytes(x.vector) for x in sample)).reshape(len(sample), r.dims)), k)
    held = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CELLS vectors for each of 16 numbers of dimensions
    homes = stored(_homes(classes, held), "homes")
    units: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in homes.where(F.col("dims").isin(*each) if each else F.lit(False)).groupBy("dims", "home").count().collect():  # a row for each cell
        cells = len(centroids[r.dims]) if r.dims in centroids else 1
        units.setdefault(r.dims, (np.zeros(cells, np.int64), np.ones(cells, np.int64)))[1][r.home] = -(-r["count"] // each[r.dims])
    units = {d: (np.cumsum(n) - n, n) for d, (_, n) in units.items()}
    found = stored(_links(_placed(homes, held, units, least), least), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("b is not null"), "a", "b").withColumnRenamed("vertex", "name")
    by_class = stored(classes.select("name", "size").join(counts, "name", "left").join(labels, "name", "left").select("name", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "name").alias("component")), "classes")
    named = every.where("name <> 0").select("vec_id", "name").join(by_class, "name")
    heads = named.groupBy("component").agg(F.min("vec_id").alias("head"))
    linked = named.join(heads, "component").select("vec_id", F.col("n").alias("n_links"), F.col("head").alias("component_id"))
    alone = every.where("name = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
