"""Intervals, tests, sample sizes, and a bootstrap whose draws are pure functions of their index."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolkit.operators.scan import prefix_sums
from spoolkit.storage import stored

POWER_FLOOR = 60
#: Differences of one block, draws of a resample that are made together, and tasks that the resamples are dealt into.
PLACES, DRAWS, TURNS = 1 << 20, 1 << 16, 64
# The published rational approximation 7.1.26 of erf.
_ERF_P, _ERF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct(point, lo, hi) of a proportion; (0, 0, 1) without trials."""
    s = F.least(n, F.greatest(F.lit(0), successes)) / n
    low = 1 + z * z / n
    mid = (s + z * z / (2 * n)) / low
    half = (z / low) * F.sqrt(s * (1 - s) / n + z * z / (4 * n * n))
    pack = lambda p, lo, hi: F.struct(p.alias("point"), lo.alias("lo"), hi.alias("hi"))
    return F.when(n > 0, pack(s.cast("double"), F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half))).otherwise(pack(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def norm_cdf(x: Column) -> Column:
    """The standard normal distribution function; one half for null and NaN."""
    t = 1 / (1 + _ERF_P * F.abs(x) / math.sqrt(2))
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + F.lit(c)) * t
    upper = 0.5 * (2 - poly * F.exp(-x * x / 2))
    return F.when(F.isnan(x) | x.isNull() | (x == 0), 0.5).when(x > 0, upper).otherwise(1 - upper)


def norm_cdf_of(x: float) -> float:
    if math.isnan(x) or x == 0:
        return 0.5
    if x < 0:
        return 1 - norm_cdf_of(-x)
    t, poly = 1 / (1 + _ERF_P * x / math.sqrt(2)), 0.0
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return 0.5 * (2 - poly * math.exp(-x * x / 2)) if x < math.inf else 1.0


def z_for(p: float) -> float:
    """The quantile that ``norm_cdf`` has, by halving [-8, 8] eighty times."""
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    if p == 0.5:
        return 0.0
    low, high = -8.0, 8.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if norm_cdf_of(mid) < p else (low, mid)
    return (low + high) / 2


def two_proportion(a: Column, a_n: Column, b: Column, b_n: Column) -> Column:
    """struct(diff, se, z, p) of the pooled two-sided test of b against a."""
    pa, pb = F.least(a_n, F.greatest(F.lit(0), a)) / a_n, F.least(b_n, F.greatest(F.lit(0), b)) / b_n
    pool = (pa * a_n + pb * b_n) / (a_n + b_n)
    se = F.sqrt(pool * (1 - pool) * (1 / a_n + 1 / b_n))
    z = F.when(se > 0, (pb - pa) / se).otherwise(0.0)
    good = (a_n > 0) & (b_n > 0)
    return F.struct(
        F.when(good, pb - pa).otherwise(0.0).alias("diff"), F.when(good, se).otherwise(float("inf")).alias("se"),
        F.when(good, z).otherwise(0.0).alias("z"), F.when(good, 2 * (1 - norm_cdf(F.abs(z)))).otherwise(1.0).alias("p"),
    )


def repeats_needed(sigma: float, halfwidth: float, z: float = 1.96) -> float:
    if not all(map(math.isfinite, (sigma, halfwidth, z))) or halfwidth <= 0 or z < 0:
        return math.inf
    return 0 if sigma <= 0 or z == 0 else math.ceil(2 * (z * sigma / halfwidth) ** 2)


def _z_sum(alpha: float, power: float, one_sided: bool) -> float | None:
    return z_for(1 - alpha / (1 if one_sided else 2)) + z_for(power) if 0 < alpha < 1 and 0 < power < 1 else None


def trials_needed(p0: float, mde: float, alpha: float = 0.05, power: float = 0.8, one_sided: bool = True) -> float:
    p1, z = p0 + mde, _z_sum(alpha, power, one_sided)
    if z is None or not (mde > 0 and 0 <= p0 <= 1 and p1 <= 1):
        return math.inf
    return math.ceil(z**2 * (p0 * (1 - p0) + p1 * (1 - p1)) / mde**2)


def trials_needed_paired(sigma_delta: float, mde: float, alpha: float = 0.05, power: float = 0.8, one_sided: bool = True) -> float:
    z = _z_sum(alpha, power, one_sided)
    if z is None or not (math.isfinite(sigma_delta) and sigma_delta > 0 and math.isfinite(mde) and mde > 0):
        return math.inf
    return math.ceil(z**2 * sigma_delta**2 / mde**2)


def delta_sd(sigma_run: float, k: float, heterogeneity: float = 0.15) -> float:
    if not (math.isfinite(sigma_run) and sigma_run > 0 and math.isfinite(k) and k > 0 and math.isfinite(heterogeneity) and heterogeneity >= 0):
        return math.inf
    return math.sqrt(2 * sigma_run**2 / k + heterogeneity**2)


def noise_band(value: Column) -> Column:
    """struct(n, mean, sd, band95) of an aggregate; an infinite band below two values."""
    n, sd = F.count(value), F.stddev_samp(value)
    return F.struct(n.alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.when(n < 2, float("inf")).otherwise(sd).alias("sd"), F.when(n < 2, float("inf")).otherwise(1.96 * sd).alias("band95"))


def rollout_band(tasks: int, attempts: int) -> float:
    """Half the width of the interval of a mean of tasks times attempts coin throws."""
    return 1.96 * math.sqrt(0.25 / (tasks * attempts))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at rank ceil(q n) of an array."""
    return F.try_element_at(F.array_sort(values), F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(q)).cast("int")))


# Fixed value: what the 32-bit generator adds to its state at each draw.
_STEP = 0x6D2B79F5
_M32 = 0xFFFFFFFF


def _times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product; b is split so that nothing overflows 63 bits."""
    low, high = b.bitwiseAND(0xFFFF), F.shiftrightunsigned(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(0xFFFF), 16)).bitwiseAND(_M32)


def random_draw(index: Column, seed: int = 42) -> Column:
    """The ``index``-th number in [0, 1) of the seeded generator: its state only adds, so draws need no order."""
    a = ((F.lit(seed & _M32) + _times32(F.lit(_STEP), ((index + 1).cast("long")).bitwiseAND(_M32))).bitwiseAND(_M32)).cast("long")
    t = _times32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    u = (t + _times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(_M32)
    t = t.bitwiseXOR(u)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def _draws(first: int, count: int, seed: int) -> np.ndarray:
    """``random_draw`` times 2**32 of ``count`` indexes from ``first`` on."""
    a = np.arange(1, count + 1, dtype=np.uint32)
    a *= np.uint32(_STEP)
    a += np.uint32((seed + _STEP * first) & _M32)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return t ^ (t >> np.uint32(14))


def _resampled(iters: int, each: int, seed: int, places: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (turn, n, block, xs) to ``i, part``: what the places of the block add to each resample of the turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, ns, blocks = (batch.column(c).to_pylist() for c in range(3))
            for row, (turn, n, block) in enumerate(zip(turns, ns, blocks, strict=True)):
                xs = batch.column(3)[row].values.to_numpy(zero_copy_only=False)
                start, whole = block * places, len(xs) == n
                resamples = range(turn * each, min(iters, (turn + 1) * each))
                parts = []
                for i in resamples:
                    total = 0.0
                    for j in range(0, n, DRAWS):
                        place = (_draws(i * n + j, min(DRAWS, n - j), seed) * (n / 4294967296.0)).astype(np.int64)
                        if not whole:
                            place = place[(place >= start) & (place < start + len(xs))] - start
                        total += float(xs[place].sum())
                    parts.append(total)
                yield pa.RecordBatch.from_arrays([pa.array(resamples, pa.int64()), pa.array(parts, pa.float64())], ["i", "part"])

    return work


def bootstrap_mean(deltas: DataFrame, value: str = "delta", order: str = "task", iters: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``n, point, lo, hi`` of the mean of paired differences.

    Draw ``i * n + j`` picks the j-th value of resample i, so draws need no
    order.  The differences lie in blocks of ``PLACES`` by their place; each task
    makes the draws of some resamples and adds up those that fall into a block.
    """
    rows = deltas.where(F.col(value).isNotNull()).select(F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    placed = prefix_sums(rows, [], F.col("o").isNull(), "o", "x").select("x", F.col("n_before").alias("place"))
    block = F.floor(F.col("place") / PLACES).cast("long")
    lists = placed.groupBy(block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("xs"))
    blocks = stored(lists, "blocks")
    total = blocks.agg(F.sum(F.size("xs")).cast("long").alias("n"), (F.sum(F.aggregate("xs", F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("xs"))).alias("point"))  # one row
    each = max(1, -(-iters // TURNS))
    turns = deltas.sparkSession.range(0, -(-iters // each), 1, -(-iters // each)).withColumnRenamed("id", "turn").crossJoin(F.broadcast(total.select("n")))
    # each pair of a turn and a file of blocks is a task, and nothing is shuffled
    met = turns.crossJoin(blocks.hint("shuffle_replicate_nl")).select("turn", "n", "block", "xs")
    sums = met.mapInArrow(_resampled(iters, each, seed, PLACES), "i long, part double").groupBy("i").agg(F.sum("part").alias("part"))
    means = sums.crossJoin(F.broadcast(total.select("n"))).select((F.col("part") / F.col("n")).alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    return total.crossJoin(bounds).select("n", "point", "lo", "hi")  # one row each


def verdict(regressions: Column, n: Column, lo: Column, hi: Column, band: Column, mde: float = 0.05) -> Column:
    """regressed, helped (enough tasks, and the interval above the band), no_effect or inconclusive."""
    return F.when(regressions > 0, "regressed").when((n >= POWER_FLOOR) & (lo > band), "helped").when((lo <= 0) & (hi >= 0) & (hi - lo < 2 * mde), "no_effect").otherwise("inconclusive")
