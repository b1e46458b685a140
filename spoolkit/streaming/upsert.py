"""A table of the best row for each key, merged batch by batch.

Rows are dealt into buckets by the hash of their key.  A batch rewrites only the
buckets that it touches: what they hold and what comes are reduced to the
preferred row of each key, and written to a folder of the batch.  A commit lists
the folder of each bucket; it counts once it is whole, so a batch that fails half
way changes nothing, and one that comes again is skipped.  Preference is a total
order, so batches may come in any order, overlap or repeat and give the rows that
all of them give at once.  There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none where there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _commits(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, f"{path}/commits") if "_SUCCESS" in _names(spark, f"{path}/commits/{n}")]


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Bucket to folder, as of the last commit: at most as many as there are buckets."""
    done = _commits(spark, path)
    return {r.bucket: r.folder for r in spark.read.schema("bucket int, folder string").parquet(f"{path}/commits/{done[-1]}").collect()} if done else {}


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows as of the last commit."""
    folders = [f"{path}/{f}" for _, f in sorted(_folders(spark, path).items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def preferred(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each of ``keys`` (nulls are a value): the first in ``order`` (ascending, nulls first), found by partial aggregates."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys))).agg(F.min_by(whole, F.struct(*order)).alias("row")).select("row.*")


def merge(rows: DataFrame, path: str, keys: list[str], order: list[Column], batch: str, buckets: int = 64) -> int:
    """Merge ``rows`` into the table at ``path``; how many buckets were rewritten (0 where ``batch`` is known already).

    ``order`` should decide between any two different rows of a key; the number
    of ``buckets`` stays what it was at the first merge.  An empty batch is
    committed as it is.
    """
    spark = rows.sparkSession
    done = _commits(spark, path)
    if any(n.split("-", 1)[1] == batch for n in done):
        return 0
    folders = _folders(spark, path)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = sorted(r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect())
    there = [f"{path}/{folders[b]}" for b in touched if b in folders]
    both = rows.unionByName(spark.read.schema(rows.schema).parquet(*there)) if there else rows
    step = f"{len(done):09d}-{batch}"
    if touched:
        best = preferred(both, keys, order).withColumn("bucket", bucket)
        best.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{step}")
    now = folders | {b: f"data/{step}/bucket={b}" for b in touched}
    listed = spark.createDataFrame(sorted(now.items()), "bucket int, folder string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{step}")  # a row for each bucket
    return len(touched)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders of buckets that the last commit doesn't list; how many there were."""
    kept = set(_folders(spark, path).values())
    gone = 0
    for step in _names(spark, f"{path}/data"):
        for name in _names(spark, f"{path}/data/{step}"):
            if name.startswith("bucket=") and f"data/{step}/{name}" not in kept:
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{step}/{name}")
                gone += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone
