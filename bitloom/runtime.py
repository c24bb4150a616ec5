"""Session helpers that every operator shares."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this many rows on; below it one task holds the key easily.
HOT_ROWS = 20_000
#: At most this many keys can be hot, so the list of them may be broadcast.
MAX_HOT_KEYS = 1_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once; they may run where it isn't installed.

    The archive is written for Spark's file server alone, which hands it to every executor.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="bitloom-package-")) / "bitloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of stored files in at least as many partitions as there are cores, for work that costs more than a shuffle.

    Only inputs in fewer splits than cores are moved, so what moves is at most a split per core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only in local mode, where all tasks run in one process."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="bitloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(counts: DataFrame, key: list[str], n: str, total: int) -> DataFrame | None:
    """Hashes of the keys with more rows than one task should hold, with a number of salts each.

    The threshold is at least ``total / MAX_HOT_KEYS``, so no more than MAX_HOT_KEYS keys
    can pass it: the result is small whatever the input. None if no key can be hot.
    """
    threshold = max(HOT_ROWS, -(-total // MAX_HOT_KEYS))
    if total < threshold:
        return None
    return counts.where(F.col(n) >= threshold).select(
        F.xxhash64(*key).alias("_hot"), F.ceil(F.col(n) / F.lit(threshold)).cast("int").alias("_salts")
    ).groupBy("_hot").agg(F.max("_salts").alias("_salts"))


def salted_join(
    many: DataFrame, one: DataFrame, key: list[str], spread: str, hot: DataFrame | None, how: str = "inner"
) -> DataFrame:
    """Equi-join (null keys equal null keys) whose hot keys are spread over several tasks.

    Rows of ``many`` under a hot key get a salt from the hash of column ``spread``;
    ``one``, which has few rows under each key, is repeated once per salt. ``hot`` is from
    :func:`hot_keys` over the same key columns.
    """
    right = one.select(*[F.col(k).alias(f"_r_{k}") for k in key], *[c for c in one.columns if c not in key])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key]
    if hot is None:
        return many.join(right, cond, how).drop(*[f"_r_{k}" for k in key])
    hot = F.broadcast(hot)
    left = (
        many.withColumn("_h", F.xxhash64(*key))
        .join(hot, F.col("_h") == F.col("_hot"), "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0)))
        .drop("_h", "_hot", "_salts")
    )
    right = (
        right.withColumn("_h", F.xxhash64(*[F.col(f"_r_{k}") for k in key]))
        .join(hot, F.col("_h") == F.col("_hot"), "left")
        .withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_h", "_hot", "_salts")
    )
    return left.join(right, cond + [F.col("_salt") == F.col("_rsalt")], how).drop(
        "_salt", "_rsalt", *[f"_r_{k}" for k in key]
    )


#: Up to so many ids are broadcast, after they were counted (8 MB of longs).
BROADCAST_IDS = 1_000_000


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is among ``ids``; broadcast only up to a counted bound, shuffled beyond it."""
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def join_nulls_equal(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns in which null equals null; the columns are those of the left side."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])
