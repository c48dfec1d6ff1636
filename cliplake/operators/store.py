"""Snapshot tables without MERGE: coalescing upserts, latest-wins replacement, ids, status changes, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplake.session import written


def latest(df: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """The latest row of each key (partial aggregation, no window): greatest version, then greatest values."""
    return df.groupBy(key).agg(F.max(F.struct(version, *columns)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def fold_upserts(history: DataFrame, key: str, version: str, updated: Sequence[str], fixed: Sequence[str], *more: Column) -> DataFrame:
    """The state after upserting all versions in order: the latest non-NULL of ``updated``, the first of ``fixed``, and further aggregates."""
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in updated]
    oldest = [F.min_by(c, version).alias(c) for c in fixed]
    return history.groupBy(key).agg(*newest, *oldest, *more)


def upsert_coalesce(target: DataFrame, source: DataFrame, key: str, updated: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """A new snapshot: new rows are added, of known rows the non-NULL new values hold and ``fixed`` stay."""
    t, s = target.alias("t"), source.alias("s")
    pick = lambda a, b, c: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(
        pick("t", "s", key), *[pick("s", "t", c) for c in updated], *[F.when(F.col(f"t.{key}").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in fixed]
    )


def set_status(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the status and error of ``changes`` (key, status, error_message): an unset error is cleared."""
    c = changes.select(F.col(key), F.col("status").alias("_s"), F.col("error_message").alias("_e"), F.lit(True).alias("_hit"))
    out = rows.join(c, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return out.withColumn("status", F.when(hit, F.col("_s")).otherwise(F.col("status"))).withColumn("error_message", F.when(hit, F.col("_e")).otherwise(F.col("error_message"))).drop("_s", "_e", "_hit")


def assign_ids(rows: DataFrame, order: Sequence[str], after: int, buckets: int = 64) -> DataFrame:
    """Consecutive ids behind ``after`` in the given order: range pieces are numbered by themselves and offset by the sizes before.

    The pieces are written once, as another run over the same rows may draw other borders.
    """
    spark = rows.sparkSession
    pieces = written(rows.repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id()), "id-pieces")
    sizes = {r[0]: r[1] for r in pieces.groupBy("_p").count().collect()}  # one number per piece
    offsets, total = [], after
    for p in range(buckets):
        offsets.append((p, total))
        total += sizes.get(p, 0)
    start = F.broadcast(spark.createDataFrame(offsets, "_p int, _o bigint"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return pieces.withColumn("_n", inner).join(start, "_p").withColumn("new_id", F.col("_o") + F.col("_n")).drop("_p", "_n", "_o")


def batch_counters(items: DataFrame) -> DataFrame:
    """Per batch: items, completed, failed, pending, and whether the batch is completed, derived from its items."""
    c = items.groupBy("batch_id").agg(
        F.count("*").alias("total_urls"), F.count_if(F.col("status") == "done").alias("completed"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending")
    )
    return c.withColumn("status", F.when(F.col("pending") == 0, "completed").otherwise("interrupted"))


def todo(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates without a row in ``done``."""
    return candidates.join(done.select(key), key, "left_anti")


def finished(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates with a row in ``done``."""
    return candidates.join(done.select(key), key, "left_semi")


def falsy(c: Column, default: Column) -> Column:
    """NULL and '' give the default."""
    return F.coalesce(F.nullif(c, F.lit("")), default)
