"""Previous rows over ordered rows of an entity, without one task per entity.

Rows are windowed inside (entity, shard); one summary row per shard carries what the next shard needs. A hot
entity is therefore spread over its shards, and only its shard summaries meet in one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_shard(seconds: Column, length: float = 3600.0) -> Column:
    """Number of the time shard; NULL times share one shard of their own."""
    return F.floor(seconds / F.lit(length)).cast("long")


def with_previous(df: DataFrame, entity: Sequence[str], shard: str, order: Sequence[str], prev: dict[str, Column]) -> DataFrame:
    """Adds the value of each expression in ``prev`` in the previous row of the entity (NULL in the first).

    ``shard`` must not fall along ``order``; ``order`` must be unique within the entity.
    """
    inner = Window.partitionBy(*entity, shard).orderBy(*order)
    packed = F.struct(*[c.alias(n) for n, c in prev.items()])
    rows = df.withColumn("_sq_val", packed).withColumn("_sq_prev", F.lag("_sq_val").over(inner)).withColumn("_sq_first", F.row_number().over(inner) == 1)
    ends = df.groupBy(*entity, shard).agg(F.max_by(packed, F.struct(*order)).alias("_sq_last"))
    ends = ends.withColumn("_sq_before", F.lag("_sq_last").over(Window.partitionBy(*entity).orderBy(shard))).drop("_sq_last")
    on = [rows[c].eqNullSafe(ends[c]) for c in [*entity, shard]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = rows.join(ends, cond, "left").select(rows["*"], "_sq_before")
    value = F.when(F.col("_sq_first"), F.col("_sq_before")).otherwise(F.col("_sq_prev"))
    out = out.withColumn("_sq_value", value)
    return out.withColumns({n: F.col(f"_sq_value.{n}") for n in prev}).drop("_sq_val", "_sq_prev", "_sq_first", "_sq_before", "_sq_value")
