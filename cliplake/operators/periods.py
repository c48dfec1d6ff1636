"""Continuous periods and the gaps between them, for intervals that overlap, nest, touch or leave holes.

Two levels, so that a huge entity is never one task. Level one clips every interval into the time shards of
its two ends and merges inside (entity, shard). The shards between the ends are not filled but counted: one
row per entity and shard says how many intervals leave it and arrive in it, so a running sum tells which
shards an interval passes whole; those get one more piece, the shard itself. An interval of any length thus
has two pieces. Only the first and the last local period of a shard can touch its borders or face another
shard; level two stitches just those (at most two rows per entity and shard). Gaps inside a shard leave at
level one, gaps across shards at level two.

Defined results: times are rounded to milliseconds first; rows with a NULL, NaN or infinite time, or whose
end is then not after the start, are no intervals and are left out; a NULL entity column is a value of its
own; exact repeats change nothing; an empty table gives an empty result; further columns are ignored,
whatever their names. The working columns begin with ``_pd_``, so entity columns may have any other name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplake.functions.clean import compact, to_ms
from cliplake.sources.tables import table

HOUR_MS = 3_600_000
#: The label table is a short list of known sounds: its types are sent to all tasks, and a longer list is refused.
MOST_TYPES = 10_000


def merge_periods(
    df: DataFrame,
    entity: Sequence[str],
    start: str = "start_sec",
    end: str = "end_sec",
    recording_pause_ms: int = HOUR_MS,
    shard_ms: int = HOUR_MS,
) -> DataFrame:
    """``entity`` columns, kind ('period' or 'gap'), start_ms, end_ms.

    A gap of ``recording_pause_ms`` or more separates recordings and is not returned.
    """
    spans = df.select(*entity, to_ms(F.col(start).cast("double")).alias("_pd_s"), to_ms(F.col(end).cast("double")).alias("_pd_e"))
    spans = spans.where("_pd_s < _pd_e")
    low = lambda c: c - F.pmod(c, F.lit(shard_ms))
    own = [F.col(f"`{c}`") for c in entity]
    head, tail, s, e = F.col("_pd_head"), F.col("_pd_tail"), F.col("_pd_s"), F.col("_pd_e")
    spans = spans.withColumns({"_pd_head": low(s), "_pd_tail": low(e - 1)})
    piece = lambda shard, a, b, leaves, came: F.struct(shard.alias("shard"), a.alias("s"), b.alias("e"), F.lit(leaves).alias("leaves"), F.lit(came).alias("came"))
    inside = F.array(piece(head, s, e, 0, 0))
    across = F.array(piece(head, s, head + shard_ms, 1, 0), piece(tail, tail, e, 0, 1))
    pieces = spans.select(*own, F.explode(F.when(head == tail, inside).otherwise(across)).alias("_pd_x"))
    pieces = pieces.select(*own, *[F.col(f"_pd_x.{c}").alias(f"_pd_{c}") for c in ("shard", "s", "e", "leaves", "came")])

    # Shards that intervals pass whole: they came from before and leave later. One row per entity and shard.
    sums = pieces.groupBy(*own, "_pd_shard").agg(F.sum("_pd_leaves").alias("_pd_l"), F.sum("_pd_came").alias("_pd_c"))
    before = Window.partitionBy(*own).orderBy("_pd_shard").rowsBetween(Window.unboundedPreceding, -1)
    passing = F.coalesce(F.sum(F.col("_pd_l") - F.col("_pd_c")).over(before), F.lit(0)) - F.col("_pd_c")
    whole = sums.withColumn("_pd_n", passing).where("_pd_n > 0")
    whole = whole.select(*own, "_pd_shard", F.col("_pd_shard").alias("_pd_s"), (F.col("_pd_shard") + shard_ms).alias("_pd_e"), F.lit(1).alias("_pd_came"))
    pieces = pieces.drop("_pd_leaves").unionByName(whole)

    in_shard = Window.partitionBy(*own, "_pd_shard").orderBy("_pd_s", "_pd_e")
    reach = F.max("_pd_e").over(in_shard.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("_pd_new", F.when(F.col("_pd_s") <= reach, 0).otherwise(1))
    islands = islands.withColumn("_pd_n", F.sum("_pd_new").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    local = islands.groupBy(*own, "_pd_shard", "_pd_n").agg(F.min("_pd_s").alias("_pd_s"), F.max("_pd_e").alias("_pd_e"), F.max("_pd_came").alias("_pd_came"))

    along = Window.partitionBy(*own, "_pd_shard").orderBy("_pd_s")
    local = local.withColumn("_pd_next", F.lead("_pd_s").over(along)).withColumn("_pd_prev", F.lag("_pd_e").over(along))
    edge = F.col("_pd_next").isNull() | F.col("_pd_prev").isNull()
    # Edges of an entity meet in one group (bucket NULL); all other local periods stay with their shard.
    local = local.withColumn("_pd_bucket", F.when(~edge, F.col("_pd_shard")))
    chain = Window.partitionBy(*own, "_pd_bucket").orderBy("_pd_s")
    local = local.withColumn("_pd_before", F.lag("_pd_e").over(chain)).withColumn("_pd_before_shard", F.lag("_pd_shard").over(chain))
    # A period that came from an earlier shard goes on from the last edge before it, however many shards lie between.
    joins = F.col("_pd_bucket").isNull() & (F.col("_pd_before_shard") != F.col("_pd_shard")) & ((F.col("_pd_before") == F.col("_pd_s")) | (F.col("_pd_came") == 1))
    local = local.withColumn("_pd_new", F.when(joins, 0).otherwise(1))
    local = local.withColumn("_pd_chain", F.sum("_pd_new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    # The gap before a local period: to the neighbour in its shard, else to the last edge of an earlier shard.
    across = F.when(F.col("_pd_bucket").isNull() & (F.col("_pd_new") == 1), F.col("_pd_before"))
    local = local.withColumn("_pd_gap", F.coalesce("_pd_prev", across))
    merged = local.groupBy(*own, "_pd_bucket", "_pd_chain").agg(
        F.min("_pd_s").alias("_pd_s"),
        F.max("_pd_e").alias("_pd_e"),
        F.min_by("_pd_gap", "_pd_s").alias("_pd_gap"),
    )
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_pd_s").alias("start_ms"), F.col("_pd_e").alias("end_ms")),
        F.when(
            (F.col("_pd_gap") < F.col("_pd_s")) & (F.col("_pd_s") - F.col("_pd_gap") < recording_pause_ms),
            F.struct(F.lit("gap").alias("kind"), F.col("_pd_gap").alias("start_ms"), F.col("_pd_s").alias("end_ms")),
        ),
    )
    out = merged.select(*own, F.explode(rows).alias("_pd_row")).where(F.col("_pd_row").isNotNull())
    return out.select(*own, "_pd_row.kind", "_pd_row.start_ms", "_pd_row.end_ms")


def known_types(labels: DataFrame) -> DataFrame:
    """_k, _t: the event types of the label table by their letters, as a local table of proven size."""
    rows = labels.groupBy(compact(F.col("event_type")).alias("_k")).agg(F.min("event_type").alias("_t")).where("_k IS NOT NULL").limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError("the table of known labels must stay small")
    return labels.sparkSession.createDataFrame(rows, "_k string, _t string")


def event_tracks(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Audio events with ``track``: the event type as spelled in the label table, compared by letters only.

    A type that is in no row of the label table keeps its own trimmed spelling; NULL becomes ''.
    """
    known = known_types(labels)
    e = events.select("video_id", "event_type", "start_sec", "end_sec").withColumn("_k", compact(F.col("event_type")))
    e = e.join(F.broadcast(known), "_k", "left")
    return e.select("video_id", F.coalesce("_t", F.trim("event_type"), F.lit("")).alias("track"), "start_sec", "end_sec")


def p1_found(spark, folder: str) -> DataFrame:
    """Periods and gaps of every video: per event type in audio_events, of all speech in speaker_segments."""
    events = event_tracks(table(spark, folder, "audio_events"), table(spark, folder, "audio_labels"))
    speech = table(spark, folder, "speaker_segments").select("video_id", F.lit("").alias("track"), "start_sec", "end_sec")
    both = events.withColumn("source", F.lit("audio_events")).unionByName(speech.withColumn("source", F.lit("speaker_segments")))
    return merge_periods(both, ["source", "video_id", "track"])


#: The same in SQL (the running maximum over a whole track; no shards).
P1_SQL = """WITH types AS (SELECT DISTINCT event_type, regexp_replace(lower(event_type), '[^a-z]', '', 'g') AS k FROM audio_labels),
spans AS (SELECT 'audio_events' AS source, e.video_id, coalesce(t.event_type, trim(e.event_type), '') AS track, start_sec, end_sec
    FROM audio_events e LEFT JOIN types t ON regexp_replace(lower(e.event_type), '[^a-z]', '', 'g') = t.k
  UNION ALL SELECT 'speaker_segments', video_id, '', start_sec, end_sec FROM speaker_segments),
ms AS (SELECT source, video_id, track, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM spans WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL),
reach AS (SELECT *, max(e) OVER (PARTITION BY source, video_id, track ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ms WHERE s < e),
isl AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY source, video_id, track ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM reach),
per AS (SELECT source, video_id, track, i, min(s) AS start_ms, max(e) AS end_ms FROM isl GROUP BY source, video_id, track, i),
gaps AS (SELECT source, video_id, track, lag(end_ms) OVER (PARTITION BY source, video_id, track ORDER BY start_ms) AS a, start_ms AS b FROM per)
SELECT source, video_id, track, 'period' AS kind, start_ms, end_ms FROM per
UNION ALL SELECT source, video_id, track, 'gap', a, b FROM gaps WHERE b - a < 3600000"""
