"""Speaker of every transcript segment: the turn with the largest overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplake.session import written

BUCKET_SEC = 60.0
#: Bucket widths, each eight times the one before; at the last one 9e12 seconds touch two buckets.
LEVELS = 14


def _level(start: Column, end: Column) -> Column:
    """The level at which the interval touches at most two buckets."""
    return F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log(8.0, (end - start) / BUCKET_SEC)).cast("int")))


def _slots(start: Column, end: Column, levels: Column) -> Column:
    at = lambda c, k: F.floor(c / (F.lit(BUCKET_SEC) * F.pow(F.lit(8.0), k))).cast("long")
    return F.explode(F.flatten(F.transform(levels, lambda k: F.transform(F.sequence(at(start, k), at(end, k)), lambda x: F.struct(k.alias("level"), x.alias("bucket"))))))


def speaker_align(segments: DataFrame, turns: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """segments (video_id, seg_no, start_sec, end_sec) with ``speaker`` and ``overlap``.

    turns: video_id, turn_no, speaker, start_sec, end_sec. The largest overlap of one turn wins, the earlier
    turn on ties; it counts if it is at least ``tolerance``, or if the segment is shorter than twice that;
    otherwise the speaker is ''. Times beyond 9e12 seconds are no times. The range join runs on time buckets:
    both sides have a level of widths by their length, and a pair meets at the greater of its two levels, so
    only neighbours in time are paired, however long a turn or a segment is.
    """
    segments = written(segments.select("video_id", "seg_no", "start_sec", "end_sec"), "align-segments")  # read three times
    ok = "start_sec < end_sec AND abs(start_sec) < 9e12 AND abs(end_sec) < 9e12"
    s, e, own = F.col("start_sec"), F.col("end_sec"), F.array("own")
    t, g = (df.where(ok).withColumn("own", _level(s, e)) for df in (turns, segments))
    there = lambda df: sorted(r[0] for r in df.select("own").distinct().collect())  # noqa: E731 - at most LEVELS numbers
    above = lambda found: F.filter(F.array(*[F.lit(k) for k in found]).cast("array<int>"), lambda k: k > F.col("own"))
    of_turns, of_segments = there(t), there(g)
    t = t.withColumn("slot", _slots(s, e, F.concat(own, above(of_segments))))
    t = t.select("video_id", "slot.level", "slot.bucket", F.col("own").alias("t_own"), "turn_no", F.col("speaker").alias("t_speaker"), s.alias("t_start"), e.alias("t_end"))
    g = g.withColumn("slot", _slots(s, e, F.concat(own, above(of_turns)))).select("video_id", "seg_no", s, e, "own", "slot.level", "slot.bucket")
    overlap = F.least("end_sec", "t_end") - F.greatest("start_sec", "t_start")
    pairs = g.join(t, ["video_id", "level", "bucket"]).where(F.col("level") == F.greatest("own", "t_own")).withColumn("ov", overlap).where("ov > 0")
    best = pairs.groupBy("video_id", "seg_no", "start_sec", "end_sec").agg(F.max_by(F.struct("ov", "t_speaker"), F.struct("ov", -F.coalesce("turn_no", F.lit(0)))).alias("b"))
    out = segments.select("video_id", "seg_no", s, e).distinct().join(best, ["video_id", "seg_no", "start_sec", "end_sec"], "left")
    takes = (F.col("b.ov") >= tolerance) | ((F.col("b.ov") > 0) & (e - s < 2 * tolerance))
    return out.select("video_id", "seg_no", s, e, F.when(takes, F.col("b.t_speaker")).otherwise("").alias("speaker"), F.coalesce("b.ov", F.lit(0.0)).alias("overlap"))
