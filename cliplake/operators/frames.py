"""Keyframes: sampling, first and last guarantee, protected trimming, hybrid fill, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_sample(videos: DataFrame, count: Column) -> DataFrame:
    """``videos`` (video_id, duration_sec): up to ``count`` evenly spaced times, at least a second apart, before the end."""
    step = F.greatest(F.col("duration_sec") / (count + 1), F.lit(1.0))
    out = videos.where((F.col("duration_sec") > 0) & (count > 0)).select("video_id", "duration_sec", step.alias("step"), F.explode(F.sequence(F.lit(1), count.cast("int"))).alias("i"))
    return out.withColumn("timestamp_sec", F.col("step") * F.col("i")).where("timestamp_sec < duration_sec").select("video_id", "i", "timestamp_sec")


def first_last_guard(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames (video_id, timestamp_sec, id, score) with a first frame (0.1 s) and a last one (0.5 s before the end) where none is near.

    Driven by the videos, so a video without frames gets both. Adds pos: first, originals by time, last.
    """
    near = frames.groupBy("video_id").agg(F.min("timestamp_sec").alias("lo"), F.max("timestamp_sec").alias("hi"))
    v = videos.where("duration_sec > 0").join(near, "video_id", "left")
    first = v.where("lo IS NULL OR lo >= 0.5").select("video_id", F.lit(0).alias("part"), F.lit(0.1).alias("timestamp_sec"), F.lit(-1).cast("long").alias("id"), F.lit(0.0).alias("score"))
    last = v.where("(hi IS NULL OR hi <= duration_sec - 1.0) AND duration_sec > 1.0")
    last = last.select("video_id", F.lit(2).alias("part"), (F.col("duration_sec") - 0.5).alias("timestamp_sec"), F.lit(-2).cast("long").alias("id"), F.lit(0.0).alias("score"))
    own = frames.join(videos.where("duration_sec > 0").select("video_id"), "video_id", "left_semi")
    own = own.select("video_id", F.lit(1).alias("part"), "timestamp_sec", "id", "score")
    w = Window.partitionBy("video_id").orderBy("part", "timestamp_sec", "id")
    out = first.unionByName(own).unionByName(last)
    return out.withColumn("pos", F.row_number().over(w) - 1).drop("part")


def keyframe_trim(frames: DataFrame, most: int) -> DataFrame:
    """At most ``most`` frames of a video: the interior frames of lowest score go first, the earlier of equal ones."""
    video = Window.partitionBy("video_id")
    n = F.count("*").over(video)
    ends = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    f = frames.withColumn("n", n).withColumn("edge", ends)
    rank = F.row_number().over(Window.partitionBy("video_id", "edge").orderBy("score", "pos"))
    f = f.withColumn("rank", rank).where("edge OR rank > n - " + str(most))
    keep = F.row_number().over(video.orderBy("pos"))
    return f.withColumn("keep", keep).where(F.col("keep") <= most).drop("n", "edge", "rank", "keep")


def reindex(frames: DataFrame) -> DataFrame:
    """frame_index by time (ties by id), from 0."""
    w = Window.partitionBy("video_id").orderBy("timestamp_sec", "id")
    return frames.withColumn("frame_index", (F.row_number().over(w) - 1).cast("int"))


def hybrid_fill(videos: DataFrame, scene: DataFrame, most: int, apart: float = 1.0) -> DataFrame:
    """Scene frames plus interval frames that keep ``apart`` seconds from every scene frame, ``most`` in all.

    The anti-join runs on whole-second buckets, so only frames of neighbouring seconds are compared.
    """
    found = scene.groupBy("video_id").agg(F.count("*").alias("found"))
    v = videos.join(found, "video_id", "left").withColumn("slots", F.greatest(F.lit(0), F.lit(most) - F.coalesce("found", F.lit(0))))
    sampled = interval_sample(v, F.col("slots")).join(v.select("video_id", "slots"), "video_id")
    second = lambda c: F.floor(F.col(c) / apart).cast("long")
    near = scene.select("video_id", F.col("timestamp_sec").alias("ts")).withColumn("b", F.explode(F.sequence(second("ts") - 1, second("ts") + 1)))
    a, b = sampled.withColumn("b", second("timestamp_sec")).alias("a"), near.alias("b")
    same = (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.b") == F.col("b.b")) & (F.abs(F.col("a.timestamp_sec") - F.col("b.ts")) < apart)
    left = a.join(b, same, "left_anti")
    w = Window.partitionBy("video_id").orderBy("timestamp_sec")
    left = left.withColumn("r", F.row_number().over(w)).where("r <= slots")
    return scene.select("video_id", "timestamp_sec", F.lit("scene").alias("strategy")).unionByName(left.select("video_id", "timestamp_sec", F.lit("interval").alias("strategy")))
