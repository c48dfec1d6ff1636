"""Audio events: label classes, sliding windows, merged neighbours, timeline summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplake.functions.clean import compact
from cliplake.functions.text import round_binary
from cliplake.operators.periods import known_types
from cliplake.operators.sequence import time_shard

#: Classes of sound labels (fixed values); any other label is 'sound_effect'.
LABEL_CLASSES = {
    "music": (
        "Music", "Musical instrument", "Singing", "Song", "Guitar", "Acoustic guitar", "Electric guitar", "Piano", "Keyboard (musical)", "Drum", "Drum kit", "Bass guitar", "Violin",
        "Trumpet", "Flute", "Saxophone", "Hip hop music", "Pop music", "Rock music", "Electronic music", "Jazz",
    ),
    "speech": (
        "Speech", "Narration, monologue", "Conversation", "Male speech, man speaking", "Female speech, woman speaking", "Child speech, kid speaking", "Whispering",
    ),
    "silence": ("Silence",),
    "applause": ("Applause", "Clapping", "Cheering", "Crowd", "Laughter"),
}


def classify_label(label: Column) -> Column:
    """The class of a known sound label, 'sound_effect' otherwise (NULL included)."""
    out = F.when(F.lit(False), F.lit(""))
    for name, labels in LABEL_CLASSES.items():
        out = out.when(label.isin(*labels), F.lit(name))
    return out.otherwise(F.lit("sound_effect"))


def clean_events(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Each event id once, with the label table's spelling of its type; events without times are left out."""
    e = events.where("start_sec IS NOT NULL AND end_sec IS NOT NULL").withColumn("_k", compact(F.col("event_type")))
    e = e.join(F.broadcast(known_types(labels)), "_k", "left").withColumn("event_type", F.coalesce("_t", "event_type")).withColumn("label", F.coalesce("label", F.lit("")))
    return e.select("id", "video_id", "event_type", "label", "start_sec", "end_sec", "confidence").dropDuplicates(["id"])


def merge_adjacent(events: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Runs of one type in which every event starts within ``tolerance`` of the end of the one before.

    A run keeps the label and start of its first event, the end of its last one, the greatest confidence, and
    is named by its first event (``first_id``). Runs are built inside (video, time shard); only the first and
    the last run of a shard can go on in another one, and just those meet in one group of the video.
    """
    rows = events.withColumn("shard", time_shard(F.col("start_sec")))
    inner = Window.partitionBy("video_id", "shard").orderBy("start_sec", "id")
    same = (F.lag("event_type").over(inner) == F.col("event_type")) & (F.abs(F.col("start_sec") - F.lag("end_sec").over(inner)) < tolerance)
    rows = rows.withColumn("new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("n", F.sum("new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.struct("start_sec", "id", "event_type", "label"), F.struct("start_sec", "id", "end_sec")
    runs = rows.groupBy("video_id", "shard", "n").agg(F.min(first).alias("first"), F.max(last).alias("last"), F.max("confidence").alias("confidence"))
    along = Window.partitionBy("video_id", "shard").orderBy("n")
    edge = (F.col("n") == 1) | F.lead("n").over(along).isNull()
    runs = runs.withColumn("inner", F.when(~edge, F.col("shard"))).withColumn("inside", ~edge)
    chain = Window.partitionBy("video_id", "inner", "inside").orderBy("first.start_sec", "first.id")
    joins = ~F.col("inside") & ~F.lag("shard").over(chain).eqNullSafe(F.col("shard")) & (F.lag("first.event_type").over(chain) == F.col("first.event_type"))
    joins = joins & (F.abs(F.col("first.start_sec") - F.lag("last.end_sec").over(chain)) < tolerance)
    runs = runs.withColumn("new", F.when(joins, 0).otherwise(1))
    runs = runs.withColumn("chain", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("video_id", "inner", "inside", "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("confidence").alias("confidence"))
    return out.select("video_id", F.col("first.id").alias("first_id"), "first.event_type", "first.label", "first.start_sec", "last.end_sec", "confidence")


def audio_timeline(merged: DataFrame, durations: DataFrame) -> DataFrame:
    """Per video: seconds of music and silence as shares of its duration, the longest type (first seen on ties).

    ``durations``: video_id, duration_sec. A missing, zero or negative duration gives the defaults. Spans are
    added up in whole microseconds, so the sums do not hang on the order of the rows.
    """
    span = F.round((F.col("end_sec") - F.col("start_sec")) * 1e6).cast("bigint")
    by_type = merged.groupBy("video_id", "event_type").agg(F.sum(span).alias("us"), F.min(F.struct("start_sec", "first_id")).alias("first"))
    per = by_type.groupBy("video_id").agg(
        F.sum(F.when(F.col("event_type") == "music", F.col("us")).otherwise(0)).alias("music"),
        F.sum(F.when(F.col("event_type") == "silence", F.col("us")).otherwise(0)).alias("silence"),
        F.max_by("event_type", F.struct("us", -F.col("first.start_sec"), -F.col("first.first_id"))).alias("dominant"),
    )
    d = durations.join(per, "video_id", "left")
    ok = F.col("duration_sec") > 0
    ratio = lambda c: F.coalesce(F.when(ok, round_binary(F.col(c) / 1e6 / F.col("duration_sec"), 3)), F.lit(0.0))
    return d.select(
        "video_id",
        F.coalesce(ok & (F.col("music") > 0), F.lit(False)).alias("has_music"),
        ratio("music").alias("music_ratio"),
        ratio("silence").alias("silence_ratio"),
        F.coalesce(F.when(ok, F.col("dominant")), F.lit("")).alias("dominant_type"),
    )


def sliding_windows(signals: DataFrame, length: Column, rate: int, window_sec: float = 2.0, hop_sec: float = 1.0) -> DataFrame:
    """Adds window_no, start_sec, end_sec: only full windows over ``length`` samples."""
    size, hop = int(window_sec * rate), int(hop_sec * rate)
    starts = F.when(length >= size, F.sequence(F.lit(0).cast("long"), (length - size).cast("long"), F.lit(hop).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = signals.select("*", F.posexplode(starts).alias("window_no", "_at"))
    return out.withColumn("start_sec", round_binary(F.col("_at") / rate, 1)).withColumn("end_sec", round_binary((F.col("_at") + size) / rate, 1)).drop("_at")


def top_class(probabilities: Column) -> Column:
    """Index of the greatest probability; the first of equal ones."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1
