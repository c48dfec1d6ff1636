"""Clean, ordered speaker turns from transcripts.

Each transcript row is parsed where it is read (grammar in ``speech``); only start, end, speaker and letter
count of each segment travel on. Missing speakers are found by a bucketed overlap join with the speaker
rows, so a video with very many of them is spread over time buckets. Turns are runs of one speaker.

Defined results: of several rows of a video the latest counts (NULL times first; ties: greatest segments);
NULL or empty segments_json means the raw text holds, NULL or empty text means no turns; exact repeats of a
segment count once; segments without a start take the place after the one before them; a segment without an
end is open for OPEN_END_MS; one whose end is not after its start, or without a start, has no speaker of its
own to find (''), and so has one that no valid speaker row overlaps; of equal overlaps the earliest row wins,
then the first name. Times beyond 9e12 seconds are no times. NULL video ids are dropped. Extra columns are
ignored. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplake.functions.clean import to_ms
from cliplake.llm.speech import letters, read_segments, speaker_name
from cliplake.session import written
from cliplake.sources.tables import table

_SEG = pa.struct([("pos", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("who", pa.string()), ("n", pa.int64()), ("text", pa.string())])
_SEG_DDL = "array<struct<pos:int,s:bigint,e:bigint,who:string,n:bigint,text:string>>"
BUCKET_MS = 300_000
#: Transcripts parsed at a time.
SLICE_ROWS = 1024
#: Bucket widths, each eight times the one before; the last one holds any time there is.
LEVELS = 14
#: A segment without an end lasts so long.
OPEN_END_MS = 40 * 60_000


def ordered_segments(segments_json: str | None, text_full: str | None, keep_text: bool = False) -> list[dict]:
    """The segments that have speech, ordered by start, exact repeats once."""
    rows, seen, carried = [], set(), None
    for s in read_segments(segments_json, text_full):
        if s.key in seen:
            continue
        seen.add(s.key)
        carried = s.start_ms if s.start_ms is not None else carried
        if n := letters(s.spoken):
            at = carried if carried is not None else -(1 << 60)
            rows.append((at, s.position, {"s": s.start_ms, "e": s.end_ms, "who": s.speaker, "n": n, "text": " ".join(s.spoken.split()) if keep_text else None}))
    rows.sort(key=lambda r: r[:2])
    return [{"pos": i, **r[2]} for i, r in enumerate(rows)]


def parsed(transcripts: DataFrame, keep_text: bool = False) -> DataFrame:
    """video_id, segs: of each video's latest transcript."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, SLICE_ROWS) for x in batches for at in range(0, x.num_rows, SLICE_ROWS)):
            _, _, segments, texts = (c.to_pylist() for c in b.columns)
            segs = [ordered_segments(j, t, keep_text) for j, t in zip(segments, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(segs, pa.list_(_SEG))], ["video_id", "made", "segs"])

    rows = transcripts.where("video_id IS NOT NULL").select("video_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("made"), "segments_json", "text_full")
    rows = rows.mapInArrow(run, f"video_id string, made bigint, segs {_SEG_DDL}")
    return rows.groupBy("video_id").agg(F.max(F.struct("made", "segs")).alias("r")).select("video_id", "r.segs")


def _div(a, width):
    return F.floor(a / width).cast("long")


def _width(level):
    return F.lit(BUCKET_MS) * F.pow(F.lit(8.0), level).cast("long")


def _level(length):
    """The level at which an interval of this length touches at most two buckets."""
    k = F.ceil(F.log(8.0, length / F.lit(BUCKET_MS))).cast("int")
    return F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.coalesce(k, F.lit(0))))


def _slots(start, end, levels):
    """(level, bucket) of every bucket that the interval touches at each of the levels."""
    at = lambda k: F.transform(F.sequence(_div(start, _width(k)), _div(end - 1, _width(k))), lambda x: F.struct(k.alias("level"), x.alias("bucket")))
    return F.explode(F.flatten(F.transform(levels, at)))


def with_speakers(segs: DataFrame, speaker_rows: DataFrame) -> DataFrame:
    """``segs`` (video_id, pos, s, e, who, n, text) with ``speaker``: their own, or that of the row that overlaps longest.

    Both sides have the level of bucket widths at which they touch at most two buckets, and a pair meets at
    the greater of its two levels: so a segment of any length has few look-ups, and only true neighbours in
    time meet. Segments look up their own level and those above it that any row has; rows are also put on the
    levels above their own that any segment without a speaker has (none, as long as segments are short).
    All other segments pass through the left join without a partner.
    """
    name = F.pandas_udf(lambda s: s.map(lambda v: speaker_name(v) or ""), "string")
    rows = speaker_rows.where("end_sec > start_sec").select(
        "video_id", name("speaker").alias("name"), to_ms(F.col("start_sec")).alias("rs"), to_ms(F.col("end_sec")).alias("re")
    )
    rows = rows.where("rs IS NOT NULL AND re > rs").withColumn("own", _level(F.col("re") - F.col("rs")))
    segs = segs.withColumn("far", F.coalesce(F.col("e"), F.col("s") + OPEN_END_MS))
    segs = segs.withColumn("own", F.when(F.col("who").isNull() & (F.col("far") > F.col("s")), _level(F.col("far") - F.col("s"))))
    # At most LEVELS numbers from each side.
    there = lambda df: sorted(r[0] for r in df.select("own").where("own IS NOT NULL").distinct().collect())
    of_rows, of_segs = there(rows), there(segs)
    levels = lambda found: F.filter(F.array(*[F.lit(k) for k in found]).cast("array<int>"), lambda k: k > F.col("own"))
    own = F.array(F.col("own"))
    rows = rows.withColumn("slot", _slots(F.col("rs"), F.col("re"), F.concat(own, levels(of_segs))))
    rows = rows.select("video_id", "name", "rs", "re", F.col("own").alias("r_own"), "slot.level", "slot.bucket")
    lost = segs.where("own IS NOT NULL").withColumn("slot", _slots(F.col("s"), F.col("far"), F.concat(own, levels(of_rows))))
    lost = lost.select("video_id", "pos", "s", "far", "own", "slot.level", "slot.bucket")
    pairs = lost.join(rows, ["video_id", "level", "bucket"]).where(F.col("level") == F.greatest("own", "r_own"))
    overlap = F.least("far", "re") - F.greatest("s", "rs")
    best = pairs.where(overlap > 0).groupBy("video_id", "pos").agg(F.min(F.struct((-overlap).alias("o"), "rs", "name")).alias("best"))
    found = segs.join(best, ["video_id", "pos"], "left")
    return found.select("video_id", "pos", "n", "text", F.coalesce("who", "best.name", F.lit("")).alias("speaker"))


def speaker_turns(transcripts: DataFrame, speaker_rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """video_id, turn_no, speaker, n_letters (and text with ``keep_text``)."""
    segs = written(parsed(transcripts, keep_text), "segments")  # parsed once, read three times
    flat = with_speakers(segs.select("video_id", F.explode("segs").alias("x")).select("video_id", "x.*"), speaker_rows)
    w = Window.partitionBy("video_id").orderBy("pos")  # the segments of one transcript row
    new = F.when(F.lag("speaker").over(w) == F.col("speaker"), 0).otherwise(1)
    flat = flat.withColumn("new", new).withColumn("turn", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    extra = [F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text")] if keep_text else []
    return flat.groupBy("video_id", F.col("turn").cast("long").alias("turn_no")).agg(F.first("speaker").alias("speaker"), F.sum("n").alias("n_letters"), *extra)


def p4_found(spark, folder: str) -> DataFrame:
    """The speaker turns of every transcript."""
    return speaker_turns(table(spark, folder, "transcripts"), table(spark, folder, "speaker_segments"))
