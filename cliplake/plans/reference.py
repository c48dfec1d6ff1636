"""The operator queries with their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliplake.functions import text as X
from cliplake.functions import urls as U
from cliplake.operators import align, audio, frames, store
from cliplake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- common inputs

UPDATED = ("title", "uploader", "upload_date", "duration_sec", "file_path", "file_size_bytes", "status", "error_message")
FIXED = ("platform", "platform_id", "url")


def videos(spark, d) -> DataFrame:
    """One row per video: all crawls folded."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    v = table(spark, d, "videos").withColumn("seen", us("updated_at")).withColumn("born", us("created_at"))
    return store.fold_upserts(v, "id", "seen", UPDATED, FIXED, F.min("born").alias("created_us"))


_V = f"""V AS (SELECT id, {', '.join(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN updated_at END) AS {c}" for c in UPDATED)},
  {', '.join(f"min_by({c}, updated_at) AS {c}" for c in FIXED)}, epoch_us(min(created_at)) AS created_us FROM videos GROUP BY id)"""


def url_of(platform="platform", pid="platform_id"):
    """A URL on the platform's own host (the stored hosts are placeholders)."""
    return (
        F.when(F.col(platform) == "youtube", F.concat(F.lit("https://youtube.com/shorts/"), F.col(pid)))
        .when(F.col(platform) == "instagram", F.concat(F.lit("https://www.instagram.com/reel/"), F.col(pid), F.lit("/")))
        .when(F.col(platform) == "tiktok", F.concat(F.lit("https://www.tiktok.com/@u/video/"), F.length(pid), F.length("url")))
        .otherwise(F.col("url"))
    )


_URL = """CASE platform WHEN 'youtube' THEN 'https://youtube.com/shorts/' || platform_id
  WHEN 'instagram' THEN 'https://www.instagram.com/reel/' || platform_id || '/'
  WHEN 'tiktok' THEN 'https://www.tiktok.com/@u/video/' || length(platform_id) || length(url) ELSE url END"""

_TCOLS = ("language", "text_full", "segments_json", "whisper_model", "duration_sec")


def transcripts(spark, d) -> DataFrame:
    t = table(spark, d, "transcripts").withColumn("made", F.unix_micros(F.col("created_at").cast("timestamp")))
    return store.latest(t, "video_id", "made", _TCOLS)


_T = """T AS (SELECT * EXCLUDE (r) FROM (SELECT video_id, language, text_full, segments_json, whisper_model, duration_sec,
  row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, language DESC NULLS LAST, text_full DESC NULLS LAST, segments_json DESC NULLS LAST, whisper_model DESC NULLS LAST, duration_sec DESC NULLS LAST) AS r FROM transcripts) WHERE r = 1)"""

_ACOLS = ("summary", "topics_json", "hooks_json", "style_json", "engagement_signals_json", "full_json")


def analyses(spark, d) -> DataFrame:
    a = table(spark, d, "analyses").withColumn("made", F.unix_micros(F.col("created_at").cast("timestamp")))
    return store.latest(a, "video_id", "made", _ACOLS)


_A = """A AS (SELECT * EXCLUDE (r) FROM (SELECT video_id, summary, topics_json, hooks_json, style_json, engagement_signals_json, full_json,
  row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, summary DESC NULLS LAST, topics_json DESC NULLS LAST, hooks_json DESC NULLS LAST, style_json DESC NULLS LAST, engagement_signals_json DESC NULLS LAST, full_json DESC NULLS LAST) AS r FROM analyses) WHERE r = 1)"""


def keyframes(spark, d) -> DataFrame:
    return table(spark, d, "keyframes").distinct()


_K = "K AS (SELECT DISTINCT * FROM keyframes)"


def events(spark, d) -> DataFrame:
    return audio.clean_events(table(spark, d, "audio_events"), table(spark, d, "audio_labels"))


_E = """E AS (SELECT DISTINCT e.id, e.video_id, coalesce(t.event_type, e.event_type) AS event_type, coalesce(e.label, '') AS label, e.start_sec, e.end_sec, e.confidence
  FROM audio_events e LEFT JOIN (SELECT DISTINCT event_type, regexp_replace(lower(event_type), '[^a-z]', '', 'g') AS k FROM audio_labels) t
  ON regexp_replace(lower(e.event_type), '[^a-z]', '', 'g') = t.k WHERE e.start_sec IS NOT NULL AND e.end_sec IS NOT NULL)"""
_M = """F AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND abs(start_sec - lag(end_sec) OVER w) < 0.5 THEN 0 ELSE 1 END AS new FROM E WINDOW w AS (PARTITION BY video_id ORDER BY start_sec, id)),
  I AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY start_sec, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM F),
  M AS (SELECT video_id, arg_min(id, (start_sec, id)) AS first_id, arg_min(event_type, (start_sec, id)) AS event_type, arg_min(label, (start_sec, id)) AS label, arg_min(start_sec, (start_sec, id)) AS start_sec,
  arg_max(end_sec, (start_sec, id)) AS end_sec, max(confidence) AS confidence FROM I GROUP BY video_id, island)"""

SEGMENTS = "array<struct<start:string,end:string,text:string,speaker:string,offsets:struct<`from`:string,`to`:string>>>"


def _seconds(value, ms):
    """A number of seconds, a clock text ('00:01:02,5'), or else milliseconds from the offsets."""
    clock = F.when(value.rlike(r"^\d+(:\d+){1,2}([.,]\d+)?$"), F.aggregate(F.split(F.replace(value, F.lit(","), F.lit(".")), ":"), F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double")))
    return F.coalesce(value.try_cast("double"), clock, ms.try_cast("double") / 1000)


def segments(spark, d) -> DataFrame:
    """Segments with times in seconds: video_id, seg_no, start_sec, end_sec, text, speaker."""
    t = transcripts(spark, d).select("video_id", F.posexplode(X.array_or_empty(F.col("segments_json"), SEGMENTS)).alias("seg_no", "s"))
    return t.select("video_id", "seg_no", _seconds(F.col("s.start"), F.col("s.offsets.from")).alias("start_sec"), _seconds(F.col("s.end"), F.col("s.offsets.to")).alias("end_sec"), F.col("s.text").alias("text"), F.col("s.speaker").alias("speaker"))


def _sec(name: str, offset: str) -> str:
    v, clock = f"json_extract_string(a[i + 1], '$.{name}')", "'^\\d+(:\\d+){1,2}([.,]\\d+)?$'"
    parts = f"list_transform(string_split(replace({v}, ',', '.'), ':'), lambda x: CAST(x AS DOUBLE))"
    return f"coalesce(try_cast({v} AS DOUBLE), CASE WHEN regexp_matches({v}, {clock}) THEN list_reduce({parts}, lambda p, x: p * 60 + x) END, try_cast(json_extract_string(a[i + 1], '$.offsets.{offset}') AS DOUBLE) / 1000)"


_S = f"""{_T}, J AS (SELECT video_id, from_json(CASE WHEN coalesce(segments_json, '') = '' THEN '[]' ELSE segments_json END, '["JSON"]') AS a FROM T),
  S AS (SELECT video_id, CAST(i AS INT) AS seg_no, {_sec('start', 'from')} AS start_sec, {_sec('end', 'to')} AS end_sec,
  json_extract_string(a[i + 1], '$.text') AS text, json_extract_string(a[i + 1], '$.speaker') AS speaker FROM (SELECT video_id, a, unnest(range(len(a))) AS i FROM J))"""


def turns(spark, d) -> DataFrame:
    s = table(spark, d, "speaker_segments").where("start_sec < end_sec").distinct()
    w = Window.partitionBy("video_id").orderBy("start_sec", "end_sec", "speaker")
    return s.withColumn("turn_no", F.row_number().over(w))


_R = "R AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, speaker) AS turn_no FROM (SELECT DISTINCT * FROM speaker_segments WHERE start_sec < end_sec))"


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# ---------------------------------------------------------------- scans


@query(with_sql(_V) + "SELECT id AS video_id, platform, title, status FROM V WHERE id IN (SELECT video_id FROM analyses)")
def point_lookup_video(spark, d):
    """The rows of a given set of video ids (here: all ids that have an analysis)."""
    wanted = table(spark, d, "analyses").select(F.col("video_id").alias("id"))
    return videos(spark, d).join(wanted, "id", "left_semi").select(F.col("id").alias("video_id"), "platform", "title", "status")


@query(with_sql(_V) + "SELECT url, arg_min(id, (created_us, id)) AS video_id FROM V GROUP BY url")
def lookup_by_url(spark, d):
    return videos(spark, d).groupBy("url").agg(F.min_by("id", F.struct("created_us", "id")).alias("video_id"))


@query(with_sql(_T) + "SELECT video_id, language, whisper_model, length(text_full) AS n_chars FROM T WHERE video_id IN (SELECT id FROM videos)")
def transcript_lookup(spark, d):
    ids = table(spark, d, "videos").select(F.col("id").alias("video_id"))
    return transcripts(spark, d).join(ids, "video_id", "left_semi").select("video_id", "language", "whisper_model", F.length("text_full").cast("bigint").alias("n_chars"))


@query(with_sql(_K) + "SELECT video_id, id, timestamp_sec, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, id) AS BIGINT) AS pos FROM K")
def keyframes_ordered(spark, d):
    w = Window.partitionBy("video_id").orderBy("timestamp_sec", "id")
    return keyframes(spark, d).select("video_id", "id", "timestamp_sec", F.row_number().over(w).cast("bigint").alias("pos"))


@query(with_sql(_E) + "SELECT video_id, id, event_type, start_sec, lag(id) OVER (PARTITION BY video_id ORDER BY start_sec, id) AS previous_id FROM E")
def audio_events_ordered(spark, d):
    from cliplake.operators.sequence import time_shard, with_previous

    e = events(spark, d).withColumn("shard", time_shard(F.col("start_sec")))
    e = with_previous(e, ["video_id"], "shard", ["start_sec", "id"], {"previous_id": F.col("id")})
    return e.select("video_id", "id", "event_type", "start_sec", "previous_id")


@query(with_sql(_A) + "SELECT video_id, summary, topics_json FROM A")
def analysis_lookup(spark, d):
    return analyses(spark, d).select("video_id", "summary", "topics_json")


ITEM = {"F": "done", "O": "error", "P": "pending"}
_B = "B AS (SELECT o_custkey AS batch_id, CAST(o_orderkey AS VARCHAR) AS url, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'error' ELSE 'pending' END AS status, epoch_us(o_orderdate) AS changed_us FROM orders)"


def items(spark, d) -> DataFrame:
    """Batch items, from orders: a customer's orders are the items of one batch."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "error").otherwise("pending")
    return o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").cast("string").alias("url"), status.alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("changed_us"))


@query(with_sql(_B) + "SELECT batch_id, url FROM B WHERE status = 'pending'")
def pending_items(spark, d):
    return items(spark, d).where("status = 'pending'").select("batch_id", "url")


@query(with_sql(_B) + "SELECT batch_id, max(changed_us) AS updated_us FROM B GROUP BY batch_id HAVING count_if(status = 'pending') > 0 ORDER BY updated_us DESC, batch_id LIMIT 1")
def latest_batch(spark, d):
    b = items(spark, d).groupBy("batch_id").agg(F.max("changed_us").alias("updated_us"), F.count_if(F.col("status") == "pending").alias("p")).where("p > 0")
    return b.orderBy(F.desc("updated_us"), "batch_id").limit(1).select("batch_id", "updated_us")


def list_rows(v: DataFrame, status: str | None = None, platform: str | None = None, limit: int = 50) -> DataFrame:
    """The newest videos; empty filters don't filter, a negative limit is none."""
    for name, value in (("status", status), ("platform", platform)):
        if value:
            v = v.where(F.col(name) == value)
    v = v.orderBy(F.desc("created_us"), "id")
    v = v.limit(limit) if limit >= 0 else v
    return v.select(F.col("id").alias("video_id"), "platform", "title", "duration_sec", "status", "url")


@query(with_sql(_V) + "SELECT id AS video_id, platform, title, duration_sec, status, url FROM V WHERE status = 'analyzed' AND platform = 'youtube' ORDER BY created_us DESC, id LIMIT 50")
def list_videos(spark, d):
    return list_rows(videos(spark, d), "analyzed", "youtube")


@query("SELECT DISTINCT trim(url) AS url FROM videos WHERE trim(url) <> '' AND NOT starts_with(trim(url), '#')")
def url_list_scan(spark, d):
    """The URL list of the videos, as a text list is read: trimmed, without blank lines and comments."""
    from cliplake.sources.files import clean_urls

    return clean_urls(table(spark, d, "videos").select(F.col("url").alias("value"))).distinct()


@query("SELECT DISTINCT platform_id, url, title, uploader, duration_sec FROM (SELECT platform_id, url, coalesce(title, '') AS title, coalesce(uploader, '') AS uploader, coalesce(duration_sec, 0.0) AS duration_sec FROM videos)")
def browse_ndjson(spark, d):
    """Listing entries as one JSON line each, read back with the listing's defaults; broken lines are dropped."""
    from cliplake.sources.files import browse_entries

    v = table(spark, d, "videos")
    lines = v.select(F.to_json(F.struct(F.col("platform_id").alias("id"), "url", "title", "uploader", F.col("duration_sec").alias("duration"))).alias("value"))
    broken = v.select(F.concat(F.lit("{"), F.col("id")).alias("value"))
    return browse_entries(lines.unionByName(broken), "youtube").select("platform_id", "url", "title", "uploader", "duration_sec").distinct()


@query("SELECT id, coalesce(try_cast(trim(duration_text) AS DOUBLE), 60.0) AS duration_sec FROM (SELECT DISTINCT id, CASE WHEN duration_sec IS NULL THEN 'N/A' ELSE ' ' || CAST(floor(duration_sec) AS BIGINT) || ' ' END AS duration_text FROM videos)")
def duration_fallback(spark, d):
    t = F.when(F.col("duration_sec").isNull(), "N/A").otherwise(F.concat(F.lit(" "), F.floor("duration_sec").cast("string"), F.lit(" ")))
    return table(spark, d, "videos").select("id", t.alias("t")).distinct().select("id", X.duration_of(F.col("t")).alias("duration_sec"))


@query(with_sql(_K) + "SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY id) AS BIGINT) AS n, CAST(floor(timestamp_sec * 1000) AS BIGINT) / 1000.0e0 AS pts FROM K")
def pts_extract(spark, d):
    """Frame times read back from a log text of each video."""
    from cliplake.sources.files import log_times

    line = F.concat(F.lit("[showinfo] n:"), F.col("id").cast("string"), F.lit(" pts_time:"), (F.floor(F.col("timestamp_sec") * 1000) / 1000).cast("decimal(18,3)").cast("string"), F.lit(" x"))
    logs = keyframes(spark, d).groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    return log_times(logs, "log").select("video_id", (F.col("n") + 1).cast("bigint").alias("n"), "pts")


@query(with_sql(_S) + "SELECT video_id, seg_no, start_sec, end_sec, trim(text) AS text FROM S WHERE trim(text) <> ''")
def asr_json_explode(spark, d):
    return segments(spark, d).select("video_id", "seg_no", "start_sec", "end_sec", F.trim("text").alias("text")).where("text <> ''")


@query("SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS class_no, label FROM audio_labels WHERE trim(label) <> ''")
def label_dim(spark, d):
    """The label list with class numbers (a fixed small list)."""
    from cliplake.sources.files import label_list

    return label_list(table(spark, d, "audio_labels").select("label"))


@query()
def wav_decode(spark, d):
    """A generated wave file through the reader: rows of first samples."""
    from cliplake.session import shared_dir
    from cliplake.sources.wav import decode_wavs, write_sample

    folder = f"{shared_dir(spark)}/wav-sample"
    write_sample(spark, folder)
    return decode_wavs(spark, folder).select("rate", "n_samples", F.slice("samples", 1, 4).alias("head"))


# ---------------------------------------------------------------- sinks and changes


@query(with_sql(_V) + "SELECT id AS video_id, platform, platform_id, url, title, uploader, upload_date, duration_sec, file_size_bytes, status FROM V")
def upsert_coalesce(spark, d):
    """All crawls of every video folded into one row: new values over old ones, NULL never over a value."""
    v = videos(spark, d)
    return v.select(F.col("id").alias("video_id"), "platform", "platform_id", "url", "title", "uploader", "upload_date", "duration_sec", "file_size_bytes", "status")


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 4 <> 0),
  s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name || '*' END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END AS bal, 'NEW' AS seg FROM customer WHERE c_custkey % 3 = 0)
  SELECT coalesce(t.k, s.k) AS k, coalesce(s.name, t.name) AS name, coalesce(s.bal, t.bal) AS bal, CASE WHEN t.k IS NOT NULL THEN t.seg ELSE s.seg END AS seg FROM t FULL OUTER JOIN s ON t.k = s.k""")
def upsert_snapshot(spark, d):
    """A batch of rows upserted into a snapshot (customer rows with and without NULLs stand for videos)."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    t = c.where(k % 4 != 0).select(k.alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = c.where(k % 3 == 0).select(k.alias("k"), F.when(k % 2 == 0, F.concat("c_name", F.lit("*"))).alias("name"), F.when(k % 5 != 0, F.col("c_acctbal") + 1).alias("bal"), F.lit("NEW").alias("seg"))
    return store.upsert_coalesce(t, s, "k", ("name", "bal"), ("seg",))


@query(with_sql(_V, _A) + "SELECT id AS video_id, CASE WHEN id IN (SELECT video_id FROM A) THEN 'analyzed' ELSE status END AS status, CASE WHEN id IN (SELECT video_id FROM A) THEN NULL ELSE error_message END AS error_message FROM V")
def status_transition(spark, d):
    """Saving an analysis sets the status and clears the error."""
    changes = analyses(spark, d).select(F.col("video_id").alias("id"), F.lit("analyzed").alias("status"), F.lit(None).cast("string").alias("error_message"))
    return store.set_status(videos(spark, d).select("id", "status", "error_message"), changes, "id").select(F.col("id").alias("video_id"), "status", "error_message")


@query(with_sql(_A) + "SELECT video_id, md5(coalesce(full_json, '')) AS body, summary FROM A")
def replace_latest_wins(spark, d):
    return analyses(spark, d).select("video_id", F.md5(F.coalesce("full_json", F.lit(""))).alias("body"), "summary")


@query(with_sql(_K) + "SELECT id, video_id, CAST(1000000 + row_number() OVER (ORDER BY id) AS BIGINT) AS new_id FROM K")
def assign_ids(spark, d):
    return store.assign_ids(keyframes(spark, d), ["id"], 1_000_000, 16).select("id", "video_id", "new_id")


@query("SELECT DISTINCT platform AS batch_id, url, 'pending' AS status FROM videos")
def batch_fanout(spark, d):
    """A batch of URLs into items (one batch per platform)."""
    b = table(spark, d, "videos").select(F.col("platform").alias("batch_id"), "url").distinct()
    return b.withColumn("status", F.lit("pending"))


@query("SELECT platform AS batch_id, url, count(*) AS n FROM videos GROUP BY platform, url HAVING count(*) > 1")
def batch_dup_check(spark, d):
    return table(spark, d, "videos").groupBy(F.col("platform").alias("batch_id"), "url").agg(F.count("*").alias("n")).where("n > 1")


@query(with_sql(_B) + "SELECT batch_id, count(*) AS total_urls, CAST(count_if(status = 'done') AS BIGINT) AS completed, CAST(count_if(status = 'error') AS BIGINT) AS failed, CAST(count_if(status = 'pending') AS BIGINT) AS pending, CASE WHEN count_if(status = 'pending') = 0 THEN 'completed' ELSE 'interrupted' END AS status FROM B GROUP BY batch_id")
def batch_counters(spark, d):
    return store.batch_counters(items(spark, d))


_ALIGN = f""", P AS (SELECT S.video_id, S.seg_no, S.start_sec, S.end_sec, R.speaker AS spk, R.turn_no, CASE WHEN R.turn_no IS NULL THEN 0 ELSE greatest(0, least(S.end_sec, R.end_sec) - greatest(S.start_sec, R.start_sec)) END AS ov
  FROM (SELECT * FROM S WHERE start_sec < end_sec) S LEFT JOIN R ON R.video_id = S.video_id AND R.start_sec < S.end_sec AND R.end_sec > S.start_sec),
  Q AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg_no ORDER BY ov DESC, turn_no) AS r FROM P)
  SELECT video_id, seg_no, CASE WHEN ov >= 0.5 OR (ov > 0 AND end_sec - start_sec < 1.0) THEN spk ELSE '' END AS speaker, round(ov, 6) AS overlap FROM Q WHERE r = 1"""


@query("WITH " + _S + ", " + _R + _ALIGN)
def speaker_align(spark, d):
    """Each timed segment's speaker by largest overlap with a speaker turn."""
    s = segments(spark, d).where("start_sec < end_sec").select("video_id", "seg_no", "start_sec", "end_sec")
    return align.speaker_align(s, turns(spark, d)).select("video_id", "seg_no", "speaker", F.round("overlap", 6).alias("overlap"))


# ---------------------------------------------------------------- joins and exports


def export_rows(spark, d) -> DataFrame:
    v = videos(spark, d).where("status = 'analyzed'").withColumnRenamed("id", "video_id").drop("created_us")
    a = analyses(spark, d)
    t = transcripts(spark, d).select("video_id", "language", "text_full")
    return v.join(a, "video_id").join(t, "video_id", "left")


_X = "X AS (SELECT V.*, A.* EXCLUDE (video_id), T.language, T.text_full FROM V JOIN A ON A.video_id = V.id LEFT JOIN T ON T.video_id = V.id WHERE V.status = 'analyzed')"
_OBJ = "CASE WHEN json_valid({0}) THEN {0} WHEN json_valid(regexp_extract({0}, '\\{{[\\s\\S]*\\}}')) THEN regexp_extract({0}, '\\{{[\\s\\S]*\\}}') END"


@query(with_sql(_V, _A, _T, _X) + f"SELECT id AS video_id, platform, url, title, uploader, duration_sec, upload_date, coalesce(language, '') AS language, summary, array_to_string(from_json(coalesce(nullif(topics_json, ''), '[]'), '[\"VARCHAR\"]'), ', ') AS topics, coalesce(json_extract_string({_OBJ.format('full_json')}, '$.content_type'), '') AS content_type, coalesce(json_extract_string({_OBJ.format('full_json')}, '$.style.format'), '') AS format, coalesce(json_extract_string({_OBJ.format('full_json')}, '$.style.pacing'), '') AS pacing FROM X")
def export_csv(spark, d):
    """The rows of the CSV export (13 columns), before the sink."""
    return csv_rows(export_rows(spark, d))


def csv_rows(x: DataFrame) -> DataFrame:
    v = X.lenient_json(F.col("full_json"))
    x = x.withColumn("v", v)
    get = lambda p: F.coalesce(F.try_variant_get("v", p, "string"), F.lit(""))
    return x.select(
        "video_id", "platform", "url", "title", "uploader", "duration_sec", "upload_date", F.coalesce("language", F.lit("")).alias("language"), "summary",
        F.array_join(X.array_or_empty(F.col("topics_json")), ", ").alias("topics"), get("$.content_type").alias("content_type"), get("$.style.format").alias("format"), get("$.style.pacing").alias("pacing"),
    )


def json_records(x: DataFrame) -> DataFrame:
    """video_id, record: the JSON export with NULL members kept; the analysis as the model wrote it."""
    fields = ("video_id", "platform", "platform_id", "url", "title", "uploader", "duration_sec", "upload_date")
    s = F.struct(*fields, F.col("text_full").alias("transcript"), "language", X.lenient_json(F.col("full_json")).alias("analysis"))
    return x.select("video_id", F.to_json(s, {"ignoreNullFields": "false"}).alias("record"))


@query(with_sql(_V, _A, _T, _X) + f"SELECT id AS video_id, title, url, text_full AS transcript, language, json_extract_string({_OBJ.format('full_json')}, '$.summary') AS summary FROM X")
def export_json(spark, d):
    """The JSON records read back: what a reader of the export finds."""
    r = json_records(export_rows(spark, d))
    get = lambda p: F.get_json_object("record", p)
    return r.select("video_id", get("$.title").alias("title"), get("$.url").alias("url"), get("$.transcript").alias("transcript"), get("$.language").alias("language"), get("$.analysis.summary").alias("summary"))


@query(with_sql(_V, _A, _T, _X) + "SELECT id AS video_id, platform, platform_id, url, title, uploader, duration_sec, upload_date, language, text_full, summary FROM X")
def export_join(spark, d):
    return export_rows(spark, d).select("video_id", "platform", "platform_id", "url", "title", "uploader", "duration_sec", "upload_date", "language", "text_full", "summary")


@query(with_sql(_K) + "SELECT K.video_id, K.id AS keyframe_id, K.timestamp_sec, D.description FROM K JOIN (SELECT DISTINCT keyframe_id, description FROM vision_descriptions) D ON D.keyframe_id = K.id")
def frame_descriptions(spark, d):
    desc = table(spark, d, "vision_descriptions").select("keyframe_id", "description").distinct()
    k = keyframes(spark, d).select("video_id", F.col("id").alias("keyframe_id"), "timestamp_sec")
    return k.join(desc, "keyframe_id").select("video_id", "keyframe_id", "timestamp_sec", "description")


def show_rows(v: DataFrame, t: DataFrame, a: DataFrame, k: DataFrame) -> DataFrame:
    """One nested row per video: transcript, analysis, keyframes by time (NULL or empty where there are none)."""
    frame = F.struct("timestamp_sec", "id", "frame_index", "file_path", "strategy")
    per = k.groupBy("video_id").agg(F.sort_array(F.collect_list(frame)).alias("keyframes"))
    t = t.select("video_id", F.struct("language", "text_full", "segments_json", "whisper_model", "duration_sec").alias("transcript"))
    a = a.select("video_id", F.struct("summary", "topics_json", "hooks_json", "style_json", "engagement_signals_json", "full_json").alias("analysis"))
    v = v.withColumnRenamed("id", "video_id")
    return v.join(t, "video_id", "left").join(a, "video_id", "left").join(per, "video_id", "left").withColumn("keyframes", F.coalesce("keyframes", F.array()))


@query(with_sql(_V, _T, _A, _K) + """SELECT V.id AS video_id, V.platform, T.language, length(T.text_full) AS n_chars, A.summary, CAST(coalesce(n, 0) AS INT) AS n_keyframes, first_id
  FROM V LEFT JOIN T ON T.video_id = V.id LEFT JOIN A ON A.video_id = V.id LEFT JOIN (SELECT video_id, count(*) AS n, arg_min(id, (timestamp_sec, id)) AS first_id FROM K GROUP BY video_id) G ON G.video_id = V.id""")
def show_video(spark, d):
    s = show_rows(videos(spark, d), transcripts(spark, d), analyses(spark, d), keyframes(spark, d))
    return s.select("video_id", "platform", "transcript.language", F.length("transcript.text_full").cast("bigint").alias("n_chars"), "analysis.summary", F.size("keyframes").alias("n_keyframes"), F.get("keyframes", F.lit(0))["id"].alias("first_id"))


MOST = 4
_D = "D AS (SELECT id AS video_id, duration_sec FROM V WHERE duration_sec > 0)"


def _durations(spark, d) -> DataFrame:
    return videos(spark, d).select(F.col("id").alias("video_id"), "duration_sec").where("duration_sec > 0")


_STEP = """SELECT D.video_id, i, step * i AS timestamp_sec FROM (SELECT video_id, duration_sec, slots, greatest(duration_sec / (slots + 1), 1.0) AS step FROM D2 WHERE slots > 0) D, unnest(range(1, CAST(slots AS INT) + 1)) AS u(i) WHERE step * i < duration_sec"""


@query(with_sql(_V, _D, "D2 AS (SELECT *, 8 AS slots FROM D)") + _STEP.replace("D.video_id, i, step * i AS timestamp_sec", "D.video_id, CAST(i AS INT) AS i, round(step * i, 6) AS timestamp_sec"))
def interval_sample(spark, d):
    return frames.interval_sample(_durations(spark, d), F.lit(8)).withColumn("timestamp_sec", F.round("timestamp_sec", 6))


@query(with_sql(_V, _D, _K, "C AS (SELECT K.video_id, K.timestamp_sec FROM K JOIN D ON D.video_id = K.video_id WHERE K.strategy = 'scene')", f"D2 AS (SELECT D.*, greatest(0, {MOST * 3} - coalesce(n, 0)) AS slots FROM D LEFT JOIN (SELECT video_id, count(*) AS n FROM C GROUP BY video_id) G ON G.video_id = D.video_id)", f"N AS ({_STEP})", "N2 AS (SELECT N.*, row_number() OVER (PARTITION BY N.video_id ORDER BY N.timestamp_sec) AS r FROM N WHERE NOT EXISTS (SELECT 1 FROM C WHERE C.video_id = N.video_id AND abs(C.timestamp_sec - N.timestamp_sec) < 1.0))") + "SELECT video_id, round(timestamp_sec, 6) AS timestamp_sec, 'scene' AS strategy FROM C UNION ALL SELECT N2.video_id, round(N2.timestamp_sec, 6), 'interval' FROM N2 JOIN D2 ON D2.video_id = N2.video_id WHERE r <= slots")
def hybrid_fill(spark, d):
    """Scene frames, filled up with interval frames that are a second apart from them."""
    v = _durations(spark, d)
    scene = keyframes(spark, d).where("strategy = 'scene'").join(v, "video_id", "left_semi").select("video_id", "timestamp_sec")
    return frames.hybrid_fill(v, scene, MOST * 3).withColumn("timestamp_sec", F.round("timestamp_sec", 6))


@query("SELECT doc_id, CAST(i AS INT) AS pos, CAST(a[i + 1] AS INT) AS letter_count, b[i + 1] AS word FROM (SELECT doc_id, b, list_transform(b, lambda x: length(x)) AS a, unnest(range(len(b))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS b FROM documents WHERE text IS NOT NULL))")
def zip_positions(spark, d):
    """Two arrays matched by position."""
    w = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("b"))
    z = w.select("doc_id", F.posexplode(F.arrays_zip(F.transform("b", lambda x: F.length(x)).alias("a"), F.col("b").alias("b"))).alias("pos", "z"))
    return z.select("doc_id", "pos", F.col("z.a").alias("letter_count"), F.col("z.b").alias("word"))


@query(with_sql(_V) + "SELECT id AS video_id FROM V WHERE id NOT IN (SELECT video_id FROM transcripts WHERE video_id IS NOT NULL)")
def pending_work_anti(spark, d):
    v = videos(spark, d).select(F.col("id").alias("video_id"))
    return store.todo(v, table(spark, d, "transcripts"), "video_id")


@query(with_sql(_V) + "SELECT id AS video_id FROM V WHERE id IN (SELECT video_id FROM transcripts)")
def done_semi(spark, d):
    v = videos(spark, d).select(F.col("id").alias("video_id"))
    return store.finished(v, table(spark, d, "transcripts"), "video_id")


_CLASS = "CASE " + " ".join(f"WHEN label IN ({', '.join(repr(x) for x in names)}) THEN '{k}'" for k, names in audio.LABEL_CLASSES.items()) + " ELSE 'sound_effect' END"


@query(f"SELECT label, {_CLASS} AS event_class, count(*) AS n FROM (SELECT CASE WHEN id % 4 = 0 THEN 'Music' WHEN id % 4 = 1 THEN 'Narration, monologue' WHEN id % 4 = 2 THEN 'Cheering' ELSE label END AS label FROM audio_events) GROUP BY label")
def classify_label(spark, d):
    """Classes of labels; known labels of the class list are mixed in by id."""
    i = F.col("id") % 4
    label = F.when(i == 0, "Music").when(i == 1, "Narration, monologue").when(i == 2, "Cheering").otherwise(F.col("label"))
    return table(spark, d, "audio_events").groupBy(label.alias("label")).agg(F.count("*").alias("n")).withColumn("event_class", audio.classify_label(F.col("label")))


@query("""SELECT 'transcripts' AS child, video_id AS key FROM transcripts WHERE video_id NOT IN (SELECT id FROM videos) UNION SELECT 'keyframes', video_id FROM keyframes WHERE video_id NOT IN (SELECT id FROM videos)
  UNION SELECT 'vision_descriptions', CAST(keyframe_id AS VARCHAR) FROM vision_descriptions WHERE keyframe_id NOT IN (SELECT id FROM keyframes) UNION SELECT 'lineitem', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def orphan_check(spark, d):
    pairs = (("transcripts", "video_id", "videos", "id"), ("keyframes", "video_id", "videos", "id"), ("vision_descriptions", "keyframe_id", "keyframes", "id"), ("lineitem", "l_orderkey", "orders", "o_orderkey"))
    out = []
    for child, key, parent, pk in pairs:
        c = table(spark, d, child).select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
        p = table(spark, d, parent).select(F.col(pk).alias("k"))
        out.append(c.join(p, "k", "left_anti").select(F.lit(child).alias("child"), F.col("k").cast("string").alias("key")))
    return reduce(DataFrame.unionByName, out)


# ---------------------------------------------------------------- aggregates

TABLES = ("videos", "transcripts", "audio_events", "speaker_segments", "keyframes", "vision_descriptions", "analyses", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark, d):
    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES])


@query(with_sql(_V) + "SELECT status, count(*) AS n FROM V GROUP BY status")
def videos_by_status(spark, d):
    return videos(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(with_sql(_V) + "SELECT platform, count(*) AS n FROM V GROUP BY platform")
def videos_by_platform(spark, d):
    return videos(spark, d).groupBy("platform").agg(F.count("*").alias("n"))


@query(with_sql(_E, _M) + "SELECT video_id, first_id, event_type, label, start_sec, end_sec, confidence FROM M")
def merge_adjacent(spark, d):
    return audio.merge_adjacent(events(spark, d))


_TL = """G AS (SELECT video_id, event_type, CAST(sum(CAST(round((end_sec - start_sec) * 1e6) AS BIGINT)) AS BIGINT) AS us, min(start_sec) AS first, arg_min(first_id, (start_sec, first_id)) AS fid FROM M GROUP BY video_id, event_type),
  H AS (SELECT video_id, coalesce(sum(us) FILTER (event_type = 'music'), 0) / 1e6 AS music, coalesce(sum(us) FILTER (event_type = 'silence'), 0) / 1e6 AS silence, arg_max(event_type, (us, -first, -fid)) AS dominant FROM G GROUP BY video_id)"""


@query(with_sql(_V, _E, _M, _TL) + """SELECT V.id AS video_id, coalesce(duration_sec > 0 AND music > 0, false) AS has_music, coalesce(CASE WHEN duration_sec > 0 THEN CAST(format('{:.3f}', music / duration_sec) AS DOUBLE) END, 0.0) AS music_ratio,
  coalesce(CASE WHEN duration_sec > 0 THEN CAST(format('{:.3f}', silence / duration_sec) AS DOUBLE) END, 0.0) AS silence_ratio, coalesce(CASE WHEN duration_sec > 0 THEN dominant END, '') AS dominant_type FROM V LEFT JOIN H ON H.video_id = V.id""")
def audio_timeline(spark, d):
    """Music and silence as shares to three digits, and the longest type."""
    dur = videos(spark, d).select(F.col("id").alias("video_id"), "duration_sec")
    return audio.audio_timeline(audio.merge_adjacent(events(spark, d)), dur)


@query(with_sql(_E, _M, _TL) + "SELECT video_id, dominant AS dominant_type FROM H")
def dominant_type(spark, d):
    merged = audio.merge_adjacent(events(spark, d))
    one = merged.select("video_id").distinct().withColumn("duration_sec", F.lit(1.0))
    return audio.audio_timeline(merged, one).select("video_id", "dominant_type")


@query("SELECT video_id, count(DISTINCT speaker) AS n_speakers FROM speaker_segments GROUP BY video_id")
def speaker_count(spark, d):
    return table(spark, d, "speaker_segments").groupBy("video_id").agg(F.countDistinct("speaker").alias("n_speakers"))


def transcript_lines(t: DataFrame) -> DataFrame:
    """video_id, text: speaker lines if the first segment has a speaker, else the full text."""
    segs = X.array_or_empty(F.col("segments_json"), "array<struct<text:string,speaker:string>>")
    t = t.select("video_id", "text_full", segs.alias("segs"))
    lines = F.array_join(F.transform("segs", lambda s: F.concat(F.lit("["), F.coalesce(s["speaker"], F.lit("")), F.lit("] "), F.coalesce(s["text"], F.lit("")))), "\n")
    named = F.coalesce(F.get("segs", F.lit(0))["speaker"], F.lit("")) != ""
    return t.select("video_id", F.when(named, lines).otherwise(F.col("text_full")).alias("text"))


_TT = """L AS (SELECT video_id, string_agg('[' || coalesce(speaker, '') || '] ' || coalesce(text, ''), chr(10) ORDER BY seg_no) AS lines, coalesce(arg_min(coalesce(speaker, ''), seg_no), '') AS first FROM S GROUP BY video_id),
  TT AS (SELECT T.video_id, CASE WHEN coalesce(first, '') <> '' THEN lines ELSE text_full END AS text FROM T LEFT JOIN L ON L.video_id = T.video_id)"""


@query("WITH " + _S + ", " + _TT + " SELECT video_id, md5(text) AS digest, length(text) AS n_chars FROM TT")
def transcript_text(spark, d):
    return transcript_lines(transcripts(spark, d)).select("video_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


def event_lines(e: DataFrame) -> DataFrame:
    """video_id, shard, text: lines '[0.0s-2.5s] type: label (90%)' by time, in pieces of an hour, so a live stream is no single string."""
    from cliplake.operators.sequence import time_shard

    at = lambda c: F.concat(X.fixed(F.col(c), 1), F.lit("s"))
    sure = X.fixed(F.coalesce("confidence", F.lit(0.0)) * 100, 0)
    line = F.concat(F.lit("["), at("start_sec"), F.lit("-"), at("end_sec"), F.lit("] "), "event_type", F.lit(": "), "label", F.lit(" ("), sure, F.lit("%)"))
    e = e.withColumn("shard", time_shard(F.col("start_sec")))
    rows = F.sort_array(F.collect_list(F.struct("start_sec", "id", line.alias("line"))))
    return e.groupBy("video_id", "shard").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


_LINE = "'[' || format('{:.1f}', start_sec) || 's-' || format('{:.1f}', end_sec) || 's] ' || event_type || ': ' || label || ' (' || format('{:.0f}', coalesce(confidence, 0.0) * 100) || '%)'"


@query(with_sql(_E) + "SELECT video_id, CAST(floor(start_sec / 3600) AS BIGINT) AS shard, md5(string_agg(" + _LINE + ", chr(10) ORDER BY start_sec, id)) AS digest FROM E GROUP BY ALL")
def audio_lines(spark, d):
    return event_lines(events(spark, d)).select("video_id", "shard", F.md5("text").alias("digest"))


@query(with_sql(_A) + "SELECT video_id, array_to_string(from_json(coalesce(nullif(topics_json, ''), '[]'), '[\"VARCHAR\"]'), ', ') AS topics FROM A")
def topics_join(spark, d):
    return analyses(spark, d).select("video_id", F.array_join(X.array_or_empty(F.col("topics_json")), ", ").alias("topics"))


@query(with_sql(_K) + "SELECT strategy, count(*) AS n FROM (SELECT strategy, (id % 100) / 100.0e0 AS score FROM K) WHERE score > 0.3e0 GROUP BY strategy")
def scene_threshold(spark, d):
    """Frames above a score (the id stands for the score, which the table doesn't keep)."""
    k = keyframes(spark, d).withColumn("score", (F.col("id") % 100) / 100)
    return k.where("score > 0.3D").groupBy("strategy").agg(F.count("*").alias("n"))


_GUARD = """FR AS (SELECT K.video_id, K.timestamp_sec, K.id, (K.id % 7) / 10.0e0 AS score FROM K JOIN D ON D.video_id = K.video_id), LH AS (SELECT D.*, lo, hi FROM D LEFT JOIN (SELECT video_id, min(timestamp_sec) AS lo, max(timestamp_sec) AS hi FROM FR GROUP BY video_id) G ON G.video_id = D.video_id),
  U AS (SELECT video_id, 0 AS part, 0.1e0 AS timestamp_sec, -1 AS id, 0.0e0 AS score FROM LH WHERE lo IS NULL OR lo >= 0.5 UNION ALL SELECT video_id, 1, timestamp_sec, id, score FROM FR UNION ALL SELECT video_id, 2, duration_sec - 0.5, -2, 0.0e0 FROM LH WHERE (hi IS NULL OR hi <= duration_sec - 1.0) AND duration_sec > 1.0),
  W AS (SELECT video_id, timestamp_sec, id, score, row_number() OVER (PARTITION BY video_id ORDER BY part, timestamp_sec, id) - 1 AS pos FROM U)"""


def _guarded(spark, d) -> DataFrame:
    k = keyframes(spark, d).select("video_id", "timestamp_sec", "id", ((F.col("id") % 7) / 10).alias("score"))
    return frames.first_last_guard(_durations(spark, d), k)


@query(with_sql(_V, _D, _K, _GUARD) + "SELECT video_id, round(timestamp_sec, 6) AS timestamp_sec, CAST(id AS BIGINT) AS id, CAST(pos AS BIGINT) AS pos FROM W")
def first_last_guard(spark, d):
    return _guarded(spark, d).select("video_id", F.round("timestamp_sec", 6).alias("timestamp_sec"), "id", F.col("pos").cast("bigint").alias("pos"))


_TRIM = f"""Y AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM W), Z AS (SELECT *, pos = 0 OR pos = n - 1 AS edge FROM Y), Z2 AS (SELECT *, row_number() OVER (PARTITION BY video_id, edge ORDER BY score, pos) AS rk FROM Z),
  Z3 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS keep FROM Z2 WHERE edge OR rk > n - {MOST})"""


@query(with_sql(_V, _D, _K, _GUARD, _TRIM) + f"SELECT video_id, CAST(id AS BIGINT) AS id, CAST(pos AS BIGINT) AS pos FROM Z3 WHERE keep <= {MOST}")
def keyframe_trim(spark, d):
    return frames.keyframe_trim(_guarded(spark, d), MOST).select("video_id", "id", F.col("pos").cast("bigint").alias("pos"))


@query(with_sql(_V, _D, _K, _GUARD, _TRIM) + f"SELECT video_id, round(timestamp_sec, 6) AS timestamp_sec, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, id) - 1 AS INT) AS frame_index FROM Z3 WHERE keep <= {MOST}")
def keyframe_select(spark, d):
    """The whole selection: guard, trim, renumber."""
    return frames.reindex(frames.keyframe_trim(_guarded(spark, d), MOST)).select("video_id", F.round("timestamp_sec", 6).alias("timestamp_sec"), "frame_index")


@query(with_sql(_K) + "SELECT id, video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, id) - 1 AS INT) AS frame_index FROM K")
def reindex_frames(spark, d):
    return frames.reindex(keyframes(spark, d).drop("frame_index")).select("id", "video_id", "frame_index")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS class_no, round(CAST(list_max(embedding) AS DOUBLE), 5) AS p FROM embeddings")
def top_class(spark, d):
    return table(spark, d, "embeddings").select("vec_id", audio.top_class(F.col("embedding")).alias("class_no"), F.round(F.array_max("embedding").cast("double"), 5).alias("p"))


@query(with_sql(_V, _D) + "SELECT video_id, CAST(w AS INT) AS window_no, CAST(w AS DOUBLE) AS start_sec, CAST(w + 2 AS DOUBLE) AS end_sec FROM (SELECT video_id, unnest(range(CASE WHEN CAST(floor(duration_sec * 100) AS BIGINT) >= 200 THEN (CAST(floor(duration_sec * 100) AS BIGINT) - 200) // 100 + 1 ELSE 0 END)) AS w FROM D)")
def audio_windows(spark, d):
    """Windows of two seconds every second over a signal of 100 samples a second."""
    w = audio.sliding_windows(_durations(spark, d), F.floor(F.col("duration_sec") * 100).cast("bigint"), 100)
    return w.select("video_id", "window_no", "start_sec", "end_sec")


# ---------------------------------------------------------------- scalars


@query("SELECT DISTINCT id AS stored_id, substr(sha256(platform || ':' || platform_id), 1, 16) AS video_id FROM videos")
def video_id(spark, d):
    return table(spark, d, "videos").select(F.col("id").alias("stored_id"), U.video_id(F.col("platform"), F.col("platform_id")).alias("video_id")).distinct()


_PLAT = "CASE " + " ".join(f"WHEN regexp_matches(u, '{p}') THEN '{n}'" for p, n in U.PLATFORMS) + " END"


@query(f"SELECT u AS url, {_PLAT} AS platform FROM (SELECT DISTINCT {_URL} AS u FROM videos)")
def detect_platform(spark, d):
    u = table(spark, d, "videos").select(url_of().alias("url")).distinct()
    return u.select("url", U.detect_platform(F.col("url")).alias("platform"))


def _first(p: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(u, '{x}', 1), '')" for x in U.IDS[p]) + ")"


@query(f"SELECT u AS url, CASE platform WHEN 'youtube' THEN {_first('youtube')} WHEN 'instagram' THEN {_first('instagram')} WHEN 'tiktok' THEN coalesce({_first('tiktok')}, substr(md5(u), 1, 12)) END AS found_id FROM (SELECT DISTINCT platform, {_URL} AS u FROM videos)")
def extract_id(spark, d):
    u = table(spark, d, "videos").select("platform", url_of().alias("url")).distinct()
    return u.select("url", U.extract_id(F.col("url"), F.col("platform")).alias("found_id"))


_PROF = "CASE WHEN uploader IS NULL THEN u WHEN platform = 'youtube' THEN 'https://www.youtube.com/@' || md5(uploader) ELSE 'https://www.instagram.com/' || md5(uploader) || '/' END"


@query(f"""SELECT u AS url, coalesce(CASE {_PLAT} WHEN 'instagram' THEN regexp_matches(u, '{U.PROFILE_INSTAGRAM}') AND NOT regexp_matches(u, '{U.IDS['instagram'][0]}') WHEN 'youtube' THEN regexp_matches(u, '{U.PROFILE_YOUTUBE}') END, false) AS is_profile
  FROM (SELECT DISTINCT {_PROF} AS u FROM (SELECT *, {_URL} AS u FROM videos) UNION SELECT {_URL} FROM videos)""")
def profile_url(spark, d):
    v = table(spark, d, "videos").withColumn("u", url_of())
    page = F.when(F.col("uploader").isNull(), F.col("u")).when(F.col("platform") == "youtube", F.concat(F.lit("https://www.youtube.com/@"), F.md5("uploader"))).otherwise(F.concat(F.lit("https://www.instagram.com/"), F.md5("uploader"), F.lit("/")))
    u = v.select(page.alias("url")).union(v.select("u")).distinct()
    return u.select("url", U.is_profile(F.col("url"), U.detect_platform(F.col("url"))).alias("is_profile"))


@query("SELECT DISTINCT id, coalesce(nullif(title, ''), '(untitled)') AS title, coalesce(nullif(uploader, ''), '(unknown)') AS uploader, coalesce(duration_sec, 0.0) AS duration_sec FROM videos")
def falsy_default(spark, d):
    f = store.falsy
    return table(spark, d, "videos").select("id", f(F.col("title"), F.lit("(untitled)")).alias("title"), f(F.col("uploader"), F.lit("(unknown)")).alias("uploader"), F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec")).distinct()


@query("SELECT DISTINCT id, substr(title, 1, 50) AS t50, substr(title, 1, 60) AS t60, substr(title, 1, 100) AS t100 FROM videos")
def truncate_text(spark, d):
    return table(spark, d, "videos").select("id", *[F.substring("title", 1, n).alias(f"t{n}") for n in (50, 60, 100)]).distinct()


@query(with_sql(_A) + "SELECT video_id, json_exists(g, '$.face_count') AS has_face_count, coalesce(json_extract_string(g, '$.spoken_language'), '') AS spoken_language FROM (SELECT video_id, CASE WHEN json_valid(engagement_signals_json) THEN engagement_signals_json ELSE '{}' END AS g FROM A)")
def json_default(spark, d):
    """Absent members and members that are null are told apart."""
    g = analyses(spark, d).select("video_id", F.coalesce(F.try_parse_json("engagement_signals_json"), F.parse_json(F.lit("{}"))).alias("g"))
    keys = F.json_object_keys(F.to_json("g"))
    return g.select("video_id", F.coalesce(F.array_contains(keys, "face_count"), F.lit(False)).alias("has_face_count"), F.coalesce(F.try_variant_get("g", "$.spoken_language", "string"), F.lit("")).alias("spoken_language"))


@query(with_sql(_A) + f"SELECT video_id, json_extract_string(o, '$.content_type') AS content_type, o IS NOT NULL AS readable FROM (SELECT video_id, {_OBJ.format('full_json')} AS o FROM A)")
def json_lenient(spark, d):
    a = analyses(spark, d).select("video_id", X.lenient_json(F.col("full_json")).alias("v"))
    return a.select("video_id", F.try_variant_get("v", "$.content_type", "string").alias("content_type"), F.col("v").isNotNull().alias("readable"))


_SCORES = """SC AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{"hook_strength": ' || (doc_id % 11) || ', "information_density": ' || (doc_id % 7) || '.5, "emotional_impact": ' || (doc_id % 5) || ', "shareability": ' || (doc_id % 3) || ', "overall": ' || (doc_id % 9) || '}'
  WHEN doc_id % 4 = 1 THEN 'Sure: {"hook_strength": "' || (doc_id % 11) || '.25", "reasoning": "ok"} bye' WHEN doc_id % 4 = 2 THEN 'no scores' ELSE '{"reasoning": "none"}' END AS reply FROM documents)"""


def score_replies(spark, d) -> DataFrame:
    """Model replies in four kinds: clean, within prose, no JSON, JSON without scores."""
    i, s = F.col("doc_id"), lambda n: (F.col("doc_id") % n).cast("string")
    clean = F.concat(F.lit('{"hook_strength": '), s(11), F.lit(', "information_density": '), s(7), F.lit('.5, "emotional_impact": '), s(5), F.lit(', "shareability": '), s(3), F.lit(', "overall": '), s(9), F.lit("}"))
    prose = F.concat(F.lit('Sure: {"hook_strength": "'), s(11), F.lit('.25", "reasoning": "ok"} bye'))
    reply = F.when(i % 4 == 0, clean).when(i % 4 == 1, prose).when(i % 4 == 2, "no scores").otherwise('{"reasoning": "none"}')
    return table(spark, d, "documents").select("doc_id", reply.alias("reply"))


def score_columns(replies: DataFrame) -> DataFrame:
    """The five scores of a reply (0 where absent) and the reasoning ('' where absent)."""
    r = replies.withColumn("v", X.lenient_json(F.col("reply")))
    num = lambda f: F.coalesce(F.try_variant_get("v", f"$.{f}", "double"), F.lit(0.0)).alias(f)
    return r.select(*replies.columns, *[num(f) for f in [*X.SCORE_WEIGHTS, "overall"]], F.coalesce(F.try_variant_get("v", "$.reasoning", "string"), F.lit("")).alias("reasoning"))


_SX = f"SX AS (SELECT doc_id, {_OBJ.format('reply')} AS o FROM SC), SY AS (SELECT doc_id, {', '.join(f'coalesce(try_cast(json_extract_string(o, {chr(39)}$.{f}{chr(39)}) AS DOUBLE), 0.0) AS {f}' for f in [*X.SCORE_WEIGHTS, 'overall'])}, coalesce(json_extract_string(o, '$.reasoning'), '') AS reasoning FROM SX)"


@query(with_sql(_SCORES, _SX) + "SELECT * FROM SY")
def score_extract(spark, d):
    return score_columns(score_replies(spark, d)).drop("reply")


@query(with_sql(_SCORES, _SX) + "SELECT doc_id, overall, round(hook_strength * 0.3e0 + information_density * 0.25e0 + emotional_impact * 0.25e0 + shareability * 0.2e0, 6) AS overall_recomputed FROM SY")
def score_overall(spark, d):
    s = score_columns(score_replies(spark, d))
    again = X.overall_score(*[F.col(f) for f in X.SCORE_WEIGHTS])
    return s.select("doc_id", "overall", F.round(again, 6).alias("overall_recomputed"))


@query(with_sql(_SCORES, _SX) + "SELECT doc_id, overall, reasoning FROM SY WHERE overall > 0")
def score_lookup(spark, d):
    return score_columns(score_replies(spark, d)).where("overall > 0").select("doc_id", "overall", "reasoning")


@query("SELECT DISTINCT id, start_sec, " + ", ".join(f"CAST(format('{{:.{k}f}}', start_sec) AS DOUBLE) AS r{k}, format('{{:.{k}f}}', end_sec) AS f{k}" for k in (0, 1, 2)) + ", CAST(format('{:.1f}', (id * 2 + 1) / 16) AS DOUBLE) AS tie FROM audio_events")
def round_even(spark, d):
    """Rounded as the binary value says, ties to even: the raw times, their printed forms, and ties made of the ids."""
    e = table(spark, d, "audio_events")
    r = [c for k in (0, 1, 2) for c in (X.round_binary(F.col("start_sec"), k).alias(f"r{k}"), X.fixed(F.col("end_sec"), k).alias(f"f{k}"))]
    return e.select("id", "start_sec", *r, X.round_binary((F.col("id") * 2 + 1) / 16, 1).alias("tie")).distinct()


_TASK = X.FRAME_TASK.replace("'", "''")


@query(with_sql(_V, _K, "N AS (SELECT K.*, count(*) OVER (PARTITION BY video_id) AS total FROM K)") + f"""SELECT N.id, md5('This is frame ' || (frame_index + 1) || ' of ' || total || '. Captured at ' || format('{{:.1f}}', timestamp_sec) || 's' || CASE WHEN coalesce(duration_sec, 0) <> 0 THEN ' of a ' || format('{{:.0f}}', duration_sec) || 's video.' ELSE '' END || chr(10) || chr(10) || '{_TASK}') AS digest FROM N LEFT JOIN V ON V.id = N.video_id""")
def frame_prompt(spark, d):
    """Prompts of all frames."""
    k = keyframes(spark, d)
    n = k.groupBy("video_id").agg(F.count("*").alias("total"))
    v = videos(spark, d).select(F.col("id").alias("video_id"), "duration_sec")
    r = k.join(n, "video_id").join(v, "video_id", "left")
    return r.select("id", F.md5(X.frame_prompt(F.col("frame_index"), F.col("total"), F.col("timestamp_sec"), F.col("duration_sec"))).alias("digest"))


def merge_prompts(v: DataFrame, text: DataFrame, frames_: DataFrame, sounds: DataFrame, template: str) -> DataFrame:
    """video_id, prompt: the template with title, platform, duration, uploader, transcript, frames and sounds filled in."""
    r = v.join(text, "video_id", "left").join(frames_, "video_id", "left").join(sounds, "video_id", "left")
    parts = {
        "title": store.falsy(F.col("title"), F.lit("(untitled)")), "platform": F.col("platform"), "duration": F.coalesce(F.nullif(F.col("duration_sec"), F.lit(0.0)).cast("string"), F.lit("0")), "uploader": store.falsy(F.col("uploader"), F.lit("(unknown)")),
        "transcript": F.coalesce("text", F.lit("(no transcript)")), "frames": F.coalesce("frames", F.lit("(no vision data)")), "sounds": F.coalesce("sounds", F.lit("(no audio analysis)")),
    }
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), parts[name]]
    return r.select("video_id", F.concat(*pieces, F.lit(rest)).alias("prompt"))


def sound_lines(e: DataFrame) -> DataFrame:
    """video_id, sounds: one line per event by time, put together from pieces of an hour each."""
    pieces = F.sort_array(F.collect_list(F.struct("shard", "text")))
    return event_lines(e).groupBy("video_id").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "\n").alias("sounds"))


TEMPLATE = "Title: {title}\nPlatform: {platform}\nDuration: {duration}s\nUploader: {uploader}\n\n{transcript}\n\n{frames}\n\n{sounds}\n"


@query("WITH " + ", ".join((_S, _TT, _V, _K, _E)) + """, FL AS (SELECT video_id, string_agg('[' || format('{:.1f}', timestamp_sec) || 's] ' || description, chr(10) ORDER BY timestamp_sec, id) AS frames FROM (SELECT K.video_id, K.timestamp_sec, K.id, D.description FROM K JOIN (SELECT DISTINCT keyframe_id, description FROM vision_descriptions) D ON D.keyframe_id = K.id) GROUP BY video_id),
  SL AS (SELECT video_id, string_agg(""" + _LINE + """, chr(10) ORDER BY start_sec, id) AS sounds FROM E GROUP BY video_id)
  SELECT V.id AS video_id, md5('Title: ' || coalesce(nullif(title, ''), '(untitled)') || chr(10) || 'Platform: ' || platform || chr(10) || 'Duration: ' || coalesce(CAST(nullif(duration_sec, 0) AS VARCHAR), '0') || 's' || chr(10) || 'Uploader: ' || coalesce(nullif(uploader, ''), '(unknown)') || chr(10) || chr(10) || coalesce(text, '(no transcript)') || chr(10) || chr(10) || coalesce(frames, '(no vision data)') || chr(10) || chr(10) || coalesce(sounds, '(no audio analysis)') || chr(10)) AS digest
  FROM V LEFT JOIN TT ON TT.video_id = V.id LEFT JOIN FL ON FL.video_id = V.id LEFT JOIN SL ON SL.video_id = V.id""")
def merge_prompt(spark, d):
    """Prompts over transcript, frame lines and sound lines."""
    f = frame_descriptions(spark, d).groupBy("video_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp_sec", "keyframe_id", "description"))), lambda x: F.concat(F.lit("["), X.fixed(x["timestamp_sec"], 1), F.lit("s] "), x["description"])), "\n").alias("frames")
    )
    e = sound_lines(events(spark, d))
    v = videos(spark, d).withColumnRenamed("id", "video_id").select("video_id", "title", "platform", "uploader", "duration_sec")
    return merge_prompts(v, transcript_lines(transcripts(spark, d)), f, e, TEMPLATE).select("video_id", F.md5("prompt").alias("digest"))


@query("SELECT DISTINCT file_path, CASE lower(split_part(file_path, '.', -1)) WHEN 'png' THEN 'image/png' ELSE 'image/jpeg' END AS mime FROM (SELECT CASE WHEN id % 3 = 0 THEN replace(file_path, '.jpg', '.PNG') WHEN id % 3 = 1 THEN file_path ELSE replace(file_path, '.jpg', '.webp') END AS file_path FROM keyframes)")
def mime_type(spark, d):
    i, p = F.col("id") % 3, F.col("file_path")
    path = F.when(i == 0, F.regexp_replace(p, r"\.jpg", ".PNG")).when(i == 1, p).otherwise(F.regexp_replace(p, r"\.jpg", ".webp"))
    return table(spark, d, "keyframes").select(path.alias("file_path")).distinct().select("file_path", X.mime_type(F.col("file_path")).alias("mime"))


@query("SELECT url, CAST(1 AS INT) AS from_list FROM videos UNION ALL SELECT 'https://youtube.com/shorts/' || id, 0 FROM videos")
def url_union(spark, d):
    """URLs given directly and from a list, one after the other, repeats kept."""
    v = table(spark, d, "videos")
    return v.select("url", F.lit(1).alias("from_list")).unionByName(v.select(F.concat(F.lit("https://youtube.com/shorts/"), "id").alias("url"), F.lit(0).alias("from_list")))
