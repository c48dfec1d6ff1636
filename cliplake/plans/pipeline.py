"""The analysis of a batch of URLs as stages over tables.

Every stage takes what its output table lacks (left anti join), calls its backend per item, and writes the
outcome before the next stage reads it, so nothing expensive is computed twice and a broken run resumes where
it stopped. A failing item gets its error; the others go on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplake import plugins
from cliplake.functions import text as X
from cliplake.functions import urls as U
from cliplake.operators import align, audio, frames, store
from cliplake.session import written
from cliplake.warehouse import Warehouse

MERGE_TASK = "You are analyzing a short-form video. Answer with one JSON object: summary, topics, timeline, hook, style, engagement_signals, content_type.\n\n"
SCORE_TASK = "Score the video from 0 to 10. Answer with one JSON object: hook_strength, information_density, emotional_impact, shareability, overall, reasoning.\n\n"


@dataclass
class Options:
    crawler: str = "fake"
    transcriber: str = "fake"
    vlm: str = "fake"
    llm: str = "fake"
    audio: str | None = None
    diarizer: str | None = None
    skip_transcribe: bool = False
    skip_vision: bool = False
    score: bool = False
    strategy: str = "interval"
    max_frames: int = 8
    source: str = "cli"
    extra: dict = field(default_factory=dict)


def create_batch(w: Warehouse, urls: DataFrame, source: str = "cli") -> str:
    """A batch with one pending item per URL; a URL given twice is refused."""
    twice = urls.groupBy("url").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the batch names a URL twice: {twice[0].url}")
    batch_id = uuid.uuid4().hex[:12]
    none = F.lit(None).cast("string")
    items = urls.select(F.lit(batch_id).alias("batch_id"), "url", none.alias("video_id"), F.lit("pending").alias("status"), none.alias("error_message"))
    w.append("batch_items", items)
    _write_batch(w, batch_id, source, "running")
    return batch_id


def _write_batch(w: Warehouse, batch_id: str, source: str | None, status: str) -> None:
    items = w.read("batch_items").where(F.col("batch_id") == batch_id)
    c = items.agg(F.count("*").cast("int").alias("total_urls"), F.count_if(F.col("status") == "done").cast("int").alias("completed"), F.count_if(F.col("status") == "error").cast("int").alias("failed"))
    old = w.read("batches").where(F.col("id") == batch_id).select("source", "created_at")
    row = c.join(old, how="left") if source is None else c.select("*", F.lit(source).alias("source"), F.current_timestamp().alias("created_at"))
    w.put_latest("batches", row.select(F.lit(batch_id).alias("id"), "source", "total_urls", "completed", "failed", F.lit(status).alias("status"), "created_at", F.current_timestamp().alias("updated_at")), "id")


def interrupt(w: Warehouse, batch_id: str) -> None:
    _write_batch(w, batch_id, None, "interrupted")


def resumable(w: Warehouse) -> str | None:
    """The latest interrupted batch."""
    b = w.read("batches").where("status = 'interrupted'").orderBy(F.desc("updated_at"), "id").limit(1).collect()
    return b[0].id if b else None


def _outcome(df: DataFrame, name: str) -> DataFrame:
    return written(df, f"stage-{name}")


def _failed(got: DataFrame, key: str = "video_id") -> DataFrame:
    return got.where("NOT ok").select(F.col(key).alias("id"), F.col("error").alias("e"))


def run(w: Warehouse, batch_id: str, o: Options) -> None:
    """All stages over the pending items of the batch."""
    pending = w.read("batch_items").where((F.col("batch_id") == batch_id) & (F.col("status") == "pending"))
    url, platform = F.col("url"), U.detect_platform(F.col("url"))
    todo = pending.select("url", platform.alias("platform"), U.extract_id(url, platform).alias("platform_id"))
    todo = todo.withColumn("id", U.video_id(F.col("platform"), F.col("platform_id")))
    unsupported = F.col("id").isNull()
    fresh = store.todo(todo.where(~unsupported).dropDuplicates(["id"]), w.read("videos"), "id")
    got = _outcome(plugins.call_each(fresh.select("id", "url"), "id", "crawler", o.crawler, lambda m, r: m.download(r["url"])), "download")
    meta = F.from_json("result", "title string, uploader string, duration_sec double, upload_date string, file_path string, file_size_bytes bigint")
    new = fresh.join(got.where("ok").select("id", meta.alias("m")), "id").select(
        "id", "platform", "platform_id", "url", "m.title", "m.uploader", "m.upload_date", "m.duration_sec", "m.file_path", "m.file_size_bytes",
        F.lit("downloaded").alias("status"), F.lit(None).cast("string").alias("error_message"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )
    w.put_latest("videos", _outcome(new, "videos"), "id")
    mine = _outcome(todo.where(~unsupported).select("id").distinct().join(w.read("videos"), "id").select("id", "file_path", "duration_sec"), "mine")

    # A stage answers with the items that failed in it (id, e); later stages leave them out.
    failed = [got.where("NOT ok").select("id", F.col("error").alias("e"))]
    stages = ((not o.skip_transcribe, _transcribe), (o.audio, _audio), (o.diarizer, _diarize), (not o.skip_vision, _vision), (True, _merge))
    for wanted, stage in (*stages, (o.score, lambda w, m, o: score(w, m, o.llm))):
        if wanted:
            failed.append(stage(w, mine, o))
            mine = mine.join(failed[-1].select("id"), "id", "left_anti")
    errors = reduce(DataFrame.unionByName, failed).groupBy("id").agg(F.min("e").alias("e"))
    state = todo.join(errors, "id", "left").select("url", F.col("id").alias("_id"), F.when(F.col("id").isNull(), F.concat(F.lit("unsupported URL: "), "url")).otherwise(F.col("e")).alias("_e"))
    w.replace("batch_items", _closed_items(w, batch_id, state))
    _write_batch(w, batch_id, None, "completed")


def _closed_items(w: Warehouse, batch_id: str, state: DataFrame) -> DataFrame:
    items = w.read("batch_items")
    hit = (F.col("batch_id") == batch_id) & F.col("_hit")
    joined = items.join(state.withColumn("_hit", F.lit(True)), "url", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return joined.select(
        "batch_id", "url", F.when(hit, F.col("_id")).otherwise(F.col("video_id")).alias("video_id"),
        F.when(~hit, F.col("status")).when(F.col("_e").isNotNull(), "error").otherwise("done").alias("status"), F.when(hit, F.col("_e")).otherwise(F.col("error_message")).alias("error_message"),
    )


def _set(w: Warehouse, ids: DataFrame, status: str) -> None:
    change = ids.select("id", F.lit(status).alias("status"), F.lit(None).cast("string").alias("error_message")).distinct()
    w.replace("videos", store.set_status(w.read("videos"), change, "id"))


def _transcribe(w: Warehouse, mine: DataFrame, o: Options) -> DataFrame:
    todo = store.todo(mine.withColumnRenamed("id", "video_id"), w.read("transcripts"), "video_id").select("video_id", "file_path")
    got = _outcome(plugins.call_each(todo, "video_id", "transcriber", o.transcriber, lambda m, r: m.transcribe(r["file_path"])), "transcripts")
    bad, got = _failed(got), got.where("ok")
    r = F.col("result")
    rows = got.select("video_id", F.get_json_object(r, "$.language").alias("language"), F.get_json_object(r, "$.text").alias("text_full"), F.get_json_object(r, "$.segments").alias("segments_json"),
                      F.get_json_object(r, "$.model").alias("whisper_model"), F.get_json_object(r, "$.duration_sec").cast("double").alias("duration_sec"), F.current_timestamp().alias("created_at"))
    w.put_latest("transcripts", rows, "video_id")
    _set(w, got.select(F.col("video_id").alias("id")), "transcribed")
    return bad


def _numbered(w: Warehouse, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
    after = w.read(name).agg(F.max("id")).first()[0] or 0
    return store.assign_ids(rows, order, after, 8).withColumnRenamed("new_id", "id")


def _audio(w: Warehouse, mine: DataFrame, o: Options) -> DataFrame:
    todo = store.todo(mine.withColumnRenamed("id", "video_id"), w.read("audio_events"), "video_id").select("video_id", "file_path")
    got = _outcome(plugins.call_each(todo, "video_id", "audio", o.audio, lambda m, r: m.analyze(r["file_path"])), "audio")
    bad, got = _failed(got), got.where("ok")
    e = got.select("video_id", F.posexplode(F.from_json("result", "array<struct<label:string,start_sec:double,end_sec:double,confidence:double>>")).alias("id", "e")).select("video_id", F.col("id").cast("bigint").alias("id"), "e.*")
    e = e.where("confidence > 0.3").withColumn("event_type", audio.classify_label(F.col("label")))
    merged = audio.merge_adjacent(e).select("video_id", "event_type", F.coalesce("label", F.lit("")).alias("label"), "start_sec", "end_sec", "confidence")
    w.append("audio_events", _numbered(w, "audio_events", merged, ["video_id", "start_sec"]))
    return bad


def _diarize(w: Warehouse, mine: DataFrame, o: Options) -> DataFrame:
    todo = store.todo(mine.withColumnRenamed("id", "video_id"), w.read("speaker_segments"), "video_id").select("video_id", "file_path")
    got = _outcome(plugins.call_each(todo, "video_id", "diarizer", o.diarizer, lambda m, r: m.diarize(r["file_path"])), "turns")
    bad, got = _failed(got), got.where("ok")
    turn = got.select("video_id", F.posexplode(F.from_json("result", "array<struct<speaker:string,start_sec:double,end_sec:double>>")).alias("turn_no", "t")).select("video_id", "turn_no", "t.*")
    w.append("speaker_segments", turn.select("video_id", "speaker", "start_sec", "end_sec"))
    w.put_latest("transcripts", _outcome(labelled(w.read("transcripts"), turn), "labelled"), "video_id")
    return bad


def labelled(transcripts: DataFrame, turn: DataFrame) -> DataFrame:
    """Transcripts of the videos that have turns, their segments with speakers."""
    t = transcripts.join(turn.select("video_id").distinct(), "video_id", "left_semi")
    s = t.select("video_id", F.posexplode(X.array_or_empty(F.col("segments_json"), "array<struct<start:double,end:double,text:string,confidence:double>>")).alias("seg_no", "s"))
    who = align.speaker_align(s.select("video_id", "seg_no", F.col("s.start").alias("start_sec"), F.col("s.end").alias("end_sec")), turn)
    full = s.join(who.select("video_id", "seg_no", "speaker"), ["video_id", "seg_no"])
    seg = F.struct("seg_no", F.struct("s.start", "s.end", "s.text", "s.confidence", "speaker").alias("v"))
    js = full.groupBy("video_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(seg)), lambda x: x["v"])).alias("_j"))
    return t.join(js, "video_id").withColumn("segments_json", F.col("_j")).drop("_j")


def select_frames(v: DataFrame, strategy: str, most: int, scene: DataFrame | None = None) -> DataFrame:
    """Times of the frames to take by strategy: interval, scene, motion (both from found frames) or hybrid."""
    if strategy == "interval":
        f = frames.interval_sample(v, F.lit(most)).select("video_id", "timestamp_sec", F.col("i").cast("bigint").alias("id"), F.lit(0.0).alias("score"))
    elif strategy in ("scene", "motion"):
        w = Window.partitionBy("video_id").orderBy("timestamp_sec")
        f = scene.withColumn("id", F.row_number().over(w).cast("bigint")).select("video_id", "timestamp_sec", "id", F.lit(1.0 if strategy == "motion" else 0.0).alias("score"))
    elif strategy == "hybrid":
        w = Window.partitionBy("video_id").orderBy("timestamp_sec")
        f = frames.hybrid_fill(v, scene, most).withColumn("id", F.row_number().over(w).cast("bigint")).select("video_id", "timestamp_sec", "id", F.lit(0.0).alias("score"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return frames.reindex(frames.keyframe_trim(frames.first_last_guard(v, f), most))


def _vision(w: Warehouse, mine: DataFrame, o: Options) -> DataFrame:
    v = mine.select(F.col("id").alias("video_id"), "duration_sec")
    fresh = store.todo(v, w.read("keyframes"), "video_id")
    f = select_frames(fresh, o.strategy, o.max_frames, o.extra.get("scene")).drop("id")
    path = F.concat(F.lit("frames/"), "video_id", F.lit("/"), F.lpad(F.col("frame_index").cast("string"), 4, "0"), F.lit(".jpg"))
    f = f.select("video_id", "frame_index", "timestamp_sec", path.alias("file_path"), F.lit(o.strategy).alias("strategy"))
    w.append("keyframes", _outcome(_numbered(w, "keyframes", f, ["video_id", "timestamp_sec"]), "frames"))
    # Gated on the descriptions themselves, so frames that a broken run left undescribed are described later.
    k = w.read("keyframes").join(v, "video_id")
    total = k.groupBy("video_id").agg(F.count("*").alias("total"))
    prompt = X.frame_prompt(F.col("frame_index"), F.col("total"), F.col("timestamp_sec"), F.col("duration_sec"))
    k = k.join(total, "video_id").select(F.col("id").alias("keyframe_id"), "video_id", "file_path", prompt.alias("prompt"))
    todo = store.todo(k, w.read("vision_descriptions"), "keyframe_id").withColumn("keyframe_id", F.col("keyframe_id").cast("string"))
    got = _outcome(plugins.call_each(todo, "keyframe_id", "vlm", o.vlm, lambda m, r: m.describe(r["file_path"], r["prompt"])), "descriptions")
    of = k.select(F.col("keyframe_id").cast("string").alias("keyframe_id"), "video_id")
    bad, got = _outcome(_failed(got.join(of, "keyframe_id")).groupBy("id").agg(F.min("e").alias("e")), "undescribed"), got.where("ok")
    r = F.col("result")
    w.put_latest("vision_descriptions", got.select(F.col("keyframe_id").cast("bigint"), F.get_json_object(r, "$.description").alias("description"), F.get_json_object(r, "$.objects").alias("objects_json"), F.get_json_object(r, "$.text_in_frame").alias("text_in_frame"), F.lit(o.vlm).alias("vlm_backend"), F.lit(None).cast("string").alias("vlm_model")), "keyframe_id")
    return bad


def _merge(w: Warehouse, mine: DataFrame, o: Options) -> DataFrame:
    from cliplake.plans import reference as R

    v = store.todo(mine.select(F.col("id").alias("video_id")), w.read("analyses"), "video_id").join(w.read("videos").withColumnRenamed("id", "video_id"), "video_id").select("video_id", "title", "platform", "uploader", "duration_sec")
    k = w.read("keyframes").join(w.read("vision_descriptions").withColumnRenamed("keyframe_id", "id"), "id")
    fr = k.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp_sec", "id", "description"))), lambda x: F.concat(F.lit("["), X.fixed(x["timestamp_sec"], 1), F.lit("s] "), x["description"])), "\n").alias("frames"))
    ev = R.sound_lines(w.read("audio_events"))
    prompts = R.merge_prompts(v, R.transcript_lines(w.read("transcripts")), fr, ev, MERGE_TASK + R.TEMPLATE)
    got = _outcome(plugins.call_each(prompts, "video_id", "llm", o.llm, lambda m, r: m.complete(r["prompt"], max_tokens=800, temperature=0.1)), "analyses")
    bad, got = _failed(got), got.where("ok")
    w.put_latest("analyses", merged_replies(got.select("video_id", F.get_json_object(F.concat(F.lit('{"r":'), "result", F.lit("}")), "$.r").alias("reply"))), "video_id")
    _set(w, got.select(F.col("video_id").alias("id")), "analyzed")
    return bad


def merged_replies(replies: DataFrame) -> DataFrame:
    """Rows of ``analyses`` from model replies (video_id, reply); a reply without an object becomes the summary."""
    v = replies.withColumn("v", X.lenient_json(F.col("reply")))
    lost = F.to_json(F.struct(F.col("reply").alias("summary"), F.array().cast("array<string>").alias("topics"), F.lit("failed to parse JSON").alias("error")))
    part = lambda f, empty: F.coalesce(F.to_json(F.try_variant_get("v", f"$.{f}", "variant")), F.lit(empty))
    return v.select(
        "video_id", F.when(F.col("v").isNull(), F.col("reply")).otherwise(F.coalesce(F.try_variant_get("v", "$.summary", "string"), F.lit(""))).alias("summary"),
        part("topics", "[]").alias("topics_json"), part("hook", "{}").alias("hooks_json"), part("style", "{}").alias("style_json"), part("engagement_signals", "{}").alias("engagement_signals_json"),
        F.coalesce(F.to_json("v"), lost).alias("full_json"), F.current_timestamp().alias("created_at"),
    )


def score(w: Warehouse, mine: DataFrame, llm: str) -> DataFrame:
    """Scores of the analyzed videos that have none; answers with those that failed."""
    from cliplake.plans import reference as R

    todo = store.todo(w.read("analyses").join(mine.select(F.col("id").alias("video_id")), "video_id", "left_semi"), w.read("scores"), "video_id")
    prompts = todo.select("video_id", F.concat(F.lit(SCORE_TASK), "full_json").alias("prompt"))
    got = _outcome(plugins.call_each(prompts, "video_id", "llm", llm, lambda m, r: m.complete(r["prompt"], max_tokens=300, temperature=0.2)), "scores")
    bad, got = _failed(got), got.where("ok")
    reply = got.select("video_id", F.get_json_object(F.concat(F.lit('{"r":'), "result", F.lit("}")), "$.r").alias("reply"))
    w.put_latest("scores", R.score_columns(reply).withColumn("model_used", F.lit(llm)), "video_id")
    return bad
