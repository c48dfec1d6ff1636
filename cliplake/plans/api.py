"""Reading surface over a warehouse: list, show, export, statistics; tools of the JSON-RPC server."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.functions import urls as U
from cliplake.plans import pipeline
from cliplake.plans import reference as R
from cliplake.sources.files import write_csv_exact, write_json_files
from cliplake.warehouse import Warehouse

STATS_TABLES = ("videos", "transcripts", "keyframes", "vision_descriptions", "analyses", "audio_events", "scores", "batches")


def list_videos(w: Warehouse, status: str | None = None, platform: str | None = None, limit: int = 50) -> list[dict]:
    v = w.read("videos").withColumn("created_us", F.unix_micros("created_at"))
    return [r.asDict() for r in R.list_rows(v, status, platform, limit).collect()]  # the listing is the feature


def show_video(w: Warehouse, video_id: str) -> dict | None:
    mine = lambda t, k="video_id": w.read(t).where(F.col(k) == video_id)
    row = R.show_rows(mine("videos", "id"), mine("transcripts"), mine("analyses"), mine("keyframes")).limit(1).collect()
    if not row:
        return None
    r = row[0].asDict(recursive=True)
    load = lambda s, empty: json.loads(s) if s else empty
    t, a = r["transcript"], r["analysis"]
    out: dict[str, Any] = {"video": {c: r[c] for c in ("video_id", "platform", "platform_id", "url", "title", "uploader", "duration_sec", "status", "file_path")}, "transcript": None, "analysis": None, "keyframes": r["keyframes"]}
    if t:
        out["transcript"] = {"language": t["language"], "text_full": t["text_full"], "segments": load(t["segments_json"], []), "whisper_model": t["whisper_model"], "duration_sec": t["duration_sec"]}
    if a:
        out["analysis"] = {"summary": a["summary"], "topics": load(a["topics_json"], []), "hooks": load(a["hooks_json"], []), "style": load(a["style_json"], {}), "engagement_signals": load(a["engagement_signals_json"], []), "full": load(a["full_json"], {})}
    return out


def export_rows(w: Warehouse, video_id: str | None = None) -> DataFrame:
    v = w.read("videos").where("status = 'analyzed'").withColumnRenamed("id", "video_id").drop("created_at", "updated_at")
    if video_id:
        v = v.where(F.col("video_id") == video_id)
    return v.join(w.read("analyses").drop("created_at"), "video_id").join(w.read("transcripts").select("video_id", "language", "text_full"), "video_id", "left")


def export_json(w: Warehouse, folder: str, video_id: str | None = None) -> int:
    """One pretty file per analyzed video; returns their number."""
    records = R.json_records(export_rows(w, video_id)).persist()
    try:
        write_json_files(records, folder)
        return records.count()
    finally:
        records.unpersist()


def export_csv(w: Warehouse, folder: str) -> int:
    """CSV files with the 13 columns; nothing is written if no video is analyzed."""
    if w.read("videos").where("status = 'analyzed'").isEmpty():
        return 0
    rows = R.csv_rows(export_rows(w)).persist()
    try:
        write_csv_exact(rows, folder)
        return rows.count()
    finally:
        rows.unpersist()


def stats(w: Warehouse) -> dict:
    counts = {t: w.read(t).count() for t in STATS_TABLES}
    by = lambda c: {r[0]: r[1] for r in w.read("videos").groupBy(c).count().collect()}
    return {"tables": counts, "by_status": by("status"), "by_platform": by("platform")}


TOOLS: dict[str, dict] = {
    "crawl": {"about": "Fetch videos by URL", "properties": {"urls": "array"}, "required": ["urls"]},
    "analyze": {"about": "All stages: fetch, transcribe, describe frames, merge", "properties": {"urls": "array", "skip_vision": "boolean", "skip_transcribe": "boolean", "wait": "boolean"}, "required": ["urls"]},
    "list_videos": {"about": "Videos with optional filters", "properties": {"status": "string", "platform": "string", "limit": "integer"}, "required": []},
    "show_video": {"about": "All that is known of one video", "properties": {"video_id": "string"}, "required": ["video_id"]},
    "export": {"about": "Export analyses as JSON or CSV", "properties": {"format": "string", "output": "string"}, "required": []},
}


def tool_list() -> list[dict]:
    kind = lambda t: {"type": "array", "items": {"type": "string"}} if t == "array" else {"type": t}
    return [{"name": n, "description": t["about"], "inputSchema": {"type": "object", "properties": {p: kind(k) for p, k in t["properties"].items()}, "required": t["required"]}} for n, t in TOOLS.items()]


def call_tool(w: Warehouse, name: str, args: dict, options: pipeline.Options | None = None) -> dict:
    """The tool's answer as pretty JSON in one text block; failures are error results."""
    try:
        if name not in TOOLS:
            raise KeyError(f"Unknown tool: {name}")
        text = json.dumps(_call(w, name, args, options or pipeline.Options()), ensure_ascii=False, indent=2, default=str)
        return {"content": [{"type": "text", "text": text}]}
    except Exception as e:  # noqa: BLE001 - the caller gets it as a result
        return {"content": [{"type": "text", "text": e.args[0] if isinstance(e, KeyError) and e.args else f"Error: {e}"}], "isError": True}


def _call(w: Warehouse, name: str, args: dict, o: pipeline.Options) -> Any:
    if name == "list_videos":
        return list_videos(w, args.get("status"), args.get("platform"), int(args.get("limit", 50)))
    if name == "show_video":
        found = show_video(w, args["video_id"])
        if found is None:
            raise KeyError(f"Video not found: {args['video_id']}")
        return found
    if name == "export":
        kind, out = args.get("format", "json"), args.get("output", "./export")
        if kind not in ("json", "csv"):
            raise ValueError(f"unknown format: {kind}")
        return {"exported": export_json(w, out) if kind == "json" else export_csv(w, out), "output": out}
    urls = w.spark.createDataFrame([(u,) for u in args["urls"]], "url string")
    batch = pipeline.create_batch(w, urls, "rpc")
    if name == "analyze" and args.get("wait") is False:
        pipeline.interrupt(w, batch)  # so that --resume finds it
        return {"batch_id": batch, "status": "queued", "warning": "the batch is stored only; resume it, or call again with wait=true, to process it"}
    o.skip_vision, o.skip_transcribe = bool(args.get("skip_vision", name == "crawl")), bool(args.get("skip_transcribe", name == "crawl"))
    pipeline.run(w, batch, o)
    items = w.read("batch_items").where(F.col("batch_id") == batch)
    return {"batch_id": batch, "items": [r.asDict() for r in items.select("url", "video_id", "status", "error_message").collect()]}


def is_profile(w: Warehouse, url: str) -> bool:
    u = w.spark.createDataFrame([(url,)], "url string")
    return u.select(U.is_profile(F.col("url"), U.detect_platform(F.col("url")))).first()[0]
