"""Command line: browse, crawl, analyze, transcribe, vision, list, show, export, score, db, config, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from cliplake import plugins
from cliplake.plans import api, pipeline, rpc
from cliplake.session import local_session
from cliplake.settings import flag, load_env, setting, shown
from cliplake.sources.files import url_file
from cliplake.warehouse import Warehouse

def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cliplake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("crawl", "analyze", "transcribe", "vision"):
        c = sub.add_parser(name)
        c.add_argument("urls", nargs="*")
        c.add_argument("--file")
        if name == "analyze":
            c.add_argument("--resume", action="store_true")
            c.add_argument("--score", action="store_true")
    b = sub.add_parser("browse")
    b.add_argument("url")
    b.add_argument("--limit", type=int, default=30)
    c = sub.add_parser("list")
    c.add_argument("--status")
    c.add_argument("--platform")
    c.add_argument("--limit", type=int, default=50)
    for name in ("show", "score"):
        sub.add_parser(name).add_argument("video_id")
    c = sub.add_parser("export")
    c.add_argument("--format", choices=("json", "csv"), default="json")
    c.add_argument("--output", default="./export")
    sub.add_parser("db").add_argument("action", choices=("stats", "reset", "migrate"))
    sub.add_parser("config").add_argument("action", choices=("show", "check"))
    sub.add_parser("serve")
    return p


def options(command: str, score: bool = False) -> pipeline.Options:
    return pipeline.Options(
        crawler=setting("CRAWLER_BACKEND"), transcriber=setting("WHISPER_BACKEND"), vlm=setting("VLM_BACKEND"), llm=setting("LLM_BACKEND"), audio=setting("AUDIO_BACKEND") or None,
        diarizer=(setting("DIARIZE_BACKEND") or None) if flag("DIARIZE_ENABLED") else None,
        skip_transcribe=command in ("crawl", "vision"), skip_vision=command in ("crawl", "transcribe"), score=score, strategy=setting("KEYFRAME_STRATEGY"), max_frames=int(setting("KEYFRAME_MAX")),
    )


def main(argv: list[str] | None = None, warehouse: Warehouse | None = None) -> int:
    a = parser().parse_args(argv)
    load_env(".env")
    if a.command == "config":
        print(json.dumps(shown(), indent=2))
        if a.action == "check":
            for kind, name in (("llm", "LLM_BACKEND"), ("vlm", "VLM_BACKEND"), ("transcriber", "WHISPER_BACKEND"), ("crawler", "CRAWLER_BACKEND")):
                plugins.backend(kind, setting(name))
        return 0
    if a.command == "browse":
        for e in plugins.backend("crawler", setting("CRAWLER_BACKEND")).browse(a.url, a.limit):
            print(e["id"], e["title"])
        return 0
    w = warehouse or Warehouse(local_session(), setting("CLIPLAKE_DATA"))
    if a.command == "serve":
        out, sys.stdout = sys.stdout.buffer, sys.stderr  # stdout carries messages only
        rpc.serve(w, sys.stdin.buffer, out)
    elif a.command == "list":
        for v in api.list_videos(w, a.status, a.platform, a.limit):
            print(v["video_id"], v["platform"], v["status"], (v["title"] or "(untitled)")[:50])
    elif a.command == "show":
        found = api.show_video(w, a.video_id)
        if found is None:
            print(f"Video not found: {a.video_id}", file=sys.stderr)
            return 1
        print(json.dumps(found, ensure_ascii=False, indent=2, default=str))
    elif a.command == "export":
        print(api.export_json(w, a.output) if a.format == "json" else api.export_csv(w, a.output))
    elif a.command == "score":
        if w.read("analyses").where(F.col("video_id") == a.video_id).isEmpty():
            print(f"No analysis of {a.video_id}", file=sys.stderr)
            return 1
        pipeline.score(w, w.spark.createDataFrame([(a.video_id,)], "id string"), setting("LLM_BACKEND"))
        print(w.read("scores").where(F.col("video_id") == a.video_id).first().asDict())
    elif a.command == "db":
        if a.action == "stats":
            print(json.dumps(api.stats(w), indent=2))
        elif a.action == "migrate":
            print(w.version())
        elif input("Type 'yes' to delete all data: ").strip() == "yes":
            w.reset()
    else:
        batch = pipeline.resumable(w) if getattr(a, "resume", False) else None
        if batch is None:
            given = w.spark.createDataFrame([(u,) for u in a.urls], "url string")
            urls = url_file(w.spark, a.file, a.urls) if a.file else given
            batch = pipeline.create_batch(w, urls, "cli")
        try:
            pipeline.run(w, batch, options(a.command, getattr(a, "score", False)))
        except KeyboardInterrupt:
            pipeline.interrupt(w, batch)
            return 130
        print(batch)
    return 0


if __name__ == "__main__":
    sys.exit(main())
