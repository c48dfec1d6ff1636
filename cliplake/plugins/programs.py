"""Backends that run outside programs: downloader, speech recognition, audio and frame extraction.

Each builds its arguments and reads the program's output; ``run`` can be replaced (tests). Files are written
to the folder given, which executors share if a later stage runs elsewhere.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from collections.abc import Callable
from typing import Any

from cliplake.functions.urls import IDS
from cliplake.plugins import Spacing, register
from cliplake.settings import setting
from cliplake.sources.files import PAGES, TITLE_LIMIT
from cliplake.sources.listing import platform_of

#: Seconds a program may take (fixed values).
METADATA, DOWNLOAD, BROWSE, CONVERT, RECOGNISE, EXTRACT, ONE_FRAME = 60, 300, 120, 120, 300, 120, 30
#: Per platform: begin of file names, format wanted, further options, member that names the uploader else (fixed values).
SITES = {
    "youtube": ("yt", "bestvideo[height<=720]+bestaudio/best[height<=720]/best", ["--remote-components", "ejs:github"], "channel"),
    "instagram": ("ig", "bestvideo+bestaudio/best", [], "uploader_id"),
    "tiktok": ("tt", "bestvideo+bestaudio/best", [], "creator"),
}
#: Filters that find frames (fixed values).
FILTERS = {"scene": "select='gt(scene,0.3)',showinfo", "motion": "mpdecimate=hi=200:lo=100:frac=0.5,setpts=N/FRAME_RATE/TB,showinfo"}

Run = Callable[[list[str], float], "tuple[int, str, str]"]


def run_program(args: list[str], timeout: float) -> tuple[int, str, str]:
    """(exit code, output, error output)."""
    r = subprocess.run(args, capture_output=True, text=True, timeout=timeout, check=False)
    return r.returncode, r.stdout, r.stderr


def checked(run: Run, args: list[str], timeout: float, what: str) -> tuple[str, str]:
    code, out, err = run(args, timeout)
    if code != 0:
        raise RuntimeError(f"{what} failed: {err[:500]}")
    return out, err


class Downloader:
    """Metadata, files and listings of the three platforms; calls to one platform are spaced within the process."""

    spacing = Spacing()

    def __init__(self, folder: str | None = None, run: Run = run_program, spacing: Spacing | None = None) -> None:
        self.folder, self.run = folder or os.path.join(setting("CLIPLAKE_DATA"), "videos"), run
        self.spacing = spacing or Downloader.spacing

    def _base(self, platform: str) -> list[str]:
        cookies = setting("IG_COOKIES_FILE")
        return [setting("YT_DLP_BIN"), *(["--cookies", cookies] if platform == "instagram" and cookies and os.path.exists(cookies) else [])]

    def download(self, url: str) -> dict:
        platform = platform_of(url)
        if platform not in SITES:
            raise ValueError(f"unsupported URL: {url}")
        self.spacing.wait(platform)
        prefix, wanted, more, other = SITES[platform]
        info = json.loads(checked(self.run, [*self._base(platform), "--dump-json", "--no-download", *more, url], METADATA, "reading metadata")[0])
        found = next((m[1] for p in IDS[platform] if (m := re.search(p, url))), None)
        name = info.get("id", found) if platform == "tiktok" or found is None else found
        single = ["--no-playlist"] if platform == "youtube" else []
        args = ["-f", wanted, "--merge-output-format", "mp4", "-o", os.path.join(self.folder, f"{prefix}_{name}.%(ext)s"), *single, *more, url]
        checked(self.run, [*self._base(platform), *args], DOWNLOAD, "download")
        path = os.path.join(self.folder, f"{prefix}_{name}.mp4")
        there = os.path.exists(path)
        title = info.get("title", "" if platform == "youtube" else info.get("description", "")[:100])
        return {
            "title": title, "uploader": info.get("uploader", info.get(other, "")), "duration_sec": float(info.get("duration") or 0), "upload_date": info.get("upload_date", ""),
            "file_path": path if there else "", "file_size_bytes": os.path.getsize(path) if there else 0,
        }

    def browse(self, url: str, limit: int = 30) -> list[dict]:
        """The entries of a page of one platform; lines that are no JSON are dropped."""
        platform = platform_of(url)
        if platform not in PAGES:
            raise NotImplementedError(f"no listings of {platform or 'this platform'}: {url}")
        args = [*self._base(platform), "--flat-playlist", "--dump-json", "--no-download", "--playlist-end", str(limit), *SITES[platform][2], url]
        out = []
        for line in checked(self.run, args, BROWSE, "listing")[0].splitlines():
            try:
                e = json.loads(line) if line.strip() else None
            except ValueError:
                continue
            if isinstance(e, dict):
                title = e.get("title") or (e.get("description") if platform == "instagram" else "") or ""
                out.append(e | {"title": title[: TITLE_LIMIT.get(platform)]})
        return out


def recognised(text: str, model: str) -> dict:
    """The answer of a speech program: transcription[].offsets in milliseconds, result.language."""
    data = json.loads(text)
    segs = []
    for s in data.get("transcription", []):
        if spoken := s.get("text", "").strip():
            at = s.get("offsets", {})
            segs.append({"start": at.get("from", 0) / 1000, "end": at.get("to", 0) / 1000, "text": spoken})
    return {"language": data.get("result", {}).get("language", ""), "text": " ".join(s["text"] for s in segs), "segments": segs, "model": model, "duration_sec": 0.0}


def extract_audio(video: str, wav: str, rate: int = 16_000, run: Run = run_program) -> str:
    """The sound of a video as mono wave file."""
    checked(run, [setting("FFMPEG_BIN"), "-i", video, "-ar", str(rate), "-ac", "1", "-y", wav], CONVERT, "audio extraction")
    if not os.path.exists(wav):
        raise RuntimeError("audio extraction gave no file")
    return wav


class SpeechProgram:
    def __init__(self, program: str, model: str, run: Run = run_program) -> None:
        self.program, self.model, self.run = program, model, run

    def transcribe(self, path: str) -> dict:
        with tempfile.TemporaryDirectory() as scratch:  # of this call only
            wav = path if path.endswith(".wav") else extract_audio(path, os.path.join(scratch, "sound.wav"), run=self.run)
            out, _ = checked(self.run, [self.program, "-m", self.model, "-f", wav, "--output-json", "-l", "auto"], RECOGNISE, "speech recognition")
        return recognised(out, self.model)


class SpeechModule:
    """Speech recognition by a Python package, where it is installed."""

    def __init__(self, model: str) -> None:
        self.name, self.model = model, None

    def transcribe(self, path: str) -> dict:
        if self.model is None:
            try:
                from faster_whisper import WhisperModel
            except ImportError as e:
                raise RuntimeError("the speech package is not installed") from e
            self.model = WhisperModel(self.name)
        found, info = self.model.transcribe(path)
        segs = [{"start": s.start, "end": s.end, "text": s.text.strip(), "confidence": s.avg_logprob} for s in found]
        return {"language": info.language, "text": " ".join(s["text"] for s in segs), "segments": segs, "model": self.name, "duration_sec": info.duration}


def duration(video: str, run: Run = run_program) -> float:
    """Seconds by the probe, 60.0 where it answers no number."""
    program = setting("FFMPEG_BIN").replace("ffmpeg", "ffprobe")
    try:
        return float(run([program, "-v", "quiet", "-show_entries", "format=duration", "-of", "csv=p=0", video], ONE_FRAME)[1].strip())
    except (ValueError, OSError):
        return 60.0


def found_frames(video: str, pattern: str, strategy: str, most: int, run: Run = run_program) -> list[tuple[float, str]]:
    """(time, file) of the frames that the filter of a strategy finds; the log names the times in order."""
    _, _, log = run([setting("FFMPEG_BIN"), "-i", video, "-vf", FILTERS[strategy], "-vsync", "vfr", "-frames:v", str(most), "-y", pattern], EXTRACT)
    times = re.findall(r"pts_time:(\d+\.?\d*)", log)[:most]
    return [(float(t), pattern % (i + 1)) for i, t in enumerate(times) if os.path.exists(pattern % (i + 1))]


def take_frame(video: str, at: float, path: str, run: Run = run_program) -> bool:
    run([setting("FFMPEG_BIN"), "-ss", str(at), "-i", video, "-frames:v", "1", "-q:v", "2", "-y", path], ONE_FRAME)
    return os.path.exists(path)


def _register() -> None:
    made: dict[tuple[str, str], Callable[[], Any]] = {
        ("crawler", "yt-dlp"): Downloader,
        ("transcriber", "whisper-cpp"): lambda: SpeechProgram(setting("WHISPER_CPP_BIN"), setting("WHISPER_MODEL")),
        ("transcriber", "faster-whisper"): lambda: SpeechModule(setting("WHISPER_MODEL")),
    }
    for (kind, name), factory in made.items():
        register(kind, name, factory)


_register()
