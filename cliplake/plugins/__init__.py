"""Models and crawlers behind small interfaces: six kinds, named backends, deterministic fakes for tests.

A backend is made once per task (not per item) and called item by item inside Arrow batches; an exception
becomes the item's error and the others go on.
"""

from __future__ import annotations

import functools
import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from cliplake.settings import setting


class Crawler(Protocol):
    def download(self, url: str) -> dict: ...
    def browse(self, url: str, limit: int = 30) -> list[dict]: ...


class Transcriber(Protocol):
    def transcribe(self, path: str) -> dict: ...


class FrameDescriber(Protocol):
    def describe(self, path: str, prompt: str) -> dict: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str, max_tokens: int = 800, temperature: float = 0.1) -> str: ...


class AudioAnalyzer(Protocol):
    def analyze(self, path: str) -> list[dict]: ...


class Diarizer(Protocol):
    def diarize(self, path: str) -> list[dict]: ...


KINDS = ("crawler", "transcriber", "vlm", "llm", "audio", "diarizer")
_BACKENDS: dict[tuple[str, str], Callable[[], Any]] = {}


def register(kind: str, name: str, factory: Callable[[], Any]) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of backend: {kind}")
    _BACKENDS[kind, name] = factory


def backend(kind: str, name: str) -> Any:
    return factory_of(kind, name)()


def factory_of(kind: str, name: str) -> Callable[[], Any]:
    if (kind, name) not in _BACKENDS:
        from cliplake.plugins import http, programs  # noqa: F401 - they register themselves
    if (kind, name) not in _BACKENDS:
        raise ValueError(f"unknown {kind} backend: {name}")
    return _BACKENDS[kind, name]


def retry(times: int = 3, wait: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """Tries a call again after growing waits; the last failure is raised."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **kwargs):
            pause = wait
            for n in range(times):
                try:
                    return f(*args, **kwargs)
                except Exception:
                    if n == times - 1:
                        raise
                    sleep(pause)
                    pause *= factor

        return run

    return wrap


class Spacing:
    """At most so many calls a minute, by spacing them (per process)."""

    #: Calls a minute by platform (fixed values); others as the settings say.
    PER_MINUTE = {"youtube": 10, "instagram": 5, "tiktok": 8}

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.clock, self.sleep, self.last = clock, sleep, {}

    def wait(self, platform: str) -> None:
        gap = 60.0 / (self.PER_MINUTE.get(platform) or int(setting("RATE_LIMIT_PER_MINUTE")))
        now, before = self.clock(), self.last.get(platform)
        if before is not None and now - before < gap:
            self.sleep(gap - (now - before))
            now = self.clock()
        self.last[platform] = now


def call_each(rows: DataFrame, key: str, kind: str, name: str, call: Callable[[Any, dict], Any]) -> DataFrame:
    """``key``, ok, result (JSON text), error: ``call(backend, row)`` for every row; failures stay with their row.

    The outcome is expensive and may differ when called again, so write it before using it twice.
    """
    factory = factory_of(kind, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    out.append((row[key], True, json.dumps(call(model, row), ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001 - the item's own error
                    out.append((row[key], False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "ok", "result", "error"])

    return rows.mapInPandas(run, f"`{key}` string, ok boolean, result string, error string")


def _seed(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


class FakeCrawler:
    def download(self, url: str) -> dict:
        if "broken" in url:
            raise RuntimeError("download failed")
        n = _seed(url)
        return {"title": f"Video {n % 1000}", "uploader": f"user{n % 7}", "duration_sec": float(5 + n % 55), "upload_date": "20240101", "file_path": f"videos/{n}.mp4", "file_size_bytes": n % 10_000}

    def browse(self, url: str, limit: int = 30) -> list[dict]:
        return [{"id": f"{_seed(url) % 1000}-{i}", "title": f"Entry {i}"} for i in range(limit)]


class FakeTranscriber:
    def transcribe(self, path: str) -> dict:
        segs = [{"start": float(3 * i), "end": float(3 * i + 3), "text": f"sentence {i}", "confidence": -0.1} for i in range(3)]
        return {"language": "en", "text": " ".join(s["text"] for s in segs), "segments": segs, "model": "fake", "duration_sec": 9.0}


class FakeDescriber:
    def describe(self, path: str, prompt: str) -> dict:
        return {"description": f"A frame at {path}.", "objects": ["phone"], "text_in_frame": ""}


class FakeModel:
    """Answers a score prompt with scores, any other with an analysis."""

    def complete(self, prompt: str, max_tokens: int = 800, temperature: float = 0.1) -> str:
        if "hook_strength" in prompt:
            return 'Here: {"hook_strength": 7.5, "information_density": 6.0, "emotional_impact": 8.0, "shareability": 5.5, "overall": 6.85, "reasoning": "ok"}'
        return json.dumps({"summary": "A short video.", "topics": ["demo"], "hook": {"opening_type": "visual"}, "style": {"format": "vlog", "pacing": "fast"}, "engagement_signals": {"face_count": 1}, "content_type": "story"})


class FakeAudio:
    def analyze(self, path: str) -> list[dict]:
        return [{"label": "Music", "start_sec": 0.0, "end_sec": 2.0, "confidence": 0.8}, {"label": "Music", "start_sec": 2.0, "end_sec": 4.0, "confidence": 0.9}, {"label": "Speech", "start_sec": 4.0, "end_sec": 6.0, "confidence": 0.7}]


class FakeDiarizer:
    def diarize(self, path: str) -> list[dict]:
        return [{"speaker": "S00", "start_sec": 0.0, "end_sec": 5.0}, {"speaker": "S01", "start_sec": 5.0, "end_sec": 10.0}]


for _kind, _fake in zip(KINDS, (FakeCrawler, FakeTranscriber, FakeDescriber, FakeModel, FakeAudio, FakeDiarizer)):
    register(_kind, "fake", _fake)
