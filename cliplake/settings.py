"""Settings by environment variable, with their defaults; ``.env`` files."""

from __future__ import annotations

import os

#: Names and defaults (fixed values, but for the data folder).
SETTINGS = {
    "CLIPLAKE_DATA": "./data", "VLM_BACKEND": "omlx", "VLM_MODEL": "", "OMLX_BASE_URL": "http://localhost:8000/v1", "OLLAMA_BASE_URL": "http://localhost:11434",
    "LLM_BACKEND": "omlx", "LLM_MODEL": "", "OPENCLAW_BASE_URL": "http://localhost:18789/v1", "OPENCLAW_MODEL": "", "OPENCLAW_API_KEY": "",
    "WHISPER_BACKEND": "faster-whisper", "WHISPER_MODEL": "large-v3", "WHISPER_CPP_BIN": "whisper-cpp", "IG_COOKIES_FILE": "", "RATE_LIMIT_PER_MINUTE": "10",
    "KEYFRAME_STRATEGY": "scene", "KEYFRAME_MAX": "8", "PANNS_MODEL_PATH": "", "AUDIO_BACKEND": "", "AUDIO_WINDOW_SEC": "2.0", "AUDIO_HOP_SEC": "1.0",
    "FFMPEG_BIN": "ffmpeg", "YT_DLP_BIN": "yt-dlp", "CRAWLER_BACKEND": "yt-dlp", "DIARIZE_ENABLED": "false", "DIARIZE_BACKEND": "", "PYANNOTE_AUTH_TOKEN": "", "WEBHOOK_URL": "",
}
SECRET = ("OPENCLAW_API_KEY", "PYANNOTE_AUTH_TOKEN")


def setting(name: str) -> str:
    return os.environ.get(name, SETTINGS[name])


def flag(name: str) -> bool:
    """True for 'true', '1' and 'yes' in any case."""
    return setting(name).strip().lower() in ("true", "1", "yes")


def shown() -> dict[str, str]:
    """All settings; secrets only as to whether they are set."""
    return {k: ("***" if setting(k) else "") if k in SECRET else setting(k) for k in SETTINGS}


def load_env(path: str) -> None:
    """NAME=value lines; the first '=' splits, quotes are taken off, variables that exist stay."""
    if not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                name, _, value = line.partition("=")
                os.environ.setdefault(name.strip(), value.strip().strip("'\""))
