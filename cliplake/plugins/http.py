"""Models behind HTTP servers: two common protocols, for text and for frames. Standard library only.

``Chat``: POST <base>/chat/completions with messages. ``Generate``: POST <base>/api/generate with a prompt.
Addresses, models and keys come from the settings; the transport can be replaced (tests).
"""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable
from typing import Any

from cliplake.functions.text import MIME
from cliplake.plugins import register
from cliplake.settings import setting

#: Seconds a server may take (fixed values).
TEXT_TIMEOUT, FRAME_TIMEOUT = 120, 60
#: Answer length for a frame (fixed value).
FRAME_TOKENS = 300


def post(url: str, payload: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read().decode())


def image(path: str) -> tuple[str, str]:
    """(media type by ending, base64 of the file)."""
    with open(path, "rb") as f:
        return MIME.get(path.rsplit(".", 1)[-1].lower(), "image/jpeg"), base64.b64encode(f.read()).decode()


class Chat:
    def __init__(self, base: str, model: str = "", key: str = "", send: Callable[..., dict] = post) -> None:
        self.url, self.model, self.send = base.rstrip("/") + "/chat/completions", model, send
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}

    def _ask(self, content: Any, timeout: float, **more: Any) -> str:
        payload = {"messages": [{"role": "user", "content": content}], **more} | ({"model": self.model} if self.model else {})
        return self.send(self.url, payload, self.headers, timeout)["choices"][0]["message"]["content"]

    def complete(self, prompt: str, max_tokens: int = 800, temperature: float = 0.1) -> str:
        return self._ask(prompt, TEXT_TIMEOUT, max_tokens=max_tokens, temperature=temperature)

    def describe(self, path: str, prompt: str) -> dict:
        kind, data = image(path)
        parts = [{"type": "image_url", "image_url": {"url": f"data:{kind};base64,{data}"}}, {"type": "text", "text": prompt}]
        return {"description": self._ask(parts, FRAME_TIMEOUT, max_tokens=FRAME_TOKENS), "objects": [], "text_in_frame": ""}


class Generate:
    def __init__(self, base: str, model: str, send: Callable[..., dict] = post) -> None:
        self.url, self.model, self.send = base.rstrip("/") + "/api/generate", model, send

    def _ask(self, prompt: str, timeout: float, **more: Any) -> str:
        return self.send(self.url, {"model": self.model, "prompt": prompt, "stream": False, **more}, {}, timeout).get("response", "")

    def complete(self, prompt: str, max_tokens: int = 800, temperature: float = 0.1) -> str:
        return self._ask(prompt, TEXT_TIMEOUT, options={"num_predict": max_tokens, "temperature": temperature})

    def describe(self, path: str, prompt: str) -> dict:
        return {"description": self._ask(prompt, FRAME_TIMEOUT, images=[image(path)[1]]), "objects": [], "text_in_frame": ""}


register("llm", "omlx", lambda: Chat(setting("OMLX_BASE_URL"), setting("LLM_MODEL")))
register("llm", "ollama", lambda: Generate(setting("OLLAMA_BASE_URL"), setting("LLM_MODEL") or "llama3"))
register("llm", "openclaw", lambda: Chat(setting("OPENCLAW_BASE_URL"), setting("OPENCLAW_MODEL"), setting("OPENCLAW_API_KEY")))
register("vlm", "omlx", lambda: Chat(setting("OMLX_BASE_URL"), setting("VLM_MODEL")))
register("vlm", "ollama", lambda: Generate(setting("OLLAMA_BASE_URL"), setting("VLM_MODEL") or "llava"))
