"""Lenient reading of JSON written by models: prose around it, JSON inside JSON text, case of names."""

from __future__ import annotations

import json
import re
from typing import Any

_DECODER = json.JSONDecoder()
_OPEN = re.compile(r"[\[{]")


def unwrap(value: Any) -> Any:
    """A string that is itself JSON counts as that JSON, however often it is wrapped; anything else stays."""
    while isinstance(value, str):  # each time the text is shorter by its quotes at least
        text = value.strip()
        if not text or text[0] not in '[{"':
            return value
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return value
    return value


def read_json(text: str | None) -> Any:
    """The object or array in ``text``: the whole text, or the longest one within prose; None if there is none.

    A bracket of the prose itself fails at its first character and is passed over. JSON that begins well and
    breaks off later is broken: then nothing is read, rather than some inner object of it.
    """
    if text is None:
        return None
    text = text.strip("\ufeff \t\r\n")
    if not text:
        return None
    try:
        value = unwrap(json.loads(text))
        if not isinstance(value, str):
            return value
        text = value
    except (ValueError, RecursionError):
        pass
    best, size, at = None, 0, 0
    while m := _OPEN.search(text, at):
        try:
            value, end = _DECODER.raw_decode(text, m.start())
        except RecursionError:
            return None
        except json.JSONDecodeError as e:
            if e.pos - m.start() > 1:
                return None
            at = m.end()
            continue
        if end - m.start() > size:
            best, size = value, end - m.start()
        at = end
    return best


def field(obj: Any, name: str) -> Any:
    """The member ``name`` of an object, whatever its case; JSON text inside it is read."""
    if not isinstance(obj, dict):
        return None
    if name in obj:
        return unwrap(obj[name])
    for k, v in obj.items():
        if k.lower() == name:
            return unwrap(v)
    return None


def items(value: Any) -> list[tuple[int, Any]]:
    """Positions and members of an array; a lone object has position 0; other values have none."""
    value = unwrap(value)
    if isinstance(value, dict):
        return [(0, value)]
    if isinstance(value, list):
        return [(i, unwrap(v)) for i, v in enumerate(value)]
    return []
