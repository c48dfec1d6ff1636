"""JSON-RPC over a pair of byte streams, each message framed by a Content-Length header."""

from __future__ import annotations

import json
from typing import Any, BinaryIO

from cliplake.plans import api
from cliplake.warehouse import Warehouse

PROTOCOL = "2024-11-05"


def read_message(stream: BinaryIO) -> dict | None:
    """The next message; None at the end of the stream."""
    length = None
    while line := stream.readline():
        line = line.strip()
        if not line:
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value)
    if length is None:
        return None
    return json.loads(stream.read(length))


def write_message(message: dict, stream: BinaryIO) -> None:
    body = json.dumps(message, ensure_ascii=False).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    stream.flush()


def answer(w: Warehouse, request: dict) -> dict | None:
    """The response to one request; None for notifications."""
    method, rid = request.get("method"), request.get("id")
    ok = lambda result: {"jsonrpc": "2.0", "id": rid, "result": result}
    bad = lambda code, text: {"jsonrpc": "2.0", "id": rid, "error": {"code": code, "message": text}}
    try:
        if method == "initialize":
            return ok({"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "cliplake", "version": "1"}})
        if method == "notifications/initialized":
            return None
        if method == "tools/list":
            return ok({"tools": api.tool_list()})
        if method == "tools/call":
            p: dict[str, Any] = request.get("params") or {}
            return ok(api.call_tool(w, p.get("name", ""), p.get("arguments") or {}))
        return bad(-32601, f"Method not found: {method}")
    except Exception as e:  # noqa: BLE001 - the client gets it
        return bad(-32603, str(e))


def serve(w: Warehouse, source: BinaryIO, sink: BinaryIO) -> None:
    while (request := read_message(source)) is not None:
        if (response := answer(w, request)) is not None:
            write_message(response, sink)
