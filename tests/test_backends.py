"""Backends over HTTP and by programs, with a fake transport and fake programs."""

import base64
import json

import pytest

from cliplake import plugins, settings
from cliplake.plugins import http, programs


class Server:
    def __init__(self, answer):
        self.answer, self.calls = answer, []

    def __call__(self, url, payload, headers, timeout):
        self.calls.append((url, payload, headers, timeout))
        return self.answer


def test_chat_protocol():
    s = Server({"choices": [{"message": {"content": "ok"}}]})
    assert http.Chat("http://h:1/v1/", "m", send=s).complete("hello", max_tokens=123, temperature=0.3) == "ok"
    url, body, headers, timeout = s.calls[0]
    assert (url, headers, timeout) == ("http://h:1/v1/chat/completions", {}, 120)
    assert body == {"messages": [{"role": "user", "content": "hello"}], "max_tokens": 123, "temperature": 0.3, "model": "m"}
    http.Chat("http://h:1/v1", "", "secret", send=s).complete("x")
    assert s.calls[1][2] == {"Authorization": "Bearer secret"} and "model" not in s.calls[1][1]


def test_generate_protocol():
    s = Server({"response": "ok"})
    assert http.Generate("http://h:2", "m", send=s).complete("p", max_tokens=77, temperature=0.4) == "ok"
    assert s.calls[0][:2] == ("http://h:2/api/generate", {"model": "m", "prompt": "p", "stream": False, "options": {"num_predict": 77, "temperature": 0.4}})
    assert http.Generate("http://h:2", "m", send=Server({})).complete("p") == ""


def test_frames(tmp_path):
    f = tmp_path / "a.PNG"
    f.write_bytes(b"\x00pic")
    data = base64.b64encode(b"\x00pic").decode()
    s = Server({"choices": [{"message": {"content": "a cat"}}]})
    assert http.Chat("http://h", "m", send=s).describe(str(f), "look")["description"] == "a cat"
    content = s.calls[0][1]["messages"][0]["content"]
    assert content[0]["image_url"]["url"] == f"data:image/png;base64,{data}" and content[1] == {"type": "text", "text": "look"}
    assert s.calls[0][1]["max_tokens"] == 300 and s.calls[0][3] == 60
    g = Server({"response": "a dog"})
    assert http.Generate("http://h", "m", send=g).describe(str(f), "look")["description"] == "a dog" and g.calls[0][1]["images"] == [data]


def test_transport(monkeypatch):
    seen = {}

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b'{"response": "yes"}'

    def opened(request, timeout):
        seen.update(url=request.full_url, body=json.loads(request.data), kind=request.headers["Content-type"], timeout=timeout)
        return Answer()

    monkeypatch.setattr("urllib.request.urlopen", opened)
    monkeypatch.setenv("OLLAMA_BASE_URL", "http://other:5")
    assert plugins.backend("llm", "ollama").complete("p") == "yes"
    assert seen["url"] == "http://other:5/api/generate" and seen["body"]["model"] == "llama3" and seen["kind"] == "application/json" and seen["timeout"] == 120


class Program:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, args, timeout):
        self.calls.append((args, timeout))
        return self.answers.pop(0)


def test_download(tmp_path):
    (tmp_path / "yt_abcdefghijk.mp4").write_bytes(b"12345")
    waits = []
    spacing = plugins.Spacing(lambda: 0.0, waits.append)
    run = Program((0, '{"title": "T", "channel": "C", "duration": 9}', ""), (0, "", ""), (1, "", "boom"))
    d = programs.Downloader(str(tmp_path), run, spacing)
    got = d.download("https://youtube.com/shorts/abcdefghijk")
    assert (got["title"], got["uploader"], got["duration_sec"], got["file_size_bytes"]) == ("T", "C", 9.0, 5)
    assert "--dump-json" in run.calls[0][0] and run.calls[0][1] == 60 and "--no-playlist" in run.calls[1][0] and run.calls[1][1] == 300
    with pytest.raises(RuntimeError, match="boom"):
        d.download("https://youtube.com/shorts/abcdefghijk")
    assert waits == [6.0]
    run = Program((0, '{"id": "77", "description": "D", "creator": "U"}', ""), (0, "", ""))
    got = programs.Downloader(str(tmp_path), run, spacing).download("https://www.tiktok.com/@u/video/123")
    assert (got["title"], got["uploader"], got["file_path"]) == ("D", "U", "") and any("tt_77" in a for a in run.calls[1][0])
    with pytest.raises(ValueError):
        d.download("https://example.org/x")


def test_browse_and_cookies(tmp_path, monkeypatch):
    cookies = tmp_path / "c.txt"
    cookies.write_text("x")
    monkeypatch.setenv("IG_COOKIES_FILE", str(cookies))
    run = Program((0, '{"id": "1", "description": "' + "d" * 150 + '"}\nbroken\n\n{"id": "2", "title": "t"}', ""))
    got = programs.Downloader(str(tmp_path), run).browse("https://www.instagram.com/u/", 7)
    assert [e["id"] for e in got] == ["1", "2"] and len(got[0]["title"]) == 100
    args = run.calls[0][0]
    assert args[1:3] == ["--cookies", str(cookies)] and args[args.index("--playlist-end") + 1] == "7"
    with pytest.raises(NotImplementedError):
        programs.Downloader(str(tmp_path), run).browse("https://www.tiktok.com/@u")


def test_speech_program(tmp_path):
    out = '{"result": {"language": "en"}, "transcription": [{"text": " Hi ", "offsets": {"from": 1500, "to": 2250}}, {"text": " "}]}'
    run = Program((0, out, ""))
    got = programs.SpeechProgram("prog", "m", run).transcribe("a.wav")
    assert got["segments"] == [{"start": 1.5, "end": 2.25, "text": "Hi"}] and got["language"] == "en" and got["text"] == "Hi"
    with pytest.raises(RuntimeError, match="no file"):
        programs.SpeechProgram("prog", "m", Program((0, "", ""))).transcribe("a.mp4")
    with pytest.raises(RuntimeError, match="bad"):
        programs.extract_audio("a.mp4", str(tmp_path / "x.wav"), run=Program((1, "", "bad")))


def test_frames_by_program(tmp_path):
    pattern = str(tmp_path / "v_scene_%03d.jpg")
    (tmp_path / "v_scene_001.jpg").write_bytes(b"")
    run = Program((0, "", "x pts_time:1.5 y\nz pts_time:3 q"))
    assert programs.found_frames("v.mp4", pattern, "scene", 4, run) == [(1.5, pattern % 1)]
    assert "select='gt(scene,0.3)',showinfo" in run.calls[0][0]
    assert programs.duration("v", Program((0, " 12.5\n", ""))) == 12.5 and programs.duration("v", Program((0, "N/A", ""))) == 60.0
    assert not programs.take_frame("v", 1.0, str(tmp_path / "none.jpg"), Program((0, "", "")))


def test_settings(monkeypatch):
    for text, want in (("true", True), ("Yes", True), ("1", True), ("no", False), ("", False)):
        monkeypatch.setenv("DIARIZE_ENABLED", text)
        assert settings.flag("DIARIZE_ENABLED") is want
    monkeypatch.setenv("PYANNOTE_AUTH_TOKEN", "t")
    assert settings.shown()["PYANNOTE_AUTH_TOKEN"] == "***" and settings.shown()["OPENCLAW_API_KEY"] == ""
    monkeypatch.setenv("RATE_LIMIT_PER_MINUTE", "30")
    slept = []
    s = plugins.Spacing(lambda: 0.0, slept.append)
    s.wait("other")
    s.wait("other")
    assert slept == [2.0]
