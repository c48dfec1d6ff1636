import io
import json

import pytest

from cliplake import plugins
from cliplake.__main__ import main
from cliplake.plans import api, pipeline, rpc
from cliplake.settings import load_env
from cliplake.streaming.ingest import drain_url_files
from cliplake.warehouse import Warehouse

URLS = ["https://youtube.com/shorts/abcdefghijk", "https://www.instagram.com/reel/Abc_1/", "https://www.tiktok.com/@u/video/123"]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    w = Warehouse(spark, str(tmp_path_factory.mktemp("wh")))
    urls = spark.createDataFrame([(u,) for u in [*URLS, "https://youtube.com/shorts/brokenbroke", "https://example.org/x"]], "url string")
    batch = pipeline.create_batch(w, urls)
    pipeline.run(w, batch, pipeline.Options(audio="fake", diarizer="fake", score=True))
    return w, batch


def test_batch_outcome(done):
    w, batch = done
    items = {r.url: r for r in w.read("batch_items").collect()}
    assert all(items[u].status == "done" and items[u].video_id for u in URLS)
    assert "download failed" in items["https://youtube.com/shorts/brokenbroke"].error_message
    assert "unsupported" in items["https://example.org/x"].error_message
    b = w.read("batches").first()
    assert (b.id, b.total_urls, b.completed, b.failed, b.status) == (batch, 5, 3, 2, "completed")


def test_stages_wrote_their_tables(done):
    w, _ = done
    assert w.read("videos").where("status = 'analyzed'").count() == 3
    assert w.read("transcripts").where("segments_json LIKE '%S00%'").count() == 3
    merged = w.read("audio_events").where("event_type = 'music'").collect()
    assert len(merged) == 3 and all((r.start_sec, r.end_sec, r.confidence) == (0.0, 4.0, 0.9) for r in merged)
    assert w.read("keyframes").count() == w.read("vision_descriptions").count() > 0
    s = w.read("scores").first()
    assert (s.hook_strength, s.overall, s.model_used) == (7.5, 6.85, "fake")
    ids = [r.id for r in w.read("keyframes").select("id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_second_run_has_nothing_to_do(done, spark):
    w, _ = done
    before = w.read("analyses").collect()
    again = pipeline.create_batch(w, spark.createDataFrame([(URLS[0] + "?x=1",)], "url string"))
    pipeline.run(w, again, pipeline.Options())
    assert w.read("analyses").count() == len(before)


def test_errors_of_every_stage_stay_with_their_item(spark, tmp_path):
    class Grumpy(plugins.FakeTranscriber):
        def transcribe(self, path):
            if path.endswith(("0.mp4", "1.mp4", "2.mp4", "3.mp4", "4.mp4")):
                raise RuntimeError("no speech today")
            return super().transcribe(path)

    class Blind(plugins.FakeDescriber):
        def describe(self, path, prompt):
            if path.endswith("0001.jpg"):
                raise RuntimeError("too dark")
            return super().describe(path, prompt) | {"description": prompt}

    plugins.register("transcriber", "grumpy", Grumpy)
    plugins.register("vlm", "blind", Blind)
    w = Warehouse(spark, str(tmp_path / "w"))
    urls = [f"https://youtube.com/shorts/{k:011d}" for k in range(8)]
    b = pipeline.create_batch(w, spark.createDataFrame([(u,) for u in urls], "url string"))
    pipeline.run(w, b, pipeline.Options(transcriber="grumpy"))
    items = w.read("batch_items").collect()
    bad = [r for r in items if r.status == "error"]
    assert 0 < len(bad) < 8 and all("no speech today" in r.error_message for r in bad)
    assert {r.video_id for r in w.read("analyses").collect()} == {r.video_id for r in items if r.status == "done"}
    again = Warehouse(spark, str(tmp_path / "v"))
    b = pipeline.create_batch(again, spark.createDataFrame([(u,) for u in urls[:2]], "url string"))
    pipeline.run(again, b, pipeline.Options(vlm="blind"))
    assert all(r.status == "error" and "too dark" in r.error_message for r in again.read("batch_items").collect())
    assert again.read("analyses").count() == 0 and again.read("vision_descriptions").where("description LIKE 'This is frame 1 of %. Captured at %'").count() == 2


def test_queued_batch_is_resumable(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    got = api._call(w, "analyze", {"urls": URLS[:1], "wait": False}, pipeline.Options())
    assert got["status"] == "queued" and got["warning"] and pipeline.resumable(w) == got["batch_id"]


def test_append_keeps_the_parts(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    row = lambda i: spark.createDataFrame([(i, "v", "speech", "x", 0.0, 1.0, 0.5)], "id bigint, video_id string, event_type string, label string, start_sec double, end_sec double, confidence double")
    w.append("audio_events", row(1))
    first = w._parts("audio_events")
    w.append("audio_events", row(2))
    assert w._parts("audio_events")[:1] == first and len(w._parts("audio_events")) == 2
    assert sorted(r.id for r in w.read("audio_events").collect()) == [1, 2]
    w.replace("audio_events", row(3))
    assert w.vacuum() == 2 and [r.id for r in w.read("audio_events").collect()] == [3]


def test_duplicate_url_is_refused(done, spark):
    with pytest.raises(ValueError):
        pipeline.create_batch(done[0], spark.createDataFrame([("u",), ("u",)], "url string"))


def test_resume_takes_interrupted(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    b = pipeline.create_batch(w, spark.createDataFrame([("u",)], "url string"))
    assert pipeline.resumable(w) is None
    pipeline.interrupt(w, b)
    assert pipeline.resumable(w) == b


def test_list_show_export(done, tmp_path):
    w, _ = done
    assert len(api.list_videos(w, platform="youtube")) == 1 and len(api.list_videos(w, status="", limit=-1)) == 3
    vid = api.list_videos(w)[0]["video_id"]
    shown = api.show_video(w, vid)
    assert shown["transcript"]["segments"][0]["speaker"] == "S00" and shown["keyframes"][0]["timestamp_sec"] <= shown["keyframes"][-1]["timestamp_sec"]
    assert api.show_video(w, "none") is None
    assert api.export_json(w, str(tmp_path / "j")) == 3
    record = json.loads((tmp_path / "j" / f"{vid}.json").read_text())
    assert record["analysis"]["summary"] == "A short video." and record["language"] == "en"
    assert api.export_csv(w, str(tmp_path / "c")) == 3
    body = b"".join(p.read_bytes() for p in (tmp_path / "c").iterdir())
    assert body.startswith(b"video_id,platform,url,title") and b"\r\n" in body


def test_empty_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "e"))
    assert w.version() == 3 and w.migrate() == []
    assert api.list_videos(w) == [] and api.export_csv(w, str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()
    assert api.stats(w)["tables"]["videos"] == 0


def test_rpc(done):
    w, _ = done
    assert [t["name"] for t in rpc.answer(w, {"id": 1, "method": "tools/list"})["result"]["tools"]] == ["crawl", "analyze", "list_videos", "show_video", "export"]
    assert rpc.answer(w, {"id": 1, "method": "nope"})["error"]["code"] == -32601
    assert rpc.answer(w, {"method": "notifications/initialized"}) is None
    bad = rpc.answer(w, {"id": 2, "method": "tools/call", "params": {"name": "none"}})["result"]
    assert bad["isError"] and "Unknown tool" in bad["content"][0]["text"]
    missing = api.call_tool(w, "show_video", {"video_id": "none"})
    assert missing["isError"] and "not found" in missing["content"][0]["text"]
    body = json.dumps({"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "list_videos", "arguments": {}}}).encode()
    out = io.BytesIO()
    rpc.serve(w, io.BytesIO(b"Content-Length: %d\r\n\r\n" % len(body) + body), out)
    out.seek(0)
    assert len(json.loads(rpc.read_message(out)["result"]["content"][0]["text"])) == 3


def test_cli(done, capsys, tmp_path, monkeypatch):
    w, _ = done
    monkeypatch.setenv("CRAWLER_BACKEND", "fake")
    assert main(["list"], w) == 0 and "analyzed" in capsys.readouterr().out
    assert main(["show", "none"], w) == 1
    assert main(["config", "check"]) == 0
    assert main(["browse", "https://youtube.com/@u", "--limit", "2"]) == 0
    env = tmp_path / "env"
    env.write_text("A_NEW='x=1'\n# no\nPATH=gone\n")
    load_env(str(env))
    import os

    assert os.environ["A_NEW"] == "x=1" and os.environ["PATH"] != "gone"


def test_unknown_backends():
    with pytest.raises(ValueError):
        plugins.backend("llm", "none")
    with pytest.raises(ValueError):
        plugins.register("oracle", "x", object)


def test_retry_and_spacing():
    waits, calls = [], []

    @plugins.retry(3, 1.0, 2.0, waits.append)
    def f():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return "ok"

    assert f() == "ok" and waits == [1.0, 2.0]
    now, slept = [0.0], []
    s = plugins.Spacing(lambda: now[0], slept.append)
    s.wait("instagram")
    s.wait("instagram")
    assert slept == [12.0]


def test_strategies(spark):
    v = spark.createDataFrame([("a", 20.0), ("b", 0.0)], "video_id string, duration_sec double")
    scene = spark.createDataFrame([("a", 3.0), ("a", 9.0)], "video_id string, timestamp_sec double")
    for s in ("interval", "scene", "motion", "hybrid"):
        got = pipeline.select_frames(v, s, 4, scene).collect()
        assert 0 < len(got) <= 4 and {r.video_id for r in got} == {"a"}
    with pytest.raises(ValueError):
        pipeline.select_frames(v, "none", 4, scene)


def test_reply_without_json(spark):
    r = pipeline.merged_replies(spark.createDataFrame([("a", "sorry"), ("b", 'x {"summary": "s", "topics": ["t"]} y')], "video_id string, reply string"))
    got = {x.video_id: x for x in r.collect()}
    assert got["a"].summary == "sorry" and "failed to parse" in got["a"].full_json
    assert (got["b"].summary, got["b"].topics_json, got["b"].style_json) == ("s", '["t"]', "{}")


def test_stream_of_url_files(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("u1\n\n# no\nu2\nu1\n")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "cp"), w)
    assert drain_url_files(*args) == 1 and drain_url_files(*args) == 0
    (tmp_path / "in" / "2.txt").write_text("u2\nu3\n")
    assert drain_url_files(*args) == 1
    assert sorted(r.url for r in w.read("batch_items").collect()) == ["u1", "u2", "u3"]
