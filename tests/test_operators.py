"""Operators against plain folds and hand-written expectations."""

import random

from pyspark.sql import functions as F

from cliplake.functions import text as X
from cliplake.operators import align, audio, frames, store
from cliplake.plans import reference as R
from cliplake.sources.files import browse_entries, label_list, log_times
from cliplake.sources.wav import read_samples, sample_bytes

EV = "id bigint, video_id string, event_type string, label string, start_sec double, end_sec double, confidence double"


def fold_merge(rows):
    out = []
    for r in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        if out and out[-1][0] == r[1] and out[-1][1] == r[2] and abs(r[4] - out[-1][4]) < 0.5:
            out[-1][4], out[-1][5] = r[5], max(out[-1][5], r[6])
        else:
            out.append([r[1], r[2], r[3], r[4], r[5], r[6]])
    return sorted(map(tuple, out))


def test_merge_adjacent_examples(spark):
    run = lambda rows: sorted(tuple(r)[2:] for r in audio.merge_adjacent(spark.createDataFrame(rows, EV)).collect())
    assert run([(1, "v", "music", "Music", 0.0, 2.0, 0.8), (2, "v", "music", "Music", 2.0, 4.0, 0.9)]) == [("music", "Music", 0.0, 4.0, 0.9)]
    assert len(run([(1, "v", "music", "Music", 0.0, 2.0, 0.8), (2, "v", "speech", "S", 2.0, 4.0, 0.9)])) == 2
    assert run([]) == []


def test_merge_adjacent_random(spark):
    r, rows = random.Random(1), []
    for i in range(1500):
        s = round(r.uniform(0, 9000), 1)
        rows.append((i, r.choice("ab"), r.choice(["music", "speech"]), r.choice("xy"), s, round(s + r.uniform(0, 9), 1), r.random()))
    got = sorted(tuple(x) for x in audio.merge_adjacent(spark.createDataFrame(rows, EV)).select("video_id", "event_type", "label", "start_sec", "end_sec", "confidence").collect())
    assert got == fold_merge(rows)


def test_timeline_example(spark):
    rows = [(1, "v", "music", "M", 0.0, 6.0, 0.9), (2, "v", "silence", "S", 6.0, 8.0, 0.9), (3, "v", "speech", "T", 8.0, 10.0, 0.9)]
    d = spark.createDataFrame([("v", 10.0), ("w", 0.0), ("x", None)], "video_id string, duration_sec double")
    got = {r.video_id: tuple(r)[1:] for r in audio.audio_timeline(audio.merge_adjacent(spark.createDataFrame(rows, EV)), d).collect()}
    assert got == {"v": (True, 0.6, 0.2, "music"), "w": (False, 0.0, 0.0, ""), "x": (False, 0.0, 0.0, "")}


def test_label_classes(spark):
    df = spark.createDataFrame([(x,) for x in ("Music", "Guitar", "Speech", "Silence", "Applause", "Random", "Dog bark", None)], "l string")
    assert [r[0] for r in df.select(audio.classify_label(F.col("l"))).collect()] == ["music", "music", "speech", "silence", "applause", "sound_effect", "sound_effect", "sound_effect"]


def test_wave_samples():
    x, rate = read_samples(sample_bytes())
    assert rate == 16000 and len(x) == 100 and set(x) == {0.5}


def fold_align(segs, turns, tol=0.5):
    out = {}
    for v, n, s, e in segs:
        best, who = 0.0, ""
        for tv, _, name, a, b in turns:
            ov = min(e, b) - max(s, a)
            if tv == v and ov > best:
                best, who = ov, name
        out[v, n] = who if best >= tol or (best > 0 and e - s < 2 * tol) else ""
    return out


SEG, TURN = "video_id string, seg_no int, start_sec double, end_sec double", "video_id string, turn_no int, speaker string, start_sec double, end_sec double"


def test_align_examples(spark):
    run = lambda s, t: {(r.video_id, r.seg_no): r.speaker for r in align.speaker_align(spark.createDataFrame(s, SEG), spark.createDataFrame(t, TURN)).collect()}
    segs = [("v", 0, 0.0, 3.0), ("v", 1, 3.0, 6.0), ("v", 2, 6.0, 9.0)]
    assert set(run(segs, [("v", 0, "S00", 0.0, 20.0)]).values()) == {"S00"}
    assert run([("v", 0, 2.0, 6.0)], [("v", 0, "S00", 0.0, 5.0), ("v", 1, "S01", 5.0, 10.0)]) == {("v", 0): "S00"}
    assert run([("v", 0, 0.0, 5.0)], [("v", 0, "S00", 20.0, 30.0)]) == {("v", 0): ""}
    assert run([("v", 0, 0.0, 5.0)], []) == {("v", 0): ""}


def test_align_random(spark):
    r = random.Random(5)
    segs = [(r.choice("ab"), i, s := round(r.uniform(0, 400), 2), round(s + r.uniform(0.1, 20), 2)) for i in range(200)]
    turns = [(r.choice("ab"), i, f"S{i % 4}", s := round(r.uniform(0, 400), 2), round(s + r.uniform(0.1, 40), 2)) for i in range(60)]
    turns.append(("b", 99, "LONG", 390.0, 390.0 + 200_000))
    segs += [("a", 900, 0.0, 8e12), ("b", 901, 100.0, 5000.0), ("b", 902, 250_000.0, 900_000.0)]
    got = {(x.video_id, x.seg_no): x.speaker for x in align.speaker_align(spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN)).collect()}
    assert got == fold_align(segs, turns)


FRAME = "video_id string, timestamp_sec double, id bigint, score double"


def test_guard_and_trim_examples(spark):
    v = spark.createDataFrame([("a", 15.0), ("b", 20.0), ("c", 8.0), ("d", 0.8)], "video_id string, duration_sec double")
    f = spark.createDataFrame([("a", 5.0, 1, 0.5), ("a", 10.0, 2, 0.8), ("b", 3.0, 3, 0.2), ("b", 5.0, 4, 0.9), ("b", 7.0, 5, 0.1)], FRAME)
    got = {}
    for r in frames.keyframe_trim(frames.first_last_guard(v, f), 4).orderBy("pos").collect():
        got.setdefault(r.video_id, []).append(r.timestamp_sec)
    assert got == {"a": [0.1, 5.0, 10.0, 14.5], "b": [0.1, 3.0, 5.0, 19.5], "c": [0.1, 7.5], "d": [0.1]}


def test_trim_random(spark):
    r = random.Random(9)
    rows = [(f"v{k}", float(t), k * 100 + t, round(r.random(), 1)) for k in range(30) for t in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, FRAME)
    from pyspark.sql import Window

    df = df.withColumn("pos", F.row_number().over(Window.partitionBy("video_id").orderBy("timestamp_sec")) - 1)
    for most in (1, 2, 4):
        want = set()
        for k in range(30):
            mine = [(x[2], x[3]) for x in rows if x[0] == f"v{k}"]
            while len(mine) > most and len(mine) > 2:
                mine.pop(min(range(1, len(mine) - 1), key=lambda i: (mine[i][1], i)))
            want |= {i for i, _ in mine[:most]}
        assert {x.id for x in frames.keyframe_trim(df, most).collect()} == want


def test_hybrid_random(spark):
    r = random.Random(11)
    v = [(f"v{k}", round(r.uniform(3, 60), 2)) for k in range(40)]
    scene = [(n, round(r.uniform(0, d), 2)) for n, d in v for _ in range(r.randint(0, 5))]
    got = frames.hybrid_fill(spark.createDataFrame(v, "video_id string, duration_sec double"), spark.createDataFrame(scene, "video_id string, timestamp_sec double"), 8)
    got = sorted((x.video_id, round(x.timestamp_sec, 6), x.strategy) for x in got.collect())
    want = []
    for n, d in v:
        mine = [t for m, t in scene if m == n]
        want += [(n, t, "scene") for t in mine]
        k = max(0, 8 - len(mine))
        step, taken = max(d / (k + 1), 1.0), []
        for i in range(1, k + 1):
            t = step * i
            if t < d and all(abs(t - x) >= 1.0 for x in mine) and len(taken) < k:
                taken.append(t)
        want += [(n, round(t, 6), "interval") for t in taken]
    assert got == sorted(want)


def test_upserts(spark):
    old = spark.createDataFrame([("a", "t", 1.0, "p"), ("b", "u", None, "q")], "k string, title string, d double, fixed string")
    new = spark.createDataFrame([("a", None, 2.0, "zz"), ("c", "n", None, "r")], "k string, title string, d double, fixed string")
    got = {tuple(r) for r in store.upsert_coalesce(old, new, "k", ("title", "d"), ("fixed",)).collect()}
    assert got == {("a", "t", 2.0, "p"), ("b", "u", None, "q"), ("c", "n", None, "r")}


def test_assign_ids(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS k")
    got = {r.k: r.new_id for r in store.assign_ids(df, ["k"], 50, 7).collect()}
    assert got == {k: 51 + k for k in range(1000)}


def test_prompts(spark):
    df = spark.createDataFrame([(None, None, None, None), (0, 8, 1.5, 30.0), (None, None, 5.0, None)], "i int, n int, t double, d double")
    got = [r[0] for r in df.select(X.frame_prompt(F.col("i"), F.col("n"), F.col("t"), F.col("d"))).collect()]
    assert got == [X.FRAME_TASK, "This is frame 1 of 8. Captured at 1.5s of a 30s video.\n\n" + X.FRAME_TASK, "Captured at 5.0s\n\n" + X.FRAME_TASK]


def test_scores(spark):
    df = spark.createDataFrame([(8.0, 6.0, 7.0, 5.0)], "a double, b double, c double, d double")
    assert round(df.select(X.overall_score(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0], 6) == 6.65
    reply = '{"hook_strength": 7.5, "information_density": 6.0, "emotional_impact": 8.0, "shareability": 5.5, "overall": 6.85, "reasoning": "r"}'
    r = R.score_columns(spark.createDataFrame([(reply,), ("none",)], "reply string")).collect()
    assert (r[0].hook_strength, r[0].overall, r[0].reasoning) == (7.5, 6.85, "r") and (r[1].overall, r[1].reasoning) == (0.0, "")


def test_text_sources(spark):
    log = spark.createDataFrame([("x", "a pts_time:1.5 b\nc pts_time:3.0 d"), ("y", "none")], "k string, log string")
    assert [(r.k, r.n, r.pts) for r in log_times(log, "log").collect()] == [("x", 0, 1.5), ("x", 1, 3.0)]
    lines = spark.createDataFrame([('{"id": "q", "title": "T", "duration": 3}',), ("{broken",), ("",), ('{"id": "z", "webpage_url": "w", "channel": "c"}',)], "value string")
    got = [tuple(r) for r in browse_entries(lines, "youtube").collect()]
    assert got == [("youtube", "q", "https://www.youtube.com/watch?v=q", "T", "", 3.0, ""), ("youtube", "z", "w", "", "c", 0.0, "")]
    assert label_list(spark.createDataFrame([], "label string"), 3).orderBy("class_no").collect()[2].label == "class_2"


def test_binary_rounding(spark):
    r = random.Random(1)
    v = [0.35, 2.675, 0.125, 0.5, 1.5, 2.5, -0.04, -2.675, 0.0, 1e15, 123456.785, float("inf"), 1e300, None, -1e-9]
    v += [round(r.uniform(-1000, 1000), r.randint(0, 5)) for _ in range(3000)] + [(2 * r.randrange(10**6) + 1) / 2 ** r.randint(1, 6) for _ in range(1000)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for d in (0, 1, 2, 3):
        for x, got, text in df.select("x", X.round_binary(F.col("x"), d), X.fixed(F.col("x"), d)).collect():
            assert (got, text) == (None, None) if x is None else got == round(x, d) and (text == "%.*f" % (d, x) or abs(x) > 4e12), (x, d, got, text)
    assert spark.createDataFrame([(float("nan"),)], "x double").select(X.fixed(F.col("x"), 1)).first()[0] == "nan"


def test_bounded_sample(spark):
    from cliplake.operators.sampling import bounded_sample

    df = spark.range(50_000).selectExpr("id", "id % 7 AS _h")
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert [r.id for r in bounded_sample(df, ["id"], 300).collect()] == want
    assert bounded_sample(df.limit(20), ["id"], 300).count() == 20
    assert bounded_sample(df.limit(0), ["id"], 300).count() == 0
