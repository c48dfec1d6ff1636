import json
import random
import time

import pytest

from cliplake.llm import speech as S
from cliplake.llm.turns import ordered_segments, speaker_turns, with_speakers

T = "video_id string, language string, text_full string, segments_json string, created_at timestamp, extra string, turn_no int"
R = "video_id string, speaker string, start_sec double, end_sec double"


@pytest.mark.parametrize(
    ("text", "label", "spoken"),
    [
        ("Hello there", None, "Hello there"),
        ("[Music] (00:09) It took [laughter [loud]] four", None, "It took four"),
        ("- SPEAKER_00: Hi", "SPEAKER_00", "Hi"),
        (">> Speaker #1: Hi", "SPEAKER_01", "Hi"),
        ("<v S02>Hi", "SPEAKER_02", "Hi"),
        ("ＳＰＥＡＫＥＲ_０３: Hi", "SPEAKER_03", "Hi"),
        ("[00:00:01.500] [HOST]: Hi", "HOST", "Hi"),
        ("00:05 guest — Hi", "GUEST", "Hi"),
        ("SPK 00 (01:05): <00:01:05.000> Hi", "SPEAKER_00", "Hi"),
        ("speaker1> Hi", "SPEAKER_01", "Hi"),
        ("00:00:18.112 --> The audio", None, "The audio"),
        ("（拍手） 【音乐】 你好", None, "你好"),
        ("*coughs* ♪♪ ((crosstalk)) <inaudible>", None, ""),
        ("Here is: a list — of things", None, "Here is: a list — of things"),
        ("open [bracket and (more", None, "open [bracket and (more"),
        ("about 20 minutes at 10:30", None, "about 20 minutes at 10:30"),
        ("", None, ""),
    ],
)
def test_segments(text, label, spoken):
    u = S.parse(text)
    assert S.speaker_name(u.label) == label
    assert " ".join(u.spoken.split()) == spoken


def test_deep_and_long_text():
    u = S.parse("[" * 5000 + "x" + "]" * 5000 + " word " * 20_000)
    assert S.letters(u.spoken) >= 80_000


def test_unclosed_brackets_take_no_time():
    began = time.time()
    for text in ("([" * 500, "([{<" * 2000, "(x" * 3000, "1" * 20_000 + ":00 -->", "((((a))" * 500):
        S.parse(text)
    assert time.time() - began < 3
    assert S.parse("([" * 500).spoken == "([" * 500
    assert " ".join(S.parse("a (b [c] ( d").spoken.split()) == "a (b ( d"


def test_phrases_within_a_sentence_stay():
    same = ["Do you know the answer?", "What I mean is this.", "Could you know what it was?", "They don't you know-how"]
    assert [" ".join(S.without_fillers(x).split()) for x in same[:3]] == same[:3]
    gone = {"Do, you know, not go": "Do, , not go", "It is you know the oven": "It is the oven", "do you know not forget": "do not forget", "what I mean happened": "what happened"}
    assert {x: " ".join(S.without_fillers(x).split()) for x in gone} == gone


@pytest.mark.parametrize(
    ("text", "n"),
    [("Um, so uhhh... you know, it is", 6), ("Erm.", 0), ("um intervalo bem curtinho não", 25), ("Voltamos logo depois de um intervalo bem curtinho.", 42), ("Er ist heute da", 12), ("Um.", 0), ("It is, um, like er that", 12), ("Eeeh o sea, mañana", 6), ("嗯嗯，说实话", 3), ("えっと、今日は", 3), ("Э-э... завтра", 6), ("Tu vois, euuuh c'est", 4), ("umbrella term", 12), ("Hm. Äääh ja", 2)],
)
def test_fillers(text, n):
    assert S.letters(S.without_fillers(text)) == n


def test_names():
    same = ["SPEAKER_00", "speaker_00", "SPEAKER-00", "Speaker #0", "S00", "spk_0", "SPK 00", " SPEAKER_00 ", "speaker0", "ＳＰＥＡＫＥＲ_００", "0"]
    assert {S.speaker_name(x) for x in same} == {"SPEAKER_00"}
    assert {S.speaker_name(x) for x in ("[HOST]", "Host ", "host")} == {"HOST"}
    assert all(S.speaker_name(x) is None for x in (None, "", "UNKNOWN", " unknown ", "[]", "?", float("nan"), {}, True))


def test_times():
    assert S.seconds_ms(1.5) == 1500 and S.seconds_ms("00:00:01,500") == 1500 and S.seconds_ms("1:02") == 62_000
    assert all(S.seconds_ms(x) is None for x in (None, "x", True, "", []))


def seg(start, text, speaker=None, end=None, **more):
    return {"start": start, "end": end if end is not None else (start or 0) + 1, "text": text, "speaker": speaker, **more}


def turns(spark, segs, rows=(), raw=None):
    t = spark.createDataFrame([("v", "en", raw, json.dumps(segs) if segs is not None else None, None, "x", 7)], T)
    return [tuple(r)[1:] for r in speaker_turns(t, spark.createDataFrame(list(rows), R)).orderBy("turn_no").collect()]


def test_turns_are_ordered_and_joined(spark):
    segs = [seg(4, "cc", "S01"), seg(0, "aa", "S00"), seg(1, "[Music]", "S01"), seg(2, "bbb", "Speaker 0"), seg(0, "aa", "S00"), seg(5, "- HOST: d")]
    assert turns(spark, segs) == [(0, "SPEAKER_00", 5), (1, "SPEAKER_01", 2), (2, "HOST", 1)]


def test_raw_lines(spark):
    raw = "00:05 HOST — later\nmore\n00:01 Guest — first (applause)\n\n[laughter]\n"
    assert turns(spark, None, raw=raw) == [(0, "GUEST", 5), (1, "HOST", 9)]
    assert turns(spark, [], raw="S00> one\nS01> two\nS01> two") == [(0, "SPEAKER_00", 3), (1, "SPEAKER_01", 6)]


def test_missing_speaker_is_looked_up(spark):
    rows = [("v", "S01", 0.0, 3.0), ("v", "host", 3.0, 9.0), ("v", "bad", 9.0, 3.0), ("v", None, None, 4.0), ("v", "S05", 5.0, 1e7), ("w", "x", 0.0, 99.0)]
    segs = [seg(0, "a", None, 4), seg(2, "b", "UNKNOWN", 8), seg(400_000, "c", "", 400_010), seg(-50, "d", None, -40)]
    assert turns(spark, segs, rows) == [(0, "", 1), (1, "SPEAKER_01", 1), (2, "HOST", 1), (3, "SPEAKER_05", 1)]
    assert turns(spark, segs) == [(0, "", 4)]


def test_lookup_against_brute_force(spark):
    r = random.Random(2)
    rows = [("v", f"S{k % 7}", s := round(r.uniform(0, 9000), 2), round(s + r.expovariate(1 / r.choice((3, 600, 9000))), 2)) for k in range(120)]
    segs = [("v", k, s := r.randrange(0, 9_000_000), s + r.randrange(1, 20_000), None if k % 5 else "OWN", 1, None) for k in range(300)]
    df = spark.createDataFrame(segs, "video_id string, pos int, s bigint, e bigint, who string, n bigint, text string")
    got = {x.pos: x.speaker for x in with_speakers(df, spark.createDataFrame(rows, R)).collect()}
    for _, k, s, e, own, _, _ in segs:
        over = [(-(min(e, round(b * 1000)) - max(s, round(a * 1000))), round(a * 1000), S.speaker_name(n)) for _, n, a, b in rows]
        over = sorted(o for o in over if o[0] < 0)
        assert got[k] == (own or (over[0][2] if over else ""))


def test_lookup_of_segments_of_any_length(spark):
    r = random.Random(4)
    rows = [("v", f"S{k % 5}", s := float(r.randrange(0, 3_000_000)), s + r.choice((2.0, 500.0, 40_000.0, 2e6))) for k in range(150)]
    rows += [("v", "S77", 0.0, 8e12), ("w", "S01", 5.0, 6.0)]
    segs = [("v", k, s := r.randrange(0, 3_000_000_000), s + r.choice((900, 400_000, 10_000_000, 4_000_000_000, 8_000_000_000_000_000)), None, 1, None) for k in range(200)]
    segs += [("w", 0, 0, 8_000_000_000_000_000, None, 1, None), ("w", 1, 7000, 9000, None, 1, None), ("w", 2, 9000, 9000, None, 1, None), ("w", 3, None, 9000, None, 1, None), ("w", 4, 4000, None, None, 1, None)]
    df = spark.createDataFrame(segs, "video_id string, pos int, s bigint, e bigint, who string, n bigint, text string")
    got = {(x.video_id, x.pos): x.speaker for x in with_speakers(df, spark.createDataFrame(rows, R)).collect()}
    assert len(got) == len(segs) and {k: v for k, v in got.items() if k[0] == "w"} == {("w", 0): "SPEAKER_01", ("w", 1): "", ("w", 2): "", ("w", 3): "", ("w", 4): "SPEAKER_01"}
    for v, k, s, e, *_ in segs[:200]:
        over = sorted((-(min(e, round(b * 1000)) - max(s, round(a * 1000))), round(a * 1000), S.speaker_name(n)) for u, n, a, b in rows if u == v)
        assert got[v, k] == (over[0][2] if over[0][0] < 0 else "")


def test_impossible_times(spark):
    assert turns(spark, [{"start": 0, "end": 8e12, "text": "hello there"}, {"start": 1e14, "end": 2e14, "text": "x"}], [("v", "S03", 1.0, 2.0)]) == [(0, "SPEAKER_03", 10), (1, "", 1)]


def test_latest_version_and_nulls(spark):
    rows = [("v", None, "x", json.dumps([seg(0, "old", "S00")]), None), ("v", None, "x", json.dumps([seg(0, "newer", "S00")]), "2024-01-02"), (None, None, "x", None, None), ("w", None, None, None, None), ("u", None, "", "", None), ("z", None, "raw text", "not json", None), ("y", None, None, "[null, 5, {\"text\": null}]", None)]
    t = spark.createDataFrame(rows, "video_id string, language string, text_full string, segments_json string, created_at string")
    got = sorted(tuple(r) for r in speaker_turns(t, spark.createDataFrame([], R)).collect())
    assert got == [("v", 0, "SPEAKER_00", 5), ("z", 0, "", 7)]
    assert speaker_turns(t.limit(0), spark.createDataFrame([], R)).count() == 0


def test_segments_without_start_follow():
    js = json.dumps([seg(5, "b"), {"text": "c"}, seg(1, "a")])
    assert [s["n"] for s in ordered_segments(js, None)] == [1, 1, 1]
    assert [s["s"] for s in ordered_segments(js, None)] == [1000, 5000, None]


def test_kept_text(spark):
    t = spark.createDataFrame([("v", "en", None, json.dumps([seg(0, " Um, one  [x]", "S00"), seg(1, "two", "S00")]), None, "x", 7)], T)
    assert speaker_turns(t, spark.createDataFrame([], R), keep_text=True).first().text == ", one two"
