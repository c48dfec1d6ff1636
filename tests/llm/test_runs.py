import random

from itertools import product

from cliplake.llm.runs import BOUNDARY, FAR, Meanings, edits, event_runs, segment

E = "id bigint, video_id string, event_type string, label string, start_sec double, end_sec double, confidence double, part int, grp string"
L = "label string, event_type string"
LABELS = [("Dog bark", "sound_effect"), ("Door slam", "sound_effect"), ("Narration", "speech"), ("Dead air", "silence")]


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 0.5, 1, "x") for r in rows], E)
    out = event_runs(df, spark.createDataFrame(LABELS, L), parts)
    return {(r.video_id, r.first_event_id): (r.n_events, r.start_ms, r.end_ms) for r in out.collect()}


def brute(rows):
    """The program over whole entities, in one piece and without short cuts."""
    m = Meanings([x for x, _ in LABELS], [t for _, t in LABELS])
    rows = {(r[0], r[1], round(r[4] * 1000)): r for r in rows if r[4] is not None and r[1] is not None}.values()
    rows = sorted(rows, key=lambda r: (r[1], round(r[4] * 1000), r[0]))
    out, last = {}, None
    for v in sorted({r[1] for r in rows}):
        mine = [r for r in rows if r[1] == v]
        for (i, _, kind, label, s, e), meaning in zip(mine, segment([m(r[3], r[2])[1] for r in mine])):
            key, ms = (v, meaning), round(s * 1000)
            end = max(ms, round(e * 1000) if e is not None else ms)
            if last and last[0] == key:
                n, a, b = out[last[1]]
                out[last[1]] = (n + 1, a, max(b, end))
            else:
                last = (key, (v, i))
                out[v, i] = (1, ms, end)
    return out


def test_spellings():
    m = Meanings([x for x, _ in LABELS], ["speech", "sound_effect"])
    for s in ("DOG BARK", "dog_bark", "Dog bark", "Ｄｏｇ ｂａｒｋ", '"Dog bark"', "Dog brak", "Dgo bark", "Dogbark", "Dog barrk", "og bark​"):
        assert m(s, "x")[0] == "LDog bark", s
    assert m("", "Sound Effect")[0] == m(None, "sound-effect")[0] == "Tsound_effect"
    assert m("something else", "speech") == m("Something-Else", "music") != m("other", "speech")
    assert edits("abc", "acb", 2) == 1 and edits("abc", "xyz", 1) == 2 and edits("", "ab", 5) == 2


def cost(events, states):
    return sum(e.get(k, FAR) for e, k in zip(events, states)) + BOUNDARY * sum(a != b for a, b in zip(["", *states], states))


def test_segmentation_is_optimal():
    r = random.Random(6)
    for _ in range(200):
        events = [{k: r.choice((0.0, 1 / 3, 0.5, 2 / 3)) for k in r.sample("abc", r.randint(1, 3))} for _ in range(r.randint(1, 6))]
        best = min(cost(events, s) for s in product("abc", repeat=len(events)))
        assert abs(cost(events, segment(events)) - best) < 1e-9
    assert segment([]) == [] and segment([{"a": 0.0}] * 1000) == ["a"] * 1000


def test_near_spellings_go_with_their_neighbours(spark):
    """'drum lop' is as near to 'drum loop' as to 'drum top': alone it is the first of them, in a run it belongs to it."""
    labels = [("Drum loop", "music"), ("Drum top", "music")]
    m = Meanings([x for x, _ in labels], ["music"])
    assert m("drum lop", "x")[0] is None and m("Drum loop", "x")[0] == "LDrum loop"
    df = lambda spelled: spark.createDataFrame([(i, "v", "music", x, float(i), None, 0.5, 1, "x") for i, x in enumerate(spelled)], E)
    spelled = ["Drum top", "drum lop", "drum top", "Drum loop", "drum lop", "drum lop", "drum loop", "Drum top", "drum lop"]
    want = [(0, 3), (3, 4), (7, 2)]
    for parts in (1, 2, 4, 9):
        got = sorted((r.first_event_id, r.n_events) for r in event_runs(df(spelled), spark.createDataFrame(labels, L), parts).collect())
        assert got == want
        got = sorted((r.first_event_id, r.n_events, r.meaning) for r in event_runs(df(["drum lop"] * 7), spark.createDataFrame(labels, L), parts).collect())
        assert got == [(0, 7, "LDrum loop")]


def test_random_against_brute_force(spark):
    r, rows = random.Random(12), []
    spell = ["Dog bark", "dog  bark", "Door slam", "Narration", "Narraton", "", None]
    for i in range(3000):
        v = "hot" if i % 3 else r.choice("abc")
        rows.append((i, v, r.choice(["speech", "Speech ", "silence"]), r.choice(spell[: r.choice((2, 7))]), round(r.uniform(0, 500), 2), r.choice([None, 900.0, 1.0])))
    rows += rows[:200]
    for parts in (1, 3, 16):
        assert run(spark, rows, parts) == brute(rows)


def test_one_run_over_many_partitions(spark):
    rows = [(i, "v", "x", "Dog bark", float(i), None) for i in range(5000)] + [(9000, "w", "x", "Dog bark", 0.0, 1.0)]
    assert run(spark, rows, 16) == {("v", 0): (5000, 0, 4_999_000), ("w", 9000): (1, 0, 1000)}


def test_edges(spark):
    rows = [(1, "v", None, None, 1.0, 2.0), (2, "v", None, "", 1.0, None), (3, "v", "speech", None, None, 3.0), (4, None, "speech", "Narration", 1.0, 2.0), (None, "v", None, None, 1.0, 2.0)]
    assert run(spark, rows) == {("v", None): (3, 1000, 2000)}
    assert run(spark, []) == {}
