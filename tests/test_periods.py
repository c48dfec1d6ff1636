import random

from pyspark.sql import functions as F

from cliplake.operators.periods import HOUR_MS, event_tracks, merge_periods, p1_found


def brute(rows, pause=HOUR_MS):
    out, by = set(), {}
    for v, s, e in rows:
        if s is not None and e is not None and round(e * 1000) > round(s * 1000):
            by.setdefault(v, []).append((round(s * 1000), round(e * 1000)))
    for v, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(v, "period", a, b) for a, b in merged}
        out |= {(v, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if y[0] - x[1] < pause}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "v string, start_sec double, end_sec double")
    return {tuple(r) for r in merge_periods(df, ["v"], **kw).collect()}


def test_random_against_brute_force(spark):
    r = random.Random(3)
    for spread, size in ((50, 4), (20_000, 90), (20_000, 5000)):
        rows = []
        for v in ("a", "b", None):
            for _ in range(250):
                s = round(r.uniform(-spread, spread), 3)
                rows.append((v, s, round(s + r.expovariate(1 / size), 3)))
        rows += rows[:40]
        assert run(spark, rows) == brute(rows)
        assert run(spark, rows, shard_ms=7_000) == brute(rows)


def test_edges_of_shards(spark):
    rows = [("a", 3599.0, 3600.0), ("a", 3600.0, 3601.0), ("a", 7100.0, 7200.0), ("a", 7200.5, 7201.0), ("b", 0.0, 36000.0), ("b", 5000.0, 5001.0), ("c", 0.0, 1.0), ("c", 3601.0, 3602.0), ("d", 0.0, 1.0), ("d", 3600.999, 3602.0)]
    assert run(spark, rows) == brute(rows)


def test_no_intervals(spark):
    rows = [("a", None, 1.0), ("a", 1.0, None), ("a", 2.0, 2.0), ("a", 3.0, 1.0), ("a", float("nan"), 1.0), ("a", 1.0, float("nan")), ("a", float("-inf"), float("inf"))]
    assert run(spark, rows) == set() == run(spark, [])


def test_very_long_interval(spark):
    rows = [("a", 0.0, 4e9), ("a", 5e9, 5e9 + 1), ("b", 1.0, 2.0)]
    assert run(spark, rows) == brute(rows)


def test_intervals_that_pass_many_shards(spark):
    r = random.Random(8)
    rows = []
    for v in ("a", "b", "c"):
        for _ in range(120):
            s = round(r.uniform(0, 3000), 1)
            rows.append((v, s, round(s + r.choice([0.4, 3.0, 40.0, 400.0 if v == "a" else 5.0]), 1)))
    rows += [("d", 0.0, 3000.0), ("d", 100.2, 100.4), ("d", 5000.0, 5001.0), ("d", 2999.0, 4000.0), ("d", 4000.0, 4000.5)]
    for shard in (1_000, 7_000, 100_000):
        assert run(spark, rows, shard_ms=shard, recording_pause_ms=50_000) == brute(rows, 50_000)


def test_ends_that_round_to_one_millisecond_are_no_interval(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.5001, 1.5004), ("a", 2.0, 3.0), ("a", 2.9996, 3.0004)]
    assert run(spark, rows) == {("a", "period", 0, 1000), ("a", "gap", 1000, 2000), ("a", "period", 2000, 3000)}


def test_extra_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", 0.0, 1.0, "k", 5)], "kind string, start_sec double, end_sec double, start_ms string, shard int").withColumnRenamed("kind", "who")
    assert [tuple(r) for r in merge_periods(df, ["who"]).collect()] == [("x", "period", 0, 1000)]


def test_tracks(spark):
    labels = spark.createDataFrame([("Door", "sound_effect"), ("Song", "music")], "label string, event_type string")
    e = spark.createDataFrame([("v", t, 0.0, 1.0) for t in ("Sound Effect", " soundEffect", "ＭＵＳＩＣ", "odd ", None)], "video_id string, event_type string, start_sec double, end_sec double")
    assert sorted(r.track for r in event_tracks(e, labels).collect()) == ["", "music", "odd", "sound_effect", "sound_effect"]


def test_query_shape(spark):
    df = p1_found(spark, "/root/testdata/sf0.001")
    assert df.columns == ["source", "video_id", "track", "kind", "start_ms", "end_ms"]
    assert df.groupBy(*df.columns).count().where("count > 1").count() == 0
    assert df.where(F.col("end_ms") <= F.col("start_ms")).count() == 0
