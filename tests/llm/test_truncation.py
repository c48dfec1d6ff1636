import math
import random
import time

from cliplake.llm.truncation import _tail, folded, hazards, p6_rates, truncated

V = "key string, source string, value string"


def corpus(n=1500, limit=None, seed=4):
    r = random.Random(seed)
    nouns = ["garden hose", "kitchen knife", "violin bow", "night train", "index fund", "court ruling", "black hole", "relay team"]
    rows = []
    for i in range(n):
        t = f"{r.choice(['Why the', 'How to use the', 'What nobody tells you about the'])} {r.choice(nouns)} {r.choice(['matters more than the', 'and everything we learned about the', 'versus the'])} {r.choice(nouns)} {r.choice(['along the way', 'explained without the jargon', 'in ten minutes', 'for a whole month'])}"
        rows.append((f"k{i}", "a", t))
    cut = set()
    if limit:
        for i, (k, s, t) in enumerate(rows):
            if len(t) > limit:
                rows[i] = (k, s, t[:limit])
                cut.add(k)
    return rows, cut


def test_limit_is_found(spark):
    rows, cut = corpus(limit=70)
    h = hazards(spark.createDataFrame(rows, V)).where("significant AND measure = 'chars'").collect()
    assert [x.length for x in h] == [70]
    got = {r.key for r in truncated(spark.createDataFrame(rows, V)).where("cut").collect()}
    assert len(got & cut) >= 0.93 * len(cut) and len(got - cut) <= 0.02 * len(rows)


def test_no_limit_no_cuts(spark):
    rows, _ = corpus()
    assert truncated(spark.createDataFrame(rows, V)).where("cut").count() <= 5


def test_broken_transfers(spark):
    rows, _ = corpus()
    r, cut = random.Random(8), set()
    for i in r.sample(range(len(rows)), 25):
        k, s, t = rows[i]
        n = r.randrange(25, len(t) - 12)
        if t[n - 1] != " " and t[n].isalpha():
            rows[i] = (k, s, t[:n])
            cut.add(k)
    got = {x.key for x in truncated(spark.createDataFrame(rows, V)).where("cut").collect()}
    assert len(got & cut) >= 0.75 * len(cut) and len(got - cut) <= 8


def test_marks_alone_are_no_sign(spark):
    rows, _ = corpus()
    rows = [(k, s, t + ", to be continued..." if i % 20 == 0 else t) for i, (k, s, t) in enumerate(rows)]
    assert truncated(spark.createDataFrame(rows, V)).where("cut AND marked").count() == 0


def test_edges(spark):
    rows = [("a", "s", None), ("b", "s", ""), ("c", "s", "  "), ("d", "s", "broken �"), ("e", "s", "👩‍"), ("f", "s", "x"), ("f2", "s", "x"), ("g", None, "some words " * 5000 + "at the end")]
    got = {r.key: r.cut for r in truncated(spark.createDataFrame(rows, V)).collect()}
    assert got == {"d": True, "e": True, "f": False, "f2": False, "g": False}
    assert truncated(spark.createDataFrame([], V)).count() == 0


def test_tail():
    assert _tail(10, 0, 0.5) == 1.0 and _tail(10, 11, 0.5) == 0.0 and abs(_tail(2, 1, 0.5) - 0.75) < 1e-12
    assert _tail(1000, 200, 0.01) < 1e-100 and _tail(5, 1, 0.0) == 0.0


def test_tail_equals_the_sum_and_stays_fast():
    r = random.Random(5)
    for _ in range(400):
        n, p = r.randint(1, 300), r.random() ** 2
        k = r.randint(0, n)
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert abs(_tail(n, k, p) - want) <= 1e-9 + 1e-7 * want
    began = time.time()
    for n in (10**6, 10**8, 10**10):
        assert 0.49 < _tail(n, n // 20, 0.05) < 0.51 and _tail(n, n // 10, 0.05) < 1e-100 and _tail(n, n // 40, 0.05) > 0.999
    assert time.time() - began < 1


def test_folded():
    assert folded("Ｗhy tо 12​") == "why to 00" and folded(None) is None


def test_rates(spark):
    rows = p6_rates(spark, "/root/testdata/sf0.01").collect()
    assert {r.platform for r in rows} == {"youtube", "instagram", "tiktok"} and all(0 < r.share < 0.5 and r.n_cut <= r.n_titles for r in rows)
