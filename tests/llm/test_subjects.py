import numpy as np
import pytest

from cliplake.llm import subjects as S
from cliplake.sources.tables import table

FOLDER = "/root/testdata/sf0.01"


HELD_OUT = "pmod(xxhash64(example_id), 8) = 0"


@pytest.fixture(scope="module")
def trained(spark):
    """Trained without an eighth of the labelled examples."""
    return S.train(table(spark, FOLDER, "documents"), table(spark, FOLDER, "subject_areas"), table(spark, FOLDER, "subject_examples").where(f"NOT {HELD_OUT}"))


def test_sentences():
    assert S.sentences("One here. Two there? 3 pm.\n00:00:01.000 --> 00:00:02.000\nThree") == ["One here.", "Two there?", "3 pm."]
    assert S.sentences("The\r\n\r\n hardest part.\n* You\n```\nx = 1.\n```\n can.\n4. Next one. (repost)") == ["The hardest part.", "* You can.", "4. Next one."]
    assert S.sentences("One here. <b>bold</b> &amp;") == ["One here."] and S.sentences("just this") == ["just this"]
    assert S.features("1e-7 ab") == S.features("ab")
    assert S.sentences("你好。再见。") == ["你好。", "再见。"]
    assert S.sentences("[00:05] Hi. #tag https://x.y/z") == ["Hi."]
    assert S.sentences("```\ncode. more.\n``` Text.") == ["Text."]
    assert all(S.sentences(x) == [] for x in (None, "", "  ", "12:30\n00:05", "!!! ???", "#a #b"))


def test_held_out_examples(spark, trained):
    """Labelled examples that the model did not see."""
    names, weights = trained
    rows = table(spark, FOLDER, "subject_examples").where(HELD_OUT).collect()
    score, right, wrong, n = S.Scorer(weights), 0, 0, 0
    for r in rows:
        p = score(S.sentences(r.text))
        n += len(p)
        right += sum(names[x.argmax()] == r.subject and x.max() >= S.SURE for x in p)
        wrong += sum(names[x.argmax()] != r.subject and x.max() >= S.SURE for x in p)
    print(right, wrong, n)
    # A thousand documents don't hold all phrases of the ones left out; other subjects are hardly ever taken for it.
    assert right >= 0.7 * n and wrong <= 0.03 * n


def test_gradient_is_the_slope_of_the_loss():
    r = np.random.default_rng(2)
    w = S.start(3, np.ones(S.BUCKETS))
    w.emb[:50] = r.normal(0, 1, (50, S.DIM))
    bags = S.Bags(r.integers(0, 50, 30).astype(np.int32), np.array([10, 5, 15]), w.rarity)
    rows, y = np.array([0, 2]), r.integers(0, 2, (2, 3)).astype(np.float32)

    def loss():
        p = bags.probabilities(w, rows).astype(np.float64)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    idx, rows_, out, bias = S._from_bytes(S._to_bytes(*S._gradient(w, bags, rows, y)), 3)
    for array, at, slope in ((w.emb, (idx[0], 2), rows_[0, 2]), (w.emb, (idx[-1], 0), rows_[-1, 0]), (w.out, (1, 1), out[1, 1]), (w.bias, (2,), bias[2])):
        kept, array[at] = array[at], array[at] + 1e-2
        up = loss()
        array[at] = kept - 1e-2
        down = loss()
        array[at] = kept
        assert abs((up - down) / 2e-2 - slope) < 0.02 * abs(slope) + 5e-3


def test_gradients_of_parts_add_up():
    r = np.random.default_rng(3)
    w = S.start(2, np.ones(S.BUCKETS))
    w.emb[:] = r.normal(0, 1, w.emb.shape)
    bags, y = S.Bags(r.integers(0, 99, 60).astype(np.int32), np.full(6, 10), w.rarity), r.integers(0, 2, (6, 2)).astype(np.float32)
    whole = S._gradient(w, bags, np.arange(6), y)
    parts = [S._gradient(w, bags, rows, y[rows]) for rows in (np.array([0, 3]), np.array([], int), np.array([1, 2, 4, 5]))]
    idx, rows = S._sum_rows(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    assert (idx == whole[0]).all() and np.allclose(rows, whole[1], atol=1e-5) and np.allclose(sum(p[2] for p in parts), whole[2], atol=1e-5)


def test_shares(spark, trained):
    names, weights = trained
    finance, travel = "Keep an eye on a bond yield while you invest the bonus.", "You can miss the connecting flight even if a boarding pass is all you have."
    plain = "Thanks for watching, and tell me what you think in the comments."
    rows = [(1, None), (2, ""), (3, "00:05\n12:30"), (4, finance), (5, " ".join([finance] + [plain] * 4)), (6, " ".join([finance] + [plain] * 5)), (7, finance + " " + travel), (8, finance), (8, finance), (9, (plain + " ") * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n_sentences int, shares string")
    got = {r.doc_id: {n for n, x in zip(names, r.shares) if x >= S.SHARE - 1e-9} for r in S.shares(df, names, weights).collect()}
    assert got == {1: set(), 2: set(), 3: set(), 4: {"finance"}, 5: {"finance"}, 6: set(), 7: {"finance", "travel"}, 8: {"finance"}, 9: set()}
    assert S.shares(df.limit(0), names, weights).count() == 0


def test_copies_agree(spark, trained):
    names, weights = trained
    docs = table(spark, FOLDER, "documents")
    s = S.shares(docs, names, weights).join(docs.select("doc_id", "text"), "doc_id")
    assert s.groupBy("text").agg({"shares": "max"}).count() == s.select("text", "shares").distinct().count()
