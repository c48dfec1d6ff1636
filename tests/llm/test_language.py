import numpy as np
import pytest

from cliplake.llm import language as L
from cliplake.sources.tables import table

FOLDER = "/root/testdata/sf0.01"


HELD_OUT = "example_id % 3 = 0"


@pytest.fixture(scope="module")
def model(spark):
    """Calibrated without a third of the labelled examples."""
    return L.train(spark, *L.training_samples(table(spark, FOLDER, "transcripts"), table(spark, FOLDER, "subject_examples").where(f"NOT {HELD_OUT}")))


def test_codes():
    same = ["en", "EN ", "eng", "English", "en-US", "en_GB"]
    assert {L.language_code(x) for x in same} == {"en"}
    assert L.language_code("German") == "de" and L.language_code("pt-BR") == "pt"
    assert all(L.language_code(x) is None for x in (None, "", "??", "und", "unknown", "auto", " "))


def test_held_out_sentences(model):
    known = {
        "en": "The weather was lovely and nobody wanted to go home.", "es": "El tiempo era bueno y nadie quería volver a casa.", "fr": "Le temps était beau et personne ne voulait rentrer.",
        "de": "Das Wetter war schön und niemand wollte nach Hause gehen.", "pt": "O tempo estava bom e ninguém queria voltar para casa.", "it": "Il tempo era bello e nessuno voleva tornare a casa.",
        "ru": "Погода была хорошая, и никто не хотел идти домой.", "ja": "天気がとても良くて、誰も家に帰りたくなかった。", "zh": "天气很好，大家都不想回家。",
    }
    p = model.probabilities(list(known.values()))
    guess = [model.codes[k] for k in p.argmax(axis=1)]
    assert sum(g == c for g, c in zip(guess, known)) >= 8


def test_held_out_rows(spark, model):
    """Labelled examples that the model did not see get their language."""
    rows = table(spark, FOLDER, "subject_examples").where(HELD_OUT).collect()
    p = model.probabilities([r.text for r in rows])
    assert sum(model.codes[k] == r.lang for k, r in zip(p.argmax(axis=1), rows)) >= 0.99 * len(rows)


def test_confidence_is_calibrated(spark, model):
    """Expected calibration error over sentences that neither fitted nor calibrated the model."""
    found = [(r.lang, s) for r in table(spark, FOLDER, "subject_examples").where(HELD_OUT).collect() for s in L._SENTENCE.findall(r.text)]
    p = model.probabilities([s for _, s in found])
    sure, right = p.max(axis=1), np.array([model.codes[k] == c for k, (c, _) in zip(p.argmax(axis=1), found)])
    bins = np.minimum((sure * 10).astype(int), 9)
    ece = sum(abs(right[bins == k].mean() - sure[bins == k].mean()) * (bins == k).mean() for k in set(bins))
    assert len(found) > 150 and ece < 0.03


def test_segments_of_raw_text(spark, model):
    raw = "Thanks for watching, and tell me what you think.\n[Music]\nGracias por ver el vídeo y hasta la próxima semana.\nNothing is ever quite like that week, and nobody wanted to go home."
    t = spark.createDataFrame([("a", "en", raw, None)], "video_id string, language string, text_full string, segments_json string")
    got = {r.seg_no: (r.language, r.main, r.stored) for r in L.transcript_languages(t, model).collect()}
    assert got[-1] == ("en", True, False)


def test_slices_do_not_change_scores(model, monkeypatch):
    texts = ["one two three", "", "¿qué?", "12 34"] * 5
    whole = model.probabilities(texts)
    monkeypatch.setattr(L, "SLICE_CHARS", 10)
    assert abs(model.probabilities(texts) - whole).max() < 1e-6


def test_edge_rows(spark, model):
    rows = [("a", None, None, None, 1), ("b", "en", "", "", 1), ("c", "fr", "Thanks for watching, and tell me what you think.", None, 1), ("d", "en", "x", '[{"text": "[Music]"}, {"text": "Thanks for watching, and tell me what you think."}, {"text": "Gracias por ver el vídeo y hasta la próxima semana."}, {"text": "Nothing is ever quite like that week."}]', 1), (None, "en", "x", None, 1)]
    t = spark.createDataFrame(rows, "video_id string, language string, text_full string, segments_json string, main int")
    got = {(r.video_id, r.seg_no): (r.language, r.main) for r in L.transcript_languages(t, model).collect()}
    assert got[("a", -1)][0] == got[("b", -1)][0] == "und"
    assert got[("c", -1)] == ("en", True) == got[("d", -1)]
    assert got[("d", 2)] == ("es", False) and ("d", 0) not in got and len(got) == 8
    assert L.transcript_languages(t.limit(0), model).count() == 0


def test_no_labels(spark):
    m = L.train(spark, [])
    t = spark.createDataFrame([("a", None, "some text", None)], "video_id string, language string, text_full string, segments_json string")
    assert L.transcript_languages(t, m).first().language == "und"


def test_very_long_text(spark, model):
    t = spark.createDataFrame([("a", "en", "Volvemos enseguida después de una pausa. " * 20_000, None)], "video_id string, language string, text_full string, segments_json string")
    r = L.transcript_languages(t, model).first()
    assert r.language == "es" and r.confidence > 0.9
