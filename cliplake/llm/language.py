"""Language of documents and of the segments of mixed ones, with calibrated confidence.

Model: averaged embeddings of hashed subword grams (1 to 3 characters) under a linear softmax, trained by
stochastic gradient descent in numpy, each fit a task of its own. Training text is a bounded sample of
labelled rows (``TRAIN_ROWS``, by hash of the key); its labels are themselves partly wrong, so two fits on
halves drop the sentences they contradict and the labels that no text supports, and a third learns from the
rest. Sentences of rightly labelled examples that no fit has seen calibrate the confidence: a temperature is
fitted on one half of them, and on the other the rejection threshold is chosen, below which no language is
assigned. For scoring, embedding and softmax weights fold into one table
gram -> class scores, so whole texts are scored by table look-ups on Arrow batches where they are read.

Defined results: NULL or empty text has language 'und' with confidence 0; segments without speech are not
scored; a transcript without stored segments has the lines of its raw text as segments (not ``stored``); repeated rows repeat; an empty or label-free training sample gives a model that rejects everything.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplake.llm.speech import letters, read_segments, stored_segments
from cliplake.operators.sampling import bounded_sample
from cliplake.sources.tables import table

BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3)
#: Bounds of the training sample: labelled rows, and sentences of one row.
TRAIN_ROWS, TRAIN_SENTENCES = 4000, 8
#: Tasks that read the sample.
SAMPLE_PARTS = 16
TARGET_ACCURACY = 0.995
#: A fit sees about STEPS sentences, in 2 to MAX_EPOCHS passes; FOLD_BLOCK neighbours of the sample share a fold.
STEPS, MAX_EPOCHS, FOLD_BLOCK = 36_000, 12, 64
EMBEDDING_RATE = 3.0
#: Rows parsed and characters scored at a time; a single longer text is still scored whole.
SLICE_ROWS, SLICE_CHARS = 512, 200_000

#: Customary names and codes: ISO 639-1, then 639-2/3 codes, English and own names.
NAMES = {
    "en": "eng english", "es": "spa spanish español castellano castilian", "fr": "fra fre french français francais",
    "de": "deu ger german deutsch", "pt": "por portuguese português portugues", "it": "ita italian italiano",
    "ru": "rus russian русский", "ja": "jpn jap japanese 日本語 jp", "zh": "zho chi cmn chinese mandarin 中文 汉语 cn",
    "ko": "kor korean 한국어", "nl": "nld dut dutch nederlands", "uk": "ukr ukrainian українська",
    "bg": "bul bulgarian български", "gl": "glg galician galego", "ca": "cat catalan català", "pl": "pol polish polski",
    "sv": "swe swedish svenska", "da": "dan danish dansk", "no": "nor norwegian norsk nb nob nn nno", "fi": "fin finnish suomi",
    "tr": "tur turkish türkçe", "ar": "ara arabic العربية", "hi": "hin hindi हिन्दी", "el": "ell gre greek ελληνικά",
    "cs": "ces cze czech čeština", "ro": "ron rum romanian română", "hu": "hun hungarian magyar", "vi": "vie vietnamese",
    "id": "ind indonesian", "th": "tha thai", "he": "heb hebrew iw", "be": "bel belarusian", "sr": "srp serbian", "hr": "hrv croatian",
}
_CODE = {n: code for code, names in NAMES.items() for n in [code, *names.split()]}


def language_code(label: str | None) -> str | None:
    """'en-US', 'EN ', 'eng', 'English' -> 'en'; None for a label that names no language."""
    if label is None or label != label:
        return None
    whole = label.strip().casefold()
    return _CODE.get(whole) or _CODE.get(re.split(r"[\s_\-()/,;]", whole, maxsplit=1)[0])


def _letter_table() -> np.ndarray:
    t = np.full(0x30000, 32, dtype=np.uint32)
    for c in range(0x30000):
        if chr(c).isalpha():
            t[c] = c
    return t


_LETTERS: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram of every text, and the text it belongs to."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    codes = _LETTERS[0][np.minimum(codes, 0x2FFFF)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    found, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        same = owner[: len(h)] == owner[n - 1 :]
        mixed = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        found.append((mixed >> np.uint32(16))[same])
        owners.append(owner[: len(h)][same])
        h = h.copy()
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    codes: list[str]
    scores: np.ndarray  # gram bucket x class
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """texts x classes; a text without letters gets equal shares."""
        if not texts or not self.codes:
            return np.zeros((len(texts), len(self.codes)))
        slices, at, size = [], 0, 0
        for i, t in enumerate(texts):  # so many characters at a time that the looked-up rows stay small
            size += len(t)
            if size >= SLICE_CHARS:
                slices.append(texts[at : i + 1])
                at, size = i + 1, 0
        slices += [texts[at:]] if at < len(texts) else []
        return np.concatenate([self._scored(s) for s in slices])

    def _scored(self, texts: list[str]) -> np.ndarray:
        idx, owner = grams(texts)
        order = np.argsort(owner, kind="stable")
        idx, owner = idx[order], owner[order]
        count = np.bincount(owner, minlength=len(texts)).astype(np.float32)
        starts = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        summed = np.add.reduceat(self.scores[idx], np.minimum(starts, len(idx) - 1), axis=0)
        z = (summed / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _fit(texts: list[str], y: np.ndarray, classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Averaged-embedding softmax by SGD; returns (gram scores, bias)."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, classes)).astype(np.float32), np.zeros(classes, np.float32)
    share = np.bincount(y, minlength=classes) / len(y)
    weight = np.minimum(4.0, np.sqrt(1 / classes / np.maximum(share, 1e-9))).astype(np.float32)
    found, owner = grams(texts)
    found = found[np.argsort(owner, kind="stable")].astype(np.int64)
    count = np.bincount(owner, minlength=len(texts))  # no text is without grams, as each is padded
    first = np.r_[0, np.cumsum(count)[:-1]]
    size, epochs = 32, int(min(MAX_EPOCHS, max(2, STEPS // max(1, len(texts)))))
    for epoch in range(epochs):
        rate = 0.6 * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), size):
            part = order[at : at + size]
            n = count[part]
            begin = np.r_[0, np.cumsum(n)[:-1]]
            idx = found[np.repeat(first[part] - begin, n) + np.arange(n.sum())]
            hidden = np.add.reduceat(emb[idx], begin, axis=0) / n[:, None].astype(np.float32)
            z = hidden @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[y[part], None]
            back = ((p @ w.T) * (EMBEDDING_RATE * rate / n[:, None])).astype(np.float32)
            w -= (4 * rate / len(part)) * (hidden.T @ p)
            b -= rate * p.sum(axis=0) / len(part)
            by = np.argsort(idx, kind="stable")
            idx = idx[by]
            runs = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
            emb[idx[runs]] -= np.add.reduceat(np.repeat(back, n, axis=0)[by], runs, axis=0)
    return (emb @ w).astype(np.float32), b


def _fits(spark: SparkSession, texts: list[str], y: np.ndarray, classes: int, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One fit on each set of rows, side by side as tasks; the sample is bounded, and so is what comes back."""
    shared = spark.sparkContext.broadcast((texts, y, sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                texts, y, sets = shared.value
                scores, bias = _fit([texts[i] for i in sets[k]], y[sets[k]], classes)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([scores.tobytes()], pa.binary()), pa.array([bias.tobytes()], pa.binary())], ["k", "scores", "bias"])

    rows = spark.range(0, len(sets), 1, len(sets)).mapInArrow(run, "k bigint, scores binary, bias binary").collect()
    shared.unpersist()
    return [(np.frombuffer(r.scores, np.float32).reshape(BUCKETS, classes), np.frombuffer(r.bias, np.float32)) for r in sorted(rows)]


def train(spark: SparkSession, noisy: Iterable[tuple[str, str]], clean: Iterable[tuple[str, str]] = ()) -> Model:
    """From (language code, sentence) pairs with partly wrong codes; ``clean`` ones are right and only calibrate.

    Without clean pairs an eighth of the noisy ones is held out, whatever the fits think of them.
    """
    samples = [(c, t) for c, t in noisy if t and c]
    clean = [(c, t) for c, t in clean if t and c]
    if not samples:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    if not clean:
        held = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 8 == 0 for _, t in samples]
        if any(held) and not all(held):
            clean, samples = [s for s, h in zip(samples, held) if h], [s for s, h in zip(samples, held) if not h]
    codes = sorted({c for c, _ in samples})
    y = np.array([codes.index(c) for c, _ in samples])
    texts = [t for _, t in samples]
    # Two folds of whole blocks of the sample judge each other's labels.
    fold = np.arange(len(samples)) // FOLD_BLOCK % 2
    guess = y.copy()
    if len(set(fold)) == 2:
        for side, (scores, bias) in enumerate(_fits(spark, texts, y, len(codes), [np.flatnonzero(fold == k) for k in (0, 1)])):
            other = np.flatnonzero(fold != side)
            guess[other] = Model(codes, scores, bias, 1.0, 0.0).probabilities([texts[i] for i in other]).argmax(axis=1)
    kept = [k for k in range(len(codes)) if (guess[y == k] == k).mean() > 0.5] or list(range(len(codes)))
    sure = np.flatnonzero((guess == y) & np.isin(y, kept))
    codes2, y2 = [codes[k] for k in kept], np.array([kept.index(k) if k in kept else 0 for k in y])
    ((scores, bias),) = _fits(spark, texts, y2, len(codes2), [sure if len(sure) else np.arange(len(y))])
    m = Model(codes2, scores, bias, 1.0, 0.0)
    clean = [(codes2.index(c), t) for c, t in clean if c in codes2]
    calibrate(m, clean)
    return m


def calibrate(m: Model, clean: list[tuple[int, str]]) -> None:
    """Temperature from one half of the held-out sentences (by hash), rejection threshold from the other."""
    halves: list[list[tuple[int, str]]] = [[], []]
    for c, t in clean:
        halves[zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2].append((c, t))
    one, two = halves
    if one:
        y, raw = np.array([c for c, _ in one]), np.log(np.maximum(m.probabilities([t for _, t in one]), 1e-30))

        def loss(temperature: float) -> float:
            z = raw / temperature
            return float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(y)), y]).mean())

        m.temperature = min(np.geomspace(0.02, 4.0, 60), key=loss)
    if two:
        p = m.probabilities([t for _, t in two])
        right, sure_of = p.argmax(axis=1) == np.array([c for c, _ in two]), p.max(axis=1)
        m.threshold = next((float(t) for t in np.linspace(0.3, 0.95, 27) if (sure_of >= t).any() and right[sure_of >= t].mean() >= TARGET_ACCURACY), 0.95)


_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]?")


def training_samples(transcripts: DataFrame, examples: DataFrame) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(code, sentence) of TRAIN_ROWS labelled transcripts by hash of the id, and of the rightly labelled examples."""
    rows = transcripts.where("language IS NOT NULL AND text_full IS NOT NULL").select("video_id", "language", "text_full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, SLICE_ROWS) for x in batches for at in range(0, x.num_rows, SLICE_ROWS)):
            ids, labels, texts = (c.to_pylist() for c in b.columns)
            found = []
            for text in texts:
                spoken = " ".join(s.spoken for s in read_segments(None, text))
                parts = [s.strip() for s in _SENTENCE.findall(spoken) if letters(s) >= 6]
                found.append(parts[:: max(1, len(parts) // TRAIN_SENTENCES)][:TRAIN_SENTENCES])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([language_code(x) for x in labels], pa.string()), pa.array(found, pa.list_(pa.string()))], ["id", "code", "parts"])

    sample = bounded_sample(rows, ["video_id", "language"], TRAIN_ROWS).repartition(SAMPLE_PARTS, F.xxhash64("video_id"))
    parsed = sample.mapInArrow(run, "id string, code string, parts array<string>").where("code IS NOT NULL AND size(parts) > 0")
    # Only a few sentences of each row of the bounded sample reach the driver, in an order of their own.
    out = [(r.code, s) for r in sorted(parsed.collect(), key=lambda r: (zlib.crc32((r.id or "").encode()), r.id or "", r.code, r.parts)) for s in r.parts]
    clean = []
    for r in bounded_sample(examples.select("lang", "text"), ["text", "lang"], TRAIN_ROWS).collect():
        if (code := language_code(r.lang)) and r.text:
            clean += [(code, s.strip()) for s in _SENTENCE.findall(r.text)]
    return out, clean


OUT = "video_id string, label string, seg_no bigint, language string, confidence double, main boolean, stored boolean"


def transcript_languages(transcripts: DataFrame, model: Model) -> DataFrame:
    """video_id, label, seg_no, language, confidence, main, stored: one row per transcript (seg_no -1) and per spoken segment.

    The language of the transcript is that of most of its spoken segments (ties: the surer one), or of the
    whole text if there are no stored segments; then the spoken lines of the text are its segments, and seg_no
    counts them. A rejected text has language 'und'.
    """
    codes = [*model.codes, "und"]
    holder = transcripts.sparkSession.sparkContext.broadcast(model)  # a fixed-size table of a few MB

    def pick(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if p.shape[1] == 0:
            return np.zeros(len(p), int), np.zeros(len(p))
        best, sure = p.argmax(axis=1), p.max(axis=1)
        return np.where(sure >= holder.value.threshold, best, len(codes) - 1), sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, SLICE_ROWS) for x in batches for at in range(0, x.num_rows, SLICE_ROWS)):
            ids, labels, segments, texts = (c.to_pylist() for c in b.columns)
            spoken: list[str] = []
            where: list[tuple[int, int]] = []
            stored: list[bool] = []
            for i, (j, t) in enumerate(zip(segments, texts)):
                segs, raw = read_segments(j, t), stored_segments(j) is None
                if raw and segs:
                    where.append((i, -1))
                    spoken.append(" ".join(s.spoken for s in segs))
                for s in segs:
                    if letters(s.spoken):
                        where.append((i, s.position))
                        spoken.append(s.spoken)
                stored.append(not raw)
            best, sure = pick(holder.value.probabilities(spoken))
            votes = np.zeros((len(ids), len(codes)))
            mass = np.zeros((len(ids), len(codes)))
            # A stored transcript is judged by its segments, a raw one by its whole text.
            judge = np.array([(w[1] >= 0) == stored[w[0]] for w in where], dtype=bool)
            row = np.array([w[0] for w in where], dtype=int)[judge]
            np.add.at(votes, (row, best[judge]), 1)
            np.add.at(mass, (row, best[judge]), sure[judge])
            votes[:, -1] *= 1e-6  # rejected segments decide only where nothing else was found
            main = (votes + mass * 1e-9).argmax(axis=1)
            seen = votes.sum(axis=1) > 0
            main = np.where(seen, main, len(codes) - 1)
            total = np.maximum(np.bincount(row, minlength=len(ids)), 1)
            share = mass[np.arange(len(ids)), main] / total
            keep = [k for k, w in enumerate(where) if w[1] >= 0]
            rows = list(range(len(ids))) + [where[k][0] for k in keep]
            lang = [codes[m] for m in main] + [codes[best[k]] for k in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in rows], pa.string()),
                    pa.array([labels[i] for i in rows], pa.string()),
                    pa.array([-1] * len(ids) + [where[k][1] for k in keep], pa.int64()),
                    pa.array(lang, pa.string()),
                    pa.array([float(s) for s in share] + [float(sure[k]) for k in keep], pa.float64()),
                    pa.array([True] * len(ids) + [bool(best[k] == main[where[k][0]]) for k in keep], pa.bool_()),
                    pa.array([stored[i] for i in rows], pa.bool_()),
                ],
                ["video_id", "label", "seg_no", "language", "confidence", "main", "stored"],
            )

    rows = transcripts.where("video_id IS NOT NULL").select("video_id", "language", "segments_json", "text_full")
    return rows.mapInArrow(run, OUT)


def p2_languages(spark, folder: str) -> DataFrame:
    """Language and confidence of every transcript and every spoken segment."""
    t = table(spark, folder, "transcripts")
    return transcript_languages(t, train(spark, *training_samples(t, table(spark, folder, "subject_examples"))))


def p2_found(spark, folder: str) -> DataFrame:
    """Transcripts whose label is missing or wrong (seg_no -1) and segments in another than the main language."""
    code = F.pandas_udf(lambda s: s.map(language_code), "string")
    found = p2_languages(spark, folder).where("language != 'und'").where("seg_no = -1 OR (stored AND NOT main)")
    wrong = (F.col("seg_no") >= 0) | ~F.col("label_code").eqNullSafe(F.col("language"))
    return found.withColumn("label_code", code("label")).where(wrong).select("video_id", "seg_no", "language").distinct()
