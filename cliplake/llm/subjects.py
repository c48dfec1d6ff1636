"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A sentence is a bag of hashed words, word pairs and word beginnings; the mean of their embeddings goes into
one logistic output per subject. Training texts are read once: every partition writes the features of its
distinct sentences as arrays. In every step each partition gives the gradient of its share of the batch, the
driver sums them (their size is fixed) and hands the new weights out, so all work on equal weights.
The model is fitted on the labelled examples first. It then labels a bounded sample of documents
(``TRAIN_DOCS``, by hash of the id), where a sentence inherits the subjects of its document, which teaches
words that no example has; sentences common to all subjects learn no subject. Every document is then scored
whole: it is about a subject if at least a fifth of its sentences are.

Defined results: NULL, empty or letterless texts have no subject; times, tags, addresses, code and remarks in
brackets are no sentences; repeated rows and copies have the same subjects.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.operators.sampling import bounded_sample
from cliplake.session import written
from cliplake.sources.tables import table

BUCKETS, DIM = 1 << 16, 12
#: Bound of the sample, and the number of pieces it is trained in.
TRAIN_DOCS, TRAIN_PARTITIONS = 12_000, 8
#: Steps on the labelled sentences and, at least, in a round of labelling; sentences of such a step; passes over them, at least; rounds.
LABELLED_STEPS, STEPS, BATCH, EPOCHS, ROUNDS = 12, 15, 12_000, 3, 3
#: Rate of the steps; frequency at which a feature counts half.
RATE, COMMON = 0.5, 2e-4
SHARE, SURE, HALF_SURE = 0.2, 0.5, 0.35
MEMORY = 200_000
SLICE_ROWS = 256

_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_NOISE = re.compile(r"https?://\S+|www\.\S+|[#@][\w\-]+|<[^<>\n]{0,200}>|&\w+;")
_TIME = re.compile(r"[\[(<]?\b\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?\b[\])>]?(?:\s*-->\s*\d[\d:.,]*)?")
#: A sentence ends at its mark; a line end within one does not end it.
_END = re.compile(r"(?<=[.!?。！？…])(?<!\d\.)[\"'»”)\]*_]*\s+|(?<=[。！？])")
_REMARK = re.compile(r"^\W*[(\[][^()\[\]]*[)\]]\W*$")
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)*(?!\w)")
_MARKED = re.compile(r"[.!?。！？…][\"'»”)\]*_]*\W*$")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text that have words; a remark in brackets is none, nor is a scrap of one or two words without a mark beside sentences."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf") if not text.isascii() else text
    text = _TIME.sub(" ", _NOISE.sub(" ", _CODE.sub(" ", text)))
    found = [s for s in (" ".join(p.split()) for p in _END.split(text) if p) if _WORD.search(s) and not _REMARK.match(s)]
    whole = [s for s in found if _MARKED.search(s) or len(_WORD.findall(s)) > 2]
    return whole or found


def features(sentence: str) -> list[int]:
    """Buckets of words, word pairs and word beginnings; in scripts without spaces, of character pairs."""
    words = _WORD.findall(sentence.lower())
    if any(c >= "\u3040" for w in words for c in w):
        words = [p for w in words for p in ([a + b for a, b in zip(w, w[1:])] or [w])]
    h = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS
    out = [h(w) for w in words]
    out += [h(a + " " + b) for a, b in zip(words, words[1:])]
    return out + [h("^" + w[:5]) for w in words if len(w) > 5]


@dataclass
class Weights:
    emb: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    rarity: np.ndarray  # weight of a bucket in the mean: a / (a + its frequency)


def start(classes: int, counts: np.ndarray, seed: int = 5) -> Weights:
    rng = np.random.default_rng(seed)
    rarity = COMMON / (COMMON + counts / max(1.0, counts.sum()))
    out = rng.normal(0, 1.0, (DIM, classes)).astype(np.float32)
    return Weights(np.zeros((BUCKETS, DIM), np.float32), out, np.full(classes, -3.0, np.float32), rarity.astype(np.float32))


def _flat(bags: list[list[int]], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, owner and share in the mean of every feature."""
    size = np.array([max(1, len(b)) for b in bags])
    idx = np.fromiter((i for b in bags for i in (b or [0])), dtype=np.int64, count=int(size.sum()))
    owner = np.repeat(np.arange(len(bags)), size)
    weight = rarity[idx]
    return idx, owner, weight / np.maximum(np.bincount(owner, weight), 1e-9)[owner].astype(np.float32)


def _mean(rows: np.ndarray, owner: np.ndarray, share: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return np.add.reduceat(rows * share[:, None], at, axis=0)


class Bags:
    """The features of many sentences as flat arrays: buckets, and the number of them in each sentence."""

    def __init__(self, idx: np.ndarray, size: np.ndarray, rarity: np.ndarray) -> None:
        self.idx, self.rarity, self.at = idx, rarity, np.r_[0, np.cumsum(size)]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, owner and share in the mean of every feature of the given sentences."""
        first, size = self.at[rows], self.at[rows + 1] - self.at[rows]
        idx = self.idx[np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
        owner, weight = np.repeat(np.arange(len(rows)), size), self.rarity[idx]
        return idx, owner, weight / np.maximum(np.bincount(owner, weight), 1e-9)[owner].astype(np.float32)

    def probabilities(self, w: Weights, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros((0, len(w.bias)), np.float32)
        idx, owner, share = self.take(rows)
        return _sigmoid(_mean((w.emb @ w.out)[idx], owner, share) + w.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sum_rows(idx: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    if not len(idx):
        return idx, rows
    order = np.argsort(idx, kind="stable")
    idx = idx[order]
    at = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
    return idx[at], np.add.reduceat(rows[order], at, axis=0)


def _gradient(w: Weights, bags: Bags, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Touched buckets, their gradient, and those of outputs and biases, summed over the given sentences."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.float32), np.zeros_like(w.out), np.zeros_like(w.bias)
    idx, owner, share = bags.take(rows)
    hidden = _mean(w.emb[idx], owner, share)
    g = (_sigmoid(hidden @ w.out + w.bias) - y).astype(np.float32)
    return *_sum_rows(idx, (g @ w.out.T)[owner] * share[:, None]), hidden.T @ g, g.sum(axis=0)


def _to_bytes(idx: np.ndarray, rows: np.ndarray, out: np.ndarray, bias: np.ndarray) -> bytes:
    """Half precision, as shares of the largest value."""
    top = np.float32(np.abs(rows).max(initial=0.0) or 1.0)
    return np.int32(len(idx)).tobytes() + top.tobytes() + idx.astype(np.int32).tobytes() + (rows / top).astype(np.float16).tobytes() + np.concatenate([out.ravel(), bias]).astype(np.float32).tobytes()


def _from_bytes(data: bytes, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, top = int(np.frombuffer(data, np.int32, 1)[0]), np.frombuffer(data, np.float32, 1, 4)[0]
    idx = np.frombuffer(data, np.int32, n, 8)
    rows = np.frombuffer(data, np.float16, n * DIM, 8 + 4 * n).reshape(n, DIM).astype(np.float32) * top
    rest = np.frombuffer(data, np.float32, -1, 8 + 4 * n + 2 * n * DIM)
    return idx, rows, rest[: DIM * classes].reshape(DIM, classes), rest[DIM * classes :]


def prepared(texts: list[str], targets: list[list[float] | None], classes: int) -> bytes:
    """The distinct sentences of some texts as arrays; a target is given for labelled texts, None for those to be labelled.

    idx, size: features of the sentences; own, own_size: sentences of each text to be labelled; known, y: labelled sentences.
    """
    number: dict[str, int] = {}
    bags: list[list[int]] = []
    own: list[list[int]] = []
    known: dict[int, list[float]] = {}
    for text, target in zip(texts, targets):
        mine = []
        for s in sentences(text):
            if s not in number:
                number[s] = len(bags)
                bags.append(features(s) or [0])
            mine.append(number[s])
        if target is not None:
            known.update(dict.fromkeys(mine, target))
        elif mine:
            own.append(mine)
    flat = lambda lists: np.fromiter((i for x in lists for i in x), np.int32, sum(map(len, lists)))
    sizes = lambda lists: np.fromiter(map(len, lists), np.int32, len(lists))
    out = io.BytesIO()
    np.savez(out, idx=flat(bags), size=sizes(bags), own=flat(own), own_size=sizes(own), known=np.fromiter(known, np.int32, len(known)), y=np.array(list(known.values()), np.float32).reshape(-1, classes))
    return out.getvalue()


def targets_of(d: dict, w: Weights, sharp: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sentences that learn, their targets): a sentence has the mean of its texts' subjects, a labelled one its own.

    With ``sharp`` it has only those that the weights find in the sentence itself too.
    """
    n, classes = len(d["size"]), len(w.bias)
    p = Bags(d["idx"], d["size"], w.rarity).probabilities(w, np.arange(n))
    text = np.repeat(np.arange(len(d["own_size"])), d["own_size"])
    share = np.zeros((len(d["own_size"]), classes))
    np.add.at(share, text, p[d["own"]] >= SURE)
    share = np.minimum(1.0, share / np.maximum(d["own_size"], 1)[:, None] / 0.8)
    y, times = np.zeros((n, classes)), np.bincount(d["own"], minlength=n)
    np.add.at(y, d["own"], share[text])
    y /= np.maximum(times, 1)[:, None]
    if sharp:
        y = ((p >= HALF_SURE) & (y >= HALF_SURE / 2)).astype(np.float64)
    y[d["known"]] = d["y"]
    times[d["known"]] += 1
    rows = np.flatnonzero(times)
    return rows.astype(np.int32), y[rows].astype(np.float32)


def _load(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _each(parts: DataFrame, answer, ddl: str) -> DataFrame:
    """``answer(row)`` of every row of arrays, one after the other."""
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                got = answer(dict(zip(names, row)))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in got], [c.split()[0] for c in ddl.split(", ")])

    return parts.mapInArrow(run, ddl)


def fit(parts: DataFrame, begin: Weights, sentences_: int, steps: int, epochs: int) -> Weights:
    """Gradient steps of the logistic losses, each weight with its own falling rate.

    parts: data (arrays), goal (the sentences that learn and their targets). All sentences are gone through
    ``epochs`` times in ``steps`` steps each; a step sums the gradients of all parts.
    """
    spark, classes = parts.sparkSession, len(begin.bias)
    w = Weights(begin.emb.copy(), begin.out.copy(), begin.bias.copy(), begin.rarity)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-4, np.float32), np.full(w.out.shape, 1e-2, np.float32), np.full(w.bias.shape, 1e-1, np.float32)
    for epoch in range(epochs if sentences_ else 0):
        for k in range(steps):
            shared = spark.sparkContext.broadcast(_pack(w))  # a fixed size

            def gradient(row: dict) -> list[bytes]:
                d, goal, now = _load(row["data"]), _load(row["goal"]), _unpack(shared.value, classes)
                mine = np.array_split(np.random.default_rng(epoch).permutation(len(goal["rows"])), steps)[k]
                return [_to_bytes(*_gradient(now, Bags(d["idx"], d["size"], now.rarity), goal["rows"][mine], goal["y"][mine]))]

            got = [_from_bytes(r.g, classes) for r in _each(parts, gradient, "g binary").collect()]  # one gradient a part
            shared.destroy()
            idx, rows = _sum_rows(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            step, lean = sum(g[2] for g in got), sum(g[3] for g in got)
            g_emb[idx] += (rows**2).mean(axis=1)
            w.emb[idx] -= RATE * rows / np.sqrt(g_emb[idx])[:, None]
            g_out += step**2
            w.out -= RATE * step / np.sqrt(g_out)
            g_bias += lean**2
            w.bias -= RATE * lean / np.sqrt(g_bias)
    return w


def _pack(w: Weights) -> bytes:
    return np.concatenate([w.emb.ravel(), w.out.ravel(), w.bias, w.rarity]).astype(np.float32).tobytes()


def _unpack(data: bytes, classes: int) -> Weights:
    flat = np.frombuffer(data, np.float32)
    a, b = BUCKETS * DIM, BUCKETS * DIM + DIM * classes
    return Weights(flat[:a].reshape(BUCKETS, DIM), flat[a:b].reshape(DIM, classes), flat[b : b + classes], flat[b + classes :])


class Scorer:
    """Sentence -> probability of each subject; sentences seen before are remembered (bounded)."""

    def __init__(self, w: Weights) -> None:
        self.scores, self.bias, self.rarity = (w.emb @ w.out).astype(np.float32), w.bias, w.rarity
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        fresh = list({t for t in texts if t not in self.known})
        if len(self.known) + len(fresh) > MEMORY:
            self.known.clear()
            fresh = list(set(texts))
        if fresh:
            idx, owner, share = _flat([features(t) for t in fresh], self.rarity)
            p = _sigmoid(_mean(self.scores[idx], owner, share) + self.bias)
            self.known.update(zip(fresh, p))
        return [self.known[t] for t in texts]


def shares(docs: DataFrame, names: list[str], weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_sentences, shares (array of the share of sentences of each subject, in the order of ``names``)."""
    shared = docs.sparkSession.sparkContext.broadcast(_pack(weights))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(_unpack(shared.value, len(names)))
        for b in (x.slice(at, SLICE_ROWS) for x in batches for at in range(0, x.num_rows, SLICE_ROWS)):
            counts, found = [], []
            for t in b.column(1).to_pylist():
                p = scorer(sentences(t))
                counts.append(len(p))
                found.append((np.array(p) >= SURE).mean(axis=0).tolist() if p else [0.0] * len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.float64()))], [key, "n_sentences", "shares"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_sentences int, shares array<double>")


def train(docs: DataFrame, areas: DataFrame, examples: DataFrame) -> tuple[list[str], Weights]:
    """Subject names and weights. Areas and examples are fixed small tables."""
    names = sorted({r.subject for r in areas.select("subject").collect() if r.subject})
    classes = len(names)
    hot = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: (n == F.col("subject")).cast("float"))
    labelled = examples.where(F.col("subject").isin(names) & F.col("text").isNotNull()).select("text", hot.alias("target"))
    sample = bounded_sample(docs.where("text IS NOT NULL").select("doc_id", "text"), ["doc_id"], TRAIN_DOCS)
    rows = sample.select("text", F.lit(None).cast("array<float>").alias("target")).unionByName(labelled)
    rows = rows.repartition(TRAIN_PARTITIONS, F.xxhash64("text")).sortWithinPartitions("text", "target")  # the same order on every run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, targets = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            targets += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([prepared(texts, targets, classes)], pa.binary())], ["data"])

    def counted(row: dict) -> list[bytes]:
        d = _load(row["data"])
        times = np.bincount(d["own"], minlength=len(d["size"])) + np.bincount(d["known"], minlength=len(d["size"]))
        return [np.bincount(d["idx"], np.repeat(times, d["size"]), BUCKETS).astype(np.float32).tobytes(), np.int64([len(d["size"]), len(d["known"])]).tobytes()]

    def goal(w: Weights | None, sharp: bool = False) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(_pack(w)) if w else None

        def run(row: dict) -> list[bytes]:
            d, out = _load(row["data"]), io.BytesIO()
            found, y = targets_of(d, _unpack(shared.value, classes), sharp) if shared else (d["known"], d["y"])
            np.savez(out, rows=found, y=y)
            return [row["data"], out.getvalue()]

        return written(_each(parts, run, "data binary, goal binary"), "subject-goals")

    parts = written(rows.mapInArrow(read, "data binary"), "subject-features")
    told = _each(parts, counted, "c binary, n binary").collect()  # fixed sizes, one row a part
    total, known = np.sum([np.frombuffer(r.n, np.int64) for r in told], axis=0)
    begin = start(classes, np.sum([np.frombuffer(r.c, np.float32) for r in told], axis=0, dtype=np.float64))
    weights = fit(goal(None), begin, known, 1, LABELLED_STEPS)
    for k in range(ROUNDS):
        steps = max(1, -(-int(total) // BATCH))
        weights = fit(goal(weights, k == ROUNDS - 1), begin, total, steps, max(EPOCHS, -(-STEPS // steps)))
    return names, weights


def p10_shares(spark, folder: str) -> DataFrame:
    """doc_id, subject, n_sentences, share: the share of each document's sentences about each subject."""
    docs = table(spark, folder, "documents")
    names, weights = train(docs, table(spark, folder, "subject_areas"), table(spark, folder, "subject_examples"))
    s = shares(docs, names, weights)
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("subject"), F.col("shares").alias("share"))
    return s.select("doc_id", "n_sentences", F.explode(pairs).alias("x")).select("doc_id", "x.subject", "n_sentences", F.col("x.share")).where("share > 0")


def p10_found(spark, folder: str) -> DataFrame:
    """The subjects of each document."""
    return p10_shares(spark, folder).where(F.col("share") >= SHARE - 1e-9).select("doc_id", "subject").distinct()


def p10_composition(spark, folder: str) -> DataFrame:
    """Documents of each subject."""
    return p10_found(spark, folder).groupBy("subject").agg(F.count("*").alias("n_documents"))
