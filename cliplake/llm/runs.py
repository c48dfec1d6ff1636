"""Runs of identical or near-identical consecutive events, collapsed into one event with count and duration.

Optimal segmentation: every run has a meaning (a known label, a label of its own, or an event type without a
label); it costs the dissimilarity of its events to that meaning plus BOUNDARY. The dissimilarity is graded:
0 for the label itself in any spelling of the same letters, the share of the typing errors allowed for a
near spelling, FAR for anything else. Pruned dynamic programming finds the cheapest sequence of runs, so a
spelling that is near to two labels goes with its neighbours where that saves boundaries.

Scale: events are range-partitioned by (entity, time, id), so a hot entity spreads over many tasks. An event
whose nearest meaning beats all others by more than two boundaries has that meaning whatever its neighbours
are; the program runs over the events between two such ones, and all others pass by in one step. Of each
partition only the first and the last run of an entity, and undecided events before the first or after the
last decided one, meet their neighbours of other partitions, in one group per entity.

Defined results: a repeated (entity, time, id) counts once; events without a time or an entity are left out;
equal times are ordered by id (NULL ids first); labels that are near to no known one mean themselves; missing
labels (NULL or empty) mean their event type; of equally cheap segmentations the one that goes on with the
run, then the label first in the alphabet. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.functions.clean import to_ms
from cliplake.session import written
from cliplake.sources.tables import table

BOUNDARY, FAR = 0.2, 2.0
#: Labels looked up are remembered per task, up to this many spellings.
MEMORY = 100_000


def letters_of(text: str | None) -> str:
    """Compatibility form, lower case, letters and digits only."""
    if text is None:
        return ""
    return re.sub(r"[^\w]|_", "", unicodedata.normalize("NFKC", text).casefold())


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


class Meanings:
    """From (label, event type) in any spelling to the meanings it is near to."""

    def __init__(self, labels: list[str], types: list[str]) -> None:
        self.labels = {letters_of(x): x for x in sorted(labels) if x}
        self.types = {letters_of(x): x for x in types if x}
        self.known: dict[tuple[str | None, str | None], tuple[str | None, dict[str, float]]] = {}

    def label(self, text: str) -> dict[str, float]:
        """Known label -> dissimilarity, of all that are near; the label itself if none is."""
        key = letters_of(text)
        if key in self.labels:
            return {"L" + self.labels[key]: 0.0}
        most = 1 if len(key) < 8 else 2
        near = {"L" + name: d / (most + 1) for k, name in self.labels.items() if (d := edits(key, k, most)) <= most}
        return near or {"L?" + (key or text.strip()): 0.0}

    def __call__(self, label: str | None, event_type: str | None) -> tuple[str | None, dict[str, float]]:
        """The meaning, if no neighbour can change it (else None), and the dissimilarity to each near meaning."""
        key = (label, None if label else event_type)
        if (m := self.known.get(key)) is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            kind = letters_of(event_type)
            near = self.label(label) if label and label.strip() else {"T" + self.types.get(kind, kind): 0.0}
            first, second = sorted([*near.items(), ("", FAR)], key=lambda x: x[1])[:2]
            m = self.known[key] = (first[0] if first[1] + 2 * BOUNDARY < second[1] else None, near)
        return m


def segment(events: list[dict[str, float]], boundary: float = BOUNDARY, far: float = FAR) -> list[str]:
    """The meaning of every event in the cheapest segmentation; an event is ``far`` from meanings it does not name.

    A meaning that costs a boundary more than the cheapest one can be left out: it can be begun anew for that.
    """
    alive: dict[str, float] = {}
    came: list[dict[str, str]] = []
    for near in events:
        low = min(alive, key=lambda k: (alive[k], k)) if alive else ""
        new, back = {}, {}
        for k in [*alive, *(k for k in near if k not in alive)]:
            stay, change = alive.get(k, float("inf")), (alive[low] if alive else 0.0) + boundary
            new[k] = min(stay, change) + near.get(k, far)
            back[k] = k if stay <= change else low
        best = min(new.values())
        alive = {k: c for k, c in new.items() if c < best + boundary}
        came.append(back)
    if not events:
        return []
    out = [min(alive, key=lambda k: (alive[k], k))]
    for back in came[:0:-1]:
        out.append(back[out[-1]])
    return out[::-1]


_RUN = "part int, seq bigint, edge boolean, video_id string, meaning string, near string, first_id bigint, n bigint, start_ms bigint, last_ms bigint, end_ms bigint"
_NAMES = [c.split()[0] for c in _RUN.split(", ")]
_OUT = "video_id string, meaning string, first_event_id bigint, n_events bigint, start_ms bigint, end_ms bigint"


class _Piece:
    """The runs of one partition, event by event in order."""

    def __init__(self, meanings: Meanings) -> None:
        self.meanings = meanings
        self.done: list[tuple] = []  # finished rows, not yet sent
        self.part, self.seq, self.video, self.entities = 0, 0, None, 0
        self.opened = False  # the partition's first run is closed
        self.held: list | None = None  # the open run: meaning, first id, n, start, last, end
        self.pending: list[tuple] = []  # undecided events since then: near, id, start, end

    def _send(self, edge: bool, meaning: str | None, near: str | None, fields: list) -> None:
        self.done.append((self.part, self.seq, edge, self.video, meaning, near, *fields))
        self.seq += 1

    def _close(self, last: bool = False) -> None:
        if self.held is not None:
            self._send(last or (self.entities == 1 and not self.opened), self.held[0], None, self.held[1:])
            self.opened, self.held = True, None

    def _extend(self, meaning: str, i, s: int, end: int) -> None:
        held = self.held
        if held is not None and held[0] == meaning:
            held[2] += 1
            held[4] = s
            if end > held[5]:
                held[5] = end
        else:
            self._close()
            self.held = [meaning, i, 1, s, s, end]

    def _soft(self) -> None:
        for near, i, s, end in self.pending:
            self._send(True, None, json.dumps(near), [i, 1, s, s, end])
        self.pending = []

    def _settle(self, right: str | None) -> None:
        """Decides the pending events between the open run and the decided event to the right."""
        if self.held is None and self.entities == 1 and not self.opened:
            self._soft()  # what lies before them is in another partition
            return
        left = [{self.held[0]: 0.0}] if self.held is not None else []
        found = segment([*left, *(p[0] for p in self.pending), *([{right: 0.0}] if right else [])])[len(left) :]
        pending, self.pending = self.pending, []
        for m, (_, i, s, end) in zip(found, pending):
            self._extend(m, i, s, end)

    def add(self, video: str, s: int, i, kind, label, end: int) -> None:
        if video != self.video:
            if self.pending:
                self._settle(None)
            self._close()
            self.video, self.entities = video, self.entities + 1
        meaning, near = self.meanings(label, kind)
        if meaning is None:
            self.pending.append((near, i, s, end))
            return
        if self.pending:
            self._settle(meaning)
        self._extend(meaning, i, s, end)

    def finish(self) -> None:
        self._close(True)
        self._soft()

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.done), _SCHEMA)], schema=_SCHEMA)
            self.done = []


def _stitch(rows: pd.DataFrame) -> pd.DataFrame:
    """The edge rows of one entity, joined over the borders of partitions."""
    rows = rows.sort_values(["part", "seq"]).astype(object).where(lambda d: d.notna(), None)
    chains: list[list] = []
    for r in rows.itertuples(index=False):
        last = chains[-1][-1] if chains else None
        # Two decided runs of one partition are its first and its last one: others may lie between.
        if last is None or (last.part == r.part and last.near is None and r.near is None):
            chains.append([])
        chains[-1].append(r)
    out: list[list] = []
    for chain in chains:
        found = segment([{r.meaning: 0.0} if r.near is None else json.loads(r.near) for r in chain])
        begun = len(out)
        for m, r in zip(found, chain):
            end = max(r.last_ms, r.end_ms)
            if len(out) > begun and out[-1][1] == m:
                out[-1][3] += r.n
                out[-1][5] = max(out[-1][5], end)
            else:
                out.append([r.video_id, m, r.first_id, r.n, r.start_ms, end])
    return pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])


def event_runs(events: DataFrame, labels: DataFrame, partitions: int | None = None) -> DataFrame:
    """video_id, meaning, first_event_id, n_events, start_ms, end_ms: every run, single events included.

    ``labels`` is the fixed table of known sounds; its rows go to every task (23 of them; refused above 10,000).
    """
    known = labels.select("label", "event_type").limit(10_001).collect()
    if len(known) > 10_000:
        raise ValueError("the table of known labels must stay small")
    names, types = [r.label for r in known], sorted({r.event_type for r in known if r.event_type})
    spark = events.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select("video_id", to_ms(F.col("start_sec")).alias("s"), F.col("id").cast("long").alias("id"), "event_type", "label", to_ms(F.col("end_sec")).alias("e"))
    rows = rows.where("video_id IS NOT NULL AND s IS NOT NULL")
    # Pieces of a range are sorted within themselves, and equal keys share a piece.
    rows = rows.repartitionByRange(parts, "video_id", "s", "id").sortWithinPartitions("video_id", "s", "id")
    rows = rows.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, before = _Piece(Meanings(names, types)), None
        for batch in batches:
            for v, s, i, kind, label, e, part in zip(*(c.to_pylist() for c in batch.columns)):
                if (v, s, i) == before:
                    continue
                before, piece.part = (v, s, i), part
                piece.add(v, s, i, kind, label, s if e is None else e)
            yield from piece.take()
        piece.finish()
        yield from piece.take()

    pieces = written(rows.mapInArrow(run, _RUN), "runs")
    inner = pieces.where("NOT edge").select("video_id", "meaning", F.col("first_id").alias("first_event_id"), F.col("n").alias("n_events"), "start_ms", F.greatest("last_ms", "end_ms").alias("end_ms"))
    return inner.unionByName(pieces.where("edge").groupBy("video_id").applyInPandas(_stitch, _OUT))


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("seq", pa.int64()), ("edge", pa.bool_()), ("video_id", pa.string()), ("meaning", pa.string()), ("near", pa.string())]
    + [(c, pa.int64()) for c in ("first_id", "n", "start_ms", "last_ms", "end_ms")]
)


def p7_runs(spark, folder: str) -> DataFrame:
    """Every run of events with its count and duration."""
    runs = event_runs(table(spark, folder, "audio_events"), table(spark, folder, "audio_labels"))
    return runs.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def p7_found(spark, folder: str) -> DataFrame:
    """Runs of at least two events."""
    return p7_runs(spark, folder).where("n_events >= 2").select("video_id", "first_event_id", "n_events")


_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_KEY = "regexp_replace(lower(translate({0}, '" + _WIDE + "', '" + _NARROW + "')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
#: The same in SQL: nearest label by edits with swaps, then neighbouring equal meanings.
P7_SQL = f"""WITH spelled AS (SELECT DISTINCT label, {_KEY.format('label')} AS k FROM audio_events WHERE trim(coalesce(label, '')) <> ''),
known AS (SELECT DISTINCT label AS name, {_KEY.format('label')} AS k FROM audio_labels),
near AS (SELECT s.label, k.name, damerau_levenshtein(s.k, k.k) AS d, CASE WHEN length(s.k) < 8 THEN 1 ELSE 2 END AS most FROM spelled s, known k),
ranked AS (SELECT label, name, d, row_number() OVER (PARTITION BY label ORDER BY d, name) AS r, count(*) OVER (PARTITION BY label, d) AS ties FROM near WHERE d <= most),
meant AS (SELECT s.label, CASE WHEN r.name IS NOT NULL AND (d = 0 OR ties = 1) THEN 'L' || r.name ELSE 'L?' || s.k END AS m FROM spelled s LEFT JOIN ranked r ON r.label = s.label AND r.r = 1),
e AS (SELECT DISTINCT a.video_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, a.id, coalesce(meant.m, 'T' || {_KEY.format('a.event_type')}) AS m
  FROM audio_events a LEFT JOIN meant ON meant.label = a.label WHERE a.video_id IS NOT NULL AND start_sec IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(m) OVER w = m THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY video_id ORDER BY s, id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT video_id, arg_min(id, (s, id)) AS first_event_id, count(*) AS n_events FROM g GROUP BY video_id, run HAVING count(*) >= 2"""
