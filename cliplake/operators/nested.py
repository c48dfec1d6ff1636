"""Deeply nested records into flat tables that keep the links from child to parent.

A record is visited once, depth first; every nested object is emitted as one tagged row: table tag, own key,
parent's key and the scalar members as JSON text. The key is the path of array positions (``2.0.1``), so a
child's key begins with its parent's and no counter is shared between tasks. ``write_tables`` writes the rows
partitioned by tag in one pass, ``typed`` gives one tag its schema.

Defined results: NULL, empty or unreadable text gives no rows; a null or scalar element keeps its position
and gives no row; a lone object where an array is usual has position 0; member names count regardless of
case; JSON text inside JSON is read; an object wrapped in one outer field or in prose is the object. Of
several rows of a record the latest counts (NULL times are the earliest; equal times: the greatest texts).
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.functions.jsonish import field, items, read_json, unwrap
from cliplake.sources.tables import table


@dataclass(frozen=True)
class Nest:
    """A child table: its tag, the member that holds it ('' for the document itself) and the tables inside."""

    tag: str
    member: str
    inner: tuple["Nest", ...] = ()


#: What lies in the columns of ``analyses``.
ANALYSIS_NESTS: dict[str, tuple[Nest, ...]] = {
    "full_json": (Nest("timeline", "timeline", (Nest("shots", "shots", (Nest("objects", "objects"),)),)),),
    "hooks_json": (Nest("hooks", "", (Nest("evidence", "evidence"),)),),
    "style_json": (Nest("overlays", "overlays", (Nest("fonts", "fonts"),)),),
}

EMITTED = "video_id string, child_table string, row_key string, parent_key string, payload string"
_NAMES = [c.split()[0] for c in EMITTED.split(", ")]
#: Records visited at a time.
SLICE_ROWS = 256


def _emit(value: Any, nest: Nest, parent: str, out: list[tuple[str, str, str, str]]) -> None:
    for i, obj in items(value):
        if not isinstance(obj, dict):
            continue
        key = f"{parent}.{i}" if parent else str(i)
        flat = {k: v for k, v in obj.items() if not isinstance(unwrap(v), (dict, list))}
        out.append((nest.tag, key, parent, json.dumps(flat, ensure_ascii=False)))
        for child in nest.inner:
            _emit(field(obj, child.member), child, key, out)


def visit(text: str | None, nests: tuple[Nest, ...]) -> list[tuple[str, str, str, str]]:
    """(tag, key, parent key, payload) of every nested object of one document."""
    doc, out = read_json(text), []
    expected = {n.member for n in nests} | {c.member for n in nests if not n.member for c in n.inner}
    if isinstance(doc, dict) and len(doc) == 1:
        (name, inner), inner_value = next(iter(doc.items())), None
        if name.lower() not in expected and isinstance(inner_value := unwrap(inner), (dict, list)):
            doc = inner_value
    for nest in nests:
        _emit(field(doc, nest.member) if nest.member else doc, nest, "", out)
    return out


def flatten(df: DataFrame, key: str, nests: dict[str, tuple[Nest, ...]], version: str | None = None) -> DataFrame:
    """All nested objects of the JSON columns in ``nests``: one tagged row each.

    Rows of one key are reduced to the latest by ``version`` before anything is parsed (partial aggregation
    on the map side, one shuffle). Arrow batches go through the visitor in slices; nothing is gathered by key.
    """
    texts = list(nests)
    rows = df.select(F.col(key).cast("string").alias("video_id"), *texts, *([version] if version else []))
    if version:
        latest = F.max(F.struct(version, *texts)).alias("_r")
        rows = rows.groupBy("video_id").agg(latest).select("video_id", *[f"_r.{c}" for c in texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, SLICE_ROWS) for x in batches for at in range(0, x.num_rows, SLICE_ROWS)):
            keys, *columns = (c.to_pylist() for c in b.columns)
            out: list[tuple] = []
            for i, row_key in enumerate(keys):
                for name, values in zip(texts, columns):
                    out += [(row_key, *r) for r in visit(values[i], nests[name])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], _NAMES)

    return rows.mapInArrow(run, EMITTED)


def write_tables(tagged: DataFrame, path: str) -> None:
    """One pass over the tagged rows into ``path/child_table=<tag>/``."""
    tagged.write.mode("overwrite").partitionBy("child_table").parquet(path)


def typed(tagged: DataFrame, tag: str, schema: str) -> DataFrame:
    """The rows of one tag with ``schema`` applied to the payload; members that don't fit are NULL."""
    mine = tagged.where(F.col("child_table") == tag)
    return mine.select("video_id", "row_key", "parent_key", F.from_json("payload", schema).alias("_p")).select("video_id", "row_key", "parent_key", "_p.*")


def p3_found(spark, folder: str) -> DataFrame:
    """Every nested object of the latest analysis of each video."""
    a = table(spark, folder, "analyses")
    return flatten(a, "video_id", ANALYSIS_NESTS, "created_at").select("video_id", "child_table", "row_key", "parent_key")
