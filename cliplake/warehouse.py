"""Snapshot tables in a folder: a table is a list of written parts, named in a one-line pointer.

Appending writes the new rows as one more part; replacing writes a new first part. Either way the pointer is
moved last, so readers see the table before or after, never between.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

from cliplake.schemas import MIGRATIONS, SCHEMAS, VERSION


class Warehouse:
    """Tables of ``SCHEMAS`` below ``root`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)
        if not os.path.exists(self._file("VERSION")):
            self._put("VERSION", "0")
        self.migrate()

    def _file(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _put(self, name: str, text: str) -> None:
        tmp = self._file(f".{name}.{uuid.uuid4().hex}")
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(tmp, self._file(name))

    def version(self) -> int:
        with open(self._file("VERSION"), encoding="utf-8") as f:
            return int(f.read())

    def migrate(self) -> list[int]:
        """Applies the missing versions in order; returns them."""
        done = []
        for v in range(self.version() + 1, VERSION + 1):
            for t in MIGRATIONS[v]:
                if not os.path.exists(self._file(f"{t}.json")):
                    self._point(t, [])
            self._put("VERSION", str(v))
            done.append(v)
        return done

    def read(self, name: str) -> DataFrame:
        parts = self._parts(name)
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[self._file(p) for p in parts])

    def _parts(self, name: str) -> list[str]:
        with open(self._file(f"{name}.json"), encoding="utf-8") as f:
            return json.load(f)["parts"]

    def _point(self, name: str, parts: list[str]) -> None:
        self._put(f"{name}.json", json.dumps({"parts": parts}))

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        rows.select(self.columns(name)).write.parquet(self._file(part))
        return part

    @staticmethod
    def columns(name: str) -> list[str]:
        return [c.strip().split()[0] for c in SCHEMAS[name].split(",")]

    def replace(self, name: str, rows: DataFrame) -> None:
        """The whole table anew; readers of the old snapshot are not disturbed until ``vacuum``."""
        self._point(name, [self._write(name, rows)])

    def append(self, name: str, rows: DataFrame) -> None:
        """More rows, as a part of their own: what is there is not written again."""
        part = self._write(name, rows)
        self._point(name, [*self._parts(name), part])

    def put_latest(self, name: str, rows: DataFrame, key: str) -> None:
        """New rows in place of those with the same key."""
        self.replace(name, self.read(name).join(rows.select(key), key, "left_anti").select(self.columns(name)).unionByName(rows.select(self.columns(name))))

    def vacuum(self) -> int:
        """Removes snapshots that no pointer names; returns their number."""
        live = set()
        for t in SCHEMAS:
            if os.path.exists(self._file(f"{t}.json")):
                live.update(self._parts(t))
        gone = [p for p in os.listdir(self.root) if os.path.isdir(self._file(p)) and p not in live]
        for p in gone:
            shutil.rmtree(self._file(p))
        return len(gone)

    def reset(self) -> None:
        """Empties all tables."""
        for t in SCHEMAS:
            self._point(t, [])
        self.vacuum()
