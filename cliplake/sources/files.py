"""Text sources: URL lists, listing lines (one JSON object each), extractor logs, label lists; CSV and JSON sinks."""

from __future__ import annotations

import csv
import io
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTING = "id string, url string, webpage_url string, title string, description string, uploader string, channel string, uploader_id string, duration string, upload_date string"
#: Page of an entry that names none, by platform (fixed formats).
PAGES = {"youtube": "https://www.youtube.com/watch?v=%s", "instagram": "https://www.instagram.com/reel/%s/"}
TITLE_LIMIT = {"instagram": 100}


def clean_urls(lines: DataFrame) -> DataFrame:
    """Trimmed lines (column value) without blank ones and comments: url."""
    u = F.trim("value").alias("url")
    return lines.select(u).where("url <> '' AND NOT startswith(url, '#')")


def url_file(spark: SparkSession, path: str, given: list[str] | None = None) -> DataFrame:
    """URLs given directly, then those of a text file; repeats stay."""
    listed = clean_urls(spark.read.text(path))
    return spark.createDataFrame([(u,) for u in given], "url string").unionByName(listed) if given else listed


def browse_entries(lines: DataFrame, platform: str, limit: int | None = None) -> DataFrame:
    """Listing entries of lines (column value); lines that are no JSON object are dropped; missing members get defaults."""
    e = lines.where("trim(value) <> ''").select(F.from_json("value", LISTING, {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL").select("e.*")
    some = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    pid = F.coalesce("id", F.lit(""))
    page = F.when(pid != "", F.format_string(PAGES.get(platform, "%s"), pid)).otherwise("")
    title = some("title", "description") if platform == "instagram" else F.coalesce("title", F.lit(""))
    if platform in TITLE_LIMIT:
        title = F.substring(title, 1, TITLE_LIMIT[platform])
    out = e.select(
        F.lit(platform).alias("platform"), pid.alias("platform_id"), F.coalesce(F.nullif(some("url", "webpage_url"), F.lit("")), page).alias("url"), title.alias("title"),
        F.coalesce("uploader", "uploader_id" if platform == "instagram" else "channel", F.lit("")).alias("uploader"), F.coalesce(F.col("duration").try_cast("double"), F.lit(0.0)).alias("duration_sec"), F.coalesce("upload_date", F.lit("")).alias("upload_date"),
    )
    return out.limit(limit) if limit is not None and limit >= 0 else out


def log_times(logs: DataFrame, column: str) -> DataFrame:
    """All frame times of an extractor's log text, in order: n (from 0), pts."""
    times = F.regexp_extract_all(column, F.lit(r"pts_time:(\d+\.?\d*)"), 1)
    return logs.select(*[c for c in logs.columns if c != column], F.posexplode(times).alias("n", "pts")).withColumn("pts", F.col("pts").cast("double"))


def label_list(labels: DataFrame, classes: int = 527) -> DataFrame:
    """class_no, label in order; 'class_0' ... where the list is empty. A class list is short, so one window orders it."""
    known = labels.where("trim(label) <> ''").select((F.row_number().over(Window.orderBy("label")) - 1).alias("class_no"), "label")
    spare = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias("class_no"), F.concat(F.lit("class_"), F.col("id").cast("string")).alias("label"))
    none = known.agg(F.count("*").alias("n")).where("n = 0")
    return known.unionByName(spare.crossJoin(none).select("class_no", "label"))


def write_csv_exact(rows: DataFrame, folder: str) -> None:
    """CSV as the usual writer makes it: CRLF, doubled quotes, NULL and '' empty. One file a partition, each with the header."""
    names = rows.columns
    os.makedirs(folder, exist_ok=True)

    def put(k: int, it):
        it = iter(it)
        first = next(it, None)
        if first is None:
            return iter(())
        with open(f"{folder}/part-{k:05d}.csv", "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f)
            w.writerow(names)
            w.writerow(["" if x is None else x for x in first])
            for r in it:
                w.writerow(["" if x is None else x for x in r])
        return iter(())

    rows.rdd.mapPartitionsWithIndex(put).count()  # a writer per partition: the one imperative sink


def write_json_files(records: DataFrame, folder: str) -> None:
    """One pretty JSON file per record (video_id, record) in a shared folder."""
    os.makedirs(folder, exist_ok=True)

    def put(rows):
        for r in rows:
            with open(f"{folder}/{r.video_id}.json", "w", encoding="utf-8") as f:
                f.write(json.dumps(json.loads(r.record), ensure_ascii=False, indent=2))

    records.foreachPartition(put)


def csv_line(values: list[Column | str | None]) -> str:
    out = io.StringIO()
    csv.writer(out).writerow(["" if v is None else v for v in values])
    return out.getvalue()
