"""Folders written by tasks: the same folders, lines and rows as Spark's writer gives."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import functions as F

from corpuswright.sources import folders, readers, writers


def files_below(path):
    """Folder and lines of every file, hidden ones aside."""
    out = Counter()
    for folder, _, names in os.walk(path):
        for name in names:
            if not name.startswith((".", "_")):
                with open(os.path.join(folder, name)) as file:
                    out[os.path.relpath(folder, path), name.rsplit(".", 1)[1], tuple(sorted(file.read().splitlines()))] += 1
    return out


def odd_rows(spark):
    keys = ["a", "b/c", "x=y", "", None, "50%", "ä 1", "a", "[t]", "q?", "{z}"]
    return spark.createDataFrame([(k, "k" if i % 2 else "l", i, None if i == 3 else f"line {i}") for i, k in enumerate(keys)],
                                 "id string, kind string, n bigint, line string")


def test_folders_written_by_tasks_equal_the_ones_of_spark(spark, tmp_path):
    rows = odd_rows(spark).select("id", "kind", "line")
    rows.repartition(3, "id").write.partitionBy("id", "kind").text(f"{tmp_path}/plain")
    for _ in range(2):  # the second write replaces the first
        folders.write_folders(rows, f"{tmp_path}/tasks", ("id", "kind"), "line", "txt")
    assert files_below(f"{tmp_path}/tasks") == files_below(f"{tmp_path}/plain")


def test_json_folders_written_by_tasks(spark, tmp_path):
    rows = odd_rows(spark).withColumn("parts", F.array("kind", "line"))
    rows.repartition(3, "id").write.partitionBy("id").json(f"{tmp_path}/plain")
    writers.write_json(rows, f"{tmp_path}/tasks", ("id",), many_folders=True)
    assert files_below(f"{tmp_path}/tasks") == files_below(f"{tmp_path}/plain")


def test_notices_and_media_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    notices = spark.createDataFrame([("1", "one"), ("2", "two")], "notice_id string, title string")
    writers.write_json(notices, f"{tmp_path}/notices", ("notice_id",), many_folders=True)
    folders.write_folders(notices.withColumn("kind", F.lit("images")), f"{tmp_path}/media", ("notice_id", "kind"), "title", "png")
    here = [readers.scan_notices(spark, f"{tmp_path}/notices", file_glob="*.json").select("folder_id", "title"),
            readers.media_manifest(spark, f"{tmp_path}/media")]
    assert all("folder_files" in f._jdf.queryExecution().toString() for f in here)
    monkeypatch.setattr(readers, "in_tasks", lambda *_: False)
    there = [readers.scan_notices(spark, f"{tmp_path}/notices", file_glob="*.json").select("folder_id", "title"),
             readers.media_manifest(spark, f"{tmp_path}/media")]
    for a, b in zip(here, there):
        assert a.columns == b.columns and Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect())) and a.count() == 2
