"""Folders listed in tasks, and files as bitmaps."""

import json
import os
from collections import Counter

from pyspark.sql import functions as F

from corpuswright.operators import media
from corpuswright.sizing import Measured
from corpuswright.sources import folders, readers


def tree(base):
    for i in range(7):
        for kind in ("attachments", "images"):
            os.makedirs(f"{base}/n{i}/{kind}")
            for j in range(i):
                with open(f"{base}/n{i}/{kind}/f{j}.{'pdf' if j % 2 else 'PNG'}", "w") as out:
                    out.write("x" * (i + j))
        with open(f"{base}/n{i}/info.json", "w") as out:
            out.write(json.dumps({"title": f"t{i}", "url": "u"}, indent=1) if i != 3 else "{ broken")
    os.makedirs(f"{base}/empty")
    with open(f"{base}/top.md", "w") as out:
        out.write("# top\nmore")


def test_folders_are_listed_by_tasks(spark, tmp_path):
    tree(tmp_path)
    path = f"file:{tmp_path}"
    reader = folders.FolderReader({"path": path, "per_task": "3"})
    parts = reader.partitions()  # what the driver holds: entries of the top folder
    assert [len(p.entries) for p in parts] == [3, 3, 3]
    files = folders.folder_files(spark, path, content=False, per_task=3)
    assert files.rdd.getNumPartitions() == 3
    assert files.where("content is not null").count() == 0
    listed = readers.media_folders(spark, path)
    assert {(r["doc_id"], r["kind"]): r["n"] for r in listed.groupBy("doc_id", "kind").agg(F.count("*").alias("n")).collect()} == {
        (f"n{i}", k): i for i in range(1, 7) for k in ("attachments", "images")}
    assert listed.agg(F.sum("length")).first()[0] == 2 * sum(i + j for i in range(7) for j in range(i))
    notices = readers.notice_folders(spark, path)
    assert sorted((r["folder_id"], r["title"]) for r in notices.collect()) == [(f"n{i}", f"t{i}") for i in range(7) if i != 3]
    whole = readers.markdown_folders(spark, str(tmp_path)).collect()
    assert [(r["source"], r["text"]) for r in whole] == [("top.md", "# top\nmore")]


def test_large_files_come_alone(tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "BATCH_BYTES", 500)
    os.makedirs(tmp_path / "a")
    for i in range(5):
        (tmp_path / "a" / f"{i}.txt").write_text("y" * 400 * (i + 1))
    reader = folders.FolderReader({"path": str(tmp_path), "glob": "*.txt"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 5 and max(b.num_rows for b in batches) == 1


def test_very_many_folders_make_bounded_partitions(tmp_path):
    for i in range(2000):
        os.makedirs(tmp_path / f"n{i}")
    parts = folders.FolderReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == -(-2000 // folders.PER_TASK) and max(len(p.entries) for p in parts) == folders.PER_TASK


def test_bitmaps_expand_to_the_joined_rows(spark):
    hits = spark.createDataFrame([(q, d) for q in range(6) for d in range(q, 40, 3)] * 2, "query_id long, doc_id long")
    files = spark.createDataFrame([(d, f"f{d}_{i}.{'pdf' if i % 3 else 'txt'}") for d in range(30) for i in range(d % 7)] * 2,
                                  "doc_id long, path string")
    sets, numbered = media.media_sets(hits, files)
    rows = lambda df: sorted((r["query_id"], r["doc_id"], r["path"]) for r in df.collect())
    assert rows(media.media_of(sets, numbered)) == rows(media.hits_to_media(hits, files))
    few = sets.where("query_id = 4")
    assert rows(media.media_of(few, numbered)) == rows(media.hits_to_media(hits.where("query_id = 4"), files))
    assert sets.count() == 6  # one row a query, however many files


def test_buckets_beyond_the_first(spark):
    hits = spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "query_id long, doc_id long")
    files = spark.range(70000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("path"))
    sets, numbered = media.media_sets(hits, files)
    counts = {r["query_id"]: r["n"] for r in sets.groupBy("query_id").agg(F.sum(F.bitmap_count("files")).alias("n")).collect()}
    assert counts == {1: 35000, 2: 70000}
    assert media.media_of(sets.where("query_id = 1"), numbered).select("path").distinct().count() == 35000


def test_files_of_few_folders_are_many_tasks_work(spark, monkeypatch):
    hits = spark.createDataFrame([(q, d) for q in [*range(200), None] for d in (1, 2, None)] * 2, "query_id long, doc_id long")
    files = spark.createDataFrame([(d, f"{d}_{i}.pdf") for d in (1, 2, 3, None) for i in range(50)] * 2, "doc_id long, path string")
    want = sorted((-1 if q is None else q, d, f"{d}_{i}.pdf") for q in [*range(200), None] for d in (1, 2) for i in range(50))
    for limit in (1 << 20, 0):  # files sent to every task, and too many for that
        monkeypatch.setattr(media, "measure", lambda df: Measured(1, 1 if limit else 1 << 40))
        found = media.hits_to_media(hits, files).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((-1 if r["query_id"] is None else r["query_id"], r["doc_id"], r["path"]) for r in found) == want
        sizes = Counter(r["task"] for r in found)
        assert len(sizes) >= 6 and max(sizes.values()) < len(want) / 2


def test_files_of_a_folder_follow_in_lists_that_compress(spark, tmp_path):
    hits = spark.range(64).select(F.col("id").alias("query_id"), F.lit(7).cast("long").alias("doc_id"))
    files = spark.range(30000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".pdf")).alias("path"))
    media.hits_to_media(hits, files).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 64 * 30000 and rows.select("path").distinct().count() == 30000
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < rows.count() * 68 / 4  # names more than fill a dictionary and, in a row, a compressor's window
