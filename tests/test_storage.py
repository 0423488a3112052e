"""Readers on hand-made files, sinks, and restarts of the incremental jobs."""

import json

from pyspark.sql import functions as F, types as T

from corpuswright import schemas
from corpuswright.sources import html, readers, writers
from corpuswright.streaming import jobs


def test_scan_notices_skips_broken_files(spark, tmp_path):
    for name, body in (("11", json.dumps({"notice_id": "11", "title": "t", "attachments": ["a.pdf"], "images": []}, indent=2)), ("12", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "info.json").write_text(body, encoding="utf-8")
    got = readers.scan_notices(spark, str(tmp_path)).collect()
    assert [(r["folder_id"], r["title"], r["attachments"]) for r in got] == [("11", "t", ["a.pdf"])]


def test_scan_wrapped_shapes(spark, tmp_path):
    row = T.StructType([T.StructField("q", T.StringType())])
    for i, body in enumerate(([{"q": "a"}], {"examples": [{"q": "b"}], "data": [{"q": "no"}]}, {"data": [{"q": "c"}]}, {"chunks": [{"q": "d"}, {"q": "e"}]})):
        (tmp_path / f"{i}.json").write_text(json.dumps(body, indent=1))
    assert sorted(r["q"] for r in readers.scan_json_wrapped(spark, str(tmp_path), row).collect()) == ["a", "b", "c", "d", "e"]


def test_scan_chunk_files(spark, tmp_path):
    (tmp_path / "1_chunks.json").write_text(json.dumps([{"chunk_id": "1_chunk_1", "parent_id": "1", "metadata": {"category": "c"}, "chunk_text": "x"}]))
    (tmp_path / "2_chunks.json").write_text("[]")
    (tmp_path / "3_chunks.json").write_text("")
    (tmp_path / "other.json").write_text('[{"chunk_id": "no"}]')
    assert [r["metadata"]["category"] for r in readers.scan_chunk_files(spark, str(tmp_path)).collect()] == ["c"]


def test_scan_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿faithfulness,answer_relevancy\n0.5,nan\nNaN,\n".encode())
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("faithfulness", "answer_relevancy")])
    got = readers.scan_metrics_csv(spark, str(tmp_path / "r.csv"), schema, schema.names).collect()
    assert [(r[0], r[1]) for r in got] == [(0.5, None), (None, None)]


def test_scan_jsonl_nested(spark, tmp_path):
    line = {"prompt": "p", "chosen": "TEXT", "rejected": "VISION", "analysis": {"text_latency": 1.5, "is_complex": True}}
    (tmp_path / "d.jsonl").write_text(json.dumps(line) + "\n")
    row = readers.scan_jsonl(spark, str(tmp_path / "d.jsonl"), schemas.PREFERENCE_PAIR).first()
    assert (row["analysis"]["text_latency"], row["analysis"]["is_complex"]) == (1.5, True)


def test_scan_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\n\ntwo", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no")
    assert [(r["source"], r["text"]) for r in readers.scan_markdown(spark, str(tmp_path)).collect()] == [("a.md", "one\n\ntwo")]


def test_media_manifest(spark, tmp_path):
    for path in ("5/images/b.PNG", "5/attachments/z.pdf", "5/attachments/n.hwp", "unknown/images/u.png", "6/info.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"xy")
    got = readers.media_manifest(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["kind"], r["file_name"], r["length"]) for r in got] == [
        ("5", "attachments", "z.pdf", 2), ("5", "images", "b.PNG", 2)]


def test_html_to_notice(spark):
    page = ('<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>no()</script><p>Text<br>more &lt;x&gt;'
            '<a href="/Download.do?f=1">plan: a/b.hwp\n(3 KB)</a> <a href="/other"><b>other</b></a>'
            '<img src="data:image/png;base64,xx"><img alt="" src="../pic.png"><!-- hidden --> <p>unclosed')
    row = html.html_to_notice(spark.createDataFrame([(1, "u", page)], "id int, url string, html string"), "id", "url", "html").first()
    assert row["title"] == "A & B" and row["content"] == "Text more <x> plan: a/b.hwp (3 KB) other unclosed"
    assert row["links"] == ["/Download.do?f=1", "/other"]
    assert row["attachments"] == ["plan_ a_b.hwp"] and row["images"] == ["../pic.png"]


def test_listing_rows_with_dates(spark):
    page = "<tr><a href=\"javascript:view('12')\">One</a><td>03-04</td></tr><tr><a href=\"javascript:view('9')\">Two <b>x</b></a><td>2023-01-02</td></tr>"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    got = html.listing_rows(df, "id", "html", row=r"(?s)view\('(\d+)'\)\">(.*?)</a><td>([\d-]+)</td>", date_group=3).collect()
    assert [(r["position"], r["item_id"], r["title"], r["date"]) for r in got] == [(1, "12", "One", "03-04"), (2, "9", "Two x", "2023-01-02")]


def test_collection_is_rebuilt_and_pruned_by_cell(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.range(60).select(F.col("id").cast("string").alias("chunk_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("year"),
                                (F.col("id") % 3).alias("cluster_id"))
    writers.build_collection(df, path)
    assert writers.build_collection(df, path) == (21, 39)
    assert spark.read.parquet(f"{path}-rejected").count() == 39
    assert writers.build_collection(df.limit(0), f"{path}-none") == (0, 0)
    back = writers.read_collection(spark, path, df.schema)
    assert back.count() == 21 and writers.rejected_rows(df).count() == 39
    plan = back.filter("cluster_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan


def test_search_by_cell_reads_probed_folders_only(spark, tmp_path):
    from corpuswright.operators import dense
    path = str(tmp_path / "cells")
    docs = spark.createDataFrame([(str(i), [1.0, float(i % 3)], i % 3) for i in range(30)], "chunk_id string, vector array<float>, cell long")
    docs.write.partitionBy("cell").parquet(path)
    stored = spark.read.schema("chunk_id string, vector array<float>, cell long").parquet(path)
    centroids = spark.createDataFrame([(c, [1.0, float(c)]) for c in range(3)], "cell long, centroid array<float>")
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, vector array<float>")
    hits = dense.ivf_topk(stored, asked, centroids, 3, nprobe=1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "(cell" in plan
    assert {int(r["chunk_id"]) % 3 for r in hits.collect()} == {2}


def notice_file(folder, *ids):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"notice_id": i, "title": "t", "metadata": {"category": "c"}, "refined_content": f"body {i}"}) for i in ids]
    (folder / f"{'-'.join(ids)}.json").write_text("\n".join(lines))


def test_ingest_restarts_without_rework(spark, tmp_path):
    schema = T.StructType([T.StructField("notice_id", T.StringType())] + schemas.REFINED_NOTICE.fields)
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = jobs.stream_notices(spark, str(source), schema)
        jobs.stream_ingest(stream, sink, checkpoint).awaitTermination()
        return sorted(r["chunk_id"] for r in spark.read.parquet(sink).collect())

    notice_file(source, "1", "2")
    assert run() == ["1_chunk_1", "2_chunk_1"]
    assert run() == ["1_chunk_1", "2_chunk_1"]
    notice_file(source, "2", "3")
    assert run() == ["1_chunk_1", "2_chunk_1", "3_chunk_1"]


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).repartition(4).write.parquet(source)
    for attempt in range(2):  # a lost checkpoint replays the same batches
        stream = jobs.stream_notices(spark, source, T.StructType([T.StructField("id", T.LongType())]), "parquet", 1)
        jobs.stream_score(stream, lambda d: d.withColumn("score", F.col("id") * 2.0), sink, str(tmp_path / f"cp{attempt}")).awaitTermination()
    scored = spark.read.parquet(sink)
    assert scored.count() == 20
    last = jobs.progress(scored, ["score"]).orderBy(F.desc("batch")).first()
    assert (last["processed"], last["score"]) == (20, 19.0)
