"""Readers, sinks, stored pages and the two incremental jobs.

Round trips write data derived from the driver tables to the shared folder and
read it back through the reader under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed
from ..operators import evaluation
from ..session import new_table_path, spread
from ..sources import html, readers, writers
from ..sources.folders import write_folders
from ..streaming import jobs
from . import roles
from .registry import Tables, query
from .evaluation_plans import sql_f1
from .retrieval_plans import SQL_VISIBLE
from .roles import sql_norm

SQL_UNESCAPED = ("replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')")
SQL_TITLE = sql_norm(SQL_UNESCAPED.format(x="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


@query("html_to_notice", rf"""SELECT CAST(page_id AS VARCHAR) AS notice_id, url, {SQL_TITLE} AS title, {SQL_VISIBLE} AS content,
  array_to_string(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1), '|') AS links, '' AS images FROM pages""")
def html_to_notice(t: Tables) -> DataFrame:
    found = html.html_to_notice(spread(t.pages, "page_id"), "page_id", "url", "html")
    return found.select("notice_id", "url", "title", "content", F.array_join("links", "|").alias("links"),
                        F.array_join("images", "|").alias("images"))


LISTING = r'<li><a href="/([^"]*)">(.*?)</a></li>'


@query("listing_rows", rf"""WITH r AS (SELECT page_id, regexp_extract_all(html, '(?s){LISTING}', 1) AS ids, regexp_extract_all(html, '(?s){LISTING}', 2) AS titles FROM pages),
  u AS (SELECT page_id, unnest(range(1, len(ids) + 1)) AS position, unnest(ids) AS item_id, unnest(titles) AS title FROM r)
SELECT page_id, position, item_id, {sql_norm(SQL_UNESCAPED.format(x="regexp_replace(title, '(?s)<[^>]*>', ' ', 'g')"))} AS title FROM u""")
def listing_rows(t: Tables) -> DataFrame:
    return html.listing_rows(t.pages, "page_id", "html", row="(?s)" + LISTING)


def _posts(t: Tables) -> DataFrame:
    """Stored pages as notices in the information-file schema."""
    parsed = html.html_to_notice(spread(t.pages, "page_id"), "page_id", "url", "html")
    return parsed.select("notice_id", "title", F.lit("2024-01-01").alias("date"), "url", "content",
                         F.col("links").alias("attachments"), "images")


@query("scan_notices", f"""SELECT CAST(page_id AS VARCHAR) AS folder_id, {SQL_TITLE} AS title, url, length({SQL_VISIBLE}) AS n_content FROM pages""")
def scan_notices(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "notices")
    writers.write_json(_posts(t).repartition("notice_id"), path, ("notice_id",), many_folders=True)
    found = readers.scan_notices(t.spark, path, file_glob="*.json")
    return found.select("folder_id", "title", "url", F.length("content").cast("bigint").alias("n_content"))


@query("media_manifest", """SELECT CAST(page_id AS VARCHAR) AS doc_id, 'attachments' AS kind, 1 AS files FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 'images', 1 FROM pages WHERE page_id % 2 = 0""")
def media_manifest(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "media")
    kinds = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("attachments"), F.lit("images"))).otherwise(F.array(F.lit("attachments")))
    files = t.pages.select(F.col("page_id").alias("notice_id"), F.explode(kinds).alias("kind"), "url")
    write_folders(files, path, ("notice_id", "kind"), "url", "txt")
    listed = readers.media_manifest(t.spark, path, keep=F.col("file_name").endswith(".txt"))
    return listed.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("files"))


@query("notice_folders", f"""SELECT CAST(page_id AS VARCHAR) AS folder_id, {SQL_TITLE} AS title, url, {SQL_VISIBLE} AS content FROM pages""")
def notice_folders(t: Tables) -> DataFrame:
    """The same notices, folders listed by the tasks, their whole content compared."""
    path = new_table_path(t.spark, "notice-folders")
    writers.write_json(_posts(t).repartition("notice_id"), path, ("notice_id",), many_folders=True)
    return readers.notice_folders(t.spark, path, file_glob="*.json").select("folder_id", "title", "url", "content")


@query("media_folders", """SELECT CAST(page_id AS VARCHAR) AS doc_id, 'attachments' AS kind, count(*) AS files, CAST(sum(strlen(url) + 1) AS BIGINT) AS bytes FROM pages GROUP BY 1
UNION ALL SELECT CAST(page_id AS VARCHAR), 'images', count(*), CAST(sum(strlen(url) + 1) AS BIGINT) FROM pages WHERE page_id % 2 = 0 GROUP BY 1""")
def media_folders(t: Tables) -> DataFrame:
    """Files and bytes of every notice folder, listed by the tasks and never opened."""
    path = new_table_path(t.spark, "media-folders")
    kinds = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("attachments"), F.lit("images"))).otherwise(F.array(F.lit("attachments")))
    files = t.pages.select(F.col("page_id").alias("notice_id"), F.explode(kinds).alias("kind"), "url")
    write_folders(files, path, ("notice_id", "kind"), "url", "txt")
    listed = readers.media_folders(t.spark, path, keep=F.col("file_name").endswith(".txt"))
    return listed.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("markdown_folders", "SELECT item_id, text FROM benchmark")
def markdown_folders(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "markdown-folders")
    write_folders(t.benchmark, path, ("item_id",), "text", "txt")
    files = readers.markdown_folders(t.spark, path, file_glob="*.txt")
    return files.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"),
                        F.regexp_replace("text", r"\n\z", "").alias("text"))


@query("scan_json_wrapped", """SELECT item_id, text FROM benchmark""")
def scan_json_wrapped(t: Tables) -> DataFrame:
    """Objects under ``examples``, ``data`` and ``chunks``, and bare rows, one per line."""
    path, kind = new_table_path(t.spark, "wrapped"), F.col("item_id") % 4
    row = F.struct("item_id", "text")
    line = (F.when(kind == 0, F.to_json(F.struct(F.array(row).alias("examples"))))
            .when(kind == 1, F.to_json(F.struct(F.array(row).alias("data"))))
            .when(kind == 2, F.to_json(F.struct(F.array(row).alias("chunks")))).otherwise(F.to_json(row)))
    t.benchmark.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    return readers.scan_json_wrapped(t.spark, path, schema, multi_line=False)


@query("scan_chunk_files", f"""WITH {roles.SQL_CHUNKS} SELECT chunk_id, parent_id, category, entity, chunk_text FROM notice_chunks""")
def scan_chunk_files(t: Tables) -> DataFrame:
    """Every line one array of the chunks of a document."""
    from ..operators.chunking import paragraph_chunk_array
    from ..functions.text import context_header, contextual_chunk_text

    path = new_table_path(t.spark, "chunks")
    n = roles.notices(t)
    header = context_header(F.col("metadata.category"), F.col("metadata.entity"), F.col("title"))
    rows = F.transform("chunks", lambda c, i: F.struct(
        F.concat(F.col("notice_id"), F.lit("_chunk_"), (i + 1).cast("string")).alias("chunk_id"),
        F.col("notice_id").alias("parent_id"), F.col("metadata").alias("metadata"),
        contextual_chunk_text(F.col("header"), c).alias("chunk_text")))
    listed = n.select("notice_id", "metadata", header.alias("header"),
                      paragraph_chunk_array(F.col("refined_content"), separator=roles.LINES).alias("chunks"))
    listed.select(F.to_json(rows).alias("value")).write.text(path)
    found = readers.scan_chunk_files(t.spark, path, file_glob="*.txt", multi_line=False)
    return found.select("chunk_id", "parent_id", "metadata.category", "metadata.entity", "chunk_text")


@query("scan_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def scan_jsonl(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "jsonl")
    writers.write_jsonl(t.conversations, path)
    return readers.scan_jsonl(t.spark, path, t.conversations.schema)


@query("write_json", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def write_json(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "json")
    writers.write_json(t.documents, path, ("lang",))
    return t.spark.read.schema(t.documents.schema).json(path)


@query("scan_metrics_csv", f"""WITH {roles.SQL_RUNS} SELECT event_id, pipeline, faithfulness, latency FROM runs""")
def scan_metrics_csv(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "metrics")
    runs = roles.scored_runs(t).select("event_id", "pipeline", "faithfulness", "latency")
    writers.write_csv_report(runs, path)
    return readers.scan_metrics_csv(t.spark, path, runs.schema, ["faithfulness", "latency"])


@query("write_csv_report", "SELECT doc_id, text, lang FROM documents")
def write_csv_report(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "report")
    rows = t.documents.select("doc_id", "text", "lang")
    writers.write_csv_report(rows, path)
    return readers.scan_metrics_csv(t.spark, path, rows.schema)


@query("scan_markdown", "SELECT item_id, text FROM benchmark")
def scan_markdown(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "markdown")
    write_folders(t.benchmark, path, ("item_id",), "text", "txt")
    files = readers.scan_markdown(t.spark, path, file_glob="*.txt")
    return files.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"),
                        F.regexp_replace("text", r"\n\z", "").alias("text"))


@query("build_collection", """SELECT doc_id, source AS cell, text FROM documents WHERE strlen(text) <= 65535""")
def build_collection(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "collection")
    rows = t.documents.select("doc_id", "text", F.col("source").alias("cell"))
    writers.build_collection(rows, path, cell="cell", limits=fixed.RULE_LIMITS)
    return writers.read_collection(t.spark, path, rows.schema)


@query("rejected_rows", """SELECT doc_id, 'target' AS offending FROM documents WHERE strlen(text) > 1000""")
def rejected_rows(t: Tables) -> DataFrame:
    found = writers.rejected_rows(t.documents.select("doc_id", F.col("text").alias("target")), fixed.NOTICE_LIMITS)
    return found.select("doc_id", F.array_join("offending", ",").alias("offending"))


@query("append_batches", """SELECT event_id, value, event_id // 4000 AS batch FROM events""")
def append_batches(t: Tables) -> DataFrame:
    """Scored batches written in one pass; the second is then appended again and replaces itself."""
    path = new_table_path(t.spark, "batches")
    rows = t.events.select("event_id", "value", F.floor(F.col("event_id") / 4000).alias("batch"))
    rows.write.partitionBy("batch").parquet(path)
    writers.append_batch(rows.filter(F.col("batch") == 1).drop("batch"), path, 1)
    return t.spark.read.parquet(path).select("event_id", "value", F.col("batch").cast("bigint").alias("batch"))


@query("stream_ingest", f"""WITH {roles.SQL_CHUNKS} SELECT chunk_id, parent_id, category, entity, chunk_text FROM notice_chunks""")
def stream_ingest(t: Tables) -> DataFrame:
    """Documents as notice files, streamed into chunks; a second run finds nothing new."""
    base = new_table_path(t.spark, "ingest")
    n = roles.notices(t).drop("doc_id")
    n.write.json(f"{base}/in")
    for _ in range(2):
        source = jobs.stream_notices(t.spark, f"{base}/in", n.schema)
        jobs.stream_ingest(source, f"{base}/out", f"{base}/checkpoint", separator=roles.LINES).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("chunk_id", "parent_id", "category", "entity", "chunk_text")


@query("stream_ingest_expiring", f"""WITH {roles.SQL_CHUNKS} SELECT chunk_id, CASE doc_id % 10 WHEN 0 THEN 2::BIGINT ELSE 1 END AS times, chunk_text FROM notice_chunks""")
def stream_ingest_expiring(t: Tables) -> DataFrame:
    """Notices of ten days, each day's again on the next; after a gap the first day's come once more, too late to be known."""
    base = new_table_path(t.spark, "expiring")
    n = roles.notices(t)
    day = F.pmod("doc_id", F.lit(10))
    batches = [(d, (day == d) | (day == d - 1)) for d in range(10)] + [(30, day == 9), (40, day == 0)]
    schema = n.drop("doc_id").schema.add("seen_at", T.TimestampType())
    for number, (seen, rows) in enumerate(batches):
        seen_at = F.timestamp_seconds(F.lit(1_700_000_000 + 86_400 * seen))
        n.filter(rows).drop("doc_id").withColumn("seen_at", seen_at).write.json(f"{base}/in/batch={number}")
        source = jobs.stream_notices(t.spark, f"{base}/in", schema)
        jobs.stream_ingest(source, f"{base}/out", f"{base}/checkpoint", separator=roles.LINES, seen_at="seen_at").awaitTermination()
    return (t.spark.read.parquet(f"{base}/out").groupBy("chunk_id", "chunk_text")
            .agg(F.count(F.lit(1)).alias("times")).select("chunk_id", "times", "chunk_text"))


@query("stream_join_chunks", """SELECT conv_id AS session, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def stream_join_chunks(t: Tables) -> DataFrame:
    """Turns as streamed pieces: out of order over four batches, each piece once more in the next one."""
    base = new_table_path(t.spark, "pieces")
    batch = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    for number in range(5):
        rows = t.conversations.where((batch == number) | (batch == number - 1)).select("conv_id", "turn", "text")
        rows.repartition(2, "turn").write.parquet(f"{base}/in/batch={number}")
        stream = jobs.stream_notices(t.spark, f"{base}/in", rows.schema, "parquet")
        jobs.stream_join_chunks(stream, f"{base}/out", f"{base}/checkpoint", session="conv_id", seq="turn").awaitTermination()
    return jobs.assembled(t.spark.read.parquet(f"{base}/out"))


@query("stream_score", f"""WITH {roles.SQL_QA}, f AS ({sql_f1('answer', 'ground_truth')})
SELECT qa_id, length(answer) AS n_answer, coalesce(f1, 0) AS token_f1 FROM qa LEFT JOIN f USING (qa_id)""")
def stream_score(t: Tables) -> DataFrame:
    base = new_table_path(t.spark, "score")
    rows = roles.qa(t)
    files = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.spark.sparkContext.defaultParallelism)
    rows.repartition(4 * files).write.parquet(f"{base}/in")
    stream = jobs.stream_notices(t.spark, f"{base}/in", rows.schema, "parquet", files_per_batch=files)
    jobs.stream_score(stream, lambda d: evaluation.with_measures(d, ("token_f1",)), f"{base}/out",
                      f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("qa_id", F.length("answer").cast("bigint").alias("n_answer"), "token_f1")
