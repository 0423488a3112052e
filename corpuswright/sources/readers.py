"""Readers with explicit schemas. None of them infers or collects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed, schemas
from ..functions.core import null_if_nan
from ..operators.media import is_media
from .folders import PER_TASK, folder_files, in_tasks


def notice_folders(spark: SparkSession, folder: str, *, file_glob: str = "info.json", per_task: int = PER_TASK) -> DataFrame:
    """``scan_notices`` for very many folders: tasks list and read them, the driver holds the notice folders' names only.

    A file that is no object is skipped, as there.
    """
    files = folder_files(spark, folder, glob=file_glob, per_task=per_task)
    notice = F.from_json(F.col("content").cast("string"), schemas.NOTICE, {"mode": "PERMISSIVE"})
    parsed = files.select(notice.alias("n"), F.regexp_replace("folder", "^notice_id=", "").alias("folder_id"))
    return parsed.filter(_told("n")).select("n.*", "folder_id")


def _told(notice: str) -> Column:
    """Whether any field of a parsed notice is there."""
    return reduce(lambda x, y: x | y, [F.col(f"{notice}.`{f.name}`").isNotNull() for f in schemas.NOTICE.fields])


def markdown_folders(spark: SparkSession, folder: str, *, file_glob: str = "*.md", per_task: int = PER_TASK) -> DataFrame:
    """``scan_markdown`` with the listing in tasks."""
    files = folder_files(spark, folder, glob=file_glob, per_task=per_task)
    return files.select(F.col("file_name").alias("source"), "path", F.col("content").cast("string").alias("text"))


def media_folders(spark: SparkSession, folder: str, *, keep: Column | None = None, per_task: int = PER_TASK) -> DataFrame:
    """``media_manifest`` with the listing in tasks; each path comes once, in no order. No file is opened."""
    files = folder_files(spark, folder, content=False, per_task=per_task)
    rows = files.select("path", "length", F.regexp_replace("folder", "^notice_id=", "").alias("doc_id"),
                        F.regexp_replace("kind", "^kind=", "").alias("kind"), "file_name")
    wanted = is_media(F.col("file_name")) if keep is None else keep
    return rows.filter(F.col("kind").isin("attachments", "images") & (F.col("doc_id") != fixed.UNKNOWN_DOCUMENT) & wanted)


def scan_notices(spark: SparkSession, folder: str, *, file_glob: str = "info.json",
                 id_pattern: str = r"/(?:notice_id=)?([^/=]+)/[^/]+$") -> DataFrame:
    """Every ``<id>/info.json``; unreadable files are skipped. ``folder_id`` is the folder's name.

    Tasks list and read the folders where they can, so the driver never holds the list of files.
    """
    if in_tasks(spark, folder):
        files = folder_files(spark, folder, glob=file_glob)
        notice = F.from_json(F.col("content").cast("string"), schemas.NOTICE, {"mode": "PERMISSIVE"})
        parsed = files.select(notice.alias("n"), F.regexp_extract("path", id_pattern, 1).alias("folder_id"))
        return parsed.filter(_told("n")).select("n.*", "folder_id")
    return (spark.read.schema(schemas.NOTICE).option("multiLine", True).option("mode", "DROPMALFORMED")
            .option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).json(folder)
            .withColumn("folder_id", F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1)))


def scan_json_wrapped(spark: SparkSession, path: str, row: T.StructType, *, multi_line: bool = True,
                      keys: Sequence[str] = ("examples", "data", "chunks")) -> DataFrame:
    """Rows of a JSON file whose top level is a list, or an object holding the list
    under the first present of ``keys``."""
    wrapper = T.StructType(row.fields + [T.StructField(k, T.ArrayType(row)) for k in keys])
    raw = spark.read.schema(wrapper).option("multiLine", multi_line).json(path)
    bare = F.array(F.struct(*[F.col(f"`{f.name}`") for f in row.fields]))
    return raw.select(F.inline(F.coalesce(*[F.col(k) for k in keys], bare)))


def scan_chunk_files(spark: SparkSession, folder: str, *, file_glob: str = "*_chunks.json",
                     multi_line: bool = True) -> DataFrame:
    """All chunk arrays below a folder; empty files give no rows."""
    return (spark.read.schema(schemas.NOTICE_CHUNK).option("multiLine", multi_line)
            .option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
            .option("pathGlobFilter", file_glob).json(folder).filter(F.col("chunk_id").isNotNull()))


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_metrics_csv(spark: SparkSession, path: str, schema: T.StructType,
                     metrics: Sequence[str] = (), *, multi_line: bool = True) -> DataFrame:
    """Report with a header line; a byte-order mark before it does no harm, because
    columns go by position. NaN becomes null in the ``metrics``. Without ``multi_line``, for reports whose cells hold
    no line breaks, a large file is read by many tasks."""
    raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
           .option("multiLine", multi_line).option("escape", '"').csv(path))
    return raw.withColumns({m: null_if_nan(m) for m in metrics}) if metrics else raw


def scan_markdown(spark: SparkSession, folder: str, *, file_glob: str = "*.md") -> DataFrame:
    """One row per file: ``source`` (file name), ``path`` and the whole ``text``."""
    return (spark.read.option("pathGlobFilter", file_glob)
            .option("recursiveFileLookup", True).text(folder, wholetext=True)
            .select(F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("path"),
                    F.col("value").alias("text")))


def media_manifest(spark: SparkSession, folder: str, *, keep: Column | None = None,
                   layout: str = r"/(?:notice_id=)?([^/=]+)/(?:kind=)?(attachments|images)/([^/]+)$") -> DataFrame:
    """Attachment and image files per notice, attachments first, each path once.

    Only paths and sizes are read. ``keep`` is a predicate on the file name,
    PDF and image names by default.
    """
    if in_tasks(spark, folder):  # the same paths, listed by the tasks
        files = folder_files(spark, folder, content=False).select(F.concat(F.lit("file:"), "path").alias("path"), "length")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    parts = files.select("path", "length", *[
        F.regexp_extract("path", layout, i).alias(n)
        for i, n in enumerate(("doc_id", "kind", "file_name"), start=1)])
    wanted = is_media(F.col("file_name")) if keep is None else keep
    return (parts.filter((F.col("doc_id") != "") & (F.col("doc_id") != fixed.UNKNOWN_DOCUMENT) & wanted)
            .dropDuplicates(["path"]).orderBy("doc_id", "kind", "file_name"))
