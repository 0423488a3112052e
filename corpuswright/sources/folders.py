"""Files of very many folders as a table, listed and written by the tasks.

A plain reader lists every file on the driver before the first task runs. This
Python data source gives the driver the top folder's entries only; each
partition takes some of them, lists what lies below, and reads the files it finds.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, folder string, kind string, file_name string, length bigint, content binary"
PER_TASK = 256              # top folders of a partition
BATCH_BYTES = 16 << 20      # file content of an Arrow batch; a larger file comes alone
FOUND_BY_ARROW = ("", "file", "hdfs", "s3", "gs")  # schemes of folders that tasks can list


def scheme(path: str) -> str:
    return path.split(":", 1)[0] if ":" in path.split("/")[0] else ""


def _store(path: str):
    """File system and path within it."""
    from pyarrow import fs
    if scheme(path) in ("", "file"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class Folders(InputPartition):
    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries  # path and whether it is a folder


class FolderFiles(DataSource):
    """Options: ``path``, ``glob`` (file names), ``content`` (read the files), ``per_task``."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.content = str(options.get("content", "true")).lower() == "true"
        self.per_task = int(options.get("per_task", PER_TASK))

    def partitions(self) -> list[Folders]:
        from pyarrow import fs
        system, base = _store(self.root)
        top = sorted((e.path, e.type == fs.FileType.Directory) for e in system.get_file_info(fs.FileSelector(base)))
        return [Folders(top[i:i + self.per_task]) for i in range(0, len(top), self.per_task)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        system, base = _store(self.root)
        rows: list[tuple] = []
        size = 0
        for entry, is_folder in partition.entries:
            infos = system.get_file_info(fs.FileSelector(entry, recursive=True) if is_folder else [entry])
            for info in sorted(infos, key=lambda i: i.path):
                if info.type != fs.FileType.File or info.base_name.startswith((".", "_")) or not fnmatch.fnmatchcase(info.base_name, self.glob):
                    continue
                data = None
                if self.content:
                    with system.open_input_stream(info.path) as stream:
                        data = stream.read()
                parts = info.path.split("/")
                inside = info.path[len(base):].strip("/").split("/")
                rows.append((info.path, inside[0] if len(inside) > 1 else "", parts[-2] if len(inside) > 2 else "",
                             info.base_name, info.size, data))
                size += len(data or b"") + 200
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def folder_files(spark: SparkSession, path: str, *, glob: str = "*", content: bool = True,
                 per_task: int = PER_TASK) -> DataFrame:
    """``path, folder, kind, file_name, length, content`` of all files below ``path`` whose name fits ``glob``.

    ``folder`` is the entry of ``path`` a file lies under, ``kind`` the folder it lies in where that is deeper; names
    that begin with a dot or an underscore are left out. Unlike other readers the driver never holds the
    list of files.
    """
    spark.dataSource.register(FolderFiles)
    return (spark.read.format(FolderFiles.name()).option("path", path).option("glob", glob)
            .option("content", str(content).lower()).option("per_task", str(per_task)).load())


# --- writing ---

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 32), *map(ord, "\"#%'*/:=?\\{[]^"), 127)}  # as Spark's own writer does


def in_tasks(spark: SparkSession, path: str) -> bool:
    """Whether the tasks can list and write ``path`` themselves; a bare path belongs to Spark's default file system."""
    default = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    return scheme(path) == "file" or (scheme(path) == "" and default.startswith("file:"))


def write_folders(df: DataFrame, path: str, keys: tuple[str, ...], text: str, extension: str) -> None:
    """One file of lines for each distinct ``keys``, in folders ``key=value/...`` below ``path``, written by the tasks.

    Spark's writer sets the rights of every file by a process of its own and the driver then moves folder after folder. Here
    a task writes each file where it belongs. Names depend on the partition only, so a task that runs again replaces
    its files. What lay at ``path`` is replaced. Schemes the tasks do not know go through Spark's writer, as ``.txt``.
    """
    spark = df.sparkSession
    # A fixed number: joined by their bytes, very many tiny files would be one task's.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    named = [F.nullif(F.col(f"`{k}`").cast("string"), F.lit("")).alias(k) for k in keys]  # both are one folder
    rows = df.select(*named, F.col(text).alias("__line")).repartition(tasks, F.col(f"`{keys[0]}`"))
    if not in_tasks(spark, path):
        rows.write.mode("overwrite").partitionBy(*keys).text(path)
        return
    rows.limit(0).write.mode("overwrite").partitionBy(*keys).text(path)
    listed = rows.select(F.array(*[F.col(f"`{k}`") for k in keys]).alias("values"), "__line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(path)
        name = f"part-{TaskContext.get().partitionId():05d}.{extension}"
        now, out, files = None, None, 0
        for batch in batches:
            for values, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if values != now:
                    if out is not None:
                        out.close()
                    folder = "/".join([base, *(f"{k}={(v or NO_VALUE).translate(_ESCAPED)}" for k, v in zip(keys, values))])
                    system.create_dir(folder, recursive=True)
                    now, out, files = values, system.open_output_stream(f"{folder}/{name}"), files + 1
                out.write(((line or "") + "\n").encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    listed.sortWithinPartitions("values").mapInArrow(run, "files bigint").agg(F.sum("files")).collect()
