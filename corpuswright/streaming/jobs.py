"""The two incremental jobs: ingest new notices, score new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import notice_chunks


def stream_notices(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json",
                   files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def stream_ingest(notices: DataFrame, sink: str, checkpoint: str, *, key: str = "notice_id",
                  content: str = "refined_content", separator: str = r"\n\n+", seen_at: str | None = None,
                  memory: str = "7 days") -> StreamingQuery:
    """Chunk every new notice once and append the chunks to a parquet table.

    With an event time column ``seen_at`` a notice is remembered for ``memory`` after it was seen and then forgotten, so
    the state holds the ids of that span only, however long the stream runs. A repeat that comes later is
    ingested again; ``late_repeats`` counts it. Without ``seen_at`` all ids stay in the state store, which
    grows with the corpus. Offsets lie in the checkpoint: a restart neither repeats nor loses a notice.
    """
    if seen_at is None:
        fresh = notices.dropDuplicates([key])
    else:
        fresh = notices.withWatermark(seen_at, memory).dropDuplicatesWithinWatermark([key])
    chunks = notice_chunks(fresh, parent=key, content=content, separator=separator, keep=[seen_at] if seen_at else [])
    return (chunks.writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def late_repeats(chunks: DataFrame, key: str = "parent_id", seen_at: str = "seen_at") -> DataFrame:
    """``key, times``: notices the stream took more than once because their first time was forgotten."""
    return (chunks.groupBy(key).agg(F.count_distinct(seen_at).alias("times")).filter(F.col("times") > 1))


def stream_join_chunks(pieces: DataFrame, sink: str, checkpoint: str, *, session: str = "session", seq: str = "seq",
                       text: str = "text", end_mark: str | None = None) -> StreamingQuery:
    """Put streamed answer pieces in order, session by session, as they come.

    Pieces are numbered from 0. Runs without a gap are written at once as parts ``(session, first, last, text)``;
    a piece that comes before its predecessors waits in the state, one that comes again is dropped, and nothing
    from the first piece equal to ``end_mark`` on is written. The state of a session is its next number and the
    pieces that wait, never its text; ``assembled`` joins the parts. Null texts count as empty.
    """
    kind = pieces.schema[session].dataType
    parts = T.StructType([T.StructField("session", kind), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
                          T.StructField("text", T.StringType())])
    kept = T.StructType([T.StructField("next", T.LongType()), T.StructField("ended", T.BooleanType()),
                         T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType()))])

    def assemble(key, frames, state):
        import pandas as pd

        following, ended, waiting = 0, False, {}
        if state.exists:
            following, ended, seqs, texts = state.get
            waiting = dict(zip(seqs, texts))
        for frame in frames:
            for number, piece in zip(frame["seq"], frame["text"]):
                if not ended and number >= following:
                    waiting.setdefault(int(number), "" if piece is None else piece)
        first, run = following, []
        while not ended and following in waiting:
            piece = waiting.pop(following)
            ended = end_mark is not None and piece == end_mark
            if not ended:
                run.append(piece)
                following += 1
        if ended:
            waiting = {}
        state.update((following, ended, list(waiting), list(waiting.values())))
        if run:
            yield pd.DataFrame({"session": [key[0]], "first": [first], "last": [following - 1], "text": ["".join(run)]})

    named = pieces.select(F.col(session).alias("session"), F.col(seq).cast("bigint").alias("seq"), F.col(text).alias("text"))
    ordered = (named.filter(F.col("seq").isNotNull()).groupBy("session")
               .applyInPandasWithState(assemble, parts, kept, "append", "NoTimeout"))
    return (ordered.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def assembled(parts: DataFrame) -> DataFrame:
    """``session, text`` of the parts a stream has written so far."""
    listed = F.sort_array(F.collect_list(F.struct("first", "text")))
    return parts.groupBy("session").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("text"))


def stream_score(rows: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str,
                 checkpoint: str) -> StreamingQuery:
    """Score rows batch by batch. Each batch owns a folder, so a replayed batch
    overwrites itself; the cumulative result is the union of all folders."""
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def progress(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows and running means per finished batch; batches are few."""
    from pyspark.sql import Window

    per_batch = scored.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in metrics])
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return per_batch.select("batch", F.sum("n").over(so_far).alias("processed"),
                            *[(F.sum(m).over(so_far) / F.sum("n").over(so_far)).alias(m) for m in metrics])
