"""State that expires, repeats that come late, restarts."""

from pyspark.sql import functions as F, types as T

from corpuswright.streaming import jobs

DAY = 86_400
META = "struct<year:string,category:string,target:string,entity:string>"


def write_batch(spark, folder, number, ids, day):
    rows = [(f"n{i}", f"title {i}", f"text of notice {i}, long enough to be a chunk of its own and more") for i in ids]
    frame = spark.createDataFrame(rows, "notice_id string, title string, refined_content string")
    frame = frame.withColumns({"metadata": F.lit(None).cast(META), "seen_at": F.timestamp_seconds(F.lit(1_700_000_000 + DAY * day))})
    frame.coalesce(1).write.json(f"{folder}/batch={number:03d}")
    return frame.schema


def test_state_stays_flat_and_late_repeats_are_counted(spark, tmp_path):
    base, states, schema = str(tmp_path), [], None

    def run():
        source = jobs.stream_notices(spark, f"{base}/in", schema)
        query = jobs.stream_ingest(source, f"{base}/out", f"{base}/checkpoint", seen_at="seen_at", memory="2 days")
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    for day in range(12):  # 20 new notices a day, and the day before's again
        ids = range(20 * (day - (day > 0)), 20 * (day + 1))
        schema = write_batch(spark, f"{base}/in", day, ids, day)
        states.append(run()[-1])
    assert max(states[4:]) <= max(states[:5]) and max(states) <= 20 * 5, states
    out = spark.read.parquet(f"{base}/out")
    assert out.select("parent_id").distinct().count() == 240 == out.count()
    assert jobs.late_repeats(out).count() == 0
    write_batch(spark, f"{base}/in", 12, [0, 1, 300], 30)
    run()
    run()  # a restart finds nothing new
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == 243
    assert sorted((r["parent_id"], r["times"]) for r in jobs.late_repeats(out).collect()) == [("n0", 2), ("n1", 2)]


def test_pieces_in_any_order_give_the_batch_answer(spark, tmp_path):
    """Late and repeated pieces, an end mark, a gap that never fills, a restart."""
    from corpuswright.operators import evaluation

    base = str(tmp_path)
    answers = {"a": ["x", "y", "<end>", "late"], "b": ["1", "2", "3", "4", "5"], "c": [None, "n"], "d": ["p", "q", "r"]}
    pieces = [(s, i, t) for s, ts in answers.items() for i, t in enumerate(ts) if (s, i) != ("d", 1)]
    batches = [[pieces[i] for i in order if i < len(pieces)] for order in ([6, 2, 0, 11], [1, 6, 5, 9, 12], [3, 4, 4, 7, 8, 10, 2], [0, 1, 7])]
    seen = sorted({p for b in batches for p in b}, key=str)
    schema = "session string, seq long, text string"
    sizes = []
    for number, batch in enumerate(batches + [[]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{base}/in/batch={number}")
        stream = jobs.stream_notices(spark, f"{base}/in", spark.createDataFrame([], schema).schema, "parquet")
        query = jobs.stream_join_chunks(stream, f"{base}/out", f"{base}/checkpoint", end_mark="<end>")
        query.awaitTermination()
        sizes.append(spark.read.parquet(f"{base}/out").count())
    assert sizes[-1] == sizes[-2]  # nothing new, nothing again
    got = {r["session"]: r["text"] for r in jobs.assembled(spark.read.parquet(f"{base}/out")).collect()}
    whole = spark.createDataFrame([p for p in seen if p[0] != "d"], schema).na.fill("", ["text"])
    want = {r["session"]: r["answer"] for r in evaluation.join_chunks(whole, "session", "seq", "text", end=F.col("text") == "<end>").collect()}
    assert got == want | {"d": "p"}  # what follows the gap waits
