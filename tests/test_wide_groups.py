"""Steps that must not hand a whole group or batch to one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswright.operators import datasets, ordinals
from corpuswright.plans import storage_plans
from corpuswright.plans.registry import Tables
from corpuswright.streaming import jobs


def test_a_group_of_few_but_wide_rows_is_cut_into_ranges(spark, monkeypatch):
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("q"), F.repeat(F.lit("x"), 500)).alias("question"),
                                   F.when(F.col("id") % 5 == 0, "VISION").otherwise("TEXT").alias("route")).repartition(4)

    def numbered():
        return ordinals.with_ordinal(rows, "n", [F.col("doc_id")], [F.col("route")])

    def balanced():
        return datasets.balance_routes(rows, question="question", route="route", order=[F.col("doc_id")], pick=F.col("doc_id"), cues=("see",))

    want = [sorted(numbered().collect()), sorted(balanced().collect())]
    assert "__range" not in numbered()._jdf.queryExecution().toString()
    monkeypatch.setattr(ordinals, "WINDOW_BYTES", 50_000)
    assert "__range" in numbered()._jdf.queryExecution().toString()
    assert [sorted(numbered().collect()), sorted(balanced().collect())] == want


def test_streamed_batches_hold_many_files(spark, small, monkeypatch):
    taken = []
    plain = jobs.stream_notices

    def spy(*args, **options):
        taken.append(options["files_per_batch"])
        return plain(*args, **options)

    monkeypatch.setattr(jobs, "stream_notices", spy)
    storage_plans.stream_score(Tables(spark, small))
    assert taken[0] >= spark.sparkContext.defaultParallelism
