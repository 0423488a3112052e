"""Searches with more questions than a task holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswright.operators import lexical, search


def test_groups_of_questions_give_the_hits_of_one_set(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)] + ["the", "of", "la"] * 6
    docs = spark.createDataFrame([(i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(5 + i % 23))) for i in range(300)],
                                 "chunk_id bigint, text string").unionByName(
        spark.createDataFrame([(300, ""), (301, "w1 w1"), (302, "w1 w1")], "chunk_id bigint, text string")).repartition(4)
    asked = spark.createDataFrame([(f"q{i}", " ".join(words[(i * 5 + j * 3) % len(words)] for j in range(1 + i % 9))) for i in range(60)]
                                  + [("none", "unknown")], "query_id string, question string")
    one = lexical.lexical_topk(docs, "chunk_id", "text", asked, "query_id", "question", 4, drop_build=0.2, drop_search=0.2)
    monkeypatch.setattr(lexical, "GROUP_BYTES", 4000)
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 50)
    profile = lexical.question_profile(docs, "text", asked, "query_id", "question", 0.2, broadcast_bytes=1)
    assert not profile.small
    many = lexical.lexical_topk(docs, "chunk_id", "text", asked, "query_id", "question", 4, drop_build=0.2, profile=profile)
    plan = many._jdf.queryExecution().toString()
    assert "Join" not in plan and "Union" in plan  # no join of postings and questions
    def rows(df):
        return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    assert many.columns == one.columns and rows(many) == rows(one) and many.count() > 150
    assert many.where(F.col("query_id") == "none").count() == 0


def test_documents_are_read_once_for_all_groups(spark, monkeypatch):
    """Whatever the lists' lengths and the matrix's size, the groups give the hits of one set and share one reading of the texts."""
    words = [f"w{i}" for i in range(60)] + ["the", "of", "la"] * 9
    texts = [(i % 190, " ".join(words[(i * 11 + j * j) % len(words)] for j in range(i % 31))) for i in range(200)]  # ten ids come twice
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame(texts, "chunk_id bigint, text string").repartition(3)
    docs = plain.mapInArrow(count, plain.schema)
    asked = spark.createDataFrame([(i % 76, " ".join(words[(i * 5 + j * 3) % len(words)] for j in range(1 + i % 12))) for i in range(80)],
                                  "query_id bigint, question string")

    def rows(df):
        return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())

    for k, cost, gain, together in ((2, 0, 0, 3), (30, 5, 100, 7), (300, 1000, 1000, 200)):
        one = rows(lexical.lexical_topk(plain, "chunk_id", "text", asked, "query_id", "question", k, drop_build=0.2, drop_search=0.2))
        with monkeypatch.context() as m:
            m.setattr(lexical, "GROUP_BYTES", 4000)
            m.setattr(lexical, "LIST_COST", cost)
            m.setattr(lexical, "DENSE_GAIN", gain)
            m.setattr(lexical, "QUESTIONS_TOGETHER", together)
            m.setattr(lexical, "POSTINGS_PER_STEP", 50)
            before = seen.value
            many = lexical.lexical_topk(docs, "chunk_id", "text", asked, "query_id", "question", k, drop_build=0.2, drop_search=0.2,
                                        broadcast_bytes=1)
            assert rows(many) == one
            assert seen.value - before <= 2 * len(texts)  # counted, then coded


def test_refilled_rows_are_read_once_and_only_the_best_get_texts(spark, monkeypatch):
    words = [f"w{i}" for i in range(50)] + ["the", "of"] * 8
    texts = [(i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(3 + i % 19)), f"s{i}") for i in range(90)]
    chunks = spark.createDataFrame(texts, "chunk_id bigint, text string, source string")
    twice = chunks.unionByName(spark.createDataFrame([(4, "w1 w2 the", "other")], chunks.schema))
    listed = [(i, " ".join(words[(i * 5 + j * 3) % len(words)] for j in range(1 + i % 9)), ["label"] if i % 3 else ["x" * 200]) for i in range(40)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(listed, "qa_id bigint, question string, contexts array<string>")
    counted = rows.mapInArrow(count, rows.schema)

    def refilled(data, of):
        out = search.refill_contexts(data, "qa_id", "question", "contexts", lambda needy: search.hybrid_search(of, needy, retrieve_k=20, final_k=3))
        return sorted((r["qa_id"], r["refilled"], tuple(r["contexts"])) for r in out.collect())

    for of in (chunks, twice):
        want = refilled(rows, of)
        with monkeypatch.context() as m:
            m.setattr(search, "PAIRS_WITH_TEXTS", 0)
            before = seen.value
            assert refilled(counted, of) == want and sum(r[1] for r in want) > 20
            assert seen.value - before <= 2 * len(listed)
    asked = rows.select(F.col("qa_id").alias("query_id"), "question")
    want = search.hybrid_search(chunks, asked, retrieve_k=20, final_k=3, normalise=True)
    monkeypatch.setattr(search, "PAIRS_WITH_TEXTS", 0)
    got = search.hybrid_search(chunks, asked, retrieve_k=20, final_k=3, normalise=True)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
