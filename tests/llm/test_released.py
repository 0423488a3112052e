"""What worker processes give back at the end of a task, and what travels between them."""

import pyarrow as pa

from corpuswright.llm import bpe, common, suffix_dedup


class Pool:
    def __init__(self):
        self.released = 0

    def release_unused(self):
        self.released += 1


def test_a_task_gives_unused_memory_back_at_its_end(monkeypatch):
    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    assert list(common.releasing(lambda rows: (2 * r for r in rows))([1, 2])) == [2, 4] and pool.released == 1
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", ""])], names=["doc_id", "text"])
    out = pa.Table.from_batches(list(bpe._task(None, True, True)([batch])))
    assert out.column("decoded").to_pylist() == ["a b", ""] and pool.released == 2


def test_all_words_of_a_cache_are_measured_without_a_look_at_each():
    class Sealed(dict):
        def __getitem__(self, key):
            raise AssertionError("a look at a word")

    known = {"ab": b"1234", "c.": b"12"}
    assert bpe.Units._bytes(Sealed(known)) == bpe.Units._bytes(known, ["c.", "ab"]) == 2 * 4 + 6 + 2 * bpe.ENTRY


def test_only_texts_with_a_partner_are_shuffled(spark, monkeypatch):
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(300))
    rows = [(1, long), (2, "x" + long), (3, "short"), (4, None), (None, long), (6, long[:300] + "other"), (7, "y" * 500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = common.text_rows(docs).withColumn("body", suffix_dedup.F.md5("text"))
    side = texts.where("doc_id = 1").select("body", suffix_dedup.F.lit(5).alias("v"))
    met, others = suffix_dedup._met(texts, side, "left")
    assert others is None and met.count() == 7
    want = sorted(map(str, suffix_dedup.remove_repeats(docs).drop("kept").collect()))
    monkeypatch.setattr(suffix_dedup, "SIDE", 0)
    met, others = suffix_dedup._met(texts, side, "left")
    assert sorted(map(str, (r["doc_id"] for r in met.collect()))) == ["1", "None"]
    assert sorted(r["doc_id"] for r in others.collect()) == [2, 3, 4, 6, 7]
    assert sorted(map(str, suffix_dedup.remove_repeats(docs).drop("kept").collect())) == want
