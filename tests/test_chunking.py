"""Chunkers against plain restatements, on edge rows and generated texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import chunking


def paragraph_reference(text, least):
    out, open_chunk = [], None
    for block in (b.strip() for b in re.split(r"\n\n+", text.strip())):
        if not block:
            continue
        if open_chunk is None:
            open_chunk = block
        elif len(open_chunk) + len(block) < least:
            open_chunk = f"{open_chunk}\n{block}"
        else:
            out.append(open_chunk)
            open_chunk = block
    return out + ([open_chunk] if open_chunk else [])


def bounded_reference(page, most):
    packs = []
    for block in (b.strip() for b in page.strip().split("\n\n")):
        if not block:
            continue
        used = sum(len(b) + 2 for b in packs[-1]) if packs else 0
        if packs and used + len(block) <= most:
            packs[-1].append(block)
        else:
            packs.append([block])
    return ["\n\n".join(p) for p in packs]


def texts():
    rng = random.Random(7)
    sizes = [1, 3, 10, 24, 25, 26, 49, 50, 51, 120, 400, 798, 799, 800, 801, 1600]
    made = ["\n\n".join("é" * rng.choice(sizes) for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    return made + ["", " \n\n ", "short", "short\n\n" + "l" * 60, "a" * 24 + "\n\n" + "b" * 25, "a" * 25 + "\n\n" + "b" * 25,
                   "x\n\n\n\n\ny", "\n\nlead", "p" * 900 + "\n\nq", "q\n\n" + "p" * 900, "a" * 398 + "\n\n" + "b" * 400,
                   "a" * 399 + "\n\n" + "b" * 400]


@pytest.mark.parametrize("build, reference", [
    (lambda: chunking.paragraph_chunk_array(F.col("t")), lambda t: paragraph_reference(t, 50)),
    (lambda: chunking.bounded_chunk_array(F.col("t")), lambda t: bounded_reference(t, 800)),
])
def test_folds(spark, build, reference):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", build().alias("c")).collect()}
    assert got == {i: reference(t) for i, t in enumerate(texts())}


def test_chunks_rejoin_to_the_text(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string")
    joined = rows.select("t", F.array_join(chunking.paragraph_chunk_array(F.col("t")), "\n").alias("j"))
    for row in joined.collect():
        assert row["j"] == "\n".join(b.strip() for b in re.split(r"\n\n+", row["t"].strip()) if b.strip())


def test_split_pages(spark):
    tag = '<page doc_id="1-2" num="{}"></page>'
    text = f"first\n\n{tag.format(1)}\n\n \n\n{tag.format(2)}third\npage{tag.format('iv')} tail is dropped"
    rows = spark.createDataFrame([("a.md", text), ("b.md", "no tag at all"), ("c.md", "")], "source string, text string")
    got = chunking.rule_chunks(rows, "text", "source").orderBy("page_index").collect()
    assert [(r["page_num_raw"], r["page_num"], r["prev_page"], r["next_page"], r["text"]) for r in got] == [
        ("1", 1, 0, 2, "first"), ("iv", None, None, None, "third\npage")]


def test_empty_notices_give_no_rows(spark):
    rows = spark.createDataFrame([("1", None, None, "  ")], "notice_id string, title string, "
                                 "metadata struct<year:string,category:string,target:string,entity:string>, refined_content string")
    assert chunking.notice_chunks(rows).count() == 0


def test_missing_metadata_takes_defaults(spark):
    rows = spark.createDataFrame([("1", None, (None, "", None, None), "body")], "notice_id string, title string, "
                                 "metadata struct<year:string,category:string,target:string,entity:string>, refined_content string")
    row = chunking.notice_chunks(rows).first()
    assert row["chunk_id"] == "1_chunk_1"
    assert row["chunk_text"] == "문서정보: [ - 부서없음] 제목 없음\n\n내용:\nbody"
    assert (row["year"], row["category"]) == ("", "")
