"""Rows the pipeline stages may not lose, names that must not clash, and workers without the package."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuswright.llm import bpe, decontaminate, ngram_join

A = " ".join(f"w{i * 7919 % 1009}" for i in range(60))
B = " ".join(f"v{i * 7919 % 1009}" for i in range(60))
CLASHING = ("_id", "_bad", "doc", "body", "kept_doc", "kept_body", "_w", "node", "c", "first")


def frame(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHING:
        out = out.withColumn(name, F.lit(1))
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_keep_one_keeps_rows_that_only_share_an_id(spark):
    rows = [(1, A), (1, B), (2, A + " more"), (3, ""), (1, ""), (1, None), (None, B + " x"), (None, A[10:]), (None, "alone"),
            (5, "alone"), (1, A), (7, " \t")]
    kept = ngram_join.keep_one(frame(spark, rows), shingle=5, percent=80)
    assert set(CLASHING) < set(kept.columns)
    assert pairs(kept) == sorted([(1, A), (1, B), (3, ""), (1, ""), (1, None), (5, "alone"), (7, " \t")], key=str)
    assert ngram_join.keep_one(frame(spark, rows).limit(0)).count() == 0


def test_decontaminate_drops_the_row_with_the_passage_only(spark):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    rows = [(1, f"{A} {item} {B}"), (1, A), (None, f"{B} {item}"), (None, B), (2, None), (3, "")]
    kept = decontaminate.decontaminate(frame(spark, rows), bench)
    assert pairs(kept) == sorted([(1, A), (None, B), (2, None), (3, "")], key=str)
    assert decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminate(frame(spark, rows).limit(0), bench).count() == 0


def test_stages_take_odd_rows(spark, docs, nothing, small):
    odd = docs.withColumns({n: F.lit(1) for n in CLASHING if n not in docs.columns})
    for table in (odd, nothing):
        out = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.stored(stage(spark, out, small), "test")
            assert out.columns == table.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, out, small).count() == out.count()


def test_round_trip_is_encode_and_decode(spark, docs):
    once = bpe.round_trip(docs)
    assert sorted(map(str, once.collect())) == sorted(map(str, bpe.decode(bpe.encode(docs)).collect()))


def test_unit_cache_keeps_to_its_bytes():
    words = bpe.Vocabulary(open(bpe.vocabulary_file(), encoding="utf-8").read())
    units = bpe.Units(words.encode_units, {}, cached=40_000)
    plain = bpe.Units(words.encode_units, {})
    for i in range(60):
        texts = [" ".join(f"u{i * 40 + j} the same words" for j in range(30)), f"line{i}\nnext{i}."]
        assert units.texts(texts) == plain.texts(texts)
        assert sum(units.held.values()) < 40_000 + 2 * units._bytes(units.spaced, set(texts[0].split(" ")) & units.spaced.keys())


OPS = ["op1_html_extraction", "op2_license_scan", "op3_quality_rules", "op4_arrow_token_ids", "op5_bpe_round_trip", "op6_suffix_dedup",
       "op7_lm_scoring", "op8_decontamination", "op9_pii", "op10_ngram_join", "op11_source_mixing", "op12_prefix_trie",
       "op13_source_divergence"]


def test_workers_need_no_package(small, tmp_path):
    """Every query in a session whose Python workers cannot import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {repo!r})
        from corpuswright.session import local_session
        spark = local_session("4", 4, "3g", "far")
        spark.sparkContext.setCheckpointDir({str(tmp_path / "shared")!r})
        import __spark_entry__ as e
        bad = []
        for name in {OPS!r}:
            try:
                e.queries()[name](spark, {small!r}).count()
            except Exception as error:
                bad.append((name, str(error)[-600:]))
        assert not bad, bad
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
