"""Hand-made edge rows for the column functions."""

import pytest
from pyspark.sql import functions as F

from corpuswright import fixed
from corpuswright.functions import contexts as C, core, measures as M, routes as R, text as X


def one(spark, column, row=None):
    frame = spark.range(1) if row is None else spark.createDataFrame([tuple(row.values())], list(row))
    return frame.select(column.alias("v")).first()["v"]


def lit(value):
    return F.lit(value).cast("string") if value is None else F.lit(value)


WHITE = "\t\n\x0b\x0c\r\x1c\x85\xa0 　 "


@pytest.mark.parametrize("text", ["", "  a  b ", f"{WHITE}x{WHITE}y{WHITE}", "a\n\nb"])
def test_white_space_is_pythons(spark, text):
    assert one(spark, core.strip(lit(text))) == text.strip()
    assert one(spark, core.norm_ws(lit(text))) == " ".join(text.split())


def test_norm_ws_of_null(spark):
    assert one(spark, core.norm_ws(lit(None))) == ""


@pytest.mark.parametrize("raw, vision_first, first_token, text_first, binary", [
    ("VISION", "VISION", "VISION", "VISION", "VISION"),
    ("text", "TEXT", "TEXT", "TEXT", "TEXT"),
    ("TEXT or VISION", "VISION", "TEXT", "TEXT", "TEXT"),
    ("neither", "TEXT", "TEXT", "UNKNOWN", "VISION"),
    ("", "TEXT", "TEXT", "UNKNOWN", "VISION"),
    ("the VISION one", "VISION", "TEXT", "VISION", "VISION"),
    ("비전", "TEXT", "TEXT", "VISION", "VISION"),
])
def test_parse_route(spark, raw, vision_first, first_token, text_first, binary):
    got = [one(spark, R.parse_route(lit(raw), m)) for m in ("vision_first", "first_token", "text_first", "binary")]
    assert got == [vision_first, first_token, text_first, binary]


@pytest.mark.parametrize("fields, route", [
    ((None, "", "vision"), "VISION"), (("other", "TEXT RAG", "VISION"), "TEXT"), (("", None, "x"), ""),
    (("both TEXT and VISION", None, None), "VISION"),
])
def test_first_route(spark, fields, route):
    assert one(spark, R.first_route(*[lit(f) for f in fields])) == route


@pytest.mark.parametrize("fields, truth", [
    ((" ", fixed.NO_ANSWER, " a "), "a"), ((None, None, None), ""), (("x", "y", "z"), "x"), ((f" {fixed.NO_ANSWER} ", "", None), ""),
])
def test_first_ground_truth(spark, fields, truth):
    assert one(spark, X.first_ground_truth(*[lit(f) for f in fields])) == truth


@pytest.mark.parametrize("body, name, index, doc_id, num", [
    ("x 1-1-1-1∼12 y", "z", 3, "1-1-1-1", "12"), ("x 1-2~4", "9-9 z", 3, "1-2", "4"),
    ("no tag", "1-2-1-3. title", 3, "1-2-1-3", "3"), ("no tag", "plain", 1, "unknown", "1"),
])
def test_page_tag(spark, body, name, index, doc_id, num):
    got = one(spark, X.page_tag(lit(body), lit(name), lit(index)))
    assert (got["doc_id"], got["num"]) == (doc_id, num)


@pytest.mark.parametrize("question, pick, expected", [
    ("Where?", 0, "Look: Where?"), ("Where?", 1, "Where (see table)?"), (" Where ", 1, "Where (see table)"),
    ("Where?", 2, "Look: Where?"), ("", 0, "Look: "),
])
def test_inject_cue(spark, question, pick, expected):
    assert one(spark, X.inject_cue(lit(question), lit(pick), ["Look: ", " (see table)"])) == expected


def test_complete_date(spark):
    assert str(one(spark, X.complete_date(lit("03-04"), 2024))) == "2024-03-04"
    assert str(one(spark, X.complete_date(lit("2023-12-31"), 2024))) == "2023-12-31"
    assert one(spark, X.complete_date(lit("pinned"), 2024)) is None


@pytest.mark.parametrize("text, bare", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ('"quoted"', "quoted"), ('say "x"', 'say "x"'), ('"', '"'), ("", ""),
])
def test_strip_wrappers(spark, text, bare):
    assert one(spark, X.strip_wrappers(lit(text))) == bare


def test_safe_filename(spark):
    assert one(spark, X.safe_filename(lit('a/b:c*"d"?.pdf\nsize 3'))) == "a_b_c__d__.pdf"


@pytest.mark.parametrize("value", [0.0005, 0.0525, 26.88 / 512, 0.0625, 2.5, 1234.5678, 0.1235])
def test_metric_format_is_pythons(spark, value):
    assert one(spark, X.format_metric(F.lit(value))) == f"{value:.3f}"
    assert one(spark, X.format_metric(F.lit(None).cast("double"))) == "-"


def test_metric_format_on_many_values(spark):
    import random

    rng = random.Random(2)
    values = [rng.uniform(-3, 3) for _ in range(2000)] + [n / 2000 for n in range(-2000, 2000)] + [rng.randrange(10 ** 6) / 512 for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3):
        got = rows.select("v", X.format_metric(F.col("v"), digits).alias("t")).collect()
        assert [r["t"] for r in got] == [f"{r['v']:.{digits}f}" for r in got]


def test_token_counts(spark):
    got = one(spark, X.token_counts(lit("B a, b! A-b é1")))
    assert [(r["token"], r["tf"]) for r in got] == [("a", 2), ("b", 3), ("é1", 1)]
    assert one(spark, X.token_counts(lit(None))) == []


@pytest.mark.parametrize("page, cap, pages", [(1, 10, [1, 2]), (5, 10, [4, 5, 6]), (0, 4, [1]), (0, 10, [1, 2]), (None, 25, [1, 2, 3])])
def test_page_window(spark, page, cap, pages):
    assert one(spark, C.page_window(F.lit(page).cast("int"), cap)) == pages


def test_contexts(spark):
    texts, labels = F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.lit(" label "))
    assert one(spark, C.contexts_as_list(texts, labels)) == ["label"]
    assert one(spark, C.contexts_as_list(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))) == []
    assert one(spark, C.label_only_contexts(F.lit(None).cast("array<string>"))) is True
    assert one(spark, C.label_only_contexts(F.array(F.lit("x" * 120)))) is False


def test_source_label_defaults_differ(spark):
    for category, merged, node in ((None, "[공지사항-일반] 7", "[공지-일반] 7"), ("", "[공지사항-] 7", "[공지-일반] 7")):
        assert one(spark, C.source_label(lit(category), lit("7"), fixed.MERGED_SOURCE_LAYOUT, empty_is_missing=False)) == merged
        assert one(spark, C.source_label(lit(category), lit("7"), fixed.NODE_SOURCE_LAYOUT, empty_is_missing=True)) == node


def test_footer_only_once(spark):
    sources = F.array(F.lit("b"), F.lit("a"), F.lit("b"))
    assert one(spark, C.source_footer(lit("answer"), sources, title="Sources")) == "answer\n\nSources\n- a\n- b"
    assert one(spark, C.source_footer(lit("answer 📚"), sources)) == "answer 📚"


def test_answers_that_are_no_json(spark):
    from corpuswright.functions import routes as R, text as X
    for content, route in ((None, ("REJECT", "")), ("oops", ("REJECT", "")), ('{"route": "text"}', ("TEXT", ""))):
        assert tuple(one(spark, R.route_with_reason(F.lit(content).cast("string")))) == route
    for content, n in ((None, 0), ("[", 0), ('{"qa_pairs": [{"question": "a"}]}', 1), ('{"other": 1}', 0)):
        assert len(one(spark, X.qa_pairs(F.lit(content).cast("string")))) == n
    assert one(spark, X.attachment_text(F.array().cast("array<struct<name:string,text:string>>"))) is None


@pytest.mark.parametrize("answer, truth, f1", [("a b a", "a a c", 2 * 2 / 6), ("", "", 0.0), ("x", None, 0.0), ("same one", "one same", 1.0)])
def test_token_f1(spark, answer, truth, f1):
    assert one(spark, M.token_f1(lit(answer), lit(truth))) == pytest.approx(f1, abs=1e-6)


def test_context_ap(spark):
    contexts = F.array(F.lit("none"), F.lit("a b"), F.lit("zz"), F.lit("b a c"))
    assert one(spark, M.context_ap(lit("a b"), contexts)) == pytest.approx((1 / 2 + 2 / 4) / 2)
    assert one(spark, M.context_ap(lit(""), contexts)) == 0.0


def test_cosine(spark):
    assert one(spark, M.question_answer_cosine(lit("a a b"), lit("a c"))) == pytest.approx(2 / (5 ** 0.5 * 2 ** 0.5), abs=1e-6)
    assert one(spark, M.question_answer_cosine(lit(""), lit("a"))) == 0.0
