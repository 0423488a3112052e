"""Extraction: wrappers, roles, broken markup."""

from corpuswright.llm import extract

SHELL = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>Home</li><li>News</li></ul></nav>'
         '<div class="cookie-notice">We use cookies</div><p>Same line on every page</p>{}<div id="comments"><p>Nice {}</p></div>'
         '<form><label>Name</label></form><footer>&copy; {}</footer></body></html>')


def page(body, n=0):
    return SHELL.format(body, n, n)


def test_extract(spark):
    rows = [(i, f"http://a.example/{i}", page(f"<p>Text &amp; more\n {i}</p><p>Second<br>part {i}", i)) for i in range(6)]
    rows += [(20, "http://b.example/1", "<article><h1>Head</h1><p><b>One<p>Two &lt;x</article><p>outside</p>"), (21, None, None),
             (22, "odd", ""), (23, "http://c.example", "just text &amp no tags"), (20, "http://b.example/1", "<p>again</p>"),
             (24, "http://d.example", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as mark", "3 as slots")
    got = {(r["page_id"], r["url"], r["text"]) for r in extract.extract(pages).collect()}
    want = {(i, f"http://a.example/{i}", f"Text & more {i}\n\nSecond part {i}") for i in range(6)}
    want |= {(20, "http://b.example/1", "Head\n\nOne\n\nTwo <x"), (20, "http://b.example/1", "again"), (21, None, ""), (22, "odd", ""),
             (23, "http://c.example", "just text & no tags"), (24, "http://d.example", "deep")}
    assert got == want
    assert extract.extract(pages.limit(0)).count() == 0


def test_alignment_matches_the_largest_common_tree():
    a = ["body", [["nav", []], ["div", [["p", []]]], ["footer", []]]]
    b = ["body", [["aside", []], ["nav", []], ["div", [["h1", []], ["p", []]]], ["footer", []]]]
    size, pairs = extract.align(a, b)
    assert size == 5 and pairs == {"": "", "/0": "/1", "/1": "/2", "/1/0": "/2/1", "/2": "/3"}


def test_copies_of_one_page_are_not_template(spark):
    pages = spark.createDataFrame([(i, "http://a.example/x", page("<p>One article</p>")) for i in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in extract.extract(pages).collect()} == {"Same line on every page\n\nOne article"}


def texts_of(spark, bodies):
    rows = [(i, "http://a.example/x", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return [r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
            .orderBy("page_id").collect()]


def test_copies_beside_other_pages_are_not_template(spark):
    copy = "<p>Start</p><p>End</p><blockquote>Only here</blockquote>"
    others = [f"<p>Other {i}</p><p>Rest {i}</p>" for i in range(4)]
    assert texts_of(spark, [copy] * 8 + others)[:8] == ["Start\n\nEnd\n\nOnly here"] * 8


def test_boilerplate_of_a_second_layout_is_template(spark):
    first = [f"<div class='one'><p>Text {i}</p></div>" for i in range(7)]
    second = [f"<div class='{'two' if i % 2 else 'three'}'><p>Piece {i}</p></div><section class='x'>Follow us</section>" for i in range(6)]
    assert texts_of(spark, first + second) == [f"Text {i}" for i in range(7)] + [f"Piece {i}" for i in range(6)]


def kept(body):
    return [t for _, _, t in extract.content(extract.layout(f"<html><body>{body}</body></html>")[2])]


def test_one_class_word_does_not_take_the_article():
    text = "<h1>Head</h1><p>A long article of many words.</p>"
    for name in ("has-sidebar", "no-comments", "site right-sidebar", "search-results", "sidebar"):
        assert kept(f"<div class='{name}'>{text}</div>") == ["Head", "A long article of many words."], name
    assert kept("<div class='article-header'><h1>Head</h1></div><p>A long article of many words.</p>") == [
        "Head", "A long article of many words."]
    assert kept("<div><h1 class='main-title'>Head</h1><p>Text</p></div>") == ["Head", "Text"]
    assert kept("<div role='main'><p>Text</p></div><p>Around</p>") == ["Text"]
    assert kept(f"{text}<div class='page-footer'>Foot</div><div class='comments'>Nice</div><nav>Menu</nav>") == [
        "Head", "A long article of many words."]
    assert kept("<nav>Menu</nav>") == []


def test_pages_without_address_have_no_wrapper(spark):
    rows = [(i, None if i % 2 else "nowhere", f"<html><body><p>Own {i}</p><section>Shared by all</section></body></html>") for i in range(8)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"Own {i}\n\nShared by all" for i in range(8)}
