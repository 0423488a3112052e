"""Document operators against brute force on small tables, with every edge row."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpuswright.llm import arrow_ids, bpe, decontaminate, language_model, licenses, ngram_join, pii, quality, suffix_dedup
from corpuswright.llm import attention as model

from .conftest import LONG, TEXTS

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0D]+")


def by_row(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_licenses(docs, nothing):
    def expect(text):
        low = (text or "").translate(LOWER)
        found = [m.group() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(found))
                  if found[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))

    got = licenses.license_scan(docs)
    assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter(
        (i, *expect(t)) for i, t in TEXTS)
    row = got.where("doc_id = 11").first()
    assert row["labels"] == "apache,apache-2.0,mit" and 0 < row["score"] <= 1
    assert licenses.license_scan(nothing).count() == 0
    assert len(licenses.rules()) > 200


def test_license_suppression_keeps_the_wider_and_surer():
    spans = licenses.scan("SPDX-License-Identifier: AGPL-3.0-or-later; this is under GNU General\nPublic License v2")[7]
    assert [s[2] for s in spans] == ["agpl-3.0", "gpl-2.0"]


def expected_quality(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    counts = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 5)}
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            len(found) < 10 or 100 * len(repeated) > 20 * len(found))


def test_quality(docs, nothing):
    got = quality.quality_report(docs)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter(
        (i, *expected_quality(t)) for i, t in TEXTS)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert by_row(kept, "doc_id") == by_row(got.where("kept"), "doc_id")
    assert quality.quality_report(nothing).count() == 0


def test_quality_sketches_merge(docs):
    measured = quality.base_columns(docs.select("doc_id", "text", "lang", "source").na.fill(""))
    whole = by_row(quality.sketch(measured), "lang", "source", "measure", "bucket", "n")
    halves = Counter()
    for part in ("coalesce(doc_id, 0) % 2 = 0", "coalesce(doc_id, 0) % 2 = 1"):
        for r in quality.sketch(measured.where(part)).collect():
            halves[r["lang"], r["source"], r["measure"], r["bucket"]] += r["n"]
    assert whole == Counter((*k, n) for k, n in halves.items())


def test_quality_limits_follow_the_source(spark):
    plain = " ".join(f"word{i}" for i in range(100))
    marked = lambda n: plain + "#" * n
    rows = [(0, marked(0), "plain"), (1, marked(12), "plain"), (2, marked(12), "tables"), (3, marked(28), "tables"),
            (4, marked(28), "plain"), (5, marked(300), "junk"), (6, marked(12), "odd"), (7, "few", "failed")]
    rows += [(100, marked(0), "plain")] * 1000 + [(101, marked(25), "tables")] * 300 + [(102, marked(300), "junk")] * 50
    rows += [(103, "few", "failed")] * 300
    got = quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang"))
    kept = {r["doc_id"]: r["kept"] for r in got.select("doc_id", "kept").distinct().collect()}
    assert kept == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 100: True, 101: True, 102: False, 103: False}
    limits = got.where("doc_id in (1, 2)").orderBy("doc_id").collect()
    assert [r["symbol_rate_max"] for r in limits] == [0.10, 0.30]


def test_bpe_equals_the_library_and_comes_back(docs, nothing, tokenizer):
    got = bpe.decode(bpe.encode(docs))
    want = Counter()
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got.collect()) == want
    assert bpe.decode(bpe.encode(nothing)).count() == 0


def test_long_word_tree_equals_the_forest():
    words = bpe.Vocabulary(open(bpe.vocabulary_file(), encoding="utf-8").read())
    some = [b"internationalisation", b"aaaaaaaaaaaaaaaa", "Ünïcödé漢字".encode(), b"x"]
    assert [words.merge_long(w).astype("<u4").tobytes() for w in some] == words.merge_short(some)


def test_arrow_files(docs, nothing, tokenizer):
    index = arrow_ids.write_ids(docs, length=16, rows=3)
    got = arrow_ids.read_ids(index, length=16, rows=3).collect()
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, arrow_ids.END], "<u4")
        want.append((i, start, len(ids), ids.tobytes()))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got), key=lambda r: r[1]) == want
    assert arrow_ids.write_ids(nothing).count() == 0


def test_words_of_letters_need_no_search_for_pre_tokens(tokenizer):
    """Their ids come from the library's model alone; what the pattern would part goes through it."""
    searched = []

    class Counted:
        model = tokenizer.model

        def encode_batch_fast(self, texts, **options):
            searched.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    content = open(bpe.vocabulary_file(), encoding="utf-8").read()
    plain = ["word", " word", " ñandú$$$", " Ünion.", " 漢字か한글", " it's", " don'", " Straße]'s", "'s", " a1", " '", " x\u00adx", " ªº", " ǅ''", " é\u0301x"]
    encode = arrow_ids._library(Counted(), "<u2", arrow_ids._whole_words(content))
    assert encode(plain) == [np.array(tokenizer.encode(u, add_special_tokens=False).ids, "<u2").tobytes() for u in plain]
    seen = "\n".join(searched).split("\n")
    assert not {"word", " word", " ñandú$$$", " Ünion.", " 漢字か한글", " don'"} & set(seen) and {" it's", "'s", " a1"} <= set(seen)


@pytest.mark.parametrize("gathered", [suffix_dedup.GATHERED, 3, 1])
def test_repeats(docs, nothing, gathered, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GATHERED", gathered)
    if gathered < 5:  # hot ranks, and texts in stretches
        monkeypatch.setattr(suffix_dedup, "HOT", 4)
        monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    bodies = [(i, (t or "").encode()) for i, t in TEXTS]
    counts = Counter(b[k:k + 400] for _, b in bodies for k in range(len(b) - 399))
    want = Counter()
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if counts[b[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()] += 1
    assert by_row(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    if gathered > 3:
        assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_a_common_passage_is_one_row_of_each_text(spark, monkeypatch):
    """Places of a crowded passage grow with the texts that have it, not with its classes of distances too."""
    monkeypatch.setattr(suffix_dedup, "GATHERED", 5)
    passage = " ".join(f"p{i * 7919 % 10007}" for i in range(200))
    docs = spark.createDataFrame([(i, f"{i} " * 30 + passage + f" {i * i}" * 20) for i in range(40)], "doc_id long, text string")
    made = []
    keep = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: made.append((name, out := keep(df, name))) or out)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    counts = Counter(t[k:k + 400] for t in texts.values() for k in range(len(t) - 399))
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if counts[t[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        assert got[i] == sum(gone)
    found = {name: df for name, df in made}
    contexts = found["contexts"].where(f"members > {suffix_dedup.GATHERED}").count()
    assert contexts and found["starts"].where("print is null").count() <= 2 * contexts


@pytest.mark.parametrize("together", [suffix_dedup.TOGETHER, 40])
def test_a_pattern_that_goes_on_is_not_an_anchor_a_period(spark, monkeypatch, together):
    """Its strings stay at one place of each text, and what starts twice in a text is known there."""
    monkeypatch.setattr(suffix_dedup, "GATHERED", 5)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    texts = [*("ab cd ef " * 200 + f"tail {i} " * 3 for i in range(12)), f"{'xy zw uv ' * 60}end", "ab cd ef " * 60 + "q", "ab cd ef " * 45]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {}
    keep = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: made.update({name: (out := keep(df, name))}) or out)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    counts = Counter(t[k:k + 400] for t in texts for k in range(len(t) - 399))
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if counts[t[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        assert got[i] == sum(gone)
    if together > 1000:
        assert made["contexts"].count() <= 10 * len(texts)  # 200 periods a text


@pytest.mark.parametrize("frequent", [language_model.FREQUENT, 40, 0])
def test_language_model(docs, nothing, frequent, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    counts, rows = Counter(), []
    for i, t in TEXTS:
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        found = [*WORD.findall((t or "").translate(LOWER)), None]
        rows.append((i, held, found))
        if not held:
            counts.update(found)
    total = sum(counts.values())
    want = Counter((i, h, len(f), sum(counts[w] > 0 for w in f), total,
                    round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in f), 5)) for i, h, f in rows)
    got = language_model.score(docs).collect()
    assert Counter((*r[:5], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert language_model.score(nothing).count() == 0


def test_language_model_learns_from_every_token(docs, monkeypatch):
    """The targets of all rounds together are all ids of the training rows."""
    weights = model.fresh(np.ones(model.CLASSES))
    monkeypatch.setattr(model, "gradients", lambda w, x, y: {n: np.zeros_like(v) for n, v in w.items()})

    class State:
        value = (model.flat(weights), np.arange(5000) % model.CLASSES, "<u2")

    rows = [np.arange(n, dtype="<u2") for n in (1, 19, 20, 21, 1000, 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7, 13)), pa.array([r.tobytes() for r in rows])], names=["row", "ids"])
    out = [b for turn in range(3) for b in language_model._learn(State, turn, 3)([batch])]
    assert sum(b.column(0)[0].as_py() for b in out) == sum(map(len, rows))


def shingles(text, k):
    found = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(found[i:i + k]) for i in range(len(found) - k + 1)) if len(found) >= k else frozenset([tuple(found)] if found else [])


@pytest.mark.parametrize("k,percent,often,long", [(3, 90, 64, 1000), (5, 80, 0, 1000), (3, 90, 0, 100)])
def test_join(docs, nothing, k, percent, often, long, monkeypatch):
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    monkeypatch.setattr(ngram_join, "LONG", long)
    sets = [(i, shingles(t, k)) for i, t in TEXTS]
    group = list(range(len(sets)))

    def top(a):
        while group[a] != a:
            a = group[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                group[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[top(a)] = min(i, least.get(top(a), i))
    want = Counter((i, len(s), least.get(top(a))) for a, (i, s) in enumerate(sets))
    assert by_row(ngram_join.linked(docs, k, percent), "doc_id", "n_shingles", "component_id") == want
    if k == 5:
        assert ngram_join.linked(nothing, k, percent).count() == 0


def test_keep_one_leaves_one_of_a_group(docs):
    ids = [r["doc_id"] for r in ngram_join.keep_one(docs, 5, 80).select("doc_id").collect()]
    assert ids.count(5) == 1 and 6 not in ids and {1, 2, 3, 4, 9, 11, 12} <= set(ids)


def test_contamination(spark, docs, nothing):
    words = LONG.split()
    items = [(1, " ".join(words[50:90])), (2, None), (3, "nothing of this is there at all, honestly"), (4, "one two"),
             (5, " ".join(words[100:130] + ["changed"] + words[131:160]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench).collect()}

    def counts(found):
        k = min(5, len(found))
        return Counter(tuple(found[i:i + k]) for i in range(len(found) - k + 1))

    split = lambda t: [w for w in re.split(decontaminate.SEPARATORS, (t or "").lower()) if w]
    want = {}
    for i, t in TEXTS:
        found = split(t)
        for item, text in items:
            mine = split(text)
            if not mine:
                continue
            best = 0
            for s in range(max(1, len(found) - len(mine) + 1)):
                a, b = counts(found[s:s + len(mine)]), counts(mine)
                if len(found[s:s + len(mine)]) >= min(5, len(mine)):
                    best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                want[i, item] = round(best, 6)
    assert got == want and len(want) > 4
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and not {5, 6, 4} & {r["doc_id"] for r in left.select("doc_id").collect()}
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_contamination_of_cut_passages(spark):
    """Passages cut at their end: followed by a run of one word, or by the end of the text."""
    words = lambda name, n: [f"{name}w{j}" for j in range(n)]
    items = [(i, words(f"a{i}", 100)) for i in range(60)] + [(i, words(f"b{i}", 9)) for i in range(100, 500)]
    texts = [(i, w[:90] + ["so"] * 40 if i < 100 else w[:8]) for i, w in items]
    rows = lambda pairs: [(i, " ".join(w)) for i, w in pairs]
    found = decontaminate.contaminated(spark.createDataFrame(rows(texts), "doc_id long, text string"),
                                       spark.createDataFrame(rows(items), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in found.collect()}
    assert got == {(i, i, 0.811321 if i < 100 else 0.8) for i, _ in items}


def brute_pii(text):
    out = [(m.start(), m.end(), "email") for m in pii.EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in pii.PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii(docs, nothing):
    want = {i: brute_pii(t or "") for i, t in TEXTS}
    for r in pii.pii_spans(docs).collect():
        assert [tuple(s) for s in r["base"]] == want[r["doc_id"]]
        assert set(want[r["doc_id"]]) <= {tuple(s) for s in r["spans"]}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[11].endswith("mail [EMAIL] or [PHONE]") and clean[1] is None
    assert pii.pii_spans(nothing).count() == 0


def test_pii_patterns_on_odd_texts():
    import random
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("12.@ab-+ ()é") for _ in range(rng.randint(0, 30)))
        base = sorted(pii.base_spans(text), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert base == brute_pii(text), text


def test_field_finds_held_out_formats():
    import random
    rng, weights, hit, told, true = random.Random(99), pii.train(), 0, 0, 0
    for _ in range(300):
        text, spans = pii._made(rng)
        found = set(pii.find_spans(text, weights)[1])
        hit, told, true = hit + len(found & set(spans)), told + len(found), true + len(spans)
    assert hit / true > 0.85 and hit / told > 0.85


def test_field_finds_joined_and_late_spans():
    weights = pii.train()
    for before, value, after, kind in [
            ("SSN:", "123-45-6789", "", "ssn"), ("IBAN:", "DE89370400440532013000", "", "iban"), ("dob:", "1980-01-02", "", "birth"),
            ("ssn (", "123-45-6789", ")", "ssn"), ("iban ", "GB29 NWBK 6016 1331 9268 19", " paid", "iban"),
            ("mac ", "0a:bb:cc:dd:ee:f1", "", "mac"), ("call ", "(030) 1234-5678", "", "phone")]:
        assert (len(before), len(before) + len(value), kind) in pii.find_spans(before + value + after, weights)[1], value
    for n in range(58, 70):
        text = "7, " * n + "iban DE89 3704 0044 0532 0130 00 and"
        assert (3 * n + 5, 3 * n + 32, "iban") in pii.find_spans(text, weights)[1], n


def test_marks_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        x, y = (rng.choice(pool, rng.integers(1, 250), replace=False) for _ in range(2))
        assert ngram_join.most_shared(ngram_join.mark_of(x), ngram_join.mark_of(y)) >= len(np.intersect1d(x, y))
    many = np.arange(1, 5000, dtype=np.uint64) << np.uint64(40)  # all in one bucket: beyond what a count holds
    assert ngram_join.most_shared(ngram_join.mark_of(many), ngram_join.mark_of(many)) >= len(many)
