"""Edge cases, brute-force versions and held-out accuracy of the corpus operators, on small tables."""

import hashlib
import json
import os
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankfile.llm import decontaminate, extract, jaccard, language, pieces, pii, quality, registry, repeats, toxicity, vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2


def docs(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # columns whose names clash with the operators' own
    return df.withColumns({c: F.lit(1) for c in ("a", "b", "n", "score", "component_id", "kind")}) if more.get("clash") else df


ODD = [None, "", " \n\t ", "x", BASE, BASE, "word " * 30_000, "é ▁ \U0001f600 a@b.co", "!!!", "1.2.3.4 +1 (555) 010-9999"]


def test_components_small(spark):
    from rankfile.llm.common import components

    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 8), (2, 2)], "a long, b long")
    assert {r.node: r.component_id for r in components(e).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 2: 2}
    assert components(e.limit(0)).count() == 0


@pytest.mark.parametrize("together", [500_000, 0])
def test_components_chains_and_stars(spark, together):
    from rankfile.llm.common import components

    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2600, (300, 2))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    order = rng.permutation(len(edges))
    e = spark.createDataFrame([edges[k][:: 1 if k % 2 else -1] for k in order], "a long, b long").repartition(16)
    assert {r.node: r.component_id for r in components(e, together=together).collect()} == {x: find(x) for x in list(parent)}


# language
def test_language_learns_switches(spark):
    en, de = "the quick house water thing with weather ", "der schnelle straße wasser über nicht schön "
    rows = [(i, (en if i % 2 else de) * 8, "en" if i % 2 else "de") for i in range(40)]
    model = language.train(rows)
    d = docs(spark, [en * 5, de * 5, None, "123 !!", en * 6 + de * 3, ""], clash=True)
    got = {r.doc_id: r for r in language.identify(d, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "und", "und", "en", "und"]
    assert got[4].n_switches >= 1
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(d.limit(0), model).count() == 0


def test_texts_without_letters_are_undetermined(spark):
    en, de = "the quick house water thing with weather ", "der schnelle straße wasser über nicht schön "
    model = language.train([(i, (en if i % 2 else de) * 8, "en" if i % 2 else "de") for i in range(40)])
    texts = ["\U0001f600 \U0001f600 \U0001f600", "\U0001f44d\U0001f3fd", "\U0001f680\U0001f680 12", "12 !! ٣", "\U0001d49c", "\U0001f600 " * 50 + de, de, de]
    got = [r for r in sorted(language.identify(docs(spark, texts), model).collect(), key=lambda r: r.doc_id)]
    assert [r.lang_pred for r in got[:4]] == ["und"] * 4 and [r.score for r in got[:4]] == [0.0] * 4
    assert got[4].lang_pred in ("de", "en")  # a letter beyond the basic plane
    assert got[5].lang_pred == "de" and got[5].score == pytest.approx(got[6].score) == pytest.approx(got[7].score)  # rows alike, and emoji that say nothing


def test_marginals_against_plain_forward_backward():
    rng = np.random.default_rng(1)
    e, offsets, t = rng.normal(size=(300, 3)), np.array([0, 1, 1, 60, 120, 300]), rng.normal(size=(3, 3))
    got = language.chain_marginals(e, offsets, t)
    for a, b in zip(offsets[:-1], offsets[1:]):
        x, fw = np.ones(3), []
        for i in range(a, b):
            x = (x @ np.exp(t)) * np.exp(e[i])
            x /= x.sum()
            fw.append(x)
        y = np.ones(3)
        for i in range(b - 1, a - 1, -1):
            m = fw[i - a] * y
            assert np.allclose(got[i], m / m.sum())
            y = np.exp(t) @ (np.exp(e[i]) * y)
            y /= y.sum()


@needs_tables
def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = language.op1_language(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in r) >= 0.9 * len(r)


# extraction
PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, ok?</div><article><h1>Head &amp; line</h1><p>First  para, with <b>bold</b>, <a href=x>link</a>,\n and more text to read.<p>Second one &copy; 2020 &#233;
<aside>related</aside><div id="comments"><p>A reader says something long, really, quite long indeed.</p></div></article><div class="sidebar"><p>Side text, with commas, and, more, of them, to score</p></div><form><p>Sign up, now, please, do it</p></form><footer>foot</footer>"""


def test_extract(spark):
    assert extract.main_text(PAGE) == "Head & line\nFirst para, with bold, link, and more text to read.\nSecond one © 2020 é"
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "v", "plain <b text"), (5, "w", "<div>" * 3000 + "deep"), (6, "x", "<p><b>T<br><p>x &am")]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[2].text == got[3].text == ""
    assert got[5].text == "deep"
    assert got[6].text == "T\nx &am"
    assert all(r.n_chars == len(r.text) for r in got.values())


PARAGRAPH = "<p>Some long paragraph, with commas, that goes on and on for the reader of it.</p>"


SENTENCE = "Some long paragraph, with commas, that goes on and on for the reader of it."


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f"<div style='overflow:hidden'>{PARAGRAPH * 3}</div>", 3),
        (f"<p style='overflow: hidden; color:red'>{SENTENCE}</p>{PARAGRAPH}", 2),
        (f"<p title='the hidden truth'>{SENTENCE}</p>{PARAGRAPH}", 2),
        (f"<p data-id='menu' data-role=nav>{SENTENCE}</p>{PARAGRAPH}", 2),
        (f"<p hidden>{SENTENCE}</p><p aria-hidden='true'>{SENTENCE}</p>{PARAGRAPH * 2}", 2),
        (f"<div style='display:none'><p>{SENTENCE}</p></div><div>{PARAGRAPH * 3}</div>", 3),
        (f"<div style='display: none'>{PARAGRAPH * 3}</div>", 3),  # shown by script: it holds the whole page
        (f"<div class=page><div class=s1>{PARAGRAPH * 4}</div><div class=s2><h2>Two</h2><p>A short one, here.</p></div></div>", 6),
        (f"<div class=a><article>{PARAGRAPH * 3}</article></div><div class=b><article><h2>B</h2>{PARAGRAPH * 2}</article></div>", 6),
        (f"<div><div>{PARAGRAPH * 4}</div><div><h3>More</h3><ul><li><a href=1>one, long link text that goes on</a></li></ul></div></div>", 4),
    ],
)
def test_attributes_and_sections(page, lines):
    assert len(extract.main_text(page).split("\n")) == lines


def test_extract_repeated_rows_and_empty_table(spark):
    d = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (1, "u", None)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in extract.extract(d).collect()) == sorted([len(extract.main_text(PAGE))] * 2 + [0])
    assert extract.extract(d.limit(0)).count() == 0


@pytest.mark.parametrize("wrap", ["<div class='layout no-sidebar'>", "<div id=post-with-comments>", "<div class='content has-ads'>", "<form id=aspnetForm>", "<section class='has-related'>", "<div class='single-post comments-open'>"])
def test_extract_wrappers_with_furniture_words(wrap):
    page = f"<body><nav>x</nav>{wrap}<h1>T</h1>{PARAGRAPH * 3}<div class='comments-area'>{PARAGRAPH * 9}</div>"
    assert extract.main_text(page) == "\n".join(["T", *[PARAGRAPH[3:-4]] * 3])


def test_extract_keeps_furniture_out():
    assert extract.main_text(f"<article>a</article><div class=ad>{PARAGRAPH * 3}</div>") == "a"
    assert extract.main_text(f"<div class='user-comments comments'>{PARAGRAPH * 4}</div>") == ""
    assert extract.main_text(f"<div id=site-footer>{PARAGRAPH[3:-4]}</div>") == ""


@pytest.mark.parametrize("piece", ["<div>", "<p><div>", "<li><ul>", "<td><th>", "<i><p>", "</x><span>"])
def test_extract_deep_nesting(piece):
    began = time.process_time()
    assert extract.main_text(piece * 100_000 + "deep text") == "deep text"
    assert time.process_time() - began < 20


def test_extract_without_article():
    body = "<div id=content><h2>Title</h2>" + "<p>Some long paragraph, with commas, that goes on and on for the reader of it.</p>" * 4 + "</div>"
    page = f"<body><div class=menu><a href=1>one</a> <a href=2>two</a></div>{body}<div><a href=a>many</a> <a href=b>links</a></div></body>"
    assert extract.main_text(page).split("\n")[0] == "Title"
    assert "links" not in extract.main_text(page)


# pieces
def vocabulary():
    words = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "é", "\n", "▁▁", "▁▁▁", "▁▁▁a"]
    table = ["<unk>", *words, *[""] * 256]
    return pieces.model(table, [0.0, *[-float(i) for i in range(len(words))], *[0.0] * 256], list(range(len(words) + 1, len(words) + 257)))


def test_pieces_round_trip_and_reproducible(spark):
    v = vocabulary()
    texts = [*ODD, "  lead", "abab\nab  ", "a" * 5000, "   ", "a   b     ab  ", " " * 3000 + "a", "a\u2581 b"]
    d = docs(spark, texts, clash=True)
    one = {r.doc_id: r for r in pieces.encode(d, v, alpha=0.1).collect()}
    two = {r.doc_id: r for r in pieces.encode(d.repartition(7), v, alpha=0.1).collect()}
    assert {k: r.ids for k, r in one.items()} == {k: r.ids for k, r in two.items()}
    assert all(r.lossless for r in one.values())
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(d, v, alpha=0.1), v).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert one[0].ids is None
    assert one[1].ids == []
    assert pieces.encode(d.limit(0), v).count() == 0


def test_pieces_lattices_are_built_in_parts(monkeypatch):
    monkeypatch.setattr(pieces, "PART", 50)
    lattice, sizes = pieces.Lattice(vocabulary(), 0.1), []
    monkeypatch.setattr(lattice, "add", lambda units, f=lattice.add: (sizes.append(sum(map(len, units))), f(units))[1])
    texts = pa.array([" ".join(f"ab{k}" for k in range(200)), "a" * 300, "", "ab1"])
    ids, offsets = pieces.sample(texts, np.arange(4), lattice, 17)
    assert len(sizes) > 10 and sorted(sizes)[-2] <= 100
    many = len(sizes)
    again, _ = pieces.sample(texts, np.arange(4), lattice, 17)  # nothing new
    assert len(sizes) == many and (again == ids).all()
    spell = pieces.piece_bytes(vocabulary())
    assert [pieces.decode_ids(ids[a:b].tolist(), spell) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == texts.to_pylist()


@pytest.mark.parametrize("text", ["aba", "  a", "   ", "a  b"])
def test_pieces_distribution(text):
    v, alpha, n = vocabulary(), 0.3, 40_000
    index = {p: i for i, p in enumerate(v["pieces"]) if p}

    def splits(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in index:
                for rest, z in splits(s[k:]):
                    yield (index[s[:k]], *rest), z + alpha * v["scores"][index[s[:k]]]

    every = list(splits("▁" + text.replace(" ", "▁")))
    total = sum(np.exp(z) for _, z in every)
    ids, at = pieces.sample(pa.array([text] * n), np.arange(n), pieces.Lattice(v, alpha), 5)
    seen = {}
    for x, y in zip(at[:-1], at[1:]):
        seen[tuple(ids[x:y].tolist())] = seen.get(tuple(ids[x:y].tolist()), 0) + 1
    assert max(abs(seen.get(s, 0) / n - np.exp(z) / total) for s, z in every) < 0.01


# toxicity
def test_toxicity_counterfactual(spark):
    bad, plain_ = "you are an idiot and trash moron ", "the weather is nice and calm today "
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 600, 40)) + " " + (bad if i % 2 else ""), i % 2) for i in range(120)]
    model = toxicity.train(rows, 0.5, least=4)
    d = docs(spark, [plain_, bad, plain_ + "women and muslims", plain_ + "men and christians", None, ""], clash=True)
    s = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert s[1] > 0.5 > max(s[0], s[2], s[3])
    assert abs(s[2] - s[3]) < 0.05
    assert s[4] == s[5]
    assert toxicity.score(d.limit(0), model).count() == 0
    assert toxicity.train([], 0.0)["b"] < 0


def test_toxicity_sample_rows():
    text = " ".join(f"w{chr(97 + k)}" for k in range(20))
    rows = [(1, text, 1), (2, text + " wz", 1), (3, text, 0), (4, "wa wb wc other words here", 1), (5, "", 1), (6, "", 1)]
    assert [r[0] for r in toxicity.distinct_rows(rows)] == [1, 3, 4, 5]


def test_toxicity_counterfactuals_of_late_sentences(spark, monkeypatch):
    seen = []
    plain_ = toxicity.counterfactuals
    monkeypatch.setattr(toxicity, "counterfactuals", lambda s, v: (seen.extend(s), plain_(s, v))[1])
    toxicity.train([(1, "one. two. three. four. five. women six.", 1), (2, "a.", 0)], 0.5, least=1)
    assert ["women", "six"] in seen


def test_labelled_sample_takes_all_labels(spark):
    from rankfile.llm.common import labelled_sample

    d = docs(spark, [f"t{i}" for i in range(300)])
    labels = spark.createDataFrame([(i, f"l{i % 100:02d}") for i in range(300)] + [(0, "zz"), (None, "l00"), (7, None)], "doc_id long, y string")
    rows = labelled_sample(d, labels, "y", 202, 1000)
    assert {r[2] for r in rows} == {f"l{k:02d}" for k in range(100)}
    assert len(rows) == 200
    assert labelled_sample(d, labels, "y", 1, 1) == []


# quality
def test_quality_ties_go_to_the_lower_row():
    cos = np.array([[0.5, 0.9, 0.9, -0.2, 0.9, 0.5], [-0.1, -0.1, -0.3, -0.1, -0.5, -0.1]], np.float32)
    assert [sorted(r) for r in quality.nearest(cos, 2).tolist()] == [[1, 2], [0, 1]]
    assert [sorted(r) for r in quality.nearest(cos, 4).tolist()] == [[0, 1, 2, 4], [0, 1, 3, 5]]


def test_quality_shapes_and_words():
    same = [("Hello", "World"), ("USA", "EU"), ("abc", "é"), ("a1", "bcd22"), ("1.50", "22.7"), ("x!!!", "abc!"), ("aB", "iPhone"), ("Äb", "Cd"), ("A" * 61, "!" * 70)]
    unlike = [("Hello", "hello"), ("USA", "Usa"), ("a1", "1a"), ("x!", "x?"), ("x!", "x"), ("a-b", "a_b")]
    word = lambda t: quality.terms(pa.array([t]))[0].tolist()
    assert all(word(a)[0] == word(b)[0] for a, b in same)
    assert all(word(a)[0] != word(b)[0] for a, b in unlike)
    assert word("The,")[1] == word("the")[1] != word("a")[1]
    assert word("house")[1] == word("MOUSE!")[1] == quality.LENGTHS[1]
    assert word("x" * 61) == quality.LONG_TERMS.tolist()


def test_quality_many_short_texts_in_bounded_memory():
    texts = pa.array(["ab cd"] * 10_000)
    parts = list(quality.slices(pa.record_batch([texts], ["text"]), "text", rows=quality.BLOCK))
    assert max(len(p) for p in parts) == quality.BLOCK and sum(len(p) for p in parts) == 10_000
    assert quality.counts(parts[0].column("text")).shape == (quality.BLOCK, quality.SIZE)


def test_quality_votes(spark):
    good, junk = "The cat sat on the mat and looked at the door. ", "BUY!! NOW!! CHEAP!! "
    rows = [(i, (good if i % 2 else junk) * (3 + i % 5), i % 2) for i in range(40)]
    d = docs(spark, [r[1] for r in rows] + [None, "", good * 4, junk * 4], clash=True)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.fit(d, labels)
    s = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert s[42] > 0.5 > s[43]
    assert s[40] == s[41]
    kept = quality.keep(d, model)
    assert kept.columns == d.columns
    assert not {43} & {r.doc_id for r in kept.collect()}
    assert {r.score for r in quality.score(d, quality.fit(d, labels.limit(0))).collect()} == {0.0}


# personal data
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_base(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in pii.CARD.finditer(t) if 16 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    return out + [(3, *m.span()) for m in pii.PHONE.finditer(t) if 8 <= len(pii.digits(m[0])) <= 15]


def test_pii_base_and_skip_chain(spark):
    tricky = ["a@b.c@d.e f@g", "@a.b x@y.z@", "x@a..b.c ..@q.r", "1.2.3.4.5 300.1.1.1 01.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999, +1 2", None, "", "é" * 30 + "me@x.org"]
    tricky.append("Call +1 (555) 010-9999 today. " + "word " * 50 + "again 1 555 010 9999; order 1234567890.")
    d = docs(spark, tricky, clash=True)
    model = pii.train([f"call +1 (555) 010-{k:04d} or write a{k}@b.org, item {k}{k}{k}1234567" for k in range(1000, 1200)])
    got = {r.doc_id: r for r in pii.detect(d, model).collect()}
    for i, t in enumerate(tricky):
        assert got[i].base_sha256 == hashlib.sha256(pii.written(plain_base(t or "")).encode()).hexdigest()
    assert got[9].n_phone == 1
    assert got[9].n_added == 1
    assert "1234567890" not in [tricky[9][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[9].spans.split(",")]
    red = {r.doc_id: r for r in pii.redacted(d, model).collect()}
    assert red[9].text.count("[PHONE]") == 2
    assert red[8].text == "é" * 30 + "[EMAIL]"
    assert red[9].n_chars == len(red[9].text)
    assert red[6].text is None
    assert pii.detect(d.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 50])
@pytest.mark.parametrize("gap", [2, 50])
@pytest.mark.parametrize("first", [True, False])
def test_pii_every_bare_repeat(n, gap, first):
    model = pii.train([f"call +1 (555) 010-{k:04d} or write a{k}@b.org, item {k}{k}{k}1234567" for k in range(1000, 1200)])
    model["w"][0, pii.OTHER] += 50.0  # every bare shape speaks as strongly against a span as it may
    base, bare = "Call +1 (555) 010-9999 today. ", ("word " * gap + "again 1 555 010 9999; ") * n
    order = "word " * 50 + "order 1234567890."
    text = base + bare + order if first else bare + base + order
    ((spans, added),) = pii.find([text], [True], model)
    assert len(spans) == 1
    assert [text[a:b] for _, a, b in added] == ["1 555 010 9999"] * n


def test_pii_repeat_glued_to_another_number():
    model = pii.train([])
    text = "Paid with 4111 1111 1111 1111 then. Numbers 7536784127813050 4111111111111111 in a row."
    ((spans, added),) = pii.find([text], [True], model)
    assert [text[a:b] for _, a, b in spans] == ["4111 1111 1111 1111"]
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [("card", "4111111111111111")]


def test_pii_messages_against_enumeration():
    rng = np.random.default_rng(6)
    for edges in ([(0, 1, 0), (1, 2, 1), (1, 3, 0)], [(0, 1, 0), (1, 2, 0), (2, 3, 1)], [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1)]):
        node, ties = rng.normal(size=(4, 3)), 0.5 * rng.normal(size=(2, 3, 3))
        weight = {}
        for y in np.ndindex(3, 3, 3, 3):
            weight[y] = np.exp(sum(node[i, y[i]] for i in range(4)) + sum(ties[k, y[a], y[b]] for a, b, k in edges))
        total = sum(weight.values())
        true = np.array([[sum(v for y, v in weight.items() if y[i] == j) / total for j in range(3)] for i in range(4)])
        passing = pii.Messages(np.array(edges), 3)
        got = passing.settle(node, ties)
        # exact on trees, near on the loop
        assert np.abs(got - true).max() < (1e-4 if len(edges) == 3 else 0.05)
        if len(edges) == 3:
            for (a, b, _), pair in zip(edges, passing.pairs(node, ties)):
                plain_ = np.array([[sum(v for y, v in weight.items() if (y[a], y[b]) == (i, j)) / total for j in range(3)] for i in range(3)])
                assert np.abs(pair - plain_).max() < 1e-4


def test_pii_recovers_hidden_mentions():
    rng = np.random.default_rng(2)
    line = lambda k: f"order {rng.integers(10**8, 10**9)} for +1 (555) 0{rng.integers(10, 99)}-{rng.integers(1000, 9999)} or u{k}@mail{k % 7}.org from 10.0.{k % 250}.7, ref {rng.integers(10**9, 10**10)}"
    texts = [line(k) for k in range(400)]
    got = pii.recovery(texts[300:], pii.train(texts[:300]))
    assert got["repeats"] > 50
    assert got["found"] >= 0.9 * got["repeats"]
    assert got["right"] >= 0.95 * got["given"]


def test_pii_time_is_linear():
    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000 + " @ 1234567", "1@" * 100_000, "+1((" * 100_000, "x@" + "a" * 400_000):
        began = time.process_time()
        pii.find([text], [True], pii.train([]))
        assert time.process_time() - began < 10


# decontamination
def test_decontamination(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    common = [word() for _ in range(20)]
    text = lambda n: " ".join(str(rng.choice(common)) if rng.random() < 0.4 else word() for _ in range(n))
    items = [text(30) for _ in range(12)]
    changed = items[1].split()
    changed[3], changed[17] = "zzz", "yyy"
    texts = [text(200) for _ in range(40)] + [text(60) + " " + items[0].upper() + ", " + text(60), text(90) + " " + " ".join(changed) + " " + text(10), items[2], None, "", " ".join(items[3].split()[:9]) + " " + text(50)]
    d = docs(spark, texts, clash=True)
    b = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    assert {k for k, r in got.items() if r.leaked} == {40, 41, 42}
    assert got[40].item_ids == [0]
    kept = decontaminate.drop_leaks(d, b)
    assert kept.count() == len(texts) - 3
    assert kept.columns == d.columns
    assert decontaminate.decontaminate(d, b.limit(0)).where("leaked").count() == 0


def test_decontamination_many_items(spark):
    rng = np.random.default_rng(3)
    common = np.array([f"w{k}" for k in range(4000)])
    items = [" ".join(rng.choice(common, 24)) for _ in range(600)]
    d = docs(spark, [" ".join(rng.choice(common, 200)) for _ in range(20)])
    # as many passages to a dimension as a benchmark of thousands of items has with the usual rank
    m = decontaminate.fit(d, list(enumerate(items)), rank=16)
    found = decontaminate.search(pa.array(items), m, decontaminate.Ids(m["vocabulary"]), 0.36, 0.7)
    assert all(i in {k for k, _ in x} for i, x in enumerate(found))


def test_decontamination_blocks_keep_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASSAGES", 3)
    rng = np.random.default_rng(5)
    items = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 26)) for _ in range(9)]
    rows = [(1, items[0]), (1, items[4]), (1, "nothing here"), (None, items[7]), (None, None), (2, f"{items[2]} and then {items[8]}"), (2, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_ids) for r in decontaminate.decontaminate(d, b).collect())
    assert got == [(0, []), (0, [7]), (1, []), (1, [0]), (1, [4]), (2, []), (2, [2, 8])]


@pytest.mark.parametrize("together", [16, 1])
def test_decontamination_reads_the_corpus_once_for_all_blocks(spark, monkeypatch, together):
    monkeypatch.setattr(decontaminate, "PASSAGES", 3)
    monkeypatch.setattr(decontaminate, "TOGETHER", together)
    calls = []
    for name in ("frequencies", "passage_rows"):
        monkeypatch.setattr(decontaminate, name, lambda *a, f=getattr(decontaminate, name), n=name, **k: (calls.append(n), f(*a, **k))[1])
    items = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(12)]
    d = docs(spark, [f"before {t} after" for _, t in items] + ["nothing at all of it", None, items[2][1] + " and " + items[9][1]], clash=True)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(d, b).collect()}
    assert got == {**{k: [k] for k in range(12)}, 12: [], 13: [], 14: [2, 9]}
    assert calls == ["frequencies", "passage_rows"]
    assert {r.doc_id for r in decontaminate.drop_leaks(d, b).collect()} == {12, 13}


def test_decontamination_counts_every_window_of_every_document(spark, monkeypatch):
    """More documents than the 500 that were once sampled, long ones too; the products are those of all windows' TF-IDF rows."""
    monkeypatch.setattr(decontaminate, "PAIRS", 500)  # tasks empty what they hold many times
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 600, int(rng.integers(0, 60)))) for _ in range(700)] + [" ".join(f"w{k}" for k in rng.integers(0, 600, 5000)), None, ""]
    items = [" ".join(f"w{k}" for k in range(a, a + 20)) for a in range(0, 400, 20)]
    known = decontaminate.corpus(docs(spark, texts, clash=True), items)
    ids = {w: i for i, w in enumerate(known["vocabulary"])}
    rows, df = [], np.zeros(len(ids))
    for t in texts:
        words = (t or "").split()
        for w in set(words) & set(ids):
            df[ids[w]] += 1
        for a in range(0, max(1, len(words) - 12), 12) if words else []:
            rows.append(np.bincount([ids[w] for w in words[a : a + 24] if w in ids], minlength=len(ids)))
    assert (known["df"] == df).all() and known["total"] == len(texts)
    idf, q = rng.random(len(ids)) + 0.5, rng.random((len(ids), 7))
    x = np.array(rows) * idf
    got = decontaminate.gram_product(known, idf, q, np.arange(len(ids)))
    assert np.allclose(got, x.T @ (x @ q) / (np.array(rows).sum(axis=0) * idf**2).sum())
    # a block of some of the words, in another order
    own, some = np.full(len(ids), -1), rng.permutation(len(ids))[:150]
    own[some] = np.arange(150)
    got = decontaminate.gram_product(known, idf[some], q[some], own)
    assert np.allclose(got, x[:, some].T @ (x[:, some] @ q[some]) / (np.array(rows)[:, some].sum(axis=0) * idf[some] ** 2).sum())


def test_decontamination_products_shuffle_no_partial_rows(spark, monkeypatch):
    """A row of the product comes once, from the task that holds all its counts, whatever the number of partitions."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 700, 60)) for _ in range(40)]
    known = decontaminate.corpus(docs(spark, texts), [" ".join(f"w{k}" for k in range(700))])
    assert decontaminate.Tiles(700).across == 3
    frame, seen = type(known["pairs"]), []

    def collect(df, f=frame.collect):
        rows = f(df)
        seen.append((df._jdf.queryExecution().executedPlan().toString(), rows))
        return rows

    monkeypatch.setattr(frame, "collect", collect)
    decontaminate.gram_product(known, np.ones(700), rng.random((700, 3)), np.arange(700))
    ((plan, rows),) = seen
    assert "Exchange" not in plan
    words = np.concatenate([np.frombuffer(r["own"], np.int64) for r in rows])
    assert len(words) == len(set(words.tolist())) > 650


def test_decontamination_counts_take_few_bytes():
    rng = np.random.default_rng(4)
    for top in (200, 60_000, 1 << 40):
        code = np.unique(rng.integers(0, 65_536, 5000))
        n = np.append(rng.integers(1, 9, len(code) - 1), top)
        for got, x in zip(decontaminate.unpacked(decontaminate.packed(code, n)), (code, n), strict=True):
            assert got.dtype == np.int64 and (got == x).all()
    assert len(decontaminate.packed(code, np.ones(len(code), np.int64))) < 3 * len(code)
    assert [len(x) for x in decontaminate.unpacked(decontaminate.packed(code[:0], code[:0]))] == [0, 0]


def test_decontamination_window_of_a_repeated_word():
    # one benchmark word three times among 21 others: the cosine reaches the threshold only since repeats count squared
    items = ["alpha beta gamma delta", *[f"x{k} y{k} z{k}" for k in range(6)]]
    words = [x.split() for x in items]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in words for w in x))}
    idf = np.full(len(vocabulary), 1.0)
    m = {"vocabulary": vocabulary, "idf": idf, "other": 1.5, "v": np.eye(len(vocabulary), dtype=np.float32), "latent": np.zeros((1, len(vocabulary)), np.float32), "owner": np.zeros(1, np.int64), "words": [[0]], "answers": [[0]], "items": [5]}
    m["latent"][0, 0] = 1.0
    text = " ".join(["alpha"] * 3 + [f"o{k}" for k in range(21)])
    assert 9 / (9 + 21 * 2.25) > 0.36**2 > 3 / (3 + 21 * 2.25)
    assert decontaminate.search(pa.array([text]), m, decontaminate.Ids(vocabulary), 0.36, 0.7) == [[(0, 1.0)]]


def test_sparse_rows_are_a_matrix():
    rng = np.random.default_rng(1)
    x = (rng.random((30, 50)) < 0.1) * rng.random((30, 50))
    x[np.arange(30), np.arange(30)] = 1.0
    own, col = np.nonzero(x)
    s = decontaminate.Sparse(own, col, x[own, col], x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, y = rng.random((50, 200)), rng.random((30, 7))
    assert np.allclose(s.times(q), x @ q) and np.allclose(s.back(y), x.T @ y)
    some = np.arange(30) % 4 == 1
    assert np.allclose(s.rows(some), x[some])


def test_common_subsequence():
    def slow(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(4)
    for _ in range(50):
        x, y = rng.integers(0, 6, 20).tolist(), rng.integers(0, 6, 35).tolist()
        assert decontaminate.common_subsequence(x, y) == slow(x, y)


# vectors
def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.repeat(base, 6, 0) + rng.normal(size=(360, 16)) * rng.uniform(0.05, 0.5, size=(360, 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400 + k, [float(v) for v in x[0]]) for k in range(70)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0, 2.0]), (504, [2.0, 4.0]), (505, [2.0 * v for v in rows[5][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).withColumn("copies", F.lit(1))
    got = {r.vec_id: r for r in vectors.near_duplicates(df, shard=60).collect()}
    ids = [i for i, v in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    m = np.array([v for i, v in rows if i in set(ids)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    true = m @ m.T >= 0.9
    np.fill_diagonal(true, False)
    found = np.array([got[i].n_links for i in ids])
    assert (found <= true.sum(axis=1)).all()
    assert found.sum() >= 0.95 * true.sum()
    assert got[503].n_links == got[504].n_links == 1
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (500, 501, 502))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vectors.audit(df, vectors.near_duplicates(df, shard=60)).first().recall >= 0.9
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_block_of_large_groups():
    rng = np.random.default_rng(7)
    x = unit_rows(np.repeat(unit_rows(rng.normal(size=(5, 64))), 120, 0) + 0.02 * rng.normal(size=(600, 64)))
    a, b = vectors.search_block(np.arange(600), x, np.ones(600, bool), vectors.LEAST)
    group = np.arange(600)
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert x[i] @ x[j] >= vectors.LEAST
        group[group == group[i]] = group[j]
    # the links span each of the five groups, and the exact count within groups has all pairs
    assert len(a) == 5 * 119 and len(np.unique(group)) == 5
    rows = pa.table({"grp": group, "rep": np.arange(600), "second": np.zeros(600, bool), "across": np.zeros(600, bool), "copies": np.ones(600, np.int64), "p": [v.tobytes() for v in x]})
    assert vectors.group_links(vectors.LEAST)(rows).column("others").to_pylist() == [119] * 600


def test_vectors_hot_group_over_many_centres(spark):
    rng = np.random.default_rng(9)
    x = unit_rows(rng.normal(size=(3000, 64)))
    x[:1000] = unit_rows(0.955 * x[0] + np.sqrt(1 - 0.955**2) * x[:1000])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    result = vectors.near_duplicates(df, shard=120, group=300)
    got = np.array([r.n_links for r in result.orderBy("vec_id").collect()])
    true = (x @ x.T >= vectors.LEAST).sum(axis=1) - 1
    assert (got <= true).all() and got.sum() >= 0.999 * true.sum()
    assert vectors.audit(df, result).first().recall >= 0.999


# repeats
def slow_repeats(rows):
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[d] = (len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    parts = [word(int(rng.integers(20, 120))) for _ in range(9)]
    texts = ["".join(str(rng.choice(parts))[int(rng.integers(0, 10)) :] + word(int(rng.integers(0, 40))) for _ in range(5)) for _ in range(30)]
    texts += ["a" * 300, "a" * 120, "a" * 49, "", None, "ab" * 90, texts[0], BASE, BASE[7:]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, texts, clash=True)).collect()}
    assert got == slow_repeats([(i, t or "") for i, t in enumerate(texts)])
    assert repeats.remove_repeats(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [256, 0])
def test_repeats_of_common_phrases(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PIECE", 300)
    monkeypatch.setattr(repeats, "GROUP", 4000)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcd\0"), n))
    line, phrase = word(70), word(26)
    texts = [word(int(rng.integers(0, 60))) + line[int(rng.integers(0, 4)) :] + word(20) + phrase + word(12) + phrase * 2 + word(int(rng.integers(0, 30))) for _ in range(60)]
    texts += [texts[3]] * 5 + [texts[4] + "x" + texts[5], line, line[:50], line[:49], word(2000) * 2]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, texts).repartition(5)).collect()}
    assert got == slow_repeats(list(enumerate(texts)))


def test_repeats_ids(spark):
    long = "The same long text that is well over fifty bytes, with an end."
    rows = [(1, long), (1, long), (1, long + " more"), (2, long), (None, long), (None, None), (0, "short"), (3, "short"), (4, "x" + long + long)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    n = len(long)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id == 1) == [(n, 0, 0), (n, 0, 0), (n + 5, 0, 0)]
    assert [(r.n_removed, r.n_spans) for r in got if r.doc_id == 2] == [(n, 1)]
    assert [(r.n_removed, r.n_spans) for r in got if r.doc_id == 4] == [(2 * n, 1)]
    assert all(r.n_removed == 0 for r in got if r.doc_id in (None, 0, 3))


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(0)
    b = rng.integers(97, 99, (40, 12)).astype(np.uint8)
    b[20:30] = b[5]
    text = [x.tobytes() for x in b]
    order, shared = repeats.Suffixes(b).runs(np.array([15, 25]))
    for a, z in ((0, 15), (15, 40)):
        assert sorted(order[a:z]) == list(range(a, z))
        assert [text[i] for i in order[a:z]] == sorted(text[a:z])
        assert shared[a] == -1
        for k in range(a + 1, z):
            assert shared[k] == len(os.path.commonprefix([text[order[k - 1]], text[order[k]]]))


def test_suffix_sort_survives_hash_collisions():
    b = np.tile(np.arange(12, dtype=np.uint8), (6, 1))
    b[3, 7] = 99
    s = repeats.Suffixes(b)
    s.prefix[:] = 0  # every hash collides
    _, shared = s.runs(np.array([6]))
    assert sorted(shared.tolist()) == [-1, 7, 7, 12, 12, 12]


# Jaccard join
def slow_jaccard(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block", [4096, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for size in (3, 6, 20, 70, 90, 300, 700):
        for _ in range(4):
            base = [str(x) for x in rng.choice(words, size)]
            texts.append(" ".join(base))
            for edits in (0, 1, 2, size // 60, size // 45, size // 25):
                copy = list(base)
                for k in rng.integers(0, size, edits):
                    copy[k] = "X" + copy[k]
                texts.append(" ".join(copy).upper() if edits == 1 else "  ".join(copy) + "\n")
    d = docs(spark, texts, clash=True)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(d).collect()}
    assert got == slow_jaccard(texts)
    if block == 3:
        kept = {r.doc_id for r in jaccard.one_of_each(d).collect()}
        assert kept == {i for i, (_, c) in got.items() if i == c}
        assert jaccard.join(d.limit(0)).count() == 0


def test_jaccard_rest_of_a_group_is_no_square():
    """Members apart give a few rows each in a round, and all pairs over the rounds."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.append(base[1:], k + np.uint64(1))) for k in rng.integers(0, 2**63, 60).astype(np.uint64)]
    asks, n = [True] * 60 + [False] * 60, [len(x) for x in sets] * 2
    kind = {"g": pa.int64(), "i": pa.int32(), "j": pa.int32()}
    rows = {**{x: pa.array([1] * 120, t) for x, t in kind.items()}, "asks": asks, "short": [*range(60)] * 2, "n": n, "part": [*range(60)] * 2, "sketch": [jaccard.parity(x) for x in sets] * 2}
    found = []
    for k, (first, last) in enumerate(jaccard.ROUNDS):
        out = jaccard.rest_of(first, last)(pa.table(rows)).to_pylist()
        assert k > 0 or len(out) <= 3 * 60 + 1
        found += [(x["a"], x["b"]) for x in out if x["a"] is not None]
        assert any(x["a"] is None for x in out) == (last is not None and last < 60)
        if last is not None and last >= 60:
            break
    assert set(found) == {(a, b) for a in range(60) for b in range(a + 1, 60)}


def test_jaccard_rounds_lose_no_link(spark, monkeypatch):
    """Whoever finds no link among the nearest asks on."""
    monkeypatch.setattr(jaccard, "ROUNDS", ((0, 1), (1, 2), (2, 3), (3, None)))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(12)
    base, texts = [f"w{x}" for x in rng.integers(0, 300, 120)], []
    for _ in range(60):
        copy = list(base)
        for k in rng.choice(120, 3, replace=False):
            copy[k] = f"x{rng.integers(1000)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == slow_jaccard(texts)


def test_jaccard_short_documents_and_template(spark):
    rng = np.random.default_rng(2)
    line = " ".join(f"t{k}" for k in range(60))
    # one line in every document, chains of near copies without a common centre, short texts that differ in a mark
    texts = [f"{line} " + " ".join(map(str, rng.integers(0, 10**6, int(rng.integers(5, 90))))) for _ in range(150)]
    base = [f"c{k}" for k in range(200)]
    for step in range(40):
        base[5 * step : 5 * step + 2] = [f"x{step}", f"y{step}"]
        texts.append(" ".join(base))
    texts += ["a b c d", "a b c d .", "a b c d", "A", "a", "a a a a a a a", "a a a a a"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == slow_jaccard(texts)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert {r[0]: (r[1], r[2]) for r in con.execute(registry.OP10).fetchall()} == got


def test_jaccard_keys_meet():
    rng = np.random.default_rng(5)
    for frequency in (np.zeros(1 << jaccard.SLOTS, np.uint8), rng.integers(0, 255, 1 << jaccard.SLOTS).astype(np.uint8)):
        for n in [*range(1, 40), 64, 65, 80, 192, 193, 230, 240, 577, 700, 3000]:
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            most = 2 * len(a) // 9
            for drop, add in ((most, 0), (0, len(a) // 4), (most // 2, most // 2 * 4 // 5)):
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
                if jaccard.linked(a, b):
                    own, key = jaccard.signatures([a, b], frequency)
                    assert set(key[own == 0].tolist()) & set(key[own == 1].tolist())


def test_jaccard_empty_blocks_are_keys():
    # all elements in one block of the smallest band
    a = np.arange(1, 41, dtype=np.uint64)
    own, key = jaccard.signatures([a, a[1:], a[8:]], np.zeros(1 << jaccard.SLOTS, np.uint8))
    keys = [set(key[own == k].tolist()) for k in range(3)]
    assert keys[0] & keys[1] and keys[0] & keys[2]


def test_jaccard_repeated_ids(spark):
    other = " ".join(f"o{k}" for k in range(40))
    rows = [(1, BASE, 1), (1, BASE, 2), (1, other, 3), (2, BASE + " end", 4), (3, other, 5), (3, "lone words here", 6), (None, BASE, 7), (4, None, 8), (4, "", 9), (5, "five", 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = [(r.doc_id, r.component_id) for r in jaccard.join(d).collect()]
    assert (None, None) in got
    assert sorted(x for x in got if x[0]) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (3, 3), (4, 4), (4, 4), (5, 5)]
    kept = {r.row for r in jaccard.one_of_each(d).collect()}
    assert kept - {1, 2, 8, 9} == {3, 6, 7, 10}
    assert len(kept & {1, 2}) == len(kept & {8, 9}) == 1


def test_parity_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for n, m in ((10, 12), (300, 350), (100, 900)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, m).astype(np.uint64)]))
        assert jaccard.apart(jaccard.parity(a), jaccard.parity(b)) <= len(np.setxor1d(a, b))


# queries against SQL, and the pipeline
@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    q = con.execute(registry.ORACLE[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(json.dumps([r[c] for c in sorted(names)]) for r in df.collect()) == sorted(json.dumps([r[names.index(c)] for c in sorted(names)]) for r in q.fetchall())


def test_quality_fit_holds_its_matrix_once(spark, monkeypatch):
    """The driver of the pipeline holds one matrix of the labelled rows, not two."""
    import tracemalloc

    rows = [(k, f"word{k % 7} and some {'JUNK!! ' * (k % 5)} more", k % 2) for k in range(4000)]
    monkeypatch.setattr(quality, "labelled_sample", lambda *a: list(rows))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows[:50]], "doc_id long, quality int")
    d = docs(spark, [t for _, t, _ in rows[:50]])
    tracemalloc.start()
    try:
        model = quality.fit(d, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model["z"]) == 4000
    assert peak < 1.7 * 4000 * quality.SIZE * 4


@needs_tables
def test_pipeline(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, SF).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            assert d.columns == columns
            assert 0 < d.count() <= before
            before = d.count()
    assert d.count() == before
    assert d.where("not lossless").count() == 0


# brute-force versions of the queries that SQL does not express
def table_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@needs_tables
def test_extract_against_a_plain_reading_of_the_fixture(spark):
    """The fixture's pages hold one article of paragraphs; the text is read here with the library's parser of the language."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.blocks += [""] if tag in ("h1", "p", "article") else []
            self.blocks[-1] += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            self.blocks += [""] if tag in ("h1", "p", "article") else []

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    def plain_text(html):
        p = Plain()
        p.feed(html or "")
        p.close()
        return "\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)

    html = {r.page_id: r.html for r in table_of(spark, "pages").collect()}
    got = {r.page_id: r.text for r in registry.QUERIES["op2_html_tree"](spark, SF).collect()}
    assert got == {k: plain_text(v) for k, v in html.items()}


def test_quality_votes_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["The", "cat", "sat", "BUY!!", "now", "mat,", "a", "1.50", "http://x", "and", "of"]
    texts = [" ".join(rng.choice(vocabulary[k % 2 * 3 :], int(rng.integers(1, 60)))) for k in range(80)]
    texts += [texts[3], texts[3], "", None]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    m = quality.fit(d, labels, rank=6, neighbours=5)
    got = {r.doc_id: r.score for r in quality.score(d, m).collect()}
    for i, t in enumerate(texts):
        x = quality.weighted(quality.counts(pa.array([t], pa.string())), m["idf"])[0] @ m["v"]
        cos = [float(np.float32(x @ z / max(np.linalg.norm(x), 1e-12))) for z in m["z"]]
        near = sorted(range(len(cos)), key=lambda j: (-cos[j], j))[:5]
        w = [np.exp(12 * (cos[j] - 1)) * m["weight"][j] for j in near]
        assert abs(got[i] - (sum(a * m["y"][j] for a, j in zip(w, near)) + quality.PRIOR * m["share"]) / (sum(w) + quality.PRIOR)) < 1e-3


def test_toxicity_scores_against_a_plain_sum(spark):
    rows = [(k, ("awful nasty words here" if k % 2 else "good kind words there") + f" w{k % 9}", k % 2) for k in range(60)]
    m = toxicity.train(rows, 0.4, least=3, apart=0.5)
    texts = ["awful words", "good words, awful!", None, "", "women and awful men", "AWFUL " * 50, "kind " * 3000]
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts, clash=True), m).collect()}
    for i, t in enumerate(texts):
        known = {w for w in re.findall(toxicity.WORD, (t or "").lower()) if w in m["vocabulary"]}
        assert abs(got[i] - 1 / (1 + np.exp(-(m["b"] + sum(m["w"][m["vocabulary"][w]] for w in known))))) < 1e-9


@needs_tables
def test_decontamination_against_alignment_with_every_item(spark):
    """Every document against every item by a plain common subsequence over windows a little longer than the item."""
    clean = decontaminate.clean_words
    items = {r.item_id: clean(r.text) for r in table_of(spark, "benchmark").collect()}
    got = {r.doc_id: set(r.item_ids) for r in registry.QUERIES["op5_decontamination_lsa"](spark, SF).collect()}
    found = 0
    for r in table_of(spark, "documents").collect():
        words = clean(r.text)
        held = set(words)
        want = set()
        for k, item in items.items():
            # items whose words are nearly all in the document, next to each other
            if len(held.intersection(item)) < 0.9 * len(set(item)):
                continue
            n = len(item) + 4
            if any(decontaminate.common_subsequence(item, words[a : a + n]) >= 0.9 * len(item) for a in range(0, max(1, len(words) - n + 1))):
                want.add(k)
        assert want <= got[r.doc_id]
        # and what is found has most of the item's words in the document
        assert all(len(held.intersection(items[k])) >= 0.5 * len(set(items[k])) for k in got[r.doc_id])
        found += len(want)
    assert found > 0


def test_language_against_plain_forward_backward(spark):
    en, de = "the quick house water thing with weather ", "der schnelle straße wasser über nicht schön "
    model = language.train([(i, (en if i % 2 else de) * 8, "en" if i % 2 else "de") for i in range(40)])
    texts = [en * 3 + de * 2, de * 2 + en, en * 400, None, "der the der the", "Schnelle"]
    got = {r.doc_id: r for r in language.identify(docs(spark, texts, clash=True), model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        if not words:
            assert got[i].lang_pred == "und"
            continue
        e = language.emissions(words, model["w"].astype(float), language.word_features(words))
        k = len(model["langs"])
        fw, x = [], np.ones(k)
        for row in e:
            x = (x @ np.exp(model["t"])) * np.exp(row)
            x /= x.sum()
            fw.append(x)
        y, total = np.ones(k), np.zeros(k)
        for j in range(len(e) - 1, -1, -1):
            m = fw[j] * y
            total += m / m.sum()
            y = np.exp(model["t"]) @ (np.exp(e[j]) * y)
            y /= y.sum()
        assert got[i].lang_pred == model["langs"][int(np.round(total, 9).argmax())]
        assert abs(got[i].score - total.max() / len(words)) < 1e-3


@needs_tables
def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null, empty, repeated, very long and clashing rows through every stage."""
    good = table_of(spark, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, None, None, "s", None), (10**9 + 1, "word " * 40_000, "en", "s", 200_000), (None, "no id at all, but a text", "en", "s", 24)], DOCS)
    d = good.unionByName(good.limit(5)).unionByName(odd.select([F.col(c).cast(good.schema[c].dataType) for c in good.columns]))
    d = d.withColumns({c: F.lit(1) for c in ("a", "b", "n", "score", "component_id", "kind", "at", "c")})
    sizes = [d.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        if name != "pieces":
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        sizes.append(d.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    empty = table_of(spark, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_very_long_texts_everywhere(spark):
    """Texts of a megabyte, with and without spaces, through every operator on documents."""
    texts = ["lorem ipsum dolor sit amet " * 40_000, "ab" * 150_000, "x1 " * 300_000]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(3)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet")], "item_id long, text string")
    assert language.identify(d, language.train([(1, "lorem ipsum", "la"), (2, "the house", "en")])).count() == 3
    assert toxicity.op4_toxicity(d, labels).count() == quality.op6_quality(d, labels).count() == pii.op7_pii(d).count() == 3
    assert {r.doc_id for r in decontaminate.op5_decontamination(d, items).where("leaked").collect()} == {0}
    assert [r.component_id for r in jaccard.op10_jaccard(d).orderBy("doc_id").collect()] == [0, 1, 2]
    assert {r.doc_id: r.n_removed for r in repeats.op9_repeats(d).collect()} == {0: 0, 1: 0, 2: 0}
