"""Phrase mining, lexical search and page extraction: brute force, edge rows, held-out layouts, gradients."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from choicemill.llm import html_extraction, lexical_search, phrase_mining, ready
from choicemill.llm.common import Words
from choicemill.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import compare

DOCS = "doc_id long, text string, lang string, n long, f long, q long, `term` string, segment int"
NEW = ("op11_phrase_mining", "op12_lexical_search", "op13_html_extraction")


def lowered(text):
    return re.sub("[A-Z]", lambda x: x.group().lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, nulls in every column, empty and long texts, repeated rows, clashing names."""
    ready(spark)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(25)] + ["É", "a-b", "Straße", "x\x1fy"]
    marks = ["", "", "", "", ",", ".", "!", " \t", "\n"]

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(marks) for _ in range(n))

    base, long_ = text(80), text(6_000)
    rows = [(i, base if i % 3 == 0 else text(int(rng.integers(1, 120))), rng.choice(["en", "fr"])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, " \t\n.,;", "en"), (103, long_, "en"), (103, long_, "en"), (104, base.upper(), None),
             (None, base, None), (None, "w1 w2", "xx"), (105, "the " * 700, "fr")]
    return spark.createDataFrame([(i, t, None if g is None else str(g), None, 1, 2, None, None) for i, t, g in rows], DOCS)


# ---------------------------------------------------------------- phrases

def collocations_by_hand(rows, least, cover, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    count[lang or "und"][tuple(w[i: i + n])] += 1
    out = []
    for lang, f in count.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            def inside(longer, p=p):
                return any(longer[i: i + len(p)] == p for i in range(len(longer) - len(p) + 1))
            if any(len(x) > len(p) and inside(x) and 100 * b >= cover * a for x, b in cands.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("divisor", [1, 2, 16])
def test_collocations_equal_brute_force(docs, divisor):
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    got = sorted(tuple(r) for r in phrase_mining.collocations(docs, 4, 80, 40, divisor).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == collocations_by_hand(rows, 4, 80, 40)
    assert len(got) > 60


def test_chunks_cover_every_word_once_and_overlap_by_a_window():
    text = "a b c d e f g h i j k l m n o p q r s t, u v w x y z. one"
    words = Words(pa.array([text, "b c d e"]), lower=True, blank=phrase_mining.BLANKS)
    first, end, last = phrase_mining.parsed(words, divisor=2)
    assert first[0] == 0 and end[-1] == len(words)
    for f, e, whole, after in zip(first, end, last, [*first[1:], len(words)], strict=True):
        assert e == (after if whole else after + phrase_mining.LONGEST - 1)
        assert e > f
    assert (~last).any()


def test_a_full_filter_changes_nothing(docs, monkeypatch):
    usual = sorted(map(tuple, phrase_mining.collocations(docs, 4).collect()))
    monkeypatch.setattr(phrase_mining, "_filter", lambda counts, least: b"\xff" * (phrase_mining.FILTER_BITS // 8))
    assert sorted(map(tuple, phrase_mining.collocations(docs, 4).collect())) == usual


# ---------------------------------------------------------------- search

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def ranked_by_hand(rows, items, k):
    tokens = [(i, re.findall(TERM, lowered(t))) for i, t in rows]
    tokens = [(i, w) for i, w in tokens if w]
    n, total = len(tokens), sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    out = []
    for item, text in set(items):
        terms = Counter(re.findall(TERM, lowered(text)))
        scored = []
        for i, w in tokens:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n) // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t, c in terms.items() if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=str)


ITEMS = [(1, "w1 W2 w3 É straße"), (2, "w1 w1 w1 nowhere"), (3, "nowhere at all"), (4, None), (5, ""), (6, "the W24 a-b"),
         (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (7, "w3"), (7, "w3"), (None, "w20 w21")]


@pytest.mark.parametrize(("limit", "block", "k"), [(1 << 30, 256, 10), (900, 2, 3), (1, 1, 1), (4_000, 3, 100)])
def test_search_equals_brute_force(spark, docs, limit, block, k):
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, doc_id int")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in lexical_search.top_documents(docs, items, k, limit, block).select(
        "item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranked_by_hand(rows, ITEMS, k)


def test_block_bounds_spare_blocks():
    """With a kth score in hand, most blocks of a frequent term are never unpacked, and the best stay."""
    texts = [f"common rare{i % 40} " + "filler " * (i % 50) + ("gem " * 5 if i == 3_777 else "") for i in range(6_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6_000), pa.int64()), "text": texts})
    total = sum(len(t.split()) for t in texts)
    rows = pa.Table.from_batches(list(lexical_search.segment_of(batch, 0, 6_000, total)))
    uses = {"common": 1, "gem": 9_000, "filler": 2}
    kind = pa.list_(pa.struct([("q", pa.int64()), ("weight", pa.int64())]))
    keep = rows.filter(pa.array([t is None or t in uses for t in rows.column("term").to_pylist()]))
    keep = keep.append_column("uses", pa.array([[{"q": 1, "weight": uses[t]}] if t else None for t in keep.column("term").to_pylist()], kind))
    lists = lexical_search.Lists(keep)
    docs, score = lists.best_of(lists.items[1], 0, 1)
    assert docs[score.argmax()] == 3_777
    assert lists.unpacked < 10 < sum(len(f) for f in lists.first)


def test_length_scale_is_exact_beyond_64_bits():
    n = np.array([10 ** 9, 3])
    assert lexical_search.lengths_scaled(n, 10 ** 12, 7 * 10 ** 14).tolist() == [25 + 75 * int(x) * 10 ** 12 // (7 * 10 ** 14) for x in n]


# ---------------------------------------------------------------- pages

@pytest.fixture(scope="module")
def model(spark):
    pages = ready(spark).read.parquet(f"{SF}/pages.parquet")
    return html_extraction.train(html_extraction.training_sample(pages))


def texts(page):
    return html_extraction.read_blocks(page, html_extraction.Paths()).text


@pytest.mark.parametrize(("page", "blocks"), [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b</p>c", ["a", "b", "c"]), ("a<br>b\n\tc", ["a b c"]),
    ("<p>x &amp; y&nbsp;&lt;p&gt; &eacute &bogus; &#65;</p>", ["x & y <p> é &bogus; A"]), ("<p>a<!-- <p>no</p> -->b", ["ab"]),
    ("<script>var t='</p><p>no';</script><p>yes", ["yes"]), ("<SCRIPT>never closed <p>no", []), ("<style >p{}</style >a", ["a"]),
    ("<p title='a>b' class=x>one <b>two</p>three", ["one two", "three"]), ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<a href=x>l</a><p <b>t", ["l", "t"]),
    ("</div></p></b>x</p", ["x"]), ("<table><tr><td>a<td>b<tr><td>c", ["a", "b", "c"]), ("<em>in<b>li</em>ne", ["inline"]),
])
def test_blocks(page, blocks):
    assert texts(page) == blocks


def test_deep_and_long_pages_are_read_whole():
    deep = "<div>" * 3_000 + "bottom" + "<p>x" * 3_000
    assert len(texts(deep)) == 3_001
    assert texts("<a " * 50_000 + "'" * 1_001) is not None


def test_network_gradient_equals_differences():
    rng = np.random.default_rng(4)
    model = html_extraction.Labeller(5, 3)
    model.p = {k: rng.standard_normal(v.shape) * 0.3 for k, v in model.p.items()}
    x, length = rng.standard_normal((6, 3, 5)), np.array([6, 2, 4])
    y = (rng.random((6, 3)) < 0.5).astype(float)
    _, grads = model.loss_and_gradient(x, y, length)
    for name, value in model.p.items():
        for at in rng.integers(value.size, size=4):
            losses = []
            for step in (1e-5, -1e-5):
                value.flat[at] += step
                losses.append(model.loss_and_gradient(x, y, length)[0])
                value.flat[at] -= step
            assert grads[name].flat[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6), name


def test_labels_do_not_depend_on_the_batch(model):
    paths = html_extraction.Paths()
    drawn = html_extraction.Layouts([f"w{i}" for i in range(200)], paths, 77)
    pages = [drawn.draw()[0] for _ in range(40)]
    size = np.array([len(p.text) for p in pages])
    rows = html_extraction.vectors(pages, paths)
    together = model.label(rows, size)
    alone = np.concatenate([model.label(rows[e - n: e], np.array([n])) for n, e in zip(size, np.cumsum(size), strict=True)])
    assert np.allclose(together, alone, atol=1e-4)


def test_held_out_layouts(model):
    paths = html_extraction.Paths()
    drawn = html_extraction.Layouts([a + b + c for a in ("ka", "lo", "mi", "re") for b in ("st", "nd", "r") for c in ("en", "a", "ix")], paths, 1234)
    pages = [drawn.draw() for _ in range(200)]
    size = np.array([len(p.text) for p, _ in pages])
    found = model.label(html_extraction.vectors([p for p, _ in pages], paths), size) >= 0.5
    truth = np.concatenate([y for _, y in pages]) == 1
    assert (found == truth).mean() > 0.97
    assert found[truth].mean() > 0.97 and found[~truth].mean() < 0.05


PAGE = """<html><head><title>News</title></head><body><div class="cookie-banner"><p>We use cookies on this site.</p><button>OK</button></div>
<header><a href="/">The Daily</a></header><div class="menu"><ul><li><a href=a>Home</a></li><li><a href=b>Sport</a></li></ul></div>
<div class="content"><h1>Rain &amp; wind</h1><p>It   rained all day.</p><div class="advert"><a href=z>Buy umbrellas</a></div>
<p>Then the wind came, and the roof went with it.</p></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href=c>Ten roofs</a></li></ul></div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked the rain, really.</p></div></section>
<form><label>Your mail</label><button>Send</button></form><footer>© The Daily</footer></body></html>"""


def test_a_page_without_article_element(model):
    paths = html_extraction.Paths()
    page = html_extraction.read_blocks(PAGE, paths)
    kept = model.label(html_extraction.vectors([page], paths), np.array([len(page.text)])) >= 0.5
    assert [t for t, k in zip(page.text, kept, strict=True) if k] == [
        "Rain & wind", "It rained all day.", "Then the wind came, and the roof went with it."]


def test_edge_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<p>"), (None, "w", PAGE), (4, "x", PAGE), (4, "x", PAGE),
            (5, "y", "<article>" + "<p>Some words, here.</p>" * 5_000 + "</article>")]
    table = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.url): r for r in html_extraction.main_text(table, model).collect()}
    assert html_extraction.main_text(table, model).count() == len(rows)
    assert got[1, "u"].text == got[2, None].text == got[3, "v"].text == ""
    assert got[None, "w"].text == got[4, "x"].text != ""
    assert got[5, "y"].n_chars == len(got[5, "y"].text) == 5_000 * 17 + 4_999 * 2
    empty = spark.createDataFrame([], table.schema)
    assert html_extraction.main_text(empty, model).count() == 0
    assert html_extraction.training_sample(empty) == []


# ---------------------------------------------------------------- registered queries

def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert phrase_mining.collocations(none).count() == 0
    assert lexical_search.top_documents(none, items).count() == 0
    assert lexical_search.top_documents(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, con, name):
    out = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert out["equal"], out["note"]
    assert out["types"] == []


def test_columns(spark):
    assert [set(QUERIES[n](spark, SF).columns) for n in NEW] == [
        {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}, {"item_id", "rank", "doc_id", "score"},
        {"page_id", "url", "text", "n_chars"}]
