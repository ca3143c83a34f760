"""Token counts, toxicity, language and main text: per-document operators."""

from __future__ import annotations

import math
import os
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import html_text, langid, token_counts, toxicity
from keyloom.llm.queries import TOKENIZER, op2_toxicity, op4_language_id

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]
DOCS = "doc_id long, text string, lang string, source string, score string"
ODD = [(1, None, None, None, "x"), (2, "", "en", "a", None), (2, "", "en", "a", None), (None, "one. two", None, "a", "y"), (5, "  \n ", "en", None, "z"), (6, "word " * 200_000, "en", "a", "w")]


# token counts


def test_suffix_sums_equal_a_count_per_document(spark, frame):
    encoder = token_counts.Encoder(TOKENIZER).own
    texts = [None, "", "a b c", "a b c", "Größe 12", "x" * 5000, "line\nline " * 3000]
    docs = frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lengths = [len(encoder.encode_ordinary(t)) if t else 0 for t in texts]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs, TOKENIZER)).cache()
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert {n: r["n_docs"] for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["tokens_truncated"] == sum(min(x, n) for x in lengths)
        assert math.isclose(r["quantile"], sum(x <= n for x in lengths) / len(lengths))
    asked = {r["context"]: (r["tokens_truncated"], r["docs_cut"]) for r in token_counts.totals_at(sums, [0, 1, 4, 700, 10**6]).collect()}
    assert asked == {c: (sum(min(x, c) for x in lengths), sum(x > c for x in lengths)) for c in (0, 1, 4, 700, 10**6)}


def test_long_runs_are_encoded_whole(spark, frame):
    encoder = token_counts.Encoder(TOKENIZER)
    for blank in (" ", "\n", "\t ", "\u3000", "\x85\n"):
        for after in ("", "a", "7 x", "!", "\x1c"):
            for n in (9_999, 10_000, 10_001, 25_000):
                text = "b c" + (blank * n)[:n] + after
                assert encoder.length(text) == len(encoder.own.encode_ordinary(text))
    assert encoder.length("a" + " " * 12_000 + "b" + "\n" * 11_000 + "c " * 3) == len(encoder.own.encode_ordinary("a" + " " * 12_000 + "b" + "\n" * 11_000 + "c " * 3))
    docs = frame([(i, c * 2_000_000) for i, c in enumerate(" \na7!")], "doc_id long, text string")
    rows = token_counts.length_histogram(docs, TOKENIZER).collect()
    assert sum(r["n_docs"] for r in rows) == 5 and max(r["n_tokens"] for r in rows) == len(encoder.piece.encode_ordinary(" " * 2_000_000))


def test_no_documents_have_no_lengths(spark):
    docs = spark.createDataFrame([], "text string")
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs, TOKENIZER))
    assert sums.count() == 0
    assert token_counts.totals_at(sums, [8]).first()["tokens_truncated"] == 0


# toxicity


def test_pieces_cover_all_words():
    text = "One. Two! " + "three four " * 100 + "\nfive six seven eight nine ten eleven twelve thirteen fourteen? end"
    found = list(toxicity.pieces(text))
    assert [w for _, _, words in found for w in words] == toxicity.LETTERS.findall(text.lower())
    assert all(0 <= a < b <= len(text) for a, b, _ in found) and max(len(w) for *_, w in found) <= 50


def toy(n=120):
    plain = [f"the {a} sees a {b} near some water and then it goes home with {a}." for a in ("cat", "dog", "bird", "fish") for b in ("tree", "house", "road")]
    rows, labels = [], []
    for i in range(n):
        lines = [plain[(i * 5 + k) % len(plain)] for k in range(3 + i % 4)]
        if i % 3 == 0:
            lines[i % len(lines)] = "you are such a vile zorkmoid person and nobody wants to see you here."
        rows.append((i, " ".join(lines)))
        labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_sentence_scores_are_learned_from_documents(spark, frame):
    rows, labels = toy()
    docs = frame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.where("doc_id < 90"), given, shards=2)
    out = {r["doc_id"]: r for r in toxicity.score(docs.where("doc_id >= 90"), model).collect()}
    assert all(r["predicted"] == (k % 3 == 0) for k, r in out.items())
    texts = dict(rows)
    for k in range(90, 120, 3):
        best = max(out[k]["spans"], key=lambda s: s["score"])
        assert "zorkmoid" in texts[k][best["start"] : best["end"]]


def test_score_of_odd_rows_and_clashing_columns(spark, frame):
    docs = frame(ODD, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(2, 0), (5, None), (None, 1)], "doc_id long, toxic int"), shards=2)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "lang", "source", "score", "predicted", "spans"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 5))
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_query_on_held_out_documents(spark):
    out = {r["doc_id"]: r for r in op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in out.items())
    held = [(out[x["doc_id"]]["predicted"], x["toxic"]) for x in labels if out[x["doc_id"]]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert np.mean([p for p, y in held if y == 0]) < 0.03


# language


def test_model_equals_the_recursive_formula():
    text = "banana bandana ananas band and " * 3
    grams, _, _ = langid._grams([text])
    unique, counts = np.unique(grams, return_counts=True)
    probabilities, backs, lowest = langid._kneser_ney(unique, counts, 12)

    tables = {4: Counter(dict(zip(unique.tolist(), counts.tolist(), strict=True)))}
    for n in (3, 2, 1):
        tables[n] = Counter(g & ((1 << 16 * n) - 1) for g in tables[n + 1])
    discounts = {}
    for n, t in tables.items():
        once, twice = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        discounts[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(n, gram):
        if n == 0:
            return 1 / 12
        context = gram >> 16
        mine = {g: c for g, c in tables[n].items() if g >> 16 == context}
        shorter = p(n - 1, gram & ((1 << 16 * (n - 1)) - 1))
        if not mine:
            return shorter
        total, d = sum(mine.values()), discounts[n]
        return max(mine.get(gram, 0) - d, 0) / total + d * len(mine) / total * shorter

    logs = {n: langid.HashArray(g, np.log(v)[:, None].astype(np.float32)) for n, (g, v) in probabilities.items()}
    back = {n: langid.HashArray(g, np.log(v)[:, None].astype(np.float32)) for n, (g, v) in backs.items()}
    model = langid.Model(["x"], logs, back, np.log(np.array([lowest], np.float32)))
    asked, _, _ = langid._grams(["bandanas nab an xanad"])
    got = np.exp(model.log_p(asked)[:, 0])
    assert np.allclose(got, [p(4, int(g)) for g in asked], rtol=1e-4)
    letters = sorted({g & 0xFFFF for g in tables[1]})
    context = int(unique[3] >> np.uint64(16))
    assert sum(p(4, (context << 16) | c) for c in letters) < 1


def test_hash_array_finds_what_it_holds():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    held = langid.HashArray(grams, np.zeros((len(grams), 1), np.float32))
    rows = held.find(grams)
    assert (held.grams[rows] == grams).all()
    assert (held.find(grams + np.uint64(1))[~np.isin(grams + np.uint64(1), grams)] == -1).all()


def test_long_texts_and_neighbours_do_not_change_a_text(monkeypatch, spark, frame):
    docs = frame([(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    texts = ["the hat", "!?", "1 katze 2", None, "und der hund"]
    alone = np.concatenate([model.entropies([t])[0] for t in texts])
    assert np.allclose(model.entropies(texts)[0], alone)
    long = "the cat and the hat " * 500
    whole, n = model.entropies([long])
    monkeypatch.setattr(langid, "SLICE", 1000)
    parts, m = model.entropies([long])
    assert abs(n[0] - m[0]) <= 20 and np.allclose(whole, parts, rtol=0.02)


def test_language_query_on_held_out_documents(spark):
    rows = op4_language_id(spark, SF).collect()
    given = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(given)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == given[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97
    assert not any(r["rejected"] for r in rows)


def test_language_of_odd_rows(spark, frame):
    known = frame([(i, f"the number of the house is {i} and the road", "en") for i in range(20)] + [(30 + i, "das haus und der weg sind lang", "de") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(known)
    odd = frame([*ODD, (7, "12345 !!", "en", "a", "q"), (8, "Это совсем другой язык и другие буквы, которых никто здесь не знает", "en", "a", "q"), (9, "Das Haus", "xx", "a", "q")], DOCS)
    out = langid.predict(odd, model)
    assert out.columns == ["doc_id", "lang", "source", "lang_pred", "score", "nats", "rejected"]
    rows = out.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) + 3
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 and by[k]["rejected"] for k in (1, 2, 5, 7))
    assert by[8]["rejected"] and not by[9]["rejected"] and by[9]["lang_pred"] == "de"
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {9} and kept.where("doc_id in (1, 2, 5, 7, 8)").count() == 0


def test_workers_need_no_installed_package(tmp_path):
    """From another folder, with the package on the driver's path only."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from keyloom.session import local_session
from keyloom.llm.queries import QUERIES
spark = local_session(2)
for name in ("op4_language_id", "op11_fill_in_middle", "op12_vector_codes"):
    print(name, QUERIES[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert said.returncode == 0, said.stderr[-2000:]
    assert len(said.stdout.splitlines()) == 3


def test_nothing_learned_gives_und(spark, frame):
    docs = frame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


# main text

PAGES = [
    ('<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>Head</h1><p>First <b>bold</b>text &amp; more.<p>Second<br>line</article><footer>x</footer></body></html>', "Head First boldtext & more. Second line"),
    ('<body><header>Site</header><div id="sidebar">links</div><div class="content"><h2>Title</h2><p>Long enough to be content of this page.</p><p>Short.</p><div class="comments"><p>I agree</p></div></div><form>Name <input></form><div class="cookie-notice">We use cookies</div></body>', "Title Long enough to be content of this page. Short."),
    ("plain &lt;text&gt;\n only", "plain <text> only"),
    ("<div>a<script>if (1 < 2) document.write('</p>')</script>b<style>p{}</style></div>", "ab"),
    ("<article><p>one<aside>two</aside><p>three</article><article></article>", "one three"),
    ('<p>x<span class="ad">buy</span>y<!-- c --></p>', "x y"),
    ('<body class="no-sidebar"><main><p>kept</p></main></body>', "kept"),
    (None, ""),
    ("", ""),
    ("<nav>only menu</nav>", ""),
    ("<p><b><i>" * 300 + "deep", "deep"),
    ("<<<>>&&&#x;", None),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    found = html_text.main_text(html)
    assert found == " ".join(found.split())
    if text is not None:
        assert found == text


def test_hot_language_leaves_small_ones_their_grams(spark):
    hot = [("aa", (97 << 48) + (i << 16) + 98, 9 if i < 9000 else 5) for i in range(97, 25_097)]
    small = [(f"l{k}", (99 << 48) + (100 << 32) + (101 << 16) + 500 + k, 1) for k in range(299)]
    model = langid.build(spark.createDataFrame(hot + small, "lang string, gram long, n long"))
    assert model.languages == sorted({r[0] for r in hot + small})
    for k in (0, 150, 298):
        found = model.log_p(np.array([small[k][1]], np.uint64))[0]
        assert model.languages[int(found.argmax())] == f"l{k}"
    tops = len(model.logs[langid.ORDER].grams)
    assert tops == len(hot) + len(small)


def test_labelled_junk_does_not_raise_the_limit(spark):
    import random

    rng = random.Random(2)
    junk = lambda: " ".join("".join(rng.choices("qxzjkwvyhbfgpm", k=rng.randrange(3, 9))) for _ in range(100))
    given = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'fr'").collect()]
    rows = [*given, (10**7, junk(), "fr")]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(rows, schema).repartition(3))
    unseen = [(-1 - i, junk(), None) for i in range(20)] + given[:20]
    out = {r["doc_id"]: r["rejected"] for r in langid.predict(spark.createDataFrame(unseen, schema).select("doc_id", "text"), model).collect()}
    assert all(out[i] for i, _, lang in unseen if lang is None) and not any(out[i] for i, _, _ in given[:20])


LONG = "Many words in one line make it a line of content on any page, whatever stands around it. " * 4
LINKS = "".join(f'<p><a href="/{i}">Go</a> <a href="/x{i}">x{i}</a></p>' for i in range(12))


@pytest.mark.parametrize("html, kept, gone", [
    (f"<body><div><p>The intro.</p><ul>{f'<li>{LONG}' * 9}</ul><p>The end.</p></div></body>", ["The intro.", "The end.", LONG], []),
    (f"<body><div>{f'<p>{LONG}</p>' * 12}</div><div><p>Last section, short but with {LONG}</p></div></body>", ["Last section"], []),
    (f"<body><div><blockquote>{f'<p>{LONG}</p>' * 12}</blockquote><p>Said by me.</p></div></body>", ["Said by me."], []),
    (f"<body><div>{f'<p>{LONG}</p>' * 3}</div><div>{LINKS}</div></body>", [LONG], ["x7"]),
    (f"<article><p>{LONG}</p><p>{LONG}</p><div>{LINKS}</div><p>{LONG}</p><p>Bye.</p></article>", [LONG, "Bye."], ["x7"]),
])
def test_all_content_of_unmarked_and_marked_pages(html, kept, gone):
    found = html_text.main_text(html)
    assert all(x.strip() in found for x in kept) and not any(x in found for x in gone)


LONG = "A long sentence of an article that goes on and on for quite a while, it seems. " * 4


@pytest.mark.parametrize("html, times", [
    ('<div class="post type-post comment-open"><p>{0}</p><p>{0}</p></div>', 2),
    ('<div class="content share-enabled"><p>{0}</p></div>', 1),
    ('<article><h2 id="search">S</h2><div id="search-algorithms"><p>{0}</p></div><div id="share-prices"><p>{0}</p></div></article>', 2),
    ('<form id="aspnetForm"><div><p>{0}</p></div></form>', 1),
    ('<div><p>{0}</p><p>{0}</p></div><div class="comments-area"><p>{0}</p></div><div class="comment-list"><p>{0}</p></div>', 2),
    ('<div class="no-sidebar"><p>{0}</p><p>{0}</p></div><div class="sidebar-left"><p>{0}</p></div><div id="related-posts"><p>{0}</p></div>', 2),
    ('<p>{0}</p><p>{0}</p><form><p>{0}</p></form><div class="siteHeader"><p>{0}</p></div>', 2),
    ('<div class="sidebar"><main><p>{0}</p></main></div><p>short</p>', 1),
])
def test_names_of_elements_do_not_hide_an_article(html, times):
    assert html_text.main_text(html.format(LONG)).count("A long sentence") == 4 * times


def test_titles_and_formulas_belong_to_the_article():
    page = f'<div class="article-header"><h1>The title of it</h1></div><article><div class="entry-header"><h2>Part one</h2></div><p>{LONG}</p>'
    text = html_text.main_text(page + "<p>Mass is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as all of us know by now, I think.</p></article>")
    assert "Part one" in text and "Mass is E=mc2 as all" in text


def test_unmarked_pages_of_equal_lines_are_all_content():
    page = "".join(f"<div><p>{LONG}</p></div>" for _ in range(6))
    assert html_text.main_text(page).count("A long sentence") == 24
    links = "".join("<li><a href='#'>go</a></li>" for _ in range(30))
    assert html_text.main_text(f"<div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div>").count("go") <= 12


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "<p>x</p>", "<div><figure>" + "<figure><form>x</form2></form>" * 20_000, "<main><div class='ad'>x" * 20_000, "<span class='ad'>x" * 20_000])
def test_deeply_nested_pages_take_linear_time(page):
    begin = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begin < 6


def test_smoothing_keeps_a_constant():
    assert np.allclose(html_text.smoothed(np.full(9, 3.0)), 3)


def test_extract_keeps_rows_and_columns(spark, frame):
    rows = [(i, "u", html, "c") for i, (html, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "c"), (None, None, "<p>" + "word " * 300_000, None)]
    pages = frame(rows, "page_id long, url string, html string, n_chars string")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_given_pages_give_their_article(spark):
    import html as entities
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.select("page_id", F.col("html")).collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert texts[r["page_id"]] == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inside)).split())
