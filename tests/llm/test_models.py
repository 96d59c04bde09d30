"""Trained operators: held-out accuracy, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfringe.llm import html_text, toxicity
from sparkfringe.llm.common import Scratch


@pytest.fixture(scope="module")
def trees():
    return html_text.trained(300)


def test_generated_pages_of_another_seed(trees):
    made = html_text.training_pages(150, 99)
    logit = trees.logit(html_text.features([p for p, _ in made]))
    at = wrong = 0
    for page, good in made:
        kept = html_text.decode(page, logit[at : at + len(good)])
        at += len(good)
        assert all(kept[page.parent[k]] for k in range(1, len(kept)) if kept[k])
        wrong += html_text.text_of(page, kept) != html_text.text_of(page, list(good))
    assert wrong <= 12


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1><nav><ul><li><a href="/">Home</a><li><a href="/a">About us</a></ul></nav></header>
<div class="cookie-notice">We use cookies on this page. <button>Fine</button></div><div class="ad">Buy now, cheap.</div>
<article><h1>The  title&nbsp;here</h1><p>First <b>bold</b> words, then
more &lt;words&gt; of it.<p><b>Second one<br><p>Third<!-- <p>no</p> --> one</article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I like this, thank you.</p></div></section>
<aside class="sidebar"><h3>Related</h3><a href="/x">Other news</a></aside>
<form class="search"><input name=q><label>Search</label></form><footer>&copy; Example &middot; all rights</footer></body></html>"""


def test_one_page(trees):
    assert html_text.extract([PAGE], trees) == ["The title here\nFirst bold words, then more <words> of it.\nSecond one\nThird one"]


LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt."
LAYOUTS = [
    (f'<div id="top"><a href=/>Home</a> <a href=/x>News</a></div><div id="content"><h1>Title</h1><p>{LONG}</p><p>So.</p></div><div id="footer">Copyright</div>', ["Title", LONG, "So."]),
    (f"<article><h1>Title</h1><p>{LONG}</p><section id=comments><h3>Comments</h3><div class=comment><p>{LONG}</p></div></section></article>", ["Title", LONG]),
    (f'<div class="sidebar"><h3>More</h3><p>{LONG}</p></div><div class="post"><h1>Title</h1><p>{LONG}</p></div>', ["Title", LONG]),
    (f'<div class="notice">{LONG}</div><article><p>So it is.</p></article>', ["So it is."]),
    (f'<nav><a href=x>x</a></nav><div class="ad">{LONG}</div><footer>f</footer>', []),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_layouts(k):
    assert html_text.extract([f"<html><body>{LAYOUTS[k][0]}</body></html>"], html_text.trained()) == ["\n".join(LAYOUTS[k][1])]


def test_hand_written_layouts(trees):
    """Nearly all give the exact text, and none loses it all."""
    from layouts import CANALS, SNOW

    full, right = html_text.trained(), 0
    for body, blocks in CANALS + SNOW:
        (got,) = html_text.extract([body if "<body" in body else f"<html><body>{body}</body></html>"], full)
        right += got == "\n".join(blocks)
        assert got and max(blocks, key=len) in got
    assert len(CANALS + SNOW) == 44 and right >= 41


def test_trees_are_stored_and_read_again(spark, tmp_path):
    first = html_text.trained(40, 3, f"file://{tmp_path}")
    html_text.trained.cache_clear()
    again = html_text.trained(40, 3, f"file://{tmp_path}")
    assert first is not again and first.base == again.base and (first.value == again.value).all() and (first.limit == again.limit).all()


def test_repeated_pages_are_pages_of_their_own(spark, trees):
    pages = spark.createDataFrame([(1, "u", "<p>One page.</p>"), (1, "u", "<p>One page.</p>"), (None, None, "<p>Other page.</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.main_text(pages, trees).collect()) == ["One page.", "One page.", "Other page."]


def test_odd_pages(spark, trees):
    deep = "<div>" * 5000 + "<p>deep text" + "</div>" * 5000
    odd = [None, "", "no tags, a < b & c", "<", "<p", "<<<>>>", "<!-- open", "<script>x", "</p></div>", "<a <a <a " * 2000, '<p title="open>text', deep, "<p>" + "word " * 100_000]
    pages = spark.createDataFrame([(k, None if k % 2 else "u", h) for k, h in enumerate(odd)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = {r.page_id: r for r in html_text.main_text(pages, trees).collect()}
    assert len(out) == len(odd) and all(r.n_chars == len(r.text) for r in out.values())
    assert out[2].text == "no tags, a < b & c" and out[0].text == out[1].text == ""
    assert out[12].n_chars == 499_999
    assert html_text.main_text(pages.limit(0), trees).count() == 0


def corpus(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["zworf", "quixel", "idiot", "vompf"]
    docs, labels = [], []
    for k in range(1500):
        own = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(bad) + rng.choice(["", "", "a", "en", "isch"]))
        docs.append((k, " ".join(own)))
        labels.append((k, 1, int(toxic)))
    family = " ".join(rng.choice(plain) + "q" for _ in range(40))  # copies must not teach their words
    for k in range(60):
        docs.append((2000 + k, family + (" idiot" if k < 50 else "")))
        labels.append((2000 + k, 1, int(k < 50)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = corpus(1)
    docs += [(9000, None), (9001, ""), (9002, "w " * 200_000), (None, "what an idiot"), docs[0]]
    labels += [(None, 0, 1), (3, None, None), (123456, 1, 1), labels[0]]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    with Scratch(spark) as scratch:
        model = toxicity.fit(rows, marks, scratch)
        out = toxicity.score(rows, model).select("row.doc_id", "score", toxicity.held_out(F.col("row.doc_id")).alias("out")).collect()
        blank = toxicity.fit(rows, marks.limit(0), scratch)
        assert toxicity.score(rows.limit(0), model).count() == 0
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    truth = {i: t for i, _, t in labels if i is not None and t is not None}
    held = [(r.score >= 0.7, truth[r.doc_id]) for r in out if r.out and r.doc_id in truth]
    assert len(held) > 300 and sum(p == t for p, t in held) >= 0.99 * len(held)
    by = {r.doc_id: r.score for r in out}
    assert by[9000] == by[9001] < 0.5 and by[None] > 0.7
    assert blank.score("you idiot") > 0.7 > 0.3 > blank.score("you there")
    assert len(model.voters) == toxicity.LISTS + len(toxicity.PATTERNS) + 4 and all(0 <= v["accuracy"] <= 1 for v in model.voters)


def test_toxicity_with_one_class_of_labels(spark):
    docs, labels = corpus(2)
    rows = spark.createDataFrame(docs[:200], "doc_id long, text string")
    for toxic in (0, 1):
        marks = spark.createDataFrame([(i, q, toxic) for i, q, _ in labels[:200]], "doc_id long, quality int, toxic int")
        with Scratch(spark) as scratch:
            model = toxicity.fit(rows, marks, scratch)
        assert not model.terms and model.score("you idiot") > 0.7 > 0.3 > model.score("you there")


def test_copies_of_a_text_do_not_teach_their_words(spark):
    docs, labels = corpus(3)
    with Scratch(spark) as scratch:
        model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), scratch)
    family = set(docs[-1][1].split())
    assert {"0zworf", "0idiot"} <= model.terms and not {t[1:] for t in model.terms if t[0] == "0"} & family


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    noisy = lambda p: np.where(rng.random(4000) < p, y, ~y) * 2 - 1
    one, two, three = noisy(0.75), noisy(0.75), noisy(0.9)
    votes = np.stack([one, one, one, two, three, noisy(0.95)], 1).astype(np.int8)
    posterior, voters = toxicity.label_model(votes, votes[:, -1])
    assert ((posterior > 0.5) == y).mean() > 0.93
    assert voters[0]["weight"] < 0.5 < voters[3]["weight"]
