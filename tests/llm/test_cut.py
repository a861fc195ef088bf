"""The minimum cut against all labellings, and page extraction through the operator on odd tables."""

import itertools
import random
import time

import pytest

from sparkloom.llm.extraction import extract_text, main_text, minimum_cut


def cost(side, source, sink, edges):
    return sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(w for i, j, w in edges if side[i] != side[j])


def test_cut_is_the_least_of_all_labellings():
    rng = random.Random(12)
    for _ in range(150):
        n = rng.randrange(1, 9)
        source, sink = ([rng.choice([0.0, rng.random() * 4]) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rng.random() * 2) for i in range(n) for j in range(i) if rng.random() < 0.5]
        found = minimum_cut(source, sink, edges)
        best = min(cost(side, source, sink, edges) for side in itertools.product([False, True], repeat=n))
        assert abs(cost(found, source, sink, edges) - best) < 1e-6


def test_pages_with_nulls_repeats_and_long_text(spark):
    sentence = "The river rose in the night and the town woke to water in its lower streets. "
    long = f"<nav><a href='/'>Home</a></nav><article>{''.join(f'<p>{k} {sentence * 20}</p>' for k in range(400))}</article>"
    rows = [(1, "u", long, "x"), (1, "u", long, "x"), (None, None, f"<p>{sentence}</p>", None), (2, "v", None, "y"), (3, "w", "", "z")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), str(r.url), r.n_chars) for r in got) == sorted([("1", "u", len(main_text(long)))] * 2 + [("None", "None", len(sentence.strip())), ("2", "v", 0), ("3", "w", 0)])
    text = next(r.text for r in got if r.page_id == 1)
    assert text.count("\n\n") == 399 and "Home" not in text and text.startswith("0 The river") and text.endswith("streets.")


TEXT = "The river rose in the night and the town woke to water in its lower streets and yards. " * 3


@pytest.mark.parametrize(
    "page,kept",
    [
        (f"<article class='alert-zone'><h1>Flood</h1><p>{TEXT}</p><p>{TEXT}</p></article>", 3),
        (f"<div id='wrapper' class='header-layout widget-area'><h2>Flood</h2><p>{TEXT}</p><p>{TEXT}</p></div>", 3),
        (f"<article><h1>Flood</h1><section class='related-work'><p>{TEXT}</p><p>{TEXT}</p></section></article>", 3),
        (f"<article><h1>Flood</h1><p>{TEXT}</p><section class='social-history'><p>{TEXT}</p></section><p>{TEXT}</p></article>", 4),
        ("<p>Closed today.</p>", 1),
        (f"<article><h1>Flood</h1><p>{TEXT} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><noscript><p>{TEXT}</p></noscript></article>", 3),
        (f"<article><p>{TEXT}</p></article><div class='comments'><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div>", 1),
        (f"<article><p>{TEXT}</p><div class='related-posts'><p>{TEXT}</p></div><aside><p>{TEXT}</p></aside></article>", 1),
        (f"<div class='comment-thread'><p>{TEXT}</p><p>{TEXT}</p></div>", 0),
        ("<nav><a href='/'>Home</a></nav><footer>All rights reserved.</footer>", 0),
        (f"<div class='cookie-notice'><p>We use cookies.</p></div><div><h1>Flood</h1><p>{TEXT}</p></div>", 2),
    ],
)
def test_a_word_in_a_class_does_not_outweigh_an_article(page, kept):
    text = main_text(f"<html><body>{page}</body></html>")
    assert len([x for x in text.split("\n\n") if x]) == kept
    if "<math>" in page:
        assert "x=2" in text


def test_long_and_deep_pages_take_time_in_proportion():
    began = time.process_time()
    text = main_text("<div>" + "".join(f"<p>{'word ' * (5 + k * 7 % 11)}</p><ul><li><a href='/'>link {k}</a></li></ul>" for k in range(10_000)) + "</div>")
    assert text
    assert main_text("<div class='widget'>" * 4000 + f"<p>{TEXT}</p>" * 3000 + "</div>" * 4000).count("\n\n") == 2999
    assert time.process_time() - began < 15
