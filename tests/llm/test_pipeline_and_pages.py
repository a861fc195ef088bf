"""The pipeline's stages on planted documents, and page extraction on pages with known parts."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from sparkloom.llm.extraction import main_text, minimum_cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = ["".join(random.Random(k).choice("abcdefghijklmnop") for _ in range(5)) for k in range(2000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, 200)) for k in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1].replace(rows[3][1].split()[10], "other", 1))]  # copies
    rows += [(200, f"{prose(rng, 90)}\n{passage}"), (201, f"{passage}\n{prose(rng, 90)}")]  # a shared passage
    rows += [(300, "A short one."), (301, None), (302, "again and again " * 60), (303, " \n")]  # all but the first are junk
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(d, t, "en", "ab"[d % 2], len(t or "")) for d, t in rows], SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_stage_takes_effect(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    clean = set(range(40)) | {200, 201, 300}
    assert ids["quality_rules"] == clean | {100, 101}
    assert ids["ngram_jaccard_join"] == clean
    texts = {r.doc_id: r.text for r in kept["substring_dedup"]}
    assert set(texts) == clean and len(texts[200].split()) == 160 and len(texts[201].split()) == 90
    assert all(r.n_chars == len(r.text) for r in kept["substring_dedup"])
    mixed, size = defaultdict(int), defaultdict(int)
    for r in kept["source_mixing"]:
        mixed[r.source] += len(r.text.split())
    for r in kept["substring_dedup"]:
        size[r.source] += len(r.text.split())
    total = sum(size.values())
    want_a = min(2 * size["a"], round(1.5 * total * 3 / 4))
    assert mixed == {"a": want_a, "b": pytest.approx(min(2 * size["b"], 1.5 * total - want_a), abs=1)}
    load = Counter()
    for r in kept["packing"]:
        load[r.sequence_id] += r.length
        assert len(r.ids) == r.length
    assert max(load.values()) <= 2048
    # a document taken twice is packed twice
    takes = Counter(r.doc_id for r in kept["source_mixing"])
    assert Counter(r.doc_id for r in kept["packing"] if r.start == 0) == takes


def test_run_gives_the_packed_rows(spark, folder):
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(corpus_pipeline.run(spark, folder).columns)


def test_minimum_cut():
    assert minimum_cut([5, 0, 0], [0, 0, 5], [(0, 1, 3.0), (1, 2, 1.0)]) == [True, True, False]
    assert minimum_cut([], [], []) == []


LONG = "The river rose in the night and the town woke to water in its lower streets, which nobody had seen for years."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href='/'>Home</a></nav></body></html>", ""),
        (f"<body><header><h1>Site</h1></header><article><h1>Flood</h1><p>{LONG}</p><p>Short &amp;\n sweet.</p></article><aside>Ad</aside><footer>© x</footer></body>", f"Flood\n\n{LONG}\n\nShort & sweet."),
        (f"<div class='sidebar'>Links</div><div id=content><p>{LONG}<script>x('<p>')</script><p>{LONG}</div><section class='comments'><p>{LONG}</p></section>", f"{LONG}\n\n{LONG}"),
        (f"<main><p>a<b>b</b>c {LONG}<form><input><button>Go</button></form></main><!-- <p>gone", f"abc {LONG}"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


MENU = "<nav><a href='/'>Home</a></nav>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<div class='content has-sidebar'>{MENU}<article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='wrapper has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div class='search-results'>{MENU}<article><p>{LONG}</p></article><aside><p>{LONG}</p></aside></div>", LONG),
        (f"<div class='social related'><main><h1>Flood</h1><p>{LONG}</p></main></div><footer><p>{LONG}</p></footer>", f"Flood\n\n{LONG}"),
        (f"<form id='aspnetForm'>{MENU}<article><p>{LONG}</p></article><div class='sidebar'><p>{LONG}</p></div></form>", LONG),
        (f"<div id='main'><form id='aspnetForm'>{MENU}<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></form></div>", f"{LONG}\n\n{LONG}\n\n{LONG}"),
        # marks that enclose no main part hold, also in longer parts
        (f"<article><p>{LONG}</p><div class='comments'><article><p>{f'{LONG} ' * 9}</p></article></div></article>", LONG),
        (f"<article><p>{LONG}</p></article><div class='related'><article><p>{LONG}</p></article></div>", LONG),
        (f"<p>{LONG}</p><aside><article><p>{LONG}</p></article></aside>", LONG),
        (f"{MENU}<div class='cookie-banner'><p>{LONG}</p></div>", ""),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p></article><div hidden><article>{LONG}</article></div>", f"{LONG}"),
    ],
)
def test_marks_of_outer_parts_weigh_in_the_cut(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<p>{LONG}</p><div class='sidebar' data-x='{'x' * 5000} <p>LEAK</p>'><p>{LONG}</p></div>", LONG),
        (f'<p>{LONG}</p><p data-props="{{{"x" * 100_000} <b>}}">{LONG}</p>', f"{LONG}\n\n{LONG}"),
        (f"<p data-html=\"<div class='sidebar' style='display:none'>\">{LONG}</p>", LONG),
        (f"<div hidden='until-found'><p>{LONG}</p></div><p>{LONG}</p>", LONG),
        (f'<p class="a>{LONG}</p><p>{LONG}</p>', f"{LONG}\n\n{LONG}"),
        (f"<p title=it's>{LONG}</p><p>{LONG} It's.</p>", f"{LONG}\n\n{LONG} It's."),
        *((f"<p>{LONG}</p><{tag} data-x='a>b'/><p>{LONG}</p><{tag}>gone</{tag}>", f"{LONG}\n\n{LONG}") for tag in ("svg", "object", "template")),
        (f"<svg data-x='a>b'>gone</svg><title-bar>{LONG}</title-bar>", LONG),
    ],
)
def test_tags_with_long_values_and_empty_tags(page, text):
    assert main_text(page) == text
