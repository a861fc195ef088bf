"""Whole licences, and notices that are neither a line nor a whole text."""

import random
import re
import textwrap
from fractions import Fraction

import pytest

from sparkloom.llm.licenses import BODIES, TEMPLATES, scan_licenses

DRAW = random.Random(5)
PROSE = "".join(" ".join("".join(DRAW.choices("abcdefghijklmnop", k=6)) for _ in range(22)) + "\n" for _ in range(9))
NAMES = sorted(f.stem for f in BODIES.glob("*.txt"))
HEADERS = {"Apache-2.0": TEMPLATES["Apache-2.0"][1], "GPL-3.0": TEMPLATES["GPL-3.0"][1]}


def scanned(spark, texts):
    return {(r.doc_id, r.unit): (r.license, r.dice) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_whole_licences_wrapped_at_80_columns(spark):
    texts = ["Copyright (c) 2020 Some One\n\n" + textwrap.fill((BODIES / f"{name}.txt").read_text(), 80) for name in NAMES]
    found = scanned(spark, texts)
    for k, name in enumerate(NAMES):
        assert found[k, 0][0] == name and found[k, 0][1] > 0.95


def test_licences_and_headers_inside_longer_documents(spark):
    short = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT"]
    inside = [(name, (BODIES / f"{name}.txt").read_text()) for name in short] + list(HEADERS.items())
    texts = [PROSE + textwrap.fill(text, 40) + "\n" + PROSE for _, text in inside]
    texts.append(PROSE + inside[3][1] + "\n" + PROSE * 9 + inside[2][1] + PROSE)  # two of them
    texts.append(PROSE.replace("\n", " ") + inside[3][1].replace("\n", " ") + PROSE.replace("\n", " "))  # within one line
    texts.append(PROSE)
    found = scanned(spark, texts)
    passages = {k: [(-unit, *v) for (d, unit), v in sorted(found.items(), reverse=True) if d == k and unit < 0] for k in range(len(texts))}
    for k, (name, _) in enumerate(inside):
        assert [p[:2] for p in passages[k]] == [(10, name)] and passages[k][0][2] > 0.95
    assert [p[:2] for p in passages[6]] == [(10, "MIT"), (10 + len(inside[3][1].split("\n")) + 81, "ISC")]
    assert [p[:2] for p in passages[7]] == [(1, "MIT")]
    assert not passages[8]


@pytest.mark.parametrize("text", [f"{PROSE}Released under the MIT License.\n{PROSE}", "Released under the MIT License."])
def test_a_line_of_its_own_is_no_passage(spark, text):
    assert [v[0] for v in scanned(spark, [text]).values()] == ["MIT"] and all(unit > 0 for _, unit in scanned(spark, [text]))


@pytest.mark.parametrize("small", ["ISC", "MIT", "BSD-2-Clause"])
def test_a_small_licence_after_a_large_one_is_found_too(spark, small):
    found = scanned(spark, [f"{(BODIES / 'GPL-3.0.txt').read_text()}\n\n{PROSE}{(BODIES / f'{small}.txt').read_text()}", (BODIES / "BSD-3-Clause.txt").read_text()])
    assert found[0, 0][0] == "GPL-3.0" and [v[0] for (d, unit), v in found.items() if d == 0 and unit < 0] == [small]
    assert [(unit, v[0]) for (d, unit), v in found.items() if d == 1] == [(0, "BSD-3-Clause")]


def passages_by_hand(text, templates, least=0.8):
    """(license, dice, first word, last word) of the passages, every place weighed and every pair of runs compared."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    pairs, found = list(zip(words, words[1:], strict=False)), []
    for name, body in templates:
        of = body.split()
        grams = set(zip(of, of[1:], strict=False))
        total, peak, first, last, runs = Fraction(0), Fraction(0), 0, 0, []
        weight, most = Fraction(str(least)), (2 - 2 * Fraction(str(least))) * len(grams)
        for i, pair in enumerate([*pairs, *[None] * (10 * len(pairs) + 10)]):
            total += (2 if pair in grams else 0) - weight
            if total <= 0 or peak - total > most:
                runs += [(first, last)] if peak > 0 else []
                total, peak, first = Fraction(0), Fraction(0), i + 1
            elif total > peak:
                peak, last = total, i
        for a, b in runs:
            own = set(pairs[a : b + 1])
            dice = 2 * len(own & grams) / (len(own) + len(grams))
            if dice >= least:
                found.append((-dice, -len(grams), name, a, b))
    kept = []
    for c in sorted(found):
        if all(c[4] + 1 < d[3] or d[4] + 1 < c[3] for d in kept):
            kept.append(c)
    return sorted((name, round(-under, 6)) for under, _, name, _, _ in kept)


def test_passages_equal_those_sought_by_hand(spark):
    draw = random.Random(8)
    vocabulary = [f"word{k}" for k in range(30)]
    templates = [(f"L{k}", " ".join(draw.choices(vocabulary, k=n))) for k, n in enumerate((6, 12, 30, 60))]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(1, 9)):
            words = draw.choice(templates)[1].split() if draw.random() < 0.6 else draw.choices([*vocabulary, "x", "y", "z"], k=draw.randrange(1, 70))
            parts += [w for w in words if draw.random() > 0.03]
        # nothing but passages: no line is a unit of its own, nor is the whole text
        texts.append(" ".join([*(f"u{k}" for k in range(400)), *parts]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in scan_licenses(frame, {name: (body,) for name, body in templates}).collect():
        assert r.unit == -1
        found.setdefault(r.doc_id, []).append((r.license, r.dice))
    by_hand = {k: passages_by_hand(x, templates) for k, x in enumerate(texts)}
    assert sum(map(len, by_hand.values())) > 150
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in by_hand.items() if v}


def test_a_text_of_megabytes(spark):
    mit, gpl = ((BODIES / f"{name}.txt").read_text() for name in ("MIT", "GPL-3.0"))
    wrapped = mit.replace(" ", "\n", 3)
    found = scanned(spark, [(wrapped + "\n" + PROSE) * 600, (gpl + "\n") * 40 + PROSE + wrapped + "\n"])
    passages = sorted(-unit for (d, unit) in found if d == 0)
    apart = (wrapped + "\n" + PROSE).count("\n")
    assert passages == [1 + k * apart for k in range(600)] and {v[0] for (d, _), v in found.items() if d == 0} == {"MIT"}
    assert {v[0] for (d, _), v in found.items() if d == 1} >= {"GPL-3.0", "MIT"}
