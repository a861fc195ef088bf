"""Quality rules as a short-circuit cascade.

Every rule rejects a text or lets it pass; a document is kept if all rules let it pass. The verdict
doesn't depend on the rules' order, the work does: each text stops at its first rejection. On a
random sample of all rows it is measured which rules reject together and what each statistic costs
that the rules read. The rules then run by rejections per cost, highest first, where a rule counts
the texts that those before it let pass, and pays for the statistics that they haven't computed.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.llm.common import SPACES

SYMBOLS = b"#*$%&|<>"
BULLETS = ("-".encode(), "*".encode(), "\u2022".encode())


class TextStats:
    """Statistics of one whole text, each computed at most once. A null text has none of anything."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes.split() splits at exactly the six blanks of WORD

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that the text holds at least twice, the first one included."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen, upto, total = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                total += i + 3 - max(upto, i)
                upto = i + 3
        return total

    @cached_property
    def n_bullet_lines(self) -> int:
        return sum(x.lstrip().startswith(BULLETS) for x in self.lines)

    @cached_property
    def n_top_word(self) -> int:
        """How often the most frequent word stands in the text."""
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_letter_words(self) -> int:
        """Words that hold a letter of any script."""
        return sum(any(map(str.isalpha, w.decode())) for w in self.words)


#: What each statistic is computed from.
NEEDS = {"n_words": ("words",), "n_repeat_words": ("words",), "n_dup_lines": ("lines",), "n_bullet_lines": ("lines",), "n_top_word": ("words",), "n_letter_words": ("words",)}


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a text that must go; `reads` are the statistics that it asks for."""

    name: str
    rejects: Callable[[TextStats], bool]
    reads: tuple[str, ...] = ()

    def statistics(self) -> tuple[str, ...]:
        """What it reads, each after what it is computed from."""
        return tuple(dict.fromkeys(x for s in self.reads for x in (*NEEDS.get(s, ()), s)))


def default_rules(min_words: int = 50, repeat_percent: int = 50, symbol_share: float = 0.1, dup_line_share: float = 0.4, word_length: tuple[float, float] = (2.5, 12.0)) -> tuple[Rule, ...]:
    return (
        Rule("too_few_words", lambda t: t.n_words < min_words, ("n_words",)),
        Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > repeat_percent * t.n_words, ("n_words", "n_repeat_words")),
        Rule("symbols", lambda t: t.n_symbols > symbol_share * t.n_words, ("n_words", "n_symbols")),
        Rule("repeated_lines", lambda t: t.n_dup_lines > dup_line_share * len(t.lines), ("n_dup_lines",)),
        Rule("word_length", lambda t: t.n_words > 0 and not word_length[0] <= t.word_chars / t.n_words <= word_length[1], ("n_words", "word_chars")),
    )


def shape_rules(bullet_percent: int = 90, top_word_percent: int = 30, letter_percent: int = 60) -> tuple[Rule, ...]:
    """Texts of list items alone, of one word over and over, or of numbers and signs; none of them judges a text without words."""
    return (
        Rule("bullets", lambda t: 100 * t.n_bullet_lines > bullet_percent * len(t.lines), ("n_bullet_lines",)),
        Rule("one_word", lambda t: 100 * t.n_top_word > top_word_percent * t.n_words, ("n_words", "n_top_word")),
        Rule("few_letters", lambda t: 100 * t.n_letter_words < letter_percent * t.n_words, ("n_words", "n_letter_words")),
    )


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 400) -> tuple[dict[int, int], dict[str, float]]:
    """(number of sampled texts by the rules that reject them, a bit each; seconds of each statistic and rule).

    Every row is sampled with the same chance, such that about `sample_rows` are; only sums reach the driver.
    """
    names = tuple(dict.fromkeys(s for r in rules for s in r.statistics()))

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, spent = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                stats, pattern = TextStats(text), 0
                for name in names:
                    began = time.perf_counter()
                    getattr(stats, name)
                    spent[name] += time.perf_counter() - began
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    pattern |= bool(rule.rejects(stats)) << k
                    spent[rule.name] += time.perf_counter() - began
                patterns[pattern] += 1
        rows = [(None, p, float(n)) for p, n in patterns.items()] + [(name, None, x) for name, x in spent.items()]
        what, pattern, x = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(pattern, pa.int64()), pa.array(x, pa.float64())], ["what", "pattern", "x"])

    count = docs.count()
    sampled = docs.select("text").sample(min(1.0, sample_rows / max(1, count)), seed=11)
    sums = sampled.mapInArrow(trial, "what string, pattern long, x double").groupBy("what", "pattern").agg(F.sum("x")).collect()
    return {p: int(x) for what, p, x in sums if what is None}, {what: x for what, _, x in sums if what is not None}


def ordered(rules: Sequence[Rule], patterns: dict[int, int], costs: dict[str, float]) -> tuple[Rule, ...]:
    """By rejections per second, highest first, of the texts that are left; as given where nothing was measured."""
    left, known, order = dict(enumerate(rules)), set(), []
    while left:

        def worth(k: int) -> float:
            rejected = sum(n for p, n in patterns.items() if p >> k & 1)
            return rejected / max(1e-9, costs.get(left[k].name, 0.0) + sum(costs.get(s, 0.0) for s in left[k].statistics() if s not in known))

        best = max(left, key=lambda k: (worth(k), -k))
        order.append(left.pop(best))
        known.update(order[-1].statistics())
        patterns = {p: n for p, n in patterns.items() if not p >> best & 1}
    return tuple(order)


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, features: Sequence[str] = (), sample_rows: int = 400) -> DataFrame:
    """All columns of `docs`, then `failed_rule` string (null if kept), `kept` boolean and the `features` asked for (long).

    The added names replace columns of the same name. A null text counts as empty, and is rejected
    by `too_few_words`. Repeated rows get the same verdict each; an empty table gives an empty one.
    Of the rules that would reject a text, `failed_rule` names the first in the measured order.
    """
    rules = tuple(default_rules() if rules is None else rules)
    rules = ordered(rules, *measured(docs, rules, sample_rows))
    carried = [c for c in docs.columns if c not in {"failed_rule", "kept", *features}]
    beside = [c for c in carried if c != "text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, extra = [], {f: [] for f in features}
            for text in batch.column(1).to_pylist():
                stats = TextStats(text)
                failed.append(next((r.name for r in rules if r.rejects(stats)), None))
                for f in features:
                    extra[f].append(getattr(stats, f))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed, pa.string()), pa.array([x is None for x in failed], pa.bool_()), *(pa.array(extra[f], pa.int64()) for f in features)],
                names=["row", "text", "failed_rule", "kept", *features],
            )

    frame = docs.select(F.struct(*(F.col(f"`{c}`") for c in beside) if beside else (F.lit(0).alias("_"),)).alias("row"), "text")
    schema = StructType([*frame.schema.fields]).add("failed_rule", "string").add("kept", "boolean")
    for f in features:
        schema = schema.add(f, "long")
    judged = frame.mapInArrow(judge, schema)
    return judged.select(*((F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in carried), "failed_rule", "kept", *features)
