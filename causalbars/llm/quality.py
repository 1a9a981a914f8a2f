"""Quality rules as a short-circuit cascade ordered by rejections per cost."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.llm.common import put

_SYMBOLS = "#*$%&|<>"
_NO_SYMBOL = str.maketrans("", "", _SYMBOLS)
_SPACES = " \t\n\x0b\x0c\r"
_NO_SPACE = str.maketrans("", "", _SPACES)
_SPACE = str.maketrans(_SPACES, " " * len(_SPACES))


@dataclass(frozen=True)
class Text:
    """A text and what the base statistics have already worked out about it."""

    text: str
    words: list[str]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text is refused; rules are independent, so their order changes cost only."""

    name: str
    rejects: Callable[[Text], bool]


def _many_symbols(t: Text) -> bool:
    return 10 * t.n_symbols > len(t.words)


def _odd_word_length(t: Text) -> bool:
    return not 2 * len(t.words) <= t.word_chars <= 15 * len(t.words)


def _duplicate_lines(t: Text) -> bool:
    return 10 * t.n_dup_lines > 6 * sum(1 for line in t.text.split("\n") if line.translate(_SPACE).strip(" "))


def _shouting(t: Text) -> bool:
    return 2 * sum(w.isupper() for w in t.words) > len(t.words)


def _few_letters(t: Text) -> bool:
    return 10 * sum(any(map(str.isalpha, w)) for w in t.words) < 7 * len(t.words)


def _one_word(t: Text) -> bool:
    return 100 * max(Counter(t.words).values(), default=0) > 30 * len(t.words)


def _exclamations(t: Text) -> bool:
    return 4 * sum(w[-1] == "!" for w in t.words) > len(t.words)


RULES = (
    Rule("many_symbols", _many_symbols),
    Rule("odd_word_length", _odd_word_length),
    Rule("duplicate_lines", _duplicate_lines),
    Rule("shouting", _shouting),
    Rule("few_letters", _few_letters),
    Rule("one_word", _one_word),
    Rule("exclamations", _exclamations),
)


def repeat_words(words: list[str]) -> int:
    """Words covered by three-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def describe(text: str | None) -> Text:
    text = text or ""
    spaced = text.translate(_SPACE)
    words = [w for w in spaced.split(" ") if w]
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.translate(_SPACE).strip(" "):
            seen.add(line)
    return Text(
        text, words, sum(map(len, words)), len(text) - len(text.translate(_NO_SYMBOL)), dups, repeat_words(words)
    )


def base_failed(t: Text, min_words: int, repeat_pct: int) -> bool:
    return len(t.words) < min_words or 100 * t.n_repeat_words > repeat_pct * len(t.words)


def rule_profile(docs: DataFrame, rules: Sequence[Rule], text: str, sample_rows: int, seed: int) -> dict[str, tuple[float, float]]:
    """Each rule's seconds and rejection rate on about ``sample_rows`` texts: {name: (cost, rate)}.

    Every row is drawn with the same probability where it is read, so no task gathers the sample.  Every rule runs on
    every sampled text inside the tasks; two sums per rule reach the driver.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, refused, rows = [0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for value in batch["_text"]:
                t = describe(value)
                rows += 1
                for i, rule in enumerate(rules):
                    start = time.perf_counter_ns()
                    refused[i] += bool(t.words and rule.rejects(t))
                    spent[i] += time.perf_counter_ns() - start
        yield pd.DataFrame({"rule": [r.name for r in rules], "spent": spent, "refused": refused, "seen": rows})

    fraction = min(1.0, sample_rows / max(docs.count(), 1))
    sampled = docs.select(F.col(f"`{text}`").alias("_text")).sample(fraction, seed)
    rows = (
        sampled.mapInPandas(measure, "rule string, spent bigint, refused bigint, seen bigint")
        .groupBy("rule")
        .agg(F.sum("spent").alias("spent"), F.sum("refused").alias("refused"), F.sum("seen").alias("seen"))
        .collect()
    )
    return {r.rule: (r.spent / 1e9 / max(r.seen, 1), r.refused / max(r.seen, 1)) for r in rows}


def cascade_order(rules: Sequence[Rule], profile: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejections per second first; rules that refused nothing go by cost."""

    def key(rule: Rule) -> tuple[float, float]:
        cost, rate = profile.get(rule.name, (0.0, 0.0))
        return (-rate / max(cost, 1e-12), cost)

    return sorted(rules, key=key)


def judge_quality(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    min_words: int = 50,
    repeat_pct: int = 50,
    sample_rows: int = 2000,
    seed: int = 0,
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and failed_rule.

    Base statistics are worked out for every whole text.  A text that passes the base runs through the cascade:
    rules in the order of rejections per cost, measured on a sample of about ``sample_rows`` rows, up to the first
    that refuses it.  The sample decides the order only: kept is the same for any order, while failed_rule, the
    rule that was met first, may differ between runs.

    A null or empty text has zero words and fails the base; repeated rows are judged alike; an empty table stays empty;
    input columns with the added names are replaced.
    """
    order = cascade_order(rules, rule_profile(docs, rules, text, sample_rows, seed))

    @F.pandas_udf(
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, failed_rule string"
    )
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            t = describe(value)
            failed = base_failed(t, min_words, repeat_pct)
            refused = "base" if failed else next((r.name for r in order if r.rejects(t)), None)
            out.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, refused is None, refused))
        return pd.DataFrame(out, columns=_COLUMNS)

    judged = docs.withColumn("_quality", judge(F.col(f"`{text}`")))
    return put(judged, **{c: F.col(f"_quality.{c}") for c in _COLUMNS}).drop("_quality")


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"]
