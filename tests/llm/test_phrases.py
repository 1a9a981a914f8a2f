"""Benchmark phrases against a plain search through all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from causalbars.llm import phrases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def windows_of(words, size):
    return {tuple(words[s : s + size]) for s in range(max(len(words) - size + 1, 1))} if words else set()


def brute(rows, items, size):
    out = []
    for key, text, *_ in rows:
        words, hit, names = words_of(text), set(), set()
        for item, item_text in items:
            for window in windows_of(words_of(item_text), size):
                for s in range(len(words) - len(window) + 1):
                    if tuple(words[s : s + len(window)]) == window:
                        hit.update(range(s, s + len(window)))
                        names.add(item)
        out.append((key, len(words), len(hit), sorted(str(n) for n in names if n is not None), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(8)
    vocabulary = ["the", "of", "a", "é", "Ünter", "straße", "x9", "ÉTÉ", "on", "42"]
    items = [(i, " ".join(draw.choice(vocabulary[:6]) for _ in range(draw.choice([1, 2, 3, 4, 5, 9])))) for i in range(14)]
    items += [(3, "the second of this id a b c"), (None, "no id of the a é"), (50, None), (51, ""), (52, "?!"), (53, items[0][1]), (54, "never seen words at all")]
    rows = []
    for i in range(60):
        text = " ".join(draw.choice(vocabulary) + draw.choice(["", ",", " -", "\n"]) for _ in range(draw.choice([0, 1, 5, 40])))
        if i % 3 == 0:
            text += f" {(draw.choice(items)[1] or '').upper()}."
        rows.append((i, text))
    rows += [(100, None), (101, ""), (None, items[2][1]), (5, rows[5][1]), (5, rows[5][1]), (102, "the of " * 3000)]
    return rows, items


def tables(spark, made):
    rows, items = made
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("term", F.lit("x")).withColumn("row", F.lit(1))
    return docs, spark.createDataFrame(items, "item_id bigint, text string").withColumn("window", F.lit(0))


@pytest.mark.parametrize("size,small", [(4, 500_000), (4, 0), (1, 500_000), (2, 500_000), (3, 0)])
def test_hits_and_items_equal_brute_force(spark, made, size, small):
    docs, items = tables(spark, made)
    rows = made[0] if size > 1 else [r for r in made[0] if r[0] != 102]
    if size == 1:
        docs = docs.where("doc_id is null or doc_id <> 102")
    got = phrases.decontaminate(docs, items, size=size, small=small)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, made[1], size)


def test_proximity_equals_brute_force(spark, made):
    rows, items = [r for r in made[0] if r[0] not in (5, 102, None)], made[1]
    docs, items_df = tables(spark, (rows, items))
    windows = phrases.item_windows(items_df, size=4)
    index = phrases.build_index(docs, windows.terms())
    heads = index.where("term = ''").select("row", "key")
    got = phrases.near_matches(index, windows, reach=3).join(heads, "row").join(windows.words, "window").select("key", "words", "at")
    rarity = {}
    for _, text in rows:
        for w in words_of(text):
            rarity[w] = rarity.get(w, 0) + 1
    want = set()
    for window in {w for _, t in items for w in windows_of(words_of(t), 4)}:
        terms = sorted(set(window), key=lambda w: (rarity.get(w, 0), window.index(w)))
        for key, text in rows:
            words = words_of(text)
            for at, w in enumerate(words):
                near = words[max(0, at - 3) : at + 4]
                if w == terms[0] and all(t in near for t in terms):
                    want.add((key, window, at + 1))
    assert len(want) > 20
    assert {(r.key, tuple(r.words), r.at) for r in got.collect()} == want and got.count() == len(want)


def test_empty_tables(spark, made):
    docs, items = tables(spark, made)
    assert phrases.decontaminate(docs.where("false"), items).count() == 0
    none = phrases.decontaminate(docs, items.where("false"))
    assert none.count() == len(made[0]) and none.where("contaminated or n_hit > 0 or size(items) > 0").count() == 0


def test_no_python_on_the_way(spark, made):
    docs, items = tables(spark, made)
    plan = phrases.decontaminate(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
