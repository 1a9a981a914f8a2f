"""Alignment of two tokenizers against a plain one that tokenizes whole texts."""

import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest

from causalbars.llm import alignment
from causalbars.llm.alignment import Fragment, Tokens, align_tokens, group_text, link_scores
from causalbars.llm.queries import piece_model_path, tokenizer_path
from causalbars.llm.words import ByteIds, PartTable, PieceIds, Ragged

PIECES = [" ", "\n", "a", "b", "The", "é", " ", "　", ".", ",", "'s", "12", "<|endoftext|>", "<s>", "\t", "  ", "😀", "漢字", "\x00", "\x1c", "\x85", "\r", "²", "thing", "onesen"]


@pytest.fixture(scope="module")
def encoders():
    return alignment.Encoders(tokenizer_path(), piece_model_path())


def brute(encoders, rows):
    """n_a, n_b, groups, and the scores of links of every row."""
    texts, out = [], []
    for _, text, *_ in rows:
        a = encoders.a.whole(f" {text}") if text else []
        b = encoders.b.model.encode(text) if text else []
        want = f" {text}".encode()
        if not text or encoders.a_text(a) != want or encoders.b_text(b) != want:
            texts.append(([], [], [], []))
            continue
        a_end = np.cumsum([encoders.a_size[i] for i in a]).tolist()
        b_end = np.cumsum([encoders.b_size[i] for i in b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            k, m = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        texts.append((a, b, groups, [(g[0][-1], g[1][-1]) for g in groups]))
    count = Counter(link for t in texts for link in t[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for (key, *_), (a, b, groups, links) in zip(rows, texts, strict=True):
        text = ";".join(group_text(*g) for g in groups)
        out.append((key, len(a), len(b), len(groups), len(links), text, sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)))
    return sorted(out, key=repr)


def found(docs, **options):
    aligned = align_tokens(docs, tokenizer_path(), piece_model_path(), **options)
    joined = aligned.join(link_scores(aligned), "_row", "left").fillna(0, ["n_best", "count_sum"])
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    return sorted((tuple(r[n] for n in names) for r in joined.collect()), key=repr)


def test_parts_encode_as_whole_texts():
    a, plain, b = ByteIds(tokenizer_path(), plain=True), ByteIds(tokenizer_path(), plain=False), PieceIds(piece_model_path())

    class Table(PartTable):
        def forget(self):
            super().forget()
            self.a, self.b = Ragged(np.int64), Ragged(np.int64)

        def learn(self, parts):
            self.a.append(a.encode(parts))
            self.b.append(b.encode(parts) if self.lead else [])

    draw = random.Random(2)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    led, bare = Table(" ", 2000), Table("", 2000)
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        codes, sizes = led.split(some)
        bare_codes, bare_sizes = bare.split(some)
        for text, c, d in zip(some, np.split(codes, np.cumsum(sizes)[:-1]), np.split(bare_codes, np.cumsum(bare_sizes)[:-1]), strict=True):
            assert led.a.take(c)[0].tolist() == a.whole(f" {text}")
            assert bare.a.take(d)[0].tolist() == a.whole(text)
            assert not text or led.b.take(c)[0].tolist() == b.model.encode(text)
    assert plain.whole("x<|endoftext|>") != a.whole("x<|endoftext|>")


def test_fragments_compose_in_any_order():
    draw = random.Random(5)

    def ends(n):
        return sorted(draw.sample(range(1, 60), n - 1)) + [60]

    for _ in range(300):
        a_end, b_end = ends(draw.randint(1, 20)), ends(draw.randint(1, 20))
        tokens = Tokens(list(range(len(a_end))), a_end, list(range(100, 100 + len(b_end))), b_end)
        parts = []
        cuts_a, cuts_b = sorted(draw.choices(range(len(a_end) + 1), k=5)), sorted(draw.choices(range(len(b_end) + 1), k=5))
        for s, e, t, u in zip([0, *cuts_a], [*cuts_a, None], [0, *cuts_b], [*cuts_b, None], strict=True):
            parts.append(Fragment.of(Tokens(tokens.a[s:e], a_end[s:e], tokens.b[t:u], b_end[t:u])))
        want = [group_text(*g) for g in tokens.groups()[0]]
        left = reduce(Fragment.__add__, parts)
        right = reduce(lambda x, y: y + x, reversed(parts))
        tree = (parts[0] + parts[1]) + ((parts[2] + parts[3]) + (parts[4] + parts[5]))
        for f in (left, right, tree):
            text, n, links = f.finish()
            assert text.split(";") == want and n == len(want) == len(links)


def test_alignment_equals_brute_force(spark, encoders, rows, docs):
    draw = random.Random(9)
    more = [(1000 + i, "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 60))), "en", "s", 1) for i in range(150)]
    more += [(2000, "mark ▁ of a space", "en", "s", 1), (2001, " ", "en", "s", 1), (2002, "<|endoftext|> and <s>", "en", "s", 1)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("groups", docs.lang)
    want = brute(encoders, rows + more)
    assert sum(w[1] == 0 for w in want) > 3
    assert found(table) == want
    # Ranges of 40 bytes: hundreds of fragments of one text, composed over several levels.
    short = [r for r in rows + more if len(r[1] or "") < 1000]
    assert found(table.where("length(text) < 1000 or text is null"), chunk=40, fan=3) == brute(encoders, short)


def test_long_text_in_ranges(spark, encoders):
    draw = random.Random(4)
    rows = [(1, "".join(draw.choice(["on\n", "on ", "the ", "x", "don't\n", "é "]) for _ in range(9000))), (2, "a b"), (2, "y" * 3000), (None, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(table, chunk=100, fan=4) == brute(encoders, rows)


def test_no_rows(empty):
    aligned = align_tokens(empty, tokenizer_path(), piece_model_path())
    assert aligned.count() == 0 and link_scores(aligned, broadcast_pairs=-1).count() == 0
