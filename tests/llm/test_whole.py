"""Sharding, mixing, packing, resampling and search: the whole table decides."""

import functools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import functions as F

from causalbars.llm import forest, mixing, packing, resampling, sharding

tokenizers = pytest.importorskip("tokenizers")
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 100, 101, 997, 1024, 1025])
def test_feistel_is_a_permutation(spark, n):
    rule = sharding.Feistel(n, seed=5)
    want = [rule.position_of(i) for i in range(n)]
    assert sorted(want) == list(range(n))
    got = rule.place(spark.range(n), "id", "p").orderBy("id").collect()
    assert [r.p for r in got] == want


def test_shards_are_even_gapless_and_computable(spark, docs):
    rows = sharding.shard_rows(docs.withColumn("Slot", F.lit("x")), ["doc_id", "text"], shards=4, seed=2).collect()
    n = len(rows)
    sizes = Counter(r.shard for r in rows)
    assert n == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    again = sharding.shard_rows(docs.repartition(5), ["doc_id", "text"], shards=4, seed=2).collect()
    assert Counter(map(str, ((r.doc_id, r.shard, r.slot) for r in rows))) == Counter(map(str, ((r.doc_id, r.shard, r.slot) for r in again)))
    rule = sharding.Feistel(n, 2)
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [rule.position_of(i) for i in range(1)] == [ordered[0].slot * 4 + ordered[0].shard]
    assert sharding.shard_rows(docs.where("false"), ["doc_id"]).count() == 0


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    sharded = sharding.shard_rows(docs, ["doc_id", "text"], shards=3)
    sharding.write_shards(sharded, str(tmp_path / "s"), buckets=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


def brute_targets(sizes, weights, most):
    """Sources in their order; a target stops at ``most`` times its size, and the excess is shared by the others."""
    left, opened, out = float(sum(sizes.values())), dict(zip(sizes, weights, strict=True)), {}
    while opened:
        rate = left / sum(opened.values())
        full = [s for s, w in opened.items() if rate * w > most * sizes[s]]
        out |= {s: float(most * sizes[s]) for s in full} if full else {s: rate * w for s, w in opened.items()}
        left -= sum(most * sizes[s] for s in full)
        opened = {s: w for s, w in opened.items() if s not in full} if full else {}
    return out


def test_targets_stop_and_are_reshared(spark):
    assert brute_targets({"a": 100, "b": 10, "c": 90}, (1, 2, 3), 3)["b"] == 30
    draw = np.random.default_rng(7)
    for sizes in ({"a": 100, "b": 10, "c": 90}, {f"s{i:03}": int(x) for i, x in enumerate(draw.integers(0, 10_000, 200) // draw.integers(1, 900, 200))}):
        table = frame(spark, list(sizes.items()), "source string, size int")
        got = mixing.mix_sources(table, F.array("source"), F.col("size"), F.col("source")).collect()
        want = brute_targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))], 3)
        assert {r.source: r.mix_target for r in got} == pytest.approx(want)


def test_fifty_thousand_sources(spark):
    rows = spark.range(150_000).select(F.concat(F.lit("s"), F.lpad(F.pmod("id", F.lit(50_000)).cast("string"), 5, "0")).alias("source"), (F.col("id") % 97 + 1).alias("size"), "id")
    began = time.time()
    got = mixing.mix_sources(rows, F.array("source"), F.col("size"), F.col("id")).select("source", "mix_size", "mix_target", "mix_taken").toPandas()
    assert time.time() - began < 60
    by_source = got.groupby("source").agg(size=("mix_size", "sum"), largest=("mix_size", "max"), target=("mix_target", "first"), taken=("mix_taken", "sum")).sort_index()
    want = brute_targets(by_source["size"].to_dict(), [(1, 2, 3)[i % 3] for i in range(50_000)], 3)
    np.testing.assert_allclose(by_source.target, [want[s] for s in by_source.index])
    assert ((by_source.taken - by_source.target).abs() <= by_source.largest).all()


def test_flow_repeats_only_when_nothing_unread_would_serve():
    patterns = {("a",): 10, ("a", "b"): 10, ("b",): 10}
    assert mixing.plan_flow(patterns, {"a": 20, "b": 10}, 3) == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    assert mixing.plan_flow(patterns, {"a": 40, "b": 0}, 3) == {("a",): 20, ("a", "b"): 20, ("b",): 0}
    assert sum(mixing.plan_flow(patterns, {"a": 5, "b": 55}, 3).values()) == 60


def test_mixture_comes_near_its_targets(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, 1 + i * 7 % 23) for i in range(3000)] + [(9999, "tiny", 3), (10000, "s1", None), (10001, None, 0)]
    table = frame(spark, rows, "doc_id int, source string, size int").withColumn("MIX_taken", F.lit("x"))
    got = mixing.mix_sources(table, F.array("source"), F.col("size"), F.col("doc_id")).collect()
    again = mixing.mix_sources(table.repartition(7), F.array("source"), F.col("size"), F.col("doc_id")).collect()
    assert {r.doc_id: r.mix_taken for r in got} == {r.doc_id: r.mix_taken for r in again}
    assert sum({r.source: r.mix_target for r in got}.values()) == pytest.approx(sum(r.mix_size for r in got))
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.mix_taken for r in own) - own[0].mix_target) <= max(r.mix_size for r in own)
        assert all(r.mix_taken in (0, r.mix_size, 2 * r.mix_size, 3 * r.mix_size) for r in own)
    tiny = next(r for r in got if r.source == "tiny")
    assert tiny.mix_taken == 9 == tiny.mix_target
    assert mixing.mix_sources(table.where("false"), F.array("source"), F.col("size"), F.col("doc_id")).count() == 0


def test_overlapping_sources_share_documents(spark):
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["b"] if i % 3 == 1 else None, 10) for i in range(600)]
    table = frame(spark, rows, "doc_id int, m array<string>, size int")
    got = mixing.mix_sources(table, F.col("m"), F.col("size"), F.col("doc_id"), weights=(1,)).collect()
    assert sum(r.mix_taken for r in got) == pytest.approx(4000, abs=10)
    assert all(r.mix_taken == 0 for r in got if r.m is None)


ODD = ["<|endoftext|>", "a<|endoftext|>\n<|endoftext|>b", "<|endoftext", "\n", "a\n\nb", "a  b", " a", "a ", "a \n", "\u00a0x\u00a0", "x\r\ny", "it's, he'll.", "a.b.c!?", "<|endoftext|> q", "", " ", "a\tb c\nd. E", "5.,z 5.", "\u2028a b"]


def test_encoder_equals_the_tokenizer(rows):
    plain = tokenizers.Tokenizer.from_file(str(TOKENIZER))
    texts = ODD + [r[1] or "" for r in rows]
    for words in (600_000, 10):
        encoder = packing.IdTable(str(TOKENIZER), words)
        for some in (texts, texts[::-1]):
            for text, ids in zip(some, encoder.encode(some), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize(("length", "windows", "merge"), [(2048, 64, 64), (64, 3, 2), (16, 1, 2)])
def test_pieces_rebuild_every_document(spark, docs, length, windows, merge):
    docs = docs.unionByName(spark.createDataFrame([(900, "two <|endoftext|><|endoftext|> tokens", "en", "s", 1)], docs.schema))
    got = packing.pack_documents(docs.withColumn("key", F.lit(1)), str(TOKENIZER), length=length, windows=windows, merge=merge, least=4).collect()
    plain = tokenizers.Tokenizer.from_file(str(TOKENIZER))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[(r.doc_id, zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    by_doc, by_sequence = {}, {}
    for r in got:
        assert len(r.token_ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        if len({p.start for p in pieces}) == len(pieces):  # the repeated row is told apart below
            pieces.sort(key=lambda p: p.start)
            assert want[(doc, zlib.crc32(b"".join(p.token_ids for p in pieces)))] == 1
    assert sum(r.length for r in got) == sum(n * w for (w, n) in ((r.doc_tokens, 1) for r in got if r.start == 0))
    padded = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        size = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        assert size <= length
        if size & (size - 1):
            padded += length - size
            assert length - size < 4
    assert packing.pack_documents(docs.where("false"), str(TOKENIZER)).count() == 0


def test_resampling_tells_target_text_from_the_rest(spark):
    draw = np.random.default_rng(1)
    good = [" ".join(draw.choice(["the", "of", "and", "river", "stone", "light", "a"], 60)) + "." for _ in range(300)]
    bad = [" ".join([f"W{draw.integers(9)}!!"] * 40) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(400, None), (401, ""), (None, "the river"), (5, good[5])]
    docs = frame(spark, rows, "doc_id bigint, text string").withColumn("KEPT", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 400, 2)] + [(None, 1), (1, None)], "doc_id bigint, quality int")
    got = {(r.doc_id, r.text): r.kept for r in resampling.select_quality(docs, labels).collect()}
    kept = [got[(i, t)] for i, t in rows[:400]]
    assert np.mean(kept[:300]) > 0.97 and np.mean(kept[300:]) < 0.05
    assert got[(400, None)] is False and got[(401, "")] is False
    assert resampling.select_quality(docs.where("false"), labels).count() == 0
    assert not any(r.kept for r in resampling.select_quality(docs, labels.where("false")).collect())


def test_all_labels_of_documents_decide_the_share(spark, monkeypatch):
    """Also those that the fit leaves out, and none of a document that is missing or has no word."""
    monkeypatch.setattr(resampling, "fit_importance", functools.partial(resampling.fit_importance, max_labelled=7))
    docs = frame(spark, [(i, f"word{i % 13} of {i}") for i in range(500)] + [(500, " "), (501, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 10 < 7)) for i in range(400)] + [(i, 0) for i in range(500, 900)], "doc_id bigint, quality int")
    assert resampling.select_quality(docs, labels).where("kept").count() == 350


def test_top_k_keeps_exactly_k(spark):
    scored = frame(spark, [(i, float(i % 97) + i / 1e4) for i in range(500)] + [(500, None)], "id int, gumbel_key double")
    for share in (0.0, 0.1, 0.333, 0.9, 1.0):
        assert resampling.keep_top(scored, share).where("kept").count() == round(share * 500)


def brute_nearest(points, k):
    out = {}
    for i, x in points:
        if i % 20 == 0:
            near = sorted({(-float(np.dot(y, x)), j) for j, y in points if j != i})
            out.setdefault(i, near[:k])
    return out


def test_forest_finds_nearly_all_neighbours(spark):
    draw = np.random.default_rng(4)
    points = [(i, (draw.standard_normal(16) * (1 + i % 3)).tolist()) for i in range(3000)]
    same = points[7][1]
    points += [(i, same) for i in range(3000, 3100)]
    extra = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [1.0, 2.0]), (None, same), points[20], points[20]]
    table = frame(spark, points + extra, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x"))
    got = {}
    for r in forest.nearest(table, F.col("vec_id") % 20 == 0, rows_per_block=700, queries_per_block=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(points, 20)
    assert set(got) == set(want)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21))
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near)
        hits += len({v for _, v, _ in near} & {v for _, v in want[q]})
    assert hits >= 0.95 * 20 * len(want)
    few = table.where("vec_id < 5")
    assert forest.nearest(few, F.col("vec_id") % 20 == 0).count() == 4
    assert forest.nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 21, 100, 500, 2000])
def test_forest_lists_are_full_at_every_size(spark, n):
    """Vectors without structure, the hardest case; small tables are met whole."""
    draw = np.random.default_rng(n)
    points = [(i, draw.standard_normal(32).tolist()) for i in range(n)]
    table = frame(spark, points, "vec_id bigint, embedding array<double>")
    got = {}
    for r in forest.nearest(table, F.col("vec_id") % 20 == 0, partitions=3).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: {v for _, v in near} for q, near in brute_nearest(points, 20).items() if near}
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    hits = sum(len(set(got[q]) & want[q]) for q in want)
    assert hits >= (1 if n <= 100 else 0.9) * sum(map(len, want.values()))


def test_forest_meets_few_rows_where_neighbours_are_near():
    draw = np.random.default_rng(1)
    points = (draw.standard_normal((400, 1, 32)) * 3 + 0.1 * draw.standard_normal((400, 20, 32))).reshape(-1, 32)
    planes = forest._planes(32, 80, 24, 0)
    built = forest.PrefixForest.build(points, float(np.linalg.norm(points, axis=1).max()), planes)
    asked = np.arange(0, 8000, 20)
    met, hits = 0, 0
    for q, rows in built.candidates(points[asked], asked, 10, 0.05):
        met += len(rows)
        score = points @ points[asked[q]]
        score[asked[q]] = -np.inf
        hits += len(set(np.argsort(-score)[:10]) & set(rows.tolist()))
    assert met < 0.35 * len(asked) * 8000 and hits >= 0.9 * 10 * len(asked)


def test_forest_keeps_vectors_of_every_length(spark):
    draw = np.random.default_rng(3)
    points = [(i, draw.standard_normal(4 if i % 3 else 7).tolist()) for i in range(120)]
    got = forest.nearest(frame(spark, points, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5, rows_per_block=16).collect()
    for q in range(0, 120, 20):
        same = [(i, x) for i, x in points if len(x) == len(points[q][1]) and i != q]
        want = sorted((-float(np.dot(x, points[q][1])), i) for i, x in same)[:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in want]


def plain_buckets(text, m, s):
    """N-gram buckets of a text by loops over its words."""

    def shape(w):
        w = re.sub(r"[^\W\d_]+", lambda r: "A" if r[0].isupper() else "a" if r[0].islower() else "Aa", w)
        return re.sub(r"([^\w\s])\1+", r"\1\1", re.sub(r"\d+", "0", w))

    def pair(x, y):
        return ((x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F) % (1 << 64)) >> 20

    words = text.split()
    hashes = [(zlib.crc32(w.lower().encode()), zlib.crc32(shape(w).encode())) for w in words]
    out = [h % m for h, _ in hashes] + [m + g % s for _, g in hashes]
    for i in range(1, len(words)):
        same = words[i] == words[i - 1]
        if not same:
            out.append(pair(hashes[i - 1][0], hashes[i][0]) % m)
        out.append(m + (0 if same else pair(hashes[i - 1][1], hashes[i][1]) % s))
    return out


def test_weights_equal_a_plain_count(spark):
    draw = np.random.default_rng(12)
    vocabulary = ["Alpha", "beta", "GAMMA", "d4", "x!!", "...", "é7", "mixedCase", "on", "on"]
    rows = [(i, " ".join(draw.choice(vocabulary, draw.integers(0, 40)))) for i in range(200)] + [(200, None)]
    rated = {i: int(i % 5 > 1) for i in range(0, 150)}
    docs, labels = frame(spark, rows, "doc_id bigint, text string"), spark.createDataFrame(list(rated.items()), "doc_id bigint, quality int")
    m, s = 20_000, 4_096
    raw, target = Counter(), Counter()
    for i, text in rows:
        for b in plain_buckets(text or "", m, s):
            raw[b] += 1
            target[b] += rated.get(i) == 1

    def log_share(counts, b):
        part = range(m) if b < m else range(m, m + s)
        return np.log((counts[b] + 1) / (len(part) + totals[id(counts), b < m]))

    totals = {(id(c), first): sum(n for b, n in c.items() if (b < m) == first) for c in (raw, target) for first in (True, False)}
    want = {i: sum(log_share(target, b) - log_share(raw, b) for b in plain_buckets(text, m, s)) if text else None for i, text in rows}
    got = {r.doc_id: r for r in resampling.select_quality(docs, labels).collect()}
    for i, weight in want.items():
        assert got[i].log_weight == (None if weight is None else pytest.approx(weight, abs=1e-9))
    keyed = sorted((r.gumbel_key for r in got.values() if r.gumbel_key is not None), reverse=True)
    worded = [i for i, w in want.items() if w is not None]
    share = np.mean([rated[i] for i in worded if i in rated])
    kept = {i for i, r in got.items() if r.kept}
    assert kept == {i for i in worded if got[i].gumbel_key >= keyed[round(share * len(worded)) - 1]}
