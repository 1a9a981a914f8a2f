"""Near-duplicates, components and repeated strings against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame
from pyspark.sql import functions as F

from causalbars.llm import graph, minhash, suffixes


def brute_groups(rows, width, percent):
    """(index of the row) -> smallest key of its group, by comparing all pairs of rows."""
    sets = [minhash.shingles_of(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                group[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i in range(len(rows)):
        key = rows[i][0]
        old = names.get(find(i))
        names[find(i)] = key if old is None else old if key is None else min(old, key)
    return [(len(sets[i]), names[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, docs, rows, width):
    pairs = [(r[0], r[1]) for r in rows]
    want = Counter((k, n, c, k == c) for (k, _), (n, c) in zip(pairs, brute_groups(pairs, width, 80), strict=True))
    got = minhash.near_duplicates(docs.withColumn("n_shingles", F.lit(0)), width=width, percent=80)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want


def near_copies(n, words, changes, seed):
    draw = np.random.default_rng(seed)
    base = [f"w{i}" for i in draw.integers(5000, size=words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in draw.choice(words, changes, replace=False):
            own[at] = f"x{draw.integers(10**6)}"
        out.append(" ".join(own))
    return out


def test_links_that_no_hub_sees_are_found(spark):
    """Copies whose similarity to each other scatters around the border."""
    texts = near_copies(60, 80, 4, 1) + near_copies(40, 60, 2, 2)
    pairs = list(enumerate(texts))
    got = minhash.near_duplicates(frame(spark, pairs, "doc_id bigint, text string"), width=2)
    want = brute_groups(pairs, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == dict(enumerate(want))


@pytest.mark.parametrize("worth", [0, 1])
def test_rounds_share_texts_and_components(spark, monkeypatch, worth):
    """Texts are stored once, not in each round, and links of a round join the components of the one before, which are stars already."""
    names = []
    for module in (minhash, graph):
        monkeypatch.setattr(module, "stage", lambda df, name, *a, put=module.stage, **k: names.append(name) or put(df, name, *a, **k))
    monkeypatch.setattr(minhash, "_WORTH", worth, raising=False)
    pairs = list(enumerate(near_copies(60, 80, 4, 1)))
    got = minhash.near_duplicates(frame(spark, pairs, "doc_id bigint, text string"), width=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == dict(enumerate(brute_groups(pairs, 2, 80)))
    assert names.count("compared") > 1
    assert names.count("texts") == 1
    assert len(names) < 40


def test_stars_take_one_step(spark, monkeypatch):
    names = []
    monkeypatch.setattr(graph, "stage", lambda df, name, *a, put=graph.stage, **k: names.append(name) or put(df, name, *a, **k))
    links = [(1, i) for i in range(2, 30)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.root for r in graph.components(frame(spark, links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 30)}, **{i: 100 for i in range(100, 130)}}
    assert names == ["links", "large-star"]


def test_members_that_cannot_be_linked_are_not_joined(spark):
    """Thirty variants share much that the hub has not, but too little for a link, and a near copy of the hub asks for little: no pair of variants."""
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    near = " ".join(base[:-1] + ["y"])
    variants = [" ".join(base[:60] + [f"c{i}" for i in range(8)] + [f"x{draw.integers(10**6)}" for _ in range(32)]) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([near, *variants])] + [(i, " ".join(base)) for i in range(100, 1100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = {r.doc_id: r.node for r in docs.withColumn("node", minhash._row_key("doc_id", "text")).collect()}
    hub = min(range(100, 1100), key=keys.get)
    chosen = [hub, *range(31)]
    assert keys[hub] == min(keys[i] for i in chosen)
    sizes = {i: len(minhash.shingles_of(t, 2)) for i, t in rows}
    members = spark.createDataFrame([(1, keys[i], sizes[i], keys[i]) for i in chosen], "band bigint, node bigint, n int, root bigint")
    held = docs.where(F.col("doc_id").isin(chosen))
    got = minhash._open_pairs(members, held, "doc_id", "text", 2, 80).collect()
    assert [r for r in got if keys[0] not in (r.x, r.y)] == []


def test_one_row_of_each_group_stays(spark, docs, rows):
    left = minhash.drop_near_duplicates(docs, width=2).collect()
    pairs = [(r[0], r[1]) for r in rows]
    groups = brute_groups(pairs, 2, 80)
    want = {c for n, c in groups if n} - {None}
    assert {r.doc_id for r in left if minhash.shingles_of(r.text, 2)} == want | {None}
    assert len([r for r in left if minhash.shingles_of(r.text, 2)]) == len({(c, c is None) for n, c in groups if n})
    assert len([r for r in left if not minhash.shingles_of(r.text, 2)]) == sum(not n for n, _ in groups)
    assert left[0].asDict().keys() == set(docs.columns)


def test_duplicates_of_an_empty_table(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(0)
    a = draw.integers(2**63, size=400).astype(np.uint64)
    b = np.concatenate([a[:320], draw.integers(2**63, size=80).astype(np.uint64)])
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 400]), 1024)
    assert abs((s[:, 0] == s[:, 1]).mean() - 320 / 480) < 0.05


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(1, 7)] + [(500, 500), (600, 601), (601, 600)]
    got = {r.node: r.root for r in graph.components(frame(spark, links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 1 for i in range(1, 8)}, 600: 600, 601: 600}
    assert graph.components(frame(spark, [], "a bigint, b bigint")).count() == 0


def brute_cut(rows, window):
    seen, out = set(), {}
    docs = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for key, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        if (key, text) in out:
            continue
        for p in range(len(raw) - window + 1):
            w = raw[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out[(key, text)] = (len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("window", [100, 40])
def test_cut_bytes_equal_brute_force(docs, rows, window):
    want = brute_cut([(r[0], r[1]) for r in rows], window)
    source = Counter((r[0], *want[(r[0], r[1])]) for r in rows)
    got = suffixes.remove_repeats(docs.withColumn("row", F.lit(1)), window=window)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == source


def test_short_periods_and_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_CHUNK", 1000)
    draw = np.random.default_rng(2)
    rows = [(i, "".join(draw.choice(list("ab"), 700)) if i % 2 else "abc" * 400 + "".join(draw.choice(list("xy"), 300))) for i in range(12)]
    rows += [(20, rows[1][1][100:600] + rows[3][1][50:300] + rows[0][1][1150:1300]), (21, "\u00e9" * 900)]
    got = suffixes.remove_repeats(frame(spark, rows, "doc_id bigint, text string"))
    want = brute_cut(rows, 100)
    assert {(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()} == {k: v for (k, _), v in want.items()}


def common_line():
    """A line shorter than the window in many documents, with other bytes around it; some passages stand twice."""
    draw = np.random.default_rng(9)
    line = "All rights are reserved by the owner of this page."
    rows = []
    for i in range(240):
        before, after = ("".join(draw.choice(list("abcdefgh "), 90)) for _ in range(2))
        rows.append((i, f"{before}{line}{after}"))
    rows += [(300 + i, f"new {i} {rows[i * 7][1][20:215]} end {i}") for i in range(30)]
    return rows + [(400 + i, rows[5][1][30:190] + "z" * i) for i in range(50)] + [rows[9], rows[9]]


def test_windows_of_a_hot_sample_meet_in_many_groups(spark, monkeypatch):
    """What one key of the last shuffle holds stays bounded, and the cuts stay exact."""
    monkeypatch.setattr(suffixes, "_HOT", 30, raising=False)
    rows = common_line()
    docs = frame(spark, rows, "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    assert got == {k: v for (k, _), v in brute_cut(rows, 100).items()}

    def sizes(window):
        def count(batches):
            seen = Counter()
            for batch in batches:
                seen.update(c for c, x in zip(batch.column("core").to_pylist(), batch.column("context").is_valid().to_pylist(), strict=True) if x)
            core, n = list(seen), list(seen.values())
            zero = pa.array([0] * len(core), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(n, pa.int64()), zero, zero], ["doc", "row", "a", "b"])

        return count

    monkeypatch.setattr(suffixes, "_resolve", sizes)
    assert 1 < max(r.row for r in suffixes.repeated_spans(docs).collect()) <= 30


def test_one_key_of_equal_windows_is_not_held(monkeypatch):
    monkeypatch.setattr(suffixes, "_HELD", 50, raising=False)
    n, window = 1000, 100
    whole = [np.full(n, 7), np.arange(n), np.arange(n) + 5, np.full(n, 3), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    batches = [suffixes._batch(*[c[i : i + 20] for c in whole], [b"q" * window] * 20) for i in range(0, n, 20)]
    out = pa.Table.from_batches(list(suffixes._resolve(window)(iter(batches))))
    assert sorted(out.column("doc").to_pylist()) == list(range(1, n))
    assert set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)) == {(3, 103)}


def test_sampling_holds_little_beside_its_text():
    """The least hashes of windows, taken in small blocks, are those of a plain search, and no table of the size of the text is made."""
    import tracemalloc

    draw = np.random.default_rng(11)
    lengths = np.array([150_000, 99, 100, 0, 300_000, 31, 350_000])
    data = draw.integers(97, 123, lengths.sum()).astype(np.uint8)
    data[200_000:260_000] = np.tile(data[200_000:200_050], 1200)
    starts, hashes = np.cumsum(lengths) - lengths, suffixes.PrefixHashes(data)
    tracemalloc.start()
    found = suffixes.anchors(hashes, starts, lengths, 100)
    assert tracemalloc.get_traced_memory()[1] < 12 * len(data)
    tracemalloc.stop()
    core = suffixes.mix64(hashes.of(np.arange(len(data) - 23), 24))
    cut = np.concatenate([np.arange(s, s + n - 99) for s, n in zip(starts, lengths, strict=True) if n >= 100])
    sample = cut + np.lib.stride_tricks.sliding_window_view(core, 77)[cut].argmin(axis=1)
    windows = np.concatenate([np.arange(s + a, s + b + 1) for s, a, b in zip(found.start, found.lo, found.hi, strict=True)])
    assert windows.tolist() == cut.tolist()
    assert np.repeat(found.start, found.hi - found.lo + 1).tolist() == sample.tolist()
    assert found.core.tolist() == core[found.start].tolist()


@pytest.mark.parametrize("common", [0, 3])
def test_only_windows_that_may_be_equal_are_sorted(monkeypatch, common):
    """Contexts of one sample that differ everywhere else: their windows have no equals and need no order."""
    sizes = []
    monkeypatch.setattr(suffixes, "suffix_merge_sort", lambda h, s, *rest, sort=suffixes.suffix_merge_sort: (sizes.append(len(s)), sort(h, s, *rest))[1])
    draw = np.random.default_rng(12)
    n, window, line = 500, 100, b"a line that all have here"
    context = [bytes(draw.integers(97, 123, 75).astype(np.uint8)) + line + bytes(draw.integers(97, 123, 75).astype(np.uint8)) for _ in range(n)]
    for i in range(common):  # the last hundred bytes again, behind other ones
        context[n - 1 - i] = context[n - 1 - i][:75] + context[i][75:]
    zero = np.zeros(n, np.int64)
    batch = suffixes._batch(np.full(n, 7), np.arange(n), np.arange(n), zero + 1000, zero - 75, zero, context)
    out = pa.Table.from_batches(list(suffixes._resolve(window)(iter([batch]))))
    assert sorted(zip(*[out.column(c).to_pylist() for c in ("doc", "a", "b")], strict=True)) == [(n - common + i, 1000, 1100) for i in range(common)]
    assert sum(sizes) < 38_000 / 4  # hashes that fall together let some through


def test_bits_follow_the_keys(spark, monkeypatch):
    """With more keys than a fixed table holds, a table of their size still tells most others apart."""
    from causalbars.llm import bits

    monkeypatch.setattr(bits, "BITS", 1 << 19)
    keys = spark.range(300_000).selectExpr("xxhash64(id) AS core")
    table = bits.bit_table(keys, bits.bits_for(300_000))
    assert table.has(keys.toPandas().core.to_numpy()).all()
    assert table.has(np.random.default_rng(3).integers(-(2**62), 2**62, 100_000)).mean() < 0.15
    assert bits.bits_for(10) == 1 << 19 and bits.bits_for(10**9) == 1 << 22


def test_nothing_to_cut(empty):
    assert suffixes.remove_repeats(empty).count() == 0


def test_merge_sort_orders_suffixes_by_hash_comparison():
    draw = np.random.default_rng(5)
    data = draw.integers(97, 100, 3000).astype(np.uint8)
    data[1500:2000] = data[200:700]
    hashes = suffixes.PrefixHashes(data)
    at = np.sort(draw.choice(2900, 600, replace=False))
    group = np.sort(draw.integers(0, 7, 600))
    order = suffixes.suffix_merge_sort(hashes, at, group, 50)
    raw = data.tobytes()
    want = sorted(range(600), key=lambda i: (group[i], raw[at[i] : at[i] + 50]))
    assert order.tolist() == want
