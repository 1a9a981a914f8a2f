"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.llm.bits import bit_table, mix64
from causalbars.llm.graph import stars
from causalbars.plans.staging import stage

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = b" \t\n\x0b\x0c\r"
_KNOWN_WORDS = 150_000
_BATCH = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; ``bytes.split`` cuts at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles_of(text: str | None, width: int) -> set:
    """Distinct runs of ``width`` words; a shorter text is one shingle, one without words none."""
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(width)], strict=False))


class ShingleHasher:
    """64-bit hashes of a text's distinct shingles; shingles are told apart by their words, not by hashes."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        known, distinct = self.known, list(set(words))
        for w in distinct:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        hashed = np.fromiter(map(known.__getitem__, distinct), np.uint64, len(distinct))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        width = min(self.width, len(words))
        code = ids[: len(ids) - width + 1].copy()
        mixed = hashed[ids[: len(code)]] + np.uint64(width)
        for i in range(1, width):
            if len(distinct) ** 2 >= 1 << 62:
                raise ValueError("too many distinct words in one text")
            code = np.unique(code, return_inverse=True)[1] if i > 1 else code
            code = code * len(distinct) + ids[i : len(code) + i]
            mixed = mix64(mixed) + hashed[ids[i : len(mixed) + i]]
        return mix64(mixed[np.unique(code, return_index=True)[1]])


def signatures(hashes: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of several sets: (coordinates, sets).

    The first permutation is the hash of a shingle, cut to 32 bits and mixed.  The second, a fixed bijection of the 32-bit
    numbers, is used for every coordinate, each time shifted circularly by one more step: coordinate k is the
    smallest value of the permutation over (element + k * step) modulo 2^32.
    """
    x = hashes.astype(np.uint32)
    out = np.empty((coordinates, len(starts)), np.uint32)
    y, z = np.empty_like(x), np.empty_like(x)
    for k in range(coordinates):
        np.add(x, np.uint32((k * 0x9E3779B1) & 0xFFFFFFFF), out=y)
        for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
            np.right_shift(y, np.uint32(shift), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(factor), out=y)
        np.right_shift(y, np.uint32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        out[k] = np.minimum.reduceat(y, starts)
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band and set: (sets, bands)."""
    bands = len(signature) // rows
    out = np.empty((signature.shape[1], bands), np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[1], b + 1, np.uint64)
        for r in range(rows):
            h = mix64(h ^ signature[b * rows + r].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        out[:, b] = h
    return out.view(np.int64)


def _describe(width: int, bands: int, rows: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            sizes, digests, hashed = [], [], [None] * batch.num_rows
            waiting: list[tuple[int, np.ndarray]] = []
            total = 0

            def flush(waiting=waiting, hashed=hashed) -> None:
                if waiting:
                    sets = [h for _, h in waiting]
                    starts = np.cumsum([0] + [len(h) for h in sets[:-1]])
                    for (i, _), row in zip(waiting, band_hashes(signatures(np.concatenate(sets), starts, bands * rows), rows), strict=True):
                        hashed[i] = row.tolist()
                    waiting.clear()

            for i, text in enumerate(batch.column(2).to_pylist()):
                h = hasher.hashes(text)
                sizes.append(len(h))
                digests.append(hashlib.blake2b(np.sort(h).tobytes(), digest_size=16).digest() if len(h) else None)
                if len(h):
                    waiting.append((i, h))
                    total += len(h)
                    if total > _BATCH:
                        flush()
                        total = 0
            flush()
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(hashed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_key", "_n", "_digest", "_bands"])

    return describe


def _row_key(key: str, text: str) -> Column:
    """Tells rows apart by their key and text; equal rows are one."""
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))


def _with_texts(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``pairs`` (a, b, ...) of row keys with the texts _left and _right; pairs of one a come together.  ``docs`` has no row twice."""
    texts = docs.select(_row_key(key, text).alias("_row"), F.col(f"`{text}`").alias("_text"))
    return (
        pairs.join(texts.select(F.col("_row").alias("b"), F.col("_text").alias("_right")), "b")
        .join(texts.select(F.col("_row").alias("a"), F.col("_text").alias("_left")), "a")
        .select("a", "b", "_left", "_right", *[c for c in pairs.columns if c not in ("a", "b")])
    )


def _set_pairs(batch: pa.RecordBatch, width: int, held: list) -> Iterator[tuple[set, set]]:
    """The shingle sets of both sides; ``held`` keeps the last left one."""
    for a, left, right in zip(*[batch.column(i) for i in (0, 2, 3)], strict=True):
        if not held or a.as_py() != held[0]:
            held[:] = a.as_py(), shingles_of(left.as_py(), width)
        yield held[1], shingles_of(right.as_py(), width)


def _compared(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Each pair (a, b, ra, rb) of row keys and their roots with good: whether the full shingle sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            good = []
            for x, y in _set_pairs(batch, width, held):
                both = len(x & y)
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 4, 5)], pa.array(good, pa.bool_())], ["a", "b", "ra", "rb", "good"])

    return _with_texts(pairs.select("a", "b", "ra", "rb"), docs, key, text).mapInArrow(check, "a bigint, b bigint, ra bigint, rb bigint, good boolean")


_PARITY = 4  # words of 64 bits that sum up a member's differences


def _differences(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """For each pair (hub, node) ``elements``, hashes of the shingles that only one of them has, their ``parity`` and ``need``.

    Two members of one hub are similar enough if and only if they share at least the sum of their needs of these elements (an element
    that both lack, or both have beyond the hub): with t = percent / (100 + percent) and s shared elements, their sets share
    |hub| - |hub without x| - |hub without y| + s shingles, and a link asks for t * (|x| + |y|).  Needs are whole numbers, 2 * (100 + percent)
    times that.  Bit i of ``parity`` tells whether the number of elements that are i modulo 256 is odd: where the bits of two members
    differ, at least one of them has an element that the other has not.
    """

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            elements, parities, needs = [], [], []
            for hub, own in _set_pairs(batch, width, held):
                less, more = hub - own, own - hub
                hashed = [xxhash.xxh3_64_intdigest(b" ".join(e), seed) for seed, part in enumerate((less, more)) for e in part]
                hashed = np.array(hashed, np.uint64)
                elements.append(hashed.view(np.int64).tolist())
                odd = np.bincount((hashed % np.uint64(64 * _PARITY)).astype(np.int64), minlength=64 * _PARITY) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                needs.append(2 * percent * len(own) - (100 + percent) * (len(hub) - 2 * len(less)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(elements, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64())), pa.array(needs, pa.int64())], ["hub", "node", "elements", "parity", "need"])

    renamed = pairs.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return _with_texts(renamed, docs, key, text).mapInArrow(differ, "hub bigint, node bigint, elements array<bigint>, parity array<bigint>, need bigint")


_GUESSES = 8  # members of a bucket's largest component that each other member is compared with in a round
_WORTH = 0.05  # the share of a round's comparisons that must be exceeded by links for another round of guesses


def _ends(x: str, y: str) -> list[Column]:
    """Two members as a pair (x, nx, rx, y, ny, ry)."""
    return [F.col(f"{side}{c}").alias(f"{name}{end}") for side, end in ((x, "x"), (y, "y")) for c, name in (("node", ""), ("n", "n"), ("root", "r"))]


def _guesses(members: DataFrame, step: int) -> DataFrame:
    """(x, nx, rx, y, ny, ry): every member of a bucket that is not in its largest component, with some seeded members of that component.

    The bucket's hub is left out, since it met all of them.
    """
    members = members.where("node <> hub")
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(_GUESSES * step + i)).alias("t"), "node", "n")) for i in range(_GUESSES)]
    hubs = members.where("root = largest").groupBy("band").agg(F.array(*drawn).alias("_hubs"))
    taken = F.transform("_hubs", lambda h: F.struct(h["node"].alias("node"), h["n"].alias("n")))
    hubs = hubs.select("band", F.explode(F.array_distinct(taken)).alias("guess"))
    met = members.where("root <> largest").join(hubs, "band")
    return met.select(F.col("guess.node").alias("x"), F.col("guess.n").alias("nx"), F.col("largest").alias("rx"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"))


def _open_pairs(members: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(x, nx, rx, y, ny, ry): members of one bucket in different components, with their roots, enough pairs to find all their links or what follows from them.

    The hub of a bucket is its smallest node, with which its members were compared.  Two members whose needs add up to nothing are
    linked for certain; each such member is paired with the one of the least need, to which then both are linked.  All others
    must share elements of their differences from the hub.  Elements are put in order, rare ones first: a member
    with d elements that must share m of them has one in common with its partner among its first d - m + 1, so
    only those are joined, and elements that no other member has not at all.  What a pair must share, it cannot if too few elements come
    behind the first common one in either member, or if their parities differ in too many bits: the join leaves such pairs out.
    """
    scale = 2 * (100 + percent)
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"))
    rows = members.join(hubs, "band").where("node <> hub").select("hub", "node", "n", "root").distinct()
    rows = stage(rows, "open-members")
    told = stage(_differences(rows.select("hub", "node"), docs, key, text, width, percent), "differences")
    parity = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(_PARITY)]
    rows = rows.join(told.select("hub", "node", F.size("elements").alias("d"), "need", *parity), ["hub", "node"])
    least = rows.groupBy("hub").agg(F.min(F.struct("need", "node", "n", "root")).alias("_least"))
    rows = stage(rows.join(least, "hub"), "needs")
    certain = rows.where((F.col("need") + F.col("_least.need") <= 0) & (F.col("root") != F.col("_least.root")))
    certain = certain.select(_ends("", "_least."))

    each = told.select("hub", "node", F.size("elements").alias("_d"), F.explode("elements").alias("e"))
    common = stage(each.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"), "common-elements")
    # Elements of one member alone come first in the order; those after them are numbered from the end.
    shared = each.join(common, ["hub", "e"])
    place = F.row_number().over(Window.partitionBy("hub", "node").orderBy(F.desc("_c"), F.desc("e")))
    shared = shared.withColumn("_place", F.col("_d") - place + 1).join(rows, ["hub", "node"])
    must = F.greatest(F.ceil((F.col("need") + F.col("_least.need")) / scale), F.lit(1))
    kept = ["node", "n", "root", "need", "d", "after", *[f"p{i}" for i in range(_PARITY)]]
    shared = shared.withColumn("after", F.col("_d") - F.col("_place"))
    first = stage(shared.where(F.col("_place") <= F.col("_d") - must + 1).select("hub", "e", *kept), "first-elements")
    sides = [first.select("hub", "e", *[F.col(c).alias(f"{s}{c}") for c in kept]) for s in "xy"]
    sizes = 100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")
    # The first common element has all others behind it, so a pair that is linked meets there.
    need = F.col("xneed") + F.col("yneed")
    behind = need <= scale * (1 + F.least("xafter", "yafter"))
    apart = sum((F.bit_count(F.col(f"xp{i}").bitwiseXOR(F.col(f"yp{i}"))) for i in range(_PARITY)), F.lit(0))
    alike = 2 * need <= scale * (F.col("xd") + F.col("yd") - apart)
    sharing = sides[0].join(sides[1], ["hub", "e"]).where((F.col("xroot") < F.col("yroot")) & sizes & (need > 0) & behind & alike)
    return certain.unionByName(sharing.select(_ends("x", "y")).distinct())


def _members(docs: DataFrame, key: str, text: str, width: int, percent: int, bands: int, rows: int, star_rounds: int) -> DataFrame:
    """One row per document: _row, _key, _n and the _root of its component (null without shingles), stored."""
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    kind = docs.schema[key].dataType.simpleString()
    described = source.select(
        _row_key(key, text).alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")
    ).mapInArrow(
        _describe(width, bands, rows), f"_row bigint, _key {kind}, _n bigint, _digest binary, _bands array<bigint>"
    )
    described = stage(described, "signatures")
    # Equal sets have equal bands, so any of a class stands for it.
    classes = described.where("_n > 0").groupBy("_digest").agg(F.min("_row").alias("node"), F.max("_n").alias("n"), F.first("_bands").alias("_bands"))
    classes = stage(classes, "classes")
    firsts = classes.select("node", "n", F.explode("_bands").alias("band"))
    shared = firsts.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "n")).alias("_hub")).where("c > 1")
    members = firsts.join(shared, "band").select("band", "node", "n", F.col("_hub.node").alias("hub"), F.col("_hub.n").alias("hub_n"))
    members = stage(members, "buckets")
    texts = source.select(_row_key(key, text).alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    texts = texts.where(bit_table(members.select("node").distinct()).test()(F.col("_row"))).dropDuplicates(["_row"])
    texts = stage(texts.select("_key", "_text"), "texts")

    compared, roots = None, None
    step, last = 0, max(star_rounds, 1)
    while step <= last:
        if not step:
            hub = [F.col("hub").alias("x"), F.col("hub_n").alias("nx"), F.col("hub").alias("rx")]
            pairs = members.select(*hub, F.col("node").alias("y"), F.col("n").alias("ny"), F.col("node").alias("ry"))
        else:
            rooted = members.withColumn("root", F.lit(None).cast("long")) if roots is None else members.join(roots, "node", "left")
            rooted = rooted.withColumn("root", F.coalesce("root", "node"))
            # The hub met all members, so only buckets whose others are apart are open.
            sizes = rooted.where("node <> hub").groupBy("band", "root").agg(F.count(F.lit(1)).alias("_c"))
            mixed = sizes.groupBy("band").agg(F.max_by("root", F.struct("_c", "root")).alias("largest"), F.count(F.lit(1)).alias("_roots"))
            rooted = stage(rooted.join(mixed.where("_roots > 1").drop("_roots"), "band"), "open-buckets")
            if rooted.isEmpty():
                break
            pairs = _guesses(rooted, step) if step < last else _open_pairs(rooted.drop("hub"), texts, "_key", "_text", width, percent)
        possible = (F.col("x") != F.col("y")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        ends = [f("x", "y").alias(n) for f, n in ((F.least, "a"), (F.greatest, "b"))] + [f("rx", "ry").alias(n) for f, n in ((F.least, "ra"), (F.greatest, "rb"))]
        pairs = pairs.where(possible).select(*ends).distinct()
        if compared is not None and step == last:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        found = stage(_compared(stage(pairs, "pairs"), texts, "_key", "_text", width, percent), "compared")
        compared = found.select("a", "b") if compared is None else compared.unionByName(found.select("a", "b"))
        met, linked = found.agg(F.count(F.lit(1)), F.count_if("good")).first()
        if linked:
            links = found.where("good").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            roots = stars(links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        # Where guesses hardly link any more, what is left is told by differences.
        step = last if 0 < step < last and linked <= _WORTH * met else step + 1

    keyed = described.select("_row", "_key", "_n", "_digest").join(classes.select("_digest", "node"), "_digest", "left")
    if roots is not None:
        keyed = keyed.join(roots, "node", "left").withColumn("_root", F.coalesce("root", "node"))
    else:
        keyed = keyed.withColumn("_root", F.col("node"))
    return stage(keyed.select("_row", "_key", "_n", "_root"), "members")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 6,
    star_rounds: int = 4,
) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their ``width``-word shingle sets.

    Result: key, n_shingles, component_id (the smallest key reachable over links, a document's own included) and kept
    (key = component_id), one row per document.

    1. One pass over the texts gives set size, set digest and band hashes.  Documents with equal sets are one class, found
       by minima that are pre-aggregated; only class representatives go on.
    2. A bucket is a band hash that several classes have.  Instead of all pairs of a bucket, each member is paired with one
       hub; pairs with possible set sizes are verified on the full texts, and links merged to components.  In the next
       rounds, at most ``star_rounds`` in all, whoever is not in a bucket's largest component is compared with eight of that component, as
       long as that links many.  The texts of bucket members are stored once, and links join the components found before.  What is left are members of one bucket in different components.  Those
       pairs of them are verified that may be linked by how both differ from the hub (``_open_pairs``), so no
       link in a bucket is lost, and no bucket is joined with itself.
    3. A pair of similarity s shares no bucket with probability (1 - s^rows)^bands: 5e-6 at 0.8 for 40 bands of 6.

    Texts without words (null, empty) have no shingles and no links.  Null keys are linked by their texts but never name a
    component; a component of null keys alone has a null id and all of it is kept.  Repeated rows are linked with
    each other; an empty table has no result; other input columns are ignored.
    """
    keyed = _members(docs, key, text, width, percent, bands, rows, star_rounds)
    names = keyed.where("_root is not null").groupBy("_root").agg(F.min("_key").alias("_name"), F.count(F.lit(1)).alias("_size"))
    named = keyed.join(names.where("_size > 1"), "_root", "left")
    component = F.when(F.col("_size").isNotNull(), F.col("_name")).otherwise(F.col("_key"))
    return named.select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("_key").eqNullSafe(component)).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 6,
    star_rounds: int = 4,
) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``, that of the smallest key (nulls last), then row hash.

    Of a row that is in the table more than once one stays, unless it has no words.  Only rows that may go, or that are in
    the table more than once, are shuffled; all others are decided where they are read.
    """
    members = _members(docs, key, text, width, percent, bands, rows, star_rounds).where("_root is not null")
    order = F.struct(F.col("_key").isNull(), F.col("_key"), F.col("_row"))
    groups = members.groupBy("_root").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    decided = members.join(groups, "_root").select("_row", (F.col("_row") == F.col("_best")["_row"]).alias("_stays"))
    decided = decided.groupBy("_row").agg(F.max("_stays").alias("_stays"), F.count(F.lit(1)).alias("_times"))
    unsure = stage(decided.where("not _stays or _times > 1"), "decided")
    maybe = bit_table(unsure.select("_row")).test()
    rowed = docs.withColumn("_row", _row_key(key, text))
    asked = rowed.where(maybe(F.col("_row"))).join(unsure, "_row", "left")
    single = asked.where("_stays is null").drop("_stays", "_times")
    first = asked.where("_stays").drop("_stays", "_times").dropDuplicates(["_row"])
    return rowed.where(~maybe(F.col("_row"))).unionByName(single).unionByName(first).drop("_row")
