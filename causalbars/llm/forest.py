"""Nearest neighbours by a hash-prefix forest, searched block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.plans.staging import stage


def _planes(dims: int, trees: int, bits: int, seed: int) -> np.ndarray:
    """Random projections (trees, dims + 1, bits), alike wherever they are drawn."""
    return np.random.default_rng(seed).standard_normal((trees, dims + 1, bits)).astype(np.float32)


def _codes(points: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One hash string per tree and point: the signs of its projections, the first in the highest bit."""
    bits = planes.shape[2]
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint32)
    points = points.astype(np.float32)
    return np.stack([(points @ p > 0) @ weights for p in planes]).astype(np.uint32)


class PrefixForest:
    """Sorted arrays of hash strings, one per tree, over one block of vectors.

    Inner products become angles by one more coordinate, sqrt(M^2 - |x|^2) with M the longest vector of
    all, which is 0 for a query.  The sorted strings and their order are stored with the block.
    """

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, order: np.ndarray, planes: np.ndarray):
        self.vectors, self.sorted, self.order, self.planes = vectors, codes, order, planes
        self.bits = planes.shape[2]

    @staticmethod
    def build(vectors: np.ndarray, longest: float, planes: np.ndarray) -> PrefixForest:
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
        codes = _codes(np.column_stack([vectors, rest]), planes)
        order = np.argsort(codes, axis=1, kind="stable").astype(np.uint32)
        return PrefixForest(vectors, np.take_along_axis(codes, order, axis=1), order, planes)

    def _longest(self, codes: np.ndarray) -> np.ndarray:
        """For each query the longest prefix that it shares with a string of any tree: that of a neighbour in sorted order."""
        best = np.zeros(codes.shape[1], int)
        for held, asked in zip(self.sorted, codes, strict=True):
            at = np.searchsorted(held, asked)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(held) - 1)):
                other = (held[near] ^ asked).astype(np.float64)
                best = np.maximum(best, self.bits - np.frexp(other)[1])
        return best

    def _ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the run of the sorted array that shares ``depth`` leading bits."""
        shift = np.uint32(self.bits - depth)
        first = (codes >> shift) << shift
        last = first | np.uint32((1 << int(shift)) - 1)
        low = np.stack([np.searchsorted(s, f, "left") for s, f in zip(self.sorted, first, strict=True)])
        high = np.stack([np.searchsorted(s, f, "right") for s, f in zip(self.sorted, last, strict=True)])
        return low, high

    def products(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products to within rounding; many rows are not copied out first."""
        return (self.vectors @ query)[rows] if 4 * len(rows) > len(self.vectors) else self.vectors[rows] @ query

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int, fresh: float) -> Iterator[tuple[int, np.ndarray]]:
        """(query, rows met) when all trees ascend together, one bit at a time, from a query's longest match on.

        ``own`` is a query's own row in the block, or -1, which is no candidate.  A query goes on until it has met ``8 * k`` rows, and
        then until twice as many rows bring at most the share ``fresh`` of its ``k`` best that were not among them before.  If
        twice as many would be half of the block, it meets all of it.  So the number of candidates follows the data: few where neighbours are much
        nearer than others, up to all where they are not.
        """
        codes = _codes(np.column_stack([queries, np.zeros(len(queries))]), self.planes)
        start = self._longest(codes)
        n = len(self.vectors)
        every = np.arange(n)
        met = np.zeros((len(queries), n), bool)
        met[own >= 0, own[own >= 0]] = True
        base = np.full(len(queries), 4 * k)
        best: list[set] = [set()] * len(queries)
        waiting = np.arange(len(queries))
        # Where even a uniform tree has few matches, two bits at a time.
        near = int(np.log2(n)) + 1
        depths = [d for d in range(self.bits, -1, -1) if d <= near or (d - near) % 2 == 0]
        for depth in depths:
            whole = waiting[4 * base[waiting] >= n] if depth else waiting
            for q in whole.tolist():
                # The next step would be half of the block or more.
                yield q, np.delete(every, own[q]) if own[q] >= 0 else every
            waiting = np.setdiff1d(waiting, whole)
            active = waiting[start[waiting] >= depth]
            if not len(active):
                continue
            low, high = self._ranges(codes[:, active], depth)
            enough = (high - low).sum(axis=0) >= 2 * base[active]
            done = []
            for i, q in zip(np.flatnonzero(enough).tolist(), active[enough].tolist(), strict=True):
                runs = [self.order[t, low[t, i] : high[t, i]] for t in np.flatnonzero(high[:, i] > low[:, i])]
                if runs:
                    met[q, np.concatenate(runs)] = True
                rows = np.flatnonzero(met[q])
                rows = rows[rows != own[q]]
                if len(rows) < 2 * base[q]:
                    continue
                score = self.products(queries[q], rows)
                now = set(rows[np.argpartition(score, len(rows) - k)[len(rows) - k :]].tolist())
                gained = len(now - best[q])
                best[q], base[q] = now, len(rows)
                if gained > fresh * k:
                    continue
                yield q, rows
                done.append(q)
            waiting = np.setdiff1d(waiting, done)
            if not len(waiting):
                return


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Double precision, summed in the order of the components whatever else is computed with them."""
    total = np.zeros(len(vectors))
    for j, q in enumerate(query):
        total += vectors[:, j] * q
    return total


def nearest_in(
    forest: PrefixForest, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, fresh: float
) -> Iterator[tuple[int, list[int], list[float]]]:
    """For each query its id, and ids and scores of its k nearest among the candidates, ties to the smaller id."""
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids[order], own), len(ids) - 1)]
    row = np.where(ids[at] == own, at, -1)
    for q, rows in forest.candidates(queries, row, k, fresh):
        query = queries[q]
        # An id may stand in a block more than once, with other vectors.
        rows = rows[ids[rows] != own[q]]
        if len(rows) > k:
            rough = forest.products(query, rows)
            border = np.partition(rough, len(rough) - k)[len(rough) - k]
            rows = rows[rough >= border - 1e-9 * max(1.0, np.abs(rough).max())]
        score = inner_products(forest.vectors[rows], query)
        best = np.lexsort((ids[rows], -score))[:k]
        yield int(own[q]), ids[rows[best]].tolist(), score[best].tolist()


def usable(vector: Column) -> Column:
    """Neither null nor zero nor holding null or non-finite components."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    trees: int = 80,
    bits: int = 24,
    fresh: float = 0.05,
    rows_per_block: int = 8192,
    queries_per_block: int = 2048,
    partitions: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """The k nearest rows of each query by inner product: query_id, rank, vec_id, score.

    All rows are indexed: they are dealt to blocks of about ``rows_per_block``, and the index of a block (vectors, sorted hash strings
    of all trees) is built and stored once.  Each block of queries is sent to every index block, where a query meets as many
    rows as its own neighbours call for (``PrefixForest.candidates``), all of a small table; the best of all blocks are merged.
    Memory is set by the block sizes, and ``partitions`` (the session's number of shuffle partitions, if not given) by how many tasks share the work.

    Of equal vectors only the k + 1 smallest ids can be among anyone's nearest, so the others are left out of
    the index (not of the queries), which also splits a hot vector before the shuffle.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; vectors of different lengths
    have no inner product and do not meet; repeated rows count once; a query is never its own neighbour; an empty table has no result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_v"), is_query.alias("_q"))
    rows = rows.where(F.col("_id").isNotNull() & usable(F.col("_v"))).dropDuplicates(["_id", "_v"]).withColumn("_dims", F.size("_v"))
    rows = stage(rows, "vectors")
    same = Window.partitionBy("_v").orderBy("_id")
    indexed = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("_dims").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_block).alias("_blocks"),
        F.ceil(F.greatest(F.count_if("_q"), F.lit(1)) / queries_per_block).alias("_parts"),
        (F.max(norm) * (1 + 1e-9)).alias("_longest"),
    )
    sizes = stage(sizes, "vector-sizes")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(part: DataFrame, number: str, salt: int) -> DataFrame:
        deal = F.pmod(F.xxhash64("_id", F.lit(salt)), F.col(number)).cast("int")
        return part.select("_id", "_v", "_dims").join(sizes, "_dims").withColumn("_block", deal)

    def payload(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        ids = group.column("_id").to_numpy().astype("<i8")
        flat = group.column("_v").combine_chunks().flatten().to_numpy().astype("<f8")
        return group.column("_block")[0].as_py(), ids, flat.reshape(len(ids), -1)

    def build(group: pa.Table) -> pa.Table:
        block, ids, points = payload(group)
        dims = points.shape[1]
        forest = PrefixForest.build(points, group.column("_longest")[0].as_py(), _planes(dims, trees, bits, seed))
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (ids, points, forest.sorted, forest.order)]
        return pa.table([pa.array([dims], pa.int32()), pa.array([block], pa.int32()), *packed], ["_dims", "_block", "_ids", "_vectors", "_sorted", "_order"])

    def ask(group: pa.Table) -> pa.Table:
        part, ids, points = payload(group)
        columns = [pa.array([points.shape[1]], pa.int32()), pa.array([part], pa.int32()), pa.array([group.column("_blocks")[0].as_py()]), pa.array([ids.tobytes()]), pa.array([points.tobytes()])]
        return pa.table(columns, ["_dims", "_part", "_blocks", "_qids", "_qvectors"])

    def search(group: pa.Table) -> pa.Table:
        found = []
        for row in group.to_pylist():
            dims = row["_dims"]
            ids, own = np.frombuffer(row["_ids"], "<i8"), np.frombuffer(row["_qids"], "<i8")
            points, queries = (np.frombuffer(row[c], "<f8").reshape(-1, dims) for c in ("_vectors", "_qvectors"))
            codes, order = (np.frombuffer(row[c], np.uint32).reshape(trees, -1) for c in ("_sorted", "_order"))
            forest = PrefixForest(points, codes, order, _planes(dims, trees, bits, seed))
            found += nearest_in(forest, ids, queries, own, k, fresh)
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))]
        return pa.table(columns, ["query_id", "ids", "scores"])

    index = dealt(indexed, "_blocks", seed).groupBy("_dims", "_block")
    index = stage(index.applyInArrow(build, "_dims int, _block int, _ids binary, _vectors binary, _sorted binary, _order binary"), "index")
    asked = dealt(rows.where("_q"), "_parts", seed + 1).groupBy("_dims", "_block")
    asked = stage(asked.applyInArrow(ask, "_dims int, _part int, _blocks long, _qids binary, _qvectors binary"), "asked")
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)))
    pairs = index.repartition(n, "_dims", "_block").join(asked.repartition(n, "_dims", "_block").hint("shuffle_hash"), ["_dims", "_block"])
    best = (
        pairs.groupBy("_dims", "_block", "_part")
        .applyInArrow(search, "query_id bigint, ids array<bigint>, scores array<double>")
        .select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("_f"))
        .select("query_id", F.col("_f.ids").alias("vec_id"), F.col("_f.scores").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
