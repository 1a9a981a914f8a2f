"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.llm.common import put
from causalbars.plans.series import numbered

_PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 .. n-1.

    A number is written as (left, right) on a grid of ``rows`` x ``cols`` cells, the smallest near-square
    one with n cells or more.  Each round adds a keyed function of one half to the other,
    modulo its range, which is a bijection of the grid.  A result outside 0 .. n-1 is permuted again
    until it falls inside (cycle walking), which is a bijection of 0 .. n-1.
    """

    n: int
    seed: int = 0
    rounds: int = 6

    @property
    def rows(self) -> int:
        return math.isqrt(max(self.n, 1) - 1) + 1

    @property
    def cols(self) -> int:
        return -(-max(self.n, 1) // self.rows)

    @property
    def keys(self) -> list[tuple[int, int, int]]:
        draw = random.Random(self.seed)
        return [tuple(draw.randrange(1, _PRIME) for _ in range(3)) for _ in range(self.rounds)]

    def position_of(self, number: int) -> int:
        """Where row ``number`` goes, computed without any data."""
        while True:
            left, right = divmod(number, self.cols)
            for i, (a, b, c) in enumerate(self.keys):
                x = (right if i % 2 == 0 else left) % _PRIME
                x = ((x * a + b) % _PRIME) ** 2 % _PRIME
                x = (x ^ (x >> 15)) * c % _PRIME
                if i % 2 == 0:
                    left = (left + x) % self.rows
                else:
                    right = (right + x) % self.cols
            number = left * self.cols + right
            if number < self.n:
                return number

    def once(self, number: str) -> str:
        """SQL of one pass over the grid for the BIGINT expression ``number``."""
        cell = f"named_struct('l', {number} div {self.cols}L, 'r', {number} % {self.cols}L)"
        for i, (a, b, c) in enumerate(self.keys):
            x = f"(s.{'r' if i % 2 == 0 else 'l'} % {_PRIME}L * {a}L + {b}L) % {_PRIME}L"
            x = f"transform(array({x}), x -> x * x % {_PRIME}L)[0]"
            x = f"transform(array({x}), x -> (x ^ shiftright(x, 15)) * {c}L % {_PRIME}L)[0]"
            new = (
                f"named_struct('l', (s.l + {x}) % {self.rows}L, 'r', s.r)"
                if i % 2 == 0
                else f"named_struct('l', s.l, 'r', (s.r + {x}) % {self.cols}L)"
            )
            cell = f"transform(array({cell}), s -> {new})[0]"
        return f"transform(array({cell}), s -> s.l * {self.cols}L + s.r)[0]"

    def place(self, df: DataFrame, number: str, name: str) -> DataFrame:
        """Adds ``name``, the permuted position of the BIGINT column ``number``.

        The first pass is plain arithmetic, one projection a step.  At most ``rows * cols - n`` numbers lie
        outside, so no walk is longer than that; it is evaluated only for the few rows that leave the
        range, about one in ``rows``.
        """
        x, left, right = F.col("_x"), F.col("_left"), F.col("_right")
        df = df.withColumns({"_left": F.expr(f"{number} div {self.cols}L"), "_right": F.col(number) % self.cols})
        for i, (a, b, c) in enumerate(self.keys):
            df = df.withColumn("_x", ((right if i % 2 == 0 else left) % _PRIME * a + b) % _PRIME)
            df = df.withColumn("_x", x * x % _PRIME)
            df = df.withColumn("_x", x.bitwiseXOR(F.shiftright(x, 15)) * c % _PRIME)
            if i % 2 == 0:
                df = df.withColumn("_left", (left + x) % self.rows)
            else:
                df = df.withColumn("_right", (right + x) % self.cols)
        df = df.withColumn("_x", left * self.cols + right)
        outside = max(self.rows * self.cols - self.n, 1)
        walk = f"aggregate(sequence(1, {outside}), _x, (x, i) -> if(x < {self.n}L, x, {self.once('x')}))"
        return df.withColumn(name, F.expr(f"if(_x < {self.n}L, _x, {walk})")).drop("_x", "_left", "_right")


def shard_rows(docs: DataFrame, order: list[str], shards: int = 8, seed: int = 0) -> DataFrame:
    """Deal all rows to ``shards`` shards in a reproducible random order: adds shard and slot.

    Rows are numbered in the order of ``order`` (a unique key, or the key and columns that tell its rows apart),
    the number is permuted, and position p is slot ``p div shards`` of shard ``p mod shards``:
    row counts of any two shards differ by one at most, slots are gapless from 0,
    and ``Feistel(n, seed).position_of(number)`` finds a row's place without reading data.

    Nulls sort first; equal rows get different slots, in either order; an empty table stays empty;
    input columns named shard or slot are replaced.
    """
    rows = numbered(docs, order, "_number")
    rule = Feistel(rows.count(), seed)
    placed = rule.place(rows, "_number", "_place")
    place = F.col("_place")
    return put(placed, shard=(place % shards).cast("int"), slot=F.expr(f"_place div {shards}")).drop("_number", "_place")


def write_shards(sharded: DataFrame, path: str, buckets: int = 1) -> None:
    """Write one folder per shard, each in the order of its slots; a shard is cut into ``buckets`` runs of slots."""
    run = F.col("slot") % F.lit(buckets)
    n = sharded.select("shard").distinct().count() * buckets
    (
        sharded.withColumn("_run", run)
        .repartition(max(n, 1), "shard", "_run")
        .sortWithinPartitions("shard", "slot")
        .drop("_run")
        .write.partitionBy("shard")
        .parquet(path)
    )
