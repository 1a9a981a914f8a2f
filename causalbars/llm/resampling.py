"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalbars.llm.common import put
from causalbars.plans.quantiles import exact_quantiles
from causalbars.plans.staging import stage

_SHAPE = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))
_KNOWN_WORDS = 150_000


class NgramHasher:
    """Buckets of a text's n-grams.

    Words give unigrams and bigrams in ``word_buckets`` buckets.  Their shapes (runs of capitals, small letters, digits,
    the marks themselves) give unigrams and bigrams in ``shape_buckets`` more; a word equal to the one before it
    is one bigram, whatever the word.
    """

    def __init__(self, word_buckets: int, shape_buckets: int):
        self.word_buckets, self.shape_buckets = word_buckets, shape_buckets
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        shape = word
        for pattern, by in _SHAPE:
            shape = pattern.sub(by, shape)
        return zlib.crc32(word.lower().encode("utf-8", "replace")) << 32 | zlib.crc32(shape.encode("utf-8", "replace"))

    def buckets(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, np.int64)
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self._hash(w)
        both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        same = word[1:] == word[:-1]
        m, s = np.uint64(self.word_buckets), np.uint64(self.shape_buckets)
        pairs = _pair(word)[~same] % m
        shapes = _pair(shape)
        shapes[same] = 0
        parts = (word % m, pairs, m + shape % s, m + shapes % s)
        return np.concatenate(parts).astype(np.int64)

    @property
    def size(self) -> int:
        return self.word_buckets + self.shape_buckets


def _pair(h: np.ndarray) -> np.ndarray:
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return x >> np.uint64(20)


@dataclass(frozen=True)
class ImportanceModel:
    """Log ratio of the target's and the raw text's bucket probabilities."""

    log_ratio: np.ndarray
    word_buckets: int
    shape_buckets: int


def _rated(labels: DataFrame, key: str, good: str) -> DataFrame:
    """(_key, _good): one row per labelled key."""
    rated = labels.where(F.col(f"`{good}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    return rated.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(F.col(f"`{good}`")).cast("int").alias("_good"))


def fit_importance(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    good: str = "quality",
    word_buckets: int = 20_000,
    shape_buckets: int = 4_096,
    max_labelled: int = 20_000,
    smoothing: float = 1.0,
    seed: int = 0,
) -> ImportanceModel:
    """Count n-grams of the whole corpus (raw) and of its labelled good documents (target) in one pass.

    At most ``max_labelled`` labelled documents, chosen by a seeded hash, train the target; their ids are what is broadcast.
    The raw counts cover all documents.  A task sends one row per bucket, and the driver gets one row per bucket in all.
    """
    chosen = _rated(labels, key, good).orderBy(F.xxhash64("_key", F.lit(seed)), "_key").limit(max_labelled)
    chosen = stage(chosen, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NgramHasher(word_buckets, shape_buckets)
        raw, target = np.zeros(hasher.size, np.int64), np.zeros(hasher.size, np.int64)
        for batch in batches:
            for value, label in zip(batch.column(0), batch.column(1), strict=True):
                found = np.bincount(hasher.buckets(value.as_py() or ""), minlength=hasher.size)
                raw += found
                if label.as_py() == 1:
                    target += found
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(hasher.size)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    seen = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_key", "left")
    rows = (
        seen.select("_text", "_good")
        .mapInArrow(count, "bucket bigint, raw bigint, target bigint")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()
    )
    raw, target = np.full(word_buckets + shape_buckets, smoothing), np.full(word_buckets + shape_buckets, smoothing)
    for r in rows:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    parts = (slice(0, word_buckets), slice(word_buckets, None))
    ratio = np.concatenate([np.log(target[p] / target[p].sum()) - np.log(raw[p] / raw[p].sum()) for p in parts])
    return ImportanceModel(ratio, word_buckets, shape_buckets)


def good_share(scored: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality") -> float:
    """Share of good ones among all labelled documents of ``scored`` that have a word; 0 without any.

    Every label counts once, however many there are: ``max_labelled`` bounds the fit, not this.
    """
    worded = scored.where("log_weight is not null").select(F.col(f"`{key}`").alias("_key"))
    share = _rated(labels, key, good).join(worded, "_key", "left_semi").agg(F.avg("_good")).first()[0]
    return 0.0 if share is None else float(share)


def log_weight(model: ImportanceModel, text: Column) -> Column:
    """Sum of a text's n-gram log ratios; null without any word."""
    ratio, sizes = model.log_ratio, (model.word_buckets, model.shape_buckets)

    def score(buckets: np.ndarray) -> float | None:
        return float(ratio[buckets].sum()) if len(buckets) else None

    @F.pandas_udf("double")
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = NgramHasher(*sizes)
        for batch in texts:
            yield pd.Series([score(hasher.buckets(t or "")) for t in batch], dtype="float64")

    return weigh(text)


def score_documents(docs: DataFrame, model: ImportanceModel, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Adds log_weight and gumbel_key = log_weight + Gumbel noise drawn from a seeded hash of the key."""
    half = F.xxhash64(F.col(f"`{key}`"), F.lit(seed)).bitwiseAND((1 << 52) - 1) + 0.5
    noise = -F.log(-F.log(half / (1 << 52)))
    scored = put(docs, log_weight=log_weight(model, F.col(f"`{text}`")))
    return put(scored, gumbel_key=F.col("log_weight") + noise)


def keep_top(scored: DataFrame, share: float) -> DataFrame:
    """Adds kept: the Gumbel top-k, k being ``share`` of the documents that have a key.

    Adding Gumbel noise to log weights and taking the k largest draws k documents without replacement with
    probabilities in proportion to their weights.  The k-th key is found by exact distributed quantiles; documents that tie with
    it are all kept; documents without a word have no key and are not.  Pass a staged table: it is read several times.
    """
    n = scored.where("gumbel_key is not null").count()
    k = min(n, max(0, round(share * n)))
    if k == 0:
        return put(scored, kept=F.lit(False))
    if k == n:
        return put(scored, kept=F.col("gumbel_key").isNotNull())
    level = (F.lit(float(n - k)) - 0.5) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    border = exact_quantiles(scored.select("gumbel_key"), [], "gumbel_key", {"border": level}).first()["border"]
    return put(scored, kept=F.coalesce(F.col("gumbel_key") >= F.lit(border), F.lit(False)))


def select_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Documents with log_weight, gumbel_key and kept, as many kept as the labels' share of good ones.

    Nulls: a null text has no words and is not kept; a null key gets the noise of its hash; labels with a null key or
    rating or without a document that has a word don't count, and with none at all nothing is kept.  Repeated rows get equal keys.  An empty table stays
    empty; input columns with the added names are replaced.
    """
    model = fit_importance(docs, labels, key, text, seed=seed)
    scored = stage(score_documents(docs, model, key, text, seed), "importance")
    return keep_top(scored, good_share(scored, labels, key))
