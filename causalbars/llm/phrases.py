"""Benchmark phrases in a corpus, by a positional inverted index; built-in functions only.

The index holds one posting (term, row, position) for each word of the corpus that a test item uses, sorted by term in each file, so
that a list is a few row groups of every file.  A window of test words starts from its rarest term: that list, moved by the term's
offset, gives possible starts, which the next rarest list cuts down, then all the others.  Every list is met by an
equi-join on (row, position, term), so a frequent term, window or document is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.llm.common import literal_table
from causalbars.plans.staging import stage

#: What separates words, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Term of the one posting at position 0 of every row, which holds its key and number of words.
_HEAD = ""


def _split(text: Column) -> Column:
    """An empty entry, then the words as written, then perhaps an empty entry."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def _lower(word: Column) -> Column:
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, else as it is, for Catalyst to decide by its size."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", small: int = 500_000) -> DataFrame:
    """Stored postings (term, row, pos, key, n_words) of all words of ``docs`` that are in ``terms`` (term, distinct).

    Positions count from 1.  Each row of ``docs`` also has one posting of the empty term at position 0, with its key and number of words.
    """
    wanted = _bounded(terms.select("term").unionByName(literal_table(docs.sparkSession, [F.struct(F.lit(_HEAD).alias("term"))])), small)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), _split(F.col(f"`{text}`")).alias("_words"), F.monotonically_increasing_id().alias("row"))
    n_words = F.size("_words") - F.when(F.element_at("_words", -1) == "", 2).otherwise(1)
    words = rows.select("row", "_key", n_words.cast("long").alias("_n"), F.posexplode("_words").alias("pos", "_word"))
    words = words.where((F.col("_word") != "") | (F.col("pos") == 0)).withColumn("term", _lower(F.col("_word")))
    first = F.col("pos") == 0
    postings = words.join(wanted, "term").select(
        "term", "row", "pos", F.when(first, F.col("_key")).alias("key"), F.when(first, F.col("_n")).alias("n_words")
    )
    return stage(postings.sortWithinPartitions("term"), "postings")


@dataclass
class ItemWindows:
    """``words``: window, size, words (each different word list once); ``members``: window, item of every window's items."""

    words: DataFrame
    members: DataFrame

    def terms(self) -> DataFrame:
        return self.words.select(F.explode("words").alias("term")).distinct()

    def lists(self, index: DataFrame, distinct: bool = False) -> DataFrame:
        """window, size, needed, rank, offset, term: a window's terms from the rarest on; windows with a term of no posting are left out.

        With ``distinct`` a window's repeated term is listed once.
        """
        count = index.where(F.col("term") != _HEAD).groupBy("term").agg(F.count(F.lit(1)).alias("_count"))
        each = self.words.select("window", "size", F.posexplode("words").alias("offset", "term"))
        if distinct:
            each = each.groupBy("window", "size", "term").agg(F.min("offset").alias("offset"))
        each = each.join(_bounded(stage(count, "term-counts"), 500_000), "term", "left")
        whole = Window.partitionBy("window")
        each = each.withColumn("needed", F.count(F.lit(1)).over(whole)).withColumn("_found", F.count("_count").over(whole))
        ranked = each.withColumn("rank", F.row_number().over(whole.orderBy("_count", "offset")))
        return stage(ranked.where("_found = needed").select("window", "size", "needed", "rank", "offset", "term"), "test-lists")


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = 10) -> ItemWindows:
    """All runs of ``size`` consecutive words of every item; an item of fewer words, but not none, is one window."""
    lowered = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    words = items.select(F.col(f"`{key}`").alias("item"), F.filter(_split(lowered), lambda w: w != "").alias("_w"))
    n = F.size("_w")
    starts = words.where(n > 0).select("item", "_w", F.explode(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))).alias("_s"))
    cut = stage(starts.select("item", F.slice("_w", F.col("_s"), size).alias("words")).distinct(), "item-windows")
    different = cut.select("words").distinct().withColumn("window", F.monotonically_increasing_id())
    different = stage(different.select("window", F.size("words").alias("size"), "words"), "windows")
    return ItemWindows(different, stage(cut.join(different, "words").select("window", "item"), "window-items"))


def exact_matches(index: DataFrame, windows: ItemWindows, small: int = 500_000) -> DataFrame:
    """Every occurrence of every window: window, size, row, start (position of its first word)."""
    lists = windows.lists(index)
    postings = index.where(F.col("term") != _HEAD).select("term", "row", "pos")

    def of(ranks: Column) -> DataFrame:
        return _bounded(lists.where(ranks), small)

    rarest = of(F.col("rank") == 1).select("term", "window", "size", "offset")
    starts = postings.join(rarest, "term").select("window", "size", "row", (F.col("pos") - F.col("offset")).alias("start"))
    starts = stage(starts.where("start > 0"), "starts-1")
    done = [starts.where("size = 1")]
    # The next rarest list: one posting of each start that goes on.
    second = lists.where("rank = 2").select("window", "offset", "term")
    wanted = starts.join(_bounded(second, small), "window").withColumn("pos", F.col("start") + F.col("offset"))
    lists_2 = postings.join(_bounded(second.select("term").distinct(), small), "term", "left_semi")
    starts = stage(wanted.join(lists_2, ["row", "pos", "term"], "left_semi").select("window", "size", "row", "start"), "starts-2")
    done.append(starts.where("size = 2"))
    # All other lists, of rows in which anything is left.
    wanted = starts.join(of(F.col("rank") > 2).select("window", "offset", "term"), "window")
    wanted = wanted.withColumn("pos", F.col("start") + F.col("offset"))
    rows = starts.where("size > 2").select("row").distinct()
    if rows.limit(small + 1).count() <= small:
        postings = postings.join(F.broadcast(rows), "row", "left_semi")
    met = wanted.join(postings, ["row", "pos", "term"]).groupBy("window", "size", "row", "start").agg(F.count(F.lit(1)).alias("_n"))
    done.append(met.where(F.col("_n") == F.col("size") - 2).drop("_n"))
    return stage(done[0].unionByName(done[1]).unionByName(done[2]), "matches")


def near_matches(index: DataFrame, windows: ItemWindows, reach: int = 20, small: int = 500_000) -> DataFrame:
    """Places where a window's words stand together in any order: window, row, at.

    ``at`` is a position of the window's rarest term that has every other term of the window within ``reach`` words before
    or behind it.  Positions are cut into ranges as wide as the reach, so each list is met by an equi-join.
    """
    lists = windows.lists(index, distinct=True)
    postings = index.where(F.col("term") != _HEAD).select("term", "row", "pos", F.floor(F.col("pos") / reach).alias("_range"))
    rarest = _bounded(lists.where("rank = 1"), small).select("term", "window", "needed")
    found = stage(postings.join(rarest, "term").select("window", "needed", "row", F.col("pos").alias("at")), "near-1")
    for step, ranks in enumerate(("rank = 2", "rank > 2"), 2):
        terms = lists.where(ranks).select("window", "term")
        here = F.floor(F.col("at") / reach)
        wanted = found.join(_bounded(terms, small), "window").withColumn("_range", F.explode(F.array(here - 1, here, here + 1)))
        met = wanted.join(postings, ["row", "term", "_range"]).where(F.abs(F.col("pos") - F.col("at")) <= reach)
        met = met.groupBy("window", "needed", "row", "at", "term").agg(F.lit(1).alias("_one"))
        met = met.groupBy("window", "needed", "row", "at").agg(F.count(F.lit(1)).alias("_n"))
        rest = met.where(F.col("_n") == (F.lit(1) if step == 2 else F.col("needed") - 2)).drop("_n")
        found = stage(found.where(F.col("needed") < step).unionByName(rest), f"near-{step}")
    return found.select("window", "row", "at")


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", size: int = 10, small: int = 500_000
) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, items (sorted as strings), contaminated.

    A word is hit if it stands inside an occurrence of a window of ``size`` consecutive words of an item (the whole item if it is
    shorter); ``items`` are the ids of items with an occurring window.  Words are runs of ASCII letters (lower-cased), digits and
    all characters beyond ASCII.

    Broadcasts are used for tables counted to at most ``small`` rows, and joins beyond.  A document's item ids are
    one list, as long as the benchmark at most.

    A null text has no words, and an item without words no window; rows equal to another are judged for themselves;
    items of equal id or text are joined; an item without an id hits words, but is not listed; empty tables give zeros or no
    rows; other columns are ignored.
    """
    windows = item_windows(items, item_key, "text", size)
    index = build_index(docs, windows.terms(), key, text, small)
    matches = exact_matches(index, windows, small)
    inside = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))
    hit = matches.select("row", inside.alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = matches.select("row", "window").distinct().join(_bounded(windows.members, small), "window")
    named = named.where("item is not null").select("row", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    heads = index.where(F.col("term") == _HEAD).select("row", "key", "n_words")
    out = heads.join(hit, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )
