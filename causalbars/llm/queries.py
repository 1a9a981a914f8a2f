"""Queries over the given tables, one per operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import alignment, forest, minhash, mixing, oracles, packing, phrases, pii, quality, repair, resampling, sharding, suffixes, urls
from causalbars.llm.common import n_words, table
from causalbars.plans.staging import stage

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[f.__name__] = f
    sql = getattr(oracles, f.__name__.upper(), None)
    if sql:
        LLM_ORACLES[f.__name__] = sql
    return f


SHARDS = 8

#: The base rules, in the order of their statement.
URL_RULES = [
    urls.host_rule("block", "net/"),
    urls.host_rule("allow", "example.net/en/"),
    urls.host_rule("block", "example.com/de/"),
    urls.host_rule("allow", "org/fr/"),
]
#: Words of spam hosts and paths.
SPAM_WORDS = ["cheap-pills", "casino", "viagra", "free-money", "lottery", "adult", "xxx", "payday-loans", "replica-watches"]


@query
def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot in a seeded shuffle; only id, size and checksum are moved."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shard_rows(rows, ["doc_id", "text_crc32", "size"], SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url by the base rules, else by spam words."""
    rules = URL_RULES + [urls.word_rule("block", w) for w in SPAM_WORDS]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules).drop("url")


MIX_WEIGHTS = (1, 2, 3)


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = stage(docs, "mix-documents")
    mixed = mixing.mix_sources(docs, F.array("source"), F.col("size"), F.col("doc_id"), MIX_WEIGHTS)
    return mixed.select(
        "doc_id",
        "size",
        F.col("mix_pattern_size").alias("source_size"),
        F.round("mix_target", 6).alias("target"),
        F.col("mix_taken").alias("taken"),
        F.col("mix_repeats").alias("repeats"),
    )


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    base = pii.spans_text(F.filter(spans, lambda s: s["base"]))
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), pii.spans_text(spans).alias("spans")
    )


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the cascade's verdict."""
    judged = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text", "failed_rule")


SEQUENCE = 2048


def tokenizer_path() -> str:
    """The tokenizer file that the queries use; it is installed with its package on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place, and a checksum of its ids."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), length=SEQUENCE)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def piece_model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers on every document, and how common its links are."""
    aligned = alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path())
    digest = aligned.select(
        "_row",
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256)).alias("groups_sha256"),
    )
    return (
        digest.join(alignment.link_scores(aligned), "_row", "left")
        .drop("_row")
        .fillna(0, ["n_best", "count_sum"])
    )


@query
def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in benchmark passages of ten words, and the items they come from."""
    judged = phrases.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        "contaminated",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with seeded faults, told by a checksum of conversation and turn; nulls are one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(F.encode(name, "UTF-8")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fault.alias("_fault")
    ).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_copy", "_fault")


@query
def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after seeded damage."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = repair.repair_conversations(damaged(given))
    told = repaired.conversations.join(repair.digests(repaired.edits), "_c", "left").withColumnRenamed("conv_id", "_conv")
    every = given.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = F.col("_c").isNotNull()
    return every.select(
        "conv_id",
        *[F.when(found, F.col(c)).otherwise(0).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


@query
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance weight of every document and whether the Gumbel top-k keeps it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = resampling.fit_importance(docs, table(spark, sf_dir, "labels"))
    scored = stage(resampling.score_documents(docs, model).drop("text"), "importance")
    return resampling.keep_top(scored, resampling.good_share(scored, table(spark, sf_dir, "labels")))


@query
def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose vec_id is divisible by 20."""
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document by two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 100 that start earlier."""
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=100)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
