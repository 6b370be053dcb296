"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.llm import (
    bpe,
    chat,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    language_id,
    mixing,
    prefix_trie,
    secret_ledger,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from turnout.llm.common import configure, stored

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{directory}/{name}.parquet")


def vocabulary_path() -> str:
    """The registered queries use an installed public vocabulary; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, directory: str) -> DataFrame:
    plan = mixing.planned(_table(spark, directory, "documents"))
    return plan.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


def op2_secrets(spark: SparkSession, directory: str) -> DataFrame:
    found = secret_ledger.scan(_table(spark, directory, "documents"))
    kinds = [r.name for r in secret_ledger.RULES]
    spans = found.withColumn("spans", secret_ledger.span_list(kinds))
    return spans.select(
        F.col("path").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2("spans", 256).alias("base_sha256"),
        "spans",
    )


def op3_embeddings(spark: SparkSession, directory: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, directory, "embeddings"))


def op4_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, directory, "labels")))


def op5_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, directory, "documents"))


def op6_sharding(spark: SparkSession, directory: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, directory, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.find_duplicates(_table(spark, directory, "documents"))


def op8_language(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op9_bpe(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    return bpe.round_trip(docs, bpe.Vocabulary(vocabulary_path())).drop("ids")


HARD_TEXT = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, directory: str) -> DataFrame:
    turns = _table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation that says what templates use as control strings.
    hard = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    formatted = chat.format_conversations(turns.unionByName(hard))
    read = chat.read_back(formatted).withColumn(
        "learned", chat.masked_text(F.col("formatted"), F.col("loss_mask"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the faults that op11 repairs, as its contract plants them by a checksum."""
    or_space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(or_space["conv_id"], F.lit(":"), or_space["turn"]).cast("binary")) % 20
    text = or_space["text"]
    hurt = turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(or_space["role"]).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )
    return hurt.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times", "col")


def op11_repair(spark: SparkSession, directory: str) -> DataFrame:
    turns = _table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    hurt = damaged(turns)
    plans = stored(conversation_repair.plan_repairs(hurt), "plans")
    digests = conversation_repair.repaired_digests(hurt, plans)
    counts = [c for c in plans.columns if c not in ("conv_id", "sequence", "audit")]
    every = turns.select("conv_id").distinct()
    for found in (plans.withColumnRenamed("conv_id", "of"), digests.withColumnRenamed("conv_id", "of")):
        every = every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return every.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Conversations that begin with turns of the first one of their hundred, as op12's contract asks."""
    most = 5
    own = sequences.select(
        "conv_id",
        "turns",
        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int").alias("h"),
    )
    heads = sequences.where("conv_id % 100 = 0").select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head")
    )
    nothing = F.array().cast(sequences.schema["turns"].dataType)
    return own.join(heads, "base", "left").select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
        ).alias("turns"),
    )


def op12_prefix_trie(spark: SparkSession, directory: str) -> DataFrame:
    turns = _table(spark, directory, "conversations")
    sequences = stored(prefix_trie.turn_sequences(turns), "turns")
    return prefix_trie.prefix_trie(rebuilt(sequences))


def op13_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    return token_counts.count_tokens(docs, bpe.Vocabulary(vocabulary_path()))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_secrets": op2_secrets,
        "op3_embeddings": op3_embeddings,
        "op4_toxicity": op4_toxicity,
        "op5_simhash": op5_simhash,
        "op6_sharding": op6_sharding,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_language": op8_language,
        "op9_bpe": op9_bpe,
        "op10_chat": op10_chat,
        "op11_repair": op11_repair,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_token_counts": op13_token_counts,
    }
