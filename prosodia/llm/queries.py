"""The registered queries of this subpackage and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.llm import ann, decontaminate, guess_cost, hilbert, hmm, langid, mixing, ngram_join, prefix_trie, substring, token_ids, toxicity, va_file
from prosodia.llm.sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_table(_table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), "similarity")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id")) == 0
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(_table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(_table(spark, sf_dir, "documents"), width=20)
    return left.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = hilbert.shard_documents(_table(spark, sf_dir, "documents"), shards=8)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"), held_out=langid.fold(F.col("doc_id")) == 1)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return va_file.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    own = prefix_trie.turns(_table(spark, sf_dir, "conversations"))
    convs, rows = prefix_trie.grafted(own, base=conv - conv % 100, head=F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6)))
    return prefix_trie.trie(convs, rows)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return guess_cost.secrets(docs, guess_cost.lexicon(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_decontamination": op2_decontamination,
        "op3_language": op3_language,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_sharding": op6_sharding,
        "op7_toxicity": op7_toxicity,
        "op8_mixing": op8_mixing,
        "op9_multi_index": op9_multi_index,
        "op10_hmm": op10_hmm,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_secrets": op13_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
