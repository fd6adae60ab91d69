"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.llm import byte_bpe, divergence, exact_dedup, fill_middle, line_dedup, lm_scoring, mixing, preference, quality_mil, quality_rules, sharding, simhash, warc
from loomtext.llm.common import documents


def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.scored(documents(spark, sf_dir))


def op2_quality_mil(spark, sf_dir):
    return quality_mil.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encoded(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, ids=False, digests=True)


def op4_preference(spark, sf_dir):
    talks = preference.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows = preference.formatted(preference.by_first_turn(talks))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    rows = rows.withColumn("chosen_spans", spans("chosen_spans")).withColumn("rejected_spans", spans("rejected_spans"))
    return rows.fillna({"rejected_id": -1, "rejected_completion": "", "rejected_spans": ""})


def op5_simhash(spark, sf_dir):
    return simhash.grouped(documents(spark, sf_dir))


def op6_quality_rules(spark, sf_dir):
    rows = quality_rules.judged(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_line_dedup(spark, sf_dir):
    rows = line_dedup.deduplicated(documents(spark, sf_dir))
    return rows.select("doc_id", F.coalesce(F.size("removed_lines"), F.lit(0)).alias("n_removed"), F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"), "removed_lines")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir), digest=True).drop("content_key")


def op9_sharding(spark, sf_dir):
    return sharding.shards(documents(spark, sf_dir))


def op10_mixing(spark, sf_dir):
    mix = mixing.sampled(documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op11_divergence(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))


def op12_warc(spark, sf_dir):
    return warc.archived(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_fill_middle(spark, sf_dir):
    rows = fill_middle.transformed(documents(spark, sf_dir))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}
