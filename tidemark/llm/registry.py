"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import classifier, decontaminate, line_dedup, main_text, nearest, ngram_join, phrases, pieces, pii, quality, runs, sharding, token_cache
from tidemark.llm.common import table
from tidemark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.verdicts(docs, F.col("doc_id"))
    return out.select(F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_cache.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), token_cache.fresh_cache(spark))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found_spans(table(spark, sf_dir, "documents"), F.col("doc_id"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("row").alias("doc_id"), *[count(k) for k in pii.KINDS], F.sha2(pii.joined_spans(F.col("base")), 256).alias("base_sha256"),
                        pii.joined_spans(F.col("spans")).alias("spans"), count("term"))


def op6_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), [F.col("doc_id")])


def op7_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed", listed.alias("listed")).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("listed", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op11_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op4_signature_trees": op4_signature_trees,
    "op7_block_rules": op7_block_rules,
    "op8_piece_lattice": op8_piece_lattice,
    "op6_nb_svm": op6_nb_svm,
    "op11_multiprobe_search": op11_multiprobe_search,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
    "op9_disclosure": op9_disclosure,
    "op2_spaced_seeds": op2_spaced_seeds, "op3_line_dedup": op3_line_dedup,
    "op1_best_fit_shards": op1_best_fit_shards, "op10_token_cache": op10_token_cache, "op5_quality_rules": op5_quality_rules,
}
