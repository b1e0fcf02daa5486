"""Registered queries: personal data, injection, grounding, masking, repetition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lang as lg
from tidemark.functions import text as tx
from tidemark.operators import safety as sf
from tidemark.operators import turns as tn
from tidemark.plans import inputs as src

PUBLIC_DOMAINS = ["example.ac.uk"]
PUBLIC_PHONES = ["0300 500"]


def pii_scrub(spark, d):
    # the strict form is the clean one with its postcodes masked, so a text is scrubbed once
    out = tx.computed(src.passages(spark, d), "doc_id", "text", clean=sf.scrub(F.col("text"), PUBLIC_DOMAINS, PUBLIC_PHONES))
    return out.select("doc_id", (F.col("clean") != F.col("text")).alias("changed"), F.md5("clean").alias("clean_md5"),
                      F.md5(sf.mask_postcodes(F.col("clean"))).alias("strict_md5"))


def pii_email_ni(spark, d):
    masked = sf.mask_emails(sf.mask_ni(F.col("text")), [])
    return src.passages(spark, d).select("doc_id", F.md5(masked).alias("masked_md5"), F.char_length(masked).alias("n_chars"))


def luhn_flag(spark, d):
    t = F.col("text")
    return src.passages(spark, d).select(
        "doc_id", F.size(sf.card_runs(t)).alias("runs"), F.size(sf.valid_cards(t)).alias("valid"))


def injection_scan(spark, d):
    hit = sf.passage_injection(F.col("text"))
    p = src.passages(spark, d).select(
        F.lit("passage").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"),
        hit["pattern"].cast("string").alias("pattern"), hit["match"].alias("match"))
    t = F.col("text")
    m = src.turns(spark, d).where("role = 'user'").select(
        F.lit("message").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"),
        sf.message_injection(t, lg.quick_or_english(t)).alias("pattern"), F.lit(None).cast("string").alias("match"))
    return p.unionByName(m)


def sanitise_split(spark, d):
    clean, dropped = sf.split_passages(src.passages(spark, d).select("doc_id", "text"), PUBLIC_DOMAINS)
    kept = clean.select("doc_id", F.lit("clean").alias("status"), F.lit(None).cast("bigint").alias("pattern"),
                        F.lit(None).cast("string").alias("match"))
    return kept.unionByName(dropped.select("doc_id", F.lit("dropped").alias("status"), F.col("pattern").cast("bigint"), "match"))


def grounding(spark, d):
    t, b = src.turns(spark, d), src.long_histories(spark, d)
    pairs = tn.previous_user_text(t, b).where("role = 'assistant'")
    return sf.grounding(pairs, "text", "asked").select("conv_id", "turn", "supported", "total", "passage_terms", "ratio", "weak")


def repetition_flag(spark, d):
    return sf.repetition(src.documents(spark, d).select("doc_id", "text"), "doc_id", "text")


def mask_tokens(spark, d):
    m = sf.protect(src.passages(spark, d).select("doc_id", "text"), "text")
    back = sf.restore(F.col("masked"), F.col("kept"))
    return m.select("doc_id", F.size("kept").alias("n_kept"), (back == F.col("text")).alias("restored"), F.md5("masked").alias("masked_md5"))


def sentence_pack(spark, d):
    packed = src.passages(spark, d).select("doc_id", F.posexplode(sf.pack_sentences(F.col("text"))).alias("pos", "piece"))
    return packed.select("doc_id", "pos", F.char_length("piece").alias("n_chars"), F.md5("piece").alias("piece_md5"))


def strip_parens(spark, d):
    t = F.col("text")
    out = sf.strip_asides(t, lg.quick_or_english(t))
    return src.passages(spark, d).select("doc_id", F.md5(out).alias("clean_md5"), F.char_length(out).alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    pii_scrub, pii_email_ni, luhn_flag, injection_scan, sanitise_split, grounding, repetition_flag, mask_tokens,
    sentence_pack, strip_parens)}
