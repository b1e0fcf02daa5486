"""Cheap tests before a rule, one pass for many rules and direct token runs change no result."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import regex as rx
from tidemark.functions import text as tx
from tidemark.operators import scan
from tidemark.operators import turns as tn

RULES = [*[p for p, _ in rules.COURSE_BOOSTS], *[p for _, p in rules.FAMILY_BOOSTS], *[p for p, _ in rules.COURSES], rules.HAS_TOPIC,
         r"\b(?:" + "|".join(tn.ANCHOR_TERMS) + r")\b", r"\b(kit|sit|it)\b", r"\b(3d|k9+x|ab+)\b"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    parts = ["law", "Law", "LAW", "laws", "art", "fee", "Fee", "computer  science", "sport", "ſport", "Kit", "ıt", "İT", "sit", "3d", "é", "ŵ", "_", "-", "'",
             "1", " ", " ", " ", ".", "\n", " ", "　", "\U0001d4d0", "ß", "what", "SA1", "IT Services", "Moodle", "personal tutor", "£5", "a@b.c", "x/y"]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(0, 12))),) for _ in range(1500)]
    return spark.createDataFrame([*rows, (None,)], "text string").cache()


@pytest.mark.parametrize("unicode_words", [False, True])
@pytest.mark.parametrize("ignore_case", [False, True])
def test_rules_with_a_lead_match_the_same(texts, unicode_words, ignore_case):
    pairs = []
    for p in RULES:
        made = rx.compile_rule(p, unicode_words, ignore_case)
        assert made.startswith("(?=[")
        plain = made[made.index("(?iu)" if ignore_case else "(?:(?<="):]
        pairs.append(F.count_if(~F.col("text").rlike(made).eqNullSafe(F.col("text").rlike(plain))))
    assert sum(texts.agg(*[c.alias(f"c{i}") for i, c in enumerate(pairs)]).first()) == 0


def test_other_shapes_have_no_lead():
    for p in (r"\b(a?b|cd)\b", r"\b\w*(ll)\b", r"^(and|but)\b", r"\b(a|b)\b|c", r"\b([a|b]c|d)\b", r"\b(a|)\b", r"\b(x(y|z)|d)\b"):
        assert not rx.compile_rule(p).startswith("(?=[")


def test_a_mask_has_the_bits_of_its_rules(texts):
    some = [*RULES, r"\b(a?rt|cd)\b", "fee"]
    bits = sum((F.when(rx.matches(F.col("text"), p, True), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(some)), F.lit(0).cast("bigint"))
    got = texts.select(bits.alias("a"), tn.rule_mask(F.col("text"), some, True).alias("b"))
    assert got.where("a IS DISTINCT FROM b").count() == 0
    assert got.where("a > 0").count() > 100
    # one look for all word lists comes before them
    plan = texts.select(tn.rule_mask(F.col("text"), RULES, True))._jdf.queryExecution().optimizedPlan().toString()
    assert "l(?:aw" in plan


def test_token_runs_equal_the_split_forms(texts):
    text = F.col("text")

    def split(blank, gap, least=1):
        clean = F.regexp_replace(F.lower(text), blank, " ") if blank else F.lower(text)
        return F.filter(F.split(clean, gap), lambda t: F.char_length(t) >= least)

    kept = F.filter(split(r"[^\w\s£$€@.:/\-]", r"\s+", 3), lambda w: ~w.isin(*rules.KEYWORD_STOP))
    both = [(tx.latin_tokens(text), split(None, "[^a-zÀ-ÿŵŷ0-9]+")), (tx.word_runs(text), split(r"[^\wÀ-ɏ\s']", r"\s+")),
            (tx.scored_words(text), split(r"[^a-zÀ-ɏ\s']", r"\s+")), (tx.keywords(text, 9), F.slice(kept, 1, 9))]
    assert sum(texts.agg(*[F.count_if(~a.eqNullSafe(b)).alias(f"c{i}") for i, (a, b) in enumerate(both)]).first()) == 0


def test_documents_keep_postings_of_asked_words_only(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "c d"), (3, None)], "doc_id long, text string")
    only = spark.createDataFrame([("a",), ("d",)], "term string")
    packed = scan.pack(docs, "doc_id", tx.latin_tokens(F.col("text")), only=only)
    assert {tuple(r) for r in packed.document_frequency().collect()} == {("a", 1), ("d", 1)}
    assert (packed.n, packed.filled, packed.tokens) == (3, 2, 6)


def test_topic_texts_are_not_shuffled(spark):
    from tidemark.plans import inputs

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = inputs.topics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
