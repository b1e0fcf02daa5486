"""An ordered scrub works each of its steps out once and leaves texts without a match as they are."""

from pyspark.sql import functions as F

from tidemark.functions import regex as rx
from tidemark.operators import safety
from tidemark.plans import safety as plans


def test_pii_scrub_masks_a_text_once(spark, sf):
    plan = plans.pii_scrub(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[NI-NUMBER]") == 1 and plan.count("[PHONE]") == 1


def test_shortest_matches_and_texts_without_one(spark):
    rows = ["AB123456C", "4111111111111111", "a@b.co", "01632 960123", "student id 1234567", "SA18EW sw1a\n1aa", "plain 123 text", "", None]
    t = F.col("t")
    out = spark.createDataFrame([(r,) for r in rows], "t string").select(safety.scrub(t, [], postcodes=True).alias("s"))
    assert [r.s for r in out.collect()] == ["[NI-NUMBER]", "[CARD-NUMBER]", "[EMAIL]", "[PHONE]", "[STUDENT-ID]", "[POSTCODE] [POSTCODE]",
                                            "plain 123 text", "", None]
