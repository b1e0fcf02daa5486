"""The lexicon step works every line out once, with the same records as the tokeniser."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import lexicon as lx
from tidemark.plans import inputs as src

LINES = ["", "  ", "one", "One two", " a-b c' 'd. ", "...", "ŵy ÂB\tx9y z\n", "tail word 12 ", None, "a  b\rc d"]


def test_end_tokens_equal_the_tokeniser(spark):
    df = spark.createDataFrame([(t,) for t in LINES], "t string")
    low, all_ = F.lower("t"), tx.letter_tokens(F.col("t"))
    for row in df.select(all_.alias("all"), tx.last_token(low).alias("last"), *[tx.first_tokens(low, n).alias(f"f{n}") for n in (1, 2, 3)]).collect():
        if row["all"] is None:
            assert row["last"] is None
            continue
        assert row["last"] == (row["all"][-1] if row["all"] else "")
        for n in (1, 2, 3):
            assert row[f"f{n}"] == " ".join(row["all"][:n])


def test_filters_do_not_repeat_the_regular_expressions(spark, sf):
    rec = src.lexicon_records(spark, sf)
    pairs = lx.merge(rec.where("doc_id % 4 = 0"), rec.where("doc_id % 4 <> 0"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract" in line]


def test_merge_keeps_first_existing_and_last_fresh(spark):
    def rows(*r):
        return spark.createDataFrame(list(r), "seq long, subject string, cy string, en string")

    old = rows((2, "s", "aa", "second"), (1, "s", " AA ", "first"), (3, "s", "bb", " "), (4, "s", None, "x"))
    new = rows((1, "s", "aa", "later"), (1, "s", "bb", "one"), (2, "s", "bb", "two"), (3, "s", "bb", "12"), (4, "t", "cc", "other"))
    got = {tuple(r) for r in lx.merge(old, new, ["s"]).select("cy", "en", "origin").collect()}
    assert got == {("aa", "first", "existing"), ("bb", "two", "new")}


def test_terms_of_one_pass(spark):
    df = spark.createDataFrame([(t,) for t in ["Beth yw", "un dau tri pedwar", " \"q w ", "ab-cde f_g 'hij", "x1y abc\t", None, ""]], "l string")
    got = sorted(r["term"] for r in lx.term_tokens(df, "l").collect())
    want = ["beth", "beth yw", "dau", "tri", "pedwar", "cde", "ab-cde f_g 'hij", "x1y abc", "abc"]
    from tidemark import rules
    assert got == sorted(w for w in want if w not in rules.TERM_STOP)
