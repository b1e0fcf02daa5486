"""Cross-site boilerplate lines by distinct-site spread.

Every line with a word is normalised (white space runs to one blank, trimmed, lower case) and hashed to 128 bits. One
aggregation merges a HyperLogLog sketch of sites per hash, built in every task before the shuffle. A line whose estimate
lies clearly above ``min_sites`` is boilerplate, one clearly below is not, and lines near the threshold get an exact
distinct count. All occurrences of a boilerplate line go but the first one by (id, place), so no wording leaves the corpus.

Null and empty texts have no lines and stay; a null site counts as one site; blank lines are kept as they are. Repeated
rows are the same occurrence and are treated alike. A common line is only ever counted, never gathered; what is
gathered per document is the places of its own removed lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, body, row_key, sized, stage

MIN_SITES = 8
#: log2 of the registers; the standard error is 1.04 / sqrt(2 ** REGISTERS).
REGISTERS = 11
#: Share of the threshold on either side in which sites are counted exactly: over four standard errors.
NEAR = 0.125
BROADCAST_LINES = 500_000


def _lines(docs: DataFrame, id_col: str, site_col: str) -> DataFrame:
    rows = docs.select(row_key(F.col(id_col), F.col("text")).alias("own"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(body(F.col("text")), "\n")).alias("pos", "line"))
    plain = F.lower(F.trim(F.regexp_replace("line", BLANKS, " ")))
    rows = rows.select("own", "id", "site", "pos", plain.alias("line")).where("line <> ''")
    return rows.select("own", "id", "site", "pos", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))


def removed_places(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(own, places): the places of removed lines of every row that loses some."""
    lines = _lines(docs, id_col, site_col)
    spread = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS)))
    least = min(min_sites - 1, int(min_sites * (1 - NEAR)))
    wide = stage(lines.groupBy("h1", "h2").agg(spread.alias("sites")).where(F.col("sites") >= least), "spread")
    found = stage(lines.join(sized(wide, BROADCAST_LINES), ["h1", "h2"]), "wide-lines")
    near = F.col("sites") < max(min_sites + 1, min_sites * (1 + NEAR))
    exact = found.where(near).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    sure = wide.where(~near).select("h1", "h2").union(exact.where(F.col("exact") >= min_sites).select("h1", "h2"))
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "own", "pos")).alias("first")).join(sure, ["h1", "h2"], "left_semi")
    again = found.join(sized(first, BROADCAST_LINES), ["h1", "h2"]).where(F.struct("id", "own", "pos") != F.col("first"))
    return again.groupBy("own").agg(F.collect_set("pos").alias("places"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", min_sites: int = MIN_SITES,
               counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the remaining text, and on request two columns: lines with a word before, lines removed."""
    places = removed_places(docs, id_col, site_col, min_sites)
    keyed = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col), F.col("text")).alias("own"))
    joined = keyed.join(places, "own", "left").select("row", "places")
    lines = F.split(body(F.col("row.text")), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("places"), i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(left)
    worded = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    extra = {} if counts is None else {counts[0]: worded.cast("long"), counts[1]: F.coalesce(F.size("places"), F.lit(0)).cast("long")}
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns], *[v.alias(k) for k, v in extra.items()])


def has_words(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """For a corpus: lines removed, ``n_chars`` brought up to date, rows that lost all their words left out."""
    before, gone = "lines before dedup", "lines removed by dedup"
    out = line_dedup(docs, counts=(before, gone), **options)
    out = out.where((F.col(f"`{gone}`") == 0) | has_words(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"`{gone}`") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
