"""Personal data: base spans by pattern, then terms that give a protected entity away.

Base spans are the leftmost non-overlapping matches of four patterns on the whole text, kept if their value check holds
(address parts up to 255, Luhn sum, number of digits). The entities found are protected. A term (word of three letters or
digits at least, outside all base spans) discloses an entity by the share of the entity's information that seeing the term
anywhere in a text yields: ``log2(p(e|t) / p(e)) / log2(1 / p(e))`` with ``p(e) = n(e) / N`` and, n in documents,
``p(e|t) = (n(t,e) + PRIOR * p(e)) / (n(t) + PRIOR)``: every term has PRIOR documents of mere chance besides its own, which
weigh on rare pairs and vanish for frequent ones. All pairs are weighed; a term at or above ``THRESHOLD`` for any entity
becomes a span wherever it occurs, in texts without the entity too. In the sanitised text base spans and numbers are
generalised to a tag and other terms are removed.

Positions are code points, end exclusive. Null and empty texts have no spans. Repeated rows count as documents and are
treated alike; an entity in every document carries no information and is disclosed by nothing. Other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MANY, body, let, row_key, sized, stage

#: kind -> (pattern, cheap test that a text may hold a match). A look-behind or the end of the last match is where a run
#: of its characters can start, and possessive steps never go back, so long runs take linear time.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
}
RANKS = {k: i for i, k in enumerate(KINDS)} | {"term": 4}
TERM = r"[\p{L}\p{N}]{3,}"
THRESHOLD = 0.9
PRIOR = 1.0
#: Stands for a letter or digit of a base span; a term that one touches is part of the span. No text holds it (a text's own is blanked).
_TAKEN = "\uFFFF"
FREE_TERM = rf"(?<![\p{{L}}\p{{N}}{_TAKEN}])[\p{{L}}\p{{N}}]{{3,}}+(?!{_TAKEN})"
#: Matches whose places are added up in one go; blocks of them are joined afterwards, so long texts stay cheap.
BLOCK = 512
BROADCAST_TERMS = 200_000
#: Telling terms of one text that are searched for by name.
FEW = 64

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def located(text: Column, pattern: str | Column) -> Column:
    """[(start, end, value)] of all matches: the pieces between matches give the places."""
    def within(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["gap"])
            end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
            span = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("value"))
            return F.struct(end.alias("at"), F.when(p["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))
        return F.aggregate(parts, zero, step)

    def walk(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("out"))
        def step(acc: Column, b: Column) -> Column:
            moved = F.transform(b["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["value"]))
            return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))
        return F.flatten(F.aggregate(blocks, zero, step)["out"])

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return let(parts, lambda ps: walk(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ps), F.lit(1)), F.lit(BLOCK)), lambda i: within(F.slice(ps, i, F.lit(BLOCK))))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(digits: Column) -> Column:
        each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
        return F.aggregate(each, F.lit(0), lambda s, x: s + x)

    return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), total(d) % 10 == 0).otherwise(False))


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _spans_of(kind: str, text: Column) -> Column:
    pattern, may = KINDS[kind]
    held = F.filter(located(text, pattern), lambda s: _holds(kind, s["value"]))
    spans = F.transform(held, lambda s: F.struct(s["start"], F.lit(RANKS[kind]).alias("rank"), s["end"], F.lit(kind).alias("kind"), s["value"]))
    return F.when(may(text), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    return F.sort_array(F.concat(*[_spans_of(kind, text) for kind in KINDS]))


def _free(text: Column, spans: Column) -> Column:
    """The text with the characters of base spans masked one by one, so that places stay."""
    def step(acc: Column, s: Column) -> Column:
        start, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        masked = F.regexp_replace(F.regexp_replace(F.substring(text, start + 1, end - start), r"[^\p{L}\p{N}]", " "), r"[\p{L}\p{N}]", _TAKEN)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, start - acc["at"]), masked)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return let(F.aggregate(spans, zero, step), lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.lit(MANY))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FREE_TERM), F.lit(0)), F.lower))


def with_spans(docs: DataFrame, keep: Column, text_col: str = "text") -> DataFrame:
    """``row`` (what ``keep`` says), own, spans: base spans of every row, written to the shared folder."""
    rows = docs.select(keep.alias("row"), row_key(F.col(text_col)).alias("own"), base_spans(body(F.col(text_col))).alias("spans"))
    return stage(rows, "base-spans")


def disclosing_terms(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """(own, terms): spans of the disclosing terms of every text that has some. ``own`` stands for the text."""
    may = F.coalesce(F.greatest(*[F.col(text_col).rlike(r) for r in (r"@", r"[0-9](?:[\x20().-]*[0-9]){3}")]), F.lit(False))
    clear = docs.select(row_key(F.col(text_col)).alias("own"), may.alias("may"), F.translate(body(F.col(text_col)), _TAKEN, " ").alias("text"))
    held = clear.where("may").groupBy("own").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    held = held.select("own", "copies", "text", base_spans(F.col("text")).alias("spans"))
    texts = stage(held.select("own", "copies", F.array_distinct(F.transform("spans", lambda s: F.sha2(F.lower(s["value"]), 256))).alias("entities"),
                              _free(F.col("text"), F.col("spans")).alias("text")), "texts-with-entities")
    total = docs.count()
    entities = texts.select("own", "copies", F.explode("entities").alias("entity"))
    known = entities.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    chance = F.col("n_entity") / F.lit(float(max(total, 1)))
    # with n(t,e) = n(e) at best, a term in more documents than ``most`` cannot reach the threshold
    most = (F.col("n_entity") + prior * chance) / F.pow(chance, F.lit(1 - threshold)) - prior
    entities = entities.join(known.where(F.col("n_entity") < total).withColumn("most", most + 1e-6), "entity")

    # n(t): texts that may hold entities are counted with their base spans masked, the others as they are
    met = texts.select("own", "copies", (F.size("entities") > 0).alias("held"), F.explode(_terms(F.col("text"))).alias("term"))
    met = stage(met, "terms-met")
    others = clear.where("NOT may").select(F.explode(_terms(F.col("text"))).alias("term"))
    spread = met.groupBy("term").agg(F.sum("copies").alias("inside"), F.max("held").alias("held")).join(
        others.groupBy("term").agg(F.count(F.lit(1)).alias("outside")), "term", "left")
    spread = spread.where("held").select("term", F.coalesce("outside", F.lit(0)).alias("outside"), (F.col("inside") + F.coalesce("outside", F.lit(0))).alias("n_term"))
    spread = stage(spread, "spread")
    rare = met.where("held").select("own", "term").join(spread, "term")
    pairs = entities.alias("e").join(rare.alias("r"), (F.col("e.own") == F.col("r.own")) & (F.col("n_term") <= F.col("most")))
    pairs = pairs.groupBy("entity", "term", "n_entity", "n_term", "outside").agg(F.sum("copies").alias("both"))
    given = (F.col("both") + prior * chance) / (F.col("n_term") + prior)
    telling = stage(pairs.where(F.log2(given / chance) / -F.log2(chance) >= threshold).select("term", "outside").distinct(), "telling")

    # only texts that hold a telling term are searched, and only for the telling terms they hold
    wanted = sized(telling.select("term"), BROADCAST_TERMS)
    abroad = sized(telling.where("outside > 0").select("term"), BROADCAST_TERMS)
    inside = met.select("own", "term").join(wanted, "term", "left_semi")
    found = clear.where("NOT may").select("own", F.explode(_terms(F.col("text"))).alias("term")).join(abroad, "term", "left_semi")
    mine = stage(inside.unionByName(found).groupBy("own").agg(F.collect_set("term").alias("mine")), "telling-terms-of-texts")
    few = sized(mine, BROADCAST_TERMS)
    free = clear.where("NOT may").join(few, "own").groupBy("own").agg(F.first("text").alias("text"), F.first("mine").alias("mine"))
    rows = texts.select("own", "text").join(few, "own").unionByName(free.select("own", "text", "mine"))
    places = rows.select("own", "mine", F.explode(located(F.col("text"), _any_of(F.col("mine")))).alias("t"))
    places = places.where(F.array_contains("mine", F.lower("t.value"))).select("own", "t.start", "t.end", "t.value")
    span = F.struct("start", F.lit(RANKS["term"]).alias("rank"), "end", F.lit("term").alias("kind"), "value")
    return places.groupBy("own").agg(F.collect_set(span).cast(_SPAN).alias("terms"))


def _any_of(terms: Column) -> Column:
    """Pattern of free terms that may be one of a few; any free term where they are many or no plain runs of letters and digits
    (lower case of a single letter can be two characters)."""
    plain = F.forall(terms, lambda t: t.rlike(r"^[\p{L}\p{N}]+$")) & (F.size(terms) <= FEW)
    listed = F.concat(F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}{_TAKEN}])(?:"), F.array_join(terms, "|"), F.lit(rf")(?![\p{{L}}\p{{N}}{_TAKEN}])"))
    return F.when(plain, listed).otherwise(F.lit(FREE_TERM))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def found_spans(docs: DataFrame, keep: Column, text_col: str = "text", **options) -> DataFrame:
    """row, base (base spans), spans (base and disclosing terms, ordered), one row per input row."""
    rows = with_spans(docs, keep, text_col)
    out = rows.join(disclosing_terms(docs, text_col, **options), "own", "left")
    both = F.sort_array(F.concat("spans", F.coalesce("terms", F.array().cast(_SPAN))))
    return out.select("row", F.col("spans").alias("base"), both.alias("spans"))


def sanitised(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with base spans and numbers generalised to a tag and other disclosing terms removed; overlaps merge into the first."""
    found = found_spans(docs, F.struct("*"), text_col, **options)
    text = F.col(f"row.{text_col}")

    def step(acc: Column, s: Column) -> Column:
        tag = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"].rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).otherwise(F.lit(""))
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), tag)
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = let(F.aggregate("spans", zero, step), lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.lit(MANY))))
    value = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*[(value if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
