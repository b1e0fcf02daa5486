"""Knowledge base of intents: merging, de-duplication, audit, topic grid, response choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import regex as rx
from tidemark.functions import text as tx
from tidemark.operators.ordered import row_numbers, top_k


def pattern_key(pattern: Column) -> Column:
    return F.lower(F.trim(pattern))


def merge_patterns(training: DataFrame, base: DataFrame, additions: DataFrame) -> DataFrame:
    """(tag, pattern, origin): exact-string union per tag, then curated additions.

    Additions need a known tag and a key (trimmed, lower-cased) that is new for it;
    the first addition of a key wins.  Inputs are (seq, tag, pattern).
    """
    merged = training.select("tag", "pattern").union(base.select("tag", "pattern")).distinct()
    known = base.select("tag").distinct()
    fresh = additions.join(known, "tag", "left_semi").groupBy("tag", pattern_key(F.col("pattern")).alias("_key")).agg(
        F.min_by("pattern", "seq").alias("pattern"))
    have = merged.select("tag", pattern_key(F.col("pattern")).alias("_key")).distinct()
    added = fresh.where("_key <> ''").join(have, ["tag", "_key"], "left_anti").select("tag", "pattern")
    return merged.withColumn("origin", F.lit("merged")).unionByName(added.withColumn("origin", F.lit("added")))


def dedupe_patterns(patterns: DataFrame, keep_in: list[tuple[str, str]]) -> DataFrame:
    """Mark the patterns removed because another intent keeps them.

    The keeper is the override or the first intent seen; an override that does not
    hold the pattern removes nothing.  One small row per key is joined back, so a
    frequent pattern never gathers in one group.
    """
    override = F.lit(None).cast("string")
    for key, tag in keep_in:
        override = F.when(F.col("_key") == key, tag).otherwise(override)
    keyed = patterns.withColumn("_key", pattern_key(F.col("pattern")))
    first = keyed.groupBy("_key").agg(
        F.min_by("tag", "seq").alias("_first"), F.count("*").alias("_n"),
        F.max(F.col("tag") == F.coalesce(override, F.lit(""))).alias("_held"))
    keeper = F.when(override.isNull(), F.col("_first")).when(F.col("_held"), override)
    removed = (F.col("_n") > 1) & (F.col("_key") != "") & F.coalesce(F.col("tag") != keeper, F.lit(False))
    return keyed.join(first, "_key").withColumn("removed", removed).drop("_key", "_first", "_n", "_held")


def audit(patterns: DataFrame, responses: DataFrame, facts: DataFrame, shown: int | None = None) -> DataFrame:
    """(rule, tag, msg, n_issues): per-rule issues, all of them, or the first ``shown`` of each rule."""
    n_pat = patterns.groupBy("tag").agg(F.count("*").alias("p"))
    n_resp = responses.groupBy("tag").agg(
        F.sum(F.size(F.coalesce("responses_en", "responses_list", F.array()))).alias("en"),
        F.sum(F.size(F.coalesce("responses_cy", F.array()))).alias("cy"))
    per_tag = n_pat.join(n_resp, "tag", "full").na.fill(0)

    def issue(df, rule, tag, when, msg):
        return df.where(when).select(F.lit(rule).alias("rule"), tag.alias("tag"), msg.alias("msg"))

    def counted(prefix, col, suffix):
        return F.concat(F.lit(prefix), F.col(col).cast("string"), F.lit(suffix))

    tag = F.col("tag")
    parts = [
        issue(per_tag, "R1", tag, F.col("p") < 3, counted("only ", "p", " patterns")),
        issue(per_tag, "R1", tag, F.col("en") < 2, counted("only ", "en", " English responses")),
        issue(per_tag, "R1", tag, F.col("cy") < 2, counted("only ", "cy", " Welsh responses")),
        issue(per_tag, "R2", tag, F.col("p") > 40, counted("", "p", " patterns")),
    ]
    welsh = F.exists("questions", lambda s: rx.matches(s, rules.DIACRITIC_WIDE)
                     | rx.matches(s, r"\b(sut|beth|ble|pryd|pam|faint|ydy|yw)\b"))
    fact_id = F.col("id")
    fees = F.contains(fact_id, F.lit("fees-")) & (fact_id != "fees-general")
    bad = facts.select("id", F.explode("qualifiers").alias("_q")).where(~F.col("_q").isin(*rules.AUDIT_QUALIFIERS))
    parts += [
        issue(facts, "R3", fact_id, F.coalesce("answer_cy", F.lit("")) == "", F.lit("missing Welsh answer")),
        issue(facts, "R3", fact_id, ~welsh, F.lit("no Welsh question")),
        issue(facts, "R4", fact_id, fees & (F.size("qualifiers") == 0), F.lit("fees fact without qualifiers")),
        issue(bad, "R4", fact_id, fees, F.concat(F.lit("unknown qualifier "), "_q")),
    ]
    keyed = patterns.withColumn("_key", pattern_key(F.col("pattern"))).where("_key <> ''")
    first = keyed.groupBy("_key").agg(F.min_by("tag", "seq").alias("_first"))
    parts.append(issue(keyed.join(first, "_key"), "R5", tag, tag != F.col("_first"),
                       F.concat(F.lit("duplicate pattern of "), "_first", F.lit(": "), "_key")))
    problems = parts[0]
    for p in parts[1:]:
        problems = problems.unionByName(p)
    totals = problems.groupBy("rule").agg(F.count("*").alias("n_issues"))
    listed = problems if shown is None else top_k(problems, ["rule"], [F.col("tag"), F.col("msg")], shown)
    return listed.join(F.broadcast(totals), "rule")  # at most one total per rule: five rows


# ------------------------------------------------------------------ topics
def expand(topics: DataFrame, seeds: str, entities: str, templates: list[str], out: str) -> DataFrame:
    """Seeds followed by entity x template phrases, first spelling of a phrase kept."""
    made = F.flatten(F.transform(entities, lambda e: F.array(*[
        F.trim(F.replace(F.lit(t), F.lit("{X}"), e)) for t in templates])))
    staged = topics.withColumn("_made", made).withColumn(
        "_low", F.concat(F.transform(seeds, F.lower), F.transform("_made", F.lower)))
    # a made phrase stays when its lower-cased form first occurs at its own position
    own = F.size("_low") - F.size("_made")
    extra = F.filter("_made", lambda p, i: (F.char_length(p) > 1) & (F.array_position("_low", F.lower(p)) == own + i + 1))
    return staged.withColumn(out, F.concat(seeds, extra)).drop("_made", "_low")


def _family(rows: DataFrame, seq: int, id_: Column, title: Column, title_cy: Column, seeds_en: list[Column],
            seeds_cy: list[Column], entities_en: list[Column], entities_cy: list[Column], hint: Column,
            priority: int) -> DataFrame:
    return rows.select(
        F.lit(seq).alias("seq"), id_.alias("id"), title.alias("title"), title_cy.alias("title_cy"),
        F.array(*seeds_en).alias("seeds_en"), F.array(*seeds_cy).alias("seeds_cy"),
        F.array(*entities_en).alias("entities_en"), F.array(*entities_cy).alias("entities_cy"),
        hint.alias("hint"), F.lit(priority).cast("bigint").alias("priority"))


def _f(template: str, **cols: str) -> Column:
    """'{en} degree' with named columns filled in."""
    out = F.lit(template)
    for name, col in cols.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.col(col))
    return out


def subject_topics(subjects: DataFrame, seq: int) -> DataFrame:
    """Course, careers and entry topics of each (id, en, cy) subject."""
    def t(template):
        return _f(template, id="id", en="en", cy="cy")

    course = _family(subjects, seq, t("subject-{id}"), t("{en} course"), t("cwrs {cy}"),
                     [t("study {en}"), t("{en} degree"), t("{en} BA"), t("{en} BSc")],
                     [t("astudio {cy}"), t("gradd {cy}")],
                     [t("{en}"), t("{en} degree"), t("{en} course"), t("BA {en}"), t("BSc {en}")],
                     [t("{cy}"), t("gradd {cy}")], t("{en} undergraduate postgraduate course modules"), 6)
    careers = _family(subjects, seq + 1, t("subject-{id}-careers"), t("{en} careers / employability"), t("Gyrfaoedd {cy}"),
                      [t("what jobs can I get with a {en} degree"), t("{en} graduate careers"), t("is {en} a good degree for jobs")],
                      [t("gyrfaoedd {cy}"), t("swyddi {cy}")],
                      [t("{en} careers"), t("{en} jobs"), t("{en} graduate")], [t("gyrfaoedd {cy}")],
                      t("{en} graduate careers employability"), 5)
    entry = _family(subjects, seq + 2, t("subject-{id}-entry"), t("{en} entry requirements"), t("Gofynion mynediad {cy}"),
                    [t("what grades for {en}"), t("{en} entry requirements"), t("A-levels needed for {en}")],
                    [t("gofynion mynediad {cy}")], [t("{en} entry requirements"), t("{en} A-level requirements")],
                    [t("gofynion {cy}")], t("{en} entry requirements grades needed"), 5)
    return course.unionByName(careers).unionByName(entry)


def campus_topics(campuses: DataFrame, services: list[tuple[str, str, str]], seq: int) -> DataFrame:
    """Campus x service grid; the services are a fixed list carried by every campus row."""
    fixed = F.array(*[F.struct(F.lit(i).alias("sid"), F.lit(e).alias("sen"), F.lit(c).alias("scy")) for i, e, c in services])
    grid = campuses.select("id", "en", "cy", F.inline(fixed))

    def t(template):
        return _f(template, id="id", en="en", cy="cy", sid="sid", sen="sen", scy="scy")

    return _family(grid, seq, t("campus-{id}-{sid}"), t("{en} {sen}"), t("{cy} {scy}"),
                   [t("{en} {sen}"), t("{sen} at {en} campus"), t("where is the {sen} in {en}"), t("{en} campus {sen} location")],
                   [t("{scy} {cy}")], [t("{en} {sen}"), t("{sen} {en}")], [t("{scy} {cy}")],
                   t("{en} campus {sen} location opening hours contact"), 4)


def student_topics(types: DataFrame, concerns: list[tuple[str, str, str]], seq: int) -> DataFrame:
    """Student type x concern grid."""
    fixed = F.array(*[F.struct(F.lit(i).alias("sid"), F.lit(e).alias("sen"), F.lit(c).alias("scy")) for i, e, c in concerns])
    grid = types.select("id", "en", "cy", F.inline(fixed))

    def t(template):
        return _f(template, id="id", en="en", cy="cy", sid="sid", sen="sen", scy="scy")

    return _family(grid, seq, t("student-{id}-{sid}"), t("{en} — {sen}"), t("{cy} — {scy}"),
                   [t("{sen} for {en}s"), t("{en} {sen}"), t("as a {en}, {sen}")], [t("{scy} ar gyfer {cy}")],
                   [t("{en} {sen}")], [t("{cy} {scy}")], t("{en} {sen} support eligibility process"), 4)


def simple_topics(rows: DataFrame, seq: int, seeds: list[str], seeds_cy: list[str], hint: str, priority: int,
                  title: str = "{En}") -> DataFrame:
    """How-to, policy, wellbeing and funding families share this shape."""
    up = rows.withColumn("En", F.concat(F.upper(F.substring("en", 1, 1)), F.lower(F.expr("substring(en, 2)"))))

    def t(template):
        return _f(template, id="id", en="en", cy="cy", En="En")

    return _family(up, seq, t("{id}"), t(title), t("{cy}"), [t(s) for s in seeds], [t(s) for s in seeds_cy],
                   [t("{en}")], [t("{cy}")], t(hint), priority)


def build_topics(parts: list[DataFrame]) -> DataFrame:
    """Later families win on equal ids; phrases expanded in both languages."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fields = [c for c in union.columns if c not in ("id", "seq")]
    last = union.groupBy("id").agg(F.max_by(F.struct(*fields), "seq").alias("t")).select("id", "t.*")
    en = expand(last, "seeds_en", "entities_en", rules.TEMPLATES_EN, "phrases_en")
    return expand(en, "seeds_cy", "entities_cy", rules.TEMPLATES_CY, "phrases_cy").drop(
        "seeds_en", "seeds_cy", "entities_en", "entities_cy")


# --------------------------------------------------------------- responses
def pick_response(asked: DataFrame, responses: DataFrame, draw: Column) -> DataFrame:
    """Deterministic choice of one response per (tag, lang), English when the language has none.

    Responses get global positions sorted by (tag, lang); a pick is the first
    position of its pool plus the draw modulo the pool size, so no pool is
    gathered in one place.  ``asked`` has tag and lang, ``responses`` (seq, tag, lang, text).
    """
    placed = row_numbers(responses, [F.col("tag"), F.col("lang"), F.col("seq")], "_pos")
    pools = placed.groupBy("tag", "lang").agg(F.min("_pos").alias("_from"), F.count("*").alias("_n"))
    own = pools.select("tag", "lang", F.struct("_from", "_n").alias("_own"))
    english = pools.where("lang = 'en'").select("tag", F.struct("_from", "_n").alias("_en"))
    chosen = asked.join(own, ["tag", "lang"], "left").join(english, "tag", "left").withColumn(
        "_pool", F.coalesce("_own", "_en"))
    at = chosen.withColumn("_pos", F.col("_pool._from") + draw % F.col("_pool._n")).drop("_own", "_en", "_pool")
    return at.join(placed.select("_pos", F.col("text").alias("response")), "_pos", "left").drop("_pos")
