"""Source units, translations, glossary and reviews: validation, inspection and assessment.

Tables: units(doc_id, ord, id, page, kind, source), translations(doc_id, ord, id, text),
terms(doc_id, ord, id, source, target, sense, unit_ids, status, variants), review_units(doc_id, id, verdict, checks, n_findings)
and decisions(doc_id, issue_id, reason). Violations are rows; nothing raises for a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scanner import casefold
from ..functions.text import blank, numbers, term_present, tokens
from ..schemas import BASE_CHECKS, KIND_CHECKS, KINDS, UNIT_ID


def split_units(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank lines of documents as units, numbered from 1 by line."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "source")).filter("source <> ''")
    ord_ = (F.col("at") + 1).cast("long")
    return rows.select("doc_id", ord_.alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-b"), ord_.cast("string")).alias("id"), "source")


def unit_violations(units: DataFrame) -> DataFrame:
    """One row for each broken rule of a unit, and for ids that occur twice in a document."""
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(~F.regexp_like("id", F.lit(UNIT_ID)), F.lit(True)), F.lit("unit_id")),
            F.when(F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)), F.lit("kind")),
            F.when(blank("source"), F.lit("blank_source")),
            F.when(F.coalesce(F.col("page") <= 0, F.lit(True)), F.lit("page")),
        )
    )
    each = units.select("doc_id", "id", F.explode(rules).alias("rule"))
    twice = units.groupBy("doc_id", "id").count().filter("count > 1").select("doc_id", "id", F.lit("duplicate_id").alias("rule"))
    return each.unionByName(twice)


def dangling(refs: DataFrame, units: DataFrame) -> DataFrame:
    """References (doc_id, unit_id, ...) to units that do not exist."""
    return refs.join(units.select("doc_id", F.col("id").alias("unit_id")), ["doc_id", "unit_id"], "left_anti")


def unquoted(quotes: DataFrame, units: DataFrame) -> DataFrame:
    """Quotes (doc_id, unit_id, quote) that their unit's source does not hold."""
    joined = quotes.join(units.select("doc_id", F.col("id").alias("unit_id"), "source"), ["doc_id", "unit_id"], "left")
    return joined.filter(F.coalesce(~F.contains("source", F.col("quote")), F.lit(True)) | blank("quote")).drop("source")


def alignment(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Documents whose ordered lists of ids differ."""
    listed = lambda t, name: t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias(name))
    both = listed(units, "expected").join(listed(translations, "actual"), "doc_id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).select("doc_id", size("expected").alias("n_expected"), size(F.coalesce("actual", F.array().cast("array<string>"))).alias("n_actual"))


def pair(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Units with their output, empty where there is none."""
    t = translations.select("doc_id", "id", F.col("text").alias("output"))
    return units.join(t, ["doc_id", "id"], "left").withColumn("output", F.coalesce("output", F.lit("")))


def term_scope(terms: DataFrame) -> DataFrame:
    return terms.filter("status = 'approved'").select("doc_id", F.explode("unit_ids").alias("unit_id"), F.col("id").alias("term_id"), F.col("source").alias("term"), "target", "sense", "variants")


def term_issues(paired: DataFrame, terms: DataFrame) -> DataFrame:
    """Approved terms in a unit's source without target or variant in its output."""
    s = term_scope(terms).withColumnRenamed("doc_id", "t_doc")
    scoped = paired.join(s, (paired["doc_id"] == s["t_doc"]) & (paired["id"] == s["unit_id"]))
    forms = F.concat(F.array("target"), F.coalesce("variants", F.array().cast("array<string>")))
    absent = ~F.exists(forms, lambda v: F.contains(F.col("output"), v))
    return scoped.filter(term_present(F.col("source"), F.col("term")) & absent).select(paired["doc_id"], F.col("id").alias("unit_id"), "term_id", "term", "target")


def term_conflicts(terms: DataFrame) -> DataFrame:
    """Pairs of approved terms with the same source word and a shared unit that disagree."""
    t = terms.filter("status = 'approved'")
    t = t.withColumn("word", casefold(F.col("source")))
    a = t.select("doc_id", "word", *[F.col(c).alias(f"a_{c}") for c in ("ord", "id", "unit_ids", "target", "sense")])
    b = t.select("doc_id", "word", *[F.col(c).alias(f"b_{c}") for c in ("ord", "id", "unit_ids", "target", "sense")])
    j = a.join(b, ["doc_id", "word"]).filter((F.col("a_ord") < F.col("b_ord")) & F.arrays_overlap("a_unit_ids", "b_unit_ids"))
    return j.filter("a_target <> b_target or a_sense <> b_sense").select("doc_id", "word", "a_id", "b_id")


def inspect(units: DataFrame, translations: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Issues (doc_id, id, unit_id, code, severity): errors cannot be waived, candidates can, with a reason."""
    paired = pair(units, translations)
    found = F.array_compact(
        F.array(
            F.when(blank("output"), F.struct(F.lit("empty_translation").alias("code"), F.lit("error").alias("severity"))),
            F.when(tokens("source") != tokens("output"), F.struct(F.lit("protected_tokens").alias("code"), F.lit("error").alias("severity"))),
            F.when(numbers("source") != numbers("output"), F.struct(F.lit("numbers").alias("code"), F.lit("candidate").alias("severity"))),
        )
    )
    rows = paired.select("doc_id", F.col("id").alias("unit_id"), F.explode(found).alias("x")).select("doc_id", "unit_id", "x.code", "x.severity")
    whole = alignment(units, translations).select("doc_id", F.lit("document").alias("unit_id"), F.lit("alignment").alias("code"), F.lit("error").alias("severity"))
    out = rows.unionByName(whole)
    if terms is not None:
        out = out.unionByName(term_issues(paired, terms).select("doc_id", "unit_id", F.concat(F.lit("term-"), "term_id").alias("code"), F.lit("candidate").alias("severity")))
    return out.select("doc_id", F.concat_ws(":", "unit_id", "code").alias("id"), "unit_id", "code", "severity")


def required_checks(kind: Column) -> Column:
    """Sorted checks that a unit of this kind needs."""
    extra = F.lit(None).cast("string")
    for k, check in KIND_CHECKS.items():
        extra = F.when(kind == k, F.lit(check)).otherwise(extra)
    return F.array_sort(F.array_compact(F.array(*map(F.lit, BASE_CHECKS), extra)))


def review_gaps(units: DataFrame, review_units: DataFrame) -> DataFrame:
    """Units without a passed, complete and unobjected review."""
    r = review_units.select("doc_id", "id", "verdict", "checks", "n_findings")
    j = units.join(r, ["doc_id", "id"], "left")
    passed = (F.col("verdict") == "passed") & (F.col("n_findings") == 0) & (F.size(F.array_except(required_checks(F.col("kind")), F.col("checks"))) == 0)
    return j.filter(~F.coalesce(passed, F.lit(False))).select("doc_id", F.col("id").alias("unit_id"))


def review_coverage(units: DataFrame, review_units: DataFrame) -> DataFrame:
    """Documents whose reviewed ids are not exactly their units, once each."""
    u = units.groupBy("doc_id", "id").agg(F.lit(1).alias("here"))
    r = review_units.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("times"))
    return u.join(r, ["doc_id", "id"], "full").filter("here is null or times is null or times > 1").select("doc_id").distinct()


def open_issues(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues that still block: every error, and candidates without a reasoned decision."""
    d = decisions.select("doc_id", F.col("issue_id").alias("id"), "reason")
    return issues.join(d, ["doc_id", "id"], "left").filter((F.col("severity") == "error") | blank("reason")).drop("reason")


def versions(units: DataFrame, translations: DataFrame) -> DataFrame:
    """doc_id, document_sha256 and translation_sha256: what a review refers to."""

    def version(rows: DataFrame, text: str, name: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct("ord", "id", F.col(text).alias("text"))))
        return rows.groupBy("doc_id").agg(F.sha2(F.to_json(held), 256).alias(name))

    return version(units, "source", "document_sha256").join(version(translations, "text", "translation_sha256"), "doc_id", "left")


def review_state(current: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id and blocker of documents whose review as a whole is missing, of another version, or unsigned.

    current: as from versions; reviews: doc_id, document_sha256, translation_sha256, reviewer.
    """
    r = reviews.select("doc_id", F.lit(True).alias("held"), F.col("document_sha256").alias("of_document"), F.col("translation_sha256").alias("of_translation"), "reviewer")
    j = current.join(r, "doc_id", "left")
    stale = ~(F.col("of_document").eqNullSafe(F.col("document_sha256")) & F.col("of_translation").eqNullSafe(F.col("translation_sha256")))
    held = F.col("held").isNotNull()
    found = F.array(F.when(~held, "semantic_review_missing"), F.when(held & stale, "stale_review"), F.when(held & blank("reviewer"), "reviewer_missing"))
    return j.select("doc_id", F.explode(F.array_compact(found)).alias("blocker"))


def assess(units: DataFrame, translations: DataFrame, terms: DataFrame | None, reviews: DataFrame, review_units: DataFrame, decisions: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """status and number of blockers of every document.

    Errors and the state of the review always count; what a review says or leaves open counts where there is one.
    """
    state = review_state(versions(units, translations) if current is None else current, reviews)
    blockers = open_issues(inspect(units, translations, terms), decisions)
    by_review = blockers.filter("severity <> 'error'").select("doc_id", F.col("id").alias("blocker"))
    by_review = by_review.unionByName(review_gaps(units, review_units).select("doc_id", F.concat("unit_id", F.lit(":semantic_review")).alias("blocker")))
    by_review = by_review.unionByName(review_coverage(units, review_units).select("doc_id", F.lit("review_coverage").alias("blocker")))
    by_review = by_review.join(reviews.select("doc_id").distinct(), "doc_id", "left_semi")
    every = blockers.filter("severity = 'error'").select("doc_id", F.col("id").alias("blocker")).unionByName(state).unionByName(by_review)
    n = every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = units.select("doc_id").distinct().join(n, "doc_id", "left").withColumn("n_blockers", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("doc_id", "n_blockers", F.when(F.col("n_blockers") > 0, "needs_review").otherwise("reviewed").alias("status"))


def neighbours(units: DataFrame) -> DataFrame:
    """The ids just before, at and after each unit, joined by commas."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(-1, 1)
    return units.select("doc_id", "id", F.array_join(F.collect_list("id").over(w), ",").alias("near"))


def read_only_context(units: DataFrame, selected: DataFrame, evidence: DataFrame) -> DataFrame:
    """Units shown beside a selection: neighbours and evidence, less the selection itself."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    s = selected.select("doc_id", "id").distinct().withColumn("chosen", F.lit(True))
    marked = units.join(s, ["doc_id", "id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    beside = F.coalesce(F.lag("chosen").over(w), F.lit(False)) | F.coalesce(F.lead("chosen").over(w), F.lit(False))
    e = evidence.select("doc_id", "id").distinct().withColumn("cited", F.lit(True))
    out = marked.withColumn("beside", beside).join(e, ["doc_id", "id"], "left")
    return out.filter("not chosen and (beside or cited)").select("doc_id", "ord", "id")


def risks(units: DataFrame, long_chars: int = 1200, quote_chars: int = 160) -> DataFrame:
    """Why a unit needs a second audit, with the start of its source as evidence."""
    flags = F.coalesce("source_flags", F.array().cast("array<string>")) if "source_flags" in units.columns else F.array().cast("array<string>")
    own = F.array_compact(
        F.array(
            F.when(F.col("kind").isin("table", "algorithm", "theorem"), F.concat(F.lit("structured_"), "kind")),
            F.when(F.contains("source", F.lit("[[EQ:")), F.lit("protected_formula")),
            F.when(F.length("source") > long_chars, F.lit("long_source_unit")),
        )
    )
    return units.select("doc_id", F.col("id").alias("unit_id"), F.explode(F.array_distinct(F.concat(flags, own))).alias("reason"), F.substring("source", 1, quote_chars).alias("source_quote"))


def packet_sizes(units: DataFrame) -> DataFrame:
    """Characters, UTF-8 bytes and number of units by document."""
    return units.groupBy("doc_id").agg(F.sum(F.length("source")).cast("long").alias("content_chars"), F.sum(F.octet_length("source")).cast("long").alias("content_utf8_bytes"), F.count(F.lit(1)).alias("n_units"))


MAX_TERMS = 10_000  # personal terms, which ride along with every unit


def relevant_terms(units: DataFrame, terms: DataFrame) -> DataFrame:
    """Personal terms (term, target) that occur in a document; the list is counted first, and more than MAX_TERMS are an error."""
    if terms.limit(MAX_TERMS + 1).count() > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} personal terms")
    held = terms.agg(F.collect_list(F.struct("term", "target")).alias("all"))
    hit = F.filter("all", lambda t: term_present(F.col("source"), t["term"]))
    return units.join(F.broadcast(held)).select("doc_id", F.explode(hit).alias("t")).select("doc_id", "t.term", "t.target").distinct()


def last_wins(items: DataFrame, key: str) -> DataFrame:
    """Repeats of a key collapse: the last item stands, at the place (ord) of the first."""
    kept = items.groupBy("doc_id", key).agg(F.min("ord").alias("first_ord"), F.max_by("id", "ord").alias("id"))
    place = Window.partitionBy("doc_id").orderBy("first_ord")
    return kept.select("doc_id", F.row_number().over(place).cast("long").alias("ord"), "id", key)
