"""Verification gates: set-oriented checks of claims and sentences against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import agrees, canonical_unit, magnitude_label, measures_in
from ..functions.text import key_terms
from .pairs import moves, pair_counts

#: Claim types that each evidence type supports, blocking statuses, wording allowed by grade.
ALLOWED = {
    "quantitative": ["statistical", "descriptive", "comparative"],
    "methodological": ["methodological", "descriptive"],
    "contextual": ["descriptive", "background"],
    "qualitative": ["descriptive", "interpretive"],
}
BLOCKING = ("blocked", "unsupported", "rejected")
GRADES = ("high", "medium", "low")
STRENGTHS = ("hedged", "moderate", "strong")
TERM_SHARE = 0.40


def links(claims: DataFrame) -> DataFrame:
    """(claim_id, evidence_id): the bridge table of claims to the evidence they cite."""
    return claims.select("claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))


def linkage(claims: DataFrame, evidence: DataFrame, sentences: DataFrame) -> DataFrame:
    """FA: (claim_id, reasons, blocked): status, missing or unknown evidence, no sentence, a type that evidence does not allow."""
    known = evidence.select("evidence_id", "evidence_type")
    allowed = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    cited = links(claims).join(known.withColumn("known", F.lit(True)), "evidence_id", "left")
    per = cited.groupBy("claim_id").agg(F.count("evidence_id").alias("cited"), F.count_if(F.col("evidence_id").isNotNull() & F.col("known").isNull()).alias("unknown"), F.collect_set("evidence_type").alias("types"))
    spoken = sentences.select(F.explode("claim_ids").alias("claim_id")).distinct().withColumn("spoken", F.lit(True))
    c = claims.select("claim_id", "claim_type", "status").join(per, "claim_id", "left").join(spoken, "claim_id", "left")
    fits = F.exists("types", lambda t: F.array_contains(F.element_at(allowed, t), F.col("claim_type")))
    tests = [
        (F.col("status").isin(*BLOCKING), "blocked status"),
        (F.coalesce("cited", F.lit(0)) == 0, "no evidence"),
        (F.coalesce("unknown", F.lit(0)) > 0, "unknown evidence"),
        (F.col("spoken").isNull(), "no sentence"),
        ((F.size("types") > 0) & ~fits, "type not allowed"),
    ]
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in tests]))
    return c.select("claim_id", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) > 0).alias("blocked"))


def statistical_backing(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """FB: (claim_id, backed) of statistical claims: whether any cited evidence is quantitative."""
    stat = claims.where("claim_type = 'statistical'")
    cited = links(stat).join(evidence.select("evidence_id", "evidence_type"), "evidence_id", "left")
    return cited.groupBy("claim_id").agg(F.coalesce(F.bool_or(F.col("evidence_type") == "quantitative"), F.lit(False)).alias("backed"))


def figures_supported(claim: Column, content: Column) -> Column:
    """Whether each figure of the claim has one in the content within 1 %, with an equal or unstated unit."""
    has = measures_in(content)

    def found(c: Column) -> Column:
        def same(e: Column) -> Column:
            unit = (c["unit"] == "") | (e["unit"] == "") | (canonical_unit(c["unit"]) == canonical_unit(e["unit"]))
            return agrees(c["value"], e["value"]) & unit

        return F.exists(has, same)

    return F.forall(measures_in(claim), found)


def terms_covered(claim: Column, content: Column, share: float = TERM_SHARE) -> Column:
    """Whether the content holds enough of the claim's key terms; a claim without terms passes."""
    terms = key_terms(claim)
    low = F.lower(content)
    held = F.size(F.filter(terms, lambda t: low.contains(t)))
    return (F.size(terms) == 0) | (held >= share * F.size(terms))


def content_overlap(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """FE: (claim_id, examined, failed, blocked). A claim fails only if none of the evidence it cites supports it.

    Evidence meets claims by id, never by comparing all with all.
    """
    pairs = links(claims).join(claims.select("claim_id", "claim_text"), "claim_id").join(evidence.select("evidence_id", "content"), "evidence_id")
    ok = figures_supported(F.col("claim_text"), F.col("content")) & terms_covered(F.col("claim_text"), F.col("content"))
    votes = pairs.select("claim_id", "evidence_id", ok.alias("ok")).groupBy("claim_id", "evidence_id").agg(F.bool_or("ok").alias("ok"))
    per = votes.groupBy("claim_id").agg(F.count("*").alias("examined"), F.count_if(~F.col("ok")).alias("failed"))
    return per.withColumn("blocked", F.col("failed") == F.col("examined"))


def statement(claims: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """FS: (claim_id, missing): figures of a claim that no paragraph which carries it states, within 1 %."""
    prose = paragraphs.select(F.explode("claim_ids").alias("claim_id"), measures_in(F.col("text")).alias("said"))
    said = prose.select("claim_id", F.explode("said").alias("s")).select("claim_id", F.col("s.value").alias("said"))
    wanted = claims.select("claim_id", F.explode(measures_in(F.col("claim_text"))).alias("m")).select("claim_id", F.col("m.text").alias("figure"), F.col("m.value").alias("value"))
    hit = wanted.join(said, "claim_id", "left").groupBy("claim_id", "figure", "value").agg(F.coalesce(F.bool_or(agrees(F.col("value"), F.col("said"))), F.lit(False)).alias("hit"))
    return hit.groupBy("claim_id").agg(F.count_if(~F.col("hit")).alias("missing"))


def wording(sentences: DataFrame, evidence: DataFrame, weakest: bool = False) -> DataFrame:
    """FD: (sentence_id, grade, wording_strength, too_strong). The grade is the strongest cited one, or the weakest if asked.

    High evidence carries strong wording, medium moderate, low hedged.
    """
    place = F.array_position(F.array(*map(F.lit, GRADES)), F.col("evidence_grade"))
    graded = sentences.select("sentence_id", "wording_strength", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", place.alias("place")), "evidence_id")
    pick = F.max("place") if weakest else F.min("place")
    per = graded.groupBy("sentence_id", "wording_strength").agg(pick.cast("int").alias("place"))
    strength = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("wording_strength"))
    return per.select("sentence_id", F.get(F.array(*map(F.lit, GRADES)), F.col("place") - 1).alias("grade"), "wording_strength", (strength > 4 - F.col("place")).alias("too_strong"))


def concordance(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row: concordant, discordant, tied pairs of a table along its key; the table may have any number of rows."""
    return pair_counts(table, key, value)


def trend(table: DataFrame, label: str, value: str, claimed: str = "rises") -> DataFrame:
    """FT: one row: pairs as in concordance, whether the ends agree, and whether the claimed trend is refuted.

    Labels are ordered by the magnitude they state. A claim is refuted if most pairs and both ends are
    against it; fewer than three groups refute nothing.
    """
    keyed = table.withColumn("__k", magnitude_label(F.col(label)))
    pairs = concordance(keyed, "__k", value)
    ends = keyed.agg(F.count("*").alias("groups"), F.min_by(value, "__k").alias("first"), F.max_by(value, "__k").alias("last"))
    against = F.col("discordant") > F.col("concordant") if claimed == "rises" else F.col("concordant") > F.col("discordant")
    wrong_ends = F.col("last") <= F.col("first") if claimed == "rises" else F.col("last") >= F.col("first")
    return pairs.join(ends).withColumn("refuted", (F.col("groups") >= 3) & against & wrong_ends)  # one row each


def covariation(table: DataFrame, x: str, y: str) -> DataFrame:
    """FT2: one row: pairs of rows in which two measures move together, apart, or not at all."""
    return moves(table, x, y)


def band_labels_known(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """FL: (claim_id, label, known) of the band labels that claims quote, dashes alike."""
    quoted = claims.select("claim_id", F.explode(F.regexp_extract_all(F.translate("claim_text", "–—−", "---"), F.lit(r"[0-9][0-9,.]*-[0-9][0-9,.]*[0-9]|[0-9][0-9,]*\+"), 0)).alias("label"))
    known = labels.select(F.translate("label", "–—−", "---").alias("label")).distinct().withColumn("known", F.lit(True))
    return quoted.join(known, "label", "left").select("claim_id", "label", F.coalesce("known", F.lit(False)).alias("known"))


def run_gates(claims: DataFrame, evidence: DataFrame, sentences: DataFrame) -> DataFrame:
    """(gate, claim_id, blocked) of FA, FB and FE together."""
    fa = linkage(claims, evidence, sentences).select(F.lit("FA").alias("gate"), "claim_id", "blocked")
    fb = statistical_backing(claims, evidence).select(F.lit("FB").alias("gate"), "claim_id", (~F.col("backed")).alias("blocked"))
    fe = content_overlap(claims, evidence).select(F.lit("FE").alias("gate"), "claim_id", "blocked")
    return fa.unionByName(fb).unionByName(fe)


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("gate").agg(F.count_if("blocked").alias("blocked"), F.count_if(~F.col("blocked")).alias("verified"))


def confusion(rows: DataFrame, truth: str, flagged: str) -> DataFrame:
    """One row: tp, fp, fn, tn, recall, false_positive_rate, precision."""
    t, f = F.col(truth), F.col(flagged)
    c = rows.agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & ~f).alias("tn"))
    return c.select("*", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("fp", F.col("fp") + F.col("tn")).alias("false_positive_rate"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))


def verify(answer: DataFrame, sources: DataFrame) -> DataFrame:
    """(sentence_id, grounded): whether any single source that a sentence cites supports its figures and terms.

    answer: sentence_id, text, cites (array of source_id); sources: source_id, content. A cited source
    that does not exist grounds nothing.
    """
    cited = answer.select("sentence_id", "text", F.explode_outer("cites").alias("source_id")).join(sources, "source_id", "left")
    ok = F.coalesce(figures_supported(F.col("text"), F.col("content")) & terms_covered(F.col("text"), F.col("content")), F.lit(False))
    return cited.groupBy("sentence_id").agg(F.bool_or(ok).alias("grounded"), F.count_if(F.col("source_id").isNotNull() & F.col("content").isNull()).alias("unknown")).select("sentence_id", (F.col("grounded") & (F.col("unknown") == 0)).alias("grounded"))
