"""Scores of hypotheses against references, per pair and over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpuslab.functions.edit import char_distance, edit_counts, edit_script, error_rate, safe_ratio
from korpuslab.functions.text import normalize_tr_for_wer, once, tokens, words

#: Upper ends of error-rate buckets and their names.
BUCKETS = ((0.0, "identity"), (0.05, "up_to_5"), (0.15, "5_to_15"), (0.30, "15_to_30"))


def track(df: DataFrame, reference: str, hypothesis: str, into: str, normalized: bool) -> DataFrame:
    """``df`` with one score struct: token counts and edits, wer, cer. Characters count spaces; a raw text is not trimmed for cer."""
    texts = {into_: F.coalesce(normalize_tr_for_wer(c) if normalized else F.col(c), F.lit("")) for into_, c in (("_r", reference), ("_h", hypothesis))}
    df = once(df, **texts)
    df = df.withColumns({"_rt": tokens("_r") if normalized else words("_r"), "_ht": tokens("_h") if normalized else words("_h")})
    df = df.withColumns({"_e": edit_counts(F.col("_rt"), F.col("_ht")), "_c": char_distance(F.col("_r"), F.col("_h"))})
    edits, length = F.col("_e.insertions") + F.col("_e.deletions") + F.col("_e.substitutions"), F.size("_rt")
    chars, char_edits = F.length("_r"), F.col("_c")
    score = F.struct(
        length.alias("reference_length"), F.col("_e.insertions").alias("insertions"), F.col("_e.deletions").alias("deletions"), F.col("_e.substitutions").alias("substitutions"),
        error_rate(edits, length).alias("wer"), chars.alias("reference_chars"), char_edits.alias("char_edits"), error_rate(char_edits, chars).alias("cer"),
    )
    return df.withColumn(into, score).drop("_r", "_h", "_rt", "_ht", "_e", "_c")


def score_text(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``df`` with the raw and the normalised score of each pair."""
    return track(track(df, reference, hypothesis, "raw", False), reference, hypothesis, "normalized", True)


def classify_before_after(reference: Column, before: Column, after: Column) -> Column:
    """How a correction changed a hypothesis, by equality of normalised texts alone.

    ``orthographic_only``: both agree with the reference once normalised, but not both are written as it is.
    """
    r, b, a = (normalize_tr_for_wer(c) for c in (reference, before, after))
    was, is_ = b == r, a == r
    return F.when(~was & is_, "improved").when(was & ~is_, "damaged").when(was & is_ & ~((before == reference) & (after == reference)), "orthographic_only").otherwise("unchanged")


def micro(df: DataFrame, by: list[str], score: str = "normalized") -> DataFrame:
    """Corpus rates: edits and lengths are summed before they are divided."""
    s = lambda f: F.col(f"{score}.{f}")
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(s("insertions") + s("deletions") + s("substitutions")).alias("word_edits"), F.sum(s("reference_length")).alias("reference_words"),
        F.sum(s("char_edits")).alias("char_edits"), F.sum(s("reference_chars")).alias("reference_chars"),
    )
    return sums.withColumns({"wer": error_rate(F.col("word_edits"), F.col("reference_words")), "cer": error_rate(F.col("char_edits"), F.col("reference_chars"))})


def macro(df: DataFrame, by: list[str], score: str = "normalized") -> DataFrame:
    """Means of the pairs' own rates."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.avg(f"{score}.wer").alias("macro_wer"), F.avg(f"{score}.cer").alias("macro_cer"))


def wer_bucket(wer: Column) -> Column:
    out = F.when(wer <= BUCKETS[0][0], BUCKETS[0][1])
    for top, name in BUCKETS[1:]:
        out = out.when(wer <= top, name)
    return out.otherwise("over_30")


def correction_summary(df: DataFrame, by: list[str], reference: str, before: str, after: str) -> DataFrame:
    """Relative reduction of word errors, over-correction and shares of improved, unchanged and damaged rows by change of error count."""
    df = track(track(df, reference, before, "_b", True), reference, after, "_a", True)
    edits = lambda c: F.col(f"{c}.insertions") + F.col(f"{c}.deletions") + F.col(f"{c}.substitutions")
    df = df.withColumns({"_eb": edits("_b"), "_ea": edits("_a")})
    clean = F.col("_eb") == 0
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_eb").alias("edits_before"), F.sum("_ea").alias("edits_after"),
        F.count_if(F.col("_ea") < F.col("_eb")).alias("improved"), F.count_if(F.col("_ea") == F.col("_eb")).alias("unchanged"), F.count_if(F.col("_ea") > F.col("_eb")).alias("damaged"),
        F.count_if(clean).alias("correct_before"), F.count_if(clean & (F.col("_ea") > 0)).alias("overcorrected"),
    )
    return sums.withColumns({"relative_wer_reduction": safe_ratio(F.col("edits_before") - F.col("edits_after"), F.col("edits_before")), "overcorrection_rate": safe_ratio(F.col("overcorrected"), F.col("correct_before"))})


def hallucinated(reference: Column, hypothesis: Column, output: Column) -> Column:
    """Distinct tokens of a correction that are in neither the hypothesis nor the reference."""
    return F.array_except(output, F.concat(hypothesis, reference))


def substitutions(df: DataFrame, reference: str, hypothesis: str, top: int) -> DataFrame:
    """The most frequent token substitutions over all pairs; columns hold token arrays."""
    steps = df.select(F.explode(edit_script(F.col(reference), F.col(hypothesis))).alias("o")).where("o.operation = 'substitute'")
    counts = steps.groupBy(F.col("o.reference").alias("reference_token"), F.col("o.hypothesis").alias("hypothesis_token")).agg(F.count(F.lit(1)).alias("times"))
    return counts.orderBy(F.desc("times"), "reference_token", "hypothesis_token").limit(top)


def error_class(reference: Column, hypothesis: Column) -> Column:
    """What kind of error a substitution is: a number, an apostrophe, letters that differ by a Turkish mark, a suffix, or another word."""
    number = reference.rlike("[0-9]") | hypothesis.rlike("[0-9]")
    bare = lambda c: F.regexp_replace(c, "'", "")
    marks = lambda c: F.translate(c, "çğıöşüâîû", "cgiosuaiu")
    stem = F.least(F.length(reference), F.length(hypothesis)) >= 4
    suffix = stem & (F.substring(reference, 1, 4) == F.substring(hypothesis, 1, 4))
    return F.when(number, "number").when(bare(reference) == bare(hypothesis), "apostrophe").when(marks(reference) == marks(hypothesis), "character").when(suffix, "suffix").otherwise("word")


def error_classes(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Token substitutions over all pairs by class; columns hold token arrays."""
    steps = df.select(F.explode(edit_script(F.col(reference), F.col(hypothesis))).alias("o")).where("o.operation = 'substitute'")
    return steps.groupBy(error_class(F.col("o.reference"), F.col("o.hypothesis")).alias("error_class")).agg(F.count(F.lit(1)).alias("times"))
