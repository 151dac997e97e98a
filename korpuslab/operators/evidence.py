"""Evidence over evaluated corpora: populations, slices, samples, intervals and the decision matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpuslab.functions.edit import error_rate, safe_ratio
from korpuslab.functions.text import normalize_tr_for_wer
from korpuslab.operators.scoring import track
from korpuslab.operators.selection import sample_order
from korpuslab.schemas import EVALUATION_ROW

MINIMUM_COVERAGE = 0.98
#: Gates on term accuracy, errors, families, speakers; share fixed, damage, worsening in points; error pairs.
GATES = {"canonical_accuracy": 0.90, "errors": 25, "families": 10, "speakers": 2, "least_speakers": 3, "fixed": 0.50, "damage": 0.01, "worsening": 0.005, "pairs": 200}


def engine_populations(results: DataFrame, utterance: str, engine: str, ok: Column) -> DataFrame:
    """For each pair of engines the utterances both have, and both did; an engine with itself is its whole population."""
    rows = results.groupBy(F.col(utterance).alias("u"), F.col(engine).alias("e")).agg(F.bool_or(ok).alias("ok"))
    other = rows.select("u", F.col("e").alias("engine_b"), F.col("ok").alias("ok_b"))
    pairs = rows.withColumnRenamed("e", "engine_a").join(other, "u").where("engine_a <= engine_b")
    return pairs.groupBy("engine_a", "engine_b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("ok") & F.col("ok_b")).alias("both_succeeded"))


def all_engine_intersection(results: DataFrame, utterance: str, engine: str, ok: Column) -> DataFrame:
    """Utterances on which every engine of the results succeeded."""
    engines = results.select(engine).distinct().count()
    return results.where(ok).groupBy(utterance).agg(F.countDistinct(engine).alias("_n")).where(F.col("_n") == engines).select(utterance)


def coverage_verdict(results: DataFrame, by: list[str], ok: Column, edits: Column, length: Column) -> DataFrame:
    """Coverage, the verdict on it, the rate of what succeeded, and the rate if failures had said nothing at all."""
    sums = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.sum(F.when(ok, edits).otherwise(0)).alias("edits"), F.sum(F.when(ok, length).otherwise(0)).alias("words"), F.sum(F.when(ok, edits).otherwise(length)).alias("pessimistic_edits"), F.sum(length).alias("all_words"),
    )
    coverage = safe_ratio(F.col("succeeded"), F.col("total"))
    return sums.withColumns({"coverage": coverage, "verdict": F.when(coverage >= MINIMUM_COVERAGE, "EVIDENCE_COMPLETE").otherwise("EVIDENCE_INCOMPLETE"), "wer": error_rate(F.col("edits"), F.col("words")), "pessimistic_wer": error_rate(F.col("pessimistic_edits"), F.col("all_words"))})


def sliced(df: DataFrame, slices: list[str], edits: str, length: str) -> DataFrame:
    """Micro and macro rates of each slice column by itself and of everything, in one pass; ``slice`` names the column."""
    per = df.withColumn("_rate", error_rate(F.col(edits), F.col(length)))
    names = F.array(F.struct(F.lit("all").alias("slice"), F.lit("").alias("value")), *(F.struct(F.lit(c).alias("slice"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in slices))
    rows = per.select(edits, length, "_rate", F.explode(names).alias("s"))
    sums = rows.groupBy("s.slice", "s.value").agg(F.count(F.lit(1)).alias("pairs"), F.sum(edits).alias("edits"), F.sum(length).alias("words"), F.avg("_rate").alias("macro_wer"))
    return sums.withColumn("micro_wer", error_rate(F.col("edits"), F.col("words")))


def leaking_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups (a recording, a speaker) whose rows are in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits"), F.count(F.lit(1)).alias("rows")).where("splits > 1")


def poisson_weight(seed: Column) -> Column:
    """A weight with a Poisson(1) distribution from a digest's first 32 bits; it is 8 at most."""
    u = F.conv(F.substring(F.md5(seed.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    out, total, p = F.lit(8), [], 0.36787944117144233
    s = 0.0
    for k in range(8):
        s += p
        total.append(s)
        p /= k + 1
    for k in reversed(range(8)):
        out = F.when(u < total[k], k).otherwise(out)
    return out


def paired_bootstrap(df: DataFrame, unit: str, before: str, after: str, length: str, replicates: int = 100, seed: int = 0) -> DataFrame:
    """The difference of corpus rates (after - before) in each replicate. Replicates are summed where the rows are."""
    rows = df.select(unit, before, after, length, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    rows = rows.withColumn("_w", poisson_weight(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(unit).cast("string"))))
    sums = rows.groupBy("replicate").agg(F.sum(F.col("_w") * F.col(before)).alias("b"), F.sum(F.col("_w") * F.col(after)).alias("a"), F.sum(F.col("_w") * F.col(length)).alias("n"))
    return sums.select("replicate", (safe_ratio(F.col("a"), F.col("n")) - safe_ratio(F.col("b"), F.col("n"))).alias("difference"))


def interval(differences: DataFrame, level: float = 0.95) -> DataFrame:
    low = (1 - level) / 2
    return differences.agg(F.percentile("difference", low).alias("low"), F.percentile("difference", 1 - low).alias("high"), F.avg("difference").alias("mean"))


def crossed(df: DataFrame, combinations: list[list[str]], edits: str, length: str) -> DataFrame:
    """Micro and macro rates of every combination of columns asked for, in one pass by grouping sets.

    ``grouping`` has a bit for each column, the first the highest, that is 0 where the combination holds it; a column
    the combination lacks is null. The empty combination is the whole corpus.
    """
    columns = list(dict.fromkeys(c for some in combinations for c in some))
    per = df.withColumn("_rate", error_rate(F.col(edits), F.col(length)))
    sums = per.groupingSets([[F.col(c) for c in some] for some in combinations], *columns).agg(
        F.grouping_id(*columns).alias("grouping"), F.count(F.lit(1)).alias("pairs"), F.sum(edits).alias("edits"), F.sum(length).alias("words"), F.avg("_rate").alias("macro_wer"),
    )
    return sums.withColumn("micro_wer", error_rate(F.col("edits"), F.col("words")))


def kth_digest(rows: DataFrame, digest: str, k: int, digits: int = 4) -> str | None:
    """The k-th smallest of lower-case hex digests; None if there are fewer.

    Each round counts the next digits of those that share the prefix found so far, so the driver sees 16 to the power
    of ``digits`` counts at most, whatever the table's size; nothing is sorted.
    """
    found, left = "", k
    while True:
        at = len(found)
        counts = rows.where(F.col(digest).startswith(found)).groupBy(F.substring(digest, at + 1, digits).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("least"), F.max(digest).alias("most"))
        for row in sorted(counts.collect()):
            if left <= row["n"]:
                break
            left -= row["n"]
        else:
            return None
        if row["least"] == row["most"]:
            return row["least"]
        if left == row["n"]:
            return row["most"]
        if left == 1:
            return row["least"]
        found += row["d"]


def rebalance_identity(df: DataFrame, identity: Column, key: str, share: float, seed: int = 0) -> DataFrame:
    """All pairs with errors, and as many identity pairs as make up ``share`` of the result, rounded down, the first in seeded order.

    With fewer, or a share of 1, which errors make impossible, all of them stay. Rows that share a key stay or go
    together: keys tell rows apart where the count is to be exact.
    """
    flagged = df.withColumn("_identity", F.coalesce(identity, F.lit(False))).withColumn("_digest", sample_order(seed, key))
    counts = flagged.agg(F.count_if("_identity").alias("i"), F.count_if(~F.col("_identity")).alias("e")).first()
    want = counts["i"] if share >= 1 else min(counts["i"], int(share / (1 - share) * counts["e"]))
    if want < counts["i"]:
        last = kth_digest(flagged.where("_identity"), "_digest", want) if want > 0 else ""
        flagged = flagged.where(~F.col("_identity") | (F.col("_digest") <= F.lit(last)))
    return flagged.drop("_identity", "_digest")


def build_pairs(hypotheses: DataFrame, references: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Hypothesis and reference of each key, raw and normalised, and whether they agree."""
    h = hypotheses.select(key, F.col(text).alias("hypothesis_raw"))
    r = references.select(key, F.col(text).alias("reference_raw"))
    pairs = h.join(r, key).withColumns({"hypothesis_normalized": normalize_tr_for_wer("hypothesis_raw"), "reference_normalized": normalize_tr_for_wer("reference_raw")})
    identity = F.col("hypothesis_normalized") == F.col("reference_normalized")
    return pairs.withColumns({"is_identity": identity, "pair_type": F.when(identity, "identity").otherwise("error")})


def evaluation_rows(pairs: DataFrame, key: str, given: dict[str, Column]) -> DataFrame:
    """Built pairs in the layout of ``EVALUATION_ROW``: with the error rate before correction and what ``given`` says of each pair.

    Columns of the layout that neither has are null.
    """
    rows = track(pairs, "reference_raw", "hypothesis_raw", "_score", True)
    known = {"id": F.col(key).cast("string"), "wer_before": F.col("_score.wer")} | {c: F.col(c) for c in pairs.columns} | given
    return rows.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVALUATION_ROW.fields))


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row, that with the least key, of the rows whose texts agree once normalised; only digests are shuffled with keys."""
    return df.join(distinct_keys(df, key, text), key, "left_semi")


def distinct_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys alone of the rows that ``distinct_texts`` keeps: one scan, and one shuffle of digests."""
    digest = F.sha2(normalize_tr_for_wer(F.coalesce(F.col(text), F.lit(""))), 256)
    return df.select(key, digest.alias("_digest")).groupBy("_digest").agg(F.min(key).alias(key)).select(key)


def decide(metrics: DataFrame) -> DataFrame:
    """The decision for each row of measured metrics, by fixed precedence.

    Incomplete evidence comes first, then no problem, then a cheap baseline that is good enough, then
    training if there are enough error pairs. Needs coverage, canonical_accuracy, errors, families,
    error_speakers, speakers, fixed, new_errors, damage, worsening and pairs.
    """
    c, g = F.col, GATES
    problem = (c("canonical_accuracy") <= g["canonical_accuracy"]) | ((c("errors") >= g["errors"]) & (c("families") >= g["families"]) & (c("error_speakers") >= g["speakers"]))
    cheap = (c("fixed") >= g["fixed"]) & (c("new_errors") == 0) & (c("damage") <= g["damage"]) & (c("worsening") <= g["worsening"])
    out = F.when((c("coverage") < MINIMUM_COVERAGE) | (c("speakers") < g["least_speakers"]), "EVIDENCE_INCOMPLETE").when(~problem, "PROBLEM_NOT_SHOWN").when(cheap, "CHEAP_BASELINE_SUFFICIENT").when(c("pairs") >= g["pairs"], "PROMOTE_TO_MODEL_TRAINING").otherwise("EVIDENCE_INCOMPLETE")
    return metrics.withColumn("decision", out)
