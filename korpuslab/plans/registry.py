"""Named queries over the test tables, each with the DuckDB SQL that checks it.

The tables hold no speech, so queries use documented stand-ins: a hypothesis is a
text whose token i (from 0) of row k is dropped if (i + k) % 11 = 0, else replaced by
``zzz`` if (i + k) % 13 = 0, else doubled if (i + k) % 17 = 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpuslab.functions.edit import char_distance, edit_counts, edit_script, error_rate
from korpuslab.functions.text import normalize_tr, normalize_tr_for_wer, once, pseudonym, stem, tokens
from korpuslab.operators import evidence, governance, pack, qc, scoring, selection, terms, transcription
from korpuslab.operators.ledger import claimable, fold, newest, stale_jobs

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files whose whole texts one task aligns: its Arrow batches, held by Spark and by Python, are a few times as large.
ALIGNED = 4 << 20


def spread(scan: DataFrame, per_task: int | None = None) -> DataFrame:
    """Rows of texts that are aligned next, dealt over as many tasks as the scan has, or as there are cores; or as many as splits have ``per_task`` bytes at most.

    Alignment costs far more than moving a text, and splits say nothing about rows: those of a file with few large row
    groups are empty but for as many.
    """
    spark, tasks = scan.sparkSession, scan.rdd.getNumPartitions()
    if per_task:
        number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
        tasks *= -(-(int(number) << 10 * " kmgtp".index(unit or " ")) // per_task)
    return scan.repartition(max(spark.sparkContext.defaultParallelism, tasks))


def derived(toks: Column, k: Column) -> Column:
    """The stand-in hypothesis of a token array."""
    none = F.array().cast("array<string>")
    one = lambda x, i: F.when((i + k) % 11 == 0, none).when((i + k) % 13 == 0, F.array(F.lit("zzz"))).when((i + k) % 17 == 0, F.array(x, x)).otherwise(F.array(x))
    return F.flatten(F.transform(toks, one))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, reference and hypothesis of every conversation turn."""
    rows = once(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), r=tokens(normalize_tr_for_wer("text")))
    return rows.select("conv_id", "turn", "role", F.array_join("r", " ").alias("reference"), F.array_join(derived(F.col("r"), F.col("conv_id") + F.col("turn")), " ").alias("hypothesis"))


def _scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.track(_pairs(spark, sf_dir), "reference", "hypothesis", "normalized", True)


def _edits(score: str = "normalized") -> Column:
    return F.col(f"{score}.insertions") + F.col(f"{score}.deletions") + F.col(f"{score}.substitutions")


def text_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), "text")
    rows = rows.unionByName(table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"))
    return rows.select("origin", "id", "part", F.sha2(normalize_tr("text"), 256).alias("normalized_sha256"), F.sha2(normalize_tr_for_wer("text"), 256).alias("wer_sha256"))


def tokenise_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(normalize_tr_for_wer("text"))).cast("bigint").alias("n_tokens"))


def _benchmark_tokens(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens(normalize_tr_for_wer("text")).alias("r"))
    return items.withColumn("h", derived(F.col("r"), F.col("item_id")))


def edit_counts_query(spark, sf_dir):
    rows = _benchmark_tokens(spark, sf_dir).withColumn("e", edit_counts(F.col("r"), F.col("h")))
    return rows.select("item_id", F.col("e.insertions").cast("bigint").alias("insertions"), F.col("e.deletions").cast("bigint").alias("deletions"), F.col("e.substitutions").cast("bigint").alias("substitutions"))


def wer_cer_by_role(spark, sf_dir):
    return scoring.micro(_scored_pairs(spark, sf_dir), ["role"])


def wer_by_lang(spark, sf_dir):
    """Word errors by language over whole documents; SQL has no script of texts of this length (``long_edits`` holds their distance against SQL)."""
    docs = once(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), r=tokens(normalize_tr_for_wer("text"))).drop("text")
    rows = docs.withColumn("e", edit_counts(F.col("r"), derived(F.col("r"), F.col("doc_id"))))
    sums = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("e.insertions")).alias("insertions"), F.sum(F.col("e.deletions")).alias("deletions"), F.sum(F.col("e.substitutions")).alias("substitutions"), F.sum(F.size("r")).alias("reference_words"))
    return sums.withColumn("wer", error_rate(F.col("insertions") + F.col("deletions") + F.col("substitutions"), F.col("reference_words")))


def long_edits(spark, sf_dir):
    """Whole documents, by the first letters of their words and by characters (ASCII, or a question mark): length of the script, and distances."""
    ascii_ = lambda c: F.regexp_replace(c, "[^\\x00-\\x7F]", "?")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), ALIGNED)
    docs = once(docs, w=tokens(ascii_(normalize_tr_for_wer("text")))).drop("text")
    docs = once(docs, r=F.transform("w", lambda x: F.substring(x, 1, 1)), c=F.array_join("w", " "), d=F.array_join(derived(F.col("w"), F.col("doc_id")), " "))
    h = derived(F.col("r"), F.col("doc_id"))
    rows = docs.select("doc_id", F.size("r").cast("bigint").alias("words"), edit_counts(F.col("r"), h).alias("e"), edit_script(F.col("r"), h).alias("s"), char_distance(F.col("c"), F.col("d")).cast("bigint").alias("char_edits"))
    steps = F.size(F.filter("s", lambda o: o["operation"] != "equal"))
    return rows.select("doc_id", "words", (F.col("e.insertions") + F.col("e.deletions") + F.col("e.substitutions")).cast("bigint").alias("edits"), steps.cast("bigint").alias("script_edits"), "char_edits")


def macro_by_turn(spark, sf_dir):
    rows = scoring.macro(_scored_pairs(spark, sf_dir), ["turn"])
    return rows.select("turn", "pairs", F.round("macro_wer", 9).alias("macro_wer"), F.round("macro_cer", 9).alias("macro_cer"))


def wer_buckets(spark, sf_dir):
    rows = _scored_pairs(spark, sf_dir)
    return rows.groupBy("role", scoring.wer_bucket(F.col("normalized.wer")).alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"))


def _triples(spark, sf_dir):
    """item_id, reference, before and after of benchmark items; after is the text, before again, or derived anew, by item_id % 3."""
    rows = table(spark, sf_dir, "benchmark").withColumn("r", tokens(normalize_tr_for_wer("text")))
    before, other = F.array_join(derived(F.col("r"), F.col("item_id")), " "), F.array_join(derived(F.col("r"), F.col("item_id") + 5), " ")
    rows = rows.select("item_id", F.col("text").alias("reference"), before.alias("before"), other.alias("other"))
    return rows.select("item_id", "reference", "before", F.when(F.col("item_id") % 3 == 0, F.col("reference")).when(F.col("item_id") % 3 == 1, F.col("before")).otherwise(F.col("other")).alias("after"))


def before_after(spark, sf_dir):
    return _triples(spark, sf_dir).select("item_id", scoring.classify_before_after(F.col("reference"), F.col("before"), F.col("after")).alias("change"))


def overcorrection(spark, sf_dir):
    return scoring.correction_summary(_triples(spark, sf_dir).withColumn("half", F.col("item_id") % 2), ["half"], "reference", "before", "after")


def hallucinated_tokens(spark, sf_dir):
    rows = _benchmark_tokens(spark, sf_dir)
    ghost = F.when(F.col("item_id") % 4 == 0, F.array(F.lit("ghost"))).otherwise(F.array().cast("array<string>"))
    out = F.concat(derived(F.col("r"), F.col("item_id") + 3), ghost)
    return rows.select("item_id", F.array_join(F.sort_array(scoring.hallucinated(F.col("r"), F.col("h"), out)), " ").alias("hallucinated"))


def top_substitutions(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", tokens(normalize_tr_for_wer("text")).alias("r"))
    rows = rows.withColumn("h", F.transform("r", lambda x, i: F.when((i + F.col("item_id")) % 5 == 0, F.lit("zzz")).otherwise(x)))
    return scoring.substitutions(rows, "r", "h", 20)


def _mentions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("mention_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    reference = rows.select("mention_id", F.col("l_partkey").cast("string").alias("term_id"), F.col("p_name").alias("surface"), F.array("p_type").alias("accepted_aliases"), F.col("p_brand").alias("suffix"), F.col("p_brand").alias("term_family"))
    k = F.col("l_orderkey")
    hypothesis = rows.where(k % 7 != 0).select(
        "mention_id", F.when(k % 5 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).cast("string").alias("term_id"),
        F.when(k % 3 == 0, F.col("p_type")).when(k % 4 == 0, F.concat(F.col("p_name"), F.lit("x"))).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(","))).alias("surface"),
        F.when(k % 11 == 0, F.lit("other")).otherwise(F.col("p_brand")).alias("suffix"),
    )
    return reference, hypothesis


def term_mentions(spark, sf_dir):
    reference, hypothesis = _mentions(spark, sf_dir)
    return terms.term_metrics(reference, hypothesis, ["term_family"])


def lexicon_match(spark, sf_dir):
    lexicon = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("form")).distinct().withColumn("canonical_term", F.upper("form"))
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.regexp_replace("p_name", "e", "ee").alias("text"))
    return terms.match_lexicon(texts, "text", lexicon, 1)


def inflected_match(spark, sf_dir):
    """Words of part names with an ending each: plural and case by harmony, every seventh misspelt, against the words themselves."""
    lexicon = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("form")).distinct().withColumn("canonical_term", F.upper("form"))
    k, back = F.col("p_partkey"), F.regexp_extract("w", "([aıoueiöü])[^aıoueiöü]*$", 1).isin("a", "ı", "o", "u")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.lower("p_name"), " ")).alias("i", "w"))
    ending = F.when((k + F.col("i")) % 3 == 0, F.when(back, "lardan").otherwise("lerden")).when((k + F.col("i")) % 3 == 1, F.when(back, "ların").otherwise("lerin")).otherwise("")
    word = F.when(k % 7 == 0, F.concat(F.substring("w", 1, 2), F.lit("x"), F.expr("substr(w, 3)"))).otherwise(F.col("w"))
    texts = rows.select((k * 10 + F.col("i")).alias("key"), F.concat(word, ending).alias("text"))
    return terms.match_inflected(texts, "text", lexicon, 1).drop("place")


def _clips(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("client_id"), F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.lit(".a.wav")).alias("path"), F.col("text").alias("sentence"), F.col("lang").alias("locale"), (F.col("doc_id") % 3).cast("string").alias("split"))


def clip_select(spark, sf_dir):
    rows = selection.wanted_rows(_clips(spark, sf_dir), split="1", locale="de").withColumn("found", F.col("path"))
    return selection.hash_sample(selection.clips_of(rows, "v1"), "clip_id", 50, 42).select("rank", "clip_id", "path", "speaker_id")


def speaker_distribution(spark, sf_dir):
    return _clips(spark, sf_dir).groupBy(pseudonym("v1", "client_id").alias("speaker_id")).agg(F.count(F.lit(1)).alias("clips"))


def missing_sources(spark, sf_dir):
    """Clips without a file: those whose id is divisible by 4 have one, directly or, if divisible by 8, below clips."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    files = rows.where("doc_id % 4 = 0").select(F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("clips/"), "path")).otherwise(F.col("path")).alias("path"))
    resolved = selection.resolve_files(rows, files)
    return resolved.groupBy("lang").agg(F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("found").startswith("clips/")).alias("below_clips"), F.count("found").alias("present"))


def clip_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", stem("url").alias("stem"), selection.escapes(F.concat(F.lit("a/"), F.when(F.col("page_id") % 3 == 0, F.lit("../../x")).otherwise(F.lit("../x")))).alias("escapes"))


def split_leakage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("term_family"), (F.col("doc_id") % 3).cast("string").alias("split"))
    return pack.leaking_families(rows)


def families_by_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("term_family"), (F.col("doc_id") % 2).cast("string").alias("split")).where("split = '0' OR term_family < 'src2'")
    return pack.families_by_split(rows).select("split", F.array_join(F.sort_array("families"), ",").alias("families"))


def group_leakage(spark, sf_dir):
    return evidence.leaking_groups(table(spark, sf_dir, "lineitem").withColumn("split", F.col("l_linenumber") % 2), "l_partkey", "split")


def lexicon_violations(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").cast("string").alias("canonical_term"))
    lexicon = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("canonical_term"), F.when(F.col("p_size") > 3, F.col("p_brand")).otherwise("").alias("source_id"), F.lit("uri").alias("source_uri"),
        F.when(F.col("p_size") % 10 == 0, "no").otherwise(" True ").alias("frozen_before_authoring"), F.col("p_partkey").alias("row_number_in_file"),
    )
    return pack.lexicon_violations(lexicon, known).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first_place"))


def family_mismatch(spark, sf_dir):
    families = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("term_id"), F.col("p_brand").alias("term_family"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_orderkey"), F.col("l_partkey").cast("string").alias("term_id"), F.when(F.col("l_orderkey") % 10 == 0, F.lit("none")).otherwise(F.col("p_brand")).alias("term_family"))
    return pack.family_mismatches(rows, families).groupBy("_family").agg(F.count(F.lit(1)).alias("sentences")).withColumnRenamed("_family", "family")


def freeze_digest(spark, sf_dir):
    return pack.table_digest(table(spark, sf_dir, "nation"), "digest", ["n_regionkey"], ["n_nationkey", "n_name"])


def _receipts(spark, sf_dir, changed: bool):
    key = F.col("c_custkey") + (F.col("c_custkey") % 5 == 0).cast("int") if changed else F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_custkey % 17 <> 0" if changed else "c_custkey % 19 <> 0")
    return rows.select(F.col("c_name").alias("path"), F.concat(F.lit("sha256:"), F.sha2(key.cast("string"), 256)).alias("checksum"))


def freeze_changes(spark, sf_dir):
    return pack.changed_files(_receipts(spark, sf_dir, False), _receipts(spark, sf_dir, True))


def qc_read(spark, sf_dir):
    t, text = F.col("turn"), F.col("text")
    observed = F.when((t + F.col("conv_id")) % 5 == 0, F.concat(F.lit("  "), F.lower(text), F.lit("\t"))).when((t + F.col("conv_id")) % 7 == 0, F.concat(text, F.lit(" extra"))).otherwise(text)
    k = F.col("conv_id") + t
    result = qc.qc_read(text, observed, k % 13 != 0, F.when(k % 6 != 0, "active").otherwise("withdrawn"), k % 2 == 0, k % 4 == 0, k % 17 == 0, k % 19 == 0, k % 8 == 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", result.alias("q")).select("conv_id", "turn", "q.status", F.array_join("q.reasons", ",").alias("reasons"), "q.pronunciation_variant")


def qc_spontaneous(spark, sf_dir):
    k = F.col("conv_id") + F.col("turn")
    result = qc.qc_spontaneous(F.when(k % 3 == 0, " \n").when(k % 5 == 0, F.lit(None)).otherwise(F.col("text")), k % 7 != 0, F.when(k % 11 != 0, "active"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", result.alias("q")).select("conv_id", "turn", "q.status", F.array_join("q.reasons", ",").alias("reasons"))


def _registry(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("place"), F.concat(F.when(k % 50 == 0, "raw-").otherwise("spk-"), F.when(k % 31 == 0, k - 1).otherwise(k).cast("string")).alias("speaker_id"),
        F.when(k % 4 == 0, "withdrawn").when(k % 41 == 0, "unknown").otherwise("active").alias("consent_status"), F.when(k % 37 == 0, "").otherwise(F.col("c_mktsegment")).alias("usage_scope"),
    )


def eligibility_violations(spark, sf_dir):
    return governance.eligibility_violations(_registry(spark, sf_dir), "place").select("place", "speaker_id", "violation")


def eligibility(spark, sf_dir):
    rows = governance.with_eligibility(_registry(spark, sf_dir))
    return governance.withdraw(rows, "spk-7").groupBy("usage_scope", "consent_status", "eligibility", "provenance", "qc_state").agg(F.count(F.lit(1)).alias("speakers"))


def public_export(spark, sf_dir):
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("url_path"), F.when(k % 3 == 0, F.concat(F.lit("/data/"), k.cast("string"))).when(k % 4 == 0, F.concat(F.lit("C:\\data\\"), k.cast("string"))).otherwise(F.concat(F.lit("clips/"), k.cast("string"))).alias("Audio_Path"))
    return governance.export_violations(rows)


def _ledger_events(spark, sf_dir):
    names = {"signup": "created", "view": "claimed", "purchase": "succeeded", "error": "failed", "click": "skipped"}
    event = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("event_type")]
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    return table(spark, sf_dir, "events").select("user_id", seq.alias("seq"), event.alias("event"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))


def ledger_state(spark, sf_dir):
    return fold(_ledger_events(spark, sf_dir), ["user_id"]).select("user_id", "status", "retry_count", "started_at", "finished_at")


def ledger_snapshot(spark, sf_dir):
    """The same states from two runs of states, the newer one of jobs touched since, and the events after them."""
    events = _ledger_events(spark, sf_dir)
    first = fold(events.where("seq <= 2"), ["user_id"]).withColumn("version", F.lit(1))
    tail = events.where("seq IN (3, 4)")
    second = fold(tail, ["user_id"], base=first.join(tail.select("user_id").distinct(), "user_id", "left_semi")).withColumn("version", F.lit(2))
    states = fold(events.where("seq > 4"), ["user_id"], base=newest(first.unionByName(second), ["user_id"]))
    return states.select("user_id", "status", "retry_count", "started_at", "finished_at")


def ledger_summary(spark, sf_dir):
    return ledger_state(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.sum("retry_count").alias("retries"))


def ledger_reconcile(spark, sf_dir):
    """Requests (all customers) against the ledger: new, reused, or left alone."""
    state = ledger_state(spark, sf_dir).select(F.col("user_id").alias("c_custkey"), "status")
    met = transcription.reconcile(table(spark, sf_dir, "customer"), state, ["c_custkey"])
    return met.groupBy(F.col("verdict").alias("kind")).agg(F.count(F.lit(1)).alias("requests"))


def round_outcomes(spark, sf_dir):
    """What recorded events came to, for each device's users."""
    recorded = _ledger_events(spark, sf_dir).where("event NOT IN ('created', 'claimed')").withColumn("bucket", F.col("user_id") % 10)
    return transcription.outcomes(recorded, ["bucket"])


def resource_gate(spark, sf_dir):
    rows = transcription.first_requests(table(spark, sf_dir, "events"), ["ts", "event_id"], transcription.GATE_CLIPS, ["user_id"])
    rows = rows.withColumn("status", F.when(F.col("event_type").isin("purchase", "view"), "succeeded").when(F.col("event_type") == "click", "skipped").otherwise("failed"))
    return transcription.gate_counts(rows, ["user_id"])


def fake_adapter(spark, sf_dir):
    k = F.col("conv_id")
    requests = table(spark, sf_dir, "conversations").select(F.lit("tr-1").alias("transcription_run_id"), F.concat_ws("-", "conv_id", "turn").alias("utterance_id"), F.lit("fake").alias("engine"), F.when(k % 9 == 0, F.create_map(F.lit("official_context"), F.lit("yes"))).otherwise(F.create_map(F.lit("language"), F.lit("tr"))).alias("decoding"), (k % 5 != 0).alias("there"))
    return transcription.fake_results(requests, F.col("there")).drop("protocol_version")


def result_validation(spark, sf_dir):
    k = F.col("event_id")
    results = table(spark, sf_dir, "events").select(
        F.when(k % 50 == 0, "old/v0").otherwise(transcription.PROTOCOL).alias("protocol_version"), k.cast("string").alias("utterance_id"), F.when(k % 40 == 0, "lost").when(k % 3 == 0, "failed").otherwise("succeeded").alias("status"),
        F.when(k % 7 == 0, " ").otherwise(F.col("event_type")).alias("transcript"), F.when(k % 11 != 0, "sha256:x").alias("output_checksum"),
    )
    return transcription.result_violations(results).groupBy("violation").agg(F.count(F.lit(1)).alias("results"))


def audit_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")
    return selection.stratified_sample(rows, ["lang", "quality"], "doc_id", 5, 7)


def dedup_text(spark, sf_dir):
    return evidence.distinct_keys(table(spark, sf_dir, "documents"), "doc_id", "text")


def pair_builder(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("utterance_id", F.concat_ws("-", "conv_id", "turn"))
    built = evidence.build_pairs(pairs.select("utterance_id", F.col("hypothesis").alias("text")), pairs.select("utterance_id", F.col("reference").alias("text")), "utterance_id")
    return built.groupBy("pair_type", "is_identity").agg(F.count(F.lit(1)).alias("pairs"))


def sliced_rates(spark, sf_dir):
    rows = _scored_pairs(spark, sf_dir).select("role", "turn", _edits().alias("edits"), F.col("normalized.reference_length").alias("words"))
    return evidence.sliced(rows, ["role", "turn"], "edits", "words").withColumn("macro_wer", F.round("macro_wer", 9))


def crossed_rates(spark, sf_dir):
    """Stand-in edits of documents by language, by source, by both and over all."""
    rows = table(spark, sf_dir, "documents").select("lang", "source", (F.col("n_chars") % 11).alias("edits"), F.expr("n_chars div 6").alias("words"))
    rates = evidence.crossed(rows, [["lang"], ["source"], ["lang", "source"], []], "edits", "words")
    return rates.withColumn("macro_wer", F.round("macro_wer", 9)).withColumn("grouping", F.col("grouping").cast("bigint"))


def rebalance(spark, sf_dir):
    """Identity pairs (labels of good quality) cut to two fifths of the result."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return evidence.rebalance_identity(rows, F.col("quality") == 1, "doc_id", 0.4, 11)


def engine_populations(spark, sf_dir):
    return evidence.engine_populations(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") > 10)


def all_engines(spark, sf_dir):
    return evidence.all_engine_intersection(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") > 10)


def coverage_verdict(spark, sf_dir):
    k = F.col("event_id")
    return evidence.coverage_verdict(table(spark, sf_dir, "events"), ["event_type"], k % 60 != 0, k % 7, k % 11 + 1)


def bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("b"), (F.col("doc_id") % 3).alias("a"), F.col("n_chars").alias("n"))
    return evidence.paired_bootstrap(rows, "doc_id", "b", "a", "n", 20).withColumn("difference", F.round("difference", 12))


def decision_matrix(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        "n_name", F.when(k % 9 == 0, 0.9).otherwise(0.99).alias("coverage"), F.when(k % 2 == 0, 0.95).otherwise(0.85).alias("canonical_accuracy"), (k * 2).alias("errors"), k.alias("families"), (k % 5).alias("error_speakers"), (k % 7 + 1).alias("speakers"),
        F.when(k % 3 == 0, 0.6).otherwise(0.1).alias("fixed"), F.lit(0).alias("new_errors"), F.lit(0.001).alias("damage"), F.lit(0.0).alias("worsening"), (k * 20).alias("pairs"),
    )
    return evidence.decide(rows).select("n_name", "decision")


def _retry_events(spark, sf_dir):
    """Attempts with retries and recoveries: purchases fail for now, clicks find a job stale."""
    names = {"signup": "created", "view": "claimed", "purchase": "retry", "error": "failed", "click": "recovered"}
    event = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("event_type")]
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select("user_id", (seq / 3).cast("bigint").alias("batch"), seq.alias("seq"), event.alias("event"), at.alias("at"), F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type")).alias("reason"))


def ledger_retries(spark, sf_dir):
    return fold(_retry_events(spark, sf_dir), ["user_id"]).select("user_id", "status", "retry_count", "error_reason", "started_at")


def _open_events(spark, sf_dir):
    """Events in the order of their ids that leave every job pending or running: purchases fail for now, errors are no event of a ledger's."""
    names = {"signup": "created", "view": "claimed", "purchase": "retry", "error": "noise", "click": "recovered"}
    event = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("event_type")]
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select("user_id", F.expr("event_id div 1000").alias("batch"), F.col("event_id").alias("seq"), event.alias("event"), at.alias("at"))


def ledger_stale(spark, sf_dir):
    """Jobs that run at the end of the log, and whether a recovery then would take them back."""
    events = _open_events(spark, sf_dir)
    rows = fold(events, ["user_id"]).join(F.broadcast(events.agg(F.max("at").alias("_now")))).where("status = 'running'")
    stale = stale_jobs(rows, F.col("_now"), 86400.0 * 5).select("user_id", F.lit(True).alias("stale"))
    judged = rows.select("user_id").join(stale, "user_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    return judged.groupBy("stale").agg(F.count(F.lit(1)).alias("jobs"))


def claim_order(spark, sf_dir):
    """The first pending jobs in the order in which they were created, with that place."""
    return claimable(fold(_open_events(spark, sf_dir), ["user_id"]), 25).select("user_id", F.col("job.batch").alias("batch"), F.col("job.seq").alias("seq"))


def sentence_rules(spark, sf_dir):
    """Sentences (orders) against terms (customers): unknown splits, other families, families in both splits."""
    k = F.col("o_custkey")
    terms_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("term_id"), F.col("c_mktsegment").alias("term_family"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), k == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("sentence_id"), F.when(F.col("o_orderkey") % 12 == 0, "train").when(F.col("c_mktsegment") < "D", pack.SPLITS[0]).otherwise(pack.SPLITS[1]).alias("split"),
        k.cast("string").alias("term_id"), F.when(F.col("o_orderkey") % 30 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("term_family"), F.col("o_orderkey").alias("row_number_in_file"),
    )
    return pack.sentence_violations(rows, terms_).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first_key"))


def request_validation(spark, sf_dir):
    k = F.col("event_id")
    blank = lambda n: F.when(k % n == 0, "").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(
        F.when(k % 50 == 0, "old/v0").otherwise(transcription.PROTOCOL).alias("protocol_version"), blank(40).alias("transcription_run_id"), k.cast("string").alias("utterance_id"), blank(7).alias("engine"),
        F.when(k % 11 != 0, "rev").alias("model_revision"), F.when(k % 13 != 0, "a.wav").alias("audio_path"), F.lit("out").alias("output_dir"),
    )
    return transcription.request_violations(rows).groupBy("violation").agg(F.count(F.lit(1)).alias("requests"))


def claimed_requests(spark, sf_dir):
    """Claimed jobs meet their requests by utterance and engine: orders by customer and priority against those still open."""
    requests = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("utterance_id"), F.col("o_orderpriority").alias("engine")).distinct()
    claimed = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").cast("string").alias("utterance_id"), F.col("o_orderpriority").alias("engine")).distinct()
    return transcription.claimed_of(requests, claimed).groupBy("engine").agg(F.count(F.lit(1)).alias("jobs"))


def unsafe_speakers(spark, sf_dir):
    k = F.col("c_custkey")
    speaker = F.when(k % 9 == 0, F.concat(F.lit("../"), k.cast("string"))).when(k % 10 == 0, "..").when(k % 14 == 0, F.concat(F.lit("a\\"), k.cast("string"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", governance.unsafe_id(speaker).alias("unsafe"))


def quarantine(spark, sf_dir):
    """Withdrawals of customers, some deleted already, with tokens and deadlines."""
    k = F.col("c_custkey")
    token = governance.exclusion_token(F.col("c_name"), (k * 1000).cast("string"), "sha256:m")
    held = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(token.alias("token"), F.col("c_name").alias("speaker_id"), F.explode(F.array(F.lit("held"), F.when(k % 2 == 0, "deleted"))).alias("event"), (k * 1000).cast("double").alias("at")).where("event IS NOT NULL")
    state = governance.quarantine_state(held.withColumn("at", F.when(F.col("event") == "deleted", F.col("at") + 700_000).otherwise(F.col("at"))), 1_000_000.0)
    return state.select("token", "speaker_id", "quarantine_until", "backup_expiry", "due")


def error_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", tokens(normalize_tr_for_wer("text")).alias("r"))
    wrong = F.transform("r", lambda x, i: F.when((i + F.col("item_id")) % 4 == 0, F.concat(x, F.lit("'"))).when((i + F.col("item_id")) % 4 == 1, F.concat(x, F.lit("lar"))).when((i + F.col("item_id")) % 9 == 2, F.lit("42")).otherwise(x))
    return scoring.error_classes(rows.withColumn("h", wrong), "r", "h")


def evaluation_rows(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("utterance_id", F.concat_ws("-", "conv_id", "turn"))
    built = evidence.build_pairs(pairs.select("utterance_id", F.col("hypothesis").alias("text")), pairs.select("utterance_id", F.col("reference").alias("text")), "utterance_id")
    rows = evidence.evaluation_rows(built, "utterance_id", {"source_dataset": F.lit("conversations"), "source_record": F.col("utterance_id"), "asr_engine": F.lit("stand-in")})
    return rows.groupBy("source_dataset", "asr_engine", "pair_type", scoring.wer_bucket(F.col("wer_before")).alias("bucket")).agg(F.count("id").alias("rows"), F.count("source_record").alias("records"), F.count("speaker_id").alias("speakers"))


def manifest_verify(spark, sf_dir):
    """Selected clips whose file is gone or changed: checksums taken then against those taken now."""
    old = _receipts(spark, sf_dir, False).where("path LIKE '%5'")
    return selection.changed_clips(old, _receipts(spark, sf_dir, True)).groupBy("verdict").agg(F.count(F.lit(1)).alias("clips"))


QUERIES = {
    "ledger_retries": ledger_retries, "ledger_stale": ledger_stale, "claim_order": claim_order, "sentence_rules": sentence_rules, "request_validation": request_validation, "claimed_requests": claimed_requests, "unsafe_speakers": unsafe_speakers,
    "quarantine": quarantine, "error_classes": error_classes, "evaluation_rows": evaluation_rows, "manifest_verify": manifest_verify,
    "text_normalize": text_normalize, "tokenise_counts": tokenise_counts, "edit_counts": edit_counts_query, "wer_cer_by_role": wer_cer_by_role, "wer_by_lang": wer_by_lang, "long_edits": long_edits, "macro_by_turn": macro_by_turn, "wer_buckets": wer_buckets,
    "before_after": before_after, "overcorrection": overcorrection, "hallucinated_tokens": hallucinated_tokens, "top_substitutions": top_substitutions, "term_mentions": term_mentions, "lexicon_match": lexicon_match, "inflected_match": inflected_match,
    "clip_select": clip_select, "speaker_distribution": speaker_distribution, "missing_sources": missing_sources, "clip_stems": clip_stems, "split_leakage": split_leakage, "families_by_split": families_by_split, "group_leakage": group_leakage,
    "lexicon_violations": lexicon_violations, "family_mismatch": family_mismatch, "freeze_digest": freeze_digest, "freeze_changes": freeze_changes, "qc_read": qc_read, "qc_spontaneous": qc_spontaneous,
    "eligibility_violations": eligibility_violations, "eligibility": eligibility, "public_export": public_export, "ledger_state": ledger_state, "ledger_snapshot": ledger_snapshot, "round_outcomes": round_outcomes, "crossed_rates": crossed_rates, "rebalance": rebalance, "ledger_summary": ledger_summary, "ledger_reconcile": ledger_reconcile,
    "resource_gate": resource_gate, "fake_adapter": fake_adapter, "result_validation": result_validation, "audit_sample": audit_sample, "dedup_text": dedup_text, "pair_builder": pair_builder, "sliced_rates": sliced_rates,
    "engine_populations": engine_populations, "all_engines": all_engines, "coverage_verdict": coverage_verdict, "bootstrap": bootstrap, "decision_matrix": decision_matrix,
}

from korpuslab.plans.oracles import ORACLE_SQL as ORACLE_SQL  # noqa: E402
