"""Technical terms: how many mentions a hypothesis keeps in surface, identity and suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpuslab.functions.edit import edit_script, safe_ratio
from korpuslab.functions.suffixes import stems
from korpuslab.functions.text import normalize_tr_for_wer, tokens

def term_flags(reference: DataFrame, hypothesis: DataFrame, order: Column | None = None) -> DataFrame:
    """``reference`` with flags surface_ok, canonical_ok, suffix_ok and damaged.

    A missing mention has nothing right and is damaged; extra hypothesis mentions play no part.
    Of several hypotheses for a mention the last in ``order`` counts. Surfaces, aliases and
    suffixes are compared as normalised for scoring.
    """
    aliases = F.coalesce(F.col("accepted_aliases"), F.array().cast("array<string>"))
    got = hypothesis.select("mention_id", F.struct(F.col("term_id").alias("term"), F.col("surface").alias("surface"), F.coalesce("suffix", F.lit("")).alias("suffix")).alias("_got"), (F.monotonically_increasing_id() if order is None else order).alias("_at"))
    got = got.groupBy("mention_id").agg(F.max_by("_got", "_at").alias("_got"))
    met = reference.join(got, "mention_id", "left").withColumn("_found", F.col("_got").isNotNull())
    canonical = F.coalesce(F.col("_got.term") == F.col("term_id"), F.lit(False))
    met = met.withColumn("_wanted", normalize_list(F.concat(F.array(F.coalesce("surface", F.lit(""))), aliases)))
    surface = F.array_contains(F.col("_wanted"), normalize_tr_for_wer(F.coalesce(F.col("_got.surface"), F.lit(""))))
    suffix = normalize_tr_for_wer(F.col("_got.suffix")) == normalize_tr_for_wer(F.coalesce(F.col("suffix"), F.lit("")))
    flags = {"surface_ok": surface, "canonical_ok": canonical, "suffix_ok": suffix}
    met = met.withColumns({name: F.col("_found") & F.coalesce(flag, F.lit(False)) for name, flag in flags.items()})
    return met.withColumn("damaged", ~F.col("canonical_ok")).drop("_got", "_found", "_wanted")


#: A character that no text holds and normalisation leaves alone, to carry a list through one call.
_BAR = "\U000f0000"


def normalize_list(texts: Column) -> Column:
    """``normalize_tr_for_wer`` of each text of an array, in one pass over the joined array."""
    joined = normalize_tr_for_wer(F.array_join(texts, f" {_BAR} ", ""))
    return F.transform(F.split(joined, _BAR), lambda t: F.trim(t))


def term_metrics(reference: DataFrame, hypothesis: DataFrame, by: list[str] = (), order: Column | None = None) -> DataFrame:
    """Counts and rates over all expected mentions, or for each slice; no mention gives rates of 0."""
    flags = term_flags(reference, hypothesis, order)
    sums = flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("surface_ok").alias("surface_correct"), F.count_if("canonical_ok").alias("canonical_correct"),
        F.count_if("suffix_ok").alias("suffix_preserved"), F.count_if("damaged").alias("identity_damage"),
    )
    rates = {"surface_accuracy": "surface_correct", "canonical_accuracy": "canonical_correct", "suffix_preservation": "suffix_preserved"}
    return sums.withColumns({name: safe_ratio(F.col(part), F.col("total")) for name, part in rates.items()})


def deletions(c: Column, most: int) -> Column:
    """A text and all that is left of it when up to ``most`` characters go. Two texts within that distance share one."""
    out = level = F.array(c)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))).otherwise(F.array(x)))))
        out = F.array_union(out, level)
    return out


#: Letters that sound alike when Turkish is heard badly, and what stands for them.
_ALIKE, _SOUNDS = "çğıöşüwvyqxbdgzj", "cgiosuvfikkptksc"


def phonetic_key(c: Column) -> Column:
    """The consonants of a word as they sound, after its first letter; neighbours that sound alike are one."""
    plain = F.regexp_replace(F.translate(c, _ALIKE, _SOUNDS), "[^a-z0-9]", "")
    return F.regexp_replace(F.concat(F.substring(plain, 1, 1), F.regexp_replace(F.substr(plain, F.lit(2)), "[aeiou]", "")), "(.)\\1+", "$1")


def match_lexicon(df: DataFrame, text: str, lexicon: DataFrame, furthest: int = 2, trace: bool = False) -> DataFrame:
    """Tokens near a lexicon form, with the edit distance; a token as near to two terms is left alone (abstained).

    ``df`` has ``key`` and a text column, ``lexicon`` canonical_term and form. A form of several words meets as
    many neighbouring tokens. A token also matches with a Turkish suffix after an apostrophe cut off. Distinct
    tokens meet forms by what both leave when up to ``furthest`` characters go, so no near pair is missed and
    frequent tokens count once. ``trace`` adds the form, the edit script between them by characters, and
    whether both sound alike.
    """
    forms = lexicon.select("canonical_term", normalize_tr_for_wer("form").alias("form")).where("form <> ''").distinct()
    sizes = sorted(r["n"] for r in forms.select(F.size(F.split("form", " ")).alias("n")).distinct().collect())  # lengths of terms in words
    words = df.select("key", F.split(normalize_tr_for_wer(text), " ").alias("_w"))
    none = F.array().cast("array<struct<place:int,token:string>>")

    def grams(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.struct((i - 1).cast("int").alias("place"), F.array_join(F.slice("_w", i, n), " ").alias("token")))
        return F.when(F.size("_w") >= n, at).otherwise(none)

    words = words.select("key", F.explode(F.concat(none, *map(grams, sizes))).alias("g")).select("key", "g.place", "g.token").where("token <> ''")
    words = words.withColumn("bare", F.regexp_extract("token", "^(.*?)('[^' ]*)?$", 1)).where("bare <> ''")
    filed = lambda rows, c: rows.withColumn("_left", F.explode(deletions(F.col(c), furthest)))
    near = filed(words.select("bare").distinct(), "bare").join(filed(forms, "form"), "_left").select("bare", "canonical_term", "form").distinct()
    near = near.withColumn("distance", F.levenshtein("bare", "form", furthest)).where(f"distance BETWEEN 0 AND {furthest}")
    best = near.groupBy("bare").agg(F.min(F.struct("distance", "canonical_term", "form")).alias("_best"), F.collect_set(F.struct("distance", "canonical_term")).alias("_all"))
    tied = F.size(F.array_distinct(F.transform(F.filter("_all", lambda x: x["distance"] == F.col("_best.distance")), lambda x: x["canonical_term"]))) > 1
    best = best.select("bare", F.when(~tied, F.col("_best.canonical_term")).alias("canonical_term"), F.col("_best.distance").alias("distance"), tied.alias("abstained"), F.col("_best.form").alias("form"))
    more = []
    if trace:
        letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
        best = best.withColumns({"edits": edit_script(letters("bare"), letters("form")), "sounds_alike": phonetic_key(F.col("bare")) == phonetic_key(F.col("form"))})
        more = ["form", "edits", "sounds_alike"]
    return words.join(best, "bare").select("key", "place", "token", "canonical_term", "distance", "abstained", *more)


#: How a stem met a form, best first.
HOW = ("exact", "near", "sound")


def match_inflected(df: DataFrame, text: str, lexicon: DataFrame, furthest: int = 1) -> DataFrame:
    """Tokens whose stem is a lexicon form, is within ``furthest`` edits of one, or sounds like one; a tie of two terms abstains.

    ``df`` has ``key`` and a text column, ``lexicon`` canonical_term and form, of one word each. Endings go by the
    chains that may follow a stem, or after an apostrophe. The best match of a token is the one of the least kind
    (``how``), then distance, then ending; stems of less than three letters, and sounds of less than three consonants,
    match only as they are. Null and empty texts, and tokens near nothing, give no row; an empty lexicon gives none.
    """
    forms = lexicon.select("canonical_term", normalize_tr_for_wer("form").alias("form")).where("form <> '' AND instr(form, ' ') = 0").distinct()
    words = df.select("key", F.posexplode(tokens(normalize_tr_for_wer(text))).alias("place", "token"))
    parts = stems(words)
    distinct = parts.select("stem").distinct()
    exact = distinct.join(forms, F.col("stem") == F.col("form")).select("stem", "canonical_term", "form", F.lit(0).alias("how"), F.lit(0).alias("distance"))
    filed = lambda rows, c: rows.where(F.length(c) >= 3).withColumn("_left", F.explode(deletions(F.col(c), furthest)))
    near = filed(distinct, "stem").join(filed(forms, "form"), "_left").select("stem", "canonical_term", "form").distinct()
    near = near.withColumn("distance", F.levenshtein("stem", "form", furthest)).where(f"distance BETWEEN 1 AND {furthest}")
    sound = lambda rows, c: rows.withColumn("_key", phonetic_key(F.col(c))).where("length(_key) >= 3")
    alike = sound(distinct, "stem").join(sound(forms, "form"), "_key").where("stem <> form").withColumn("distance", F.levenshtein("stem", "form"))
    met = exact.unionByName(near.withColumn("how", F.lit(1))).unionByName(alike.drop("_key").withColumn("how", F.lit(2)))
    ranked = parts.join(met, "stem").withColumn("_rank", F.struct("how", "distance", F.length("suffix").alias("n")))
    best = ranked.groupBy("token").agg(F.min(F.struct("_rank", "canonical_term", "form", "stem", "suffix")).alias("b"), F.collect_set(F.struct("_rank", "canonical_term")).alias("_all"))
    tied = F.size(F.array_distinct(F.transform(F.filter("_all", lambda x: x["_rank"] == F.col("b._rank")), lambda x: x["canonical_term"]))) > 1
    best = best.select("token", F.when(~tied, F.col("b.canonical_term")).alias("canonical_term"), "b.form", "b.stem", "b.suffix", F.element_at(F.array(*map(F.lit, HOW)), F.col("b._rank.how") + 1).alias("how"), F.col("b._rank.distance").alias("distance"), tied.alias("abstained"))
    return words.join(best, "token").select("key", "place", "token", "canonical_term", "form", "stem", "suffix", "how", "distance", "abstained")
