"""Turkish noun endings: which chains of them may follow a stem.

A small automaton with slots for plural, possessive, case and copula writes out every chain for every kind of stem:
its last vowel sets the vowels that follow, its last letter the buffers and whether d and c harden. Chains are finite,
so a token is split by looking its ends up in a table of fixed size.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vowels by the close vowel that follows them; consonants after which d and c harden.
HARMONY = {"a": "ı", "ı": "ı", "o": "u", "u": "u", "e": "i", "i": "i", "ö": "ü", "ü": "ü", "â": "ı", "î": "i", "û": "u"}
HARD = "fstkçşhpqx"
#: Endings. A is a or e, I the close vowel, D is d or t, C is c or ç; what is in brackets comes after a
#: vowel if it is a consonant, and after a consonant if it is a vowel.
PLURAL = ["lAr"]
POSSESSIVE = ["(I)m", "(I)n", "(I)mIz", "(I)nIz"]
THIRD = ["(s)I"]
CASES = ["(y)I", "(y)A", "DA", "DAn", "(n)In", "(y)lA", "CA"]
CASES_OF_THIRD = ["nI", "nA", "ndA", "ndAn", "nIn", "ylA", "ncA"]
COPULA = ["DIr", "(y)DI"]


def spell(ending: str, close: str, end: str) -> tuple[str, str, str]:
    """An ending after a stem of that close vowel and last letter's kind (vowel, hard, soft); and both after it."""
    out, skip = "", False
    for i, c in enumerate(ending):
        if c == "(":
            skip = (end == "vowel") == (ending[i + 1] == "I")
            continue
        if c == ")":
            skip = False
            continue
        if skip:
            continue
        hard = (out[-1] in HARD) if out else end == "hard"
        if c == "I":
            c = close
        elif c == "A":
            c = "a" if close in "ıu" else "e"
            close = "ı" if c == "a" else "i"
        elif c in "DC":
            c = {"D": "dt", "C": "cç"}[c][hard]
        out += c
    end = "vowel" if out[-1] in HARMONY else "hard" if out[-1] in HARD else "soft"
    return out, close, end


@cache
def chains(close: str, end: str) -> frozenset[str]:
    """Every chain of endings after such a stem; the empty one is not among them."""
    slots = {
        "stem": [(PLURAL, "plural"), (POSSESSIVE, "possessive"), (THIRD, "third"), (CASES, "case"), (COPULA, "last")],
        "plural": [(POSSESSIVE, "possessive"), (THIRD, "third"), (CASES, "case"), (COPULA, "last")],
        "possessive": [(CASES, "case"), (COPULA, "last")], "third": [(CASES_OF_THIRD, "case"), (COPULA, "last")], "case": [(COPULA, "last")], "last": [],
    }

    def after(slot: str, close: str, end: str):
        for endings, then in slots[slot]:
            for ending in endings:
                text, close_, end_ = spell(ending, close, end)
                yield text
                yield from (text + more for more in after(then, close_, end_))

    return frozenset(after("stem", close, end))


def chain_table(spark: SparkSession) -> DataFrame:
    """close, end and suffix: all chains, a few thousand rows; a stem without a vowel takes those of any."""
    kinds = [(c, e) for c in "ıuiü" for e in ("vowel", "hard", "soft")]
    rows = {(c, e, s) for c, e in kinds for s in chains(c, e)} | {("", e, s) for c, e in kinds for s in chains(c, e)}
    return spark.createDataFrame(sorted(rows), "close string, end string, suffix string")


def stem_kind(stem: Column) -> list[Column]:
    """The close vowel and the last letter's kind of a stem."""
    vowels = "".join(HARMONY)
    last = F.regexp_extract(stem, f"([{vowels}])[^{vowels}]*$", 1)
    close = F.translate(last, vowels, "".join(HARMONY.values()))
    return [close.alias("close"), F.when(stem.rlike(f"[{vowels}]$"), "vowel").when(stem.rlike(f"[{HARD}]$"), "hard").otherwise("soft").alias("end")]


def stems(tokens: DataFrame, token: str = "token", least: int = 3) -> DataFrame:
    """token, stem, suffix: each distinct token whole, before an apostrophe, and without each chain of endings that may follow what is left."""
    words = tokens.select(F.col(token).alias("token")).where("token <> ''").distinct()
    whole = words.select("token", F.col("token").alias("stem"), F.lit("").alias("suffix"))
    marked = words.where("instr(token, chr(39)) > 1").select("token", F.regexp_extract("token", "^(.*?)'", 1).alias("stem"), F.regexp_extract("token", "'(.*)$", 1).alias("suffix"))
    cut = words.where(F.length("token") > least).where("instr(token, chr(39)) = 0").select("token", F.explode(F.sequence(F.lit(least), F.length("token") - 1)).alias("n"))
    cut = cut.select("token", F.substr("token", F.lit(1), F.col("n")).alias("stem"), F.substr("token", F.col("n") + 1).alias("suffix"))
    cut = cut.select("token", "stem", "suffix", *stem_kind(F.col("stem"))).join(F.broadcast(chain_table(tokens.sparkSession)), ["close", "end", "suffix"], "left_semi")
    return whole.unionByName(marked).unionByName(cut.select("token", "stem", "suffix")).distinct()
