"""Quality checks of recordings as ordered lists of reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korpuslab.functions.text import collapse, fold_plain


def _result(checks: list[tuple[Column, str]], variant: Column) -> Column:
    reasons = F.filter(F.array(*(F.when(bad, name) for bad, name in checks)), lambda r: r.isNotNull())
    return F.struct(F.when(F.size(reasons) == 0, "passed").otherwise("failed").alias("status"), reasons.alias("reasons"), variant.alias("pronunciation_variant"))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _no_consent(consent: Column) -> Column:
    return ~_yes(consent == "active")


def qc_read(reference: Column, observed: Column, audio: Column, consent: Column, variant: Column, clear: Column, clipping: Column, corruption: Column, artificial: Column) -> Column:
    """Status, reasons in a fixed order, and whether an accepted pronunciation variant excuses other words."""
    excused = _yes(variant) & _yes(clear) & ~_yes(artificial)
    same = fold_plain(F.coalesce(reference, F.lit(""))) == fold_plain(F.coalesce(observed, F.lit("")))
    checks = [(~_yes(audio), "missing_audio"), (_no_consent(consent), "missing_consent"), (_yes(clipping), "clipping"), (_yes(corruption), "corruption"), (_yes(artificial), "artificial_spelling"), (~same & ~excused, "content_mismatch")]
    return _result(checks, excused)


def qc_spontaneous(manual_reference: Column, audio: Column, consent: Column) -> Column:
    missing = collapse(F.coalesce(manual_reference, F.lit(""))) == ""
    return _result([(~_yes(audio), "missing_audio"), (_no_consent(consent), "missing_consent"), (missing, "missing_manual_reference")], F.lit(False))
