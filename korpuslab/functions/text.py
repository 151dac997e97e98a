"""Turkish text normalisation, tokens and small text predicates as column functions.

Each helper names its input once, so expressions grow by what they do and not by how deep they are.
Everything is a built-in expression but Unicode compatibility composition, which
Spark lacks: that is an Arrow UDF, fed only with rows that hold a character which
composition could change (others pass it as null and keep their text).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Typographic variants and Turkish capitals, and what becomes of them.
VARIANTS, PLAIN = "’‘–—‐ Iİ", "''--- ıi"
#: Characters composition may change: all but ASCII and precomposed letters of Latin-1 and Latin Extended-A.
_MAY_COMPOSE = "[^\\x00-\\x7FÀ-ÿ\\u0100-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are evaluated once for each row, however often what follows names them.

    The optimizer writes a projected expression wherever it is used below a Python function; it does not look through
    a generator, so the columns come out of one that gives a row for each row.
    """
    made = "_" + "_".join(columns)
    kept = [c for c in df.columns if c not in columns]
    out = df.select("*", F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias(made))
    return out.select(*(F.col("`" + c.replace("`", "``") + "`") for c in kept), *(F.col(made)[name].alias(name) for name in columns))


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Every character Python's str.split() takes for white space, but the space itself; and
#: punctuation that scoring ignores: dots, hyphens and apostrophes stay.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PUNCTUATION = ",;:!?()[]{}\"“”…"


def _single(c: Column) -> Column:
    """Runs of plain spaces as one, none at the ends."""
    return F.trim(F.regexp_replace(c, "  +", " "))


def collapse(c: str | Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return _single(F.translate(_column(c), _SPACES, " " * len(_SPACES)))


def nfkc(c: str | Column) -> Column:
    c = _column(c)
    odd = F.transform(F.array(c), lambda t: F.when(t.rlike(_MAY_COMPOSE), t))[0]  # names its input once, however large that is
    return F.coalesce(_nfkc(odd), c)


def _plain_lower(c: Column, more: str = "") -> Column:
    """Turkish lower case with plain quotes and dashes; white space, and characters of ``more``, as spaces. One pass over the text."""
    return F.lower(F.translate(c, VARIANTS + _SPACES + more, PLAIN + " " * len(_SPACES + more)))


def normalize_tr(c: str | Column) -> Column:
    """Compatibility composition, plain quotes and dashes, Turkish lower case, single spaces; in this order."""
    return _single(_plain_lower(nfkc(c)))


def normalize_tr_for_wer(c: str | Column) -> Column:
    """``normalize_tr`` without the punctuation that scoring ignores."""
    return _single(_plain_lower(nfkc(c), _PUNCTUATION))


def fold_plain(c: str | Column) -> Column:
    """Case folding without Turkish rules, single spaces. Beyond ASCII the full folding needs Python."""
    c = _column(c)
    return collapse(F.coalesce(_casefold(F.when(c.rlike("[^\\x00-\\x7F]"), c)), F.lower(c)))


def tokens(c: str | Column) -> Column:
    """Tokens of a text between plain spaces; a text without any has none."""
    return F.array_remove(F.split(_column(c), " "), "")


def words(c: str | Column) -> Column:
    """Tokens between white space of any kind."""
    return tokens(F.translate(_column(c), _SPACES, " " * len(_SPACES)))


def parse_bool(c: str | Column) -> Column:
    """True for 1, true and yes in any case, with spaces around; anything else, null too, is false."""
    return F.coalesce(F.lower(collapse(c)).isin("1", "true", "yes"), F.lit(False))


def pseudonym(version: str | Column, client: str | Column) -> Column:
    """An opaque speaker id from a source version and a client id."""
    version = F.lit(version) if isinstance(version, str) else version
    return F.concat(F.lit("spk-"), F.substring(F.sha2(F.concat_ws("|", version, _column(client)), 256), 1, 16))


def stem(path: str | Column) -> Column:
    """A file name without folders and without its last suffix; a name that starts with its only dot keeps it."""
    name = F.regexp_extract(_column(path), "([^/]*)$", 1)
    cut = F.regexp_extract(name, "^(.+)\\.[^.]*$", 1)
    return F.when(cut == "", name).otherwise(cut)


def is_absolute_path(c: str | Column) -> Column:
    """A POSIX absolute path, or one with a drive letter."""
    return F.coalesce(_column(c).rlike("(?s)^(/|.:)"), F.lit(False))
