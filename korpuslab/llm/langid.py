"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier on hashed byte n-grams predicts
each bit. A text gets the language whose codeword its margins violate least: the
logistic loss of each bit, weighted by how well that bit was told for that language
in training. ``ambiguous`` says that the bits read off are farther from the codeword
than the code can correct, or that another codeword is nearly as close.

The classifiers are fitted on a bounded sample (``SAMPLE`` documents, spread evenly
over the languages, chosen by a hash of id and text); prediction reads whole texts and
nothing but texts. A text that is null or has no letter is ``und`` with score 0. With
a single learned language every text with a letter gets it; with none, all are ``und``.
Rows are judged one by one, so repeated rows and ids get repeated answers; in the sample
they count as the rows they are, and every language keeps a row however ids repeat. Very
long texts are read in blocks. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpuslab.llm.common import field, fold, whole
from korpuslab.llm.ngrams import ROWS, features, fit_logistic, fitted, sample_rows

SAMPLE, FOLDS, HELD = 2000, 4, 2
#: The score from which a filter keeps a text although its bits are far from every codeword.
SURE = 0.95


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n rows of +1 and -1 that differ in many places; no column is constant."""
    bits = 15 if n <= 16 else 10 * int(np.ceil(np.log2(n)))
    if n < 2:
        return np.ones((n, bits), np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        flat = np.flatnonzero(np.abs(code.sum(0, dtype=int)) == n)
        code[rng.integers(n, size=len(flat)), flat] *= -1
        gaps = (bits - code.astype(int) @ code.T.astype(int)) // 2
        near = int(gaps[~np.eye(n, dtype=bool)].min())
        if near > far:
            best, far = code, near
    return best


def _inputs_of(texts: list[str | None]) -> np.ndarray:
    return features(texts, lower=True)


class Codes:
    """What is learned: languages, codewords, bit classifiers, and the reliability of each bit for each language."""

    def __init__(self, names: list[str], x: np.ndarray, labels: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        self.w = self.b = None
        if len(names) > 1:
            self.w, self.b = fit_logistic(x, (self.code[labels] > 0).astype(np.float32))
            right = np.sign(x @ self.w + self.b) == self.code[labels]
            told = np.stack([right[labels == i].mean(0) for i in range(len(names))])
            trust = np.maximum(told - 0.5, 0.01)
            self.trust = trust / trust.sum(1, keepdims=True)
            gaps = (self.code.shape[1] - self.code.astype(int) @ self.code.T.astype(int)) // 2
            self.corrects = (int(gaps[~np.eye(len(names), dtype=bool)].min()) - 1) // 2

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts with letters: the number of the language, the score, and whether it is ambiguous."""
        n = len(texts)
        if len(self.names) == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        margin = (_inputs_of(texts) @ self.w + self.b).astype(np.float64)
        loss = np.stack([np.logaddexp(0, -margin * c) @ t for c, t in zip(self.code, self.trust, strict=True)], 1)
        odds = np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)))
        best = loss.argmin(1)
        score = 1.0 / odds.sum(1)
        wrong = (np.where(margin > 0, 1, -1) != self.code[best]).sum(1)
        return best, score, (wrong > self.corrects) | (score < 0.5)


def _fit(x: np.ndarray, rows: dict[str, list]) -> Codes:
    names = sorted(set(rows["lang"]))
    place = {name: i for i, name in enumerate(names)}
    return Codes(names, x, np.array([place[name] for name in rows["lang"]]))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Codes | None:
    """Fit on a bounded sample of rows with a language outside the held-out fold, in one task; None without such rows."""
    known = docs.where(F.col("lang").isNotNull() & (fold("doc_id", FOLDS) != HELD)).select("doc_id", "text", "lang")
    return fitted(sample_rows(known, "lang", sample), _inputs_of, _fit)


def _verdict(codes: Codes | None):
    """A column function of texts: the language, the score, and whether it is ambiguous."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        names, scores, doubt = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        some = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if codes is not None:
            for at in range(0, len(texts), ROWS):
                here = at + np.flatnonzero(some[at : at + ROWS])
                if len(here):
                    best, scores[here], doubt[here] = codes.predict([texts.iloc[i] for i in here])
                    names[here] = [codes.names[k] for k in best]
        return pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": doubt})

    return verdict


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row."""
    docs = _inputs(docs)
    found = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), _verdict(learn(docs, sample))("text").alias("_v"))
    return found.select("doc_id", "held_out", "_v.*")


def identified_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows it rejects: texts in no learned language (``und``), and doubtful ones.

    A text is doubtful if its bits are farther from the codeword than the code corrects and the language's share
    of the odds is below ``SURE``, or no language has a majority. All columns stay as they were, whatever their names; an empty table gives an empty one.
    """
    verdict = _verdict(learn(_inputs(docs), sample))(F.col("text").cast("string"))
    rows = docs.select(whole(docs), verdict.alias("_v")).where(f"_v.lang_pred <> 'und' AND NOT (_v.ambiguous AND _v.score < {SURE})")
    return rows.select(*(field("_row", c) for c in docs.columns))
