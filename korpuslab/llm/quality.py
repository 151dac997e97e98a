"""Quality classifier from weak labels.

Heuristic labellers look at a text and vote good, bad or nothing. Their votes are
counted as patterns over all documents; expectation-maximisation on those counts
estimates how often each labeller gives each vote to good and to bad documents, and
from that the chance that a document of a pattern is good. These posteriors are the
soft labels that train a linear scorer on hashed byte n-grams of a bounded sample
(``SAMPLE`` documents, half from each side where there are enough, by a hash of id and
text). No hand-made label is used. The scorer then judges whole texts of all documents.

There are at most 3 ** labellers patterns, so what comes to the driver is bounded. A
text without words gets score 0 and is not kept, and no labeller votes on it. If all
documents lean to one side the posterior itself is the score. Posteriors belong to texts,
so rows without an id and rows that repeat an id with another text train like any other;
rows that agree in both count once in the sample. Texts of any length count whole; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpuslab.llm.common import cut
from korpuslab.llm.ngrams import ROWS, features, fit_logistic, fitted, sample_rows

SAMPLE, ROUNDS, KEEP = 2000, 100, 0.3
GOOD, BAD, NONE = 1, 0, 2
_SIGNS = np.frombuffer(b"!#$%&*+<=>@[]\\^_`{|}~/", np.uint8)
#: Bytes as their class: white space, ASCII sign, anything else.
_CLASSES = bytes(32 if c in b" \t\n\x0b\x0c\r" else 33 if 33 <= c < 127 and not chr(c).isalnum() else 97 for c in range(256))
_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)


def _between(value: float, bad: float, good: float) -> int:
    """Bad from ``bad`` on, good up to ``good``, no vote in between."""
    return BAD if value >= bad else GOOD if value <= good else NONE


#: Labellers by place, and the two kinds of bad documents, each where certain labellers start out as telling.
LABELLERS = ("letters", "signs", "sign runs", "capitals", "repeats", "vocabulary", "sentences")
KINDS = ([0, 1, 2, 3], [4, 5, 6])


def votes(text: str | None) -> tuple[int, ...]:
    """The votes of ``LABELLERS`` on a text; what they look at overlaps on purpose."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (NONE,) * len(LABELLERS)
    n, levels = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(levels[_UPPER].sum()), int(levels[_LOWER].sum())
    solid, shape = sum(map(len, words)), raw.translate(_CLASSES)
    letters = (upper + lower + int(levels[128:].sum())) / solid
    again = sum(map(bytes.__eq__, words[1:], words)) / n
    stops = (sum(map(raw.count, (b". ", b".\n", b"! ", b"!\n", b"? ", b"?\n"))) + raw.rstrip().endswith((b".", b"!", b"?"))) / n
    return (
        _between(-letters, -0.85, -0.92),
        _between(int(levels[_SIGNS].sum()) / solid, 0.04, 0.01),
        _between(sum(map(shape.count, (b"a!!", b" !!", b" ! "))) / n, 0.15, 0.03),
        _between(upper / max(1, upper + lower), 0.4, 0.15) if n >= 5 else NONE,
        _between(again, 0.1, 0.03) if n >= 5 else NONE,
        _between(-len(set(words)) / n, -0.3, -0.5) if 20 <= n <= 400 else NONE,
        _between(-stops, -0.01, -0.03) if n >= 40 else NONE,
    )


def inputs(texts: list[str | None]) -> np.ndarray:
    """What the scorer sees: hashed byte grams, and in bucket 0 the words that repeat the one before."""
    x = features(texts, lower=False)
    for row, text in zip(x, texts, strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        row[0] = np.sqrt(sum(map(bytes.__eq__, words[1:], words)) / max(1, len(words)))
    return x


class LabelModel:
    """How labellers vote on good and on bad documents, from counts of vote patterns alone."""

    def __init__(self, counts: dict[str, int], rounds: int = ROUNDS):
        patterns = np.array([[int(c) for c in p] for p in counts]).reshape(len(counts), -1)
        weight = np.array(list(counts.values()), float)
        hot = np.stack([(patterns == v).astype(float) for v in (BAD, GOOD)], 2)  # a labeller that does not vote says nothing
        against = np.stack([(patterns[:, kind] == BAD).sum(1) for kind in KINDS], 1)
        post = np.concatenate([np.full((len(counts), 1), 1.0), 2.0 * against], 1) + 0.05
        post /= post.sum(1, keepdims=True)
        for _ in range(rounds):
            mass = post * weight[:, None]
            self.prior = (mass.sum(0) + 1.0) / (mass.sum() + post.shape[1])
            seen = np.einsum("pc,plv->clv", mass, hot) + 0.1
            self.gives = seen / seen.sum(2, keepdims=True)  # class, labeller, vote
            odds = np.einsum("plv,clv->pc", hot, np.log(self.gives)) + np.log(self.prior)
            post = np.exp(odds - odds.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
        post = post[:, 0]
        self.posterior = dict(zip(counts, post.tolist(), strict=True))
        #: How often a labeller is right when it votes.
        self.accuracy = self.prior[0] * self.gives[0, :, GOOD] + self.prior[1:] @ self.gives[1:, :, BAD]


def _patterns(docs: DataFrame) -> DataFrame:
    """The pattern of each text beside the number of its row, which equal rows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["".join(map(str, votes(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], names=["row", "pattern"])

    return docs.select("row", "text").mapInArrow(run, "row bigint, pattern string")


class Scorer:
    """The label model and the hashed linear scorer that its posteriors trained."""

    def __init__(self, docs: DataFrame, sample: int = SAMPLE):
        docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
        patterns = cut(_patterns(docs))
        blank = "".join(map(str, votes(None)))
        counts = {blank: 0} | {r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3 ** labellers at most
        self.model, self.w = LabelModel(dict(sorted(counts.items()))), None
        posterior = self.model.posterior
        sides = {p: int(x >= 0.5) for p, x in posterior.items() if p != blank}
        if len(set(sides.values())) < 2:
            return
        table = docs.sparkSession.createDataFrame(list(sides.items()), "pattern string, side int")
        marked = patterns.join(F.broadcast(table), "pattern").select(F.col("row").alias("doc_id"), F.lit("").alias("text"), "pattern", "side")
        picked = sample_rows(marked.distinct(), "side", sample).select(F.col("doc_id").alias("row"), "pattern")
        rows = docs.join(F.broadcast(picked), "row").dropDuplicates(["row"]).select("row", "pattern", "text")

        def fit(x: np.ndarray, rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
            return fit_logistic(x, np.array([[posterior[p]] for p in rows["pattern"]], np.float32))

        self.w, self.b = fitted(rows, inputs, fit)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Votes, posterior and score of each text."""
        found = ["".join(map(str, votes(t))) for t in texts]
        posterior = np.array([self.model.posterior.get(p, 0.5) for p in found])
        score = posterior.copy() if self.w is None else 1.0 / (1.0 + np.exp(-(inputs(texts) @ self.w + self.b)[:, 0].astype(float)))
        score[[not (t and t.encode("utf-8", "surrogatepass").split()) for t in texts]] = 0.0
        return found, posterior, score


def _verdict(scorer: Scorer):
    @F.pandas_udf("votes string, posterior double, score double")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        parts = [scorer.judge(texts.iloc[at : at + ROWS].to_list()) for at in range(0, len(texts), ROWS)]
        return pd.DataFrame({"votes": sum((p[0] for p in parts), []), "posterior": np.concatenate([p[1] for p in parts] or [np.zeros(0)]), "score": np.concatenate([p[2] for p in parts] or [np.zeros(0)])})

    return verdict


def judge_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, posterior, score and keep of every row."""
    scored = docs.select(F.col("doc_id").cast("bigint"), _verdict(Scorer(docs, sample))(F.col("text").cast("string")).alias("_v"))
    return scored.select("doc_id", "_v.*", (F.col("_v.score") >= KEEP).alias("keep"))
