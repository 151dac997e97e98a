"""Documents that are awkward in every way the operators promise to stand."""

import random

import pytest
from pyspark.sql import DataFrame

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, block int, _id string, x string, n_lines string, word string, copies int"


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": ["th", "er", "on", "an", "re", "ing", "ed"], "de": ["sch", "ung", "ein", "ich", "ver", "ä"], "fr": ["eau", "é", "que", "tion", "è", "les"], "es": ["ción", "ar", "os", "ña", "que", "í"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward_rows(n: int = 60, seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", "fr", "es"])
        lines = [prose(rng, rng.randint(3, 20), lang) for _ in range(rng.randint(1, 4))]
        rows.append((i, "\n".join(lines), lang, f"src{i % 3}"))
    shared = "A line that many of these documents share, longer than forty characters."
    rows += [(100 + i, f"{prose(rng, 8)}\n  {shared.upper() if i % 2 else shared}\t\n{prose(rng, 5)}", "en", "src0") for i in range(7)]
    copy = prose(rng, 40)
    rows += [(200 + i, copy, "en", "src0") for i in range(20)]
    near = copy.split()
    rows += [(230 + i, " ".join([*near[:i], "changed", *near[i + 1 :]]), "en", "src1") for i in range(5)]
    rows += [(300, None, "en", "src1"), (301, "", "de", None), (302, " \n\t\n", None, "src1"), (303, "123 456 !!!", "fr", "x"), (304, "Hi", "en", "src2"), (305, None, None, None)]
    rows += [(306, prose(rng, 3000), "en", "src2"), (307, "a" * 30000, "en", "src2"), (None, prose(rng, 30), "en", "src1"), (None, None, None, None)]
    rows += [(308, prose(rng, 12), "es", "src0")] * 2  # a repeated row
    rows += [(309, "İstanbul’da ışık yok \x85 日本語 <|endoftext|> 😀", "en", "src0")]
    return rows


def frame(spark, rows) -> DataFrame:
    """The rows as documents, with more columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, 7, 7, "id", "x", "lines", "w", 9) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [(1, "a", "en", "s")]).limit(0)
