"""Small tables for the operators' tests."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ("_dropped", "_doc", "_size", "_taken", "_copy", "_left", "fp", "label", "score", "size", "start", "spots", "window", "key", "cell", "kept", "entropy", "component_id", "first", "root")


def documents(spark, rows, extra=False) -> DataFrame:
    """A documents table from (doc_id, text) or full rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "a", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def prose(seed: int, words: int, pool: int = 400) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "er", "th", "in", "on", "es", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(pool)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


#: Nulls, empty and blank texts, ties, repeated rows and a long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, " \n\t ", "en", "a", 4),
    (None, "a row without an id", "fr", "b", 19),
    (4, prose(1, 30), "en", "a", 0),
    (4, prose(1, 30), "en", "a", 0),
    (5, prose(1, 30), "de", None, 0),
    (6, prose(2, 30_000), "en", "a", 0),
    (7, "é中\U0001f600 " * 40, "en", "a", 0),
]


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
