"""Small documents with every odd case, and a column for each name the operators use inside."""

from __future__ import annotations

import random

CLASHES = ["rep", "key", "check", "size", "n", "places", "row", "content", "keys", "places_", "score", "toxic_score", "n_lines", "target", "rate", "span"]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7))) for _ in range(n))


def rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars"""
    long = prose(1, 3_000)
    near = prose(2, 200).split()
    edited = [*near[:100], "changed", *near[101:]]
    texts = [
        (0, prose(3, 120)), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, " ".join(near)), (7, " ".join(edited)), (8, prose(3, 120)),
        (9, "short one"), (10, "short one"), (None, prose(4, 80)), (None, prose(4, 80)), (11, prose(5, 60) + " " + prose(3, 120)[:400]), (11, prose(6, 70)),
        (12, prose(7, 30)), (12, prose(7, 30)), (13, "x" * 20_000), (14, "é日本\n🙂 " * 40),
    ]
    texts += [(20 + i, f"{prose(100 + i, 40)}\nAll rights reserved {i} by the house\n{prose(200 + i, 30)}") for i in range(12)]
    sources = ["b", "a", None, "c", ""]
    return [(d, t, "en", sources[i % 5], None if t is None else len(t)) for i, (d, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, clashing: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHES}) if clashing else df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
