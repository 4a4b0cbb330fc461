"""Small tables with the cases that every operator has to define."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, salt int, label string, ids string"


def table(spark, rows, extra=True):
    """documents with extra columns whose names clash with those used inside the operators."""
    full = [(i, t, "en", "s", len(t or ""), "n", 1, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edge_rows():
    long = prose(1, 3000)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one  two"), (6, long), (7, long), (None, long), (None, "alone here now"),
        (8, prose(2, 60)), (8, prose(2, 60)), (9, "ünï çødé 🤗 日本 x" * 3), (10, "a" * 5000), (11, prose(2, 60) + " more"),
    ]
