"""Small document tables with the cases that every operator has to handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, `_t` string, n_words string, kept string"


def prose(rng, n, syllables=("ka", "to", "mi", "re", "lu", "na")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, extra=()):
    """Nulls in all columns, empty, blank and long texts, ties, repeated rows; extra columns have clashing names."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(24)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src22", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, "en", "src1", None), (101, "", None, None, 0), (102, " \t\n ", "en", "src0", 4), (103, texts[0], "en", "src0", 1), (104, texts[0] + " mila", "en", "src0", 1)]
    rows += [(105, prose(rng, 6000), "en", "src1", 1), (None, texts[1], "en", None, 1), (None, None, None, None, None), (106, "two words", "en", "src0", 9), (107, "two words", "en", "src0", 9), (106, "two words", "en", "src0", 9)]
    rows += list(extra)
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)
