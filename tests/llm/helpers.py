"""Small messy tables and plain Python versions of the contracts."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"


def word(rng):
    return "".join(rng.choice(("th", "er", "on", "an", "é", "re", "Ti", "x9")) for _ in range(rng.randint(1, 3)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


def corpus(seed=3, n=60):
    """Copies, near copies, nulls, blanks, odd white space, repeated lines and one long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, sentence(rng, rng.randint(1, 120)), "en" if i % 2 else "fr", f"s{i % 3}", 1))
    base = sentence(rng, 400)
    for i in range(12):
        words = base.split(" ")
        words[rng.randrange(400)] = "changed"
        rows.append((n + i, " ".join(words) if i % 3 else base, "en", "s0", 2))
    line = sentence(rng, 9)
    rows += [
        (n + 20, None, None, None, None),
        (n + 21, "", "en", "s1", 0),
        (n + 22, " \n\t\x0b ", "en", "s1", 0),
        (n + 23, "\n".join([line] * 5 + [line + "!"]), "de", "s2", 3),
        (n + 24, sentence(rng, 9000), "es", "s0", 4),
        (n + 25, "A b c\u0085d \U0001f600 e\r\nf", "en", "s1", 5),
        (n + 26, "# * $ % & | < > TOKEN!!", "en", "s1", 5),
        (3, rows[3][1], "fr", "s0", 1),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)
