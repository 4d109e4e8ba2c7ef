import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinframe.functions import text as X
from twinframe.plans import views

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_texts_against_brute_force(spark):
    pairs = views.view(spark, SF, "leak_pairs").select("doc_id", "clean_transcript", "segment_text").limit(40).collect()
    got = {r.doc_id: r.wer for r in entry.queries()["wer"](spark, SF).collect()}
    longest = 0
    for i, clean, segment in pairs:
        ref, hyp = (re.findall("[a-z]+", (t or "").lower()) for t in (clean, segment))
        longest = max(longest, len(ref))
        assert got[i] is None if not ref else abs(got[i] - distance(ref, hyp) / len(ref)) < 1e-6
    assert longest > 40


def test_more_tokens_than_codes_before_surrogates(spark):
    rows = spark.createDataFrame([([f"t{i}" for i in range(55_200)], ["other"])], "r array<string>, h array<string>")
    assert rows.select(X.wer(F.col("r"), F.col("h"))).first()[0] == 1.0


def edited(draw, n):
    """A token array and an edited copy of it, or another array, over few different tokens."""
    kinds = draw.choice([1, 2, 5, 40])
    tokens = lambda k: [f"t{draw.randrange(kinds)}" for _ in range(k)]
    ref = tokens(n)
    hyp = list(ref) if draw.random() < 0.7 else tokens(draw.choice([0, 1, 9, 70]))
    for _ in range(draw.choice([0, 1, 3, 30])):
        at = draw.randrange(len(hyp) + 1)
        hyp[at : at + draw.randrange(2)] = ["new"] * draw.randrange(2)
    return ref, hyp


def test_cut_ends_shared_codes_and_bands(spark):
    draw = random.Random(5)
    pairs = [edited(draw, draw.choice([0, 1, 3, 10, 60, 150])) for _ in range(200)] + [edited(draw, 400) for _ in range(5)]
    pairs += [(["a"] * 300, ["b"] * 300 + ["a"]), (["r"], ["h"]), (["a", "b"], []), (["x", "y"] * 90, ["y", "x"] * 90)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r array<string>, h array<string>")
    got = {x.i: x.w for x in rows.select("i", X.wer(F.col("r"), F.col("h")).alias("w")).collect()}
    assert got == {i: distance(a, b) / len(a) if a else None for i, (a, b) in enumerate(pairs)}
    odd = spark.createDataFrame([(None, ["a"]), (["a"], None), (None, None)], "r array<string>, h array<string>")
    assert [x.w for x in odd.select(X.wer(F.col("r"), F.col("h")).alias("w")).collect()] == [None] * 3
