import random
import re
from math import comb

import pytest

from twinframe.llm import quality_rules as Q

from .helpers import DOCS, LABELS, corpus, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_against_brute_force(spark):
    rows = corpus()
    got = {tuple(r) for r in Q.with_counts(frame(spark, rows)).select("doc_id", *Q.COUNTS[:5]).collect()}
    assert got == {(i, *plain(t)) for i, t, *_ in rows}


def test_stutter(spark):
    got = Q.with_counts(frame(spark, [(1, "a a a b b a", "en", "s", 1), (2, None, "en", "s", 1)])).orderBy("doc_id").collect()
    assert [r.n_stutter for r in got] == [3, 0]


def test_binomial_tail():
    for n, p in ((10, 0.3), (60, 0.01)):
        for k in range(n + 1):
            assert Q.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def labelled(n_good, n_bad, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n_good + n_bad):
        good = i < n_good
        rows.append((i, sentence(rng, 30) if good else " ".join(w + "%%%" for w in sentence(rng, 30).split()), "en", "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


def test_cutoffs_need_enough_labels(spark):
    rows, labels = labelled(1200, 60)
    docs, known = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    cut = Q.calibrate(Q.with_counts(docs), known).collect()
    assert len(cut) == 1 and set(cut[0].cutoffs) == {"symbols"}
    verdicts = {r.doc_id: r.kept for r in Q.quality_verdicts(docs, known).collect()}
    assert all(verdicts[i] == (i < 1200) for i in verdicts)
    few, few_labels = labelled(50, 20)
    assert {r.kept for r in Q.quality_verdicts(frame(spark, few), spark.createDataFrame(few_labels, LABELS)).collect()} == {True}


def test_certificate_holds_against_recount(spark):
    rng = random.Random(9)
    rows, labels = labelled(1500, 100)
    rows = [(i, t + " %%%" * rng.randint(0, 6), *x) for i, t, *x in rows]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    for r in Q.calibrate(Q.with_counts(docs), known).collect():
        for rule, cutoff in r.cutoffs.items():
            assert cutoff in Q.RULES[rule][1]
            k = sum(y and plain(t)[2] / plain(t)[0] > cutoff for (_, t, *_), (_, y, _) in zip(rows, labels)) if rule == "symbols" else 0
            assert Q.binomial_tail(k, 1500, 0.05 / len(Q.RULES)) <= 0.05 / len(Q.RULES)


def test_edges(spark):
    none = spark.createDataFrame([], LABELS)
    assert Q.quality_verdicts(spark.createDataFrame([], DOCS), none).collect() == []
    rows = corpus()
    odd = frame(spark, rows).selectExpr("*", "'x' as kept", "'y' as n_words", "1 as stratum")
    got = Q.quality_verdicts(frame(spark, rows), none)
    assert got.count() == len(rows) and got.filter("kept = base_failed").count() == 0
    kept = Q.keep_good(odd, none)
    assert kept.columns == odd.columns and kept.count() == got.filter("kept").count()
    assert {r.n_words for r in kept.collect()} == {"y"}
