import random
import zlib

import numpy as np

from twinframe.llm import quality_classifier as C

from .helpers import DOCS, LABELS, corpus, frame, sentence


def labelled(n=600, seed=8):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, 40) if i % 3 else " ".join(w.upper() + "!!" for w in sentence(rng, 40).split()), "en", "s", 1) for i in range(n)]
    return rows, [(i, int(i % 3 > 0), 0) for i in range(n)]


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = labelled()
    got = C.score_quality(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = labelled(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in C.score_quality(frame(spark, rows), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert a == b


def test_context_vectors_against_plain_sums(spark):
    rows = corpus(n=10)[:14]
    counts, sums = C.context_vectors(frame(spark, rows))
    index, want, seen = C.index_vectors(), np.zeros((C.BUCKETS, C.DIMS)), np.zeros(C.BUCKETS)
    for _, t, *_ in rows:
        ids = [C.word_buckets(w) for w in (t or "").encode().split()]
        for i, both in enumerate(ids):
            for b in both:
                seen[b] += 1
                for j in range(max(0, i - C.REACH), min(len(ids), i + C.REACH + 1)):
                    if j != i:
                        want[b] += index[ids[j][0]] + index[ids[j][1]]
    assert (counts == seen).all() and np.array_equal(sums, want)


def test_edges(spark):
    none = spark.createDataFrame([], LABELS)
    assert C.score_quality(spark.createDataFrame([], DOCS), none).collect() == []
    odd = frame(spark, corpus()).selectExpr("*", "1 as id", "2 as y", "3 as vector")
    got = C.score_quality(odd, none).collect()
    assert len(got) == len(corpus()) and {r.score for r in got} == {0.5}
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    assert len({r.score for r in C.score_quality(odd, one_class).collect()}) == 1


def test_more_labels_than_train_rows(spark):
    rows, labels = labelled()
    got = C.score_quality(frame(spark, rows + rows[:50]), spark.createDataFrame(labels, LABELS), train_rows=200).collect()
    assert len(got) == 650
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.9


def test_long_words_count_whole_and_are_not_remembered(monkeypatch):
    a, b = b"ab-" * 5000 + b"X9", b"ab-" * 5000 + b"X!"
    assert C.word_buckets(a)[1] != C.word_buckets(b)[1] and C.word_buckets(a)[0] != C.word_buckets(b)[0]
    monkeypatch.setattr(C, "CACHE_BYTES", 20_000)
    rng = random.Random(4)
    for _ in range(30):
        texts = [sentence(rng, 60).encode() + b" " + a for _ in range(5)]
        letters, shapes, sizes = C._bucket_lists(texts)
        want = [C.word_buckets(w) for t in texts for w in t.split()]
        assert list(zip(letters.tolist(), shapes.tolist())) == want and sizes.sum() == len(want)
        assert a not in C._known and C._held <= 20_000


def test_very_long_text(spark):
    rows, labels = labelled(120)
    got = C.score_quality(frame(spark, rows + [(900, "word " * 200_000, "en", "s", 1), (901, "x" * 500_000, "en", "s", 1), (None, None, None, None, None)]), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 123 and all(0 <= r.score <= 1 for r in got)
