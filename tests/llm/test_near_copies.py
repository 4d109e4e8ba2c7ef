import random

import numpy as np

import corpus_pipeline
from twinframe.llm import near_copies as N

from .helpers import DOCS, corpus, frame


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """The least id of each component over pairs with Jaccard 0.8 or more, or equal sets."""
    label = {r[0]: r[0] for r in rows}
    sets = [(r[0], shingles(r[1])) for r in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and (x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)))]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(set(label.values()))


def edited(seed=8, n=60):
    """Texts with copies in which 1 to 5 % of the words are replaced: similarities from some 0.6 to 0.95."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(200), 2 + i % 9):
            copy[at] = f"new{rng.randrange(5000)}"
        rows += [(1000 + 2 * i, " ".join(base), "en", "s", 1), (1001 + 2 * i, " ".join(copy), "en", "s", 1)]
    return rows


def test_stage_drops_lightly_edited_copies(spark):
    rows = edited()
    want = plain_kept(rows)
    assert len(want) < 100  # many pairs link, some must not
    got = sorted(r.doc_id for r in corpus_pipeline.dedup(spark, frame(spark, rows), "").collect())
    assert got == want


def test_against_brute_force(spark):
    rows = corpus() + edited(9, 20)
    for block in (3, 512):
        assert sorted(r.doc_id for r in N.keep_one(frame(spark, rows), block=block).collect()) == plain_kept(rows)
    nameless = rows + [(None, rows[0][1], "en", "s", 1), (None, "quite another text of its own", "en", "s", 1)]
    assert len(N.keep_one(frame(spark, nameless)).collect()) == len(plain_kept(rows)) + 1
    assert N.keep_one(spark.createDataFrame([], DOCS)).collect() == []


def test_bands_find_similar_sets():
    rng, missed = np.random.default_rng(1), 0
    for _ in range(400):
        shared = rng.integers(0, 1 << 63, 320, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((shared, rng.integers(0, 1 << 63, 40, dtype=np.uint64)))) for _ in "ab")
        assert N.similar(a, b)  # 320 of 400: exactly 0.8
        missed += not any(x == y for x, y in zip(N.band_keys(a), N.band_keys(b)))
    assert missed <= 1


def templates(seed=5, n=600):
    """Texts that share 100 words and have 60 of their own (Jaccard some 0.45), and a lightly edited copy of every tenth."""
    rng = random.Random(seed)
    shared = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(n):
        words = shared + [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((10 * i, " ".join(words), "en", "s", 1))
        if i % 10 == 0:
            words[130] = "edited"
            rows.append((10 * i + 1, " ".join(words), "en", "s", 1))
    return rows


def test_templates_move_no_sets_in_squares(spark, monkeypatch):
    rows, dealt = templates(), []
    check = N._verified

    def counted(frame_, radius):
        dealt.append(frame_.count())
        return check(frame_, radius)

    monkeypatch.setattr(N, "_verified", counted)
    got = sorted(r.doc_id for r in N.keep_one(frame(spark, rows), block=64).collect())
    assert got == [r[0] for r in rows if r[0] % 10 == 0]
    assert sum(dealt) <= 1.5 * len(rows)  # round 1 has each once; later only those with a close one of another component


def test_large_groups_in_small_blocks(spark):
    """One base with hundreds of edited copies, longer than a block: parts that round 1 leaves are joined later, and all by verified links."""
    rng = random.Random(6)
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(150), 1 + i % 3):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    assert [r.doc_id for r in N.keep_one(frame(spark, rows), block=16).collect()] == plain_kept(rows)
