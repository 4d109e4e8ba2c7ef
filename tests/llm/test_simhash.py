import random
import re

import numpy as np
import xxhash

from twinframe.llm import simhash
from twinframe.llm.common import join_by_count

from .helpers import DOCS, corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(i, plain(t)) for i, t, *_ in rows]
    label = {i: i for i, _ in prints}
    moved = True
    while moved:
        moved = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 4 and label[b] < label[a]:
                    label[a], moved = label[b], True
    return {(i, f, label[i]) for i, f in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_against_brute_force(spark):
    rows = corpus()
    got = {(r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_duplicates(frame(spark, rows), block=3).collect()}
    assert got == plain_components(rows)
    assert simhash.near_duplicates(frame(spark, rows)).count() == len(rows)


def test_links_of_random_and_dense_prints(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for c in centres for _ in range(30)}
    table = [(signed(p), i) for i, p in enumerate(sorted(prints))]
    want = {i: i for _, i in table}
    moved = True
    near = [(i, j) for x, i in table for y, j in table if i < j and ((x ^ y) & (2**64 - 1)).bit_count() <= 4]
    while moved:
        moved = False
        for i, j in near:
            low = min(want[i], want[j])
            moved |= want[i] != low or want[j] != low
            want[i] = want[j] = low
    for block in (2, 512):
        edges = simhash.links(spark.createDataFrame(table, "fp long, rep long"), block=block)
        got = dict(simhash.components(edges).collect())
        assert {i: got.get(i, i) for i in want} == want


def test_allocation_covers_every_link():
    for n, p in ((10, 0.5), (10**7, 0.5), (10**5, 0.1)):
        both = np.full((64, 64), int(n * p * p))
        np.fill_diagonal(both, int(n * p))
        plan = simhash.allocate(n, both, 4)
        assert sorted(b for g, _ in plan for b in g) == list(range(64))
        assert sum(t for _, t in plan) == 4 - len(plan) + 1


def test_keep_one(spark):
    rows = corpus()
    kept = sorted(r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect())
    assert kept == sorted({c for _, _, c in plain_components(rows)})
    nameless = rows + [(None, rows[0][1], "en", "s", 1), (None, "quite another text of its own", "en", "s", 1)]
    assert len(simhash.keep_one(frame(spark, nameless)).collect()) == len(kept) + 1


def test_empty_and_clashing_columns(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    odd = frame(spark, corpus()).selectExpr("*", "1 as fp", "2 as component_id", "3 as rep", "'k' as key")
    assert simhash.near_duplicates(odd).columns == ["doc_id", "fp", "component_id"]
    assert set(simhash.keep_one(odd).columns) == set(odd.columns)


def test_hot_keys_give_the_same(spark):
    rows = corpus() + [(500 + i, None, "en", "s", 0) for i in range(40)]
    want = plain_components(rows)
    for hot in (2, 1000):
        got = {(r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_duplicates(frame(spark, rows), block=3, hub=hot, hot_rows=hot).collect()}
        assert got == want
    star = spark.createDataFrame([(i, 1) for i in range(2, 60)] + [(i, i - 1) for i in range(100, 140)], "a long, b long")
    for hot in (5, 1000):
        got = dict(simhash.components(star, hot_rows=hot).collect())
        assert {got.get(i, i) for i in range(1, 60)} == {1} and {got.get(i, i) for i in range(99, 140)} == {99}


def test_join_by_count(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 30), ("b", 3), ("c", 1)) for i in range(n)] + [(None, 7), ("z", 8)], "k string, i int")
    facts = spark.createDataFrame([("a", 30, 1), ("b", 3, 2), ("d", 9, 3)], "k string, n int, f int")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(facts, "k", how).collect()))
        assert sorted(map(str, join_by_count(rows, facts, "k", how=how, hot_rows=2).collect())) == want


def test_keep_least_by_broadcast_and_by_shuffle(spark):
    docs = frame(spark, corpus())
    found = simhash.near_duplicates(docs).cache()
    prints = lambda rows, out: simhash.with_fingerprints(rows, "text", out)
    kept = [sorted(r.doc_id for r in simhash.keep_least(docs, found, "doc_id", "fp", prints, n).collect()) for n in (0, 10**6)]
    assert kept[0] == kept[1] and len(kept[0]) < docs.count()
