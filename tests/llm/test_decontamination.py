import hashlib
import random
import re

import numpy as np

from twinframe.llm import decontamination as D
from twinframe.llm.fm_index import FMIndex, suffix_array

from .helpers import DOCS, corpus, frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def windows(text):
    w = words(text)
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def plain(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        for p in windows(t):
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def tables(seed=4):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randint(11, 25))) for i in range(12)] + [(100, "Only three words"), (101, None), (102, "..."), (103, "")]
    rows = corpus()
    for i in range(8):
        part = words(items[i][1])
        start = rng.randint(0, 1)
        rows.append((500 + i, sentence(rng, 20) + "\n" + ", ".join(part[start : start + 10 + i % 3]).upper() + " " + sentence(rng, 5), "en", "s", 1))
    rows.append((600, f"x {items[0][1]} y {items[1][1]} {items[0][1]} only THREE words", "en", "s", 1))
    return rows, items


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    for _ in range(40):
        text = np.append(rng.integers(0, 4, rng.integers(1, 80)), 0).astype(np.int32)
        assert sorted(suffix_array(text).tolist()) == list(range(len(text)))
        index = FMIndex(text, 3)
        phrases = rng.integers(1, 5, (20, 4)).astype(np.int32)
        lengths = rng.integers(1, 5, 20)
        for p, n, lo, hi in zip(phrases, lengths, *index.search(phrases, lengths)):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def test_against_brute_force(spark):
    rows, items = tables()
    bench = spark.createDataFrame(items, BENCH)
    want = sorted((i, *plain(t, items)) for i, t, *_ in rows)
    for options in ({}, {"shard_words": 50}, {"phrase_block": 8}):
        found = D.find_contamination(frame(spark, rows), bench, **options)
        got = found.selectExpr("doc_id", "n_words", "n_hit", "size(items) n", "sha2(array_join(items, ','), 256) h")
        assert sorted(map(tuple, got.collect())) == want


def test_removal_leaves_no_window(spark):
    rows, items = tables()
    docs, bench = frame(spark, rows), spark.createDataFrame(items, BENCH)
    for block in (200_000, 8):
        out = D.remove_contamination(docs, bench, phrase_block=block).collect()
        assert len(out) == len(rows) and all(plain(r.text, items)[1] == 0 for r in out)
    clean = {i: t for i, t, *_ in rows if not plain(t, items)[1]}
    assert all(r.text == clean[r.doc_id] for r in out if r.doc_id in clean)
    assert any("y" in (r.text or "") for r in out if r.doc_id == 600)


def test_edges(spark):
    rows, items = tables()
    docs, bench, none = frame(spark, rows), spark.createDataFrame(items, BENCH), spark.createDataFrame([], BENCH)
    assert {r.n_hit for r in D.find_contamination(docs, none).collect()} == {0}
    assert D.find_contamination(spark.createDataFrame([], DOCS), bench).collect() == []
    odd = docs.selectExpr("*", "1 as n_hit", "2 as row", "3 as items")
    assert D.find_contamination(odd, bench).columns == ["doc_id", "n_words", "n_hit", "items", "spans"]
    assert D.remove_contamination(odd, bench).columns == odd.columns


def test_removal_does_not_depend_on_blocks(spark):
    rng = random.Random(11)
    words_ = [f"t{i}" for i in range(60)]
    items = [(1, " ".join(words_)), (2, " ".join(f"u{i}" for i in range(12)))]
    second = items[1][1].split()
    rows = [(i, " ".join([f"a{rng.randrange(99)}" for _ in range(15)] + words_ + [f"b{rng.randrange(99)}" for _ in range(15)]), "en", "s", 1) for i in range(6)]
    # cutting the first item's passage puts the second item together: another round has to find it
    rows.append((50, " ".join(["x", *second[:6], *words_[:20], *second[6:], "y"]), "en", "s", 1))
    rows += [(60, None, None, None, None), (61, "clean", "en", "s", 1), (61, "clean", "en", "s", 1)]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, BENCH)
    whole, cut = (sorted(((r.doc_id, r.text) for r in D.remove_contamination(docs, bench, phrase_block=b).collect()), key=str) for b in (200_000, 20))
    assert whole == cut and len(cut) == len(rows)
    texts = dict(cut)
    assert all(not set(words(texts[i])) & set(words_) for i in range(6))
    assert words(texts[50]) == ["x", "y"] and texts[60] is None


def test_a_phrase_of_many_items_is_dealt_out(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = [(i, passage) for i in range(40)] + [(90, "Only three words")]
    rows = [(1, f"a {passage} b", "en", "s", 1), (2, "clean", "en", "s", 1), (3, "x only three words", "en", "s", 1)]
    parts = D.test_phrases(spark.createDataFrame(items, BENCH), items=7).collect()
    assert max(len(r["items"]) for r in parts) < 20 and len({(r["phrase"], r["part"]) for r in parts}) == len(parts) > 4
    want = sorted((i, *plain(t, items)) for i, t, *_ in rows)
    for block in (200_000, 30):
        got = D.find_contamination(frame(spark, rows), spark.createDataFrame(items, BENCH), phrase_block=block).selectExpr("doc_id", "n_words", "n_hit", "size(items) n", "sha2(array_join(items, ','), 256) h")
        assert sorted(map(tuple, got.collect())) == want


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    import gc
    import weakref

    alive, most, made = [], [], D._block

    def watched(phrases, k, n):
        gc.collect()
        most.append(sum(r() is not None for r in alive))
        block = made(phrases, k, n)
        alive.append(weakref.ref(block))
        return block

    monkeypatch.setattr(D, "_block", watched)
    rows, items = tables()
    docs, bench = frame(spark, rows), spark.createDataFrame(items, BENCH)
    want = sorted((i, *plain(t, items)[:3]) for i, t, *_ in rows)
    got = D.find_contamination(docs, bench, phrase_block=8).selectExpr("doc_id", "n_words", "n_hit", "size(items) n")
    assert sorted(map(tuple, got.collect())) == want and len(most) > 10 and max(most) <= 1
