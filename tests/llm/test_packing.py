import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from twinframe.llm import packing

from .helpers import DOCS, corpus, frame

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_are_the_tokenizers():
    tok = Tokenizer.from_file(VOCABULARY)
    texts = [t or "" for _, t, *_ in corpus()] + ["It's ÀÉ İstanbul <|endoftext|> x<|ENDOFTEXT|> ΑΣ á ́b don't we'll 12,5"]
    got = packing.token_bytes([t.encode() for t in texts], VOCABULARY)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, texts, capacity):
    tok = Tokenizer.from_file(VOCABULARY)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, ids in ((d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in texts.items()):
        own, at = sorted(pieces[doc], key=lambda r: r.start), 0
        for r in own:
            cut = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(cut))
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(sequences) == list(range(len(sequences)))


def test_pack(spark):
    rows = corpus()[:-1]
    for capacity, units in ((2048, 128), (64, 32)):
        got = packing.pack(frame(spark, rows), VOCABULARY, capacity=capacity, units=units, group=3).collect()
        check(got, {i: t for i, t, *_ in rows}, capacity)
    repeated = packing.pack(frame(spark, rows * 3), VOCABULARY, with_ids=True).collect()
    assert len(repeated) >= 3 * len(rows) and all(len(r.ids) == r.length for r in repeated)
    fill = sum(r.length for r in repeated)
    assert fill / (2048 * len({r.sequence_id for r in repeated})) > 0.9


def test_column_generation_meets_demand():
    rng = np.random.default_rng(1)
    for units in (16, 64):
        widths = np.array(sorted(rng.choice(np.arange(1, units + 1), 12, replace=False)))
        demand = rng.integers(1, 400, 12)
        plan = packing.column_generation(widths, demand.astype(float), units)
        assert (sum(times * column for column, times in plan) == demand).all()
        assert all((column * widths).sum() <= units for column, _ in plan)
        assert sum(t for _, t in plan) <= np.ceil((widths * demand).sum() / units) * 1.1 + np.count_nonzero(widths * 2 > units) + sum(demand[widths * 2 > units])


def test_knapsack_against_enumeration():
    value, widths = np.array([3.0, 4.5, 7.0]), np.array([2, 3, 5])
    best, counts = packing.best_pattern(value, widths, 11)
    want = max(a * 3 + b * 4.5 + c * 7 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 11)
    assert best == want == (counts * value).sum()


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), VOCABULARY).collect() == []


def test_remembered_chunks_are_bounded(monkeypatch):
    tok = Tokenizer.from_file(VOCABULARY)
    monkeypatch.setattr(packing, "CACHE_BYTES", 30_000)
    monkeypatch.setattr(packing, "JOINED", 7)
    encoder, rng = packing.ChunkEncoder(VOCABULARY), np.random.default_rng(4)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the.", "ab", "字" * 90, "é,", "x" * 70], 9).tolist() + [f"w{n}q{n}." for n in rng.integers(0, 10**6, 20)]) for _ in range(4)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.held == sum(len(c) + len(v) + 180 for c, v in encoder.known.items()) <= 30_000
        assert all(len(c) <= packing.LONGEST for c in encoder.known)


def test_clashing_columns_and_null_ids(spark):
    rows = [(None, "a b c", "en", "s", 1), (None, None, None, None, None), (5, "d", "en", "s", 1)]
    odd = frame(spark, rows).selectExpr("*", "1 as id", "2 as width", "3 as salt", "4 as sequence_id")
    got = packing.pack(odd, VOCABULARY).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "None", "None"] and {r.doc_tokens for r in got} == {4, 1, 2}


def test_words_and_marks_are_encoded_once_and_as_the_tokenizer_does():
    encoder, tok, rng = packing.ChunkEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), np.random.default_rng(7)
    seen, encode = [], encoder._encode
    encoder._encode = lambda chunks: seen.extend(chunks) or encode(chunks)
    encoder(["treourÉ. treourÉ!! treourÉ$$$ andin.%%% andin &&&".encode()])
    assert sorted(seen) == sorted(x.encode() for x in ("treourÉ", "andin", ".", "!!", "$$$", ".%%%", "&&&"))
    letters = [*"abcxyzABC019äßÉÿ×÷ªµñłΣςе́'’.,;!?#$%&*|<>()[]{}_-+=/\\^~`@—", "'s", "n't", "é", "̸", "≠", "İ", "ﬁ", "½", "²"]
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(40)) for _ in range(200)]
    for t, ids in zip(texts, encoder([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
