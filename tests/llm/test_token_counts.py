import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from twinframe.llm import token_counts as C

from .helpers import DOCS, corpus, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def tokenizer(pieces, byte_fallback):
    tok = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    return tok


def texts():
    extra = ["日本語 テキスト", "a\x1cb c", "x\u0085y z", "<0x41> <unk> <s>", "😀😀 é😀", "▁ a▁b", "ﬁ ǆ", "\x00\x01"]
    return [t or "" for _, t, *_ in corpus()] + extra


def test_counts_are_the_tokenizers():
    pieces = C.vocabulary(MODEL)
    tok, counter = tokenizer(pieces, True), C.UnigramCounter(pieces)
    for t in texts():
        assert counter.count_text(t)[1] == len(tok.encode(t, add_special_tokens=False).ids), t


@pytest.mark.parametrize("seed", range(6))
def test_ties_and_unknown_runs(seed):
    rng = random.Random(seed)
    letters = "abcd"
    some = {"".join(rng.choice(letters + "▁") for _ in range(rng.randint(1, 4))) for _ in range(14)}
    pieces = [("<unk>", -3.0), *[(p, -float(rng.randint(1, 3))) for p in sorted(some)]]
    tok, counter = tokenizer(pieces, False), C.UnigramCounter(pieces)
    for _ in range(300):
        t = " ".join("".join(rng.choice(letters + "xy") for _ in range(rng.randint(1, 9))) for _ in range(3))
        assert counter.count_text(t)[1] == len(tok.encode(t, add_special_tokens=False).ids), (t, pieces)


def test_query(spark):
    counter = C.UnigramCounter(C.vocabulary(MODEL))
    rows = corpus()
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in C.with_token_counts(frame(spark, rows), MODEL).collect()}
    assert got == {(i, *(counter.count_text(t) if t else (0, 0))) for i, t, *_ in rows}
    assert C.with_token_counts(spark.createDataFrame([], DOCS), MODEL).collect() == []
    odd = frame(spark, rows).selectExpr("*", "'x' as n_tokens")
    assert C.with_token_counts(odd, MODEL).filter("doc_id = 21 and n_tokens is null").count() == 0


def test_long_words_null_ids_and_bounded_memory(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(None, "a bc", "en", "s", 1), (1, "x" * 100_000 + " y", "en", "s", 1), (2, "é" * 3000, "en", "s", 1)]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in C.with_token_counts(frame(spark, rows), path).collect()}
    counter = C.UnigramCounter(C.vocabulary(path))
    assert got == {i: counter.count_text(t) for i, t, *_ in rows}
    assert all(len(w) <= C.LONGEST for w in counter.known)
    monkeypatch.setattr(C, "CACHE_BYTES", 2000)
    counter.count_text(" ".join(f"w{i}" for i in range(500)))
    assert not counter.known and counter.held == 0
