import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinframe.llm import token_planes as TP

from .helpers import corpus, frame


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain(vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "  ", "\n", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a\n\n b\n", " a  b", "a 　b", "a  b", "it's I'LL we'd", " 's", "<|endoftext|>", "x <|endoftext|> y", "12 34,5", "été à la\u0085 x", "\U0001f600 \U0001f600", "a\tb \tc", "end. Next, one!? (two)", "  x", "a \x1c b"]


def test_ids_are_those_of_the_library(vocabulary, plain):
    rng = random.Random(5)
    pieces = [" ", "  ", "\n", "a", "Be", "'s", "é", "9", ",", ".", " ", "　", "\t", "中", "\U0001f600", "-", "\x1f", " "]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [" ".join(rng.choice(["the", "cat", "sat.", "été", "x9"]) for _ in range(500))]
    encode = TP.WordEncoder(vocabulary)
    for _ in range(2):  # the second time from what is remembered
        got = encode(pa.array([*texts, None]))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in [*texts, None]]


def test_forgetting_changes_nothing(vocabulary, plain, monkeypatch):
    monkeypatch.setattr(TP, "CACHE_BYTES", 2000)
    encode, rng = TP.WordEncoder(vocabulary), random.Random(8)
    for _ in range(30):
        texts = [" ".join("w" + str(rng.randint(0, 60)) * rng.randint(1, 30) for _ in range(20)) for _ in range(3)]
        assert [np.frombuffer(g, "<u4").tolist() for g in encode(pa.array(texts))] == [plain(t) for t in texts]
        assert len(encode.young) < 60


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("top", [1, 255, 256, 50_257, 1 << 24, (1 << 32) - 1])
def test_planes_round_trip(kind, top):
    ids = np.random.default_rng(1).integers(0, top, 1003, endpoint=True, dtype=np.uint64).astype("<u4")
    ids[-1] = top
    planes = TP.planes_of(ids, kind)
    assert len(planes) == -(-top.bit_length() // (8 if kind == "byte" else 1))
    assert (TP.ids_of(planes, len(ids), kind) == ids).all()
    assert (TP.ids_of(TP.planes_of(ids[:1] * 0, kind), 1, kind) == 0).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_reads_ranges_from_their_chunks(kind):
    ids = np.arange(1000, dtype="<u4") * 7
    raw = TP.file_bytes(ids, [5, None, -3], [10, 0, 990], 4, 2, kind, chunk_ids=64) + b"\n"
    file = TP.IdFile(raw)
    assert (file.about["shard"], file.about["part"], file.about["n_ids"], len(file.about["chunks"])) == (4, 2, 1000, 16)
    assert file.docs.tolist()[::2] == [5, -3] and file.unnamed.tolist() == [False, True, False] and file.lengths.tolist() == [10, 0, 990]
    for lo, hi in ((0, 1000), (0, 1), (63, 65), (64, 128), (999, 1000), (500, 500), (990, 2000)):
        assert (file.ids(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(ValueError):
        TP.IdFile(raw[:-5])


def expected(rows, plain):
    out, at = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain(text), 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("kind,file_ids", [("byte", 1 << 22), ("bit", 300)])
def test_documents_come_back_in_order(spark, vocabulary, plain, tmp_path, kind, file_ids):
    rows = [r for i, r in enumerate(corpus()) if i != len(corpus()) - 1] + [(None, "no id", "en", "s", 1), (-7, "before zero", "en", "s", 1)]
    docs = frame(spark, rows).withColumns({"id": F.lit(1), "tie": F.lit("x"), "shard": F.lit(9)})
    TP.write_ids(docs, f"file://{tmp_path}/ids", vocabulary, kind=kind, file_ids=file_ids, chunk_ids=128)
    got = TP.read_documents(spark, f"file://{tmp_path}/ids", with_ids=True).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected(rows, plain)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)


def test_repeated_ids_and_empty_tables(spark, vocabulary, plain, tmp_path):
    rows = [(4, t, "en", "s", 1) for t in ("b", "a", "a", None)] + [(3, "c", "en", "s", 1)]
    TP.write_ids(frame(spark, rows), f"file://{tmp_path}/a", vocabulary)
    got = TP.read_documents(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [3, 4, 4, 4, 4] and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.array([*plain(r[1]), 2], "<u4").tobytes()) for r in rows)
    TP.write_ids(frame(spark, rows).limit(0), f"file://{tmp_path}/b", vocabulary)
    assert TP.read_documents(spark, f"file://{tmp_path}/b").count() == 0


def test_query_on_the_given_table(spark, plain):
    from twinframe.llm import queries

    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.op11_id_planes(spark, d)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows, plain)
