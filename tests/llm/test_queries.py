"""The registered queries against plain Python versions of their contracts, on the smallest tables with odd rows added."""

import hashlib
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry

from . import test_decontamination, test_pii, test_simhash, test_url_filter, test_warc
from .helpers import corpus

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark):
    """A folder with the smallest tables, odd rows and columns with clashing names."""
    top = tempfile.mkdtemp(prefix="spark-")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6 + i, t, lang, source, n) for i, t, lang, source, n in corpus() if i != 3]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.selectExpr("*", "1 as id", "'f' as fp", "2 as shard", "3 as size", "4 as items", "5 as score").repartition(5).write.parquet(f"{top}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(10**6 + i, f"http://e{i}.org/de/{i}", h) for i, _, h in test_warc.pages() if i is not None and i != 105] + [(2 * 10**6 + i, u, None) for i, u in test_url_filter.urls()]
    pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string").select(pages.columns)).repartition(5).write.parquet(f"{top}/pages.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{top}/{name}.parquet")
    return top


def read(spark, top, name):
    return [tuple(r) for r in spark.read.parquet(f"{top}/{name}.parquet").collect()]


def run(spark, top, name, columns):
    frame = entry.queries()[name](spark, top)
    assert {c: t for c, t in frame.dtypes if c in columns} == columns
    return frame.collect()


def test_op1(spark, tables):
    got = run(spark, tables, "op1_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    rows = [r[:2] for r in read(spark, tables, "documents")]
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == test_simhash.plain_components(rows)
    assert len(got) == len(rows) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_op2(spark, tables):
    kinds = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint")
    got = run(spark, tables, "op2_quality_rules", {"doc_id": "bigint", **kinds, "base_failed": "boolean", "kept": "boolean"})
    want = {r[0]: plain_counts(r[1]) for r in read(spark, tables, "documents")}
    assert {r.doc_id: tuple(r[c] for c in kinds) for r in got} == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)


def test_op3(spark, tables):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    got = run(spark, tables, "op3_packing", dict.fromkeys(names, "bigint"))
    tok, own, inside = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in got:
        own[r.doc_id].append(r)
        inside[r.sequence_id].append((r.offset, r.length))
    for doc, text, *_ in read(spark, tables, "documents"):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own.pop(doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert not own and sorted(inside) == list(range(len(inside)))
    for spans in inside.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_op4(spark, tables):
    kinds = {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    got = run(spark, tables, "op4_decontamination", kinds)
    words, where = test_decontamination.words, defaultdict(set)
    for item, text in ((r[0], r[1]) for r in read(spark, tables, "benchmark")):
        for p in test_decontamination.windows(text):
            where[p].add(str(item))
    lengths = {len(p) for p in where}
    want = {}
    for doc, text, *_ in read(spark, tables, "documents"):
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in where:
                    hit.update(range(i, i + n))
                    found |= where[p]
        want[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert {r.doc_id: tuple(r[c] for c in list(kinds)[1:]) for r in got} == want and any(v[-1] for v in want.values())


def test_op5(spark, tables):
    got = run(spark, tables, "op5_url_rules", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = test_url_filter.plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)


def test_op6(spark, tables):
    kinds = {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    got = run(spark, tables, "op6_warc", kinds)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    assert sorted((tuple(r[c] for c in kinds) for r in got), key=str) == sorted(test_warc.plain(rows), key=str)
    assert any(r.record_type == "revisit" for r in got)


def test_op7(spark, tables):
    kinds = {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    texts = {r[0]: r[1] or "" for r in read(spark, tables, "documents")}
    for r in run(spark, tables, "op7_pii", kinds):
        base = test_pii.plain(texts.pop(r.doc_id))
        named = [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest() and set(filter(None, r.spans.split(","))) >= set(named)
    assert not texts


def test_op8(spark, tables):
    kinds = {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = run(spark, tables, "op8_hilbert", kinds)
    want = {r[0]: (len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in read(spark, tables, "documents")}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op9(spark, tables):
    got = run(spark, tables, "op9_token_counts", {"doc_id": "bigint", "n_words": "bigint", "n_tokens": "bigint"})
    want = {r[0]: len((r[1] or "").split()) for r in read(spark, tables, "documents")}
    assert {r.doc_id for r in got} == want.keys() and all(r.n_tokens >= r.n_words >= 0 for r in got)


def test_op10(spark, tables):
    got = run(spark, tables, "op10_quality_classifier", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert {r.doc_id: r.held_out for r in got} == {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in read(spark, tables, "documents")}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    held = [(r.score, quality[r.doc_id]) for r in got if r.held_out and quality.get(r.doc_id) is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert bad and np.mean([a > b for a in good for b in bad]) > 0.7


def test_pipeline_with_labels_that_certify_a_cutoff(spark):
    import corpus_pipeline

    top, rng = tempfile.mkdtemp(prefix="spark-"), np.random.default_rng(3)
    text = lambda mark: " ".join(f"w{n}{mark}" for n in rng.integers(0, 10**6, 60))
    rows = [(i, text("!!" if i % 10 == 0 else ""), "en", "s", 1) for i in range(2000)] + [(5000, None, None, None, None), (5001, rows_text := text(""), "en", "s", 1), (5002, rows_text, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(2000)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "never seen words of some benchmark item that nobody has copied")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, top).collect()}
    assert got == {i for i in range(2000) if i % 10} | {5001}
