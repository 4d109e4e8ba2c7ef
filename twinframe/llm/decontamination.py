"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents that one task holds (some ``shard_words`` words). Words that no benchmark item has cannot lie in an
occurrence, so they and runs shorter than the shortest phrase become separators; the rest is indexed, every test phrase is searched
backwards through the wavelet ranks, occurrences are located from sampled suffix positions, and hit spans of a document are merged.
Test phrases are sent to the tasks in blocks of some ``phrase_block`` (phrase, item) pairs. Each block is one pass over the documents, whose hits are
written before the next block is read, so the driver holds one block at a time, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, as_bytes, join_by_count, new_path, stage_table, trimmed
from .fm_index import FMIndex

WINDOW = 10
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns what is no word byte into spaces.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def test_phrases(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, items: int = 1000) -> DataFrame:
    """(phrase, part, items): each distinct window of ``window`` words with the ids of its items; a shorter item is one window.

    The ids of a phrase that very many items share are dealt out to parts of some ``items``. Null and empty items have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            phrases, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    phrases.append(b" ".join(words[at : at + window]).decode())
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(items, pa.string())], names=["phrase", "item"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i is not null").mapInArrow(run, "phrase string, item string")
    rows = stage_table(rows.distinct(), "phrase-items")
    counts = stage_table(rows.groupBy("phrase").agg(F.count("*").alias("n")), "phrase-counts")
    part = F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / F.lit(items)).cast("int")).alias("part")
    return join_by_count(rows, counts, "phrase").select("phrase", part, "item").groupBy("phrase", "part").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Phrases:
    """A block of test phrases as integers over their own vocabulary."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        split = [p.encode().split() for p, _ in rows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for p in split for w in p}))}
        self.lengths = np.array([len(p) for p in split], np.int64)
        self.least = int(self.lengths.min()) if len(rows) else 1
        self.table = np.zeros((len(rows), int(self.lengths.max()) if len(rows) else 1), np.int32)
        for i, p in enumerate(split):
            self.table[i, : len(p)] = [self.vocabulary[w] for w in p]
        self.items = [tuple(x) for _, x in rows]

    def hits(self, docs: list[list[bytes]], sample: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of every occurrence in the shard."""
        get, runs, starts = self.vocabulary.get, [], []
        for d, words in enumerate(docs):
            ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0])).astype(np.int8)))
            for lo, hi in zip(edge[::2], edge[1::2]):
                if hi - lo >= self.least:
                    runs += (ids[lo:hi], np.zeros(1, np.int32))
                    starts.append((d, lo, hi - lo + 1))
        none = np.zeros(0, np.int64)
        if not runs or not len(self.items):
            return none, none, none
        index = FMIndex(np.concatenate(runs), sample)
        lo, hi = index.search(self.table, self.lengths)
        n = hi - lo
        phrase = np.repeat(np.arange(len(n)), n)
        at = index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n))
        doc, first, size = map(np.array, zip(*starts))
        run = np.searchsorted(np.cumsum(size), at, side="right")
        return doc[run], first[run] + at - (np.cumsum(size) - size)[run], phrase


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """The union of word spans [first, last), as sorted spans that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def word_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of word spans."""
    word = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word, [0])).astype(np.int8)))
    return [(int(edge[2 * a]), int(edge[2 * b - 1])) for a, b in spans]


def _count_blocks(phrases: DataFrame, size: int) -> int:
    entries = phrases.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    return max(1, -(-entries * 5 // (size * 4)))


def _block(phrases: DataFrame, k: int, n: int) -> Phrases:
    """Block ``k`` of ``n`` of the staged table ``phrases``: what the driver holds at once, some 0.8 x size ids of items, each with its phrase."""
    rows = phrases.filter(F.pmod(F.xxhash64("phrase", "part"), F.lit(n)) == k).select("phrase", "items").collect()
    return Phrases(sorted((r["phrase"], r["items"]) for r in rows))


def _hits_of_blocks(phrases: DataFrame, n: int, search: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """The rows that ``search`` gives for each block, written block by block into one folder and read from it."""
    spark, path, found = phrases.sparkSession, new_path(phrases.sparkSession, "phrase-hits"), None
    for k in range(n):
        sent = spark.sparkContext.broadcast(_block(phrases, k, n))
        found = search(sent)
        found.write.parquet(f"{path}/block={k}")
        sent.destroy()
    return spark.read.schema(found.schema).parquet(*[f"{path}/block={k}" for k in range(n)])


def _shards(batch: pa.RecordBatch, column: int, shard_words: int) -> Iterator[tuple[int, list[bytes], list[list[bytes]]]]:
    texts = [t or b"" for t in as_bytes(batch.column(column))]
    start, words, total = 0, [], 0
    for i, t in enumerate(texts):
        words.append(words_of(t))
        total += len(words[-1])
        if total >= shard_words or i == len(texts) - 1:
            yield start, texts[start : i + 1], words
            start, words, total = i + 1, [], 0


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = 500_000, phrase_block: int = 200_000) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans array<struct<first, last>>) for each row of ``docs``.

    ``items`` are the sorted ids of items with an occurring window, ``spans`` the merged hit word spans [first, last). Null and empty
    texts have no words. An empty benchmark leaves everything clean. Rows with equal ids are reported each for itself.
    """
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    phrases = stage_table(test_phrases(benchmark, item_col, item_text, window), "phrases")
    n = _count_blocks(phrases, phrase_block)

    def search(sent: Broadcast, every: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in trimmed(batches):
                for start, texts, words in _shards(batch, 2, shard_words):
                    items: list[list[str]] = [[] for _ in texts]
                    spans: list[list[dict]] = [[] for _ in texts]
                    doc, first, phrase = block.hits(words)
                    order = np.argsort(doc, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
                        d = int(doc[own[0]])
                        items[d] = sorted({i for p in set(phrase[own].tolist()) for i in block.items[p]})
                        spans[d] = [{"first": a, "last": b} for a, b in merged(first[own], first[own] + block.lengths[phrase[own]])]
                    keep = [i for i in range(len(texts)) if every or items[i]]
                    ids, rows = (batch.column(i).slice(start, len(texts)).take(pa.array(keep, pa.int64())) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([ids, rows, pa.array([len(words[i]) for i in keep], pa.int64()), pa.array([items[i] for i in keep], pa.list_(pa.string())), pa.array([spans[i] for i in keep], span_type)], names=["id", "row", "n_words", "items", "spans"])

        return source.mapInArrow(run, "id long, row long, n_words long, items array<string>, spans array<struct<first:int,last:int>>")

    out = search(docs.sparkSession.sparkContext.broadcast(_block(phrases, 0, n)), True) if n == 1 else None
    if n > 1:  # put the hits of the blocks together; documents without any meet none
        found = _hits_of_blocks(phrases, n, lambda sent: search(sent, False))
        sets = found.distinct().groupBy(F.col("id").alias("i"), F.col("row").alias("r")).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "spans")])  # a row for each block at most
        sets = stage_table(sets.select("i", "r", F.sort_array(F.array_distinct("items")).alias("items"), _merge_spans(F.sort_array("spans")).alias("spans")), "phrase-sets")
        none = Phrases([])
        plain = search(docs.sparkSession.sparkContext.broadcast(none), True).drop("items", "spans")
        met = F.broadcast(sets) if sets.count() <= BROADCAST_IDS // 100 else sets
        joined = plain.join(met, F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left")
        out = joined.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("items", "array<string>"), ("spans", "array<struct<first:int,last:int>>"))})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["last"] - x["first"]))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def _merge_spans(spans):
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))

    def step(out, x):
        top = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))))
        return F.when((F.size(out) > 0) & (x["first"] <= top["last"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(spans, empty, step)


def _hit_words(block: Phrases, words: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, first words, last words) of each document of the shard that has hits."""
    doc, first, phrase = block.hits(words)
    order = np.argsort(doc, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
        yield int(doc[own[0]]), first[own], first[own] + block.lengths[phrase[own]]


def _cut(text: bytes, first: np.ndarray, last: np.ndarray, mark: bytes) -> bytes:
    kept, end = [], 0
    for a, b in word_spans(text, merged(first, last)):
        kept += (text[end:a], mark)
        end = b
    return b"".join([*kept, text[end:]])


def _with_texts(batch: pa.RecordBatch, at: int, changed: dict[int, bytes]) -> pa.RecordBatch:
    if not changed:
        return batch
    raw = as_bytes(batch.column(at))
    for i, t in changed.items():
        raw[i] = t
    return batch.set_column(at, batch.schema.field(at), pa.array(raw, pa.binary()).cast(batch.column(at).type))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = 500_000, phrase_block: int = 200_000, mark: str = "\n") -> DataFrame:
    """``docs`` with the merged hit spans cut out of their texts and ``mark`` put in their place.

    A round searches all blocks on the text as it is and cuts once. Rounds are repeated for documents that were cut, until words that
    have come together form no test phrase of any block. Other columns, null texts and clean texts stay as they are.
    """
    at, cut_mark = docs.columns.index(text_col), mark.encode()
    phrases = stage_table(test_phrases(benchmark, item_col, item_text, window), "phrases")
    n = _count_blocks(phrases, phrase_block)
    if n > 1:
        return _remove_by_rounds(docs, phrases, n, text_col, shard_words, cut_mark)
    sent = docs.sparkSession.sparkContext.broadcast(_block(phrases, 0, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in trimmed(batches):
            changed: dict[int, bytes] = {}
            for start, texts, words in _shards(batch, at, shard_words):
                rows = np.arange(start, start + len(texts))
                while len(rows):
                    again = []
                    for d, first, last in _hit_words(block, words):
                        changed[int(rows[d])] = _cut(texts[d], first, last, cut_mark)
                        again.append(d)
                    rows = rows[again]
                    texts = [changed[int(r)] for r in rows]
                    words = [words_of(t) for t in texts]
            yield _with_texts(batch, at, changed)

    return docs.mapInArrow(run, docs.schema)


def _remove_by_rounds(docs: DataFrame, phrases: DataFrame, n: int, text_col: str, shard_words: int, mark: bytes) -> DataFrame:
    """All blocks are searched on the unchanged texts, each giving the spans of the rows that it hits; then those rows are cut, and go round again.

    Rows are told apart by numbers that are written with them, as ids may be null or repeat; only rows that are hit meet their spans.
    """
    number = "__row"
    fields = T.StructType([*docs.schema])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, at = len(fields), fields.names.index(text_col)
        for batch in trimmed(batches):
            texts, changed = as_bytes(batch.column(at)), {}
            for i, spans in enumerate(batch.column(width).to_pylist()):
                ends = np.array(spans).reshape(-1, 2)
                changed[i] = _cut(texts[i], ends[:, 0], ends[:, 1], mark)
            yield pa.RecordBatch.from_arrays(_with_texts(batch, at, changed).columns[:width], names=fields.names)

    out, left = None, docs
    while True:
        left = stage_table(left.withColumn(number, F.monotonically_increasing_id()), "decontaminating")

        def search(sent: Broadcast, left: DataFrame = left) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                block = sent.value
                for batch in trimmed(batches):
                    for start, _, words in _shards(batch, 1, shard_words):
                        found = [(start + d, [x for span in merged(first, last) for x in span]) for d, first, last in _hit_words(block, words)]
                        rows = batch.column(0).take(pa.array([d for d, _ in found], pa.int64()))
                        yield pa.RecordBatch.from_arrays([rows, pa.array([s for _, s in found], pa.list_(pa.int32()))], names=["row", "spans"])

            return left.select(number, text_col).mapInArrow(run, "row long, spans array<int>")

        found = _hits_of_blocks(phrases, n, search)
        spans = stage_table(found.groupBy(F.col("row").alias(number)).agg(F.flatten(F.collect_list("spans")).alias("__spans")), "decontaminating-spans")  # a row for each block at most
        hits = spans.count()
        met = F.broadcast(spans) if hits <= BROADCAST_IDS // 100 else spans
        clean = left.join(met.select(number), number, "left_anti").select(docs.columns)
        out = clean if out is None else out.unionByName(clean)
        if not hits:
            return out
        left = left.join(met, number).select(*docs.columns, "__spans").mapInArrow(cut, fields)


def digest(items: "F.Column"):
    """Lower-case SHA-256 of comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)


