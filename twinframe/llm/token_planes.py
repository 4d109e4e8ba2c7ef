"""Token ids in binary files of compressed byte or bit planes.

Documents are encoded in ascending order of their ids, range-partitioned, and a task writes its stream of ids as a series of files. In a file
the stream is cut into chunks of a fixed number of ids; the bytes (or bits) of a chunk's ids are transposed, so that the first bytes of all
ids lie together, then the second ones, and each plane is compressed by itself with zstandard. High planes hold few values and shrink
to little. A chunk index at the end gives each chunk's place, so a range of ids is read without the rest.

File format, integers little-endian::

    magic    8 bytes  b"IDPLANE1"
    planes   of all chunks in turn, each plane one zstandard frame; a chunk of n ids has 1 to 4 byte planes of n bytes, or 1 to 32 bit
             planes of ceil(n / 8) bytes (most significant bit first), lowest plane first; higher planes than the greatest id needs are left out
    index    one zstandard frame: JSON with shard, part, kind ("byte" or "bit"), chunk_ids, n_ids, n_docs, end_id,
             chunks [[place, n_ids, [compressed bytes of each plane]]], then b"\\n", then the documents: n_docs int64 ids (xor with the one
             before), n_docs uint32 lengths (each document's ids, its end id included), and a bit for each document without an id
    trailer  uint64 place of the index, uint64 its bytes, magic, b"\\n"

Files are written and read by Spark's own sources, so they may lie in any file system that it knows; ``shard`` numbers the tasks in the
order of documents and ``part`` the files of a task.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, stage_table, trimmed

MAGIC = b"IDPLANE1"
#: Ids of a chunk, and ids after which a file ends with the document at hand.
CHUNK_IDS, FILE_IDS = 1 << 16, 1 << 22
#: Bytes of remembered words (with some 170 for the objects of each), and of the longest word that is remembered.
CACHE_BYTES, LONGEST = 240_000_000, 48
#: Bytes of texts that are encoded together (a longer text by itself), and bytes of new words that are encoded as one text.
BATCH_BYTES, JOINED = 12_000_000, 4096
#: A space that is surely the start of a token: what follows is neither white space nor may be the first byte of some.
_WORD_START = re.compile(" (?=[!-~\u00c0-\u0fff\u3400-\ud7ff])")
_ODD_SPACE = " ([^!-~\u00c0-\u0fff\u3400-\ud7ff]|$)"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts by words that begin with a space, for byte-level vocabularies whose tokens hold a space at most as their first byte.

    Such a tokenizer begins a token at each space before something that is not white space, whatever stands before, and words don't look
    ahead beyond their end. So a text's ids are those of its words, and a word is encoded once. New words are encoded together: the
    ids that begin with a space are where the words begin. The first word of a text has no space before it and is encoded apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        words = self.tok.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(words.values()) + 1, bool)
        for word, i in words.items():
            self.starts[i] = word.startswith("Ġ")
        # By the bytes after the space; when the young ones fill half of the room they become the old ones, and those are forgotten.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[bytes]) -> list[bytes]:
        """The ids of words without a space inside, each after a space."""
        groups, at, size = [], 0, 0
        for i, w in enumerate(words):
            size += len(w) + 1
            if size >= JOINED or i + 1 == len(words):
                groups.append(words[at : i + 1])
                at, size = i + 1, 0
        out: list[bytes] = []
        for group, ids in zip(groups, self._ids([(b" " + b" ".join(g)).decode() for g in groups])):
            cuts = np.flatnonzero(self.starts[ids]).tolist()
            if len(cuts) != len(group):
                raise ValueError("the vocabulary doesn't begin a token at each space")
            raw = ids.tobytes()
            out += [raw[4 * lo : 4 * hi] for lo, hi in zip(cuts, [*cuts[1:], len(ids)])]
        return out

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words; new ones are encoded and remembered."""
        young, old = self.young, self.old
        found = list(map(young.get, words))
        late = [i for i, v in enumerate(found) if v is None]
        asked = [words[i] for i in late]
        again = list(map(old.get, asked))
        new = [w for w, v in zip(asked, again) if v is None]
        if odd := [w for w in new if b" " in w]:  # spaces before or after other white space
            new = [w for w in new if b" " not in w]
        made = dict(zip(new, self._spaced(new)))
        made.update(zip(odd, [x.tobytes() for x in self._ids([(b" " + w).decode() for w in odd])]))
        for i, w, v in zip(late, asked, again):
            found[i] = made[w] if v is None else v
        kept = [(words[i], found[i]) for i in late if len(words[i]) <= LONGEST]
        young.update(kept)
        self.held += 2 * sum(map(len, asked)) + 170 * len(kept)
        if 2 * self.held > CACHE_BYTES:
            self.old, self.young, self.held = young, {}, 0
        return found

    def _lists(self, parts: pa.ListArray) -> list[bytes]:
        """The ids of texts that are cut before each word; the first part of each has no space before it."""
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        flat = parts.flatten()
        first = np.zeros(len(flat), bool)
        first[np.concatenate(([0], ends[:-1]))] = True
        heads = [x.tobytes() for x in self._ids(flat.filter(pa.array(first)).to_pylist())]
        coded = flat.filter(pa.array(~first)).dictionary_encode()
        values = self._known(coded.dictionary.cast(pa.binary()).to_pylist())
        code = coded.indices.to_numpy()
        blob, size = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4
        n = size[code]
        last = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat((np.cumsum(size) - size)[code] - last[:-1], n) + np.arange(last[-1])
        raw = memoryview(blob[at].tobytes()) if len(at) else memoryview(b"")
        cuts = 4 * last[np.concatenate(([0], ends - np.arange(1, len(ends) + 1)))]
        return [head + raw[a:b] for head, a, b in zip(heads, cuts.tolist(), cuts[1:].tolist())]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids (null: none) as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        for mark in self.special:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~odd & ~whole)
        if len(at):
            for i, ids in zip(at.tolist(), self._lists(pc.split_pattern(texts.take(pa.array(at)), " "))):
                out[i] = ids
        at = np.flatnonzero(odd & ~whole).tolist()
        if at:
            for i, ids in zip(at, self._lists(pa.array([_WORD_START.split(texts[i].as_py()) for i in at], pa.list_(pa.string())))):
                out[i] = ids
        at = np.flatnonzero(whole).tolist()
        for i, ids in zip(at, self._ids([texts[i].as_py() for i in at])):
            out[i] = ids.tobytes()
        return out


def token_bytes(texts: pa.Array, path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, by the tokenizer file ``path``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path](texts)


def _by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` bytes in a column, or of one row."""
    for batch in trimmed(batches):
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(total):
            end = max(at + 1, int(np.searchsorted(total, most + (total[at - 1] if at else 0), side="right")))
            yield batch.slice(at, end - at)
            at = end


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of some ids (not none), lowest first, as far as the greatest id needs them."""
    top = max(1, int(ids.max()).bit_length())
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, i].tobytes() for i in range((top + 7) // 8)]
    bits = np.unpackbits(raw, axis=1, count=top, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(top)]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """``n`` ids from their planes."""
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for i, plane in enumerate(planes):
            raw[:, i] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, plane in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4")[:, 0]


def file_bytes(ids: np.ndarray, docs: list[int | None], lengths: list[int], shard: int, part: int, kind: str = "byte", end_id: int = 2, chunk_ids: int = CHUNK_IDS, level: int = 3) -> bytes:
    """A whole file without the line feed at its end."""
    pack = zstandard.ZstdCompressor(level=level).compress
    out, place, chunks = [MAGIC], len(MAGIC), []
    for at in range(0, len(ids), chunk_ids):
        chunk = ids[at : at + chunk_ids]
        packed = [pack(p) for p in planes_of(chunk, kind)]
        chunks.append([place, len(chunk), [len(p) for p in packed]])
        out += packed
        place += sum(map(len, packed))
    about = {"shard": shard, "part": part, "kind": kind, "chunk_ids": chunk_ids, "n_ids": len(ids), "n_docs": len(docs), "end_id": end_id, "chunks": chunks}
    named = np.array([d or 0 for d in docs], "<i8")
    step = named.copy()
    step[1:] ^= named[:-1]
    index = pack(json.dumps(about).encode() + b"\n" + step.tobytes() + np.array(lengths, "<u4").tobytes() + np.packbits([d is None for d in docs]).tobytes())
    return b"".join([*out, index, struct.pack("<QQ", place, len(index)), MAGIC])


class IdFile:
    """One file's bytes: what it holds, and ranges of its ids."""

    def __init__(self, raw: bytes | memoryview):
        raw = memoryview(raw)
        size = len(raw) - 1
        if raw[:8] != MAGIC or raw[size - 8 :] != MAGIC + b"\n":
            raise ValueError("no file of token id planes, or not all of it")
        place, length = struct.unpack("<QQ", raw[size - 24 : size - 8])
        self.raw, self._unpack = raw, zstandard.ZstdDecompressor().decompress
        about, _, rest = self._unpack(raw[place : place + length]).partition(b"\n")
        self.about = json.loads(about)
        n = self.about["n_docs"]
        self.docs = np.bitwise_xor.accumulate(np.frombuffer(rest, "<i8", n)) if n else np.zeros(0, np.int64)
        self.lengths = np.frombuffer(rest, "<u4", n, 8 * n).astype(np.int64)
        self.unnamed = np.unpackbits(np.frombuffer(rest, np.uint8, offset=12 * n), count=n).astype(bool)

    def chunk(self, k: int) -> np.ndarray:
        place, n, sizes = self.about["chunks"][k]
        ends = np.cumsum([place, *sizes])
        return ids_of([self._unpack(self.raw[a:b]) for a, b in zip(ends, ends[1:])], n, self.about["kind"])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids from ``lo`` to before ``hi``: only their chunks are read."""
        size = self.about["chunk_ids"]
        lo, hi = max(lo, 0), min(hi, self.about["n_ids"])
        if lo >= hi:
            return np.zeros(0, "<u4")
        first = lo // size
        found = np.concatenate([self.chunk(k) for k in range(first, (hi - 1) // size + 1)])
        return found[lo - first * size : hi - first * size]


def write_ids(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, kind: str = "byte", chunk_ids: int = CHUNK_IDS, file_ids: int = FILE_IDS) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of the documents' ids.

    Null texts are empty, and documents without an id come first. Rows that share an id follow each other in an order of their texts; each is
    written. An empty table gives a folder without such files. Other columns are not read. A task holds the ids of one file (``file_ids``, and the rest
    of the document that reaches them), whatever its share of documents; their number is the session's number of shuffle partitions.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "text").select("id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, ids, lengths, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def made() -> pa.RecordBatch:
            raw = file_bytes(np.frombuffer(b"".join(held), "<u4"), ids, lengths, shard, part, kind, end_id, chunk_ids)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["file"])

        for batch in _by_bytes(batches, 1):
            for doc, raw in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1), vocabulary)):
                ids.append(doc)
                lengths.append(len(raw) // 4 + 1)
                held += (raw, end)
                size += lengths[-1]
                if size >= file_ids:
                    yield made()
                    part, ids, lengths, held, size = part + 1, [], [], [], 0
        if ids:
            yield made()

    files = rows.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents of a folder; ``start``: the ids of all documents before.

    Each file is read once. Where its ids start follows from the sums of the files before it: a row for each file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for content in batch.column(0):
                file = IdFile(content.as_buffer())
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                for lo in range(0, len(ends), 2000):
                    hi = min(lo + 2000, len(ends))
                    raw = file.ids(int(starts[lo]), int(ends[hi - 1])).tobytes()
                    cuts = [(4 * int(a - starts[lo]), 4 * int(b - starts[lo])) for a, b in zip(starts[lo:hi], ends[lo:hi])]
                    whole = [raw[a:b] for a, b in cuts]
                    columns = [pa.array(np.full(hi - lo, file.about[k])) for k in ("shard", "part")]
                    columns += [pa.array(file.docs[lo:hi], mask=file.unnamed[lo:hi]), pa.array(starts[lo:hi]), pa.array(file.lengths[lo:hi]), pa.array([zlib.crc32(x) for x in whole], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in whole], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "shard long, part long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = stage_table(files.mapInArrow(run, schema), "id-planes-read")
    sizes = rows.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n"))
    before = lambda w, n: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("all")).withColumn("base", before(Window.orderBy("shard"), "all"))  # a row for each writing task
    placed = stage_table(sizes.join(shards, "shard").select("shard", "part", (F.col("base") + before(Window.partitionBy("shard").orderBy("part"), "n")).alias("base")), "id-planes-files")
    few = placed.count() <= BROADCAST_IDS
    joined = rows.join(F.broadcast(placed) if few else placed, ["shard", "part"])
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
