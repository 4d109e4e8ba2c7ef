"""Packing documents into fixed-length sequences by cutting stock with column generation.

Documents are tokenised and cut into full sequences and one remainder. Remainders are stock items whose widths are lengths
rounded up to a grid of ``capacity / units``; the histogram over widths is the demand. A linear program over patterns of widths is
solved by column generation (knapsack dynamic programming prices new patterns), the solution is rounded down, and the few widths
left over are packed first-fit decreasing. The LP has at most ``units`` rows whatever the input. Items of a width are ranked on
executors, and rank ranges map to (pattern, copy, slot), so each item finds its sequence without a global sort.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, stage_table, trimmed

#: Bytes of remembered chunks (with some 180 for the objects of each), and of the longest chunk that is remembered.
CACHE_BYTES, LONGEST = 128_000_000, 64
#: Chunks that are encoded as one text, with a special token between them.
JOINED = 32
#: Letters of ASCII and Latin-1 in UTF-8, a chunk of nothing else, and the marks (no apostrophe) at the end of a chunk after one or a digit.
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_WORD = re.compile(rb"(?:[a-z]|" + _LATIN + rb")+\Z")
_TAIL = re.compile(rb"(?:(?<=[a-z0-9])|(?<=" + _LATIN + rb"))[!-&(-/:-@\[-`{-~]+\Z")
_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes texts by their chunks between ASCII white space.

    The vocabulary ignores case and drops white space, so a text's ids are those of its chunks, each encoded by itself; and those of a
    chunk that ends with marks after a letter or digit are those of its two parts, as a run of marks is a word of its own. Chunks of letters
    are one word each, so many are encoded as one text and cut behind the ids that end a word. Texts that may hold a special token go through whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.normalized)]
        self.mark_id, self.mark = special[-1] if special else (None, "")
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        ids = self.tok.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in ids.items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        words = [c for c in chunks if _WORD.match(c)] if self.ends.any() else []
        rest = list(set(chunks).difference(words)) if words else chunks
        return dict(zip(words, self._words([c.decode() for c in words]))) | dict(zip(rest, self._marked([c.decode() for c in rest])))

    def _words(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at, ids in zip(range(0, len(texts), JOINED), self._ids([" ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])):
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            part = texts[at : at + JOINED]
            if len(cuts) == len(part):
                raw = ids.tobytes()
                out += [raw[4 * lo : 4 * hi] for lo, hi in zip([0, *cuts], cuts)]
            else:  # a vocabulary that makes more of a run of letters
                out += [x.tobytes() for x in self._ids(part)]
        return out

    def _marked(self, texts: list[str]) -> list[bytes]:
        if self.mark_id is None:
            return [x.tobytes() for x in self._ids(texts)]
        out: list[bytes] = []
        for at, ids in zip(range(0, len(texts), JOINED), self._ids([f" {self.mark} ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])):
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            part = texts[at : at + JOINED]
            if len(cuts) == len(part) - 1:
                raw = ids.tobytes()
                out += [raw[4 * lo : 4 * hi] for lo, hi in zip([0, *[c + 1 for c in cuts]], [*cuts, len(ids)])]
            else:  # a chunk that makes the token itself
                out += [x.tobytes() for x in self._ids(part)]
        return out

    def _learn(self, chunks: set[bytes]) -> list[bytes]:
        """Put chunks into ``known``; returns those that are too long to stay."""
        tails = {c: m.start() for c in chunks if (m := _TAIL.search(c))}
        need = [c for c in {c[: tails[c]] if c in tails else c for c in chunks} | {c[at:] for c, at in tails.items()} if c not in self.known]
        for at in range(0, len(need), 20_000):
            self.known.update(self._encode(need[at : at + 20_000]))
        for c, at in tails.items():
            self.known[c] = self.known[c[:at]] + self.known[c[at:]]
        new = [*need, *tails]
        self.held += sum(len(c) + len(self.known[c]) + 180 for c in new)
        return [c for c in new if len(c) > LONGEST]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        chunks = [None if b"<|" in t else t.lower().split() for t in texts]
        found = [cs and list(map(self.known.get, cs)) for cs in chunks]
        missing = {c for cs, vs in zip(chunks, found) if cs and None in vs for c, v in zip(cs, vs) if v is None}
        long = self._learn(missing) if missing else []
        get = self.known.__getitem__
        out = []
        for t, cs, vs in zip(texts, chunks, found):
            if cs is None:
                out.append(self._ids([t.decode()])[0].tobytes())
            else:
                out.append(b"".join([get(c) if v is None else v for c, v in zip(cs, vs)] if None in vs else vs))
        for c in long:
            self.held -= len(c) + len(self.known.pop(c)) + 180
        if self.held > CACHE_BYTES:  # frequent chunks are in this batch and stay
            recent = {c: self.known[c] for cs in chunks if cs for c in cs if c in self.known}
            self.known, self.held = recent, sum(len(c) + len(v) + 180 for c, v in recent.items())
            if self.held > CACHE_BYTES // 2:
                self.known, self.held = {}, 0
        return out


def token_bytes(texts: list[bytes], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, by the tokenizer file ``path``."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path](texts)


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): full sequences and the remainder of each document.

    A document's ids are those of its text (null: empty) and then ``end_id``, so each document has at least one piece.
    """
    end = np.array([end_id], "<u4").tobytes()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in as_bytes(batch.column(1))]
            for lo in range(0, len(ids), 500):
                rows: list[list] = [[], [], [], [], [], []]
                for doc, raw in zip(ids[lo : lo + 500], token_bytes(texts[lo : lo + 500], vocabulary)):
                    raw += end
                    for at in range(0, len(raw), 4 * capacity):
                        cut = raw[at : at + 4 * capacity]
                        for column, value in zip(rows, (doc, at // 4, len(cut) // 4, zlib.crc32(cut), len(raw) // 4, np.frombuffer(cut, "<u4").astype(np.int32) if with_ids else None)):
                            column.append(value)
                columns = [pa.array(c, pa.int64()) for c in rows[:5]] + ([pa.array(rows[5], pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return source.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def best_pattern(value: np.ndarray, widths: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of widths that fits into ``units``: unbounded knapsack by dynamic programming."""
    use = np.flatnonzero(value > 1e-12)
    counts = np.zeros(len(widths), int)
    if not len(use):
        return 0.0, counts
    v, w = value[use], widths[use]
    order = np.argsort(w, kind="stable")
    v, w, use = v[order], w[order], use[order]
    best, took = np.zeros(units + 1), np.full(units + 1, -1)
    for c in range(1, units + 1):
        fits = np.searchsorted(w, c, side="right")
        best[c] = best[c - 1]
        if fits:
            gain = best[c - w[:fits]] + v[:fits]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], took[c] = gain[i], i
    c = units
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[use[took[c]]] += 1
            c -= int(w[took[c]])
    return float(best[units]), counts


def column_generation(widths: np.ndarray, demand: np.ndarray, units: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns with multiplicities that meet ``demand`` exactly: rounded LP solution, then first fit for what is left."""
    m = len(widths)
    patterns = np.diag(units // widths).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns)) if m else patterns
    x = inverse @ demand
    for i in range(rounds if m else 0):
        if i % 200 == 199:  # one step of refinement, so rounding errors don't pile up
            inverse = 2 * inverse - inverse @ (patterns @ inverse)
            x = np.maximum(inverse @ demand, 0)
        gain, column = best_pattern(inverse.sum(axis=0), widths, units)
        if gain <= 1 + 1e-3:  # then the LP value is within 0.1 % of its bound
            break
        d = inverse @ column
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        r = int(ratio.argmin())
        patterns[:, r] = column
        x = x - ratio[r] * d
        x[r] = ratio[r]
        x = np.maximum(x, 0)
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
    left, out = demand.astype(int).copy(), []
    for j in np.argsort(-x, kind="stable"):
        column = np.rint(patterns[:, j]).astype(int)
        used = column > 0
        times = min(int(np.floor(x[j] + 1e-6)), int((left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            out.append((column, times))
            left -= times * column
    while left.any():  # first fit decreasing, one pattern at a time, repeated while its widths last
        column, room = np.zeros(m, int), units
        for i in np.argsort(-widths, kind="stable"):
            take = min(int(left[i]), room // int(widths[i]))
            column[i], room = take, room - take * int(widths[i])
        used = column > 0
        times = int((left[used] // column[used]).min())
        out.append((column, times))
        left -= times * column
    return out


def _slots(units: int):
    """From the histogram to the rank ranges [lo, hi) of each width: ``each`` ranks to a sequence, the first of them ``first``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        histogram = pd.concat([pd.DataFrame({"width": [], "n": []}), *frames]).groupby("width")["n"].sum().sort_index()
        widths, rows, first = histogram.index.to_numpy(int), [], 0
        done = np.zeros(len(widths), int)
        for column, times in column_generation(widths, histogram.to_numpy(float), units):
            for i in np.flatnonzero(column):
                rows.append((widths[i], done[i], done[i] + column[i] * times, column[i], first))
                done[i] += column[i] * times
            first += times
        yield pd.DataFrame(rows, columns=["width", "lo", "hi", "each", "first"], dtype="int64").astype({"width": "int32"})

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, units: int = 128, group: int = 200_000, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id (from 0, gapless) and offset in the sequence (from 0, gapless).

    Items of a width are ranked in groups of some ``group`` pieces. Null and empty texts give a piece that holds only ``end_id``. Repeated
    rows, and rows with a null id, are packed each for itself; an empty table gives none. Other columns of ``docs`` are not read, so clashing names
    do no harm.
    """
    grid = capacity // units
    items = pieces(docs, vocabulary, id_col, text_col, capacity, end_id, with_ids)
    items = stage_table(items.withColumn("width", F.ceil(F.col("length") / grid).cast("int")), "packing-pieces")
    salts = max(64, items.count() // group)
    items = items.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = items.groupBy("width", "salt").count()
    table = stage_table(counts.withColumn("base", F.sum("count").over(Window.partitionBy("width").orderBy("salt")) - F.col("count")), "packing-counts")
    histogram = table.groupBy("width").agg(F.sum("count").alias("n")).coalesce(1)  # at most `units` rows
    # At most (patterns x widths) rows: bounded by `units`, not by the data.
    slots = F.broadcast(stage_table(histogram.mapInPandas(_slots(units), "width int, lo long, hi long, each long, first long"), "packing-slots"))
    ranked = items.join(table.select("width", "salt", "base"), ["width", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("width", "salt").orderBy("id", "start", "length", "ids_crc32")) - 1)
    placed = ranked.alias("r").join(slots.alias("s"), (F.col("r.width") == F.col("s.width")) & (F.col("r.rank") >= F.col("s.lo")) & (F.col("r.rank") < F.col("s.hi")))
    placed = placed.select("r.*", (F.col("s.first") + F.expr("(r.rank - s.lo) div s.each")).alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("width"), "rank")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    keep = ["start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    return placed.withColumn("offset", offset).select(F.col("id").alias(id_col), *keep, "sequence_id", "offset")
