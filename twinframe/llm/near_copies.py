"""The SimHash operator for a stage that must find every pair with a Jaccard similarity of 0.8 or more.

A document is the set of its shingles of ``SHINGLE`` words (64-bit hashes). Two proposals are made, and both are verified by the exact
similarity of the sets:

* SimHash fingerprints within ``radius`` bits, found by the generalised pigeonhole search of ``simhash.links``;
* at a similarity of 0.8 two fingerprints of 64 bits differ in some 10 bits, a radius that no pigeonhole plan can probe on many
  documents. What the fingerprints miss is proposed by MinHash bands: of two sets with similarity s, ``BANDS`` bands of ``ROWS`` minima
  agree in at least one with chance 1 - (1 - s^ROWS)^BANDS, that is 0.9999 at 0.8.

Documents meet under the keys that they share: a key for each band, and one for each group of near fingerprints. What joins is verified links alone,
in three rounds:

1. each document meets others under one of its keys, that which most documents have; a key of more than ``block`` documents is cut
   into blocks, each settled by itself;
2. under every key that still holds documents of different components, one document of each component meets the others (and brings its
   set under one key);
3. under keys that are still mixed all documents meet, in pairs of blocks.

In rounds 2 and 3 the minima are compared first (``SKETCH`` of them have to agree, which at a similarity of 0.8 fails with a chance of some 1e-7), and only
documents with a close one of another component bring their sets. So texts that share a template but are no copies move sketches under
their keys, and no sets. What a task returns is a spanning forest of verified links; pairs that are linked already are not looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, HOT_ROWS, append_columns, as_bytes, join_by_count, slices, stage_table
from .simhash import SEED, components, keep_least, links, majority, shingle_digests

SHINGLE, BANDS, ROWS = 5, 24, 5
#: Minima of BANDS x ROWS that two sets must have in common to be compared.
SKETCH = 72
#: Two sets link when they share at least NUM / DEN of their union.
NUM, DEN = 4, 5
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def set_and_print(text: bytes | None) -> tuple[np.ndarray, int]:
    """The sorted distinct hashes of all shingles, and the SimHash fingerprint as a signed long."""
    digests = shingle_digests(text, SHINGLE)
    fp = majority(digests)
    return np.unique(np.frombuffer(b"".join(digests), np.uint64)), fp - (1 << 64) if fp >> 63 else fp


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS x ROWS hash functions over a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[None, at : at + 2048] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return least


def keys_of(least: np.ndarray) -> list[int]:
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[i * ROWS * 8 : (i + 1) * ROWS * 8], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key for each band, as signed longs; none for an empty set."""
    return keys_of(minima(shingles)) if len(shingles) else []


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if small * DEN < large * NUM:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * DEN >= (small + large - shared) * NUM


def _hash(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def with_prints(docs: DataFrame, text_col: str = "text", out: str = "print") -> DataFrame:
    """Add a hash of the shingle set: equal for texts with equal sets."""
    return append_columns(docs, [text_col], T.StructType([T.StructField(out, T.LongType())]), lambda texts: [[_hash(set_and_print(t)[0]) for t in as_bytes(texts)]])


def _with_bands(docs: DataFrame) -> DataFrame:
    """(id, print, fp, bands, sketch: the low halves of the minima, w: 1 and one more for each 512 shingles)."""

    def run(texts: pa.Array) -> list[list]:
        made = list(map(set_and_print, as_bytes(texts)))
        least = [minima(s) if len(s) else None for s, _ in made]
        bands = [[] if m is None else keys_of(m) for m in least]
        return [[_hash(s) for s, _ in made], [fp for _, fp in made], bands, [b"" if m is None else m.astype("<u4").tobytes() for m in least], [1 + len(s) // 512 for s, _ in made]]

    fields = [T.StructField("print", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("w", T.LongType())]
    return append_columns(docs, ["text"], T.StructType(fields), run).select("id", "print", "fp", "bands", "sketch", "w")


def _with_sets(docs: DataFrame) -> DataFrame:
    def run(texts: pa.Array) -> list[list]:
        made = list(map(set_and_print, as_bytes(texts)))
        return [[s.tobytes() for s, _ in made], [np.array(band_keys(s), np.int64).tobytes() for s, _ in made], [fp for _, fp in made]]

    fields = [T.StructField("shingles", T.BinaryType()), T.StructField("bands", T.BinaryType()), T.StructField("fp", T.LongType())]
    return append_columns(docs, ["text"], T.StructType(fields), run).drop("text")


def forest(sets: list[np.ndarray], bands: np.ndarray, prints: np.ndarray, radius: int, start: np.ndarray | None = None, part: np.ndarray | None = None) -> np.ndarray:
    """The root of each set over verified links of pairs that share a band (``bands``: a row for each set) or have near fingerprints.

    Sets with equal ``start`` are taken for linked; only pairs of different ``part`` are looked at, where there are different ones.
    """
    across = part is not None and (part != part[0]).any()
    root = np.arange(len(sets)) if start is None else np.unique(start, return_index=True)[1][np.unique(start, return_inverse=True)[1]]
    refuted = set()

    def look(i: int, others: np.ndarray) -> None:
        others = others[(root[others] != root[i]) & (part[others] != part[i])] if across else others[root[others] != root[i]]
        for j in others.tolist():
            pair = (i, j) if i < j else (j, i)
            if root[i] == root[j] or pair in refuted:
                continue
            if similar(sets[i], sets[j]):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
            else:
                refuted.add(pair)

    for column in bands.T:
        order = np.argsort(column, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(column[order])) + 1):
            for at, i in enumerate(run[:-1].tolist()):
                look(i, run[at + 1 :])
    for i in range(len(sets) - 1):
        if (root != root[i]).any():
            look(i, i + 1 + np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius))
    return root


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each key without the key; the batches are sorted by it, and it comes first."""
    key, held = None, []
    for batch in slices(batches, 100):
        for k, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if k != key:
                if len(held) > 1:
                    yield held
                key, held = k, []
            held.append(row)
    if len(held) > 1:
        yield held


def _verified(dealt: DataFrame, radius: int) -> DataFrame:
    """From (key, id, root, shingles, bands, fp): edges (a, b) of verified links between rows that share a key and have different roots, and from each row to its root's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_key(batches):
            ids, start, sets, bands, prints = zip(*held)
            node, start = np.array(ids, np.int64), np.array(start, np.int64)
            root = forest([np.frombuffer(s, np.uint64) for s in sets], np.array([np.frombuffer(b, np.int64) for b in bands]), np.array(prints, np.int64).view(np.uint64), radius, start, start)
            other = node[root]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node, other)), pa.array(np.minimum(node, other))], names=["a", "b"])

    rows = dealt.select("key", "id", "root", "shingles", "bands", "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").filter("a > b").distinct()


def _sketched(dealt: DataFrame) -> DataFrame:
    """Of (key, id, root, sketch) those rows (key, id, root) that have a close sketch of another root under their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_key(batches):
            keys, ids, roots, sketches = zip(*held)
            sketch, root = np.array([np.frombuffer(s, "<u4") for s in sketches]), np.array(roots)
            close = np.zeros(len(held), bool)
            for i in range(len(held) - 1):
                met = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
                met = met[(sketch[met] == sketch[i]).sum(axis=1) >= SKETCH]
                close[met] = True
                close[i] |= len(met) > 0
            at = np.flatnonzero(close)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c)[at], pa.int64()) for c in (keys, ids, roots)], names=["key", "id", "root"])

    rows = dealt.select("key", F.col("key").alias("same"), "id", "root", "sketch")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, id long, root long")


def _blocks_met(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, n: the weight of all rows of the key) under the keys of the blocks that meet: the key itself up to ``block``, else each two of its blocks."""
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.xxhash64("key", F.least(own, i), F.greatest(own, i)))
    return rows.withColumn("key", F.explode(F.when(blocks > 1, pair).otherwise(F.array("key"))))


def _joined(candidates: DataFrame, sketches: DataFrame, sets: DataFrame, edges: DataFrame, heads: bool, radius: int, block: int, hot_rows: int) -> DataFrame:
    """``edges`` and the verified links under keys that hold different components: between one document of each (``heads``) or all of them."""
    found = components(edges)
    placed = candidates.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "w", F.coalesce("component", "id").alias("root"))
    placed = stage_table(placed, "copies-placed")
    chosen = placed.groupBy("key", "root").agg(F.min(F.struct("id", "w")).alias("m")).select("key", "root", "m.id", "m.w") if heads else placed
    sums = [F.min("root").alias("least"), F.max("root").alias("most"), F.sum("w").alias("n"), F.count("*").alias("rows")]
    mixed = stage_table(chosen.groupBy("key").agg(*sums).filter("least < most").select("key", "n", "rows"), "copies-mixed")
    if mixed.isEmpty():
        return edges
    met = join_by_count(chosen, mixed, "key", "rows", hot_rows=hot_rows).drop("rows", "w")
    close = _sketched(_blocks_met(met, block).join(sketches, "id"))
    if heads:  # copies share many keys: one is enough here, as the next round looks at all that are still apart
        close = close.groupBy("id").agg(F.min("key").alias("key"), F.min("root").alias("root"))
    close = stage_table(close, "copies-close")
    return stage_table(edges.union(_verified(close.join(sets, "id"), radius)).distinct(), "copies-edges")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, block: int = 512, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, print, component_id) for each row of ``docs``: component_id is the least id reachable over links, the row's own included.

    Rows with equal shingle sets share a component, texts without words (null, empty, blank) among them. A row whose id is null gets
    its set's component, or null if no named row has that set. Rows that repeat an id are one node. An empty table gives none. Other columns
    are not read, so names that clash with ours do no harm.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = stage_table(_with_bands(rows), "copies-prints")
    made = [F.min("id").alias("rep"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("bands", "sketch", "w")], F.count("*").alias("n")]
    reps = stage_table(prints.groupBy("print").agg(*made), "copies-reps")
    named = reps.filter("rep is not null and size(bands) > 0").select(F.col("rep").alias("id"), "fp", "bands", "sketch", "w")
    by_print = stage_table(named.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies-fingerprints")
    near = components(links(by_print.select("fp", "rep"), radius, block))
    met = by_print.join(near, F.col("rep") == F.col("node"), "left").filter("component is not null or n > 1").select("fp", F.xxhash64(F.lit("fp"), F.coalesce("component", "rep")).alias("key"), "n")
    by_fp = join_by_count(named.select("fp", "id", "w"), stage_table(met, "copies-near"), "fp", hot_rows=hot_rows).select("key", "id", "w")
    keyed = stage_table(named.select(F.explode("bands").alias("key"), "id", "w").unionByName(by_fp), "copies-keys")
    shared = stage_table(keyed.groupBy("key").agg(F.sum("w").alias("n"), F.count("*").alias("rows")).filter("rows > 1"), "copies-shared")
    candidates = stage_table(join_by_count(keyed, shared, "key", "rows", hot_rows=hot_rows), "copies-candidates")
    members = stage_table(candidates.groupBy("id").agg(F.max(F.struct("rows", "key", "n")).alias("m")).select("id", "m.key", "m.n"), "copies-members")
    few = members.count() <= BROADCAST_IDS
    sets = stage_table(_with_sets(rows.join(F.broadcast(members) if few else members, "id")), "copies-sets")
    # Round 1: a set counts once for each 512 of its shingles, so a block has some 2 MB at most, whatever the length of texts.
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.col("n") / F.lit(block)))
    alone = sets.select(F.xxhash64("key", part).alias("key"), "id", F.col("id").alias("root"), "shingles", "bands", "fp")
    edges = stage_table(_verified(alone, radius), "copies-edges")
    sketches, held = named.select("id", "sketch"), sets.select("id", "shingles", "bands", "fp")
    for heads in (True, False):
        edges = _joined(candidates.select("key", "id", "w"), sketches, held, edges, heads, radius, block, hot_rows)
    classes = reps.join(components(edges), F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("component_id"), "n")
    return join_by_count(prints.select("id", "print"), classes, "print", hot_rows=hot_rows).select(F.col("id").alias(id_col), "print", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group of near copies; of rows that repeat an id, one stays.

    Rows with a null id stay only if no named row has their shingle set, one of each set. Other columns stay as they are.
    """
    found = stage_table(near_copies(docs, id_col, text_col, **options), "copies-components")
    return keep_least(docs, found, id_col, "print", lambda rows, out: with_prints(rows, text_col, out))
