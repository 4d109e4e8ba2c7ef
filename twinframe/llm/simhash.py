"""Near duplicates by SimHash fingerprints and a generalised pigeonhole search.

Fingerprints of 64 bits link when at most ``radius`` bits differ. The bits are grouped into partitions of correlated bits, and
each partition i gets a threshold t_i with sum(t_i) = radius - partitions + 1 (t_i = -1: not probed). Two linked fingerprints
are then within t_i in at least one partition, so probing every partition within its threshold finds every link. Dynamic
programming picks the thresholds of least cost from the candidate counts that the bits' statistics predict.

A probe within t_i is a key that leaves out t_i of the partition's bits. Rows meet by key; a key with more rows than
``block`` is dealt out in pairs of blocks, so no task holds more than two blocks of a key, and no candidate is lost. What a
task returns is a spanning forest of the verified links it has seen, so a dense group of g fingerprints gives some g rows for
each of its keys and not g squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, HOT_ROWS, append_columns, as_bytes, join_by_count, stage_table

SEED = 42
#: Estimated seconds for a probe row (shuffled, sorted) and for a candidate pair (verified).
PROBE_S, PAIR_S = 1.2e-6, 3e-8


def shingle_digests(text: bytes | None, shingle: int) -> list[bytes]:
    """The 8-byte digest of each shingle of one text, repeats included; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    k = min(shingle, len(words))
    starts = np.concatenate(([0], gaps + 1))[: len(words) - k + 1].tolist()
    ends = np.append(gaps, len(joined))[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends)]


def majority(digests: list[bytes]) -> int:
    """The unsigned 64-bit number whose bits are set in over half of the digests; 0 for none."""
    if not digests:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 16):
        raw = np.frombuffer(b"".join(digests[at : at + (1 << 16)]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of one text; 0 without words."""
    return majority(shingle_digests(text, shingle))


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 4) -> DataFrame:
    """Add the fingerprint as a signed long. Null or empty texts get 0; words are split at ASCII white space."""

    def run(texts: pa.Array) -> list:
        prints = np.array([fingerprint(t, shingle) for t in as_bytes(texts)], dtype=np.uint64)
        return [prints.view(np.int64)]

    return append_columns(docs, [text_col], T.StructType([T.StructField(out, T.LongType())]), run)


def bit_statistics(prints: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """How many rows there are and, for each pair of bits, in how many both are set: 64 x 64 sums, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((64, 64), np.int64)
        for batch in batches:
            x = np.asarray(batch.column(0)).astype(np.int64, copy=False).view(np.uint64)
            bits = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            total += len(x)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([both.ravel().tolist()], pa.list_(pa.int64()))], names=["n", "both"])

    parts = prints.select(column).mapInArrow(run, "n long, both array<long>")
    sums = parts.select("n", F.posexplode("both").alias("at", "one")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("one").alias("one"))
    rows = sums.collect()  # 4096 rows at most
    both = np.zeros(4096, np.int64)
    for r in rows:
        both[r["at"]] = r["one"]
    return (rows[0]["n"] if rows else 0), both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into ``parts`` groups of near-equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds: the cheapest allocation over 1 to ``radius`` + 1 partitions."""
    p = np.diag(both) / max(n, 1) if n else np.full(64, 0.5)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2 if radius else 1, radius + 2):
        groups, total = group_bits(n, both, parts), radius - parts + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by sum of (threshold + 1)
        for group in groups:
            dist = np.ones(1)
            for b in group:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            within = np.cumsum(dist)
            step: dict[int, tuple[float, list[int]]] = {}
            for t in range(-1, min(total + parts, 3)):
                cost = 0.0 if t < 0 else comb(len(group), t) * n * PROBE_S + n * n / 2 * within[t] * PAIR_S
                for have, (spent, chosen) in table.items():
                    key = have + t + 1
                    if key <= total + parts and (key not in step or spent + cost < step[key][0]):
                        step[key] = (spent + cost, [*chosen, t])
            table = step
        if total + parts in table and (best is None or table[total + parts][0] < best[0]):
            best = (table[total + parts][0], list(zip(groups, table[total + parts][1])))
    return best[1]


def probe_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bit masks of all probe keys, as signed longs."""
    masks = []
    for group, t in plan:
        for left_out in combinations(group, t) if t >= 0 else ():
            mask = sum(1 << b for b in group if b not in left_out)
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def verified_forest(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: edges (row, root) that span the verified links within each key."""
    n = len(keys)
    root = np.arange(n)
    a_all, b_all = [], []
    live, step = np.arange(n), 1
    while len(live := live[live + step < n]):
        live = live[keys[live] == keys[live + step]]
        close = live[np.bitwise_count(prints[live] ^ prints[live + step]) <= radius]
        a_all.append(close)
        b_all.append(close + step)
        step += 1
    a, b = np.concatenate([*a_all, np.zeros(0, int)]).astype(int), np.concatenate([*b_all, np.zeros(0, int)]).astype(int)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    while (root != root[root]).any():
        root = root[root]
    nodes = np.flatnonzero(root != np.arange(n))
    return nodes, root[nodes]


def links(prints: DataFrame, radius: int = 4, block: int = 512) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints which links connect. ``prints``: distinct ``fp`` with an id ``rep``."""
    n, both = bit_statistics(prints)
    masks = probe_masks(allocate(n, both, radius))
    keyed = prints.select(F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("key"), "fp", "rep")
    hot = stage_table(keyed.groupBy("key").count().filter(F.col("count") > block), "simhash-hot")
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.xxhash64("key", F.least(own, i), F.greatest(own, i)))
    dealt = join_by_count(keyed, hot, "key", "count", "left").select(F.explode(F.when(F.col("count").isNull(), F.array("key")).otherwise(pair)).alias("key"), "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def made(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            x, y = verified_forest(key, fp.view(np.uint64), radius)
            x, y = rep[x], rep[y]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:  # the last key may go on in the next batch
                yield made(*[np.ascontiguousarray(h[:cut]) for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield made(*[np.ascontiguousarray(h) for h in held])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge. Alternating large and small stars.

    A node with more edges than ``hot_rows`` and than a thousandth of all (the hub of a star) meets its minimum without a shuffle of its edges.
    """
    size = 0

    def meet(e: DataFrame, least: DataFrame) -> DataFrame:
        return e.join(least, "a") if 2 * size <= hot_rows else join_by_count(e, stage_table(least, "edges-least"), "a", hot_rows=hot_rows)

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        return meet(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        joined = meet(e, e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        ends = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        return joined.select(ends).select("e.a", "e.b").filter("a > b").distinct()

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = stage_table(edges.filter("a > b"), "edges")
    before = mark(edges)
    for _ in range(rounds):
        size = before[0]
        stars = large(edges)
        edges = stage_table(small(stars if 2 * size <= hot_rows else stage_table(stars, "edges-large")), "edges")
        now = mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, block: int = 512, hub: int = HOT_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``.

    component_id is the least id reachable over links, the row's own included. Rows without words (null or empty text) have the
    fingerprint 0 and link like any other. Rows with the same fingerprint share a component, repeated rows included. A row
    whose id is null gets its fingerprint's component, or null if no id is reachable at that fingerprint. An empty table gives none.
    Other columns of ``docs`` are not read, so names that clash with ours do no harm.
    """
    prints = stage_table(with_fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), shingle=shingle).select("id", "fp"), "simhash-prints")
    reps = stage_table(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    joined = components(links(reps.filter("rep is not null").select("fp", "rep"), radius, block), hot_rows=hub)
    classes = reps.join(joined, reps["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n")
    return join_by_count(prints, classes, "fp", hot_rows=hot_rows).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group of near duplicates; of rows that repeat an id, one stays.

    Rows with a null id have no name to keep them by and stay only if no named document has their fingerprint's group.
    """
    found = stage_table(near_duplicates(docs, id_col, text_col, **options), "simhash-groups")
    return keep_least(docs, found, id_col, "fp", lambda rows, out: with_fingerprints(rows, text_col, out, options.get("shingle", 4)))


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, print_col: str, add_prints: Callable[[DataFrame, str], DataFrame], broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row for each component of ``found`` (id, print, component_id), by ``add_prints`` also for rows without an id.

    Up to ``broadcast_ids`` ids that go are broadcast, so no text is moved; more meet the documents in a shuffle by id.
    """
    drop = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    few = drop.count() <= broadcast_ids
    kept = docs.join(F.broadcast(drop) if few else drop, id_col, "left_anti")
    named = found.filter(F.col(id_col).isNull()).isEmpty()
    if not named:
        lone = found.groupBy(print_col).agg(F.max("component_id").alias("c")).filter("c is null").select(F.col(print_col).alias("__print"))
        rows = add_prints(docs.filter(F.col(id_col).isNull()), "__print")
        unnamed = rows.join(lone, "__print", "left_semi").dropDuplicates(["__print"]).select(docs.columns)
        kept = kept.filter(F.col(id_col).isNotNull()).unionByName(unnamed)
    repeated = found.filter(F.col(id_col) == F.col("component_id")).groupBy(id_col).count().filter("count > 1").select(id_col)
    if not repeated.isEmpty():
        once = kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col])
        kept = kept.join(repeated, id_col, "left_anti").unionByName(once)
    return kept.select(docs.columns)
