"""Hard negatives by exact inner-product search with length buckets and coordinate pruning.

Vectors become integers, so scores are exact. Rows lie in blocks of decreasing length, and a block is cut into buckets. A bucket keeps, for
each coordinate, its normalised rows sorted by that coordinate. An anchor q with the score s to reach (that of its k-th best row so far, or
the least that is allowed) looks at a bucket whose longest row has length l only if s <= |q| l. Normalised rows then need a cosine of
at least c = s / (|q| l) with q, so on q's focus coordinates (its largest ones) the row's value lies within
cos(arccos(q_f) +- arccos(c)). Binary search gives each of these ranges, the candidates of the shortest are intersected with the other ranges, and
what is left is verified by its integer score.

Anchors and rows meet in pairs of blocks, each a bounded group. A first wave looks at the blocks with the longest rows and gives each anchor
a score to reach; the second wave takes all other blocks and drops those pairs, and those anchors of a pair, whose lengths can't reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stage_table
from .vectors import finite_rows, width

#: Rows and anchors of a block, rows of a bucket, coordinates that an anchor looks at.
ROW_BLOCK, ANCHOR_BLOCK, BUCKET, FOCUS = 32_768, 4096, 2048, 4
#: What rounding may add to a cosine or a length.
SLACK = 1e-9
_ANY = 1 << 62


def integer_rows(df: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(vec_id, label, x: little-endian 32-bit integers floor(scale * c), size2: their sum of squares, is_anchor), one row an id."""
    d = width(df, vec_col)
    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")).filter("vec_id is not null and label is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            whole, vectors = finite_rows(part.column(1), d, shorter=True)
            x = np.floor(scale * vectors)
            if x.size and np.abs(x).max() >= 1 << 31:
                raise ValueError(f"a component times {scale} is beyond 32 bits")
            x, keep = x.astype("<i4"), pa.array(whole)
            size2 = np.einsum("ij,ij->i", x.astype(np.int64), x.astype(np.int64))
            columns = [part.column(0).filter(keep), part.column(2).filter(keep), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(size2), part.column(3).filter(keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "size2", "is_anchor"])

    rows = source.mapInArrow(run, "vec_id long, label long, x binary, size2 long, is_anchor boolean")
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x", "size2")).alias("r"), F.max("is_anchor").alias("is_anchor"))
    return once.select("vec_id", "r.label", "r.x", "r.size2", "is_anchor")


def in_blocks(rows: DataFrame, order: list[Column], block: int, name: str, label: str) -> DataFrame:
    """Staged rows in the order of ``order``, with the number of their block (``block`` rows, but for the last) in ``name``, however many partitions Spark makes."""
    placed = stage_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), label)
    part, inside = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    base = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))  # a row for each partition
    return placed.withColumn("__p", part).join(F.broadcast(base), "__p").withColumn(name, F.floor((F.col("__base") + inside) / block)).drop("__m", "__p", "__base")


class Bucket:
    """Rows of similar length with their sorted coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, size2: np.ndarray):
        self.ids, self.labels, self.x, self.sizes = ids, labels, x, np.sqrt(size2.astype(float))
        self.longest = float(self.sizes.max())
        self._real: np.ndarray | None = None
        self._unit: np.ndarray | None = None

    def scores(self, q: np.ndarray, size: float, at: np.ndarray | None = None) -> np.ndarray:
        """Exact scores of the rows ``at`` (None: all) with an anchor of integers."""
        if size * self.longest < 1 << 52:  # then every partial sum is exact in doubles
            if self._real is None:
                self._real = self.x.astype(float)
            rows = self._real if at is None else self._real[at]
            return (rows @ q.astype(float)).astype(np.int64)
        return (self.x if at is None else self.x[at]).astype(np.int64) @ q.astype(np.int64)

    def candidates(self, q: np.ndarray, size: float, reach: int, focus: int) -> np.ndarray | None:
        """Rows that may score ``reach`` or more; None where all may."""
        if reach <= 0 or not size:
            return None
        cosine = reach / (size * self.longest)
        if cosine > 1 + SLACK:
            return np.zeros(0, np.int64)
        if self._unit is None:
            self._unit = self.x / np.maximum(self.sizes, 1e-300)[:, None]
            self.order = np.argsort(self._unit, axis=0)
            self.sorted = np.take_along_axis(self._unit, self.order, 0)
        wide = np.arccos(min(max(cosine - SLACK, -1.0), 1.0))
        unit = q / size
        chosen = np.argpartition(-np.abs(unit), min(focus, len(unit)) - 1)[:focus]
        angles = np.arccos(np.clip(unit[chosen], -1, 1))
        low, high = np.cos(np.minimum(angles + wide, np.pi)) - SLACK, np.cos(np.maximum(angles - wide, 0)) + SLACK
        cuts = [(int(np.searchsorted(self.sorted[:, f], a)), int(np.searchsorted(self.sorted[:, f], b, "right"))) for f, a, b in zip(chosen, low, high)]
        best = min(range(len(cuts)), key=lambda i: cuts[i][1] - cuts[i][0])
        found = self.order[cuts[best][0] : cuts[best][1], chosen[best]]
        for i, f in enumerate(chosen):
            if i != best and len(found):
                values = self._unit[found, f]
                found = found[(values >= low[i]) & (values <= high[i])]
        return found


def buckets_of(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, size2: np.ndarray, by_label: bool, bucket: int) -> list[Bucket]:
    """Buckets of at most ``bucket`` rows by decreasing length, of one label each if ``by_label``."""
    order = np.lexsort((ids, -size2, labels) if by_label else (ids, -size2))
    ids, labels, x, size2 = ids[order], labels[order], x[order], size2[order]
    edges = np.flatnonzero(np.diff(labels)) + 1 if by_label else np.zeros(0, int)
    out = []
    for lo, hi in zip([0, *edges], [*edges, len(ids)]):
        out += [Bucket(ids[a : min(a + bucket, hi)], labels[a : min(a + bucket, hi)], x[a : min(a + bucket, hi)], size2[a : min(a + bucket, hi)]) for a in range(lo, hi, bucket)]
    return out


class Best:
    """The best rows so far of one query: score falling, then id."""

    def __init__(self, k: int, low: int, high: int, reach: int):
        self.k, self.high, self.reach = k, high, max(low, reach)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.reach) & (scores <= self.high)
        if not fit.any():
            return
        scores, ids = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.reach = max(self.reach, int(self.scores[-1]))


def search(anchors: DataFrame, rows: DataFrame, k: int, same: bool, bucket: int, focus: int) -> DataFrame:
    """(anchor_id, q, vec_id, score): for each anchor and query the ``k`` best rows of each of its pairs of blocks.

    ``anchors``: a, b, vec_id, label, x, size2, queries (array of low, high, reach); ``rows``: a, b, vec_id, label, x, size2, dealt to the pairs (a, b). Rows of the
    anchor's label (``same``; not the anchor itself) or of other labels are looked at, with scores from low to high and of at least reach.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "q", "vec_id", "score")])

    def columns(t: pa.Table) -> tuple[np.ndarray, ...]:
        ids, labels, size2 = (t.column(c).to_numpy() for c in ("vec_id", "label", "size2"))
        return ids, labels, np.frombuffer(b"".join(t.column("x").to_pylist()), "<i4").reshape(len(ids), -1), size2

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        own = buckets_of(*columns(right), same, bucket)
        ids, labels, x, size2 = columns(left)
        best = [[Best(k, *(q[n] for n in ("low", "high", "reach"))) for q in qs] for qs in left.column("queries").to_pylist()]
        sizes = np.sqrt(size2.astype(float))
        for b in own:
            for i in np.flatnonzero(labels == b.labels[0]) if same else range(len(ids)):
                q, size = x[i], float(sizes[i])
                found = b.candidates(q, size, min(s.reach for s in best[i]), focus)
                if found is not None and not len(found):
                    continue
                scores = b.scores(q, size, found)
                rows_at, their = (b.ids, b.labels) if found is None else (b.ids[found], b.labels[found])
                use = rows_at != ids[i] if same else their != labels[i]
                scores, rows_at = scores[use], rows_at[use]
                for s in best[i]:
                    s.add(scores, rows_at)
        made = [(np.full(len(s.ids), ids[i]), np.full(len(s.ids), j), s.ids, s.scores) for i, of in enumerate(best) for j, s in enumerate(of) if len(s.ids)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*made)], schema=schema) if made else schema.empty_table()

    return anchors.groupBy("a", "b").cogroup(rows.groupBy("a", "b")).applyInArrow(run, "anchor_id long, q long, vec_id long, score long")


def dealt(blocks: DataFrame, pairs: DataFrame, by: str, more: list[str] = ()) -> DataFrame:
    """The rows of blocks, once for each pair of their block."""
    return blocks.join(pairs.select("a", "b"), by).select("a", "b", "vec_id", "label", "x", "size2", *more)


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of each group with their rank: each pair of blocks gives at most ``k``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _two_waves(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, same: bool, bucket: int, focus: int, name: str) -> DataFrame:
    """(anchor_id, q, vec_id, score, rank) over all ``pairs`` (a, b, longest2, lead); those that lead set the scores to reach in the others."""
    pairs = stage_table(pairs, f"{name}-pairs")
    lead = pairs.filter("lead")
    started = stage_table(search(dealt(anchors, lead, "a", ["queries"]), dealt(rows, lead, "b"), k, same, bucket, focus), f"{name}-lead")
    reached = best_of(started, ["anchor_id", "q"], k).groupBy("anchor_id", "q").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    known = reached.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("q", "least"))).alias("least"))  # a number for each query
    raised = F.transform("queries", lambda q, j: F.struct(q["low"].alias("low"), q["high"].alias("high"), F.greatest(q["reach"], q["low"], F.try_element_at("least", j.cast("long"))).alias("reach")))
    later = stage_table(anchors.join(known, "vec_id", "left").withColumn("queries", raised).drop("least"), f"{name}-reach")
    # What an anchor block needs at least of a row's length, before any row is moved.
    least = F.array_min(F.transform("queries", lambda q: q["reach"]))
    need = later.groupBy("a").agg(F.min(F.when(least > 0, F.try_divide(least, F.sqrt(F.col("size2").cast("double")))).otherwise(0.0)).alias("need"))
    rest = pairs.filter("not lead").join(need, "a").filter(F.col("need") <= F.sqrt(F.col("longest2").cast("double")) * (1 + SLACK))
    rest = stage_table(rest.select("a", "b", "longest2"), f"{name}-rest")
    top = F.sqrt(F.col("size2").cast("double")) * F.sqrt(F.col("longest2").cast("double")) * (1 + SLACK)
    met = later.join(rest, "a").filter(F.exists("queries", lambda q: (q["reach"] <= 0) | (q["reach"] <= top)))
    found = search(met.select("a", "b", "vec_id", "label", "x", "size2", "queries"), dealt(rows, rest, "b"), k, same, bucket, focus)
    return best_of(started.unionByName(found), ["anchor_id", "q"], k)


def mine(df: DataFrame, label: Column, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 10, low_pct: int = 30, high_pct: int = 90, scale: int = 256, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK, bucket: int = BUCKET, focus: int = FOCUS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Components become floor(scale * c), a row's score is its inner product with the anchor, higher scores come first and ties go by smaller id. Positives are the
    first ``positives`` other rows of the anchor's label; negatives the first ``negatives`` rows of other labels whose score is from low_pct to
    high_pct % of the positive's (none for a negative positive score, as that range is empty). Rows without an id or a label, or with a vector that is null or has a null
    or non-finite entry, take no part; vectors shorter than the longest count as followed by zeros; rows that share an id count as one, that with the
    least label, then the least bytes of its little-endian integers. An empty table, or one without anchors, gives none. Scores must fit longs. Other columns are not read.
    """
    rows = integer_rows(df, id_col, vec_col, label, anchor, scale)
    by_label = in_blocks(rows, [F.col("label"), F.desc("size2"), F.col("vec_id")], row_block, "b", "lemp-by-label")
    asking = in_blocks(by_label.filter("is_anchor").drop("b", "is_anchor"), [F.col("label"), F.col("vec_id")], anchor_block, "a", "lemp-anchors")
    every = F.array(F.struct(F.lit(-_ANY).alias("low"), F.lit(_ANY).alias("high"), F.lit(-_ANY).alias("reach")))
    parts = by_label.groupBy("b", "label").agg(F.max("size2").alias("longest2")).withColumn("lead", F.col("b") == F.min("b").over(Window.partitionBy("label")))
    pairs = parts.join(asking.select("a", "label").distinct(), "label").groupBy("a", "b").agg(F.max("longest2").alias("longest2"), F.bool_or("lead").alias("lead"))
    near = _two_waves(asking.withColumn("queries", every), by_label, pairs, positives, True, bucket, focus, "lemp-positives").drop("q")
    near = stage_table(near, "lemp-near")
    by_size = in_blocks(by_label.drop("b", "is_anchor"), [F.desc("size2"), F.col("vec_id")], row_block, "b", "lemp-by-size")
    wanted = near.alias("near").filter("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("near.vec_id").alias("id"), "score"))).alias("positives"))  # ``positives`` at most
    hundred = F.lit(100).cast("long")
    # The share of the hundreds and that of the rest, so that a large score doesn't overflow.
    percent = lambda x, p, up: p * F.call_function("div", x, hundred) + F.call_function("div", p * (x % hundred) + up, hundred)
    bounds = F.transform("positives", lambda p: F.struct(percent(p["score"], low_pct, 99).alias("low"), percent(p["score"], high_pct, 0).alias("high"), F.lit(-_ANY).alias("reach")))
    anchors = stage_table(asking.join(wanted, "vec_id").withColumn("queries", bounds), "lemp-queries")
    asked = anchors.agg(F.collect_set("a").alias("all"))  # one row: a number for each anchor block
    blocks = by_size.groupBy("b").agg(F.max("size2").alias("longest2"))
    pairs = blocks.join(F.broadcast(asked)).select("b", "longest2", F.explode("all").alias("a")).withColumn("lead", F.col("b") == F.min("b").over(Window.partitionBy("a")))
    far = _two_waves(anchors.drop("positives"), by_size, pairs, negatives, False, bucket, focus, "lemp-negatives")
    named = far.join(anchors.select(F.col("vec_id").alias("anchor_id"), "positives"), "anchor_id").withColumn("p", F.element_at("positives", (F.col("q") + 1).cast("int")))
    return named.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
