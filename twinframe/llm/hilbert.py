"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to ``bits`` each and become one index on a Hilbert curve, so rows that are near on the curve
are near in every column. Rows are sorted by index and the order is cut into runs of equal counts; each shard then covers a small
box of the metadata and can be skipped by minimum and maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage_table


def _at_most(value: Column):
    return lambda b: b <= value


def quantise(df: DataFrame, dims: list[str], bits: int, accuracy: int = 1000) -> list[Column]:
    """A cell from 0 to 2^bits - 1 for each column: numbers by quantile, anything else by hash, null in cell 0."""
    top = 1 << bits
    numbers = [d for d in dims if isinstance(df.schema[d].dataType, T.NumericType)]
    cuts = {}
    if numbers:
        points = F.array(*[F.lit(i / top) for i in range(1, top)])
        row = df.agg(*[F.percentile_approx(F.col(d).cast("double"), points, accuracy).alias(d) for d in numbers]).first()  # 2^bits numbers each
        cuts = {d: sorted(set(row[d] or [])) for d in numbers}
    out = []
    for d in dims:
        if d in cuts:
            bounds = F.array(*map(F.lit, cuts[d])).cast("array<double>")
            value = F.col(d).cast("double")
            cell = F.size(F.filter(bounds, _at_most(value)))
        else:
            cell = F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(top))
        out.append(F.when(F.col(d).isNull(), 0).otherwise(cell).cast("long"))
    return out


def with_hilbert_index(df: DataFrame, cells: list[Column], bits: int, out: str = "hilbert") -> DataFrame:
    """``df`` with the position on the curve of a point with one ``bits``-bit coordinate for each dimension.

    The published transpose algorithm, one projection for each step so that no expression is written out twice: undo the excess work of
    each bit from the top down, Gray-encode, then interleave.
    """
    n = len(cells)
    x = [f"__x{i}" for i in range(n)]
    made = df.withColumns(dict(zip(x, cells)))
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            first, own = F.col(x[0]), F.col(x[i])
            up, swap = own.bitwiseAND(F.lit(q)) != 0, first.bitwiseXOR(own).bitwiseAND(F.lit(q - 1))
            step = {x[0]: F.when(up, first.bitwiseXOR(F.lit(q - 1))).otherwise(first.bitwiseXOR(swap))}
            if i:
                step[x[i]] = F.when(up, own).otherwise(own.bitwiseXOR(swap))
            made = made.withColumns(step)
    for i in range(1, n):
        made = made.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0).cast("long")
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)).cast("long"))
    made = made.withColumn("__turn", turn)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col("__turn")), b).bitwiseAND(F.lit(1).cast("long"))
            index = index * 2 + bit
    return made.withColumn(out, index).drop(*x, "__turn")


def assign_shards(df: DataFrame, dims: list[str], ties: list[str], n_shards: int, bits: int = 5, ranges: int | None = None) -> DataFrame:
    """``df`` with hilbert (long), shard (0 .. n_shards - 1) and slot (gapless from 0 in each shard). Law *rows*: counts differ by one at most.

    Rows are range-partitioned by (index, ``ties``), written with their partition, and ranked inside it; the few partition counts give
    the offsets. ``ties`` should end in a unique column; rows that repeat wholly are told apart by nothing and may swap slots. Nulls
    sort first. Input columns named like an output are replaced. An empty table gives none.
    """
    made = ("hilbert", "shard", "slot")
    rows = stage_table(df.drop(*made), "hilbert-input")  # is read for the quantiles and for the index
    rows = stage_table(with_hilbert_index(rows, quantise(rows, dims, bits), bits), "hilbert-index")  # is read to sample the ranges and to deal
    order = [F.col("hilbert"), *[F.col(t) for t in ties]]
    spread = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    spread = stage_table(spread.withColumn("__part", F.spark_partition_id()), "hilbert-rows")
    counts = stage_table(spread.groupBy("__part").agg(F.count("*").alias("__n")), "hilbert-counts")  # one row a partition
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    base = counts.withColumn("__base", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    rank = F.col("__base") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    ranked = spread.join(base, "__part").withColumn("__rank", rank)
    shard = F.expr(f"cast(__rank * {n_shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("__rank") - first).select(*rows.columns, "shard", "slot")
