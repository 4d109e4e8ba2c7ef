"""Rows by their place: the order of the files' names, then the order in a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_positions(rows: DataFrame, out: str = "pos") -> DataFrame:
    """Add each row's place from 0 to rows that are read from files (nothing but projections and filters in between).

    A scan reads the blocks of files in any order on any task, so rows are numbered in their block; blocks follow each other by file name and
    start, and the counts of rows of each block, one row a block, give the offsets. A block is what one task reads at once, and no window is larger.
    """
    # The block of a row is known where the row is read, and the running number grows along a block.
    keyed = rows.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    spans = keyed.groupBy("__f", "__b").agg(F.count("*").alias("__n"))
    files = spans.groupBy("__f").agg(F.sum("__n").alias("__all"))
    before = lambda w, n: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    files = files.withColumn("__base", before(Window.orderBy("__f"), "__all"))  # a row for each file
    base = spans.join(files, "__f").select("__f", "__b", (F.col("__base") + before(Window.partitionBy("__f").orderBy("__b"), "__n")).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__f", "__b").orderBy("__m")) - 1
    return keyed.withColumn("__r", place).join(base, ["__f", "__b"]).withColumn(out, F.col("__base") + F.col("__r")).drop("__f", "__b", "__m", "__r", "__base")


def match_report(built: DataFrame, release: DataFrame, fields: list[str], pos: str = "pos") -> DataFrame:
    """One row: n_release, n_built, for each field the number of places where both tables have it and agree (null agrees with null), and the first place where any differs or one table has no row."""
    a, b = (t.select(pos, F.struct(*fields).alias(n)) for t, n in ((built, "__a"), (release, "__b")))
    joined = a.join(b, pos, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    same = {f: both & F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")) for f in fields}
    whole = both
    for c in same.values():
        whole = whole & c
    return joined.agg(F.count("__b").alias("n_release"), F.count("__a").alias("n_built"), *[F.count_if(c).alias(f) for f, c in same.items()], F.min(F.when(~whole, F.col(pos))).alias("first_difference"))


def aligned(rows: DataFrame, labels: DataFrame, check: list[str], pos: str = "pos") -> DataFrame:
    """``rows`` with the columns of ``labels`` at the same place; an error unless both have as many rows and agree on the columns ``check``."""
    more = [c for c in labels.columns if c not in (pos, *check)]
    joined = rows.withColumn("__l", F.lit(1)).join(labels.select(pos, *more, F.lit(1).alias("__r"), *[F.col(c).alias(f"__{c}") for c in check]), pos, "full_outer")
    bad = F.col("__l").isNull() | F.col("__r").isNull()
    for c in check:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    error = F.raise_error(F.concat(F.lit("not aligned at place "), F.col(pos).cast("string"))).cast("int")
    return joined.withColumn("__l", F.when(bad, error).otherwise(F.col("__l"))).filter("__l = 1").select(*rows.columns, *more)
