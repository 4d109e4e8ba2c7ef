"""From long records to pairs: reshaping, checked joins, resume and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["source_dataset", "item_id", "model", "distractor_type"]


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def pair_pivot(df: DataFrame, keys: list[str], values: list[str], by: str = "condition", sides: tuple[str, str] = ("clean", "distracted"), complete: bool = True) -> DataFrame:
    """One row a pair with ``<value>_<side>`` columns. ``complete`` keeps pairs in which both sides occur; a side's null value stays null."""
    # Conditional maxima instead of pivot(): one partial aggregation, no distinct scan, and no row order to depend on.
    cells = [F.max(F.when(F.col(by) == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in sides]
    seen = [F.max(F.when(F.col(by) == s, 1)).alias(f"__{s}") for s in sides]
    wide = df.groupBy(*keys).agg(*cells, *seen)
    if complete:
        for s in sides:
            wide = wide.filter(F.col(f"__{s}").isNotNull())
    return wide.drop(*[f"__{s}" for s in sides])


def unpivot_sides(df: DataFrame, ids: list[str], clean: str, distracted: str, value: str = "transcript") -> DataFrame:
    """One row for each pair and condition."""
    return df.unpivot(ids, [clean, distracted], "condition", value).withColumn("condition", F.when(F.col("condition") == clean, "clean").otherwise("distracted"))


def outcome(contaminated: Column | None, used: Column, misattributed: Column, recorded: Column) -> Column:
    """Exclusive outcome label, first match wins; ``contaminated`` restricts all but 'none'."""
    gate = F.lit(True) if contaminated is None else F.coalesce(contaminated, F.lit(False))
    return (
        F.when(gate & F.coalesce(misattributed, F.lit(False)), "misattributed")
        .when(gate & F.coalesce(used, F.lit(False)), "used")
        .when(gate & F.coalesce(recorded, F.lit(False)), "recorded_only")
        .otherwise("none")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def join_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys only left, only right, in both. Each side's keys are made distinct first."""
    sides = [side.select(*keys).distinct().withColumn(m, F.lit(1)) for side, m in ((left, "__l"), (right, "__r"))]
    joined = sides[0].join(sides[1], keys, "full_outer")
    return joined.agg(
        F.count_if(F.col("__r").isNull()).alias("left_only"),
        F.count_if(F.col("__l").isNull()).alias("right_only"),
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("both"),
    )


def merge_one_to_one(sides: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of tables that have each key once: a key that is twice in one of them is an error when it is met."""
    out = None
    for side in sides:
        values = [c for c in side.columns if c not in keys]
        once = side.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in values])
        twice = F.raise_error(F.concat(F.lit("a key occurs twice: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("boolean")
        checked = once.filter(F.when(F.col("__n") > 1, twice).otherwise(F.lit(True))).drop("__n")
        out = checked if out is None else out.join(checked, keys, "full_outer")
    return out


def resume(todo: DataFrame, done: DataFrame, keys: list[str], failed: Column | None = None) -> DataFrame:
    """Rows of ``todo`` whose key has no successful row in ``done``."""
    ready = done if failed is None else done.filter(~F.coalesce(failed, F.lit(False)))
    return todo.join(ready.select(*keys).distinct(), keys, "left_anti")


def fold(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert: rows of ``base`` whose key is in ``new`` are replaced, others stay, new keys are added."""
    kept = base.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def fold_counts(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many new rows replace some of ``base`` and how many are added."""
    mark = base.select(*keys).distinct().withColumn("__old", F.lit(1))
    return new.join(mark, keys, "left").agg(F.count_if(F.col("__old").isNotNull()).alias("replaced"), F.count_if(F.col("__old").isNull()).alias("added"))
