"""Rates and contrasts of pairs over grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sql_round(x: Column, digits: int = 6) -> Column:
    """Rounded as SQL does it: scaled before, so the double itself decides a tie; Spark's own looks at its shortest decimal form and takes 1.0015625 up."""
    return F.round(x * 10.0**digits) / 10.0**digits


def pct(x: Column) -> Column:
    """100 x the mean of a 0/1 column, rounded for comparison across engines."""
    return sql_round(100 * F.avg(x.cast("double")))


def contrast(clean: Column, distracted: Column) -> list[Column]:
    """Aggregates of a paired contrast; pairs with a missing side are dropped and counted."""
    both = clean.isNotNull() & distracted.isNotNull()
    return [
        F.count_if(both).alias("n_pairs"),
        F.count_if(~both).alias("n_dropped"),
        pct(F.when(both, clean)).alias("rate_clean"),
        pct(F.when(both, distracted)).alias("rate_distracted"),
        pct(F.when(both, distracted - clean)).alias("delta_pp"),
    ]


def cohort(model: Column, frontier: list[str]) -> Column:
    """The cohort of a model: API for those listed, else open-weight."""
    return F.when(model.isin(*frontier), "API").otherwise("open-weight") if frontier else F.lit("open-weight")


def strata(pairs: DataFrame, by: list[str], clean: str, distracted: str, extra: list[Column] = ()) -> DataFrame:
    """The contrast of each stratum."""
    return pairs.groupBy(*by).agg(*contrast(F.col(clean), F.col(distracted)), *extra)


def grouped(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Aggregates over grouping sets in one pass; columns outside a row's set are 'all'."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggregates, *[F.grouping(c).alias(f"__g_{c}") for c in columns])
    return out.withColumns({c: F.when(F.col(f"__g_{c}") == 1, "all").otherwise(F.col(c).cast("string")) for c in columns}).drop(*[f"__g_{c}" for c in columns])


def summary(pairs: DataFrame, stratum: list[str], sets: list[list[str]], clean: str, distracted: str) -> DataFrame:
    """Pooled contrast, unweighted mean of stratum contrasts and the signs of strata, over grouping sets."""
    pooled = grouped(pairs, sets, contrast(F.col(clean), F.col(distracted)))
    own = pairs.groupBy(*stratum).agg(F.avg((F.col(distracted) - F.col(clean)).cast("double")).alias("d"))
    means = grouped(own, sets, [sql_round(100 * F.avg("d")).alias("delta_strata"), *[F.count_if(c).alias(n) for n, c in (("n_up", F.col("d") > 0), ("n_flat", F.col("d") == 0), ("n_down", F.col("d") < 0))]])
    return pooled.join(means, list(dict.fromkeys(c for s in sets for c in s)))


def shares(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count of each value and its share of the group's total."""
    from pyspark.sql import Window

    return df.groupBy(*group, value).agg(F.count("*").alias("n")).withColumn("share", sql_round(F.col("n") / F.sum("n").over(Window.partitionBy(*group))))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order."""
    from pyspark.sql import Window

    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def long_metrics(df: DataFrame, ids: list[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """(ids, metric, clean, distracted): one row for each pair and metric."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(a).cast("double").alias("clean"), F.col(b).cast("double").alias("distracted")) for m, (a, b) in metrics.items()]))
    return df.select(*ids, cells.alias("c")).select(*ids, "c.*")
