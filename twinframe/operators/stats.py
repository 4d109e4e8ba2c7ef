"""Paired and clustered statistics on DataFrames.

Resampling works on collapsed units (clusters, or rows dealt to a bounded number of units), never on rows, with weights from hashes
(``replicates``), so intervals repeat on any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .replicates import replicates_of

def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ``|``."""
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def bootstrap_ratio(units: DataFrame, group: list[str], unit: str, top: str, bottom: str, replicates: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of sum(top) / sum(bottom) over resampled units (one row each)."""
    stats = replicates_of(units, group, unit, top, bottom, replicates, seed)
    point = units.groupBy(*group).agg(F.count("*").alias("n_units"), F.round(F.try_divide(F.sum(top), F.sum(bottom)), 6).alias("estimate"))
    bounds = stats.groupBy(*group).agg(*[F.round(F.percentile("s", F.lit(q)), 6).alias(n) for n, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))])
    return point.join(bounds, group) if group else point.crossJoin(bounds)


def numpy_interval(df: DataFrame, group: list[str], value: Column, order: list[str], replicates: int = 2000, seed: int = 0, alpha: float = 0.05, scale: float = 100.0, most: int | None = None) -> DataFrame:
    """(group, n, estimate, ci_low, ci_high): the percentile interval of a mean as numpy draws it, for comparison with published tables.

    The values of a group, times ``scale``, stand in the order of ``order`` (which has to tell rows apart), and a replicate takes the next n numbers of ``numpy.random.default_rng(seed)``
    .integers(0, n). As the generator is one stream, a group is drawn in one task: Spark sorts its rows, and only its values, 8 bytes each, are held, beside the draws of a block of
    replicates of some 8 MB (one replicate, if that is more). A group of over ``most`` rows is an error, if given. Null values take no part; a group without any gives no row.
    """
    rows = df.select(*group, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], value.cast("double").alias("__v")).filter("__v is not null")
    kinds = ", ".join([*[f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group], "n long, estimate double, ci_low double, ci_high double"])
    width = len(group)

    def interval(x: np.ndarray) -> tuple[int, float, float, float]:
        rng, n = np.random.default_rng(seed), len(x)
        block = max(1, 1_000_000 // n)
        means = np.concatenate([x[rng.integers(0, n, size=(min(block, replicates - at), n))].mean(axis=1) for at in range(0, replicates, block)])
        low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return n, x.mean(), low, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, fields = None, [], []

        def done() -> pa.RecordBatch:
            columns = [pa.array([v], f.type) for v, f in zip(key, fields)] + [pa.array([v]) for v in interval(np.concatenate(held) * scale)]
            return pa.RecordBatch.from_arrays(columns, names=[*group, "n", "estimate", "ci_low", "ci_high"])

        for batch in batches:
            fields = list(batch.schema)[:width]
            change = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in batch.columns[:width]:
                code = np.asarray(c.dictionary_encode(null_encoding="encode").indices)
                change |= code[1:] != code[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges, edges[1:]):
                own = tuple(c[lo].as_py() for c in batch.columns[:width])
                if held and own != key:
                    yield done()
                    held = []
                key = own
                held.append(np.array(batch.column(width).slice(lo, hi - lo)))
                if most is not None and sum(map(len, held)) > most:
                    raise ValueError(f"a group of over {most} rows: use mean_interval")
        if held:
            yield done()

    met = rows.repartition(*group) if group else rows.repartition(1)
    ordered = met.sortWithinPartitions(*group, *[F.col(f"__o{i}").asc_nulls_last() for i in range(len(order))])
    return ordered.select(*group, "__v").mapInArrow(run, kinds)


def dealt_unit(keys: list[str], units: int = 500) -> Column:
    """The unit of a row, by the hash of ``keys``."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint"), F.lit(units))


def dealt_sums(df: DataFrame, group: list[str], value: Column, keys: list[str], units: int = 500) -> DataFrame:
    """(group, unit, total, n): rows with a value dealt by the hash of ``keys`` to at most ``units`` units of each group."""
    rows = df.withColumns({"__v": value.cast("double"), "__u": dealt_unit(keys, units)})
    return rows.groupBy(*group, F.col("__u").alias("unit")).agg(F.sum("__v").alias("total"), F.count("__v").alias("n")).filter("n > 0")


def mean_interval(sums: DataFrame, group: list[str], scale: float = 1.0, lo: str = "ci_low", hi: str = "ci_high", **options) -> DataFrame:
    """(group, lo, hi): interval of the mean from ``dealt_sums`` (or sums of them), times ``scale``."""
    scaled = sums.withColumn("total", F.col("total") * scale)
    return bootstrap_ratio(scaled, group, "unit", "total", "n", **options).select(*group, F.col("lo").alias(lo), F.col("hi").alias(hi))


def bootstrap_p(stats: DataFrame, group: list[str], replicates: int) -> DataFrame:
    """Two-sided p of a zero statistic from ``replicates_of``: twice the lesser tail, 1 / replicates at least and 1 at most."""
    tails = F.least(F.avg((F.col("s") <= 0).cast("double")), F.avg((F.col("s") >= 0).cast("double")))
    return stats.groupBy(*group).agg(F.round(F.least(F.lit(1.0), F.greatest(2 * tails, F.lit(1.0 / replicates))), 6).alias("p"))


def cluster_sums(df: DataFrame, group: list[str], cluster: str, value: Column) -> DataFrame:
    """(group, cluster, total, n): what resampling needs of each cluster."""
    return df.groupBy(*group, cluster).agg(F.sum(value.cast("double")).alias("total"), F.count(value).cast("double").alias("n"))


def bootstrap_cluster_mean(df: DataFrame, group: list[str], cluster: str, value: Column, **options) -> DataFrame:
    """Interval of the mean of cluster means."""
    means = cluster_sums(df, group, cluster, value).withColumn("mean", F.col("total") / F.col("n")).withColumn("one", F.lit(1.0))
    return bootstrap_ratio(means, group, cluster, "mean", "one", **options)


def bootstrap_cluster_ratio(df: DataFrame, group: list[str], cluster: str, value: Column, **options) -> DataFrame:
    """Interval of the ratio of sums, clusters resampled."""
    return bootstrap_ratio(cluster_sums(df, group, cluster, value), group, cluster, "total", "n", **options)


def paired_difference(a: Column, b: Column) -> list[Column]:
    """Accuracy loss a - b in points and its standard error from the joint counts."""
    pa, pb, pab, n = F.avg(a.cast("double")), F.avg(b.cast("double")), F.avg((a * b).cast("double")), F.count("*")
    variance = (pa * (1 - pa) + pb * (1 - pb) - 2 * (pab - pa * pb)) / n
    return [n.alias("n"), F.round(100 * pa, 6).alias("acc_a"), F.round(100 * pb, 6).alias("acc_b"), F.round(100 * (pa - pb), 6).alias("drop_pp"), F.round(100 * F.sqrt(F.greatest(variance, F.lit(0.0))), 6).alias("se_pp")]


def _integral(density, start: Column, nodes: int = 64) -> Column:
    """The integral of ``density`` over [start / (1 - start), infinity) by Gauss-Legendre nodes in s = x / (1 + x)."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    points = F.array(*[F.struct(F.lit(float((a + 1) / 2)).alias("x"), F.lit(float(c / 2)).alias("w")) for a, c in zip(x, w)])

    def term(total: Column, node: Column) -> Column:
        s = start + (1 - start) * node["x"]
        return total + node["w"] * density(s / (1 - s)) / ((1 - s) * (1 - s))

    return (1 - start) * F.aggregate(points, F.lit(0.0), term)


def _t_density(df: Column):
    return lambda x: F.exp(-(df + 1) / 2 * F.log1p(x * x / df))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null without degrees of freedom."""
    t, df = F.abs(t.cast("double")), df.cast("double")
    p = _integral(_t_density(df), t / (1 + t)) / _integral(_t_density(df), F.lit(0.0))
    return F.when((df > 0) & t.isNotNull(), F.least(F.lit(1.0), p))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal value."""
    z = F.abs(z.cast("double"))
    return F.least(F.lit(1.0), _integral(lambda x: F.exp(-x * x / 2), z / (1 + z)) / math.sqrt(math.pi / 2))


def t_quantile(df: Column, alpha: float = 0.05, steps: int = 50) -> Column:
    """The t with a two-sided tail of ``alpha``, by bisection in t / (1 + t)."""
    df = df.cast("double")
    whole = _integral(_t_density(df), F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = (at["lo"] + at["hi"]) / 2
        over = _integral(_t_density(df), middle) > alpha * whole
        return F.struct(F.when(over, middle).otherwise(at["lo"]).alias("lo"), F.when(over, at["hi"]).otherwise(middle).alias("hi"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda at: (at["lo"] + at["hi"]) / 2)
    return F.when(df > 0, s / (1 - s))


def one_sample_t(x: Column) -> list[Column]:
    """n, mean, sd, sem of a value, its two-sided p against 0 and the 95 % interval of the mean; undefined parts are null."""
    n, mean, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    sem = sd / F.sqrt(n)
    half = t_quantile(n - 1) * sem
    p = F.when(sem > 0, t_tail(F.try_divide(mean, sem), n - 1))
    return [n.alias("n"), *[F.round(c, 6).alias(k) for k, c in (("mean", mean), ("sd", sd), ("sem", sem), ("p", p), ("ci_low", mean - half), ("ci_high", mean + half))]]


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of 1 or more: Stirling's series, moved up by seven."""
    y = x.cast("double") + 7
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) + 1 / (1188 * F.pow(y, F.lit(9)))
    return series - reduce(lambda a, b: a + b, [F.log(x.cast("double") + i) for i in range(7)])


def mcnemar(b01: Column, b10: Column) -> Column:
    """Two-sided exact p of discordant counts.

    The binomial tail is summed from its largest term down by a recurrence. Beyond 12 sqrt(n) + 60 terms what is left is below 1e-100 of the sum,
    so the work grows with the root of the counts.
    """
    n, k = (b01 + b10).cast("long"), F.least(b01, b10).cast("long")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + n * math.log(0.5))
    terms = F.least(k, F.ceil(12 * F.sqrt(n)) + 60).cast("long")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] * (k - i + 1) / (n - k + i)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    tail = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<long>")), start, step, lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(2 * first * tail, F.lit(1.0)))


def rounded(p: Column, digits: int = 6) -> Column:
    """Rounded so that ties, which the p of an exact test often is, go up whatever its last bits are."""
    return F.round(p + 1e-10, digits)


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> tuple[Column, Column]:
    """Percent agreement and Cohen's kappa (null where chance agreement is 1) of a 2 x 2 table."""
    n = (n11 + n10 + n01 + n00).cast("double")
    seen = (n11 + n00) / n
    chance = ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)).cast("double") / (n * n)
    return F.round(100 * seen, 6), F.round(F.when(chance < 1, (seen - chance) / (1 - chance)), 6)


def bucketed(df: DataFrame, by: list[str], value: str, buckets: int = 64, out: str = "__b", keys: list[str] = ()) -> DataFrame:
    """Add the bucket (from 0, in order) of a number within ``by``, null values in one behind all others: edges are quantiles of drawn rows, so buckets are even however skewed the values.

    Edges come from the row with the least hash of ``keys`` (columns that tell rows apart, else the value) in each of 32 slots a bucket, so they hang on the rows alone. Those of
    ``percentile_approx`` hang on the order in which tasks' parts are merged, and a plan that makes them twice may get two sets. Rows with equal values share a bucket.
    """
    lead, key = F.col(value).cast("double"), F.xxhash64(*(keys or [value]))
    drawn = df.filter(lead.isNotNull()).groupBy(*by, F.pmod(key, F.lit(32 * buckets)).alias("__slot")).agg(F.min_by(lead, key).alias("__v"))
    points = drawn.groupBy(*by).agg(F.sort_array(F.collect_list("__v")).alias("__points"))  # 32 x buckets numbers at most
    place = lambda i: F.greatest(F.lit(1), F.ceil(F.size("__points") * i / buckets)).cast("int")
    edges = points.select(*by, F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.try_element_at("__points", place(i))).alias("__edges"))
    joined = df.join(edges, by, "left") if by else df.crossJoin(F.broadcast(edges))  # one row
    # Binary search: which of the sorted edges is the first not below the value.
    steps = F.sequence(F.lit(1), F.lit(buckets.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.size("__edges").alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.try_element_at("__edges", middle + 1) < lead
        return F.struct(F.when((at["lo"] < at["hi"]) & below, middle + 1).otherwise(at["lo"]).alias("lo"), F.when((at["lo"] < at["hi"]) & ~below, middle).otherwise(at["hi"]).alias("hi"))

    return joined.withColumn(out, F.when(lead.isNull(), buckets).otherwise(F.aggregate(steps, start, halve, lambda at: at["lo"]))).drop("__edges")


def numbered(df: DataFrame, by: list[str], order: list[str], weight: str | None = None, out: str = "last", buckets: int = 64, bucket: str | None = None) -> DataFrame:
    """Add to each row the running sum of ``weight`` (1 without one) in the order of ``order`` (nulls last, as in SQL) within ``by``, and the sum of all as ``out``_all.

    The first order column is a number. Rows are bucketed by its quantiles, so no task sorts a whole group unless a third of its rows are
    one value; sums of at most ``buckets`` buckets a group, and of its nulls, give the offsets. ``bucket``: keep the bucket's number under this name.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    cut = bucketed(df, by, order[0], buckets, keys=order).withColumn("__w", w)
    sums = cut.groupBy(*by, "__b").agg(F.sum("__w").alias("__s"))
    own = Window.partitionBy(*by)
    base = sums.select(*by, "__b", (F.sum("__s").over(own.orderBy("__b")) - F.col("__s")).alias("__base"), F.sum("__s").over(own).alias(f"{out}_all"))
    inside = Window.partitionBy(*by, "__b").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = cut.join(base, [*by, "__b"]).withColumn(out, F.col("__base") + F.sum("__w").over(inside)).drop("__w", "__base")
    return made.withColumnRenamed("__b", bucket) if bucket else made.drop("__b")


def value_ranks(df: DataFrame, by: list[str], value: str, count: str | None = None) -> DataFrame:
    """(by, value, __c: rows with it, rank: their average rank, __n: rows of the group), from the counts of distinct values."""
    counts = df.groupBy(*by, value).agg((F.sum(count) if count else F.count("*")).alias("__c"))
    run = numbered(counts, by, [value], "__c", "__last")
    return run.select(*by, value, "__c", (F.col("__last") - (F.col("__c") - 1) / 2).alias("rank"), F.col("__last_all").alias("__n"))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation and its two-sided p; null where a side is constant (p also below three rows). Works on counts of (x, y) cells."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, x, y).agg(F.count("*").alias("__k"))
    for v, name in ((x, "__x"), (y, "__y")):
        ranks = value_ranks(cells, group, v, "__k")
        cells = cells.join(ranks.select(*group, v, (F.col("rank") - (F.col("__n") + 1) / 2).alias(name)), [*group, v])
    k = F.col("__k")
    sxy, sxx, syy = (F.sum(k * F.col(a) * F.col(b)) for a, b in (("__x", "__y"), ("__x", "__x"), ("__y", "__y")))
    made = cells.groupBy(*group).agg(F.sum(k).alias("n"), F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("rho"))
    # A step of its own: in one select a lambda would take the rounded alias for the column.
    tested = made.withColumn("p", F.round(correlation_p(F.col("rho"), F.col("n")), 6))
    return tested.withColumn("rho", F.round("rho", 6))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by t with n - 2 degrees of freedom; 0 for a perfect one, null below three rows."""
    t = F.abs(r) * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))
    return F.when(n > 2, F.when(F.abs(r) >= 1, 0.0).otherwise(t_tail(t, n - 2)))


def ols(y: Column, x: Column) -> list[Column]:
    """Slope, intercept, r, r squared, the slope's standard error and two-sided p."""
    n, r = F.regr_count(y, x), F.corr(y, x)
    rest = (F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)) / (n - 2)
    return [n.alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(r, 6).alias("r"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.sqrt(rest / F.regr_sxx(y, x)), 6).alias("stderr"), F.round(correlation_p(r, n), 6).alias("p")]


def welch(x: Column, first: Column) -> list[Column]:
    """t, Satterthwaite degrees of freedom, two-sided p and the p of a lesser first mean, ``first`` marking the one group and its negation the other."""
    side = [(F.avg(F.when(c, x)), F.var_samp(F.when(c, x)) / F.count(F.when(c, x)), F.count(F.when(c, x))) for c in (first, ~first)]
    (ma, va, na), (mb, vb, nb) = side
    t = F.try_divide(ma - mb, F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), F.try_divide(va * va, na - 1) + F.try_divide(vb * vb, nb - 1))
    p = t_tail(t, df)
    return [F.round(c, 6).alias(k) for k, c in (("t", t), ("df", df), ("p", p), ("p_less", F.when(t < 0, p / 2).otherwise(1 - p / 2)))]


def benjamini_hochberg(df: DataFrame, p: str, order: list[str] = (), by: list[str] = (), out: str = "q") -> DataFrame:
    """False-discovery q-values within ``by``; null p-values take no part and get null. Ties share a q, so ``order`` has no effect.

    Only distinct p-values are ordered, in buckets: the least p n / rank from a bucket on is carried over its lesser buckets.
    """
    by = list(by)
    run = numbered(df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__c")), by, [p], "__c", "__r", 256, "__k")
    cut = run.withColumn("__v", F.col(p) * F.col("__r_all") / F.col("__r"))
    later = Window.partitionBy(*by).orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*by, "__k").agg(F.min("__v").alias("__m")).select(*by, "__k", F.min("__m").over(later).alias("__m"))
    inside = Window.partitionBy(*by, "__k").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.min("__v").over(inside), F.coalesce("__m", F.lit(1.0)), F.lit(1.0))
    done = cut.join(carried, [*by, "__k"]).select(*by, p, F.greatest(q, F.lit(0.0)).alias(out))
    return df.join(done, [*by, p], "left").select(*df.columns, out)


def signed_rank_p(n: Column, w: Column, ties: Column) -> Column:
    """Two-sided p of the lesser rank sum ``w`` of ``n`` differences; ``ties``: the sum of t^3 - t over tied groups.

    Up to 50 differences without ties by counting all signs, else by the normal law with its variance corrected for ties.
    """
    real = n.cast("double")  # n^3 goes over an int from 1,024 differences on, over a long from 1.7 million
    mean = real * (real + 1) / 4
    sd = F.sqrt((real * (real + 1) * (2 * real + 1) - ties / 2) / 24)
    size = F.least(n, F.lit(50)).cast("int")

    def with_rank(counts: Column, i: Column) -> Column:  # the rank i is positive or not
        return F.transform(counts, lambda c, j: c + F.when(j >= i, F.element_at(counts, F.greatest(j - i, F.lit(0)) + 1)).otherwise(0.0))

    none = F.transform(F.sequence(F.lit(0), (size * (size + 1) / 2).cast("int")), lambda j: F.when(j == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), size), none, with_rank)
    under = F.aggregate(F.slice(ways, 1, F.least(F.floor(w), F.lit(1275)).cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    exact = F.least(F.lit(1.0), 2 * under / F.pow(F.lit(2.0), size))
    return F.when(n == 0, 1.0).when((n <= 50) & (ties == 0), exact).otherwise(normal_tail(F.try_divide(w - mean, sd)))


def wilcoxon(df: DataFrame, group: list[str], difference: str) -> DataFrame:
    """Signed-rank sums without zeros, the lesser one ``w`` and its two-sided p; a group without any nonzero difference has p = 1."""
    known = df.filter(F.col(difference).isNotNull()).groupBy(*group, difference).agg(F.count("*").alias("__k"))
    left = known.filter(F.col(difference) != 0).withColumn("__a", F.abs(difference))
    ranked = left.join(value_ranks(left, group, "__a", "__k").drop("__n"), [*group, "__a"])
    k, up = F.col("__k"), F.col(difference) > 0
    plus, minus = (F.coalesce(F.sum(F.when(c, k * F.col("rank"))), F.lit(0.0)) for c in (up, ~up))
    # The values d and -d share a tie of __c rows: each carries its part of t^3 - t.
    ties = F.sum(k / F.col("__c") * (F.pow("__c", F.lit(3)) - F.col("__c")))
    sums = ranked.groupBy(*group).agg(F.sum(k).alias("n_nonzero"), plus.alias("w_plus"), minus.alias("w_minus"), ties.alias("ties"))
    every = known.select(*group).distinct().join(sums, group, "left").fillna(0)
    every = every.withColumn("w", F.least("w_plus", "w_minus"))
    tested = every.withColumn("p", F.round(signed_rank_p(F.col("n_nonzero"), F.col("w"), F.col("ties")), 6)).drop("ties")
    return tested.withColumns({c: F.round(c, 6) for c in ("w_plus", "w_minus", "w")})


def rank_bins(df: DataFrame, by: list[str], order: list[str], bins: int = 5, out: str = "bin") -> DataFrame:
    """Bins of equal width in the rank (not in the count): the edges are quantiles of the ranks themselves. The first of ``order`` is a number."""
    run = numbered(df, by, order, None, "__r")
    return run.withColumn(out, F.greatest(F.lit(1), F.expr(f"((__r - 1) * {bins} + (__r_all - 2)) div greatest(__r_all - 1, 1)")).cast("int")).drop("__r", "__r_all")


def set_stability(sets: DataFrame, published: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Of the sets ``s`` of a few runs a group: sizes, pairwise Jaccard (null with one run), members in all and in any run, members in two runs or
    more that are published too (null with one run), and each run's Jaccard with the published set ``p``."""
    a, b = sets.alias("a"), sets.alias("b")
    met = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    pairs = a.join(b, reduce(lambda x, y: x & y, met) & (F.col(f"a.{run}") < F.col(f"b.{run}")))
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    spread = lambda x, n: [F.round(f(x), 6).alias(f"{n}_{m}") for m, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    overlap = pairs.select(*[f"a.{k}" for k in keys], share(F.col("a.s"), F.col("b.s")).alias("j")).groupBy(*keys).agg(*spread("j", "jaccard"))
    known = sets.join(published, keys, "left").withColumn("p", F.coalesce("p", F.expr("slice(s, 1, 0)")))
    size = F.size("s")
    table = known.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.round(F.avg(size), 6).alias("heads_mean"), F.min(size).cast("long").alias("heads_min"), F.max(size).cast("long").alias("heads_max"), F.max(F.size("p")).cast("long").alias("n_published"), *spread(share(F.col("s"), F.col("p")), "published"))
    hits = known.select(*keys, "p", F.explode("s").alias("x")).groupBy(*keys, "x").agg(F.count("*").alias("hits"), F.bool_or(F.array_contains("p", F.col("x"))).alias("published"))
    counted = hits.join(table.select(*keys, "n_runs"), keys).groupBy(*keys).agg(
        F.count_if(F.col("hits") == F.col("n_runs")).alias("n_all_runs"), F.count("*").alias("n_union"), F.when(F.max("n_runs") > 1, F.count_if((F.col("hits") >= 2) & F.col("published"))).alias("n_recovered")
    )
    return table.join(counted, keys).join(overlap, keys, "left")
