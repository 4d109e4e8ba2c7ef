"""Operators that produce plans: splits, donors, windows, mixes, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import uniform


def hash_order(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def global_rank(df: DataFrame, order: Column, ties: str, out: str = "rank", digits: int = 3) -> DataFrame:
    """A rank from 0 over the whole table by a uniform hash in hex digits, without a single-partition window.

    Rows are bucketed by the leading ``digits`` of the hash, so buckets are even and in order; the counts of 16^digits buckets give
    the offsets.
    """
    keyed = df.withColumn("__h", order).withColumn("__b", F.conv(F.substring("__h", 1, digits), 16, 10).cast("int"))
    counts = keyed.groupBy("__b").agg(F.count("*").alias("__n"))  # 16^digits rows at most
    base = counts.withColumn("__base", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).drop("__n")
    ranked = keyed.join(F.broadcast(base), "__b").withColumn(out, F.col("__base") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", ties)) - 1)
    return ranked.drop("__h", "__b", "__base")


def locked_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """``heldout`` marks max(1, int(n x fraction)) rows chosen by hash, whatever the order of the input."""
    ranked = global_rank(df, hash_order(seed, F.col(key).cast("string")), key, "__rank")
    total = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(fraction))).alias("__k"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("heldout", F.col("__rank") < F.col("__k")).drop("__rank", "__k")  # one row


def assign_donors(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, j, donor): k distinct donors for each item, never itself: one seeded cycle, donor j is so many places ahead. O(n log n)."""
    cycle = global_rank(df.select(key), hash_order(seed, F.col(key).cast("string")), key, "__pos")
    n = df.agg(F.count("*").alias("__n"))
    asked = cycle.crossJoin(F.broadcast(n)).select(key, "__n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"), "__pos")  # one row
    asked = asked.filter(F.col("j") < F.col("__n") - 1).withColumn("__at", (F.col("__pos") + F.col("j") + 1) % F.col("__n"))
    donors = cycle.select(F.col(key).alias("donor"), F.col("__pos").alias("__at"))
    return asked.join(donors, "__at").select(key, "j", "donor")


def densest_window(units: DataFrame, by: str, score: str, lo: float, hi: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """The run of consecutive units with span in [lo, hi] and most score; ties: shorter, then earlier. Items without one are left out."""
    w = Window.partitionBy(by).orderBy(start, end)
    ranked = units.withColumn("rn", F.row_number().over(w)).withColumn("prefix", F.sum(score).over(w))
    a, b = ranked.alias("a"), ranked.alias("b")
    # A run's span is at least the distance of its starts, so the band on starts is safe and bounds the partners of a unit.
    runs = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("b.rn") >= F.col("a.rn")) & (F.col(f"b.{start}") <= F.col(f"a.{start}") + hi))
    runs = runs.select(F.col(f"a.{by}").alias(by), F.col(f"a.{start}").alias("start"), F.col("a.rn").alias("first"), F.col("b.rn").alias("last"), F.col(f"b.{end}").alias("end"), (F.col("b.prefix") - F.col("a.prefix") + F.col(f"a.{score}")).alias("score"))
    runs = runs.withColumn("end", F.max("end").over(Window.partitionBy(by, "first").orderBy("last"))).withColumn("span", F.col("end") - F.col("start"))
    best = runs.filter(F.col("span").between(lo, hi))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "span", "start"))).filter("r = 1")
    return ranked.select(by, "start", "end", "score", (F.col("last") - F.col("first") + 1).alias("n_units"))


def onset(seed: int, *keys: Column, length: Column, segment: Column, lo: float = 0.2, hi: float = 0.8) -> Column:
    """Where a segment starts: uniform between fractions of the length, moved left to fit, never below 0."""
    u = uniform(seed, *keys)
    return F.greatest(F.lit(0.0), F.least(length * (lo + (hi - lo) * u), length - segment))


def gain(foreground: Column, background: Column, level_db: Column) -> Column:
    """The factor that puts a background at a level relative to the foreground's root mean square; null for silence."""
    return F.try_divide(F.pow(F.lit(10.0), level_db / 20) * foreground, background)


def assemble_pairs(plan: DataFrame, transcripts: DataFrame, item: str, code: str, text: str, clean: str = "clean") -> tuple[DataFrame, DataFrame]:
    """Planned mixes with the clean and the mixed transcript, and the audit of the plan: how many are planned, whole and in want of either.

    ``plan`` has ``item`` and ``code``; ``transcripts`` has one row for each item and code, the code ``clean`` among them.
    """
    own = transcripts.filter(F.col(code) == clean).select(item, F.col(text).alias("clean_text"))
    mixed = transcripts.filter(F.col(code) != clean).select(item, code, F.col(text).alias("mixed_text"))
    joined = plan.join(own, item, "left").join(mixed, [item, code], "left")
    no_clean, no_mixed = F.col("clean_text").isNull(), F.col("mixed_text").isNull()
    audit = joined.agg(F.count("*").alias("planned"), F.count_if(~no_clean & ~no_mixed).alias("whole"), F.count_if(no_clean).alias("no_clean"), F.count_if(no_mixed).alias("no_mixed"))
    return joined.filter(~no_clean & ~no_mixed), audit


def assemble_transcripts(items: DataFrame, streams: list[DataFrame], item: str) -> DataFrame:
    """(item, transcript, n, seconds): the streams (item, speaker, start_s, end_s, text) as ``speaker: text`` lines in start order.

    Items that no stream has keep an empty transcript, and no seconds. All lines of an item meet in one row.
    """
    rows = streams[0]
    for more in streams[1:]:
        rows = rows.unionByName(more)
    line = F.struct("start_s", "end_s", "speaker", F.concat_ws(": ", "speaker", "text").alias("line"))
    made = rows.groupBy(item).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("n"), F.max("end_s").alias("seconds"))
    return items.join(made, item, "left").select(item, F.coalesce("transcript", F.lit("")).alias("transcript"), F.coalesce("n", F.lit(0)).alias("n"), "seconds")
