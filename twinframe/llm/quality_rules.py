"""Quality rules whose cutoffs are certified on labelled documents.

Each rule is one rate of a document with a grid of cutoffs from lenient to strict. For each stratum (here: lang) and rule, the
labelled good documents that pass the base rules are the holdout: a cutoff is certified if the exact binomial tail
P(X <= k | n, alpha / rules) of its k false rejections among n is at most delta / (rules * strata). Cutoffs of one rule are tested in
order and testing stops at the first that fails (fixed sequence), and the Bonferroni share covers rules and strata, so with
probability 1 - delta no stratum rejects more than ``alpha`` of its good documents. Of the certified cutoffs, that which rejects
most bad documents for the good ones that it costs is used; a stratum with too few labels gets none and keeps its documents.
"""

from __future__ import annotations

from itertools import chain
from math import exp, lgamma, log, log1p
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, stage_table

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_text_lines", "n_stutter")
#: Rates and their cutoffs, lenient first; a document is rejected where its rate is above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "bangs": ("n_bangs / n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "upper": ("n_upper / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "dup_lines": ("n_dup_lines / n_text_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "stutter": ("n_stutter / n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.29, 0.25, 0.2, 0.15, 0.1, 0.05)),
}


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each document: its words that lie in a window of ``window`` words found twice or more in it.

    Works on a batch at once: words become integers, and integers of 1, 2, 4, .. consecutive words are paired and renumbered, so
    equal numbers mean equal windows.
    """
    sizes = np.array([len(w) for w in words])
    out = np.zeros(len(words), np.int64)
    if not sizes.sum():
        return out
    ids = pd.factorize(np.fromiter(chain.from_iterable(words), object, int(sizes.sum())))[0].astype(np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    span = 1
    while span < window:  # numbers of windows of `span` words, by their first word
        step = min(span, window - span)
        ids = pd.factorize(ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:])[0].astype(np.int64) if len(ids) > step else ids[:0]
        span += step
    whole = doc[: len(ids)] == doc[window - 1 : window - 1 + len(ids)]
    at = np.flatnonzero(whole)
    if not len(at):
        return out
    number = pd.factorize(ids[at] * len(words) + doc[at])[0]
    at = at[np.bincount(number)[number] > 1]
    if len(at):
        edge = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        out += np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(words))
    return out


def _count(texts: pa.Array) -> list[np.ndarray]:
    raw = [t or b"" for t in as_bytes(texts)]
    made: list[list] = [[] for _ in COUNTS]
    for at in range(0, len(raw), 500):  # bounds the word lists held at once
        part = raw[at : at + 500]
        words = [t.split() for t in part]
        made[0] += map(len, words)
        made[4] += repeated_words(words).tolist()
        for t, w in zip(part, words):
            made[1].append(sum(map(len, w)) - (0 if t.isascii() else int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) == 0x80))))
            made[2].append(sum(map(t.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))))
            lines = [x for x in t.split(b"\n") if x.strip()]
            made[3].append(len(lines) - len(set(lines)))
            letters = np.frombuffer(t, np.uint8)
            made[5].append(int(np.count_nonzero((letters >= 65) & (letters <= 90))))
            made[6].append(t.count(b"!"))
            made[7].append(len(lines))
            made[8].append(sum(map(eq, w, w[1:])))
    return [np.array(x, np.int64) for x in made]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of COUNTS over whole texts. Null and empty texts have 0 everywhere; input columns of these names are replaced."""
    return append_columns(docs, [text_col], T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]), _count)


def base_failed() -> Column:
    """Too short, or more than 30 % of its words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def _rate(rule: str) -> Column:
    top, _, bottom = RULES[rule][0].split(" ")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def _bin(rule: str) -> Column:
    """How many cutoffs of the rule the document is above; cutoffs fall, so these are the last ones."""
    return sum((_rate(rule) > c).cast("int") for c in RULES[rule][1])


def calibrate(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, cutoffs map<rule, double>): the certified cutoffs in use. Strata without any are missing.

    ``counts`` has COUNTS, the id and the stratum (null: a stratum of its own). Unlabelled rows and null labels take no part; of labels that repeat an id the least counts.
    """
    known = labels.groupBy(id_col).agg(F.min("quality").cast("int").alias("quality")).filter("quality is not null")
    held = counts.filter(~base_failed()).join(known, id_col).select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "quality", *[_bin(r).alias(r) for r in RULES])
    long = held.select("stratum", "quality", F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "bin"))
    table = stage_table(long.groupBy("stratum", "rule", "bin", "quality").count(), "quality-table")
    level = delta / (len(RULES) * max(1, table.select("stratum").distinct().count()))
    share = alpha / len(RULES)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        picked = {}
        for rule, mine in rows.groupby("rule"):
            cutoffs = RULES[rule][1]
            good, bad = (np.bincount(x["bin"], x["count"], len(cutoffs) + 1) for _, x in ((1, mine[mine.quality == 1]), (0, mine[mine.quality == 0])))
            n_good, n_bad, best = int(good.sum()), max(1, int(bad.sum())), 0.0
            for j, cutoff in enumerate(cutoffs):  # above cutoff j: above at least len - j of them
                k = int(good[len(cutoffs) - j :].sum())
                if not n_good or binomial_tail(k, n_good, share) > level:
                    break
                gain = bad[len(cutoffs) - j :].sum() / n_bad - 4 * k / n_good
                if gain > best:
                    best, picked[rule] = gain, cutoff
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "cutoffs": [picked]})[: len(picked)]

    return stage_table(table.groupBy("stratum").applyInPandas(choose, "stratum string, cutoffs map<string,double>"), "quality-cutoffs")


def judge(counts: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add base_failed and kept to rows with COUNTS; ``kept`` is false if the base fails or a certified cutoff is passed."""
    own = cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoffs").alias("__cutoffs"))
    over = [F.coalesce(_rate(r) > F.try_element_at("__cutoffs", F.lit(r)), F.lit(False)) for r in RULES]
    joined = counts.join(own, F.coalesce(counts[stratum].cast("string"), F.lit("")) == F.col("__stratum"), "left")
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__stratum", "__cutoffs")


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(id, counts, base_failed, kept) for each row of ``docs``: repeated ids are judged row by row, an empty table gives none."""
    counts = stage_table(with_counts(docs.select(id_col, text_col, stratum), text_col).drop(text_col), "quality-counts")
    return judge(counts, calibrate(counts, labels, id_col, stratum, alpha, delta), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept. Texts are counted twice rather than shuffled to meet their verdicts."""
    cutoffs = calibrate(with_counts(docs.select(id_col, text_col, stratum), text_col).drop(text_col), labels, id_col, stratum, alpha, delta)
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in {*COUNTS, "base_failed", "kept"}}
    kept = judge(with_counts(docs.withColumnsRenamed(own), own.get(text_col, text_col)), cutoffs, own.get(stratum, stratum)).filter("kept")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
