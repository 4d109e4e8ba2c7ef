from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from twinframe.llm import hilbert as H

from .helpers import DOCS, corpus, frame


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 3), (3, 2), (4, 2), (1, 3)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, dims, bits):
    points = list(product(range(1 << bits), repeat=dims))
    names = [f"d{i}" for i in range(dims)]
    table = spark.createDataFrame(points, ", ".join(f"{n} long" for n in names)).coalesce(1)
    order = [tuple(r[:dims]) for r in H.with_hilbert_index(table, [F.col(n) for n in names], bits, "h").orderBy("h").collect()]
    at = [r.h for r in H.with_hilbert_index(table, [F.col(n) for n in names], bits, "h").collect()]
    assert sorted(at) == list(range(len(points)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


@pytest.mark.parametrize("n_shards", [1, 7, 200])
def test_law(spark, n_shards):
    rows = corpus()
    got = H.assign_shards(frame(spark, rows), ["doc_id", "n_chars", "lang"], ["source", "doc_id"], n_shards, ranges=3).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in ordered] == sorted(r.hilbert for r in got)


def test_shards_are_boxes(spark):
    table = spark.range(4096).selectExpr("id % 64 as x", "id div 64 as y")
    got = H.assign_shards(table, ["x", "y"], ["x", "y"], 16).groupBy("shard").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).collect()
    assert sum((r.w + 1) * (r.h + 1) for r in got) <= 3 * 4096  # runs of row-major order would each span all of x


def test_edges(spark):
    assert H.assign_shards(spark.createDataFrame([], DOCS), ["doc_id", "lang"], ["doc_id"], 5).collect() == []
    odd = frame(spark, corpus()).selectExpr("*", "1 as shard", "'s' as slot", "2 as hilbert", "cast(null as double) as v")
    assert H.assign_shards(odd, ["v", "lang"], ["doc_id"], 5).count() == len(corpus())


def test_repeated_rows_take_distinct_slots(spark):
    rows = frame(spark, corpus()[:5] * 40)
    got = H.assign_shards(rows, ["doc_id", "lang"], ["doc_id"], 7).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got) == 200
