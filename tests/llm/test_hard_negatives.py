import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import hard_negatives as H
from twinframe.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=10, scale=256):
    good, d = {}, max((len(v) for _, v, _ in rows if v is not None), default=0)
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = [int(np.floor(scale * float(np.float32(c)))) for c in v]
        own = (label, np.array(x + [0] * (d - len(x)), "<i4").tobytes())
        good[i] = min(good.get(i, own), own)
    good = {i: (label, np.frombuffer(x, "<i4").astype(int)) for i, (label, x) in good.items()}
    out = []
    for a, (label, q) in good.items():
        if a % every:
            continue
        score = {i: int(x @ q) for i, (_, x) in good.items() if i != a}
        ordered = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ordered if good[i][0] == label][:positives]:
            fit = [i for i in ordered if good[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"a": F.lit(1), "b": F.lit("x"), "x": F.lit(2.0), "q": F.lit(0), "score": F.lit(3)})
    return sorted(map(tuple, H.mine(df, F.col("label"), F.col("vec_id") % every == 0, **options).collect()))


def clouds(n, d=6, labels=3, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    return [(i, (centres[i % labels] * 0.5 + rng.normal(size=d) * spread).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"row_block": 37, "anchor_block": 4, "bucket": 9}, {"row_block": 64, "bucket": 16, "focus": 1}])
def test_same_as_brute_force(spark, options):
    rows = clouds(300)
    assert mined(spark, rows, **options) == brute(rows)


def test_blocks_are_full_on_many_partitions(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k")).repartition(9)
    blocks = H.in_blocks(rows, [F.desc("k"), F.col("id")], 64, "b", "t").collect()
    order = sorted(blocks, key=lambda r: (-r.k, r.id))
    assert [r.b for r in order] == [i // 64 for i in range(1000)]


def test_messy_rows_ties_and_copies(spark):
    rows = clouds(120, seed=4)
    rows += [(500, None, 1), (510, [float("nan")] * 6, 1), (520, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (530, [float("inf")] * 6, 0), (None, [1.0] * 6, 1), (540, [1.0] * 6, None), (550, [], 2), (560, [0.0] * 6, 2), (570, [0.5, -0.25], 1)]
    rows += [(600 + i, rows[7][1], i % 3) for i in range(90)]  # one common vector: nothing but ties
    rows += [rows[10], (20, rows[3][1], 2)]
    assert mined(spark, rows, row_block=50, bucket=8) == brute(rows)


def test_opposite_and_lone_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [0.6, 0.1], 1), (10, [0.0, 0.0], 0), (20, [1.0, 1.0], 5)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, rows[1:4]) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-4e6, 4e6) for _ in range(4)], i % 2) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_pruning_leaves_out_rows_but_no_result():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    x = (x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(950, 1000, (500, 1))).astype("<i4")
    b = H.Bucket(np.arange(500), np.zeros(500, int), x, (x.astype(int) ** 2).sum(axis=1))
    seen = 0
    for q in x[:40]:
        size, scores = float(np.sqrt((q.astype(int) ** 2).sum())), x.astype(int) @ q
        reach = int(np.sort(scores)[-5])
        found = b.candidates(q, size, reach, 4)
        assert set(np.flatnonzero(scores >= reach)) <= set(found.tolist())
        seen += len(found)
        assert (b.scores(q, size, found) == scores[found]).all()
        assert len(b.candidates(q, size, int(size * b.longest * 1.1), 4)) == 0
    assert seen < 0.6 * 40 * 500


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op12_lemp_negatives"])
    names = [c[0] for c in want.description]
    got = queries.op12_lemp_negatives(spark, d)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
