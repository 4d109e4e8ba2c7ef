import duckdb
import pytest
from pyspark.sql import functions as F

from twinframe.operators import notes as N
from twinframe.operators import tables as T
from twinframe.plans import registry


def test_sections_lines_and_classes(spark):
    note = "intro\n**Assessment**\nchest pain, of the friend\nOdd header:\nmore\n**P: Plan** \nFamily history: asthma of a friend\nchest friend"
    notes = spark.createDataFrame([(1, note)], "k int, note string")
    rows = N.assign_sections(N.note_lines(notes, ["k"], "note"), ["k"]).orderBy("pos").collect()
    assert [r.section for r in rows] == ["Unsectioned", *["Assessment"] * 4, "Plan", *["Family / social history"] * 2]
    lines = N.note_lines(notes, ["k"], "note").withColumn("hit", N.located(F.col("line"), F.array(*map(F.lit, ("chest", "friend", "asthma")))))
    assert [r.pos for r in lines.filter("hit").collect()] == [3, 7]  # the last line is a bare header
    texts = ["recorded in Family History", "a tangential remark in family history", "nothing", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.classify(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["family_history_inflation", "pathologised_conversation", "other", "other"]


@pytest.mark.parametrize("name", ["locate_lines", "plan_actions"])
def test_actions_after_other_letters_are_found_as_in_sql(spark, tmp_path, name):
    docs = [(i, f"words\n{t}\nmore words of it", "de", "web", 9) for i, t in enumerate(("Plan: ein \u00f6test", "plain", "\u00dfcheck", "Plan: order"), 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(i, t) for i, t in enumerate(("zebrafink wandert \u00f6test", "zebrafink wandert xtest", "zebrafink wandert, test", "zebrafink wandert \u00dforder"))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = duckdb.connect()
    for t in ("documents", "benchmark"):
        d.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), d.execute(registry.ORACLES[name]).df()
    assert sorted(map(str, got[want.columns].itertuples(index=False))) == sorted(map(str, want.itertuples(index=False)))


@pytest.mark.parametrize("hits", [641, 1287, 32_123])
def test_ties_of_rates_are_rounded_as_in_sql(spark, hits):
    got = spark.range(64_000).agg(T.pct((F.col("id") < hits).cast("int"))).first()[0]  # 641 are 1.0015625 %, which a double holds a little below
    assert got == duckdb.sql(f"select round(100 * avg(case when i < {hits} then 1.0 else 0 end), 6) from range(64000) t(i)").fetchall()[0][0]
