"""Rules, lexicons, templates and slots from tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinframe.operators import notes as N
from twinframe.operators import rules as R


def test_first_rule_decides(spark):
    rules = spark.createDataFrame(N.ENGINE_GROUPS, "rank int, pattern string, label string")
    names = {"GPT-5": "Proprietary", "o1-mini": "Proprietary", "Llama-3-8B-UltraMedical": "Open-weight, medical", "gemini-med": "Proprietary", "llama-3": "general", None: "general"}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for table in (rules, rules.orderBy(F.desc("rank")).repartition(3)):
        assert {r.n: r.g for r in rows.select("n", R.first_match(F.col("n"), table, "general").alias("g")).collect()} == names
    assert rows.select(R.first_match(F.col("n"), rules.limit(0), "none").alias("g")).distinct().collect()[0].g == "none"
    with pytest.raises(ValueError, match="rules"):
        R.first_match(F.col("n"), spark.range(1001).selectExpr("id as rank", "'x' as pattern", "'y' as label"), "general")


def test_keyword_scores(spark):
    words = spark.createDataFrame([("chest", 1), ("pain", 2), ("cough", 1), ("Headache", 3), ("tablet", 1), ("pains", 9), (None, 5)], "word string, w int")
    texts = [(1, "Chest pain and a cough, headaches, no tablets, thank you"), (2, "thank you"), (3, None), (4, "pain pains PAIN painss")]
    rows = spark.createDataFrame(texts, "k int, t string")
    assert {r.k: r.score for r in R.keyword_scores(rows, ["k"], "t", words.filter("word <> 'pains'")).collect()} == {1: 5, 2: 0, 3: 0, 4: 3}
    assert {r.k: r.score for r in R.keyword_scores(rows, ["k"], "t", words, weight="w").collect()} == {1: 8, 2: 0, 3: 0, 4: 22}  # pains by itself outweighs pain with an s, and painss is pains with one


def test_templates_are_filled_once(spark):
    kinds = [("paired", 'A: {a}\nB: {b}\n{{"score": <0-3>}}'), ("single", "{b}{b} {{{a}}}"), ("plain", "no field")]
    rows = spark.createDataFrame([(1, "paired", "x{b}", "y"), (2, "single", "a", None), (3, "plain", None, None)], "i int, kind string, a string, b string")
    templates = spark.createDataFrame(kinds, "kind string, template string")
    got = {r.i: r.prompt for r in R.rendered(rows, templates).collect()}
    assert got == {1: 'A: x{b}\nB: y\n{"score": <0-3>}', 2: " {a}", 3: "no field"}
    with pytest.raises(Exception, match="no template of the kind other"):
        R.rendered(rows.withColumn("kind", F.lit("other")), templates).collect()
    with pytest.raises(ValueError, match="asks for 'zz'"):
        R.rendered(rows, spark.createDataFrame([("paired", "{zz}")], "kind string, template string"))


def test_unknown_systems_are_picked_by_seed(spark):
    systems = spark.createDataFrame([("heart",), ("lung",), ("general",), ("skin",), ("lung",), (None,)], "system string")
    items = spark.range(400).withColumnRenamed("id", "item")
    known = items.filter("item < 100").select("item", F.when(F.col("item") % 2 == 0, "heart").otherwise("general").alias("system"))
    runs = [{r.item: r.system for r in R.lookup_or_pick(items.repartition(n), "item", known, systems, seed).collect()} for n, seed in ((1, 3), (5, 3), (2, 4))]
    assert runs[0] == runs[1] and runs[0] != runs[2] and len(runs[0]) == 400
    assert all(runs[0][i] == "heart" for i in range(0, 100, 2))
    picked = Counter(v for i, v in runs[0].items() if i >= 100 or i % 2)
    assert set(picked) == {"heart", "lung", "skin"} and min(picked.values()) > 80
    alone = R.lookup_or_pick(items, "item", known, systems.filter("system = 'general'"), 3).groupBy("system").count().collect()
    assert {r.system: r["count"] for r in alone} == {"heart": 50, "general": 350}


def test_slots_are_balanced(spark):
    slots = [(s, f"t{i}", i % 3 == 0) for s, n in (("heart", 7), ("skin", 2)) for i in range(n)]
    table = spark.createDataFrame(slots, "system string, topic string, relatives_ok boolean")
    shuffled = [sorted((r.system, r.place, r.topic) for r in R.shuffled_slots(t, "system", "topic", seed).collect()) for t, seed in ((table, 1), (table.repartition(4), 1), (table, 2))]
    assert shuffled[0] == shuffled[1] and shuffled[0] != shuffled[2]
    items = spark.createDataFrame([(s, k) for s in ("heart", "skin", "other") for k in range(70)], "system string, k long")
    got = R.assign_slots(items, R.shuffled_slots(table, "system", "topic", 1), "system", "k", 4, 3).collect()
    assert len(got) == 140 and set(Counter((r.system, r.topic) for r in got).values()) == {10, 35}
    assert all(0 <= r.relation < 7 and (r.relatives_ok or r.relation >= 4) for r in got)
    assert {r.relation for r in got if r.relatives_ok} == set(range(7)) and {r.relation for r in got if not r.relatives_ok} == {4, 5, 6}
