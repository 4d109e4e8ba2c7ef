"""Exact vectors and known designs."""

import math

import pytest
from pyspark.sql import functions as F

from twinframe.functions import text as X
from twinframe.operators import judgments as J
from twinframe.operators import pairing as P
from twinframe.operators import planning as G
from twinframe.operators import stats as S


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)] if not (isinstance(v, list) and v and isinstance(v[0], int)) else 'array<int>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_splice(spark):
    t, i = "Doctor: a\nPatient: b\nDoctor: c\nPatient: d", "Nurse: x\nDoctor: y"
    splice = lambda t, k, i=i: one(spark, X.splice_after_turn(F.col("t"), F.col("i"), F.col("k")), t=t, i=i, k=k)
    assert splice(t, 2).split("\n")[2:4] == i.split("\n") and splice(t, 2).replace(i + "\n", "") == t
    assert splice("Doctor: a\nPatient: b", 99).endswith(i)
    assert splice("no labels here", 1) == "no labels here\n" + i
    assert splice("", 1) == i and splice(t, 1, "") == t


def test_sentences(spark):
    put = lambda q, s: one(spark, X.insert_sentence(F.col("q"), F.col("s")), q=q, s=s)
    assert put("One. Two.  Three?", "New.") == "One. Two. New. Three?" and put("Only one?", "New.") == "New. Only one?"
    cut = lambda q, s: one(spark, X.remove_sentence(F.col("q"), F.col("s")), q=q, s=s)
    assert cut("First sentence. New. Last sentence?", "New.") == "First sentence. Last sentence?"
    assert cut("A\r\nb  c .  \n New.  \n\tD ;\n e  ?\n", "New.") == "A\nb c. D;\ne?" and cut("a New. New. b", "New.") == "a New. b"
    with pytest.raises(Exception, match="not found"):
        cut("abc", "x")


@pytest.mark.parametrize(("reply", "want"), [("Therefore, the final answer is [B].", "(B)"), ("the final answer is: C", "(C)"), ("... the answer is C.", "(C)"), ("\\boxed{D}", "(D)"), ("I think (a) is right", "[invalid]"), ("no letter here", "[invalid]"), ("the\u0120final\u0120answer\u0120is\u0120D.\u010a", "(D)")])
def test_answers(spark, reply, want):
    assert one(spark, X.extract_answer(F.col("r")), r=reply) == want


def test_content_words_and_leakage(spark):
    words = one(spark, X.content_words(F.col("t")), t="I have had chest pain and a cough for three days")
    assert set(words) == {"chest", "pain", "cough", "three"}


@pytest.mark.parametrize(("ref", "hyp", "want"), [("a b c d", "a b x d", 0.25), ("a b c", "a b c", 0.0), ("a b", "a b c", 0.5), ("a b c", "", 1.0), ("a b c", "b c", 1 / 3), ("", "a", None)])
def test_wer(spark, ref, hyp, want):
    got = one(spark, X.wer(F.col("r"), F.col("h")), r=ref.split(), h=hyp.split())
    assert got == (want if want is None else pytest.approx(want))


def test_alignment(spark):
    assert one(spark, X.align_insertion(F.col("a"), F.col("b")), a=[1, 2, 3, 7, 8], b=[1, 2, 3, 4, 5, 7, 8]) == [0, 1, 2, -1, -1, 3, 4]


@pytest.mark.parametrize(("b01", "b10", "n", "drop", "se", "p"), [(1, 15, 127, 11.0236, 2.99385, 0.000518799), (2, 12, 127, 7.87402, 2.86214, 0.0129395), (7, 14, 127, 5.51181, 3.57503, 0.189247), (6, 14, 127, 6.29921, 3.47672, 0.115318)])
def test_paired_statistics(spark, b01, b10, n, drop, se, p):
    rows = [(0, 1)] * b01 + [(1, 0)] * b10 + [(1, 1)] * (n - b01 - b10)
    r = spark.createDataFrame(rows, "a int, b int").agg(*S.paired_difference(F.col("a"), F.col("b")), F.count_if(F.expr("a<b")).alias("x"), F.count_if(F.expr("a>b")).alias("y")).withColumn("p", S.mcnemar(F.col("x"), F.col("y"))).first()
    assert (r.drop_pp, r.se_pp, r.p) == (pytest.approx(drop, rel=1e-5), pytest.approx(se, rel=1e-5), pytest.approx(p, rel=1e-5))


@pytest.mark.parametrize(("cells", "agreement", "k"), [((7586, 1493, 119, 18), None, None), ((4604, 0, 4, 0), 99.9132, 0.0)])
def test_kappa(spark, cells, agreement, k):
    n11, n10, n01, n00 = cells if agreement else (1493, 119, 18, 7586)
    a, b = S.kappa(*[F.lit(x) for x in (n11, n10, n01, n00)])
    r = spark.range(1).select(a.alias("a"), b.alias("k")).first()
    assert (r.a, r.k) == (pytest.approx(agreement or 98.5135, abs=1e-4), pytest.approx(k if agreement else 0.947194, abs=1e-6))


@pytest.mark.parametrize(("n", "sizes"), [(4608, [922, 921, 922, 921, 922]), (3992, [799, 798, 798, 798, 799]), (616, [124, 123, 123, 123, 123])])
def test_rank_bins(spark, n, sizes):
    got = S.rank_bins(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"]).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in got] == sizes


_REASON = '"reasoning": "r"'


@pytest.mark.parametrize(
    ("reply", "want", "fixed"),
    [
        (f'{{"contamination": 1, "severity": 3, {_REASON}}}', (1, 3), False), (f'\n {{\n "severity": 0,\n "contamination": 0,\n {_REASON}\n}}\n', (0, 0), False), (f'Sure: {{"contamination": 1, "severity": 2, {_REASON}}} ok', (1, 2), False),
        (f'{{"contamination": 1, "severity": 3, {_REASON}', (1, 3), True), (f'  {{"contamination": 1, "severity": 3, {_REASON} ', (1, 3), True), ('{"contamination": 1, "severity": 3, "reasoning": "a } b"', (1, 3), True),
        (f'{{"contamination": 2, "severity": 0, {_REASON}}}', None, False), (f'{{"contamination": true, "severity": 0, {_REASON}}}', None, False), (f'{{"contamination": "1", "severity": 1, {_REASON}}}', None, False), (f'{{"contamination": 1.0, "severity": 1, {_REASON}}}', None, False),
        ('{"contamination": 1, "severity": 2}', None, False), ('{"contamination": 1, "severity": 2, "reasoning": 5}', None, False), ('{"contamination": 1, "severity": 2, garbage}', None, False), (f'{{"contamination": 1, "severity": 2, {_REASON}}}}}}}', None, False), (f'{{"contamination": 1, "severity": 2, {_REASON}, }}', None, False),
        (f'x {{"contamination": 1, "severity": 2, {_REASON}', None, False), (f'[{{"contamination": 1, "severity": 2, {_REASON}}}]', (1, 2), False), (f'{{"contamination": 1, "severity": 2, {_REASON}}} {{}}', None, False), ("}{", None, False), ("truncated", None, False), ("", None, False), (None, None, False),
    ],
)
def test_strict_parsing(spark, reply, want, fixed):
    r = J.parse_strict(spark.createDataFrame([(reply,)], "judge_raw string")).first()
    assert ((r.contamination, r.severity) if not r.parse_error else None) == want and r.repaired == fixed
    assert (r.reasoning is None) == r.parse_error and (not r.parse_error or r.contamination is None)


@pytest.mark.parametrize(("score", "want"), [("4", 4.0), ('"4"', 4.0), ('" 4.5 "', 4.5), ("true", 1.0), ("1e0", 1.0), ('"1e0"', 1.0), ("5.0", 5.0), ("5.1", None), ("0", None), ("null", None), ('"x"', None), ('"nan"', None), ("[4]", None), ("false", None)])
def test_quality_scores(spark, score, want):
    rows = spark.createDataFrame([(f'So: {{"q": {score}, "hallucination": true}}!', 7)], "r string, x int")
    r = J.parse_quality(rows, "r", ["q"]).first()
    assert (r.q, r.hallucination, r.parse_error, r.x) == ((want, 1.0, False, 7) if want else (None, None, True, 7))


@pytest.mark.parametrize(("label", "used", "want"), [("patient", "1", ("patient", 1)), (" Patient", '"1"', ("patient", 1)), ("THIRD_PARTY\\n", "1.0", ("correct", 1)), ("absent", "false", ("absent", 0)), ("absent", "2", None), ("someone", "1", None), ("patient", '"1.0"', None), ("patient", "null", None)])
def test_attribution_labels(spark, label, used, want):
    r = J.parse_attribution(spark.createDataFrame([(f'{{"attribution": "{label}", "used_for_patient": {used}}}',)], "r string"), "r").first()
    assert ((r.attribution, r.used_for_patient) if not r.parse_error else None) == want


def test_only_whole_json_counts(spark):
    texts = ['{"a": 1}', " [1] ", "null", '{"a": 1} x', '{"a": 1}}', "{} {}", '{"a": 1, "a": 2}', "\ue000", '"\ue000"', "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", J.whole_json(F.col("t")).isNotNull().alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, True, True] + [False] * 8


def test_upsert_and_resume(spark):
    base = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, note string")
    new = spark.createDataFrame([(1, "new"), (3, "more")], "k int, note string")
    assert sorted(map(tuple, P.fold(base, new, ["k"]).collect())) == [(1, "new"), (2, "keep"), (3, "more")]
    assert tuple(P.fold_counts(base, new, ["k"]).first()) == (1, 1)
    done = P.fold(base, new, ["k"])
    assert P.resume(base, done, ["k"]).count() == 0
    assert {r.k for r in P.resume(base, done, ["k"], failed=F.col("note") == "new").collect()} == {1}


def test_one_to_one_merge(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, 5), (3, 6)], "k int, w int")
    assert sorted(map(tuple, P.merge_one_to_one([a, b], ["k"]).collect())) == [(1, "x", None), (2, None, 5), (3, None, 6)]
    with pytest.raises(Exception, match="a key occurs twice: 2"):
        P.merge_one_to_one([a, b.union(b.filter("k = 2"))], ["k"]).collect()


def test_checked_join(spark):
    left, right = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert J.validate_join(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="twice"):
        J.validate_join(left, right.union(right), ["k"]).collect()
    with pytest.raises(Exception, match="no match"):
        J.validate_join(spark.createDataFrame([(2,)], "k int"), right, ["k"]).collect()


def test_densest_window(spark):
    units = [(0, 3, 0), (4, 7, 4), (8, 11, 3), (12, 15, 0), (16, 19, 1), (20, 23, 0)]
    table = spark.createDataFrame([("i", float(a), float(b), s) for a, b, s in units], "item string, start_s double, end_s double, score int")
    for hi in (8, 12):
        assert tuple(G.densest_window(table, "item", "score", 5, hi).first()) == ("i", 4.0, 11.0, 7, 2)
    assert G.densest_window(table, "item", "score", 30, 40).collect() == []


def test_donors_and_split(spark):
    for parts in (1, 7):
        donors = G.assign_donors(spark.range(6).repartition(parts), "id", 2, 3).collect()
        assert len({(r.id, r.donor) for r in donors}) == 12 and all(r.id != r.donor for r in donors)
        held = G.locked_split(spark.range(1273).repartition(parts), "id", 0.1, 3).filter("heldout").collect()
        assert len(held) == 127
        if parts == 1:
            first = {r.id for r in held}, {tuple(r) for r in donors}
    assert first == ({r.id for r in held}, {tuple(r) for r in donors})


def test_stems_are_distinct_prefixes(spark):
    stems = lambda t: one(spark, X.stems(F.col("t")), t=t)
    assert stems("medication medications headaches cats") == ["headac", "medica", "cats"]
    assert stems("nasal polyp surgery softball team polyps removed finally breathing through nose") == ["breath", "finall", "polyps", "remove", "softba", "surger", "throug", "nasal"]
    assert stems("Who said it (a long aside) about THEIR knee-cap's ache") == ["knee-c", "ache"]


@pytest.mark.parametrize(("level", "ok"), [("1", True), ('"1"', True), ("1.0", True), ("1.9", True), ("true", True), ('" 1 "', True), ('"1.0"', False), ("2", False), ("null", False), ('"x"', False), ("-1", False)])
def test_paired_scores_as_whole_numbers(spark, level, ok):
    raw = f'{{"A": {{"contamination": {level}, "severity": 3}}, "B": {{"contamination": 0, "severity": 0}}}}'
    rows = spark.createDataFrame([(raw,)], "r string")
    got = {r.condition: (r.contamination, r.severity, r.parse_error) for r in J.parse_paired(rows, "r", F.lit(True)).collect()}
    assert got == ({"clean": (1, 3, False), "distracted": (0, 0, False)} if ok else {c: (None, None, True) for c in ("clean", "distracted")})


def test_lenient_objects(spark):
    good = '{"contamination": 1, "severity": 2}'
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([good, f"So {good} then", f"[{good}]", "{'contamination': 1, 'severity': 2}", "broken", None])], "i int, r string")
    assert [r.contamination for r in J.parse_single(rows, "r").orderBy("i").collect()] == [1, 1, None, None, None, None]


def test_tails_and_quantiles(spark):
    lit = lambda x: F.lit(float(x))
    row = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    for t, df, p in ((2.0, 10, 0.0733880), (1.0, 1, 0.5), (-12.7062, 1, 0.05), (2.776445, 4, 0.05), (1.96, 1e6, 0.0499960), (0.0, 5, 1.0), (30.0, 3, 1 - 2 / math.pi * (math.atan(30 / 3**0.5) + math.sin(2 * math.atan(30 / 3**0.5)) / 2))):
        assert row(S.t_tail(lit(t), lit(df))) == pytest.approx(p, rel=2e-4)
    assert row(S.t_tail(lit(1), lit(0))) is None
    assert row(S.normal_tail(lit(-1.959964))) == pytest.approx(0.05, rel=1e-5)
    for df, q in ((1, 12.7062), (10, 2.22814), (126, 1.97897)):
        assert row(S.t_quantile(lit(df))) == pytest.approx(q, rel=1e-4)
    assert row(S.log_gamma(lit(1))) == pytest.approx(0, abs=1e-10) and row(S.log_gamma(lit(11))) == pytest.approx(15.104412573, rel=1e-10)


def test_exact_tests(spark):
    p = lambda a, b: spark.range(1).select(S.mcnemar(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert p(0, 0) == 1 and p(3, 7) == pytest.approx(0.34375) and p(10, 1) == pytest.approx(0.01171875) and p(5, 5) == 1
    assert p(500_000, 502_000) == pytest.approx(0.0458, rel=2e-3) and p(10, 4000) == pytest.approx(0, abs=1e-100)
    signed = lambda d: S.wilcoxon(spark.createDataFrame([(1, float(x)) for x in d], "g int, d double"), ["g"], "d").first()
    assert signed([1, 2, 3, 4, 5]).p == pytest.approx(0.0625) and signed([1, -2, 3, 4, 5, 6]).p == pytest.approx(0.09375)
    assert signed([0, 0]).p == 1.0 and signed([0, 0]).n_nonzero == 0
    tied = signed([1, 1, -1, 2, 2, 3])
    assert (tied.w, tied.p) == (2.0, pytest.approx(math.erfc(8.5 / math.sqrt((6 * 7 * 13 - 30 / 2) / 24) / math.sqrt(2)), abs=1e-6))


def test_signed_ranks_of_many_differences(spark):
    got = S.wilcoxon(spark.range(1, 2001).selectExpr("1 AS g", "IF(id % 2 = 0, id, -id) AS d"), ["g"], "d").first()
    n, w = 2000, 1000.0 * 1000
    assert (got.n_nonzero, got.w_plus, got.w_minus, got.w) == (n, w + 1000, w, w)
    z = (n * (n + 1) / 4 - w) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert got.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)
    n = 30_000_000  # its cube is no long
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    p = spark.range(1).select(S.signed_rank_p(F.lit(n).cast("long"), F.lit(mean - 2 * sd), F.lit(0.0)).alias("x")).first()["x"]
    assert p == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-6)


def test_numbering_and_discovery_rates(spark):
    import random

    rng = random.Random(4)
    rows = [(i % 2, float(rng.choice((0, 0, 1, 2.5, 7, 1e6)) + (i % 5 == 0) * rng.random()), i) for i in range(300)]
    got = S.numbered(spark.createDataFrame(rows, "g int, x double, i int"), ["g"], ["x", "i"], None, "k").collect()
    for g in (0, 1):
        order = sorted((x, i) for h, x, i in rows if h == g)
        assert {r.i: (r.k, r.k_all) for r in got if r.g == g} == {i: (n + 1, len(order)) for n, (_, i) in enumerate(order)}
    p = [rng.choice((rng.random(), 0.5, 0.001 * rng.random(), 1.0)) for _ in range(80)]
    ranked = sorted(p)
    want = {x: min(min(1.0, y * len(p) / (n + 1)) for n, y in enumerate(ranked) if y >= x) for x in p}
    table = S.benjamini_hochberg(spark.createDataFrame([(x,) for x in p] + [(None,)], "p double"), "p").collect()
    assert len(table) == 81 and all((r.q is None) if r.p is None else r.q == pytest.approx(want[r.p]) for r in table)


def test_stability_of_one_run(spark):
    sets = spark.createDataFrame([("a", 1, [1, 2, 3]), ("a", 2, [1, 2, 4, 5]), ("a", 3, [1, 6]), ("b", 1, [1, 2])], "m string, run int, s array<int>")
    got = {r.m: r for r in S.set_stability(sets, spark.createDataFrame([("a", [1, 2, 7]), ("b", [1, 3, 9])], "m string, p array<int>"), ["m"], "run").collect()}
    a, b = got["a"], got["b"]
    assert (a.heads_mean, a.heads_min, a.heads_max, a.n_all_runs, a.n_union, a.n_recovered) == (3.0, 2, 4, 1, 6, 2)
    assert (a.jaccard_mean, a.jaccard_min, a.jaccard_max) == (pytest.approx(0.85 / 3, abs=1e-6), 0.2, 0.4) and a.published_max == 0.5
    assert (b.n_runs, b.n_all_runs, b.n_union, b.published_mean) == (1, 2, 2, 0.25) and b.jaccard_mean is None and b.n_recovered is None


def test_codes_options_and_folds(spark):
    level = lambda c: spark.createDataFrame([(c,)], "c string").select(*X.distractor_code(F.col("c"))).first()
    assert tuple(level("audio_-10dB_d1")) == (-10, 1) and tuple(level(None)) == (None, None)
    with pytest.raises(Exception, match="not a distractor code"):
        level("audio_10")
    with pytest.raises(Exception, match="without a label"):
        X.labelled(spark.createDataFrame([("x",)], "c string"), "c", {"a": "A"}).collect()
    pick = lambda t: spark.createDataFrame([(t,)], "t string").select(X.primed_option(F.col("t"), [(k, F.lit(o)) for k, o in zip("ABCD", ("Acute asthma", "asthma", "Gout", "gout!"))]).alias("x")).first()["x"]
    assert [pick(t) for t in ("Asthma.", "acute", "GOUT", "severe gout", "", None, "lupus")] == ["B", "A", "C", "C", None, None, None]
    assert one(spark, X.ascii_fold(F.col("t")), t="\u201cit\u2019s\u201d \u2013 ok\u2026") == "\"it's\" - ok..."


def test_rules_in_order(spark):
    from twinframe.operators import notes as N

    rules = N.AsideRules(redirect=r"(?i)\bback to you\b", forbidden=r"(?i)\bme too\b", body=r"(?i)\bmy knee\b", claim=r"(?i)\bi have [^.]{0,30}stroke\b", tags=("Doctor:", "Patient:"))
    base = ["Patient: my friend talked of a stroke", "Doctor: I see", "Patient: he is fine"]
    cases = [
        (base, False, None), (base[:2], False, "turn count"), ([*base[:2], "Nurse: hm"], False, "speaker tag"), (["Doctor: so", *base[:2]], False, "clinician opens the aside"),
        ([base[0] + "x" * 600, *base[1:]], False, "too long"), ([*base[:2], "Patient: back to you"], False, "redirect cue"), (["Patient: hi", *base[1:]], False, "assigned content missing"),
        ([*base[:2], "Patient: me too"], False, "forbidden phrase"), ([*base[:2], "Patient: my knee"], True, "patient refers to own body part"), ([*base[:2], "Patient: I have had a stroke"], False, "patient claims the condition"),
    ]
    rows = spark.createDataFrame([(i, "\n".join(t), b) for i, (t, b, _) in enumerate(cases)], "i int, t string, b boolean")
    got = rows.select("i", N.failing_rule(F.col("t"), F.array(F.lit("stroke")), F.col("b"), rules).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [f for _, _, f in cases]


def test_frozen_annotations_are_checked(spark):
    from twinframe.operators import notes as N

    rows = spark.createDataFrame([(1,), (2,)], "k int")
    saved = lambda *x: spark.createDataFrame(list(x), "k int, f string")
    assert {(r.k, r.f) for r in N.frozen(rows, saved((1, "True"), (2, "false")), ["k"], ["f"]).collect()} == {(1, True), (2, False)}
    for bad, text in ((saved((1, "true")), "match"), (saved((1, "true"), (2, "true"), (2, "true")), "duplicate"), (saved((1, "true"), (2, "yes")), "true or false"), (saved((1, "true"), (2, "true"), (3, "true")), "match")):
        with pytest.raises(Exception, match=text):
            N.frozen(rows, bad, ["k"], ["f"]).collect()


def test_pair_assembly_and_transcripts(spark):
    plan = spark.createDataFrame([(1, "d0"), (1, "d1"), (2, "d0"), (3, "d0")], "i int, c string")
    texts = spark.createDataFrame([(1, "clean", "a"), (1, "d0", "ax"), (1, "d1", "ay"), (2, "clean", "b"), (3, "d0", "cz")], "i int, c string, t string")
    whole, audit = G.assemble_pairs(plan, texts, "i", "c", "t")
    assert sorted((r.i, r.c, r.clean_text, r.mixed_text) for r in whole.collect()) == [(1, "d0", "a", "ax"), (1, "d1", "a", "ay")]
    assert tuple(audit.first()) == (4, 2, 1, 1)
    stream = lambda s, rows: spark.createDataFrame([(i, s, float(a), float(b), t) for i, a, b, t in rows], "i int, speaker string, start_s double, end_s double, text string")
    made = G.assemble_transcripts(spark.createDataFrame([(1,), (2,)], "i int"), [stream("Doctor", [(1, 0, 1, "hi"), (1, 4, 5, "ok")]), stream("Patient", [(1, 2, 3, "yes")])], "i")
    assert {r.i: (r.transcript, r.n, r.seconds) for r in made.collect()} == {1: ("Doctor: hi\nPatient: yes\nDoctor: ok", 3, 5.0), 2: ("", 0, None)}


def test_global_rank_follows_the_hash(spark):
    rows = [(i, f"{(i * 2654435761) % 2**32:08x}") for i in range(500)]
    for digits in (1, 3):
        got = G.global_rank(spark.createDataFrame(rows, "i int, h string"), F.col("h"), "i", digits=digits).collect()
        assert [r.i for r in sorted(got, key=lambda r: r.rank)] == [i for i, _ in sorted(rows, key=lambda x: x[1])]


@pytest.mark.parametrize(("units", "groups"), [(512, 256), (3, 1)])
def test_replicates_equal_plain_sums(spark, monkeypatch, units, groups):
    import hashlib

    from twinframe.operators import replicates as R

    monkeypatch.setattr(R, "UNITS", units)
    monkeypatch.setattr(R, "GROUPS", groups)
    rows = [(g, None if i % 11 == 0 else f"h{i % 2}", f"u{i}", float(i % 5) if i % 7 else None, float(i % 3)) for g in range(3) for i in range(40)] + [(9, "z", "u1", 2.0, 0.0)]

    def weight(unit, b):
        digest = hashlib.md5(f"4|{unit}".encode()).hexdigest()
        k = [int(digest[8 * i : 8 * i + 8], 16) % R.PRIME for i in range(3)]
        u = (k[0] + k[1] * b + k[2] * b * b) % R.PRIME / R.PRIME
        return sum(u >= p for p in R.POISSON)

    want = {}
    for g, h, unit, t, n in rows:
        for b in range(25):
            sums = want.setdefault((g, h, b), [0.0, 0.0])
            sums[0] += weight(unit, b) * (t or 0)
            sums[1] += weight(unit, b) * n
    df = spark.createDataFrame(rows, "g int, h string, unit string, t double, n double").repartition(3)
    got = {(r.g, r.h, r.b): r.s for r in R.replicates_of(df, ["g", "h"], "unit", "t", "n", 25, 4).collect()}
    assert got.keys() == want.keys() and all(s is None if n == 0 else s == pytest.approx(t / n) for (t, n), s in ((want[k], got[k]) for k in want))
    assert R.replicates_of(df, [], "unit", "t", "n", 7, 4).count() == 7 and R.replicates_of(df.limit(0), ["g"], "unit", "t", "n", 7, 4).count() == 0


def test_numpy_draws_in_blocks(spark):
    """The draws of a block of replicates go on where the last ended, so an interval is numpy's."""
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = {("a", 1): 4608, ("a", None): 37, ("b", 2): 1}
    data = {k: (np.arange(n) < 0.5 * n).astype(float)[rng.permutation(n)] - 0.25 for k, n in sizes.items()}
    rows = [(*k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("a", 1, 9999, None), ("c", 3, 0, None)]
    df = spark.createDataFrame(rows, "g string, h int, i int, v double").repartition(5)
    got = {(r.g, r.h): r for r in S.numpy_interval(df, ["g", "h"], F.col("v"), ["i"], seed=7).collect()}
    assert got.keys() == sizes.keys()
    for k, x in data.items():
        whole = (x * 100)[np.random.default_rng(7).integers(0, len(x), size=(2000, len(x)))].mean(axis=1)
        low, high = np.percentile(whole, [2.5, 97.5])
        assert (got[k].n, got[k].estimate, got[k].ci_low, got[k].ci_high) == (len(x), pytest.approx((x * 100).mean()), pytest.approx(low), pytest.approx(high))
    with pytest.raises(Exception, match="use mean_interval"):
        S.numpy_interval(df, ["g"], F.col("v"), ["i"], most=100).collect()


def test_numpy_draws_of_a_long_group(spark):
    import numpy as np

    n = 1_000_001
    df = spark.range(n).selectExpr("id", "IF(id % 7 = 0, 'b', 'a') AS half", "CAST(id % 5 AS DOUBLE) AS v").repartition(7)
    r = S.numpy_interval(df, [], F.col("v"), ["half", "id"], replicates=20, seed=3, scale=1.0).first()
    i = np.arange(n)
    x = np.concatenate([i[i % 7 != 0], i[i % 7 == 0]]) % 5.0
    rng = np.random.default_rng(3)
    low, high = np.percentile([x[rng.integers(0, n, size=n)].mean() for _ in range(20)], [2.5, 97.5])
    assert (r.n, r.estimate, r.ci_low, r.ci_high) == (n, pytest.approx(x.mean()), pytest.approx(low), pytest.approx(high))


def test_published_interval(spark):
    """A published contrast of 4,608 pairs, 4 of them -1 and 2,309 of them 1. Its rows aren't published, and another order gives other draws:
    with 2,000 replicates a bound has a standard error of some 0.045, so it is held to three of these."""
    rows = [(i * 2654435761 % 4608, -1.0 if i < 4 else 1.0 if i < 2313 else 0.0) for i in range(4608)]
    assert len({i for i, _ in rows}) == 4608
    r = S.numpy_interval(spark.createDataFrame(rows, "i int, v double"), [], F.col("v"), ["i"]).first()
    assert r.estimate == pytest.approx(50.0217, abs=5e-5) and r.ci_low == pytest.approx(48.6111, abs=0.14) and r.ci_high == pytest.approx(51.454, abs=0.14)


def test_buckets_are_even_on_skewed_values(spark):
    import math
    import random

    rng = random.Random(5)
    rows = [(i % 2, math.exp(3 * rng.gauss(0, 1)) * (1000 if i % 2 else 1)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g int, x double")
    counts = S.bucketed(df, ["g"], "x").groupBy("g", "__b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("g", "__b").collect()
    assert max(r.n for r in counts) < 0.04 * 10_000 and {r["__b"] for r in counts} == set(range(64))
    for a, b in zip(counts, counts[1:]):
        assert a.g != b.g or a.hi < b.lo
    single = S.bucketed(spark.createDataFrame([(1, 5.0)] * 10, "g int, x double"), ["g"], "x").select("__b").distinct().collect()
    assert len(single) == 1


def test_buckets_hang_on_the_rows_alone(spark):
    """Not on the order in which tasks' parts are merged: ranks are sums over buckets, and a plan may deal the rows twice."""
    rows = spark.range(60_000).selectExpr("CAST(id % 2 AS INT) AS g", "CAST(pmod(hash(id), 20000) AS BIGINT) AS x", "id AS i")
    dealt = [S.bucketed(rows.repartition(n, c), ["g"], "x").select("i", "__b") for n, c in ((16, F.col("i")), (5, F.hash("i", F.lit(3))))]
    assert dealt[0].exceptAll(dealt[1]).count() == 0
    sizes = [r["count"] for r in dealt[0].join(rows, "i").groupBy("g", "__b").count().collect()]
    assert len(sizes) == 128 and max(sizes) < 2.5 * 30_000 / 64


def test_numbers_with_nulls_last(spark):
    rows = [(1, None, "b"), (1, None, None), (1, None, "a"), (1, 2.0, None), (1, 2.0, "c"), (1, -1.0, "d"), (2, None, "a")]
    got = S.numbered(spark.createDataFrame(rows, "g int, x double, s string"), ["g"], ["x", "s"], None, "k").collect()
    assert {(r.g, r.x, r.s): (r.k, r.k_all) for r in got} == {(1, -1.0, "d"): (1, 6), (1, 2.0, "c"): (2, 6), (1, 2.0, None): (3, 6), (1, None, "a"): (4, 6), (1, None, "b"): (5, 6), (1, None, None): (6, 6), (2, None, "a"): (1, 1)}
    for none in (spark.createDataFrame([(None, "a"), (None, "b")], "x double, s string"), spark.createDataFrame([], "x double, s string")):
        assert sorted((r.s, r.k) for r in S.numbered(none, [], ["x", "s"], None, "k").collect()) == [("a", 1), ("b", 2)][: none.count()]
