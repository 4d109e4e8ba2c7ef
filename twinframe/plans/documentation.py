"""Contrasts of judged notes: strata, grouping sets, agreement, outcomes, examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.operators import pairing as P
from twinframe.operators import stats as S
from twinframe.operators import tables as T

from .intervals import bounds_sql, sums_sql, unit_sql
from .registry import query
from .views import twin, view

PAIR_KEYS = ["source_dataset", "family", "item_id", "model", "distractor_type"]


def pct(x: str) -> str:
    return f"round(100*avg(CAST({x} AS DOUBLE)), 6)"


CONTRAST = f"count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_dropped, {pct('c0')} AS rate_clean, {pct('c1')} AS rate_distracted, {pct('c1-c0')} AS delta_pp"


#: Models that form the API cohort; all others are open-weight.
FRONTIER = ["m3"]
_COHORT = "CASE WHEN model IN ('m3') THEN 'API' ELSE 'open-weight' END AS cohort"
_STRATUM = "model, source_dataset, distractor_type"


def _paired_rows(spark, d):
    return view(spark, d, "pairs").withColumn("cohort", T.cohort(F.col("model"), FRONTIER))


@query(twin("pairs", f"SELECT * FROM (SELECT {_STRATUM}, min(family) AS family, {CONTRAST}, round(avg(CAST(s1 AS DOUBLE)), 6) AS mean_severity FROM pairs GROUP BY {_STRATUM}) JOIN ({bounds_sql(sums_sql('SELECT * FROM pairs', _STRATUM, 'c1-c0', 'item_id'), _STRATUM)}) USING ({_STRATUM})"))
def strata_table(spark, d):
    """The contrast of each stratum with its interval."""
    wide = P.pair_pivot(view(spark, d, "judgments"), PAIR_KEYS, ["contamination", "severity"])
    by = ["model", "source_dataset", "distractor_type"]
    table = T.strata(wide, by, "contamination_clean", "contamination_distracted", [F.min("family").alias("family"), F.round(F.avg("severity_distracted"), 6).alias("mean_severity")])
    sums = S.dealt_sums(wide, by, F.col("contamination_distracted") - F.col("contamination_clean"), ["item_id"])
    return table.join(S.mean_interval(sums, by, 100.0), by)


@query(twin("pairs", "SELECT source_dataset, item_id, model, distractor_type, c0 AS contamination_clean, c1 AS contamination_distracted, q0 AS overall_quality_clean, q1 AS overall_quality_distracted, c1-c0 AS delta FROM pairs"))
def pair_pivot(spark, d):
    wide = P.pair_pivot(view(spark, d, "judgments"), PAIR_KEYS, ["contamination", "overall_quality"]).drop("family")
    return wide.withColumn("delta", F.col("contamination_distracted") - F.col("contamination_clean"))


SETS = [["model"], ["distractor_type"], ["family"], ["family", "distractor_type"], ["model", "distractor_type"], ["model", "family", "distractor_type"], []]


def _sets_sql(extra: str = "", sets=SETS) -> str:
    return "GROUPING SETS (" + ", ".join("(" + ", ".join(["cohort", *x, *([extra] if extra else [])]) + ")" for x in sets) + ")"


def _labels(columns) -> str:
    return ", ".join(f"CASE WHEN grouping({c})=1 THEN 'all' ELSE {c} END AS {c}" for c in columns)


_DIMS = ("model", "family", "distractor_type")
_BY = "cohort, model, family, distractor_type"


@query(
    twin(
        "pairs",
        f"""WITH r AS (SELECT *, {_COHORT}, {unit_sql("item_id")} AS unit FROM pairs), pooled AS (SELECT cohort, {_labels(_DIMS)}, {CONTRAST} FROM r GROUP BY {_sets_sql()}),
        own AS (SELECT cohort, model, source_dataset, family, distractor_type, avg(CAST(c1-c0 AS DOUBLE)) AS d FROM r GROUP BY ALL),
        means AS (SELECT cohort, {_labels(_DIMS)}, round(100*avg(d), 6) AS delta_strata, count(*) FILTER (d > 0) AS n_up, count(*) FILTER (d = 0) AS n_flat, count(*) FILTER (d < 0) AS n_down FROM own GROUP BY {_sets_sql()}),
        u AS (SELECT cohort, {_labels(_DIMS)}, unit, 100.0e0*sum(c1-c0) AS total, count(*) AS n FROM r GROUP BY {_sets_sql('unit')})
        SELECT * FROM pooled JOIN means USING ({_BY}) JOIN ({bounds_sql('SELECT * FROM u', _BY)}) USING ({_BY})""",
    )
)
def summary_grouping_sets(spark, d):
    """Pooled contrast with its interval, unweighted mean of strata and their signs, by cohort over grouping sets."""
    rows, sets = _paired_rows(spark, d), [["cohort", *x] for x in SETS]
    by = ["cohort", *_DIMS]
    table = T.summary(rows, ["cohort", "model", "source_dataset", "family", "distractor_type"], sets, "c0", "c1")
    sums = S.dealt_sums(rows, by, F.col("c1") - F.col("c0"), ["item_id"])
    units = T.grouped(sums, [[*x, "unit"] for x in sets], [F.sum("total").alias("total"), F.sum("n").alias("n")])
    return table.join(S.mean_interval(units, by, 100.0), by)


METRICS = {"clinical_correctness": ("t0", "t1"), "completeness": ("k0", "k1"), "succinctness": ("u0", "u1"), "hallucination": ("h0", "h1"), "overall_quality": ("q0", "q1")}
_QUALITY = " UNION ALL ".join(f"SELECT '{m}' AS metric, {_COHORT}, {_STRATUM}, item_id, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM pairs" for m, (a, b) in METRICS.items())


@query(twin("pairs", f"""WITH m AS ({_QUALITY}), s AS (SELECT metric, cohort, {_STRATUM}, avg(b-a) AS x FROM m GROUP BY ALL)
    SELECT * FROM (SELECT metric, cohort, count(*) AS n, round(avg(a), 6) AS clean_mean, round(avg(b), 6) AS distracted_mean, round(avg(b-a), 6) AS pooled FROM m GROUP BY ALL)
    JOIN (SELECT metric, cohort, round(avg(x), 6) AS strata FROM s GROUP BY ALL) USING (metric, cohort) JOIN ({bounds_sql(sums_sql('SELECT * FROM m', 'metric, cohort', 'b-a', 'item_id', 1.0), 'metric, cohort')}) USING (metric, cohort)"""))
def quality_long(spark, d):
    """Quality changes by metric and cohort: pooled with interval, and the unweighted mean of strata."""
    by = ["metric", "cohort"]
    long = T.long_metrics(_paired_rows(spark, d), ["cohort", "model", "source_dataset", "distractor_type", "item_id"], METRICS)
    own = long.groupBy(*by, "model", "source_dataset", "distractor_type").agg(F.sum("clean").alias("a"), F.sum("distracted").alias("b"), F.count("*").alias("c"))
    mean = lambda x: F.round(F.sum(x) / F.sum("c"), 6)
    change = F.col("b") - F.col("a")
    table = own.groupBy(*by).agg(F.sum("c").alias("n"), mean(F.col("a")).alias("clean_mean"), mean(F.col("b")).alias("distracted_mean"), mean(change).alias("pooled"), F.round(F.avg(change / F.col("c")), 6).alias("strata"))
    return table.join(S.mean_interval(S.dealt_sums(long, by, F.col("distracted") - F.col("clean"), ["item_id"]), by), by)


@query(twin("pairs", f"WITH l AS (SELECT model, source_dataset, distractor_type, 'a' AS rater, c0 AS x0, c1 AS x1 FROM pairs UNION ALL SELECT model, source_dataset, distractor_type, 'b', b0, b1 FROM pairs), s AS (SELECT rater, model, source_dataset, distractor_type, avg(CAST(x1-x0 AS DOUBLE)) AS v FROM l GROUP BY ALL), t AS (SELECT rater, count(*) FILTER (v < 0) AS n_negative FROM s GROUP BY ALL) SELECT rater, count(*) AS n, {pct('x0')} AS rate_clean, {pct('x1')} AS rate_distracted, {pct('x1-x0')} AS delta_pp, any_value(n_negative) AS n_negative FROM l JOIN t USING (rater) GROUP BY rater"))
def judge_sensitivity(spark, d):
    long = T.long_metrics(view(spark, d, "pairs"), ["model", "source_dataset", "distractor_type"], {"a": ("c0", "c1"), "b": ("b0", "b1")}).withColumnRenamed("metric", "rater")
    own = long.groupBy("rater", "model", "source_dataset", "distractor_type").agg(*[F.sum(c).alias(c) for c in ("clean", "distracted")], F.count("*").alias("c"))
    share = lambda x: F.round(100 * F.sum(x) / F.sum("c"), 6)
    return own.groupBy("rater").agg(F.sum("c").alias("n"), share(F.col("clean")).alias("rate_clean"), share(F.col("distracted")).alias("rate_distracted"), share(F.col("distracted") - F.col("clean")).alias("delta_pp"), F.count_if(F.col("distracted") < F.col("clean")).alias("n_negative"))


_CELLS = "count(*) FILTER (x=1 AND y=1) AS n11, count(*) FILTER (x=1 AND y=0) AS n10, count(*) FILTER (x=0 AND y=1) AS n01, count(*) FILTER (x=0 AND y=0) AS n00"
_KAPPA = "round(100.0*(n11+n00)/n, 6) AS agreement, round(CASE WHEN e < 1 THEN ((n11+n00)/n - e)/(1-e) END, 6) AS kappa"


def _kappa_sql(source: str, group: str, select: str) -> str:
    return f"WITH t AS (SELECT {select} {_CELLS} FROM {source} {group}), u AS (SELECT *, CAST(n11+n10+n01+n00 AS DOUBLE) AS n FROM t), v AS (SELECT *, (CAST((n11+n10)*(n11+n01) + (n01+n00)*(n10+n00) AS DOUBLE))/(n*n) AS e FROM u) SELECT * EXCLUDE (n, e), {_KAPPA} FROM v"


def _cells(x, y):
    return [F.count_if((x == a) & (y == b)).alias(f"n{a}{b}") for a, b in ((1, 1), (1, 0), (0, 1), (0, 0))]


@query(twin("judgments", _kappa_sql("(SELECT condition, contamination AS x, contamination_b AS y FROM judgments)", "GROUP BY GROUPING SETS ((condition), ())", "CASE WHEN grouping(condition)=1 THEN 'all' ELSE condition END AS condition,")))
def kappa(spark, d):
    table = T.grouped(view(spark, d, "judgments"), [["condition"], []], _cells(F.col("contamination"), F.col("contamination_b")))
    agreement, k = S.kappa(*[F.col(c) for c in ("n11", "n10", "n01", "n00")])
    return table.withColumns({"agreement": agreement, "kappa": k})


@query(twin("raters", _kappa_sql("(SELECT paired AS x, single AS y FROM raters)", "", "")))
def rater_agreement(spark, d):
    agreement, k = S.kappa(*[F.col(c) for c in ("n11", "n10", "n01", "n00")])
    return view(spark, d, "raters").agg(*_cells(F.col("paired"), F.col("single"))).withColumns({"agreement": agreement, "kappa": k})


_OUTCOME = "CASE WHEN c1 = 1 AND s1 = 3 THEN 'misattributed' WHEN c1 = 1 AND s1 = 2 THEN 'used' WHEN c1 = 1 AND s1 >= 1 THEN 'recorded_only' ELSE 'none' END"
_OUTCOME_OPEN = "CASE WHEN s1 = 3 THEN 'misattributed' WHEN s1 = 2 THEN 'used' WHEN s1 >= 1 THEN 'recorded_only' ELSE 'none' END"


def _outcomes(pairs, gated=True):
    return pairs.withColumn("outcome", P.outcome(F.col("c1") == 1 if gated else None, F.col("s1") == 2, F.col("s1") == 3, F.col("s1") >= 1))


@query(twin("pairs", f"SELECT source_dataset, item_id, model, distractor_type, {_OUTCOME} AS outcome, {_OUTCOME_OPEN} AS outcome_open FROM pairs"))
def outcome_label(spark, d):
    pairs = _outcomes(_outcomes(view(spark, d, "pairs"), False).withColumnRenamed("outcome", "outcome_open"))
    return pairs.select("source_dataset", "item_id", "model", "distractor_type", "outcome", "outcome_open")


_ATTR_SETS = [[], ["distractor_type"], ["family"], ["model"], ["model", "distractor_type"]]
_KINDS = ("misattributed", "used", "recorded_only")


@query(twin("pairs", f"""WITH r AS (SELECT *, {_COHORT}, {_OUTCOME} AS o, {unit_sql("item_id")} AS unit FROM pairs), l AS (SELECT *, CASE WHEN o = kind THEN 1 ELSE 0 END AS v FROM r, (VALUES ('misattributed'), ('used'), ('recorded_only')) k(kind)),
    t AS (SELECT cohort, kind, {_labels(_DIMS)}, count(*) AS n, CAST(sum(c1) AS BIGINT) AS n_incorporated, count(*) FILTER (c1 = 1 AND s1 >= 1) AS n_judged, {pct('c1')} AS incorporated, {pct('v')} AS pct FROM l GROUP BY {_sets_sql('kind', _ATTR_SETS)}),
    u AS (SELECT cohort, kind, {_labels(_DIMS)}, unit, 100.0e0*sum(v) AS total, count(*) AS n FROM l GROUP BY {_sets_sql('kind, unit', _ATTR_SETS)})
    SELECT * FROM t JOIN ({bounds_sql('SELECT * FROM u', 'kind, ' + _BY)}) USING (kind, {_BY})"""))
def attribution_rates(spark, d):
    """Shares of all pairs by outcome with intervals, by cohort over grouping sets."""
    rows, by = _outcomes(_paired_rows(spark, d)), ["cohort", *_DIMS]
    # One pass over pairs: the kinds are columns of sums by unit, and all that follows works on these few rows.
    cells = [F.count("*").alias("n"), F.sum("c1").alias("c"), F.count_if((F.col("c1") == 1) & (F.col("s1") >= 1)).alias("j"), *[F.count_if(F.col("outcome") == k).alias(k) for k in _KINDS]]
    own = rows.groupBy(*by, S.dealt_unit(["item_id"]).alias("unit")).agg(*cells)
    sets, sums = [["cohort", *x] for x in _ATTR_SETS], [F.sum(c).alias(c) for c in ("n", "c", "j", *_KINDS)]
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in _KINDS])).alias("k")
    share = lambda x: T.sql_round(100 * (F.col(x) / F.col("n")))
    rates = T.grouped(own, sets, sums).select(*by, "n", F.col("c").alias("n_incorporated"), F.col("j").alias("n_judged"), share("c").alias("incorporated"), kinds)
    rates = rates.select(*by, "n", "n_incorporated", "n_judged", "incorporated", F.col("k.kind").alias("kind"), T.sql_round(100 * (F.col("k.v") / F.col("n"))).alias("pct"))
    units = T.grouped(own, [[*x, "unit"] for x in sets], sums).select(*by, "unit", "n", kinds).select(*by, "unit", "n", F.col("k.kind").alias("kind"), F.col("k.v").alias("total"))
    return rates.join(S.mean_interval(units, [*by, "kind"], 100.0), [*by, "kind"])


@query(twin("pairs", f"WITH h AS (SELECT model, distractor_type, {_OUTCOME} AS outcome, {_OUTCOME_OPEN} AS mode FROM pairs), f AS (SELECT * FROM h WHERE outcome IN ('misattributed', 'used')) SELECT model, distractor_type, outcome, mode, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'all', distractor_type, 'both', mode, count(*) FROM f GROUP BY ALL"))
def taxonomy_counts(spark, d):
    """Modes of notes that misattribute or act: by model and outcome, and pooled."""
    both = _outcomes(_outcomes(view(spark, d, "pairs"), False).withColumnRenamed("outcome", "mode"))
    harm = both.filter("outcome in ('misattributed', 'used')")
    pooled = harm.groupBy("distractor_type", "mode").agg(F.count("*").alias("n")).withColumns({"model": F.lit("all"), "outcome": F.lit("both")})
    return harm.groupBy("model", "distractor_type", "outcome", "mode").agg(F.count("*").alias("n")).unionByName(pooled)


@query(twin("pairs", "SELECT model, distractor_type, s1 AS severity, n, round(n / sum(n) OVER (PARTITION BY model, distractor_type), 6) AS share FROM (SELECT model, distractor_type, s1, count(*) AS n FROM pairs GROUP BY ALL)"))
def severity_share(spark, d):
    return T.shares(view(spark, d, "pairs").withColumnRenamed("s1", "severity"), ["model", "distractor_type"], "severity")


@query(twin("pairs", f"SELECT CASE WHEN grouping(model)=1 THEN 'all' ELSE model END AS model, distractor_type, family, count(*) AS n, {pct('CASE WHEN o <> $$none$$ THEN 1 ELSE 0 END')} AS incorporated, {pct('CASE WHEN o = $$misattributed$$ THEN 1 ELSE 0 END')} AS misattributed FROM (SELECT *, {_OUTCOME_OPEN} AS o FROM pairs) GROUP BY GROUPING SETS ((model, distractor_type, family), (distractor_type, family))"))
def outcome_by_class(spark, d):
    rates = [F.count("*").alias("n"), T.pct((F.col("outcome") != "none").cast("int")).alias("incorporated"), T.pct((F.col("outcome") == "misattributed").cast("int")).alias("misattributed")]
    return T.grouped(_outcomes(view(spark, d, "pairs"), False), [["model", "distractor_type", "family"], ["distractor_type", "family"]], rates)


@query(twin("pairs", f"SELECT source_dataset, count(*) AS n, {pct('c1')} AS incorporated, {pct('CASE WHEN s1 = 3 THEN 1 ELSE 0 END')} AS misattributed, {pct('CASE WHEN s1 = 2 THEN 1 ELSE 0 END')} AS acted_on, rank() OVER (ORDER BY {pct('c1')} DESC, source_dataset) AS position FROM pairs GROUP BY source_dataset"))
def topic_outcomes(spark, d):
    from pyspark.sql import Window

    table = view(spark, d, "pairs").groupBy("source_dataset").agg(F.count("*").alias("n"), T.pct(F.col("c1")).alias("incorporated"), T.pct((F.col("s1") == 3).cast("int")).alias("misattributed"), T.pct((F.col("s1") == 2).cast("int")).alias("acted_on"))
    return table.withColumn("position", F.rank().over(Window.orderBy(F.desc("incorporated"), "source_dataset")).cast("long"))  # one row a topic


@query(twin("pairs", f"SELECT CASE WHEN grouping(model)=1 THEN 'all' ELSE model END AS model, CASE WHEN grouping(distractor_type)=1 THEN 'both' ELSE distractor_type END AS distractor_type, count(*) AS n, {pct('CASE WHEN s1 >= 2 THEN 1 ELSE 0 END')} AS acted, {pct('CASE WHEN q1 >= 4 THEN 1 ELSE 0 END')} AS in_plan FROM pairs WHERE c1 = 1 GROUP BY GROUPING SETS ((model, distractor_type), (distractor_type), ())"))
def action_rates(spark, d):
    hit = view(spark, d, "pairs").filter("c1 = 1")
    rates = [F.count("*").alias("n"), T.pct((F.col("s1") >= 2).cast("int")).alias("acted"), T.pct((F.col("q1") >= 4).cast("int")).alias("in_plan")]
    return T.grouped(hit, [["model", "distractor_type"], ["distractor_type"], []], rates).replace({"all": "both"}, subset=["distractor_type"])


@query(twin("pairs", "WITH f AS (SELECT model, family, count(*) AS n, avg(CAST(c1 AS DOUBLE)) AS share FROM pairs GROUP BY ALL) SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(share*n)/sum(n), 6) AS weighted_share FROM f GROUP BY ALL"))
def weighted_share(spark, d):
    own = view(spark, d, "pairs").groupBy("model", "family").agg(F.count("*").alias("n"), F.avg("c1").alias("share"))
    return own.groupBy("model").agg(F.sum("n").alias("n"), T.sql_round(F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("weighted_share"))


@query(twin("pairs", "SELECT model, bin, count(*) AS n, min(chars) AS lo, max(chars) AS hi, round(100*avg(CAST(c1-c0 AS DOUBLE)), 6) AS delta_pp FROM (SELECT *, CAST(greatest(1, ((rn-1)*5 + (n-2)) // greatest(n-1, 1)) AS INT) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY chars, source_dataset, item_id, distractor_type) AS rn, count(*) OVER (PARTITION BY model) AS n FROM pairs)) GROUP BY ALL"))
def length_quintiles(spark, d):
    binned = S.rank_bins(view(spark, d, "pairs"), ["model"], ["chars", "source_dataset", "item_id", "distractor_type"])
    return binned.groupBy("model", "bin").agg(F.count("*").alias("n"), F.min("chars").alias("lo"), F.max("chars").alias("hi"), T.pct(F.col("c1") - F.col("c0")).alias("delta_pp"))


@query(twin("pairs", "SELECT model, distractor_type, source_dataset, item_id, s1 AS severity, chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY model, distractor_type ORDER BY s1 DESC, chars DESC, source_dataset, item_id) AS rank FROM pairs WHERE c0 = 0) WHERE rank <= 3"))
def topk_examples(spark, d):
    order = [F.desc("s1"), F.desc("chars"), F.col("source_dataset"), F.col("item_id")]
    top = T.top_k(view(spark, d, "pairs").filter("c0 = 0"), ["model", "distractor_type"], order, 3)
    return top.select("model", "distractor_type", "source_dataset", "item_id", F.col("s1").alias("severity"), "chars", "rank")


_REQUESTS = [("r1", "m0", None, None), ("r2", None, "bystander", None), ("r3", "m2", "nonliteral", "family_a"), ("r4", None, None, "family_b")]


@query(twin("pairs", "WITH r(request, m, dt, f) AS (VALUES ('r1','m0',NULL,NULL),('r2',NULL,'bystander',NULL),('r3','m2','nonliteral','family_a'),('r4',NULL,NULL,'family_b')) SELECT request, model, distractor_type, source_dataset, item_id FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY s1 DESC, chars DESC, source_dataset, item_id, model, distractor_type) AS k FROM r JOIN pairs ON (m IS NULL OR m = model) AND (dt IS NULL OR dt = distractor_type) AND (f IS NULL OR f = family) WHERE s1 > 0) WHERE k = 1"))
def example_pick(spark, d):
    asked = F.broadcast(spark.createDataFrame(_REQUESTS, "request string, m string, dt string, f string"))  # the four requests above
    fits = [F.col(a).isNull() | (F.col(a) == F.col(b)) for a, b in (("m", "model"), ("dt", "distractor_type"), ("f", "family"))]
    joined = view(spark, d, "pairs").filter("s1 > 0").join(asked, fits[0] & fits[1] & fits[2])
    order = [F.desc("s1"), F.desc("chars"), *map(F.col, ("source_dataset", "item_id", "model", "distractor_type"))]
    return T.top_k(joined, ["request"], order, 1).select("request", "model", "distractor_type", "source_dataset", "item_id")


@query(twin("pairs", "WITH g AS (SELECT model, avg(CAST(c0 AS DOUBLE)) AS inc, avg(CASE WHEN s0 = 3 THEN 1.0 ELSE 0 END) AS mis FROM pairs GROUP BY model), h AS (SELECT model, avg(CAST(c1 AS DOUBLE)) AS inc, avg(CASE WHEN s1 = 3 THEN 1.0 ELSE 0 END) AS mis FROM pairs WHERE model <> 'm3' GROUP BY model) SELECT model, round(g.inc, 6) AS inc_old, round(h.inc, 6) AS inc_new, round(h.inc - g.inc, 6) AS inc_delta, round(g.mis, 6) AS mis_old, round(h.mis, 6) AS mis_new FROM g FULL JOIN h USING (model)"))
def release_compare(spark, d):
    pairs = view(spark, d, "pairs")
    rates = lambda s, t: [F.avg(f"c{s}").alias(f"inc_{t}"), F.avg((F.col(f"s{s}") == 3).cast("int")).alias(f"mis_{t}")]
    both = pairs.groupBy("model").agg(*rates(0, "old")).join(pairs.filter("model <> 'm3'").groupBy("model").agg(*rates(1, "new")), "model", "full_outer")
    both = both.withColumn("inc_delta", F.col("inc_new") - F.col("inc_old"))
    return both.select("model", *[T.sql_round(F.col(c)).alias(c) for c in ("inc_old", "inc_new", "inc_delta", "mis_old", "mis_new")])


@query(twin("judgments", "WITH a AS (SELECT source_dataset, item_id, model, distractor_type, condition, contamination FROM judgments WHERE model <> 'm1'), b AS (SELECT source_dataset, item_id, model, distractor_type, condition, contamination_b FROM judgments WHERE model <> 'm2') SELECT model, condition, count(*) AS n, count(contamination) AS n_a, count(contamination_b) AS n_b, CAST(sum(contamination) AS BIGINT) AS hits_a, CAST(sum(contamination_b) AS BIGINT) AS hits_b FROM a FULL JOIN b USING (source_dataset, item_id, model, distractor_type, condition) GROUP BY ALL"))
def judge_merge(spark, d):
    keys = [*P.KEYS, "condition"]
    rows = view(spark, d, "judgments")
    a, b = (rows.filter(f"model <> '{m}'").select(*keys, c) for m, c in (("m1", "contamination"), ("m2", "contamination_b")))
    merged = P.merge_one_to_one([a, b], keys).groupBy("model", "condition")
    return merged.agg(F.count("*").alias("n"), F.count("contamination").alias("n_a"), F.count("contamination_b").alias("n_b"), F.sum("contamination").alias("hits_a"), F.sum("contamination_b").alias("hits_b"))


@query(twin("judgments", "WITH a AS (SELECT DISTINCT source_dataset, item_id, model FROM judgments WHERE severity < 3), b AS (SELECT DISTINCT source_dataset, item_id, model FROM judgments WHERE severity > 0) SELECT count(*) FILTER (b.model IS NULL) AS left_only, count(*) FILTER (a.model IS NULL) AS right_only, count(*) FILTER (a.model IS NOT NULL AND b.model IS NOT NULL) AS \"both\" FROM a FULL JOIN b ON a.source_dataset=b.source_dataset AND a.item_id=b.item_id AND a.model=b.model"))
def join_audit(spark, d):
    rows = view(spark, d, "judgments")
    return P.join_audit(rows.filter("severity < 3"), rows.filter("severity > 0"), ["source_dataset", "item_id", "model"])


@query(twin("judgments", "SELECT source_dataset, item_id, model, distractor_type, condition FROM judgments a WHERE NOT EXISTS (SELECT 1 FROM judgments b WHERE b.severity <> 1 AND b.overall_quality > 2 AND a.source_dataset=b.source_dataset AND a.item_id=b.item_id AND a.model=b.model AND a.distractor_type=b.distractor_type AND a.condition=b.condition)"))
def resume_antijoin(spark, d):
    keys, rows = [*P.KEYS, "condition"], view(spark, d, "judgments")
    return P.resume(rows.select(*keys), rows.filter("overall_quality > 2"), keys, failed=F.col("severity") == 1)


@query(twin("judgments", "SELECT source_dataset, item_id, model, distractor_type FROM judgments a WHERE condition = 'distracted' AND (source_dataset, item_id, model, distractor_type) IN (SELECT source_dataset, item_id, model, distractor_type FROM judgments WHERE condition = 'distracted' AND contamination = 1)"))
def eligible_semijoin(spark, d):
    distracted = view(spark, d, "judgments").filter("condition = 'distracted'").select(*P.KEYS, "contamination")
    return distracted.select(*P.KEYS).join(distracted.filter("contamination = 1").select(*P.KEYS), P.KEYS, "left_semi")


_FOLD = "WITH base AS (SELECT source_dataset, item_id, model, distractor_type, condition, severity FROM judgments WHERE model <> 'm3'), new AS (SELECT source_dataset, item_id, model, distractor_type, condition, severity + 10 AS severity FROM judgments WHERE overall_quality = 5)"


@query(twin("judgments", f"{_FOLD} SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.source_dataset=b.source_dataset AND n.item_id=b.item_id AND n.model=b.model AND n.distractor_type=b.distractor_type AND n.condition=b.condition) UNION ALL SELECT * FROM new"))
def fold_upsert(spark, d):
    keys, rows = [*P.KEYS, "condition"], view(spark, d, "judgments")
    new = rows.filter("overall_quality = 5").select(*keys, (F.col("severity") + 10).alias("severity"))
    return P.fold(rows.filter("model <> 'm3'").select(*keys, "severity"), new, keys)


@query(twin("judgments", f"{_FOLD} SELECT count(*) FILTER (b.model IS NOT NULL) AS replaced, count(*) FILTER (b.model IS NULL) AS added FROM new n LEFT JOIN base b ON n.source_dataset=b.source_dataset AND n.item_id=b.item_id AND n.model=b.model AND n.distractor_type=b.distractor_type AND n.condition=b.condition"))
def fold_counts(spark, d):
    keys, rows = [*P.KEYS, "condition"], view(spark, d, "judgments")
    return P.fold_counts(rows.filter("model <> 'm3'"), rows.filter("overall_quality = 5"), keys)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, d):
    from .views import table

    return P.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(twin("pairs", "SELECT source_dataset, item_id, model, distractor_type, 'clean' AS condition, c0 AS contamination FROM pairs UNION ALL SELECT source_dataset, item_id, model, distractor_type, 'distracted', c1 FROM pairs"))
def pair_unpivot(spark, d):
    return P.unpivot_sides(view(spark, d, "pairs"), P.KEYS, "c0", "c1", "contamination")


@query(twin("judgments", "SELECT CASE WHEN j.source_dataset IS NULL THEN e.source_dataset ELSE j.source_dataset END AS source_dataset, expected, n, coalesce(n, 0) = expected AS ok FROM (VALUES ('1-URGENT', 100), ('9-NONE', 5)) e(source_dataset, expected) FULL JOIN (SELECT source_dataset, count(DISTINCT item_id) AS n FROM judgments GROUP BY 1) j ON e.source_dataset = j.source_dataset"))
def count_contract(spark, d):
    expected = spark.createDataFrame([("1-URGENT", 100), ("9-NONE", 5)], "source_dataset string, expected int")
    seen = view(spark, d, "judgments").groupBy("source_dataset").agg(F.countDistinct("item_id").alias("n"))
    return expected.join(seen, "source_dataset", "full_outer").withColumn("ok", F.coalesce("n", F.lit(0)) == F.col("expected"))
