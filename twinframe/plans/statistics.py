"""Paired tests, resampling intervals, rank statistics, heads, QA and audio tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinframe.operators import stats as S
from twinframe.operators import tables as T

from .documentation import pct
from .intervals import average_rank_sql, bounds_sql, normal_tail_sql, ratio_sql, replicates_sql, sums_sql, t_table_sql, tail_sql
from .registry import query
from .views import table, twin, view

ARMS = ["none", "interference", "random", "all"]
_VECTORS = "SELECT model, item_id, max(CASE WHEN intervention='none' THEN is_correct END) AS a, max(CASE WHEN intervention='interference' THEN is_correct END) AS b, max(CASE WHEN intervention='random' THEN is_correct END) AS c, max(CASE WHEN intervention='all' THEN is_correct END) AS e FROM item_arms GROUP BY ALL HAVING a+b+c+e IS NOT NULL"
_PAIRED = "count(*) AS n, round(100*avg(CAST(x AS DOUBLE)), 6) AS acc_a, round(100*avg(CAST(y AS DOUBLE)), 6) AS acc_b, round(100*(avg(CAST(x AS DOUBLE))-avg(CAST(y AS DOUBLE))), 6) AS drop_pp, round(100*sqrt(greatest((avg(CAST(x AS DOUBLE))*(1-avg(CAST(x AS DOUBLE))) + avg(CAST(y AS DOUBLE))*(1-avg(CAST(y AS DOUBLE))) - 2*(avg(CAST(x*y AS DOUBLE)) - avg(CAST(x AS DOUBLE))*avg(CAST(y AS DOUBLE))))/count(*), 0)), 6) AS se_pp"
_MCNEMAR = "CASE WHEN b01+b10 = 0 THEN 1.0 ELSE least(1.0, 2*list_sum(list_transform(range(0, least(b01,b10)+1), lambda i: exp(lgamma(b01+b10+1)-lgamma(i+1)-lgamma(b01+b10-i+1)+(b01+b10)*ln(0.5))))) END"


def arms(spark, d):
    wide = view(spark, d, "item_arms").groupBy("model", "item_id").agg(*[F.max(F.when(F.col("intervention") == a, F.col("is_correct"))).alias(a) for a in ARMS])
    return wide.dropna(subset=ARMS)


@query(twin("item_arms", f"SELECT model, item_id, a AS \"none\", b AS interference, c AS random, e AS \"all\" FROM ({_VECTORS})"))
def item_vectors(spark, d):
    return arms(spark, d)


@query(twin("item_arms", f"SELECT model, {_PAIRED} FROM (SELECT model, a AS x, b AS y FROM ({_VECTORS})) GROUP BY model"))
def paired_diff(spark, d):
    return arms(spark, d).groupBy("model").agg(*S.paired_difference(F.col("none"), F.col("interference")))


@query(twin("item_arms", f"WITH t AS (SELECT model, count(*) FILTER (a=0 AND b=1) AS b01, count(*) FILTER (a=1 AND b=0) AS b10 FROM ({_VECTORS}) GROUP BY model) SELECT model, b01, b10, round({_MCNEMAR} + 1e-10, 6) AS p FROM t"))
def mcnemar(spark, d):
    cells = arms(spark, d).groupBy("model").agg(F.count_if(F.expr("`none` = 0 and interference = 1")).alias("b01"), F.count_if(F.expr("`none` = 1 and interference = 0")).alias("b10"))
    return cells.withColumn("p", S.rounded(S.mcnemar(F.col("b01"), F.col("b10"))))


_SIDES = (("interference", "none", "interference"), ("random", "none", "random"), ("all", "none", "all"), ("interference_vs_random", "random", "interference"))
_LONG = f"SELECT model, item_id, arm, x, y FROM ({_VECTORS}), LATERAL (VALUES ('interference', a, b), ('random', a, c), ('all', a, e), ('interference_vs_random', c, b)) s(arm, x, y)"


@query(twin("item_arms", f"WITH l AS ({_LONG}), t AS (SELECT model, arm, {_PAIRED}, count(*) FILTER (x=0 AND y=1) AS b01, count(*) FILTER (x=1 AND y=0) AS b10 FROM l GROUP BY ALL) SELECT *, round({_MCNEMAR} + 1e-10, 6) AS p FROM t JOIN ({bounds_sql(sums_sql('SELECT * FROM l', 'model, arm', 'x-y', 'item_id'), 'model, arm')}) USING (model, arm)"))
def intervention_contrast(spark, d):
    """Each arm against no intervention, and interference against random: paired loss, its interval and exact p."""
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.col(a).alias("x"), F.col(b).alias("y")) for n, a, b in _SIDES]))
    long = arms(spark, d).select("model", "item_id", sides.alias("s")).select("model", "item_id", "s.*")
    cells = long.groupBy("model", "arm").agg(*S.paired_difference(F.col("x"), F.col("y")), F.count_if(F.expr("x = 0 and y = 1")).alias("b01"), F.count_if(F.expr("x = 1 and y = 0")).alias("b10"))
    interval = S.mean_interval(S.dealt_sums(long, ["model", "arm"], F.col("x") - F.col("y"), ["item_id"]), ["model", "arm"], 100.0)
    return cells.withColumn("p", S.rounded(S.mcnemar(F.col("b01"), F.col("b10")))).join(interval, ["model", "arm"])


_BASE_LONG = f"SELECT *, CAST(item_id % 10 = 0 AS INT) AS heldout FROM (SELECT model, item_id, distractor, x, y FROM ({_VECTORS}), LATERAL (VALUES ('interference', a, b), ('random', a, c)) s(distractor, x, y))"
_BASE_PARTS = "SELECT 'heldout' AS part, model, distractor, item_id, x, y FROM l WHERE heldout = 1 UNION ALL SELECT 'all', model, distractor, item_id, x, y FROM l"


@query(twin("item_arms", f"WITH l AS ({_BASE_LONG}), p AS ({_BASE_PARTS}), t AS (SELECT model, distractor, part, {_PAIRED}, count(*) FILTER (x=0 AND y=1) AS b01, count(*) FILTER (x=1 AND y=0) AS b10 FROM p GROUP BY ALL) SELECT *, round({_MCNEMAR} + 1e-10, 6) AS p FROM t JOIN ({bounds_sql(sums_sql('SELECT * FROM p', 'model, distractor, part', 'x-y', 'item_id'), 'model, distractor, part')}) USING (model, distractor, part)"))
def baseline_drop(spark, d):
    """The baseline of each model and distractor, on held-out items and on all: accuracies, paired loss, its standard error, interval and exact p."""
    by = ["model", "distractor", "part"]
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("distractor"), F.col(n).alias("y")) for n in ("interference", "random")])).alias("s")
    parts = F.explode(F.when(F.col("item_id") % 10 == 0, F.array(F.lit("heldout"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("part")
    long = arms(spark, d).select("model", "item_id", F.col("none").alias("x"), sides).select("model", "item_id", "x", "s.*", parts)
    cells = long.groupBy(*by).agg(*S.paired_difference(F.col("x"), F.col("y")), F.count_if(F.expr("x = 0 and y = 1")).alias("b01"), F.count_if(F.expr("x = 1 and y = 0")).alias("b10"))
    interval = S.mean_interval(S.dealt_sums(long, by, F.col("x") - F.col("y"), ["item_id"]), by, 100.0)
    return cells.withColumn("p", S.rounded(S.mcnemar(F.col("b01"), F.col("b10")))).join(interval, by)


_CLUSTERS = "SELECT model, distractor_type, item_id, sum(CAST(c1-c0 AS DOUBLE)) AS total, CAST(count(c1-c0) AS DOUBLE) AS n FROM pairs GROUP BY ALL"


@query(twin("pairs", ratio_sql(f"SELECT *, total/n AS mean, 1.0e0 AS one FROM ({_CLUSTERS})", "model, distractor_type", "item_id", "mean", "one", 2000, 0)))
def cluster_bootstrap_mean(spark, d):
    return S.bootstrap_cluster_mean(view(spark, d, "pairs"), ["model", "distractor_type"], "item_id", F.col("c1") - F.col("c0"))


@query(twin("pairs", ratio_sql(_CLUSTERS.replace("model, distractor_type, item_id", "family, item_id"), "family", "item_id", "total", "n", 5000, 20261002)))
def cluster_bootstrap_ratio(spark, d):
    return S.bootstrap_cluster_ratio(view(spark, d, "pairs"), ["family"], "item_id", F.col("c1") - F.col("c0"), replicates=5000, seed=20261002)


@query(twin("item_arms", ratio_sql(f"SELECT model, item_id, CAST(b-a AS DOUBLE) AS v, 1.0e0 AS one FROM ({_VECTORS})", "model", "item_id", "v", "one", 2000, 5)))
def bootstrap_ci(spark, d):
    rows = arms(spark, d).select("model", "item_id", (F.col("interference") - F.col("none")).cast("double").alias("v"), F.lit(1.0).alias("one"))
    return S.bootstrap_ratio(rows, ["model"], "item_id", "v", "one", seed=5)


@query()
def numpy_intervals(spark, d):
    """The contrast of each model and distractor with numpy's own draws. No twin: SQL has no such generator; tested against numpy."""
    keys = ["source_dataset", "item_id"]
    return S.numpy_interval(view(spark, d, "pairs"), ["model", "distractor_type"], F.col("c1") - F.col("c0"), keys)


_RHO_P = "CASE WHEN n > 2 THEN CASE WHEN abs(rho) >= 1 THEN 0.0 ELSE " + tail_sql("(rho*sqrt((n-2)/(1-rho*rho)))", "(n-2)") + " END END"


def _spearman_sql(rows: str, group: str, x: str, y: str) -> str:
    ranks = f"SELECT {group}, {average_rank_sql(group, x)} AS x, {average_rank_sql(group, y)} AS y FROM ({rows})"
    return f"SELECT {group}, n, round(rho, 6) AS rho, round({_RHO_P}, 6) AS p FROM (SELECT {group}, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS rho FROM ({ranks}) GROUP BY ALL)"


@query(twin("pairs", _spearman_sql("SELECT * FROM pairs", "source_dataset", "chars", "s1")))
def spearman(spark, d):
    return S.spearman(view(spark, d, "pairs"), ["source_dataset"], "chars", "s1")


@query("SELECT l_returnflag, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(rho, 6) AS r, round(r2, 6) AS r2, round(stderr, 6) AS stderr, round(" + _RHO_P + ", 6) AS p FROM (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_extendedprice, l_quantity) AS rho, regr_r2(l_extendedprice, l_quantity) AS r2, sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity)*regr_sxy(l_extendedprice, l_quantity)/regr_sxx(l_extendedprice, l_quantity))/(count(*)-2)/regr_sxx(l_extendedprice, l_quantity)) AS stderr FROM lineitem GROUP BY l_returnflag)")
def ols(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*S.ols(F.col("l_extendedprice"), F.col("l_quantity")))


_WELCH = "WITH m AS (SELECT model, avg(CAST(q1-q0 AS DOUBLE)) FILTER (f) AS ma, avg(CAST(q1-q0 AS DOUBLE)) FILTER (NOT f) AS mb, var_samp(q1-q0) FILTER (f)/count(*) FILTER (f) AS va, var_samp(q1-q0) FILTER (NOT f)/count(*) FILTER (NOT f) AS vb, count(*) FILTER (f) AS na, count(*) FILTER (NOT f) AS nb FROM (SELECT *, family='family_a' AS f FROM pairs) GROUP BY model), s AS (SELECT model, (ma-mb)/sqrt(va+vb) AS t, (va+vb)*(va+vb)/(va*va/(na-1)+vb*vb/(nb-1)) AS df FROM m), q AS (SELECT *, " + tail_sql("t", "df") + " AS p FROM s) SELECT model, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p, round(CASE WHEN t < 0 THEN p/2 ELSE 1 - p/2 END, 6) AS p_less FROM q"


@query(twin("pairs", _WELCH))
def welch_stat(spark, d):
    return view(spark, d, "pairs").groupBy("model").agg(*S.welch((F.col("q1") - F.col("q0")).cast("double"), F.col("family") == "family_a"))


_BRANDS = "SELECT p_brand, count(*) FILTER (l_returnflag='R') AS b01, count(*) FILTER (l_returnflag='A') AS b10 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"


@query(f"WITH t AS ({_BRANDS}), p AS (SELECT p_brand, {_MCNEMAR} AS p FROM t), r AS (SELECT *, row_number() OVER (ORDER BY p, p_brand) AS r, count(*) OVER () AS n FROM p) SELECT p_brand, round(p + 1e-10, 6) AS p, round(1e-10 + least(1.0, greatest(0.0, min(p*n/r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))), 6) AS q FROM r")
def bh_fdr(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cells = rows.groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("b01"), F.count_if(F.col("l_returnflag") == "A").alias("b10"))
    done = S.benjamini_hochberg(cells.withColumn("p", S.mcnemar(F.col("b01"), F.col("b10"))), "p")
    return done.select("p_brand", *[S.rounded(F.col(c)).alias(c) for c in ("p", "q")])


_SIGNED = f"""WITH z AS (SELECT model, distractor_type, q1-q0 AS d, abs(q1-q0) AS a FROM pairs WHERE q1 <> q0), r AS (SELECT *, {average_rank_sql('model, distractor_type', 'a')} AS r FROM z),
 c AS (SELECT model, distractor_type, sum(CAST(k AS DOUBLE)*k*k - k) AS ties FROM (SELECT model, distractor_type, a, count(*) AS k FROM z GROUP BY ALL) GROUP BY ALL),
 w AS (SELECT model, distractor_type, count(*) AS n, sum(CASE WHEN d>0 THEN r ELSE 0 END) AS p, sum(CASE WHEN d<0 THEN r ELSE 0 END) AS m, any_value(ties) AS ties FROM r JOIN c USING (model, distractor_type) GROUP BY ALL),
 v AS (SELECT *, least(p, m) AS w, (least(p, m) - n*(n+1)/4.0e0)/sqrt((CAST(n AS DOUBLE)*(n+1)*(2*n+1) - ties/2)/24) AS zz FROM w)
 SELECT model, distractor_type, coalesce(n, 0) AS n_nonzero, round(coalesce(p, 0), 6) AS w_plus, round(coalesce(m, 0), 6) AS w_minus, round(coalesce(w, 0), 6) AS w, round(coalesce({normal_tail_sql('zz')}, 1.0), 6) AS p FROM (SELECT DISTINCT model, distractor_type FROM pairs) LEFT JOIN v USING (model, distractor_type)"""


@query(twin("pairs", _SIGNED))
def wilcoxon_w(spark, d):
    return S.wilcoxon(view(spark, d, "pairs").withColumn("d", F.col("q1") - F.col("q0")), ["model", "distractor_type"], "d")


_LEVELS = "SELECT *, CASE WHEN family = 'family_a' THEN '-5' ELSE '-10' END AS level FROM pairs"


_CUBE = "CASE WHEN grouping(level)=1 THEN 'all' ELSE level END AS level, CASE WHEN grouping(model)=1 THEN 'all' ELSE model END AS model"
_CUBE_SETS = "GROUPING SETS ((level, model{0}), (level{0}), (model{0}), ({1}))"
_CUBE_UNITS = f"SELECT {_CUBE}, item_id, 100.0e0*avg(CAST(c1 AS DOUBLE)) AS m, 100.0e0*avg(CAST(c1-c0 AS DOUBLE)) AS dm, 1.0e0 AS one FROM l GROUP BY {_CUBE_SETS.format(', item_id', 'item_id')}"


@query(twin("pairs", f"""WITH l AS ({_LEVELS}), c AS ({_CUBE_UNITS}), r AS (SELECT {_CUBE}, count(*) AS n_pairs, {pct('c0')} AS rate_clean, round(avg(CAST(s1 AS DOUBLE)), 6) AS severity FROM l GROUP BY {_CUBE_SETS.format('', '')}),
    k AS (SELECT level, model, count(*) AS n_clusters, round(avg(m), 6) AS rate_mixed, round(avg(dm), 6) AS delta_pp FROM c GROUP BY ALL)
    SELECT * FROM r JOIN k USING (level, model) JOIN ({bounds_sql('SELECT * FROM c', 'level, model', 'item_id', 'dm', 'one')}) USING (level, model)"""))
def cluster_rates_cube(spark, d):
    """Rates by level and model with all pooled rows; the mixed rate and the contrast are means of cluster means, with its interval."""
    rows = view(spark, d, "pairs").withColumn("level", F.when(F.col("family") == "family_a", "-5").otherwise("-10"))
    # Cluster means of each grouping first, their mean second: the mean of means is not the mean of rows.
    # Spread by explode, which leaves rows where they are dealt by item; grouping sets would shuffle four rows for each one.
    every = F.lit("all")
    cells = [F.struct(x.alias("level"), y.alias("model")) for x in (F.col("level"), every) for y in (F.col("model"), every)]
    sums = lambda df: df.groupBy("level", "model", "item_id").agg(*[F.sum(c).alias(c) for c in ("n", "c0", "c1", "s1")])
    own = sums(rows.withColumn("n", F.lit(1).cast("long"))).withColumn("at", F.explode(F.array(*cells)))
    per = sums(own.select("at.level", "at.model", "item_id", "n", "c0", "c1", "s1")).withColumns({"m": 100 * F.col("c1") / F.col("n"), "dm": 100 * (F.col("c1") - F.col("c0")) / F.col("n"), "one": F.lit(1.0)})
    mean = lambda c: F.round(F.sum(c) / F.sum("n"), 6)
    table = per.groupBy("level", "model").agg(F.sum("n").alias("n_pairs"), mean(100 * F.col("c0")).alias("rate_clean"), mean(F.col("s1")).alias("severity"), F.count("*").alias("n_clusters"), F.round(F.avg("m"), 6).alias("rate_mixed"), F.round(F.avg("dm"), 6).alias("delta_pp"))
    interval = S.bootstrap_ratio(per, ["level", "model"], "item_id", "dm", "one").select("level", "model", F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    return table.join(interval, ["level", "model"])


@query(twin("pairs", _spearman_sql("SELECT * FROM pairs", "family, model", "s0", "s1")))
def conditional_spearman(spark, d):
    """Rank correlation of leakage and outcome within each level."""
    return S.spearman(view(spark, d, "pairs"), ["family", "model"], "s0", "s1")


@query(twin("pairs", f"SELECT source_dataset, s0 > 0 AS leaked, count(*) AS n, {pct('c1')} AS rate FROM pairs GROUP BY ALL"))
def conditional_rates(spark, d):
    return view(spark, d, "pairs").groupBy("source_dataset", (F.col("s0") > 0).alias("leaked")).agg(F.count("*").alias("n"), T.pct(F.col("c1")).alias("rate"))


@query(twin("pairs", "WITH m AS (SELECT source_dataset, 'overall_quality' AS metric, q1-q0 AS x FROM pairs UNION ALL SELECT source_dataset, 'completeness', k1-k0 FROM pairs) SELECT CASE WHEN grouping(source_dataset)=1 THEN 'all' ELSE source_dataset END AS source_dataset, metric, count(x) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS delta FROM m GROUP BY GROUPING SETS ((source_dataset, metric), (metric)) HAVING count(x) > 0"))
def quality_by_level(spark, d):
    long = T.long_metrics(view(spark, d, "pairs"), ["source_dataset"], {"overall_quality": ("q0", "q1"), "completeness": ("k0", "k1")}).withColumn("x", F.col("distracted") - F.col("clean"))
    return T.grouped(long, [["source_dataset", "metric"], ["metric"]], [F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("delta")]).filter("n > 0")


# Heads -----------------------------------------------------------------------------------------------------------------


@query(twin("head_masks", "SELECT model, distractor, count(*) AS n, count(*) FILTER (gate < 0.5) AS n_selected, round(100.0*count(*) FILTER (gate < 0.5)/count(*), 6) AS pct_selected, min(gate) AS gate_min, round(quantile_cont(gate, 0.5), 6) AS gate_median, round(avg(gate), 6) AS gate_mean, max(gate) AS gate_max FROM head_masks GROUP BY ALL"))
def sparsity(spark, d):
    selected = F.col("gate") < 0.5
    stats = [F.count("*").alias("n"), F.count_if(selected).alias("n_selected"), T.pct(selected.cast("int")).alias("pct_selected"), F.min("gate").alias("gate_min"), F.round(F.percentile("gate", F.lit(0.5)), 6).alias("gate_median"), F.round(F.avg("gate"), 6).alias("gate_mean"), F.max("gate").alias("gate_max")]
    return view(spark, d, "head_masks").groupBy("model", "distractor").agg(*stats)


@query(twin("head_masks", "WITH g AS (SELECT model, distractor, unnest(range(0, 8)) AS layer FROM (SELECT DISTINCT model, distractor FROM head_masks)), c AS (SELECT model, distractor, layer, count(*) AS n FROM head_masks WHERE gate < 0.1 GROUP BY ALL) SELECT model, distractor, CAST(g.layer AS INT) AS layer, coalesce(n, 0) AS n_selected, round(g.layer/7.0, 6) AS depth, CASE WHEN g.layer/7.0 <= 1/3.0 THEN 'early' WHEN g.layer/7.0 <= 2/3.0 THEN 'middle' ELSE 'late' END AS third FROM g LEFT JOIN c USING (model, distractor, layer)"))
def layer_profile(spark, d):
    masks = view(spark, d, "head_masks")
    grid = masks.select("model", "distractor").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("layer"))
    counts = masks.filter("gate < 0.1").groupBy("model", "distractor", "layer").agg(F.count("*").alias("n"))
    depth = F.col("layer") / F.lit(7.0)
    third = F.when(depth <= 1 / 3, "early").when(depth <= 2 / 3, "middle").otherwise("late")
    return grid.join(counts, ["model", "distractor", "layer"], "left").select("model", "distractor", "layer", F.coalesce("n", F.lit(0)).alias("n_selected"), F.round(depth, 6).alias("depth"), third.alias("third"))


@query(twin("head_masks", "WITH a AS (SELECT model, layer, head FROM head_masks WHERE distractor='nonliteral' GROUP BY ALL HAVING avg(gate) < 0.5), b AS (SELECT model, layer, head FROM head_masks WHERE distractor='bystander' GROUP BY ALL HAVING avg(gate) < 0.5), j AS (SELECT coalesce(a.model, b.model) AS model, a.model IS NOT NULL AS l, b.model IS NOT NULL AS r FROM a FULL JOIN b ON a.model=b.model AND a.layer=b.layer AND a.head=b.head) SELECT model, count(*) FILTER (l) AS n_a, count(*) FILTER (r) AS n_b, count(*) FILTER (l AND r) AS n_both, count(*) AS n_union, round(count(*) FILTER (l AND r)/CAST(count(*) AS DOUBLE), 6) AS jaccard, count(*) FILTER (l AND NOT r) = 0 AS subset FROM j GROUP BY model"))
def set_overlap(spark, d):
    chosen = view(spark, d, "head_masks").groupBy("model", "distractor", "layer", "head").agg(F.avg("gate").alias("g")).filter("g < 0.5")
    marks = chosen.groupBy("model", "layer", "head").agg(F.max(F.col("distractor") == "nonliteral").alias("l"), F.max(F.col("distractor") == "bystander").alias("r"))
    both = F.count_if(F.col("l") & F.col("r"))
    return marks.groupBy("model").agg(F.count_if("l").alias("n_a"), F.count_if("r").alias("n_b"), both.alias("n_both"), F.count("*").alias("n_union"), F.round(both / F.count("*"), 6).alias("jaccard"), (F.count_if(F.col("l") & ~F.col("r")) == 0).alias("subset"))


#: Seeds are dealt to RUNS training runs; a run selects the heads whose mean gate is under the cutoff.
RUNS = 12
_PICKS = f"SELECT model, distractor, seed % {RUNS} AS run, layer, head FROM head_masks GROUP BY ALL HAVING avg(gate) < 0.48"


@query(twin("head_masks", f"WITH s AS ({_PICKS}), n AS (SELECT model, distractor, run, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT a.model, a.distractor, a.run AS run_a, b.run AS run_b, count(*) AS k FROM s a JOIN s b ON a.model=b.model AND a.distractor=b.distractor AND a.layer=b.layer AND a.head=b.head AND a.run < b.run GROUP BY ALL), p AS (SELECT a.model, a.distractor, a.run AS run_a, b.run AS run_b, a.n + b.n AS sizes FROM n a JOIN n b ON a.model=b.model AND a.distractor=b.distractor AND a.run < b.run) SELECT model, distractor, run_a, run_b, round(coalesce(k,0)/CAST(sizes - coalesce(k,0) AS DOUBLE), 6) AS jaccard FROM p LEFT JOIN i USING (model, distractor, run_a, run_b)"))
def pairwise_jaccard(spark, d):
    return _run_pairs(spark, d).select("model", "distractor", "run_a", "run_b", F.round("jaccard", 6).alias("jaccard"))


def _run_sets(spark, d):
    """(model, distractor, run, s): the heads each run selects; all rows enter a mean, and there are at most RUNS sets a group."""
    picks = view(spark, d, "head_masks").groupBy("model", "distractor", (F.col("seed") % RUNS).alias("run"), "layer", "head").agg(F.avg("gate").alias("g")).filter("g < 0.48")
    return picks.groupBy("model", "distractor", "run").agg(F.collect_set(F.col("layer") * 8 + F.col("head")).alias("s"))


def _run_pairs(spark, d):
    a, b = _run_sets(spark, d).alias("a"), _run_sets(spark, d).alias("b")
    pairs = a.join(b, (F.col("a.model") == F.col("b.model")) & (F.col("a.distractor") == F.col("b.distractor")) & (F.col("a.run") < F.col("b.run")))
    share = F.size(F.array_intersect("a.s", "b.s")) / F.size(F.array_union("a.s", "b.s"))
    return pairs.select("a.model", "a.distractor", F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b"), share.alias("jaccard"))


_PUBLISHED = "SELECT model, distractor, layer, head FROM head_masks GROUP BY ALL HAVING avg(gate) < 0.49"


@query(twin("head_masks", f"""WITH s AS ({_PICKS}), pub AS ({_PUBLISHED}), n AS (SELECT model, distractor, run, count(*) AS n FROM s GROUP BY ALL), pn AS (SELECT model, distractor, count(*) AS n_published FROM pub GROUP BY ALL),
    i AS (SELECT a.model, a.distractor, a.run AS run_a, b.run AS run_b, count(*) AS k FROM s a JOIN s b ON a.model=b.model AND a.distractor=b.distractor AND a.layer=b.layer AND a.head=b.head AND a.run < b.run GROUP BY ALL),
    p AS (SELECT a.model, a.distractor, a.run AS run_a, b.run AS run_b, a.n + b.n AS sizes FROM n a JOIN n b ON a.model=b.model AND a.distractor=b.distractor AND a.run < b.run),
    j AS (SELECT model, distractor, round(avg(x), 6) AS jaccard_mean, round(min(x), 6) AS jaccard_min, round(max(x), 6) AS jaccard_max FROM (SELECT model, distractor, coalesce(k,0)/CAST(sizes - coalesce(k,0) AS DOUBLE) AS x FROM p LEFT JOIN i USING (model, distractor, run_a, run_b)) GROUP BY ALL),
    z AS (SELECT model, distractor, count(*) AS n_runs, round(avg(n), 6) AS heads_mean, min(n) AS heads_min, max(n) AS heads_max FROM n GROUP BY ALL),
    h AS (SELECT s.model, s.distractor, s.layer, s.head, count(*) AS hits, bool_or(pub.model IS NOT NULL) AS published FROM s LEFT JOIN pub ON s.model=pub.model AND s.distractor=pub.distractor AND s.layer=pub.layer AND s.head=pub.head GROUP BY ALL),
    u AS (SELECT model, distractor, count(*) FILTER (hits = n_runs) AS n_all_runs, count(*) AS n_union, CASE WHEN any_value(n_runs) > 1 THEN count(*) FILTER (hits >= 2 AND published) END AS n_recovered FROM h JOIN z USING (model, distractor) GROUP BY ALL),
    q AS (SELECT s.model, s.distractor, s.run, count(pub.model) AS k FROM s LEFT JOIN pub ON s.model=pub.model AND s.distractor=pub.distractor AND s.layer=pub.layer AND s.head=pub.head GROUP BY ALL),
    r AS (SELECT model, distractor, round(avg(x), 6) AS published_mean, round(min(x), 6) AS published_min, round(max(x), 6) AS published_max FROM (SELECT model, distractor, k/CAST(n + coalesce(n_published, 0) - k AS DOUBLE) AS x FROM q JOIN n USING (model, distractor, run) LEFT JOIN pn USING (model, distractor)) GROUP BY ALL)
    SELECT *  EXCLUDE (n_published), coalesce(n_published, 0) AS n_published FROM z JOIN u USING (model, distractor) JOIN r USING (model, distractor) LEFT JOIN j USING (model, distractor) LEFT JOIN pn USING (model, distractor)"""))
def run_stability(spark, d):
    """Stability over runs against the set of all seeds together."""
    published = view(spark, d, "head_masks").groupBy("model", "distractor", "layer", "head").agg(F.avg("gate").alias("g")).filter("g < 0.49")
    return S.set_stability(_run_sets(spark, d), published.groupBy("model", "distractor").agg(F.collect_set(F.col("layer") * 8 + F.col("head")).alias("p")), ["model", "distractor"], "run")


@query(twin("head_masks", "WITH s AS (SELECT model, distractor, layer, head, count(*) FILTER (gate < 0.35) AS hits, count(DISTINCT seed) AS n FROM head_masks GROUP BY ALL) SELECT model, distractor, max(n) AS n_seeds, count(*) FILTER (hits = n) AS n_all_seeds, count(*) FILTER (hits > 0) AS n_union, count(*) FILTER (hits >= 2) AS n_recovered, round(sum(hits)/CAST(max(n) AS DOUBLE), 6) AS mean_heads, min(hits) AS min_hits, max(hits) AS max_hits FROM s GROUP BY ALL"))
def seed_stability(spark, d):
    per = view(spark, d, "head_masks").groupBy("model", "distractor", "layer", "head").agg(F.count_if(F.col("gate") < 0.35).alias("hits"), F.count_distinct("seed").alias("n"))
    return per.groupBy("model", "distractor").agg(F.max("n").alias("n_seeds"), F.count_if(F.col("hits") == F.col("n")).alias("n_all_seeds"), F.count_if(F.col("hits") > 0).alias("n_union"), F.count_if(F.col("hits") >= 2).alias("n_recovered"), F.round(F.sum("hits") / F.max("n"), 6).alias("mean_heads"), F.min("hits").alias("min_hits"), F.max("hits").alias("max_hits"))


@query(twin("head_masks", "SELECT model, bin, CAST(sum(k) AS BIGINT) AS n_selected, round(sum(k)/sum(sum(k)) OVER (PARTITION BY model), 6) AS share FROM (SELECT model, CAST(least(floor(layer/7.0*5), 4) AS INT) AS bin, count(*) FILTER (gate < 0.3) AS k FROM head_masks GROUP BY ALL) GROUP BY model, bin"))
def depth_histogram(spark, d):
    binned = view(spark, d, "head_masks").filter("gate < 0.3").withColumn("bin", F.least(F.floor(F.col("layer") / 7 * 5), F.lit(4)).cast("int"))
    return T.shares(binned, ["model"], "bin").withColumnRenamed("n", "n_selected")


@query(twin("head_masks", "SELECT model, gate, n, CAST(sum(n) OVER (PARTITION BY model ORDER BY gate) AS BIGINT) AS n_up_to, sum(n) OVER (PARTITION BY model ORDER BY gate)/CAST(sum(n) OVER (PARTITION BY model) AS DOUBLE) AS ecdf FROM (SELECT model, gate, count(*) AS n FROM head_masks GROUP BY ALL)"))
def ecdf(spark, d):
    """How many heads have a gate up to each value, over all layers, and their share."""
    values = view(spark, d, "head_masks").groupBy("model", "gate").agg(F.count("*").alias("n"))
    return S.numbered(values, ["model"], ["gate"], "n", "__k").select("model", "gate", "n", F.col("__k").alias("n_up_to"), (F.col("__k") / F.col("__k_all")).alias("ecdf"))


@query(twin("head_masks", "SELECT model, distractor, round(avg(gate) FILTER (layer < 2), 6) AS mean_a, round(avg(gate) FILTER (layer >= 2), 6) AS mean_b, round(avg(gate) FILTER (layer < 2)/nullif(avg(gate) FILTER (layer >= 2), 0), 6) AS ratio FROM head_masks GROUP BY ALL"))
def group_ratio(spark, d):
    a, b = F.avg(F.when(F.col("layer") < 2, F.col("gate"))), F.avg(F.when(F.col("layer") >= 2, F.col("gate")))
    return view(spark, d, "head_masks").groupBy("model", "distractor").agg(F.round(a, 6).alias("mean_a"), F.round(b, 6).alias("mean_b"), F.round(F.try_divide(a, b), 6).alias("ratio"))


@query(twin("head_masks", "WITH g AS (SELECT model, distractor, layer, avg(gate) AS x FROM head_masks GROUP BY ALL) SELECT model, distractor, layer, round(x - first_value(x) OVER (PARTITION BY model, distractor ORDER BY layer), 6) AS delta FROM g"))
def ref_delta(spark, d):
    own = view(spark, d, "head_masks").groupBy("model", "distractor", "layer").agg(F.avg("gate").alias("x"))
    base = F.max(F.when(F.col("layer") == 0, F.col("x"))).over(Window.partitionBy("model", "distractor"))
    return own.select("model", "distractor", "layer", F.round(F.col("x") - base, 6).alias("delta"))


_CONTROL = "WITH m AS (SELECT *, gate < 0.2 AS sel, md5(concat_ws('|', '3', model, CAST(seed AS STRING), CAST(layer AS STRING), CAST(head AS STRING))) AS h FROM head_masks), n AS (SELECT model, seed, count(*) FILTER (sel) AS k FROM m GROUP BY ALL), r AS (SELECT model, seed, layer, head, row_number() OVER (PARTITION BY model, seed ORDER BY h) AS r FROM m WHERE NOT sel) SELECT model, seed, layer, head FROM r JOIN n USING (model, seed) WHERE r <= k"


@query(twin("head_masks", _CONTROL))
def matched_control(spark, d):
    masks = view(spark, d, "head_masks").withColumn("sel", F.col("gate") < 0.2)
    hashed = F.md5(F.concat_ws("|", F.lit("3"), *[F.col(c).cast("string") for c in ("model", "seed", "layer", "head")]))
    sized = masks.withColumn("k", F.count_if("sel").over(Window.partitionBy("model", "seed")))
    ranked = sized.filter("not sel").withColumn("r", F.row_number().over(Window.partitionBy("model", "seed").orderBy(hashed)))
    return ranked.filter("r <= k").select("model", "seed", "layer", "head")


@query(twin("head_masks", "SELECT model, seed, layer, head, scale, CASE WHEN gate < 0.5 THEN scale ELSE 1.0 END AS gate FROM head_masks, (VALUES (0.0e0), (0.5e0), (1.5e0)) s(scale)"))
def scaled_gates(spark, d):
    scales = F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.5)))).alias("scale")
    rows = view(spark, d, "head_masks").select("*", scales)
    return rows.select("model", "seed", "layer", "head", "scale", F.when(F.col("gate") < 0.5, F.col("scale")).otherwise(1.0).alias("gate"))


# Question answering ----------------------------------------------------------------------------------------------------

CONDITIONS = ["clean", "nonliteral", "bystander"]
_QA = "SELECT engine, item_id, " + ", ".join(f"max(CASE WHEN condition='{c}' THEN is_correct END) AS {c[0]}_ok, max(CASE WHEN condition='{c}' THEN is_invalid END) AS {c[0]}_bad" for c in CONDITIONS) + " FROM qa_per_item GROUP BY ALL HAVING c_ok+n_ok+b_ok IS NOT NULL"


def qa_wide(spark, d):
    cells = [F.max(F.when(F.col("condition") == c, F.col(v))).alias(f"{c[0]}_{n}") for c in CONDITIONS for v, n in (("is_correct", "ok"), ("is_invalid", "bad"))]
    return view(spark, d, "qa_per_item").groupBy("engine", "item_id").agg(*cells).dropna(subset=["c_ok", "n_ok", "b_ok"])


_LOSS = "SELECT engine, item_id, 'nonliteral' AS distractor, c_ok AS x, n_ok AS y, c_bad + n_bad AS bad FROM q UNION ALL SELECT engine, item_id, 'bystander', c_ok, b_ok, c_bad + b_bad FROM q"


def qa_long(wide):
    return T.long_metrics(wide, ["engine", "item_id", "c_bad", "n_bad", "b_bad"], {"nonliteral": ("c_ok", "n_ok"), "bystander": ("c_ok", "b_ok")}).select(
        "engine", "item_id", F.col("metric").alias("distractor"), F.col("clean").cast("int").alias("x"), F.col("distracted").cast("int").alias("y"), (F.col("c_bad") + F.when(F.col("metric") == "nonliteral", F.col("n_bad")).otherwise(F.col("b_bad"))).alias("bad")
    )


_MODEL = f"""WITH q AS ({_QA}), l AS ({_LOSS}), t AS (SELECT engine, distractor, {_PAIRED}, count(*) FILTER (x=0 AND y=1) AS b01, count(*) FILTER (x=1 AND y=0) AS b10 FROM l WHERE bad = 0 GROUP BY ALL),
    a AS (SELECT engine, distractor, count(*) AS n_all, drop_pp AS drop_all_pp, se_pp AS se_all_pp FROM (SELECT engine, distractor, {_PAIRED.replace('count(*) AS n', 'count(*) AS k')} FROM l GROUP BY ALL) GROUP BY ALL),
    c AS (SELECT engine, condition, CAST(sum(is_invalid) AS BIGINT) AS n_bad, 512*(1 + count(*) % 2) AS cap FROM qa_per_item GROUP BY ALL)
    SELECT t.* , round({_MCNEMAR} + 1e-10, 6) AS p, (SELECT count(*) FROM l WHERE l.engine = t.engine AND l.distractor = t.distractor) AS n_all, a.drop_all_pp, a.se_all_pp, c.n_bad AS invalid_clean, d.n_bad AS invalid_distracted, c.cap AS cap_clean, d.cap AS cap_distracted
    FROM t JOIN a USING (engine, distractor) JOIN c ON c.engine = t.engine AND c.condition = 'clean' JOIN c d ON d.engine = t.engine AND d.condition = t.distractor"""


@query(twin("qa_per_item", _MODEL))
def qa_model_table(spark, d):
    """Each engine and distractor: loss on evaluable pairs with its exact p, loss on all items, invalid replies and token caps of both arms."""
    keys = ["engine", "distractor"]
    rows = qa_long(qa_wide(spark, d))
    cells = rows.filter("bad = 0").groupBy(*keys).agg(*S.paired_difference(F.col("x"), F.col("y")), F.count_if(F.expr("x = 0 and y = 1")).alias("b01"), F.count_if(F.expr("x = 1 and y = 0")).alias("b10"))
    every = rows.groupBy(*keys).agg(*S.paired_difference(F.col("x"), F.col("y"))).select(*keys, F.col("n").alias("n_all"), F.col("drop_pp").alias("drop_all_pp"), F.col("se_pp").alias("se_all_pp"))
    runs = view(spark, d, "qa_per_item").groupBy("engine", "condition").agg(F.sum("is_invalid").alias("bad"), (512 * (1 + F.count("*") % 2)).alias("cap"))
    clean = runs.filter("condition = 'clean'").select("engine", F.col("bad").alias("invalid_clean"), F.col("cap").alias("cap_clean"))
    other = runs.select("engine", F.col("condition").alias("distractor"), F.col("bad").alias("invalid_distracted"), F.col("cap").alias("cap_distracted"))
    return cells.withColumn("p", S.rounded(S.mcnemar(F.col("b01"), F.col("b10")))).join(every, keys).join(clean, "engine").join(other, keys)


@query(twin("qa_per_item", f"WITH q AS ({_QA}), l AS ({_LOSS}), e AS (SELECT engine, CASE WHEN engine < 'e4' THEN 'Proprietary' ELSE 'Open-weight' END AS grp, 100*(avg(CAST(x AS DOUBLE))-avg(CAST(y AS DOUBLE))) AS loss FROM l GROUP BY ALL) SELECT CASE WHEN grouping(grp)=1 THEN 'all' ELSE grp END AS grp, count(*) AS n, round(avg(loss), 6) AS mean, round(stddev_samp(loss), 6) AS sd, round(stddev_samp(loss)/sqrt(count(*)), 6) AS sem, round(min(loss), 6) AS lo, round(max(loss), 6) AS hi FROM e GROUP BY ROLLUP (grp)"))
def group_summary(spark, d):
    loss = qa_long(qa_wide(spark, d)).groupBy("engine").agg((100 * F.avg(F.col("x") - F.col("y"))).alias("loss"))
    grp = loss.withColumn("grp", F.when(F.col("engine") < "e4", "Proprietary").otherwise("Open-weight"))
    stats = [F.count("*").alias("n"), *[F.round(c, 6).alias(n) for n, c in (("mean", F.avg("loss")), ("sd", F.stddev_samp("loss")), ("sem", F.stddev_samp("loss") / F.sqrt(F.count("*"))), ("lo", F.min("loss")), ("hi", F.max("loss")))]]
    return T.grouped(grp, [["grp"], []], stats)


@query(twin("qa_per_item", "SELECT engine, condition, count(*) AS n, CAST(sum(is_invalid) AS BIGINT) AS n_invalid, round(100*avg(CAST(is_invalid AS DOUBLE)), 6) AS pct_invalid FROM qa_per_item GROUP BY ALL"))
def invalid_counts(spark, d):
    return view(spark, d, "qa_per_item").groupBy("engine", "condition").agg(F.count("*").alias("n"), F.sum("is_invalid").alias("n_invalid"), T.pct(F.col("is_invalid")).alias("pct_invalid"))


_CATEGORY = f"""WITH q AS ({_QA}), l AS ({_LOSS}), k AS (SELECT p_brand, count(*) AS n_items FROM part GROUP BY ALL),
    c AS (SELECT engine, distractor, p_brand, 100*(avg(CAST(x AS DOUBLE)) FILTER (bad = 0) - avg(CAST(y AS DOUBLE)) FILTER (bad = 0)) AS loss FROM l JOIN part ON p_partkey = item_id GROUP BY ALL),
    w AS (SELECT * FROM c UNION ALL SELECT engine, 'mean', p_brand, avg(loss) FROM c GROUP BY ALL),
    m AS (SELECT * FROM w UNION ALL SELECT 'mean', distractor, p_brand, avg(loss) FROM w GROUP BY ALL)
    SELECT engine, distractor, p_brand, n_items, n_items >= 15 AS reported, round(loss, 6) AS loss FROM m JOIN k USING (p_brand)"""


@query(twin("qa_per_item", _CATEGORY))
def category_loss(spark, d):
    """Loss by engine and category on evaluable pairs, with rows for the mean over distractors and over engines; null without such pairs."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = qa_long(qa_wide(spark, d)).join(parts, F.col("item_id") == F.col("p_partkey"))
    fit = F.col("bad") == 0
    own = rows.groupBy("engine", "distractor", "p_brand").agg((100 * (F.avg(F.when(fit, F.col("x"))) - F.avg(F.when(fit, F.col("y"))))).alias("loss"))
    over = lambda t, c, keys: t.groupBy(*keys).agg(F.avg("loss").alias("loss")).withColumn(c, F.lit("mean")).select("engine", "distractor", "p_brand", "loss")
    both = own.unionByName(over(own, "distractor", ["engine", "p_brand"]))
    every = both.unionByName(over(both, "engine", ["distractor", "p_brand"]))
    sizes = parts.groupBy("p_brand").agg(F.count("*").alias("n_items"))
    return every.join(sizes, "p_brand").select("engine", "distractor", "p_brand", "n_items", (F.col("n_items") >= 15).alias("reported"), F.round("loss", 6).alias("loss"))


_FAMILY = f"WITH q AS ({_QA}), e AS (SELECT * FROM q WHERE c_bad + n_bad = 0), p AS (SELECT a.engine AS engine_a, b.engine AS engine_b, a.item_id, (a.c_ok-a.n_ok)-(b.c_ok-b.n_ok) AS v, 1 AS one FROM e a JOIN e b ON a.item_id = b.item_id AND a.engine < b.engine), u AS ({sums_sql('SELECT * FROM p', 'engine_a, engine_b', 'v', 'item_id')}), t AS (SELECT engine_a, engine_b, round(least(1.0, greatest(2*least(avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0 END) FILTER (s IS NOT NULL), avg(CASE WHEN s >= 0 THEN 1.0 ELSE 0 END) FILTER (s IS NOT NULL)), 1/2000.0)), 6) AS p FROM ({replicates_sql('SELECT * FROM u', 'engine_a, engine_b', 'unit', 'total', 'n', 2000, 0)}) GROUP BY ALL) SELECT * FROM (SELECT engine_a, engine_b, count(*) AS n, round(100*avg(CAST(v AS DOUBLE)), 6) AS did_pp FROM p GROUP BY ALL) JOIN ({bounds_sql('SELECT * FROM u', 'engine_a, engine_b')}) USING (engine_a, engine_b) JOIN t USING (engine_a, engine_b)"


@query(twin("qa_per_item", _FAMILY))
def family_pairs(spark, d):
    """Difference of losses of two engines on items that are valid in all four cells, with interval and p."""
    keys = ["engine_a", "engine_b"]
    loss = qa_wide(spark, d).filter("c_bad + n_bad = 0").select("engine", "item_id", (F.col("c_ok") - F.col("n_ok")).alias("loss"))
    a, b = loss.alias("a"), loss.alias("b")  # one row for each engine and item: pairs are engines squared for an item
    pairs = a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.engine") < F.col("b.engine")))
    pairs = pairs.select(F.col("a.engine").alias("engine_a"), F.col("b.engine").alias("engine_b"), "a.item_id", (F.col("a.loss") - F.col("b.loss")).alias("v"))
    sums = S.dealt_sums(pairs, keys, 100 * F.col("v"), ["item_id"])
    stats = S.replicates_of(sums, keys, "unit", "total", "n", 2000, 0)
    point = pairs.groupBy(*keys).agg(F.count("*").alias("n"), T.pct(F.col("v")).alias("did_pp"))
    return point.join(S.mean_interval(sums, keys), keys).join(S.bootstrap_p(stats, keys, 2000), keys)


#: A run's token cap, from the number of its rows.
_RUNS = "SELECT engine, condition, 512*(1 + count(*) % 2) AS cap FROM qa_per_item GROUP BY ALL"


@query(twin("qa_per_item", f"WITH r AS ({_RUNS}) SELECT a.engine, b.condition, a.cap AS cap_clean, b.cap, CASE WHEN a.cap = b.cap THEN 'matched' ELSE 'excluded' END AS status FROM r a JOIN r b ON a.engine = b.engine AND a.condition = 'clean' AND b.condition <> 'clean'"))
def matched_config(spark, d):
    runs = view(spark, d, "qa_per_item").groupBy("engine", "condition").agg((512 * (1 + F.count("*") % 2)).alias("cap"))
    clean = runs.filter("condition = 'clean'").select("engine", F.col("cap").alias("cap_clean"))
    return runs.filter("condition <> 'clean'").join(clean, "engine").select("engine", "condition", "cap_clean", "cap", F.when(F.col("cap") == F.col("cap_clean"), "matched").otherwise("excluded").alias("status"))


_PROMPT_RUNS = """p AS (SELECT engine, prompt, 512*(1 + count(*) % 2) AS cap, 100*avg(CAST(is_correct AS DOUBLE)) FILTER (condition='clean') AS acc,
    100*(avg(CAST(is_correct AS DOUBLE)) FILTER (condition='clean') - avg(CAST(is_correct AS DOUBLE)) FILTER (condition<>'clean')) AS loss, 100*avg(CAST(is_invalid AS DOUBLE)) AS inv FROM qa_prompts GROUP BY ALL),
    e AS (SELECT v.engine, v.prompt, v.acc - s.acc AS d_acc, v.loss - s.loss AS d_loss, v.inv AS invalid, v.inv > 10 AS collapsed, v.cap = s.cap AS matched FROM p v JOIN p s ON v.engine = s.engine AND s.prompt = 'standard' AND v.prompt <> 'standard')"""


@query(twin("qa_prompts", f"WITH {_PROMPT_RUNS} SELECT engine, prompt, round(d_acc, 6) AS d_acc, round(d_loss, 6) AS d_loss, round(invalid, 6) AS invalid, collapsed, matched FROM e"))
def prompt_effect(spark, d):
    """Each prompt variant against the standard prompt of the same engine; unmatched where the token caps differ."""
    return _prompts(spark, d).select("engine", "prompt", *[F.round(c, 6).alias(c) for c in ("d_acc", "d_loss", "invalid")], "collapsed", "matched")


def _prompts(spark, d):
    clean = F.col("condition") == "clean"
    rate = lambda c: 100 * F.avg(F.when(c, F.col("is_correct")))
    runs = view(spark, d, "qa_prompts").groupBy("engine", "prompt").agg((512 * (1 + F.count("*") % 2)).alias("cap"), rate(clean).alias("acc"), (rate(clean) - rate(~clean)).alias("loss"), (100 * F.avg("is_invalid")).alias("invalid"))
    base = runs.filter("prompt = 'standard'").select("engine", *[F.col(c).alias(f"__{c}") for c in ("cap", "acc", "loss")])
    made = runs.filter("prompt <> 'standard'").join(base, "engine")
    return made.select("engine", "prompt", (F.col("acc") - F.col("__acc")).alias("d_acc"), (F.col("loss") - F.col("__loss")).alias("d_loss"), "invalid", (F.col("invalid") > 10).alias("collapsed"), (F.col("cap") == F.col("__cap")).alias("matched"))


_T_ROWS = "SELECT prompt, engines, count(*) AS n, avg(d_loss) AS mean, stddev_samp(d_loss) AS sd FROM (SELECT *, 'all' AS engines FROM e UNION ALL SELECT *, 'format_stable' FROM e WHERE NOT collapsed UNION ALL SELECT *, 'matched' FROM e WHERE matched) GROUP BY ALL"


@query(twin("qa_prompts", t_table_sql(_PROMPT_RUNS, _T_ROWS, "prompt, engines")))
def prompt_summary(spark, d):
    """The change of the loss over engines (all, those whose format holds, those with the same token cap): mean, t interval and p."""
    groups = F.explode(F.array_compact(F.array(F.lit("all"), F.when(~F.col("collapsed"), "format_stable"), F.when(F.col("matched"), "matched")))).alias("engines")
    table = _prompts(spark, d).select("prompt", groups, "d_loss").groupBy("prompt", "engines").agg(*S.one_sample_t(F.col("d_loss")))
    return table.withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high")})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity >= 49) AS n_error, count(*) FILTER (l_discount = 0) AS n_refusal, round(avg(l_extendedprice), 4) AS mean_tokens, count(*) FILTER (l_tax >= 0.08) AS n_truncated, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS total_tokens, round(100*avg(CASE WHEN l_quantity < 49 AND l_discount > 0 THEN 1.0 ELSE 0 END), 6) AS pct_usable FROM lineitem GROUP BY ALL")
def run_manifest(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 49).alias("n_error"), F.count_if(F.col("l_discount") == 0).alias("n_refusal"), F.round(F.avg("l_extendedprice"), 4).alias("mean_tokens"), F.count_if(F.col("l_tax") >= 0.08).alias("n_truncated"), F.sum(F.floor("l_extendedprice").cast("long")).alias("total_tokens"), T.pct(((F.col("l_quantity") < 49) & (F.col("l_discount") > 0)).cast("int")).alias("pct_usable"))


@query(twin("item_arms", "SELECT model, item_id, max_by(letter, (CAST(logp*1000 AS BIGINT)*10 - k)) AS answer, round(max(logp) FILTER (k = item_id % 4) - max(logp) FILTER (k <> item_id % 4), 6) AS margin FROM (SELECT model, item_id, k, substr('ABCD', CAST(k+1 AS INT), 1) AS letter, CAST((item_id*7 + k*13 + is_correct*5) % 17 AS DOUBLE)/16 AS logp FROM item_arms, (VALUES (0),(1),(2),(3)) v(k) WHERE intervention='none') GROUP BY ALL"))
def argmax_margin(spark, d):
    rows = view(spark, d, "item_arms").filter("intervention = 'none'").select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    rows = rows.withColumn("logp", ((F.col("item_id") * 7 + F.col("k") * 13 + F.col("is_correct") * 5) % 17).cast("double") / 16)
    key = F.col("k") == F.col("item_id") % 4
    letter = F.substring(F.lit("ABCD"), F.col("k") + 1, F.lit(1))
    return rows.groupBy("model", "item_id").agg(F.max_by(letter, F.struct("logp", -F.col("k"))).alias("answer"), F.round(F.max(F.when(key, F.col("logp"))) - F.max(F.when(~key, F.col("logp"))), 6).alias("margin"))


@query(twin("item_arms", "WITH o AS (SELECT model, intervention, count(*) AS n, avg(CAST(is_correct AS DOUBLE)) AS x FROM item_arms GROUP BY ALL) SELECT model, intervention, n, round(100*x, 6) AS accuracy, round(100*(x - (max(x) FILTER (intervention='none') OVER (PARTITION BY model))), 6) AS delta FROM o"))
def suppression_frontier(spark, d):
    own = view(spark, d, "item_arms").groupBy("model", "intervention").agg(F.count("*").alias("n"), F.avg("is_correct").alias("x"))
    base = F.max(F.when(F.col("intervention") == "none", F.col("x"))).over(Window.partitionBy("model"))
    return own.select("model", "intervention", "n", F.round(100 * F.col("x"), 6).alias("accuracy"), F.round(100 * (F.col("x") - base), 6).alias("delta"))


