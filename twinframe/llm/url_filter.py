"""URL filtering: fixed host and path rules, then association rules that FP-growth mines from labelled URLs.

A URL becomes a set of tokens (scheme, host labels, path segments with digits folded, query keys, endings). Labelled URLs with
their label as one more item are mined; rules whose consequent is the label of bad pages, with enough confidence, support and lift,
are kept unless a shorter rule is at least as sure. Tokens that occur in exactly the same labelled URLs are one item (any of them stands
for it), so a long URL template is one item and not 2^n itemsets. Matching is by inverted index: each rule is filed under its rarest
item, and a rule found there fires if the URL has all its items.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, stage_table

BLOCK = "label=block"
#: Fixed rules (host, path, verdict).
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host/path``, else null) and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The sorted set of a URL's tokens; empty for null."""
    fold = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host="), fold(x)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), fold(x)))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    rest = F.array(
        F.when(F.contains(url, F.lit("://")), F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1)))),
        F.when(path.endswith("/"), F.lit("ends=/")),
        F.when(F.contains(url, F.lit("#")), F.lit("has=#")),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(labels, segments, keys, rest))))


def _small_or_by_count(rows: DataFrame, facts: DataFrame, key: str, small: int = 100_000, part: int = 1_000) -> DataFrame:
    """Inner join with a staged table of facts by key: broadcast up to ``small`` rows of facts, else shuffled without hot keys.

    The facts of a key are dealt out in parts of some ``part``; its rows meet each of them, and no row of the join holds more.
    """
    if facts.count() <= small:
        return rows.join(F.broadcast(facts), key)
    asking = rows.groupBy(key).agg(F.count("*").alias("__n"))
    held = facts.groupBy(key).agg(F.count("*").alias("__facts"), F.ceil(F.count("*") / F.lit(part)).cast("int").alias("__parts"))
    sizes = stage_table(asking.join(held, key), "url-key-counts")
    own = [c for c in facts.columns if c != key]
    place = F.struct(key, F.pmod(F.xxhash64(*own), F.col("__parts")).cast("int").alias("__part")).alias("__key")
    dealt = join_by_count(facts, sizes, key, "__facts").select(place, F.struct(*own).alias("__f"), "__n")
    keyed = stage_table(dealt.groupBy("__key").agg(F.collect_list("__f").alias("__f"), F.first("__n").alias("__n")), "url-facts")
    asked = join_by_count(rows, sizes, key, "__n").select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    asked = asked.select(*rows.columns, F.struct(key, "__part").alias("__key"))
    met = join_by_count(asked, keyed, "__key", "__n")
    return met.select(*rows.columns, F.explode("__f").alias("__f")).select(*rows.columns, "__f.*")


def mine_rules(tokens: DataFrame, min_support: float = 0.002, min_rows: int = 10, min_confidence: float = 0.5, min_lift: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, antecedent array of items, confidence, lift, support, item: the rarest of them) and the tokens (token, item) of items.

    ``tokens`` has rows of ``tokens`` and ``bad`` (boolean; null rows take no part). A rule needs the support of a share ``min_support`` and
    of ``min_rows`` of the labelled rows. An item is named by its least token.
    """
    spark, rows = tokens.sparkSession, tokens.filter("bad is not null")
    total, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if total < max(1, min_rows) or not n_bad:
        return spark.createDataFrame([], "rule string, antecedent array<string>, confidence double, lift double, support double, item string"), spark.createDataFrame([], "token string, item string")
    support = max(min_support, min_rows / total)
    sets = stage_table(rows.groupBy("tokens", "bad").agg(F.count("*").alias("n")).withColumn("set", F.xxhash64("tokens", "bad")), "url-sets")
    where = [F.sum("n").alias("count"), F.bit_xor("set").alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y")]
    useful = stage_table(sets.select("set", "n", F.explode("tokens").alias("token")).groupBy("token").agg(*where).filter(F.col("count") >= F.lit(support * total)), "url-tokens")
    named = useful.groupBy("count", "x", "y").agg(F.min("token").alias("item"))
    classes = stage_table(useful.join(named, ["count", "x", "y"]).select("token", "item", "count"), "url-items")
    kept = _small_or_by_count(sets.select("set", "bad", "n", F.explode("tokens").alias("token")), classes.select("token", "item"), "token")
    items = kept.groupBy("set", "bad", "n").agg(F.collect_set("item").alias("items"))
    items = items.withColumn("items", F.when(F.col("bad"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")))
    # A set that many rows have is dealt out before it is repeated; URLs without any item add nothing but their number.
    chunk = 10_000
    dealt = items.select("set", "items", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {chunk} as int)"))).alias("part")).repartition("set", "part")
    baskets = dealt.select("items", F.explode(F.sequence(F.lit(1), F.least(F.lit(chunk), F.col("n") - F.col("part") * chunk).cast("int")))).select("items")
    baskets = stage_table(baskets, "url-baskets")
    held = baskets.count()
    if not held:
        return mine_rules(tokens.limit(0), min_rows=1)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * total / held), minConfidence=min_confidence).fit(baskets)
    sure_enough = model.associationRules.filter(F.array_contains("consequent", BLOCK))
    lift = F.col("confidence") * total / n_bad  # among all labelled rows, those without items included
    found = sure_enough.select(F.array_sort("antecedent").alias("antecedent"), "confidence", lift.alias("lift"), (F.col("support") * held / total).alias("support")).filter(F.col("lift") >= min_lift)
    found = stage_table(found.withColumn("rule", F.concat_ws(" ", "antecedent")), "url-rules")
    # A rule goes if dropping one item of it leaves a rule that is as sure.
    shorter = found.select("rule", "confidence", F.explode("antecedent").alias("x"), "antecedent").select("rule", "confidence", F.concat_ws(" ", F.array_remove("antecedent", F.col("x"))).alias("short"))
    sure = found.select(F.col("rule").alias("short"), F.col("confidence").alias("c"))
    useless = shorter.join(sure, "short").filter("c >= confidence").select("rule").distinct()
    left = found.join(useless, "rule", "left_anti")
    rare = left.select("rule", F.explode("antecedent").alias("item")).join(classes.groupBy("item").agg(F.max("count").alias("count")), "item").groupBy("rule").agg(F.min_by("item", F.struct("count", "item")).alias("item"))
    return stage_table(left.join(rare, "rule").select("rule", "antecedent", "confidence", "lift", "support", "item"), "url-index"), classes.select("token", "item")


def match_rules(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, mined array, confidence): for each distinct token set that a rule fits, the surest rule, by the set's own tokens."""
    pairs = _small_or_by_count(sets.select("tokens", F.explode("tokens").alias("token")), classes, "token")
    own = pairs.groupBy("tokens").agg(F.collect_set(F.struct("item", "token")).alias("own"))
    own = stage_table(own.withColumn("items", F.array_distinct(F.col("own.item"))), "url-set-items")
    keyed = own.select("tokens", "own", "items", F.explode("items").alias("item"))
    found = _small_or_by_count(keyed, rules.select("item", "antecedent", "confidence", "support"), "item").filter(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max(F.struct("confidence", "support", "antecedent"))
    chosen = found.groupBy("tokens").agg(best.alias("b"), F.first("own").alias("own"))
    mined = F.array_sort(F.transform(F.filter("own", lambda p: F.array_contains("b.antecedent", p["item"])), lambda p: p["token"]))
    return chosen.select("tokens", mined.alias("mined"), F.col("b.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules=RULES, **mining) -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence) for each row of ``pages``; rows that repeat are judged each for itself.

    A fixed rule decides where one fits; else the verdict is block if a mined rule fires (``mined``: the URL's tokens that it names) and
    allow if none does. Labels are those of the rows with the page's id; quality 0 is bad, of labels that repeat an id the least
    counts, null labels and ids take no part. Null URLs and such without ``://`` have an empty host and path. Without labels only
    the fixed rules decide; an empty table gives none. Other columns of ``pages`` are not read, so clashing names do no harm. URLs with
    the same tokens are matched once.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = stage_table(rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url"), "url-rows")
    known = labels.groupBy(F.col(label_id).alias("id")).agg((F.min("quality") == 0).alias("bad"))
    sets = stage_table(rows.groupBy("tokens").agg(F.count("*").alias("n")), "url-distinct")
    mined = match_rules(sets.filter(F.size("tokens") > 0), *mine_rules(rows.join(known, "id").select("tokens", "bad"), **mining))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    joined = join_by_count(rows, stage_table(sets.join(mined, "tokens", "left"), "url-verdicts"), "tokens")
    own = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise("allow")
    return joined.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mined", "confidence")
