"""Joins, pivots and report tables of the paired evaluation, and round trips through stored files."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.functions import text as X
from twinframe.operators import pairing as P
from twinframe.operators import stats as S
from twinframe.operators import tables as T
from twinframe.sources import tables as store
from twinframe.streaming import ingest

from .collection import _STRICT
from .documentation import pct
from .intervals import bounds_sql, sums_sql
from .registry import query
from .statistics import _MCNEMAR, _PAIRED
from .views import table, twin, view

_KEY = "source_dataset, item_id, model, distractor_type, condition"


# Joins -----------------------------------------------------------------------------------------------------------------


@query(twin("judgments", f"WITH n AS (SELECT {_KEY}, transcript_chars + 1 AS note_chars FROM judgments WHERE overall_quality <> 3) SELECT model, condition, count(*) AS n, count(note_chars) AS n_notes, CAST(sum(note_chars) AS BIGINT) AS chars FROM judgments LEFT JOIN n USING ({_KEY}) GROUP BY ALL"))
def judgments_with_notes(spark, d):
    """Judgments with the length of their note, kept where there is no note."""
    keys = [*P.KEYS, "condition"]
    rows = view(spark, d, "judgments")
    notes = rows.filter("overall_quality <> 3").select(*keys, (F.col("transcript_chars") + 1).alias("note_chars"))
    return rows.join(notes, keys, "left").groupBy("model", "condition").agg(F.count("*").alias("n"), F.count("note_chars").alias("n_notes"), F.sum("note_chars").alias("chars"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n_tokens FROM documents")
def compute_once(spark, d):
    """Each distinct text is worked on once; the results go back by the text's hash, in 16 salts, so a text that many rows have is no hot key."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "text")
    tokens = F.size(F.regexp_extract_all(F.lower(F.first("text")), F.lit("[a-z]+"), F.lit(0))).cast("long")
    done = docs.groupBy("h").agg(tokens.alias("n_tokens")).select("h", "n_tokens", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    return docs.select("doc_id", "h", F.pmod("doc_id", F.lit(16)).cast("int").alias("salt")).join(done, ["h", "salt"]).select("doc_id", "n_tokens")


_SUBSTITUTED = "WITH w AS (SELECT model, item_id, max(is_correct) FILTER (intervention = 'none' AND item_id % 3 <> 0) AS own, max(is_correct) FILTER (intervention = 'interference') AS x FROM item_arms GROUP BY ALL), b AS (SELECT model, item_id, max(is_correct) AS base FROM item_arms WHERE intervention = 'all' GROUP BY ALL)"


@query(twin("item_arms", f"{_SUBSTITUTED} SELECT model, count(*) AS n, count(own) AS n_own, {pct('coalesce(own, base)')} AS baseline, {pct('coalesce(own, base) - x')} AS drop_pp FROM w JOIN b USING (model, item_id) WHERE x IS NOT NULL GROUP BY model"))
def baseline_substitution(spark, d):
    """The run's own unpatched answer where it has one, else the baseline table's."""
    rows = view(spark, d, "item_arms")
    own = F.max(F.when((F.col("intervention") == "none") & (F.col("item_id") % 3 != 0), F.col("is_correct")))
    wide = rows.groupBy("model", "item_id").agg(own.alias("own"), F.max(F.when(F.col("intervention") == "interference", F.col("is_correct"))).alias("x"))
    base = rows.filter("intervention = 'all'").groupBy("model", "item_id").agg(F.max("is_correct").alias("base"))
    first = F.coalesce("own", "base")
    return wide.filter("x is not null").join(base, ["model", "item_id"]).groupBy("model").agg(F.count("*").alias("n"), F.count("own").alias("n_own"), T.pct(first).alias("baseline"), T.pct(first - F.col("x")).alias("drop_pp"))


@query(twin("judgments", f"SELECT {_KEY} FROM judgments WHERE family = 'family_a' AND distractor_type = 'bystander' ORDER BY source_dataset, item_id, model, distractor_type, condition LIMIT 50"))
def first_tasks(spark, d):
    """The first 50 tasks of a family and distractor: the limit is the feature."""
    keys = [*P.KEYS, "condition"]
    return view(spark, d, "judgments").filter("family = 'family_a' and distractor_type = 'bystander'").select(*keys).orderBy(*keys).limit(50)


_CODES = [("ECONOMY", "Cardiology"), ("SMALL", "General principles"), ("STANDARD", "Nervous system"), ("MEDIUM", "Renal"), ("LARGE", "Respiratory"), ("PROMO", "Endocrine")]


@query("SELECT p_type AS code, CASE p_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _CODES) + " END AS label, count(*) AS n FROM part GROUP BY ALL")
def code_labels(spark, d):
    """Codes with the labels of a small map; a code without one is an error."""
    counts = table(spark, d, "part").groupBy(F.col("p_type").alias("code")).agg(F.count("*").alias("n"))
    return X.labelled(counts, "code", dict(_CODES))


# Pivots and order ------------------------------------------------------------------------------------------------------


@query(twin("judgments", "SELECT source_dataset, item_id, model, distractor_type, max(contamination) FILTER (condition='clean') AS a_clean, max(contamination) FILTER (condition='distracted') AS a_distracted, max(contamination_b) FILTER (condition='clean') AS b_clean, max(contamination_b) FILTER (condition='distracted') AS b_distracted FROM judgments GROUP BY ALL HAVING count(*) = 2"))
def protocol_pivot(spark, d):
    """Protocols by conditions in one row; an item without both conditions is left out, and the pivot has half the rows of what went in."""
    rows = view(spark, d, "judgments")
    cells = [F.max(F.when(F.col("condition") == c, F.col(v))).alias(f"{n}_{c}") for n, v in (("a", "contamination"), ("b", "contamination_b")) for c in ("clean", "distracted")]
    return rows.groupBy(*P.KEYS).agg(*cells, F.count("*").alias("__n")).filter("__n = 2").drop("__n")


@query(twin("pairs", f"SELECT model, {pct('CASE WHEN distractor_type = $$bystander$$ THEN c1 END')} AS bystander, {pct('CASE WHEN distractor_type = $$nonliteral$$ THEN c1 END')} AS nonliteral FROM pairs GROUP BY model"))
def report_pivot(spark, d):
    """One row a model, one column a distractor."""
    return view(spark, d, "pairs").groupBy("model").pivot("distractor_type", ["bystander", "nonliteral"]).agg(T.pct(F.col("c1")))


@query(twin("pairs", "SELECT model, distractor_type, source_dataset, item_id, chars FROM (SELECT *, row_number() OVER (PARTITION BY model, distractor_type ORDER BY chars DESC, source_dataset, item_id) AS k FROM pairs WHERE s1 = 3 AND s0 = 0) WHERE k = 1"))
def severe_example(spark, d):
    """The longest transcript of greatest severity with a clean score of zero, for each model and distractor."""
    best = F.min_by(F.struct("source_dataset", "item_id", "chars"), F.struct(-F.col("chars"), F.col("source_dataset"), F.col("item_id")))
    return view(spark, d, "pairs").filter("s1 = 3 and s0 = 0").groupBy("model", "distractor_type").agg(best.alias("b")).select("model", "distractor_type", "b.*")


_ORDER = ["m2", "m0", "m3", "m1"]


@query(twin("pairs", f"SELECT model, list_position([{', '.join(map(repr, _ORDER))}], model) AS position, count(*) AS n FROM pairs GROUP BY ALL"))
def report_order(spark, d):
    """Models in the fixed order of the report; models that it lacks come last."""
    place = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("model"))
    counts = view(spark, d, "pairs").groupBy("model").agg(F.count("*").alias("n")).withColumn("position", F.nullif(place, F.lit(0)).cast("int"))
    return counts.orderBy(F.col("position").asc_nulls_last(), "model")


# Mechanism -------------------------------------------------------------------------------------------------------------

_STYLES = "SELECT engine AS model, condition AS distractor, item_id, max(is_correct) FILTER (prompt='standard') AS b, max(is_correct) FILTER (prompt='terse') AS i, max(is_correct) FILTER (prompt='verbose') AS v FROM qa_prompts GROUP BY ALL HAVING b + i + v IS NOT NULL"


@query(twin("qa_prompts", f"WITH w AS ({_STYLES}), l AS (SELECT model, distractor, item_id, style, b AS x, y FROM w, LATERAL (VALUES ('terse', i), ('verbose', v)) s(style, y)) SELECT *, round({_MCNEMAR} + 1e-10, 6) AS p FROM (SELECT model, distractor, style, {_PAIRED}, count(*) FILTER (x=0 AND y=1) AS b01, count(*) FILTER (x=1 AND y=0) AS b10 FROM l GROUP BY ALL) JOIN ({bounds_sql(sums_sql('SELECT * FROM l', 'model, distractor, style', 'x-y', 'item_id'), 'model, distractor, style')}) USING (model, distractor, style)"))
def prompt_styles(spark, d):
    """Each prompt style against the standard one on the same items: paired loss, interval and exact p."""
    by = ["model", "distractor", "style"]
    take = lambda p: F.max(F.when(F.col("prompt") == p, F.col("is_correct")))
    rows = view(spark, d, "qa_prompts").groupBy(F.col("engine").alias("model"), F.col("condition").alias("distractor"), "item_id").agg(take("standard").alias("x"), take("terse").alias("terse"), take("verbose").alias("verbose")).dropna()
    long = rows.select("model", "distractor", "item_id", "x", F.explode(F.create_map(F.lit("terse"), F.col("terse"), F.lit("verbose"), F.col("verbose"))).alias("style", "y"))
    cells = long.groupBy(*by).agg(*S.paired_difference(F.col("x"), F.col("y")), F.count_if(F.expr("x = 0 and y = 1")).alias("b01"), F.count_if(F.expr("x = 1 and y = 0")).alias("b10"))
    interval = S.mean_interval(S.dealt_sums(long, by, F.col("x") - F.col("y"), ["item_id"]), by, 100.0)
    return cells.withColumn("p", S.rounded(S.mcnemar(F.col("b01"), F.col("b10")))).join(interval, by)


_SCALED = "SELECT model, distractor, head_set, scale, avg(CASE WHEN sel THEN scale*gate ELSE gate END) AS x, count(*) FILTER (sel) AS n_scaled FROM (SELECT *, CASE head_set WHEN 'interference' THEN gate < 0.2 ELSE (layer*8 + head + seed) % 7 = 0 END AS sel FROM head_masks, (VALUES ('interference'), ('random')) h(head_set), (VALUES (1.0e0), (0.5e0), (0.0e0)) s(scale)) GROUP BY ALL"


@query(twin("head_masks", f"WITH t AS ({_SCALED}) SELECT t.model, t.distractor, t.head_set, t.scale, t.n_scaled, round(t.x, 6) AS mean_gate, round(t.x - r.x, 6) AS delta FROM t JOIN t r ON r.model = t.model AND r.distractor = t.distractor AND r.head_set = 'interference' AND r.scale = 1.0"))
def suppression_by_set(spark, d):
    """The mean gate at each scale for the selected heads and for a set without regard to them; changes are from the unscaled model."""
    sets, scales = (F.explode(F.array(*map(F.lit, x))) for x in (("interference", "random"), (1.0, 0.5, 0.0)))
    rows = view(spark, d, "head_masks").withColumn("head_set", sets).withColumn("scale", scales)
    chosen = F.when(F.col("head_set") == "interference", F.col("gate") < 0.2).otherwise((F.col("layer") * 8 + F.col("head") + F.col("seed")) % 7 == 0)
    means = rows.groupBy("model", "distractor", "head_set", "scale").agg(F.avg(F.when(chosen, F.col("scale") * F.col("gate")).otherwise(F.col("gate"))).alias("x"), F.count_if(chosen).alias("n_scaled"))
    base = means.filter("head_set = 'interference' and scale = 1.0").select("model", "distractor", F.col("x").alias("base"))
    return means.join(base, ["model", "distractor"]).select("model", "distractor", "head_set", "scale", "n_scaled", F.round("x", 6).alias("mean_gate"), F.round(F.col("x") - F.col("base"), 6).alias("delta"))


# Stored files ----------------------------------------------------------------------------------------------------------

_DOCS = "doc_id long, text string, lang string, source string"


@query("SELECT doc_id, text, lang, source FROM documents WHERE lang = 'en'")
def csv_scan(spark, d):
    """Texts with quotes and line breaks through CSV, one source only."""
    path = store.scratch(spark, "csv")
    table(spark, d, "documents").select("doc_id", "text", "lang", "source").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return store.read_csv(spark, path, _DOCS, F.col("lang") == "en")


@query("SELECT CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'train' WHEN 'de' THEN 'validation' END AS split, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def split_scan(spark, d):
    """Files of several splits in one read, each row with its file's split; a file without a split has none."""
    path = store.scratch(spark, "splits")
    table(spark, d, "documents").select("doc_id", "text", "lang", F.col("lang").alias("file")).write.partitionBy("file").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    rows = store.read_splits(spark, [path], {"file=en": "train", "file=fr": "train", "file=de": "validation"}, "doc_id long, text string, lang string", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return rows.groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT 2 AS n_versions, count(*) AS n_rows, true AS refused FROM documents")
def frozen_outputs(spark, d):
    """A result that is there is never written over: the second write is refused, and the first stays."""
    from pyspark.errors import AnalysisException

    path, refused = store.scratch(spark, "frozen"), False
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    store.write_results(docs, path)
    try:
        store.write_results(docs.filter("doc_id < 0"), path)
    except AnalysisException as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    for _ in range(2):  # while a versioned table takes another version
        store.write_table(docs, f"{path}-table")
    n = store.manifest(spark, f"{path}-table").count()
    return spark.read.schema("doc_id long, n_chars long").option("header", True).csv(path).agg(F.lit(n).alias("n_versions"), F.count("*").alias("n_rows")).withColumn("refused", F.lit(refused))


@query(f"SELECT doc_id, replace(translate(t, '{chr(0x2018)}{chr(0x2019)}{chr(0x201C)}{chr(0x201D)}{chr(0x2013)}{chr(0x2014)}{chr(0x2011)}{chr(0xA0)}', chr(39) || chr(39) || '\"\"--- '), '{chr(0x2026)}', '...') AS plain FROM (SELECT doc_id, concat('{chr(0x201C)}', replace(text, '. ', '{chr(0x2026)} '), '{chr(0x201D)}{chr(0xA0)}{chr(0x2014)}{chr(0x2013)}it{chr(0x2019)}s') AS t FROM documents)")
def ascii_fold(spark, d):
    """Texts with typographic marks, with plain ones in their place."""
    marked = F.concat(F.lit(chr(0x201C)), F.replace("text", F.lit(". "), F.lit(chr(0x2026) + " ")), F.lit(f"{chr(0x201D)}{chr(0xA0)}{chr(0x2014)}{chr(0x2013)}it{chr(0x2019)}s"))
    return table(spark, d, "documents").select("doc_id", X.ascii_fold(marked).alias("plain"))


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def tree_scan(spark, d):
    """A folder tree with the key in its paths."""
    path = store.scratch(spark, "tree")
    table(spark, d, "documents").select("doc_id", "text", "lang").write.partitionBy("lang").parquet(path)
    rows = store.read_tree(spark, path, "part-*", ["lang"], "doc_id long, text string").withColumn("lang", F.regexp_replace("lang", "^lang=", ""))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS pos, item_id, text FROM benchmark")
def json_array_scan(spark, d):
    """The benchmark as one JSON array, with the place of each item. The list is the feature: an item file is one array."""
    path = store.scratch(spark, "array")
    item = F.struct("item_id", "text")
    rows = table(spark, d, "benchmark").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value"))
    rows.write.option("compression", "none").text(path)
    return store.read_json_items(spark, path, "item_id:bigint,text:string")


@query(twin("judgments", f"SELECT {_KEY}, severity FROM judgments"))
def jsonl_twin(spark, d):
    """A versioned table with JSON lines beside it, read from the lines."""
    path = store.scratch(spark, "twin")
    store.write_table(view(spark, d, "judgments").select(*P.KEYS, "condition", "severity"), path, jsonl=True)
    return store.read_or_empty(spark, "source_dataset string, item_id string, model string, distractor_type string, condition string, severity int", ("parquet", f"{path}/none"), ("json", f"{path}/_jsonl")).drop("version")


@query(twin("judgments", "SELECT run, n_rows, severities FROM (SELECT 1 AS run, count(*) FILTER (model <> 'm3') AS n_rows, '0..3' AS severities FROM judgments UNION ALL SELECT 2, count(*) FILTER (model <> 'm3' OR overall_quality = 5), '0..13' FROM judgments)"))
def table_versions(spark, d):
    """The manifest after a fold: both versions with their rows and parameters."""
    return store.manifest(spark, _folded(spark, d)[0]).select(F.col("params")["run"].cast("int").alias("run"), "n_rows", F.col("params")["severities"].alias("severities"))


def _folded(spark, d):
    path, keys = store.scratch(spark, "fold"), [*P.KEYS, "condition"]
    rows = view(spark, d, "judgments")
    store.write_table(rows.filter("model <> 'm3'").select(*keys, F.col("severity").cast("tinyint").alias("severity")), path, params={"run": 1, "severities": "0..3"})
    new = rows.filter("overall_quality = 5").select(*keys, (F.col("severity") + 10).cast("tinyint").alias("severity"))
    counts = store.fold_table(spark, path, new, keys, ["severity"], {"run": 2, "severities": "0..13"})
    return path, counts


@query(twin("judgments", f"SELECT {_KEY}, CASE WHEN overall_quality = 5 THEN severity + 10 ELSE severity END AS severity FROM judgments WHERE model <> 'm3' OR overall_quality = 5"))
def fold_version(spark, d):
    """A stored table after a fold: replaced rows, kept rows, new rows, scores as bytes."""
    return store.latest(spark, _folded(spark, d)[0])


@query("SELECT l_returnflag, CAST(round(avg(l_extendedprice), 1) AS DOUBLE) AS mean_price, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def result_table(spark, d):
    """Fractions to significant digits through a written result table."""
    path = store.scratch(spark, "results")
    store.write_results(table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean_price"), F.count("*").alias("n")), path)
    return spark.read.schema("l_returnflag string, mean_price double, n long").option("header", True).csv(path)


@query(twin("judge_raw", f"SELECT CAST(event_id AS VARCHAR) AS request_id, contamination, severity, repaired FROM ({_STRICT}) WHERE NOT parse_error"))
def stream_ingest(spark, d):
    """Replies from files, through the incremental ingest, into the table of first successes."""
    folder, target = store.scratch(spark, "replies"), store.scratch(spark, "ingested")
    view(spark, d, "judge_raw").select(F.col("event_id").cast("string").alias("request_id"), F.col("ts").alias("received_at"), "judge_raw").write.json(folder)
    ingest.run_ingest(spark, folder, target, store.scratch(spark, "ingest-checkpoint"))
    return spark.read.parquet(target).select("request_id", "contamination", "severity", "repaired")


@query(twin("judge_raw", f"SELECT CAST(user_id AS VARCHAR) AS request_id, contamination, severity, repaired FROM (SELECT * FROM ({_STRICT}) WHERE NOT parse_error QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, contamination DESC, severity DESC, repaired DESC) = 1)"))
def stream_upsert(spark, d):
    """Replies in two lots of files through the keyed ingest: each user's newest good reply, the second lot replacing rows of the first."""
    folder, target, state = (store.scratch(spark, n) for n in ("replies", "upserted", "upsert-checkpoint"))
    replies = view(spark, d, "judge_raw").select(F.col("user_id").cast("string").alias("request_id"), F.col("ts").alias("received_at"), "judge_raw", F.col("event_id") % 2 == 0)
    half = replies.columns[-1]
    for lot in (True, False):
        replies.filter(F.col(half) == lot).drop(half).write.mode("append").json(folder)
        ingest.run_upsert(spark, folder, target, state)
    return ingest.read_upserted(spark, target).select("request_id", "contamination", "severity", "repaired")
