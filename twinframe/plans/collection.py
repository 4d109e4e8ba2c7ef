"""Requests, replies, audits and stream queries."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinframe.functions import text as X
from twinframe.operators import judgments as J
from twinframe.operators import planning as G
from twinframe.operators import rules as R
from twinframe.operators import stats as S
from twinframe.sources import files as V
from twinframe.sources import tables as store
from twinframe.sources.positions import match_report, with_positions
from twinframe.streaming import ingest

from .intervals import replicates_sql, t_table_sql
from .registry import query
from .views import table, twin, view

_KEY = "source_dataset, item_id, model, distractor_type"


@query(twin("pairs", f"SELECT {_KEY}, right(sha256(concat_ws('|', '7', source_dataset, item_id, model, distractor_type)), 1) IN ('0','2','4','6','8','a','c','e') AS clean_first FROM pairs"))
def blind_order(spark, d):
    keys = ["source_dataset", "item_id", "model", "distractor_type"]
    return view(spark, d, "pairs").select(*keys, J.blind_order(*map(F.col, keys), seed=7).alias("clean_first"))


#: A template for each kind of request.
TEMPLATES = [
    ("note", "Write a note.\n\nTranscript:\n{transcript}\n\nNote:"),
    ("paired", "## Encounter\n{transcript}\n## Inserted\n{inserted}\n## A\n{note_a}\n## B\n{note_b}\nAnswer with {{\"a\": <0 or 1>, \"b\": <0 or 1>}}"),
    ("single", "## Encounter\n{transcript}\n## Note\n{note_a}\n## Inserted\n{inserted}\nAnswer with {{\"contamination\": <0 or 1>}}"),
    ("control", "## Encounter\n{transcript}\n## Note\n{note_a}\nAnswer with {{\"contamination\": <0 or 1>}}"),
    ("quality", "## Encounter\n{transcript}\n## Note\n{note_a}\n## Reference\n{reference}\nAnswer with {{\"overall_quality\": <1-5>}}"),
    ("attribution", "## Inserted\n{inserted}\n## Note\n{note_a}\nAnswer with {{\"attribution\": \"<patient|correct|absent>\"}}"),
]
_ASKED = "SELECT conv_id, ['note', 'paired', 'single', 'control', 'quality', 'attribution'][CAST(1 + conv_id % 6 AS INT)] AS kind, transcript, distractor_summary AS inserted, concat('note of ', CAST(conv_id AS VARCHAR)) AS note_a, concat('other of ', CAST(conv_id AS VARCHAR)) AS note_b, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE distractor_conversation END AS reference FROM dialogues JOIN insertions USING (conv_id)"


def _filled(template: str) -> str:
    parts = re.split(r"\{([a-z_]+)\}", template.replace("{{", "\x01").replace("}}", "\x02"))
    quoted = lambda x: "'" + x.replace("'", "''").replace("\x01", "{").replace("\x02", "}").replace("\n", "' || chr(10) || '") + "'"
    return "(" + " || ".join(f"coalesce({p}, '')" if i % 2 else quoted(p) for i, p in enumerate(parts)) + ")"


_RENDERED = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_filled(t)}" for k, t in TEMPLATES) + " END"


@query(twin("dialogues insertions", f"SELECT conv_id, kind, prompt, substr(sha256(concat_ws(chr(31), kind, prompt)), 1, 40) AS request_id FROM (SELECT conv_id, kind, {_RENDERED} AS prompt FROM ({_ASKED}))"))
def render_requests(spark, d):
    """Requests of six kinds from a table of templates; equal requests have equal ids."""
    kinds = F.element_at(F.array(*[F.lit(k) for k, _ in TEMPLATES]), (1 + F.col("conv_id") % 6).cast("int"))
    named = lambda n: F.concat(F.lit(f"{n} of "), F.col("conv_id").cast("string"))
    rows = view(spark, d, "dialogues").join(view(spark, d, "insertions"), "conv_id")
    rows = rows.select("conv_id", kinds.alias("kind"), "transcript", F.col("distractor_summary").alias("inserted"), named("note").alias("note_a"), named("other").alias("note_b"), F.when(F.col("conv_id") % 4 != 0, F.col("distractor_conversation")).alias("reference"))
    made = R.rendered(rows, spark.createDataFrame(TEMPLATES, "kind string, template string"))
    return made.select("conv_id", "kind", "prompt", J.request_id(F.col("kind"), F.col("prompt")).alias("request_id"))


@query(twin("dialogues", "SELECT conv_id, substr(sha256(transcript), 1, 40) AS input_hash, base64(encode('conv|' || CAST(conv_id AS VARCHAR))) AS custom_id FROM dialogues"))
def request_ids(spark, d):
    return view(spark, d, "dialogues").select("conv_id", F.substring(F.sha2("transcript", 256), 1, 40).alias("input_hash"), F.base64(F.concat(F.lit("conv|"), F.col("conv_id").cast("string")).cast("binary")).alias("custom_id"))


_BRACES = "CASE WHEN strpos({0}, '{{') > 0 AND strpos({0}, '}}') > 0 AND length({0}) - strpos(reverse({0}), '}}') + 1 > strpos({0}, '{{') THEN substr({0}, strpos({0}, '{{'), length({0}) - strpos(reverse({0}), '}}') + 2 - strpos({0}, '{{')) END"
_INT = "CASE WHEN json_type(v, '$.{0}') IN ('BIGINT', 'UBIGINT') THEN TRY_CAST(json_extract_string(v, '$.{0}') AS INT) END"
_STRICT = f"""SELECT event_id, user_id, ts, CASE WHEN ok THEN c END AS contamination, CASE WHEN ok THEN s END AS severity, ok AND NOT inner_ok AS repaired, NOT ok AS parse_error FROM (
    SELECT *, coalesce(c IN (0, 1) AND s BETWEEN 0 AND 3 AND json_type(v, '$.reasoning') = 'VARCHAR', false) AS ok FROM (
    SELECT *, {_INT.format('contamination')} AS c, {_INT.format('severity')} AS s FROM (
    SELECT *, CASE WHEN inner_ok THEN b WHEN starts_with(t, '{{') AND ends_with(t, '"') AND json_valid(t || '}}') THEN t || '}}' END AS v FROM (
    SELECT *, coalesce(json_valid(b), false) AS inner_ok FROM (SELECT *, trim(judge_raw) AS t, {_BRACES.format('judge_raw')} AS b FROM judge_raw)))))"""


@query(twin("judge_raw", f"SELECT event_id, contamination, severity, repaired, parse_error FROM ({_STRICT})"))
def parse_strict_repair(spark, d):
    return J.parse_strict(view(spark, d, "judge_raw")).select("event_id", "contamination", "severity", "repaired", "parse_error")


@query(twin("judge_raw", f"SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (parse_error) AS n_error, count(*) FILTER (repaired) AS n_repaired FROM ({_STRICT}) GROUP BY 1"))
def error_rates(spark, d):
    return ingest.error_rates(view(spark, d, "judge_raw"), time="ts")


@query(twin("judge_raw", f"SELECT user_id, event_id, contamination, severity FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ({_STRICT}) WHERE NOT parse_error) WHERE k = 1"))
def first_success(spark, d):
    good = J.parse_strict(view(spark, d, "judge_raw")).filter("not parse_error")
    best = F.min_by(F.struct("event_id", "contamination", "severity"), F.struct("ts", "event_id"))
    return good.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


_SLOTS = "CASE WHEN event_id % 10 = 0 THEN 7 ELSE event_id % 2 END"


@query(f"SELECT event_id, condition, CASE WHEN ok THEN CASE WHEN (condition = 'clean') = first THEN c ELSE 1-c END END AS contamination, CASE WHEN ok THEN CASE WHEN (condition = 'clean') = first THEN CAST(event_id % 4 AS INT) ELSE 0 END END AS severity, NOT ok AS parse_error FROM (SELECT event_id, user_id % 2 = 0 AS first, CAST({_SLOTS} AS INT) AS c, event_id % 10 <> 0 AS ok FROM events), (VALUES ('clean'), ('distracted')) v(condition)")
def parse_paired_judgment(spark, d):
    """Numbers, digits in quotes, numbers with a fraction and true or false all count as the whole number that they are."""
    a = F.when(F.col("event_id") % 10 == 0, 7).otherwise(F.col("event_id") % 2)
    spelt = lambda x: F.when((F.col("event_id") % 4 == 3) & (x <= 1), F.when(x == 1, "true").otherwise("false")).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).when(F.col("event_id") % 4 == 2, F.concat(x.cast("string"), F.lit(".0"))).otherwise(x.cast("string"))
    reply = F.concat(F.lit('Sure: {"A": {"contamination": '), spelt(a), F.lit(', "severity": '), spelt(F.col("event_id") % 4), F.lit('}, "B": {"contamination": '), spelt(1 - a), F.lit(', "severity": 0}}'))
    rows = table(spark, d, "events").select("event_id", reply.alias("reply"), (F.col("user_id") % 2 == 0).alias("first"))
    return J.parse_paired(rows, "reply", F.col("first")).select("event_id", "condition", "contamination", "severity", "parse_error")


@query("SELECT event_id, CASE WHEN ok THEN CAST(event_id % 2 AS INT) END AS contamination, CASE WHEN ok THEN CAST(event_id % 6 AS INT) END AS severity, NOT ok AS parse_error FROM (SELECT event_id, event_id % 6 <= 3 AND event_id % 7 <> 0 AS ok FROM events)")
def parse_single_judgment(spark, d):
    """Replies about one note; a list is no object, though it holds one."""
    body = F.concat(F.lit('{"contamination": '), (F.col("event_id") % 2).cast("string"), F.lit(', "severity": "'), (F.col("event_id") % 6).cast("string"), F.lit('"}'))
    reply = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(F.col("event_id") % 7 == 1, F.concat(F.lit("So: "), body)).otherwise(body)
    return J.parse_single(table(spark, d, "events").select("event_id", reply.alias("reply")), "reply").drop("reply")


#: Ways to write a number: as it is, in quotes, with a fraction, as true or false (0 and 1 only), in quotes with blanks.
_SPELT = "CASE event_id % 5 WHEN 1 THEN concat('\"', {0}, '\"') WHEN 2 THEN concat({0}, '.0') WHEN 3 THEN CASE {0} WHEN '0' THEN 'false' WHEN '1' THEN 'true' ELSE {0} END WHEN 4 THEN concat('\" ', {0}, ' \"') ELSE {0} END"
_SCORED = f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN body WHEN 1 THEN concat('Scores: ', body, ' - done') ELSE concat('[', body, ']') END AS reply, event_id % 3 <> 2 AS object, q, h FROM (
    SELECT event_id, q, h, concat('{{"overall_quality": ', {_SPELT.format("CAST(q AS VARCHAR(9))")}, ', "completeness": 4.5, "hallucination": ', {_SPELT.format("CAST(h AS VARCHAR(9))")}, '}}') AS body FROM (SELECT event_id, event_id % 7 AS q, event_id % 11 % 3 AS h FROM events) x) y"""
_LABELLED = f"""SELECT event_id, event_type, u, concat(CASE WHEN event_id % 4 = 0 THEN '{{}} then ' ELSE '' END, '{{"attribution": "', CASE event_type WHEN 'click' THEN 'patient' WHEN 'view' THEN ' Third_Party' WHEN 'error' THEN 'ABSENT ' ELSE 'someone' END, '", "used_for_patient": ', {_SPELT.format("CAST(u AS VARCHAR(9))")}, '}}') AS reply
    FROM (SELECT event_id, event_type, event_id % 11 % 3 AS u FROM events) x"""


def _real(f: str) -> str:
    return f"CASE json_type(v, '$.{f}') WHEN 'BOOLEAN' THEN CASE json_extract_string(v, '$.{f}') WHEN 'true' THEN 1.0e0 ELSE 0.0e0 END ELSE TRY_CAST(trim(json_extract_string(v, '$.{f}')) AS DOUBLE) END"


_OBJECT = "CASE WHEN json_valid(reply) THEN CASE WHEN json_type(reply) = 'OBJECT' THEN reply END WHEN json_valid({0}) THEN {0} END".format(_BRACES.format("reply"))


@query(f"SELECT event_id, CASE WHEN ok THEN q END AS overall_quality, CASE WHEN ok THEN k END AS completeness, CASE WHEN ok THEN h END AS hallucination, NOT ok AS parse_error FROM (SELECT event_id, q, k, h, coalesce(q BETWEEN 1 AND 5 AND k BETWEEN 1 AND 5 AND h IN (0, 1), false) AS ok FROM (SELECT event_id, {_real('overall_quality')} AS q, {_real('completeness')} AS k, {_real('hallucination')} AS h FROM (SELECT event_id, {_OBJECT} AS v FROM ({_SCORED}))))")
def parse_quality_judgment(spark, d):
    """Scores written as numbers, in quotes, with a fraction or as true and false, in a reply with words around it; a list is no object."""
    rows = spark.sql(_SCORED.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=table(spark, d, "events")).select("event_id", "reply")
    return J.parse_quality(rows, "reply", ["overall_quality", "completeness"]).drop("reply")


@query(f"SELECT event_id, CASE WHEN ok THEN a END AS attribution, CASE WHEN ok THEN CAST(u AS INT) END AS used_for_patient, NOT ok AS parse_error FROM (SELECT event_id, a, u, coalesce(a IN ('patient', 'correct', 'absent') AND u IN (0, 1), false) AS ok FROM (SELECT event_id, CASE a WHEN 'third_party' THEN 'correct' ELSE a END AS a, u FROM (SELECT event_id, lower(trim(json_extract_string(v, '$.attribution'))) AS a, {_real('used_for_patient')} AS u FROM (SELECT event_id, {_OBJECT} AS v FROM ({_LABELLED})))))")
def parse_attribution(spark, d):
    """Labels in any case and spacing, the older one renamed; a reply with an object before the answer is no JSON between its braces."""
    rows = spark.sql(_LABELLED.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=table(spark, d, "events")).select("event_id", "reply")
    return J.parse_attribution(rows, "reply").drop("reply")


@query(twin("dialogues insertions", "SELECT conv_id, bench_id, insert_after_turn, length(transcript) AS clean_chars, length(distractor_conversation) AS inserted_chars FROM insertions JOIN dialogues USING (conv_id)"))
def pairs_build(spark, d):
    joined = J.validate_join(view(spark, d, "insertions"), view(spark, d, "dialogues"), ["conv_id"])
    return joined.select("conv_id", "bench_id", "insert_after_turn", F.length("transcript").cast("long").alias("clean_chars"), F.length("distractor_conversation").cast("long").alias("inserted_chars"))


_PLAN = """c AS (SELECT conv_id, row_number() OVER (ORDER BY md5('21|' || CAST(conv_id AS VARCHAR)), conv_id) - 1 AS pos, count(*) OVER () AS n FROM dialogues),
    p AS (SELECT a.conv_id, CAST(j AS INT) AS j, b.conv_id AS donor, concat('d', CAST(j AS VARCHAR)) AS code FROM c a, (SELECT unnest(range(0, 2)) AS j) k JOIN c b ON b.pos = (a.pos + j + 1) % a.n WHERE j < a.n - 1),
    m AS (SELECT p.conv_id, p.code, concat(x.transcript, chr(10), y.transcript) AS text FROM p JOIN dialogues x ON x.conv_id = p.conv_id JOIN dialogues y ON y.conv_id = p.donor WHERE p.conv_id % 7 <> 0 OR p.j = 0)"""


@query(twin("dialogues", f"WITH {_PLAN} SELECT p.conv_id, p.code, p.donor, length(d.transcript) AS clean_chars, length(m.text) AS mixed_chars, length(o.transcript) AS donor_chars FROM p JOIN m USING (conv_id, code) JOIN dialogues d ON d.conv_id = p.conv_id JOIN dialogues o ON o.conv_id = p.donor"))
def transcript_pairs(spark, d):
    """Planned mixes with the clean and the mixed transcript of the item and with its donor's."""
    pairs, _ = _pairs(spark, d)
    donors = view(spark, d, "dialogues").select(F.col("conv_id").alias("donor"), F.length("transcript").cast("long").alias("donor_chars"))
    return pairs.join(donors, "donor").select("conv_id", "code", "donor", F.length("clean_text").cast("long").alias("clean_chars"), F.length("mixed_text").cast("long").alias("mixed_chars"), "donor_chars")


@query(twin("dialogues", f"WITH {_PLAN} SELECT count(*) AS planned, count(m.text) AS whole, CAST(0 AS BIGINT) AS no_clean, count(*) - count(m.text) AS no_mixed FROM p LEFT JOIN m USING (conv_id, code)"))
def pair_completeness(spark, d):
    """How many planned mixes have both transcripts."""
    return _pairs(spark, d)[1]


def _pairs(spark, d):
    talks = view(spark, d, "dialogues")
    plan = G.assign_donors(talks, "conv_id", 2, 21).withColumn("code", F.concat(F.lit("d"), F.col("j").cast("string")))
    donor = talks.select(F.col("conv_id").alias("donor"), F.col("transcript").alias("t"))
    mixed = plan.filter("conv_id % 7 <> 0 or j = 0").join(talks, "conv_id").join(donor, "donor").select("conv_id", "code", F.concat_ws("\n", "transcript", "t").alias("text"))
    recorded = mixed.unionByName(talks.select("conv_id", F.lit("clean").alias("code"), F.col("transcript").alias("text")))
    return G.assemble_pairs(plan, recorded, "conv_id", "code", "text")


_PLACED = """WITH b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, lang, source, n_chars FROM documents),
    r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, lang, source, CASE WHEN doc_id % 10 = 3 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id <> 17)"""


@query(f"{_PLACED} SELECT count(r.pos) AS n_release, count(b.pos) AS n_built, count(*) FILTER (b.lang = r.lang) AS lang, count(*) FILTER (b.source = r.source) AS source, count(*) FILTER (b.n_chars = r.n_chars) AS n_chars, min(coalesce(b.pos, r.pos)) FILTER (NOT coalesce(b.lang = r.lang AND b.source = r.source AND b.n_chars = r.n_chars, false)) AS first_difference FROM b FULL JOIN r ON b.pos = r.pos")
def field_match_audit(spark, d):
    """A release against the built table, field by field at the same place of two written files; the release lacks a row, so all later ones are shifted."""
    docs, path = table(spark, d, "documents"), store.scratch(spark, "labels")
    fields = ["lang", "source", "n_chars"]
    docs.select("doc_id", *fields).orderBy("doc_id").select(fields).write.json(f"{path}/built")
    changed = F.when(F.col("doc_id") % 10 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars")
    docs.filter("doc_id <> 17").select("doc_id", "lang", "source", changed).orderBy("doc_id").select(fields).write.json(f"{path}/release")
    built, release = (with_positions(spark.read.schema("lang string, source string, n_chars long").json(f"{path}/{n}")) for n in ("built", "release"))
    return match_report(built, release, fields)


_LEVEL = "SELECT lang, k // 1000 AS k, sum(n) AS n, md5(string_agg(h, ',' ORDER BY k)) AS h FROM ({}) GROUP BY lang, k // 1000"


@query("SELECT lang, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(h, ',' ORDER BY k)) AS fingerprint FROM (" + _LEVEL.format(_LEVEL.format("SELECT lang, doc_id AS k, 1 AS n, md5(concat(CAST(doc_id AS VARCHAR), '|', text)) AS h FROM documents")) + ") GROUP BY lang")
def fingerprint(spark, d):
    """A hash of all rows in order: rows by thousands of ids, these by thousands, and so on, so that no task gathers more than a thousand hashes of distinct ids."""
    level = table(spark, d, "documents").select("lang", F.col("doc_id").alias("k"), F.lit(1).cast("long").alias("n"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("text"))).alias("h"))
    joined = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ","))
    for _ in range(2):
        level = level.groupBy("lang", F.expr("k div 1000").alias("top")).agg(F.sum("n").alias("n"), joined.alias("h")).withColumnRenamed("top", "k")
    return level.groupBy("lang").agg(F.sum("n").alias("n"), joined.alias("fingerprint"))


@query("SELECT lang, count(*) AS n, bit_xor(CAST(('0x'||substr(md5(concat(CAST(doc_id AS VARCHAR), '|', text)),1,15)) AS BIGINT)) AS fingerprint FROM documents GROUP BY lang")
def fingerprint_unordered(spark, d):
    h = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("text"))), 1, 15), 16, 10).cast("bigint")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.bit_xor(h).alias("fingerprint"))


#: Pages go to files of so many buckets; a file holds the hashes of its pages, so that SQL can say what is in it.
_FILES = """SELECT b, string_agg(h, chr(10) ORDER BY h) || chr(10) AS content FROM (SELECT CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 2)) AS INT) AS b, md5(concat(CAST(page_id AS VARCHAR), '|', html)) AS h FROM pages) GROUP BY b"""


@query(f"WITH f AS ({_FILES}) SELECT 'bucket=' || CAST(b AS VARCHAR) AS path, sha256(content) AS sha256, CAST(length(content) AS BIGINT) AS size, CASE b % 5 WHEN 1 THEN 'mismatch' WHEN 2 THEN 'extra' ELSE 'ok' END AS status FROM f UNION ALL SELECT '../' || CAST(b AS VARCHAR), NULL, NULL, 'unsafe' FROM f WHERE b % 5 = 0 UNION ALL SELECT 'gone/' || CAST(b AS VARCHAR), NULL, NULL, 'missing' FROM f WHERE b % 5 = 1")
def checksum_audit(spark, d):
    """Written files against a manifest that has some of them wrong, lacks some, and lists some that aren't there or may not be."""
    path = store.scratch(spark, "release")
    pages = table(spark, d, "pages").select(F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 2), 16, 10).cast("int").alias("bucket"), F.md5(F.concat(F.col("page_id").cast("string"), F.lit("|"), "html")).alias("h"))
    # Sorted by bucket and hash, each bucket's rows are one file of one task.
    pages.repartition("bucket").sortWithinPartitions("bucket", "h").select("bucket", F.col("h").alias("value")).write.partitionBy("bucket").text(path)
    found = V.hashed_files(spark, path, "part-*").withColumn("path", F.regexp_extract("path", "^[^/]+", 0))
    number = F.regexp_extract("path", "[0-9]+", 0).cast("int")
    listed = found.filter(number % 5 != 2).select("path", F.when(number % 5 == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    odd = found.filter(number % 5 <= 1).select(F.concat(F.when(number % 5 == 0, "../").otherwise("gone/"), number.cast("string")).alias("path"), F.lit("0").alias("sha256"))
    done = V.verify(found, listed.unionByName(odd))
    return done.join(found.select("path", "sha256", "size"), "path", "left").select("path", "sha256", "size", "status")


_NORM = "trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]', '', 'g'))"
_PRIMED = f"""o AS (SELECT item_id, correct, {_NORM.format(x='topic')} AS t, letter, {_NORM.format(x='opt')} AS o FROM qa_options, LATERAL (VALUES ('A', a), ('B', b), ('C', c), ('D', e)) v(letter, opt)),
    pr AS (SELECT item_id, correct, letter AS primed FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN o = t THEN 0 ELSE 1 END, letter) AS r FROM o WHERE o = t OR (t <> '' AND (contains(t, o) OR contains(o, t)))) WHERE r = 1)"""


def _primed(spark, d):
    options = view(spark, d, "qa_options")
    letter = X.primed_option(F.col("topic"), [(k, F.col(c)) for k, c in zip("ABCD", "abce")])
    return options.select("item_id", "correct", letter.alias("primed")).filter("primed is not null")


@query(twin("qa_options", f"WITH {_PRIMED} SELECT item_id, correct, primed FROM pr"))
def priming_match(spark, d):
    return _primed(spark, d)


_SHARES = """a AS (SELECT engine, q.item_id, condition, ans, correct, primed FROM qa_answers q JOIN pr USING (item_id) WHERE primed <> correct), dd(distractor) AS (VALUES ('nonliteral'), ('bystander')),
    s AS (SELECT distractor, a.* FROM a, dd WHERE condition IN ('clean', distractor)),
    w AS (SELECT distractor, engine, item_id, correct, primed, max(ans) FILTER (condition = 'clean') AS c, max(ans) FILTER (condition <> 'clean') AS x FROM s GROUP BY ALL),
    r AS (SELECT distractor, CASE WHEN grouping(engine)=1 THEN 'all' ELSE engine END AS engine, count(DISTINCT item_id) AS n_items, round(100.0*count(*) FILTER (condition = 'clean' AND ans <> correct AND ans = primed)/nullif(count(*) FILTER (condition = 'clean' AND ans <> correct), 0), 6) AS share_clean,
        round(100.0*count(*) FILTER (condition <> 'clean' AND ans <> correct AND ans = primed)/nullif(count(*) FILTER (condition <> 'clean' AND ans <> correct), 0), 6) AS share_distracted FROM s GROUP BY GROUPING SETS ((distractor, engine), (distractor))),
    f AS (SELECT distractor, CASE WHEN grouping(engine)=1 THEN 'all' ELSE engine END AS engine, count(*) FILTER (c = correct AND x <> correct) AS n_newly_wrong, round(100.0*count(*) FILTER (c = correct AND x <> correct AND x = primed)/nullif(count(*) FILTER (c = correct AND x <> correct), 0), 6) AS share_newly_wrong FROM w GROUP BY GROUPING SETS ((distractor, engine), (distractor)))"""


@query(twin("qa_options qa_answers", f"WITH {_PRIMED}, {_SHARES} SELECT * FROM r JOIN f USING (distractor, engine)"))
def priming_shares(spark, d):
    """How often wrong answers, and answers that turn wrong, are the option that the insertion names; items that name the right option are left out."""
    from twinframe.operators.tables import grouped

    own = view(spark, d, "qa_answers").join(_primed(spark, d), "item_id").filter("primed <> correct")
    asked = F.when(F.col("condition") == "clean", F.array(F.lit("nonliteral"), F.lit("bystander"))).otherwise(F.array("condition"))
    rows = own.select("*", F.explode(asked).alias("distractor"))
    clean, wrong, hit = F.col("condition") == "clean", F.col("ans") != F.col("correct"), F.col("ans") == F.col("primed")
    share = lambda c, among: F.round(F.try_divide(100.0 * F.count_if(c & among), F.count_if(among)), 6)
    sets = [["distractor", "engine"], ["distractor"]]
    rates = grouped(rows, sets, [F.count_distinct("item_id").alias("n_items"), share(hit, clean & wrong).alias("share_clean"), share(hit, ~clean & wrong).alias("share_distracted")])
    wide = rows.groupBy("distractor", "engine", "item_id", "correct", "primed").agg(F.max(F.when(clean, F.col("ans"))).alias("c"), F.max(F.when(~clean, F.col("ans"))).alias("x"))
    flipped = F.coalesce((F.col("c") == F.col("correct")) & (F.col("x") != F.col("correct")), F.lit(False))
    flips = grouped(wide, sets, [F.count_if(flipped).alias("n_newly_wrong"), share(F.col("x") == F.col("primed"), flipped).alias("share_newly_wrong")])
    return rates.join(flips, ["distractor", "engine"])


@query("SELECT doc_id, CAST(k AS INT) AS n_head, CAST(len(w) - k AS INT) AS n_tail, len(w) + 3 AS n_tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w, least(5, len(regexp_extract_all(lower(text), '[a-z]+'))) AS k FROM documents)")
def align_tokens(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    cut = F.least(F.lit(5), F.size(words))
    mixed = F.concat(F.slice(words, F.lit(1), cut), F.array(F.lit("#1"), F.lit("#2"), F.lit("#3")), F.slice(words, cut + 1, F.size(words)))
    placed = table(spark, d, "documents").select("doc_id", F.size(words).alias("n"), X.align_insertion(words, mixed).alias("a"))
    first = (F.array_position("a", -1) - 1).cast("int")
    return placed.select("doc_id", first.alias("n_head"), (F.col("n") - first).alias("n_tail"), F.size("a").cast("long").alias("n_tokens"))


@query(twin("pairs", t_table_sql("", "SELECT model, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM (SELECT model, source_dataset, avg(CAST(c1-c0 AS DOUBLE)) AS d FROM pairs GROUP BY ALL) GROUP BY model", "model")))
def t_interval(spark, d):
    """Mean over datasets with its t interval and p."""
    own = view(spark, d, "pairs").groupBy("model", "source_dataset").agg(F.avg(F.col("c1") - F.col("c0")).alias("d"))
    return own.groupBy("model").agg(*S.one_sample_t(F.col("d"))).withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high")})


@query("SELECT o_orderkey, o_orderstatus, o_orderstatus = 'P' AS is_refusal, starts_with(o_orderpriority, '1') AS is_error, length(o_orderpriority) AS n_chars FROM orders")
def status_flags(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderstatus").isin("P").alias("is_refusal"), F.col("o_orderpriority").startswith("1").alias("is_error"), F.char_length("o_orderpriority").cast("long").alias("n_chars"))


@query("SELECT o_orderkey, CASE WHEN n_name IS NULL THEN 'none' ELSE coalesce(short, n_name) END AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (VALUES ('NATION_0','zero'), ('NATION_7','seven')) v(long_name, short) ON long_name = n_name")
def display_names(spark, d):
    short = F.map_from_arrays(F.array(F.lit("NATION_0"), F.lit("NATION_7")), F.array(F.lit("zero"), F.lit("seven")))
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", F.coalesce(F.try_element_at(short, F.col("n_name")), F.col("n_name"), F.lit("none")).alias("name"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber").subtract(rows.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1")
def drop_duplicates_ordered(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).filter("k = 1").select("l_orderkey", "l_linenumber", "l_extendedprice")


_CLUSTERED = "SELECT model, source_dataset, sum(CAST(c1-c0 AS DOUBLE)) AS total, CAST(count(c1-c0) AS DOUBLE) AS n FROM pairs GROUP BY ALL"


@query(twin("pairs", f"SELECT model, round(least(1.0, greatest(2*least(avg(CASE WHEN s <= 0 THEN 1.0e0 ELSE 0 END), avg(CASE WHEN s >= 0 THEN 1.0e0 ELSE 0 END)), 1/2000.0)), 6) AS p FROM ({replicates_sql(_CLUSTERED, 'model', 'source_dataset', 'total', 'n', 2000, 4)}) WHERE s IS NOT NULL GROUP BY model"))
def bootstrap_p(spark, d):
    units = S.cluster_sums(view(spark, d, "pairs"), ["model"], "source_dataset", F.col("c1") - F.col("c0"))
    return S.bootstrap_p(S.replicates_of(units, ["model"], "source_dataset", "total", "n", 2000, 4), ["model"], 2000)
