"""The entities of a paired evaluation as views over the base tables.

Each statement runs in Spark and in the SQL twin alike, except where two forms are given.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK: dict[str, str] = {
    "judgments": """
        SELECT o_orderpriority AS source_dataset,
               CASE WHEN substr(o_orderpriority,1,1) IN ('1','2') THEN 'family_a' ELSE 'family_b' END AS family,
               CAST(l_orderkey AS STRING) AS item_id, concat('m', CAST(l_suppkey % 4 AS STRING)) AS model,
               CASE WHEN l_linestatus = 'O' THEN 'bystander' ELSE 'nonliteral' END AS distractor_type,
               CASE WHEN l_linenumber % 2 = 1 THEN 'clean' ELSE 'distracted' END AS condition,
               MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS contamination,
               MAX(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS contamination_b,
               MAX(CASE WHEN l_returnflag = 'R' THEN 1 + CAST(floor(l_quantity) AS INT) % 3 ELSE 0 END) AS severity,
               MAX(1 + CAST(floor(l_quantity) AS INT) % 5) AS overall_quality,
               MAX(1 + CAST(floor(l_quantity) AS INT) % 4) AS completeness,
               MAX(1 + CAST(floor(l_quantity / 3) AS INT) % 5) AS clinical_correctness,
               MAX(1 + CAST(floor(l_quantity / 7) AS INT) % 5) AS succinctness,
               MAX(CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS hallucination,
               MAX(CAST(floor(l_extendedprice) AS BIGINT)) AS transcript_chars
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5, 6""",
    "pairs": """
        SELECT source_dataset, family, item_id, model, distractor_type,
               MAX(CASE WHEN condition = 'clean' THEN contamination END) AS c0, MAX(CASE WHEN condition = 'distracted' THEN contamination END) AS c1,
               MAX(CASE WHEN condition = 'clean' THEN contamination_b END) AS b0, MAX(CASE WHEN condition = 'distracted' THEN contamination_b END) AS b1,
               MAX(CASE WHEN condition = 'clean' THEN severity END) AS s0, MAX(CASE WHEN condition = 'distracted' THEN severity END) AS s1,
               MAX(CASE WHEN condition = 'clean' THEN overall_quality END) AS q0, MAX(CASE WHEN condition = 'distracted' THEN overall_quality END) AS q1,
               MAX(CASE WHEN condition = 'clean' THEN completeness END) AS k0, MAX(CASE WHEN condition = 'distracted' THEN completeness END) AS k1,
               MAX(CASE WHEN condition = 'clean' THEN clinical_correctness END) AS t0, MAX(CASE WHEN condition = 'distracted' THEN clinical_correctness END) AS t1,
               MAX(CASE WHEN condition = 'clean' THEN succinctness END) AS u0, MAX(CASE WHEN condition = 'distracted' THEN succinctness END) AS u1,
               MAX(CASE WHEN condition = 'clean' THEN hallucination END) AS h0, MAX(CASE WHEN condition = 'distracted' THEN hallucination END) AS h1,
               MAX(CASE WHEN condition = 'clean' THEN transcript_chars END) AS chars
        FROM {judgments} GROUP BY 1, 2, 3, 4, 5
        HAVING COUNT(DISTINCT condition) = 2""",
    "qa_per_item": """
        SELECT concat('e', CAST(l_suppkey % 8 AS STRING)) AS engine, l_partkey AS item_id,
               CASE l_linenumber % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'nonliteral' ELSE 'bystander' END AS condition,
               MAX(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS is_correct,
               MAX(CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END) AS is_invalid
        FROM lineitem GROUP BY 1, 2, 3""",
    "qa_prompts": """
        SELECT concat('e', CAST(l_suppkey % 8 AS STRING)) AS engine, l_partkey AS item_id,
               CASE l_orderkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'terse' ELSE 'verbose' END AS prompt,
               CASE l_linenumber % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'nonliteral' ELSE 'bystander' END AS condition,
               MAX(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS is_correct,
               MAX(CASE WHEN l_quantity >= 45 + l_suppkey % 4 THEN 1 ELSE 0 END) AS is_invalid
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "item_arms": """
        SELECT concat('m', CAST(l_suppkey % 2 AS STRING)) AS model, l_partkey AS item_id,
               CASE l_linenumber % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'interference' WHEN 2 THEN 'random' ELSE 'all' END AS intervention,
               MAX(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS is_correct
        FROM lineitem GROUP BY 1, 2, 3""",
    "utterances": """
        SELECT CAST(conv_id AS STRING) AS item_id, role AS speaker, turn, CAST(turn*4 + turn%2 AS DOUBLE) AS start_s,
               CAST(turn*4 + turn%2 + 3 AS DOUBLE) AS end_s, text FROM conversations""",
    "dialogues": """
        SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, concat(role, ': ', replace(text, chr(10), ' ')) AS line))),
               x -> x.line), chr(10)) AS transcript FROM conversations GROUP BY conv_id""",
    "asides": """
        SELECT i.conv_id, i.conv_id % 2 = 0 AS bystander, substr(i.distractor_summary, 1, 12) AS stem, concat(
               CASE i.conv_id % 13 WHEN 3 THEN 'assistant: so' ELSE concat('user: a friend of mine ', substr(i.distractor_summary, 1, CASE i.conv_id % 13 WHEN 4 THEN 600 ELSE 40 END)) END, chr(10),
               CASE i.conv_id % 13 WHEN 2 THEN 'nurse: hm' ELSE ' assistant: I see ' END, chr(10),
               CASE i.conv_id % 13 WHEN 5 THEN 'user: anyway, about your day' WHEN 6 THEN 'user: is it hereditary' WHEN 7 THEN 'user: like my own knees' WHEN 8 THEN 'user: I had a small stroke'
                    WHEN 9 THEN 'user: could I have some pain' WHEN 10 THEN '' ELSE 'user: well' END,
               CASE i.conv_id % 13 WHEN 1 THEN concat(chr(10), 'user: and', chr(10), 'assistant: yes') WHEN 3 THEN concat(chr(10), 'user: ', substr(i.distractor_summary, 1, 40)) ELSE '' END) AS c
        FROM {insertions} i""",
    "bench_at": """
        SELECT bench_id, bench_text, base + row_number() OVER (PARTITION BY bucket ORDER BY bench_id) - 1 AS at, n
        FROM (SELECT item_id AS bench_id, text AS bench_text, floor(item_id / 4096) AS bucket FROM benchmark) x JOIN (
            SELECT bucket, sum(c) OVER (ORDER BY bucket) - c AS base, sum(c) OVER () AS n
            FROM (SELECT floor(item_id / 4096) AS bucket, count(*) AS c FROM benchmark GROUP BY 1) y) z USING (bucket)""",
    "insertions": """
        SELECT c.conv_id, b.bench_id, 1 + c.conv_id % 3 AS insert_after_turn,
               concat('user: ', replace(b.bench_text, chr(10), ' '), chr(10), 'assistant: noted') AS distractor_conversation,
               b.bench_text AS distractor_summary
        FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN (SELECT max(n) AS n FROM {bench_at}) k ON true JOIN {bench_at} b ON b.at = c.conv_id % k.n""",
    "leak_pairs": """
        SELECT d.doc_id, d.lang, d.source, d.text AS clean_transcript, b.bench_text AS segment_text,
               concat(d.text, ' ', substr(b.bench_text, 1, CAST(floor(length(b.bench_text) / 2) AS INT))) AS mixed_transcript
        FROM documents d JOIN (SELECT max(n) AS n FROM {bench_at}) k ON true JOIN {bench_at} b ON b.at = d.doc_id % k.n""",
    "notes": """
        SELECT d.doc_id, d.lang AS model, CASE WHEN d.doc_id % 2 = 0 THEN 'nonliteral' ELSE 'bystander' END AS distractor_type, d.doc_id % 3 <> 0 AS incorporated,
               CASE d.doc_id % 4 WHEN 0 THEN 'misattributed' WHEN 1 THEN 'acted_on' WHEN 2 THEN 'recorded_only' ELSE 'not_incorporated' END AS outcome,
               CASE d.doc_id % 7 WHEN 0 THEN 'restated as a Chief Complaint' WHEN 1 THEN 'a tangential remark' WHEN 2 THEN 'hereditary' WHEN 3 THEN 'an unvoiced worry'
                    WHEN 4 THEN 'a hobby' WHEN 5 THEN 'taken as a factual report' END AS rationale,
               concat(b.bench_text, ' (aside; patient said so)') AS topic,
               concat(CASE d.doc_id % 5 WHEN 0 THEN 'Chief Complaint:' WHEN 1 THEN '## History of Present Illness' WHEN 2 THEN '**S: Subjective**' WHEN 3 THEN 'Odd words of a header' ELSE 'no header, but text.' END, chr(10),
                      substr(d.text, 1, CAST(floor(length(d.text) / 3) AS INT)), chr(10), CASE WHEN d.doc_id % 4 = 0 THEN b.bench_text ELSE 'nothing' END, chr(10),
                      CASE d.doc_id % 6 WHEN 0 THEN '**Assessment:** ' WHEN 1 THEN 'Physical Exam: ' WHEN 2 THEN 'O: labs' WHEN 3 THEN 'Impression' WHEN 4 THEN 'Family History:' ELSE 'Social history: ' END, chr(10),
                      substr(d.text, 1 + CAST(floor(length(d.text) / 3) AS INT), CAST(floor(length(d.text) / 3) AS INT)), chr(10), CASE WHEN d.doc_id % 3 = 0 THEN 'P: consider ' ELSE 'Plan: ' END,
                      CASE WHEN d.doc_id % 5 < 2 THEN b.bench_text ELSE 'rest' END, chr(10), substr(d.text, 1 + 2 * CAST(floor(length(d.text) / 3) AS INT))) AS note
        FROM documents d JOIN (SELECT max(n) AS n FROM {bench_at}) k ON true JOIN {bench_at} b ON b.at = d.doc_id % k.n""",
    "qa_options": """
        SELECT item_id, a, b, c, e, correct, CASE item_id % 5 WHEN 0 THEN concat(upper(first), '!') WHEN 1 THEN concat('an old ', first) WHEN 2 THEN substr(first, 1, 3) WHEN 3 THEN NULL ELSE first END AS topic
        FROM (SELECT *, CASE WHEN correct <> 'A' THEN a ELSE b END AS first FROM (
            SELECT p_partkey AS item_id, p_type AS a, substr(p_name, 1, instr(p_name, ' ') - 1) AS b, substr(p_name, instr(p_name, ' ') + 1) AS c, p_brand AS e, substr('ABCD', CAST(1 + p_size % 4 AS INT), 1) AS correct FROM part) x) y""",
    "qa_answers": """
        SELECT concat('e', CAST(l_suppkey % 8 AS STRING)) AS engine, l_partkey AS item_id, CASE l_linenumber % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'nonliteral' ELSE 'bystander' END AS condition,
               MAX(substr('ABCD', CAST(1 + (l_orderkey + l_linenumber) % 4 AS INT), 1)) AS ans
        FROM lineitem GROUP BY 1, 2, 3""",
    "head_masks": """
        SELECT label AS model, CASE WHEN vec_id % 2 = 0 THEN 'nonliteral' ELSE 'bystander' END AS distractor, vec_id AS seed,
               CAST(pos DIV 8 AS INT) AS layer, CAST(pos % 8 AS INT) AS head, round(1 / (1 + exp(-10 * CAST(x AS DOUBLE))), 9) AS gate
        FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x""",
    "raters": "SELECT doc_id, quality AS paired, 1 - toxic AS single FROM labels",
    "responses": """
        SELECT p_partkey AS item_id, substr('ABCD', CAST(1 + p_size % 4 AS INT), 1) AS correct_answer,
               CASE p_partkey % 8
                 WHEN 0 THEN concat('Therefore, the final answer is [', substr('ABCD', CAST(1 + p_partkey % 4 AS INT), 1), '].')
                 WHEN 1 THEN concat('... the answer is ', substr('ABCD', CAST(1 + p_partkey % 3 AS INT), 1), '.')
                 WHEN 2 THEN concat('boxed{', substr('ABCD', CAST(1 + p_size % 4 AS INT), 1), '}')
                 WHEN 3 THEN concat('Therefore, the final answer is: ', substr('ABCD', CAST(1 + p_size % 4 AS INT), 1))
                 WHEN 4 THEN 'I think (a) is right'
                 WHEN 5 THEN concat('options (A) and [B], finally (', substr('ABCDE', CAST(1 + p_size % 5 AS INT), 1), ')')
                 WHEN 6 THEN concat('**', substr('ABCD', CAST(1 + p_size % 4 AS INT), 1), '**')
                 ELSE p_name END AS response
        FROM part""",
    "judge_raw": """
        SELECT event_id, user_id, ts, CASE event_id % 23
                 WHEN 0 THEN substr(good, 1, length(good) - 1)
                 WHEN 1 THEN concat('{"contamination": true, "severity": ', s, ', "reasoning": "r"}')
                 WHEN 2 THEN 'truncated response'
                 WHEN 3 THEN concat('{"contamination": ', c, ', "severity": ', s, ', garbage}')
                 WHEN 4 THEN concat(good, '}}')
                 WHEN 5 THEN concat('{', chr(10), '  "contamination": ', c, ',', chr(10), '  "severity": ', s, ',', chr(10), '  "reasoning": "r"', chr(10), '}', chr(10))
                 WHEN 6 THEN concat('Here you are: ', good, ' as asked.')
                 WHEN 7 THEN concat('{"contamination": ', c, ', "severity": ', s, '}')
                 WHEN 8 THEN concat('{"contamination": ', c, ', "severity": ', s, ', "reasoning": 7}')
                 WHEN 9 THEN concat('{"contamination": "', c, '", "severity": ', s, ', "reasoning": "r"}')
                 WHEN 10 THEN concat('{"contamination": ', c, '.0, "severity": ', s, ', "reasoning": "r"}')
                 WHEN 11 THEN concat('{"contamination": ', c, ', "severity": 4, "reasoning": "r"}')
                 WHEN 12 THEN concat('  {"contamination": ', c, ', "severity": ', s, ', "reasoning": "not done"')
                 WHEN 13 THEN concat('{"reasoning": "a } brace", "contamination": ', c, ', "severity": ', s, '}')
                 WHEN 14 THEN concat('{"reasoning": "cut } at a brace", "contamination": ', c, ', "severity": "', s, '"')
                 ELSE good END AS judge_raw
        FROM (SELECT event_id, user_id, ts, CAST(event_id % 2 AS STRING) AS c, CAST(event_id % 4 AS STRING) AS s,
                     concat('{"contamination": ', CAST(event_id % 2 AS STRING), ', "severity": ', CAST(event_id % 4 AS STRING), ', "reasoning": "r"}') AS good
              FROM events) x""",
}
def _filled(views: dict[str, str]) -> dict[str, str]:
    """The statements with those that they stand on put in."""
    views = views | {"asides": views["asides"].replace("{insertions}", f"({views['insertions']})")}
    return {k: v.replace("{judgments}", f"({views['judgments']}) j").replace("{bench_at}", f"({views['bench_at']})") for k, v in views.items()}


# Items are numbered in ranges of their ids, so the one window over everything has a row for each range; the twin numbers them plainly.
_NUMBERED = "SELECT item_id AS bench_id, text AS bench_text, row_number() OVER (ORDER BY item_id) - 1 AS at, count(*) OVER () AS n FROM benchmark"
DUCK: dict[str, str] = _filled(SPARK | {"bench_at": _NUMBERED}) | {
    "dialogues": """
        SELECT conv_id, string_agg(concat(role, ': ', replace(text, chr(10), ' ')), chr(10) ORDER BY turn) AS transcript
        FROM conversations GROUP BY conv_id""",
    "head_masks": """
        SELECT label AS model, CASE WHEN vec_id % 2 = 0 THEN 'nonliteral' ELSE 'bystander' END AS distractor, vec_id AS seed,
               CAST(floor((i-1)/8) AS INT) AS layer, CAST((i-1) % 8 AS INT) AS head, round(1/(1+exp(-10*CAST(embedding[i] AS DOUBLE))), 9) AS gate
        FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i)""",
}


def _both(name: str, value: str) -> str:
    return f"MAX(CASE WHEN clean THEN {value} END) AS {name}0, MAX(CASE WHEN NOT clean THEN {value} END) AS {name}1"


# In Spark the lines of an item meet once, dealt by ``item_id``, under short keys: the maxima of a pair are those of its lines, as the maximum of maxima is.
# SQL's concat passes over nulls, as concat_ws does.
_ITEM_LINES = """
        (SELECT l.*, o_orderpriority AS source_dataset FROM lineitem l JOIN orders o ON l.item_id = o.item_id)"""
_PAIRS = f"""
        SELECT source_dataset, CASE WHEN substr(source_dataset,1,1) IN ('1','2') THEN 'family_a' ELSE 'family_b' END AS family, item_id,
               concat_ws('', 'm', CAST(m AS STRING)) AS model, CASE WHEN bystander THEN 'bystander' ELSE 'nonliteral' END AS distractor_type,
               c0, c1, b0, b1, s0, s1, q0, q1, k0, k1, t0, t1, u0, u1, h0, h1, chars
        FROM (SELECT source_dataset, item_id, m, bystander,
                     {_both('c', "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")},
                     {_both('b', "CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END")},
                     {_both('s', "CASE WHEN l_returnflag = 'R' THEN 1 + CAST(floor(l_quantity) AS INT) % 3 ELSE 0 END")},
                     {_both('q', "1 + CAST(floor(l_quantity) AS INT) % 5")},
                     {_both('k', "1 + CAST(floor(l_quantity) AS INT) % 4")},
                     {_both('t', "1 + CAST(floor(l_quantity / 3) AS INT) % 5")},
                     {_both('u', "1 + CAST(floor(l_quantity / 7) AS INT) % 5")},
                     {_both('h', "CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END")},
                     MAX(CASE WHEN clean THEN CAST(floor(l_extendedprice) AS BIGINT) END) AS chars
              FROM (SELECT *, l_suppkey % 4 AS m, coalesce(l_linestatus = 'O', false) AS bystander, coalesce(l_linenumber % 2 = 1, false) AS clean FROM {_ITEM_LINES}) x
              GROUP BY source_dataset, item_id, m, bystander HAVING MAX(clean) AND MAX(NOT clean)) y"""
_JUDGMENTS = SPARK["judgments"].replace("CAST(l_orderkey AS STRING) AS item_id", "item_id").replace("o_orderpriority", "source_dataset").replace("source_dataset AS source_dataset", "source_dataset").replace("concat('m',", "concat_ws('', 'm',").replace("lineitem JOIN orders ON l_orderkey = o_orderkey", f"{_ITEM_LINES} x")
SPARK = _filled(SPARK | {"judgments": _JUDGMENTS, "pairs": _PAIRS})
#: Lines of items that one task takes in, whatever the size of the table.
ITEM_ROWS = 120_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_item(lines: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    """Lines and orders with ``item_id``, the lines dealt by it to as many partitions as keep a task's share the same at any size. What is grouped by item later stays where it is."""
    parts = -(-lines.count() // ITEM_ROWS)  # the count is read from the files' footers
    dealt = lines.withColumn("item_id", F.col("l_orderkey").cast("string")).repartition(max(1, parts), "item_id")
    return {"lineitem": dealt, "orders": orders.select(F.col("o_orderkey").cast("string").alias("item_id"), "o_orderpriority")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One entity, with only the columns read that the caller uses."""
    text = SPARK[name].replace("{", "{{").replace("}", "}}")
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    if name in ("judgments", "pairs"):
        used |= _by_item(used["lineitem"], used["orders"])
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text)
    return spark.sql(text, **used)


def twin(names: str, body: str) -> str:
    """SQL over entities: ``names`` (space-separated) become leading common table expressions."""
    ctes = [f"{n} AS ({DUCK[n]})" for n in names.split()]
    head, rest = re.match(r"(?s)\s*(WITH RECURSIVE |WITH |)(.*)", body).groups()
    return (head if "RECURSIVE" in head else "WITH ") + ", ".join(ctes) + (", " if head else " ") + rest
