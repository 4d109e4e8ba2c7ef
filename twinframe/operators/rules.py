"""Rules, lexicons, templates and slots that are input tables.

Tables of rules are small by nature: they are read once, within a stated bound, and become one expression that each task compiles once.
Lexicons may be large and are joined.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules and templates that a table may have.
MOST = 1000
#: A doubled brace, or a field.
_FIELD = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def _bounded(table: DataFrame, columns: list[str], order: list[str]) -> list:
    rows = table.select(*order, *[c for c in columns if c not in order]).limit(MOST + 1).collect()  # MOST + 1 rows at most
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} rows in a table of rules")
    return sorted(rows, key=lambda r: tuple(r[c] for c in order))


def first_match(text: Column, rules: DataFrame, default: str, rank: str = "rank", pattern: str = "pattern", label: str = "label", fold: bool = True) -> Column:
    """The label of the first rule, in the order of ``rank``, whose pattern occurs in the text (``fold``: in lower case); ``default`` if none. Null counts as empty."""
    low = F.coalesce(F.lower(text) if fold else text, F.lit(""))
    return F.coalesce(*[F.when(low.rlike(r[pattern]), F.lit(r[label])) for r in _bounded(rules, [pattern, label], [rank])], F.lit(default))


def keyword_scores(texts: DataFrame, keys: list[str], text: str, lexicon: DataFrame, word: str = "word", weight: str | None = None) -> DataFrame:
    """(keys, score): the tokens of each text that are in the lexicon, as they are or without a final s; a token counts once, with the greatest weight that fits (1 without weights).

    Tokens are counted in their text before they meet the lexicon, whose words are joined, not collected. Rows that share ``keys`` are one text. Texts without such tokens have 0.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    base = lexicon.select(F.lower(word).alias("token"), w.alias("w")).filter("token is not null")
    known = base.unionByName(base.select(F.concat("token", F.lit("s")).alias("token"), "w")).groupBy("token").agg(F.max("w").alias("w"))
    tokens = texts.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    found = tokens.join(known, "token").groupBy(*keys).agg(F.sum(F.col("n") * F.col("w")).alias("score"))
    return texts.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("score", F.lit(0).cast("long")).alias("score"))


def rendered(rows: DataFrame, templates: DataFrame, kind: str = "kind", template: str = "template", out: str = "prompt") -> DataFrame:
    """Add to each row the text of its kind's template, with ``{name}`` replaced by the row's column of that name and ``{{`` and ``}}`` by braces.

    Null columns show as nothing. Text that a column puts in is not looked at again. A kind without a template, and a field without a column, are errors.
    """
    made = []
    for r in _bounded(templates, [template], [kind]):
        parts, at = [], 0
        for found in _FIELD.finditer(r[template]):
            name = found[1]
            if name and name not in rows.columns:
                raise ValueError(f"the template {r[kind]} asks for {name!r}")
            parts += [F.lit(r[template][at : found.start()]), F.coalesce(rows[name].cast("string"), F.lit("")) if name else F.lit(found[0][0])]
            at = found.end()
        parts.append(F.lit(r[template][at:]))
        made.append((r[kind], F.concat(*parts)))
    unknown = F.raise_error(F.concat(F.lit("no template of the kind "), F.coalesce(F.col(kind), F.lit("null")))).cast("string")
    return rows.withColumn(out, reduce(lambda rest, m: F.when(F.col(kind) == m[0], m[1]).otherwise(rest), reversed(made), unknown))


def lookup_or_pick(items: DataFrame, key: str, known: DataFrame, systems: DataFrame, seed: int, system: str = "system", general: str = "general") -> DataFrame:
    """Add each item's system: that of ``known`` (key, system); where it has none, or ``general``, a seeded pick among the other systems of the table ``systems``.

    The pick hangs on the seed and the item alone. Systems are few and numbered by name; without any other system it stays ``general``.
    """
    listed = systems.select(system).filter(F.col(system).isNotNull() & (F.col(system) != general)).distinct()
    numbered = listed.agg(F.array_sort(F.collect_set(system)).alias("__s"))  # one row: the names of systems
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    joined = items.join(known.select(key, system), key, "left").crossJoin(F.broadcast(numbered))
    pick = F.coalesce(F.try_element_at("__s", (F.pmod(hashed, F.greatest(F.size("__s"), F.lit(1))) + 1).cast("int")), F.lit(general))
    own = F.coalesce(system, F.lit(general))
    return joined.withColumn(system, F.when(own == general, pick).otherwise(own)).drop("__s")


def shuffled_slots(slots: DataFrame, system: str, topic: str, seed: int) -> DataFrame:
    """Add ``place`` (from 0) and ``n_slots``: the slots of each system in a seeded order that hangs on their names alone. A system's slots are a list of tens."""
    own = Window.partitionBy(system)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(system), F.col(topic)))
    return slots.withColumns({"place": (F.row_number().over(own.orderBy(order, topic)) - 1).cast("long"), "n_slots": F.count("*").over(own)})


def assign_slots(items: DataFrame, slots: DataFrame, system: str, k: str, relatives: int, others: int, allowed: str = "relatives_ok") -> DataFrame:
    """Add the slot of each item and the place of its relation in the pool of ``relatives`` + ``others`` persons, relatives first.

    Item ``k`` (from 0 in its system) goes round the shuffled slots, and its relation round the pool; a slot that doesn't allow relatives has the others alone.
    """
    joined = items.join(slots.select(system, "n_slots").distinct(), system).withColumn("place", F.col(k) % F.col("n_slots"))
    placed = joined.join(slots.drop("n_slots"), [system, "place"])
    pool = F.when(F.col(allowed), F.lit(relatives + others)).otherwise(F.lit(others))
    turn = (F.floor(F.col(k) / F.col("n_slots")) + F.col(k)) % pool
    return placed.withColumn("relation", F.when(F.col(allowed), turn).otherwise(turn + relatives).cast("long")).drop("place", "n_slots")
