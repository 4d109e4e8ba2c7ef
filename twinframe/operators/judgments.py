"""Replies of judges: blinding, requests, lenient and strict parsing, checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blind_order(*key: Column, seed: int = 0) -> Column:
    """True where the clean text is shown first: parity of the last hex digit of a hash."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *key), 256)
    return F.conv(F.substring(digest, -1, 1), 16, 10).cast("int") % 2 == 0


def request_id(*parts: Column) -> Column:
    """The first 40 hex digits of the hash of the parts: equal inputs get equal requests."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 40)


#: A key that no reply has: it shows that a text ended where its JSON value did. A reply that has this character counts as no JSON.
_END = "\ue000"


def whole_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else as a VARIANT; null for any other. Keys that repeat in an object are no JSON here."""
    framed = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(f',"{_END}":0}}')))
    ended = F.try_variant_get(framed, f'$["{_END}"]', "int").isNotNull() & ~F.contains(text, F.lit(_END))
    return F.when(ended, F.try_variant_get(framed, "$.value", "variant"))


def kind_of(value: Column) -> Column:
    """BIGINT, DOUBLE, DECIMAL(..), STRING, BOOLEAN, VOID, OBJECT<..> or ARRAY<..>; null for null."""
    return F.schema_of_variant(value)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def braces(reply: Column) -> Column:
    """From the first opening to the last closing brace; null if these are not there in this order."""
    first = F.instr(reply, F.lit("{"))
    last = F.length(reply) - F.instr(F.reverse(reply), F.lit("}")) + 1
    return F.when((first > 0) & F.contains(reply, F.lit("}")) & (last > first), F.substring(reply, first, last - first + 1))


def parse_strict(df: DataFrame, reply: str = "judge_raw") -> DataFrame:
    """Add contamination, severity, reasoning, repaired, parse_error.

    What lies between a reply's outermost braces has to be a JSON object with integers (not true, not 1.0, not "1") in their range and a text as
    reasoning. Only if it is no JSON, and the reply is an object up to its last quote, a missing final brace is put back. A reply that
    fails has nulls, never 0.
    """
    text = F.col(reply)
    stripped = F.regexp_replace(text, r"^\s+|\s+\z", "")
    cut = F.when(stripped.startswith("{") & stripped.endswith('"'), whole_json(F.concat(stripped, F.lit("}"))))
    staged = df.withColumn("__v", whole_json(braces(text))).withColumns({"__r": F.col("__v").isNull(), "__v": F.coalesce("__v", cut)})
    exact = lambda n: F.when(kind_of(field(F.col("__v"), n)) == "BIGINT", F.try_variant_get("__v", f"$.{n}", "int"))
    said = F.when(kind_of(field(F.col("__v"), "reasoning")) == "STRING", F.try_variant_get("__v", "$.reasoning", "string"))
    staged = staged.withColumns({"__c": exact("contamination"), "__s": exact("severity"), "__t": said})
    ok = F.coalesce(F.col("__c").isin(0, 1) & F.col("__s").between(0, 3) & F.col("__t").isNotNull(), F.lit(False))
    made = {"contamination": F.when(ok, F.col("__c")), "severity": F.when(ok, F.col("__s")), "reasoning": F.when(ok, F.col("__t")), "repaired": ok & F.col("__r"), "parse_error": ~ok}
    return staged.withColumns(made).drop("__v", "__r", "__c", "__s", "__t")


def lenient_object(reply: Column) -> Column:
    """The reply as a VARIANT if it is JSON as a whole, else what lies between its outermost braces if that is; null unless it is an object."""
    whole = whole_json(reply)
    found = F.coalesce(whole, F.when(whole.isNull(), whole_json(braces(reply))))
    return F.when(kind_of(found).startswith("OBJECT"), found)


def _text(value: Column) -> Column:
    return F.regexp_replace(F.try_variant_get(value, "$", "string"), r"^\s+|\s+\z", "")


_NUMBER = "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"


def whole_number(value: Column) -> Column:
    """A JSON value as a whole number: numbers lose their fraction, true is 1, a string must be digits; anything else is null."""
    kind, text = kind_of(value), _text(value)
    digits = F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text.try_cast("int"))
    number = F.try_variant_get(value, "$", "double")
    small = F.when(F.abs(number) < 1e9, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("int"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int")).when(kind == "STRING", digits).when(kind.rlike(_NUMBER), small)


def real_number(value: Column) -> Column:
    """A JSON value as a double: numbers, true as 1, and strings that spell a decimal number; anything else is null."""
    kind, text = kind_of(value), _text(value)
    spelt = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind == "STRING", spelt).when(kind.rlike(_NUMBER), F.try_variant_get(value, "$", "double"))


def parse_paired(df: DataFrame, reply: str, first_is_clean: Column) -> DataFrame:
    """Two rows a reply: slots A and B un-blinded to conditions. Values outside their range make the whole reply a parse error."""
    parsed = lenient_object(F.col(reply))
    fields = {(s, f): f"__{s}_{f}" for s in "AB" for f in ("contamination", "severity")}
    wide = df.withColumn("__v", parsed)
    wide = wide.withColumns({name: whole_number(F.try_variant_get("__v", f"$.{s}.{f}", "variant")) for (s, f), name in fields.items()})
    fine = [F.col(f"__{s}_contamination").isin(0, 1) & F.col(f"__{s}_severity").between(0, 3) for s in "AB"]
    rows = F.array(*[
        F.struct(F.lit(c).alias("condition"), F.when(first_is_clean == is_first, "A").otherwise("B").alias("shown_as")) for c, is_first in (("clean", True), ("distracted", False))
    ])
    out = wide.withColumns({"__ok": F.coalesce(fine[0] & fine[1], F.lit(False)), "__r": F.explode(rows)})
    take = lambda f: F.when(F.col("__ok"), F.when(F.col("__r.shown_as") == "A", F.col(f"__A_{f}")).otherwise(F.col(f"__B_{f}")))
    made = out.withColumns({"condition": F.col("__r.condition"), "shown_as": F.col("__r.shown_as"), "contamination": take("contamination"), "severity": take("severity"), "parse_error": ~F.col("__ok")})
    return made.drop("__v", "__ok", "__r", *fields.values())


def parse_single(df: DataFrame, reply: str) -> DataFrame:
    """contamination 0 or 1 and severity 0 to 3 of a reply about one note; a value that fails makes both null."""
    wide = df.withColumn("__v", lenient_object(F.col(reply)))
    c, s = (whole_number(F.try_variant_get("__v", f"$.{f}", "variant")) for f in ("contamination", "severity"))
    ok = F.coalesce(c.isin(0, 1) & s.between(0, 3), F.lit(False))
    return wide.withColumns({"contamination": F.when(ok, c), "severity": F.when(ok, s), "parse_error": ~ok}).drop("__v")


def parse_quality(df: DataFrame, reply: str, metrics: list[str]) -> DataFrame:
    """Metrics from 1 to 5 and hallucination 0 or 1, as numbers or spelt; a value that fails makes all null."""
    names = [*metrics, "hallucination"]
    wide = df.withColumn("__v", lenient_object(F.col(reply)))
    wide = wide.withColumns({f"__{m}": real_number(field(F.col("__v"), m)) for m in names})
    ok = F.coalesce(F.col("__hallucination").isin(0.0, 1.0), F.lit(False))
    for m in metrics:
        ok = ok & F.coalesce(F.col(f"__{m}").between(1, 5), F.lit(False))
    return wide.withColumns({**{m: F.when(ok, F.col(f"__{m}")) for m in names}, "parse_error": ~ok}).drop("__v", *[f"__{m}" for m in names])


def parse_attribution(df: DataFrame, reply: str) -> DataFrame:
    """attribution (patient, correct, absent; the older third_party is correct) in any case and spacing, and used_for_patient as a whole number; unknown labels are errors."""
    wide = df.withColumn("__v", lenient_object(F.col(reply)))
    wide = wide.withColumns({"__l": F.lower(_text(field(F.col("__v"), "attribution"))), "__u": whole_number(field(F.col("__v"), "used_for_patient"))})
    label = F.when(F.col("__l") == "third_party", "correct").otherwise(F.col("__l"))
    ok = F.coalesce(label.isin("patient", "correct", "absent") & F.col("__u").isin(0, 1), F.lit(False))
    return wide.withColumns({"attribution": F.when(ok, label), "used_for_patient": F.when(ok, F.col("__u")), "parse_error": ~ok}).drop("__v", "__l", "__u")


def validate_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Many-to-one left join that fails at run time if a key is twice on the right or a left row finds none."""
    once = right.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    joined = left.join(once, keys, "left")
    checked = F.when(F.col("__n").isNull(), F.raise_error(F.lit("no match for a key"))).when(F.col("__n") > 1, F.raise_error(F.lit("a key occurs twice")))
    return joined.filter(F.coalesce(checked.cast("int"), F.lit(1)) == 1).drop("__n")
