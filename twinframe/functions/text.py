"""Text functions on columns: splicing, sentences, content words, answers, word errors, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line that opens a speaker's turn.
TURN = r"^\s*(\[[A-Za-z ]+\]|[A-Za-z ]+:)"
#: Words that carry no content in leakage counts.
STOP_WORDS = """
that this with have been were they them their there what when where which while would could should about after
before because just like some more most very really okay yeah right know think going want well also then than from
into over only other your yours thing things something anything nothing kind sort little much many does doing done
said says being come came coming here still since again maybe actually probably quite pretty sure good great fine
thank thanks hello morning today tomorrow yesterday week weeks days time times last next first long take taking taken
make making made need needs look looking feel feeling felt tell told mean means sorry please will might must shall
ever never always sometimes every each both same such through under around down away until though although whether
either neither anyone everyone someone people person else lots okay mmhmm umm hmmm bye
""".split()
#: Widths of the bands in which an edit distance is looked for before the whole table of distances is filled.
BANDS = (16, 128, 1024)
#: Reply formats in order of precedence; (pattern, whether its last match counts instead of its first).
ANSWER_PATTERNS = [
    (r"the answer is ([A-D])", False),
    (r"(?i)answer is ([A-D])\.?", False),
    (r"(?i)Therefore, the final model answer is ([A-D])", False),
    (r"boxed\{([A-D])\}", False),
    (r"The answer is \*\*\[([A-D])\]", False),
    (r"(?i)Answer: ([A-D])", False),
    (r"(?i)Answer:\*\* ([A-D])", False),
    (r"is ([A-D])", False),
    (r"[\(\[]([A-Z])[\)\]]", True),
    (r"\*\*([A-D])\*\*", False),
    (r"\[([A-D])\]", False),
    (r"(?i)Choice ([A-D])", False),
    (r"(?i)\[\*\*([A-D])\]", False),
    (r"(?i)\[([A-D])\*\*\]", False),
    (r"(?i)My Answer\n\*\*([A-D])", False),
    (r"(?i)\n\n\*\*Answer:\*\*\n([A-D])", False),
]
#: Fixed value: an explicit final answer in a looser format.
FINAL_ANSWER = r"(?i)(?:therefore[, :]*\s*)?(?:the\s+)?(?:final\s+)(?:model\s+)?answer\s*(?:is)?\s*[:=\-]?\s*[\"'`]*[\[(]*\**\s*([A-D])(?:\b|\**)"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda a plain expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines without trailing empty ones."""
    return F.split(F.regexp_replace(text, r"[\r\n]+$", ""), r"\r\n|\n|\r")


def relabel(inserted: Column, transcript: Column) -> Column:
    """Speaker labels ``Doctor:`` as ``[doctor]`` where the transcript uses brackets."""
    bracketed = transcript.rlike(r"(?m)^\s*\[[A-Za-z ]+\]")
    styled = F.transform(lines(inserted), lambda x: F.when(x.rlike(r"^[A-Za-z ]+:"), F.concat(F.lit("["), F.lower(F.regexp_extract(x, r"^([A-Za-z ]+):", 1)), F.lit("] "), F.ltrim(F.regexp_replace(x, r"^[A-Za-z ]+:", "")))).otherwise(x))
    return F.when(bracketed, F.array_join(styled, "\n")).otherwise(inserted)


def splice_after_turn(transcript: Column, inserted: Column, k: Column) -> Column:
    """``inserted`` after the k-th speaker turn; k is clamped to the turns there are, no turns: at the end. Either side may be empty."""

    def spliced(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: F.element_at(rows, i).rlike(TURN))
        after = F.least(F.greatest(k, F.lit(1)), F.size(starts)) + 1
        cut = F.coalesce(F.when(F.size(starts) > 0, F.try_element_at(starts, after.cast("int"))), F.size(rows) + 1)
        return F.array_join(F.concat(F.slice(rows, 1, cut - 1), F.array(inserted), F.slice(rows, cut, F.size(rows))), "\n")

    joined = let(lines(transcript), spliced)
    return F.when(F.coalesce(F.length(transcript), F.lit(0)) == 0, inserted).when(F.coalesce(F.length(inserted), F.lit(0)) == 0, transcript).otherwise(joined)


def speaker_tags(transcript: Column, default: list[str]) -> Column:
    """Distinct speakers in order of appearance, or the default."""
    found = F.array_distinct(F.regexp_extract_all(transcript, F.lit(r"(?m)^([A-Za-z]+):"), F.lit(1)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, default)))


def insert_sentence(question: Column, sentence: Column) -> Column:
    """Before the last sentence; a single sentence gets it in front. Space between sentences becomes one space."""
    parts = F.split(question, r"(?<=[.!?]) +")
    return F.array_join(F.array_insert(parts, F.size(parts), sentence), " ")


def tidy(text: Column) -> Column:
    """Lines without outer blanks, runs of blanks as one, no white space before punctuation; newlines stay."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    for pattern, put in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\s+([,.;:?!])", "$1"), (r"^\s+|\s+\z", "")):
        out = F.regexp_replace(out, pattern, put)
    return out


def clean_text(text: Column, tags: str) -> Column:
    """Without what the pattern ``tags`` matches, and with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, tags, ""), r"\s+", " "))


def remove_sentence(question: Column, sentence: Column) -> Column:
    """Without the first occurrence of the sentence, then tidied; a question without it is an error."""
    at = F.instr(question, sentence)
    before = F.regexp_replace(F.substring(question, F.lit(1), at - 1), r"\s+\z", "")
    after = F.regexp_replace(F.substring(question, at + F.length(sentence), F.length(question)), r"^\s+", "")
    lost = F.raise_error(F.lit("distracting sentence not found in question")).cast("string")
    return F.when(question.isNull() | sentence.isNull(), F.lit(None).cast("string")).when(at > 0, tidy(F.concat(before, F.lit(" "), after))).otherwise(lost)


def ascii_fold(text: Column) -> Column:
    """Typographic dashes, quotes, dots and spaces as plain characters."""
    return F.replace(F.translate(text, "\u2018\u2019\u201c\u201d\u2013\u2014\u2011\u00a0", "''\"\"--- "), F.lit("\u2026"), F.lit("..."))


def normal_option(text: Column) -> Column:
    """An answer option in lower case, letters, digits and spaces only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^a-z0-9 ]", ""))


def primed_option(topic: Column, options: list[tuple[str, Column]]) -> Column:
    """The letter of the option that equals the topic, else of the first that contains it or is contained in it; null if none."""
    listed = F.transform(F.array(*[F.struct(F.lit(k).alias("k"), o.cast("string").alias("o")) for k, o in options]), lambda x: F.struct(x["k"].alias("k"), normal_option(x["o"]).alias("o")))

    def pick(both: Column) -> Column:
        t = both["t"]
        exact = F.filter(both["l"], lambda x: x["o"] == t)
        near = F.filter(both["l"], lambda x: (t != "") & (F.contains(x["o"], t) | F.contains(t, x["o"])))
        return F.coalesce(F.try_element_at(exact, F.lit(1))["k"], F.try_element_at(near, F.lit(1))["k"])

    return let(F.struct(normal_option(topic).alias("t"), listed.alias("l")), pick)


def distractor_code(code: Column) -> tuple[Column, Column]:
    """(level, donor) of a code like ``audio_-10dB_d1``; any other code is an error, null stays null."""
    pattern = r"^audio_(-?\d+)dB_d(\d+)$"
    wrong = F.raise_error(F.concat(F.lit("not a distractor code: "), code)).cast("int")
    level, donor = (F.when(code.isNull(), F.lit(None).cast("int")).when(code.rlike(pattern), F.regexp_extract(code, pattern, i).try_cast("int")).otherwise(wrong) for i in (1, 2))
    return level, donor


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def content_words(text: Column) -> Column:
    """Distinct words of four letters or more that aren't stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_except(F.filter(word_set(text), lambda w: F.length(w) >= 4), stop)


def leakage(segment: Column, clean: Column, mixed: Column) -> dict[str, Column]:
    """Content words of a segment that turn up in the mixed transcript but not in the clean one. No content words: null rates."""
    content = content_words(segment)
    leaked = F.array_sort(F.array_except(F.array_intersect(content, word_set(mixed)), word_set(clean)))
    n = F.size(content)
    return {
        "n_content": n,
        "n_leaked": F.size(leaked),
        "leakage": F.round(F.try_divide(F.size(leaked), n), 6),
        "overlap_clean": F.round(F.try_divide(F.size(F.array_intersect(content, word_set(clean))), n), 6),
        "leaked_words": F.array_join(leaked, " "),
    }


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate of two token arrays: tokens become single characters and edit distance does the rest.

    What the two share at their ends costs nothing and is cut first. Only tokens of both sides can match, so they alone need codes of
    their own; all others of a side have one code. The distance is looked for in narrow bands first, which is exact where it is
    found there. An empty or null reference and a null hypothesis give null. There are codes for a million distinct shared tokens in a
    pair; more are an error.
    """

    def distance(mid: Column) -> Column:
        ref, hyp, shared = mid["r"], mid["h"], mid["s"]
        # A token's code is its place among the shared tokens, looked up in a map that is built once. Surrogates are no characters and are left out.
        char = lambda i: F.decode(F.unhex(F.lpad(F.hex(F.when(i < 0xD800, i).otherwise(i + 0x800)), 8, "0")), "UTF-32")
        codes = F.map_from_arrays(shared, F.transform(F.sequence(F.lit(256), F.size(shared) + 255), char))
        codes = F.when(F.size(shared) > 1_000_000, F.raise_error(F.lit("over a million distinct tokens in a pair")).cast("map<string,string>")).otherwise(codes)
        coded = lambda m, a, other: F.array_join(F.transform(a, lambda x: F.coalesce(F.try_element_at(m, x), F.lit(other))), "")
        texts = let(codes, lambda m: F.struct(coded(m, ref, "r").alias("a"), coded(m, hyp, "h").alias("b")))
        within = lambda t, k: F.nullif(F.levenshtein(t["a"], t["b"], k), F.lit(-1))
        banded = let(texts, lambda t: F.coalesce(*[within(t, k) for k in BANDS], F.levenshtein(t["a"], t["b"])))
        return F.when(F.size(shared) == 0, F.greatest(F.size(ref), F.size(hyp))).otherwise(banded)

    def rate(both: Column) -> Column:
        ref, hyp = both["r"], both["h"]
        n, m = F.size(ref), F.size(hyp)
        tail = lambda h: F.least(common_prefix(both["rr"], both["hh"]), n - h, m - h)
        ends = let(common_prefix(ref, hyp), lambda h: F.struct(h.alias("h"), tail(h).alias("t")))
        cut = let(ends, lambda e: F.struct(F.slice(ref, e["h"] + 1, n - e["h"] - e["t"]).alias("r"), F.slice(hyp, e["h"] + 1, m - e["h"] - e["t"]).alias("h")))
        mid = let(cut, lambda c: F.struct(c["r"].alias("r"), c["h"].alias("h"), F.array_intersect(c["r"], c["h"]).alias("s")))
        return F.when((n > 0) & hyp.isNotNull(), let(mid, distance) / n)

    return let(F.struct(reference.alias("r"), hypothesis.alias("h"), F.reverse(reference).alias("rr"), F.reverse(hypothesis).alias("hh")), rate)


def _by_format(response: Column) -> list[Column]:
    last = lambda p: F.try_element_at(F.regexp_extract_all(response, F.lit(p), F.lit(1)), F.lit(-1))
    return [last(p) if at_end else F.nullif(F.regexp_extract(response, p, 1), F.lit("")) for p, at_end in ANSWER_PATTERNS]


def extract_answer(response: Column) -> Column:
    """The letter that a reply settles on as ``(X)``, or ``[invalid]``.

    The first format that matches decides; then again with byte-level token marks read as white space; then the last explicit final
    answer. Formats that ignore case can give a lower-case letter, which scores as wrong and not as invalid.
    """
    plain = F.replace(F.replace(response, F.lit("\u0120"), F.lit(" ")), F.lit("\u010a"), F.lit("\n"))
    final = F.upper(F.try_element_at(F.regexp_extract_all(plain, F.lit(FINAL_ANSWER), F.lit(1)), F.lit(-1)))
    return F.coalesce(F.concat(F.lit("("), F.coalesce(*_by_format(response), *_by_format(plain), final), F.lit(")")), F.lit("[invalid]"))


def first_failing(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule whose condition holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules])


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)).cast("int")


def align_insertion(clean: Column, distracted: Column) -> Column:
    """For each token of ``distracted`` its 0-based place in ``clean``, -1 for the inserted run."""

    def placed(x: Column) -> Column:
        a, b = x["a"], x["b"]
        head = common_prefix(a, b)
        tail = F.least(common_prefix(x["ra"], x["rb"]), F.size(a) - head)
        place = lambda e: lambda i: F.when(i < e["h"], i).when(i >= F.size(b) - e["t"], i - F.size(b) + F.size(a)).otherwise(-1)
        whole = let(F.struct(head.alias("h"), tail.alias("t")), lambda e: F.transform(F.sequence(F.lit(0), F.size(b) - 1), place(e)))
        return F.when(F.size(b) == 0, F.array().cast("array<int>")).otherwise(whole)

    return let(F.struct(clean.alias("a"), distracted.alias("b"), F.reverse(clean).alias("ra"), F.reverse(distracted).alias("rb")), placed)


#: Words that say nothing about an inserted topic.
TOPIC_STOP = """
the and with for from that this their have has had was were been being about after into
very just over some more than then them they also only when what which while your you
patient mentions mentioned says said small talk aside joke jokes joking friend person someone who
week weeks month months last ago now still back getting doing going one two named called
""".split()


def stems(topic: Column, stop: list[str] = TOPIC_STOP, size: int = 6, most: int = 8) -> Column:
    """Search stems of a topic: the distinct first ``size`` letters of its words of four or more characters that are no stop words
    (what is in parentheses is left out), longest first, then in alphabetical order, at most ``most``."""
    low = F.regexp_replace(F.lower(topic), r"\(.*?\)", " ")
    words = F.regexp_extract_all(low, F.lit(r"[a-z][a-z'\-]{3,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    cut = F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, size)))
    order = F.array_sort(cut, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.slice(order, 1, most)


def labelled(df: DataFrame, code: str, labels: dict[str, str], out: str = "label") -> DataFrame:
    """Add the label of each code from a small map; a code that it lacks is an error, null stays null."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    lost = F.raise_error(F.concat(F.lit("a code without a label: "), F.col(code))).cast("string")
    return df.withColumn(out, F.when(F.col(code).isNotNull(), F.coalesce(F.try_element_at(known, F.col(code)), lost)))
