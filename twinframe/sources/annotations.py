"""Annotation files: tiers of timed, quoted intervals.

A file is text in the long form of interval tiers: ``name = ".."`` opens a tier, and each interval is ``intervals [k]:``, ``xmin = ..``, ``xmax = ..``
and ``text = ".."``, where a quote inside a text is doubled. Texts may hold line breaks, and anything that looks like an interval.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The transcribers' tags.
TAGS = r"</?UNSURE>|<UNIN/>|<INAUDIBLE_SPEECH/>"
_TAGS, _SPACE = re.compile(TAGS), re.compile(r"\s+")
_INTERVAL = re.compile(r"intervals \[\d+\]:\s*xmin = (\S+)\s*xmax = (\S+)\s*text = \Z")


def clean_text(text: str) -> str:
    """Without tags, and with runs of white space as one space."""
    return _SPACE.sub(" ", _TAGS.sub("", text)).strip()


def scan_intervals(content: str) -> Iterator[tuple[str | None, float, float, str]]:
    """(tier, start, end, text without tags) of each interval whose text isn't blank, in one pass from quote to quote; a quote that isn't closed ends it."""
    at, tier = 0, None
    while (start := content.find('"', at)) >= 0:
        end = content.find('"', start + 1)
        while end >= 0 and content.startswith('"', end + 1):
            end = content.find('"', end + 2)
        if end < 0:
            return
        lead = content[max(at, start - 300) : start]  # what opens a string is short, whatever lies before it
        if found := _INTERVAL.search(lead):
            if text := clean_text(content[start + 1 : end].replace('""', '"')):
                yield tier, float(found[1]), float(found[2]), text
        elif lead.endswith("name = "):
            tier = content[start + 1 : end].replace('""', '"')
        at = end + 1


def read_intervals(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, tier, start_s, end_s, text) of the annotation files under a folder; a file is read as a whole, by one task. Files without intervals give none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, *found) for found in scan_intervals(content.as_py())]
                for lo in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[lo : lo + 2000]], schema=schema)

    names = ["path", "tier", "start_s", "end_s", "text"]
    schema = pa.schema([(n, pa.float64() if n.endswith("_s") else pa.string()) for n in names])
    return files.mapInArrow(run, "path string, tier string, start_s double, end_s double, text string")


def write_intervals(rows: DataFrame, path: str, file: list[str], tier: str, tiers: int = 64) -> None:
    """Write (tier, start_s, end_s, text) as annotation files of at most ``tiers`` groups each; ``file``: the columns that make a group. All intervals of a group meet in one row."""
    quoted = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""'))
    numbered = F.transform(
        F.array_sort(F.collect_list(F.struct("start_s", "end_s", "text"))),
        lambda x, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n            xmin = "), x["start_s"].cast("string"), F.lit("\n            xmax = "), x["end_s"].cast("string"), F.lit('\n            text = "'), quoted(x["text"]), F.lit('"')),
    )
    grids = rows.groupBy(*file, tier).agg(F.array_join(numbered, "\n").alias("body"), F.count("*").alias("n"))
    head = F.concat(F.lit('    item []:\n        class = "IntervalTier"\n        name = "'), quoted(F.col(tier).cast("string")), F.lit('"\n        intervals: size = '), F.col("n").cast("string"), F.lit("\n"))
    grids.select(F.concat(head, "body").alias("value")).write.option("maxRecordsPerFile", tiers).option("compression", "none").text(path)
