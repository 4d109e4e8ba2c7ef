"""Verification of files against a manifest."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, real, size, sha256) of all files under ``root``: path below it, and the path below it that links lead to (null if they lead out of it).

    Spark lists and reads the files, each as one row of one task; contents are hashed where they are read and go no further. Links exist in local and
    mounted file systems; where Spark's paths are of another kind, real is the path.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    plain = lambda uri: unquote(urlparse(uri).path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local, base = urlparse(top).scheme in ("", "file"), plain(top)
        for frame in frames:
            below = [os.path.relpath(plain(p), base) for p in frame["path"]]
            real = below
            if local:
                real = [os.path.relpath(os.path.realpath(plain(p)), os.path.realpath(base)) for p in frame["path"]]
            yield frame.assign(path=below, real=[None if r == ".." or r.startswith("../") else r for r in real])[["path", "real", "size", "sha256"]]

    return rows.mapInPandas(run, "path string, real string, size long, sha256 string")


_CLIMBS = r"(^|/)\.\.(/|$)"


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of files (path, real, sha256) and a manifest (path, sha256).

    ok, mismatch, missing (listed, not there), extra (there, not listed), or unsafe: a listed path that is absolute, names the root itself or climbs, or a listed file
    whose link leads out of the root.
    """
    tidy = F.regexp_replace(F.regexp_replace("path", r"/(\./)+", "/"), r"^\./|/$", "")
    listed = manifest.select("path", tidy.alias("__p"), "sha256")
    found = files.select(F.col("path").alias("__p"), "real", F.col("sha256").alias("__got"))
    both = listed.join(found, "__p", "full_outer")
    unsafe = F.col("path").startswith("/") | F.col("path").rlike(_CLIMBS) | F.col("__p").isin("", ".") | (F.col("__got").isNotNull() & F.col("real").isNull())
    status = F.when(F.col("path").isNull(), "extra").when(unsafe, "unsafe").when(F.col("__got").isNull(), "missing").when(F.col("__got") == F.lower("sha256"), "ok").otherwise("mismatch")
    return both.select(F.coalesce("path", "__p").alias("path"), status.alias("status"))
