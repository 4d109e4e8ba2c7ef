"""Reading and writing the entities: folders with keys in their paths, optional sources, result tables, manifests."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``); only a local session may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, source: Column | None = None) -> DataFrame:
    """CSV with quoted line breaks, only the rows of a source if one is asked for."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows if source is None else rows.filter(source)


def read_tree(spark: SparkSession, root: str, pattern: str, keys: list[str], schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """All files under ``root`` named ``pattern``, with the last folders of each path as ``keys``."""
    rows = spark.read.format(fmt).schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select("*", *[F.element_at(parts, -(len(keys) + 1) + i).alias(k) for i, k in enumerate(keys)])


def read_splits(spark: SparkSession, paths: list[str], splits: dict[str, str], schema: T.StructType | str, name: Column | None = None) -> DataFrame:
    """CSV files with quoted line breaks, and each file's split by its name (or by ``name``, made from ``_metadata``); null for a file that ``splits`` lacks."""
    names = F.map_from_arrays(F.array(*map(F.lit, splits)), F.array(*map(F.lit, splits.values())))
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    return rows.select("*", F.try_element_at(names, F.col("_metadata.file_name") if name is None else name).alias("split"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(pos, item fields) of files that hold one JSON array each; ``pos`` is the place in the array, from 0. A file is read as a whole."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{item}>>")).alias("pos", "item"))
    return rows.select("pos", "item.*")


def read_or_empty(spark: SparkSession, schema: T.StructType | str, *paths: tuple[str, str]) -> DataFrame:
    """The first (format, path) that exists, else an empty table. Paths are looked up where Spark reads them."""
    for fmt, path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.format(fmt).schema(schema).load(path)
    return spark.createDataFrame([], schema)


def significant(x: Column, digits: int = 6) -> Column:
    """Rounded to significant digits; 0 and null stay."""
    size = F.floor(F.log10(F.abs(x))) + 1
    factor = F.pow(F.lit(10.0), digits - size)
    return F.when((x == 0) | x.isNull(), x).otherwise(F.round(x * factor, 0) / factor)


def write_results(df: DataFrame, path: str, digits: int = 6) -> None:
    """A result table as CSV with fractional numbers to significant digits; refuses to overwrite."""
    kinds = (T.DoubleType, T.FloatType)
    df.select(*[significant(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema]).write.mode("errorifexists").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] = (), params: dict | None = None, inputs: list[str] = (), jsonl: bool = False) -> str:
    """Parquet in a new version folder under ``path`` (``jsonl``: with JSON lines beside it) and a row in its manifest; returns the version's path.

    Old versions stay, so each is the backup of the one before.
    """
    run = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{time.time_ns() % 10**9:09d}-{uuid.uuid4().hex[:8]}"
    target = f"{path}/version={run}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(target)
    spark = df.sparkSession
    written = spark.read.parquet(target)
    if jsonl:
        written.write.json(f"{path}/_jsonl/version={run}")
    row = [(run, target, json.dumps(params or {}, sort_keys=True), list(inputs), written.count())]
    spark.createDataFrame(row, MANIFEST).write.mode("append").json(f"{path}/_manifest")
    return target


MANIFEST = "run_id string, path string, params string, inputs array<string>, n_rows long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What is known of each version: run_id, path, params (a map), inputs, n_rows."""
    rows = spark.read.schema(MANIFEST).json(f"{path}/_manifest")
    return rows.withColumn("params", F.from_json("params", "map<string,string>"))


def fold_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], scores: list[str] = (), params: dict | None = None) -> DataFrame:
    """Fold rows into the newest version of a table by their keys and write the next version; returns the counts of replaced and added rows.

    ``scores`` are stored as bytes. The version before stays as the backup, and readers see the new one once its manifest row is there.
    """
    from twinframe.operators.pairing import fold, fold_counts

    base = latest(spark, path)
    counts = fold_counts(base, new, keys)
    merged = fold(base, new.select(base.columns), keys)
    write_table(merged.withColumns({c: F.col(c).cast("tinyint") for c in scores}), path, params=params, inputs=[spark_path(spark, path)])
    return counts


def spark_path(spark: SparkSession, path: str) -> str:
    """The path of the newest version."""
    return manifest(spark, path).agg(F.max_by("path", "run_id")).first()[0]


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table, by its manifest."""
    manifest = spark.read.schema("run_id string, path string").json(f"{path}/_manifest")
    return spark.read.parquet(manifest.agg(F.max_by("path", "run_id")).first()[0])
