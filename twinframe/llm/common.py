"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What glibc has to give free memory back; None elsewhere.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: A key with more than 1 / HOT_KEYS of all rows, and more than this, is hot: its facts are broadcast.
HOT_ROWS, HOT_KEYS = 256, 1000
#: Rows of a batch that a function works on at once: bounds what a Python worker holds.
SLICE = 500
#: Ids (longs) that are broadcast at most; more are shuffled.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_by_count(rows: DataFrame, facts: DataFrame, key: str, count: str = "n", how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``facts`` on ``key`` so that no task gets all rows of a hot key.

    ``facts`` has one row a key, with the number of its ``rows`` in ``count``; it should be cheap to read, as a staged table is. Keys
    with more rows than ``hot_rows`` and than 1 / HOT_KEYS of all, so at most HOT_KEYS keys, are broadcast and their rows stay
    where they are; all others are shuffled by key. ``how`` (inner or left) holds for keys that ``facts`` lacks.
    """
    total, most = facts.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    limit = max(hot_rows, total // HOT_KEYS)
    if most <= limit:
        return rows.join(facts, key, how)
    hot = F.broadcast(facts.filter(F.col(count) > limit))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.filter(F.col(count) <= limit), key, how)
    return rows.join(hot, key).select(rest.columns).unionByName(rest)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as they are; after each, free memory goes back to the system, so that an idle Python worker holds little."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows."""
    for batch in trimmed(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch


def append_columns(df: DataFrame, inputs: list[str], fields: T.StructType, func: Callable[..., list]) -> DataFrame:
    """Add columns computed in slices of SLICE rows from the Arrow arrays of ``inputs``.

    ``func`` gets one Arrow array for each input and returns one sequence or array for each field. All other columns pass
    through untouched; an input column that has the name of a computed one is replaced by it.
    """
    clash = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in clash]
    extra = [c for c in inputs if c not in keep]
    staged = df.select(*[df[c] for c in keep], *[df[c].alias(f"__in_{c}") for c in extra])
    at = [staged.columns.index(c if c in keep else f"__in_{c}") for c in inputs]
    schema = T.StructType([staged.schema[c] for c in keep] + list(fields))
    n_keep = len(keep)
    types = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = func(*[part.column(i) for i in at])
            made = [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, type=t) for x, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(part.columns[:n_keep] + made, names=schema.names)

    return staged.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow string column."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()
