"""Replies that arrive as files: parse, route errors, keep the first success of each request, fold into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.operators.judgments import parse_strict

REPLY = "request_id string, received_at timestamp, judge_raw string"


def reply_stream(spark: SparkSession, folder: str, schema: str = REPLY, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def first_success(replies: DataFrame, delay: str = "1 day") -> DataFrame:
    """Parsed replies without errors, one for each request that isn't older than the watermark."""
    good = parse_strict(replies).filter("not parse_error")
    return good.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["request_id"])


def error_rates(replies: DataFrame, width: str = "1 hour", delay: str = "1 day", time: str = "received_at") -> DataFrame:
    """Parse errors and repairs by tumbling window; works on streams and tables."""
    parsed = parse_strict(replies)
    timed = parsed.withWatermark(time, delay) if replies.isStreaming else parsed
    return timed.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.count_if("parse_error").alias("n_error"), F.count_if("repaired").alias("n_repaired")).select(F.col("w.start").alias("start"), "n", "n_error", "n_repaired")


def run_ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str = REPLY) -> None:
    """Take in what is new in ``folder`` and stop: good replies are appended to ``target``, errors to ``<target>_errors``.

    A batch writes under its number, replaces only itself and looks only at the batches before it, so a batch that is run again after a
    failure gives the same rows. Which requests are done is read from ``<target>_keys``, of ids alone.
    """

    def put(batch: DataFrame, number: int) -> None:
        parsed = parse_strict(batch).persist()
        good = parsed.filter("not parse_error")
        good = good.groupBy("request_id").agg(F.min_by(F.struct("received_at", "contamination", "severity", "repaired"), F.struct("received_at", "judge_raw")).alias("r")).select("request_id", "r.*")
        if number and _has(spark, f"{target}_keys"):
            done = spark.read.schema("request_id string, batch long").parquet(f"{target}_keys").filter(F.col("batch") < number)
            good = good.join(done, "request_id", "left_anti")
        good = good.persist()
        good.write.mode("overwrite").parquet(f"{target}/batch={number}")
        good.select("request_id").write.mode("overwrite").parquet(f"{target}_keys/batch={number}")
        parsed.filter("parse_error").write.mode("overwrite").parquet(f"{target}_errors/batch={number}")
        good.unpersist()
        parsed.unpersist()

    stream = reply_stream(spark, folder, schema)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _newest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """(bucket, batch): the last batch that wrote each bucket, of those before ``before``; a row for each bucket."""
    if not _has(spark, f"{target}/_log"):
        return None
    log = spark.read.schema("bucket int, batch long").parquet(f"{target}/_log")
    return (log if before is None else log.filter(F.col("batch") < before)).groupBy("bucket").agg(F.max("batch").alias("batch"))


def _rows_of(spark: SparkSession, target: str, newest: DataFrame) -> DataFrame:
    """The rows of the given buckets, each as its batch left it: the folders are named, so no other is looked at."""
    found = [f"{target}/batch={r.batch}/bucket={r.bucket}" for r in newest.collect()]  # a path for each bucket at most
    return spark.read.schema(UPSERTED).parquet(*found) if found else spark.createDataFrame([], UPSERTED)


UPSERTED = "request_id string, received_at timestamp, contamination int, severity int, repaired boolean"


def run_upsert(spark: SparkSession, folder: str, target: str, checkpoint: str, buckets: int = 64, schema: str = REPLY) -> None:
    """Take in what is new in ``folder`` and stop: the newest good reply of each request is its row in ``target``; errors go to ``<target>_errors``.

    Rows lie in buckets of their request. A batch reads and writes only the buckets of its own requests, as a new version under its number, and then
    notes them in a log; what batches before it left is the base of the fold. So a batch that runs again gives the same files, readers see a bucket's
    new version once it is noted, and no batch looks at all requests (``buckets`` should grow with the table). Of replies at one time the greater scores win.
    """

    def put(batch: DataFrame, number: int) -> None:
        parsed = parse_strict(batch).persist()
        good = parsed.filter("not parse_error").select("request_id", "received_at", "contamination", "severity", "repaired")
        touched = good.select(bucket_of("request_id", buckets).alias("bucket")).distinct().persist()
        known = _newest(spark, target, number)
        old = spark.createDataFrame([], UPSERTED) if known is None else _rows_of(spark, target, known.join(F.broadcast(touched), "bucket"))
        newest = F.max_by(F.struct("received_at", "contamination", "severity", "repaired"), F.struct("received_at", "contamination", "severity", "repaired"))
        folded = old.unionByName(good).groupBy("request_id").agg(newest.alias("r")).select("request_id", "r.*")
        folded.withColumn("bucket", bucket_of("request_id", buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")
        parsed.filter("parse_error").select("request_id", "received_at", "judge_raw").write.mode("overwrite").parquet(f"{target}_errors/batch={number}")
        touched.write.mode("overwrite").parquet(f"{target}/_log/batch={number}")
        touched.unpersist()
        parsed.unpersist()

    stream = reply_stream(spark, folder, schema)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_upserted(spark: SparkSession, target: str) -> DataFrame:
    """The rows of ``run_upsert``."""
    newest = _newest(spark, target)
    return spark.createDataFrame([], UPSERTED) if newest is None else _rows_of(spark, target, newest)


def _has(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
