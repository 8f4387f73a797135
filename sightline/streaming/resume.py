"""Resumable processing: an append-only result log that work is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ErrorBudgetExceeded(RuntimeError):
    pass


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) else None


def run_once(spark: SparkSession, source: str, schema: StructType, log: str, state: str, key: str, process: Callable[[DataFrame], DataFrame], max_errors: int | None = None, max_files: int = 1000) -> None:
    """Process all new work below ``source`` and append the results to ``log``.

    Files already taken are known from the checkpoint in ``state``; an anti-join with the log covers a batch that was written
    but not committed, and work delivered twice. Results with a non-null ``error`` count against ``max_errors``; beyond it the run stops, keeping
    what is done.
    """
    before = _log(spark, log) if max_errors is not None else None
    # the log is counted once; batches add what they write
    errors = 0 if before is None or "error" not in before.columns else before.filter(F.col("error").isNotNull()).count()

    def batch(df: DataFrame, _: int) -> None:
        nonlocal errors
        done = _log(spark, log)
        fresh = df.dropDuplicates([key])
        if done is not None:
            fresh = fresh.join(done.select(key), key, "left_anti")
        out = process(fresh)
        if max_errors is None or "error" not in out.columns:
            out.write.mode("append").parquet(log)
        else:
            seen = Observation()
            out.observe(seen, F.count_if(F.col("error").isNotNull()).alias("errors")).write.mode("append").parquet(log)
            errors += seen.get.get("errors", 0)
            if errors > max_errors:
                raise ErrorBudgetExceeded(f"{errors} errors, {max_errors} allowed")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def duplicates(log: DataFrame, key: str) -> DataFrame:
    """Keys that the log holds more than once; a sound log has none."""
    return log.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def progress(spark: SparkSession, log: str, work: DataFrame, key: str) -> dict[str, int]:
    """Done and pending work, for a progress report."""
    total, done = work.select(key).distinct().count(), _log(spark, log)
    finished = 0 if done is None else done.select(key).distinct().count()
    return {"work": total, "done": finished, "pending": total - finished}
