"""Incremental ingest: rows set aside, windowed counts and keyed inserts.

Every query reads landed files, runs until they are used up, and keeps its progress beside its output, so a run that
is given the same output folder goes on where the last one stopped. Output is one folder per batch, which a repeated batch
replaces. All files that have landed since the last run make one batch unless `per_batch` says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gazette.operators import spread

COUNTS = "landed BIGINT, kept BIGINT, implausible BIGINT, late BIGINT, mark TIMESTAMP, batch BIGINT"


def landed(spark: SparkSession, path: str, schema, per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Files of a landing folder as they arrive."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)).load(path)


def _each(stream: DataFrame, out: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> str:
    """Hands everything that has landed since the last run to `write`, batch by batch; returns the folder."""
    done = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out.rstrip('/')}-progress")
            .trigger(availableNow=True).start())
    done.awaitTermination()
    return out


def run(stream: DataFrame, out: str, mode: str = "append") -> str:
    """Run a stream over everything that has landed since the last run into this folder; returns the folder."""
    return _each(stream, out, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), mode)


def _fate(time: Column, earliest: str, latest: str, closed) -> Column:
    """Whether a row is kept, has no plausible time (none at all included) or comes too late."""
    fits = F.coalesce(time.between(F.lit(earliest), F.lit(latest)), F.lit(False))
    return F.when(~fits, "implausible").when(time < F.lit(closed).cast("timestamp"), "late").otherwise("kept")


def triage(stream: DataFrame, out: str, time: str, earliest: str, latest: str, late: str) -> str:
    """Parts rows that later steps can count from those they would have to drop, and loses neither.

    Kept rows have a time in range that is at most `late` before the greatest time kept in earlier batches, which is when
    a watermark of the same length closes; one far-future date would close all windows before it. Each batch writes its rows in
    one pass, a folder for each fate, and a row of counts, observed while writing, with the greatest time so far. A repeated
    batch reads the count row before its own, so it decides alike.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(COUNTS).parquet(f"{out}/counts/batch={number - 1}") if number else None
        mark, closed = before.select("mark", F.expr(f"mark - INTERVAL {late}").cast("string")).first() if before else (None, None)
        fate, seen = F.col("fate"), Observation()
        counts = [F.count(F.lit(1)).alias("landed"), *[F.count_if(fate == f).alias(f) for f in ("kept", "implausible", "late")],
                  F.max(F.when(fate == "kept", F.col(time))).alias("mark")]
        (batch.withColumn("fate", _fate(F.col(time), earliest, latest, closed)).observe(seen, *counts)
         .write.mode("overwrite").partitionBy("fate").parquet(f"{out}/rows/batch={number}"))
        found = dict(seen.get)
        found["mark"] = max((m for m in (mark, found["mark"]) if m is not None), default=None)
        row = spark.createDataFrame([tuple(found[f] for f in ("landed", "kept", "implausible", "late", "mark"))], COUNTS.rsplit(",", 1)[0])
        row.coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    return _each(stream, out, write)


def kept(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows that `triage` keeps, as a stream."""
    return landed(spark, f"{out}/rows/batch=*/fate=kept", schema)


def fates(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All rows that `triage` has met, with their fate and batch."""
    return spark.read.schema(f"{schema}, fate STRING, batch BIGINT").parquet(f"{out}/rows")


def counts(spark: SparkSession, out: str) -> DataFrame:
    """Rows landed, kept and set aside in each batch of `triage`, with the greatest time kept so far."""
    return spark.read.schema(COUNTS).parquet(f"{out}/counts")


def dedupe(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """First row per key; repeats are remembered for as long as late data may arrive."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, keys: list[str], late: str, length: str, slide: str | None = None) -> DataFrame:
    """Rows per key and window; windows that started and ended long enough ago leave the state."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return (stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), *keys, "n"))


def result(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches of an output folder."""
    return spark.read.schema(schema).parquet(path).drop("batch")


def latest(spark: SparkSession, path: str, schema, keys: list[str], values: list[str]) -> DataFrame:
    """Last value of each key of an output whose batches carry updates."""
    rows = spark.read.schema(f"{schema}, batch BIGINT").parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def insert_new(stream: DataFrame, out: str, key: str, order: str, present: DataFrame | None = None) -> str:
    """Inserts the first row of each key, once: the least by `order` of the batch in which the key first arrives.

    The table in `out` is all the memory there is, so no state grows with the keys and a new run needs none; `present`
    has a key column of rows that are there from the start. A batch asks the table for its own keys only: the key column is read, and not
    shuffled where the keys of a batch are small enough to be sent to it. Rows without a key make one key.
    """
    known = f"{stream.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, batch BIGINT"

    def write(batch: DataFrame, number: int) -> None:
        first = spread.first_per_key(batch, [key], [F.col(order)])
        tables = [] if present is None else [present.select(key)]
        if number:
            tables.append(batch.sparkSession.read.schema(known).parquet(out).filter(F.col("batch") < number).select(key))
        for earlier in tables:
            mine = first.select(F.col(key).alias("_key"))
            met = earlier.join(mine, earlier[key].eqNullSafe(mine["_key"]), "left_semi").select(F.col(key).alias("_key"))
            first = first.join(met, first[key].eqNullSafe(met["_key"]), "left_anti")
        first.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _each(stream, out, write)
