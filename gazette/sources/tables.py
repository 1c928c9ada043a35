"""Seeds, snapshots, listings, price series and the tables that are kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.common import lookup, text
from gazette.operators import spread
from gazette.session import discard, folders, make_folder

# Listing status of each platform status; anything else is active.
LISTING_STATUS = {"open": "active", "active": "active", "settled": "resolved", "closed": "resolved"}


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup table kept as CSV with a header; rows without a key are left out."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return rows.filter(F.coalesce(F.trim(rows.columns[0]), F.lit("")) != "")


def read_seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Curated seeds kept as JSON, an object per line or an array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def aliases(entities: DataFrame) -> DataFrame:
    """Every name an entity goes by: its canonical name and its aliases."""
    names = F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return entities.select("canonical_name", F.explode(names).alias("name")).filter("name <> ''")


def newest_folder(spark: SparkSession, folder: str, name: str = "snapshot") -> str | None:
    """The greatest value among the `name=value` subfolders, from the listing of the folder alone."""
    names = [f.rsplit("/", 1)[1] for f in folders(spark, folder)]
    return max((n.split("=", 1)[1] for n in names if n.startswith(f"{name}=")), default=None)


def read_latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest snapshot of a folder with one `snapshot=...` subfolder each; no file of an older one is opened."""
    newest = newest_folder(spark, folder)
    reader = spark.read.schema(f"{schema}, snapshot STRING").option("basePath", folder)
    return reader.json(f"{folder}/snapshot={newest}") if newest is not None else spark.createDataFrame([], f"{schema}, snapshot STRING")


def latest_snapshot(df: DataFrame) -> DataFrame:
    """Rows of the greatest snapshot."""
    return df.filter(F.col("snapshot") == df.agg(F.max("snapshot")).scalar())


def listings_east(raw: DataFrame) -> DataFrame:
    """Listings of the platform with a status word and a settlement source."""
    return raw.select(
        text(F.col("ticker")).alias("external_id"), text(F.col("title")).alias("title"),
        text(F.col("subtitle")).alias("subtitle"), F.coalesce("rules_primary", "subtitle", F.lit("")).alias("criteria"),
        text(F.col("open_time")).alias("listed_at"), text(F.col("close_time")).alias("expires_at"),
        lookup(F.col("status"), LISTING_STATUS, "active").alias("status"),
        F.array_compact(F.array(F.when(text(F.col("settlement_source")) != "", F.col("settlement_source")))).alias("entities"),
        F.lit("east").alias("platform"))


def listings_west(raw: DataFrame) -> DataFrame:
    """Listings of the platform with a closed flag."""
    return raw.select(
        F.col("id").cast("string").alias("external_id"), text(F.col("question")).alias("title"),
        F.lit("").alias("subtitle"), text(F.col("description")).alias("criteria"),
        text(F.col("start_date")).alias("listed_at"), text(F.col("end_date")).alias("expires_at"),
        F.when(F.coalesce("closed", F.lit(False)), "resolved").otherwise("active").alias("status"),
        F.array().cast("array<string>").alias("entities"), F.lit("west").alias("platform"))


def candle_price(close: Column, close_dollars: Column) -> Column:
    """Closing price; a close of zero counts as missing and the dollar form steps in."""
    return F.when(close != 0, close).otherwise(close_dollars)


def latest_price(contracts: DataFrame, prices: DataFrame) -> DataFrame:
    """Cents for yes and no from each contract's last price; 50 without one."""
    last = prices.groupBy("contract_id").agg(F.max_by("p", F.struct("ts", "p")).alias("p"))
    yes = F.coalesce(F.bround(F.col("p") * 100, 0).cast("int"), F.lit(50))
    return contracts.select("contract_id").join(last, "contract_id", "left").select(
        "contract_id", yes.alias("yes_cents"), (100 - yes).alias("no_cents"))


def insert_if_absent(kept: DataFrame, arrived: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The kept rows plus the first arrival of each key that is not kept yet."""
    fresh = spread.first_per_key(arrived.join(kept.select(key), key, "left_anti"), [key], order)
    return kept.unionByName(fresh.select(*kept.columns))


def refresh(cached: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cached rows with fresh values where a lookup gave one; a miss keeps the row and marks it stale."""
    new = fresh.select(key, F.struct(*columns).alias("_new"))
    joined = cached.join(new, key, "left")
    return joined.select(key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns],
                         F.col("_new").isNull().alias("stale"))


def manifest(log: DataFrame) -> DataFrame:
    """Topics attempted, succeeded and failed, and artifacts loaded, from a load log (topic_id, ok, artifacts)."""
    return log.agg(F.count("*").alias("attempted"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
                   F.coalesce(F.sum(F.when(F.col("ok"), F.col("artifacts"))), F.lit(0)).alias("artifacts"))


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version BIGINT, name STRING").parquet(f"{path}/manifest")


def write_documents(df: DataFrame, path: str, key: str, rows_per_file: int = 1_000_000, keep: int = 2) -> str:
    """One folder of JSON per key as a new version of the documents; returns the version's folder.

    The manifest names the new version only when all of it is written, so readers see the last whole version while a
    write runs or after it failed, and keys that are gone leave no output. The newest `keep` versions stay, for readers that have
    just begun; older ones and what failed writes left are removed. One writer at a time. Rows are rebalanced by key, so adaptive
    execution cuts a heavy key, or many copies of one row, into as many tasks as its size asks for and joins small ones.
    Rows without a key have a folder of their own.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    make_folder(spark, f"{path}/manifest")
    df.hint("rebalance", key).write.option("maxRecordsPerFile", rows_per_file).partitionBy(key).json(f"{path}/versions/{name}")
    version = (_manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(version, name)], "version BIGINT, name STRING").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    named = {r.name for r in _manifest(spark, path).filter(F.col("version") > version - keep).collect()}
    for folder in folders(spark, f"{path}/versions"):
        if folder.rsplit("/", 1)[1] not in named:
            discard(spark, folder)
    return f"{path}/versions/{name}"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of the newest whole version; a path that has none yet has no documents."""
    make_folder(spark, f"{path}/manifest")
    newest = _manifest(spark, path).agg(F.max_by("name", "version")).first()[0]
    return spark.createDataFrame([], schema) if newest is None else spark.read.schema(schema).json(f"{path}/versions/{newest}")
