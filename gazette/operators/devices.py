"""Device event reports from several national sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import dates, keywords


def normalise(raw: DataFrame, country: str, source: str) -> DataFrame:
    """One source in the common shape; columns: native_id, day_text, raw_severity, recall, device."""
    return raw.select(
        F.concat(F.lit(f"{country}-"), F.col("native_id").cast("string")).alias("id"),
        dates.lenient_day(F.col("day_text")).alias("day"), F.lit(source).alias("source"), F.lit(country).alias("country"),
        keywords.severity_class(F.col("raw_severity")).alias("severity"), F.coalesce("recall", F.lit(False)).alias("is_recall"),
        F.trim("device").alias("device"))


def union(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def summary(events: DataFrame) -> DataFrame:
    """Counts by source and severity, with the totals of each as subtotal rows named "all"."""
    day = F.when(F.col("day") != "", F.col("day"))
    counted = events.cube("source", "severity").agg(
        F.count("*").alias("n"), F.count_if("is_recall").alias("recalls"),
        F.count_if(F.col("severity") == "death").alias("deaths"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return counted.fillna("all", ["source", "severity"])


def flag_stats(articles: DataFrame, flags: list[str]) -> DataFrame:
    """How many articles carry each of the reported flags."""
    single = articles.select(F.explode("flags").alias("flag")).filter(F.col("flag").isin(flags))
    return single.groupBy("flag").agg(F.count("*").alias("n"))
