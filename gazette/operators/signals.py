"""Signals cited for an evaluation: blended rank, exposure, liability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions.common import lookup, steps
from gazette.operators import spread


def blended(signal: Column, vector: Column, signal_weight: float = vocab.SIGNAL_WEIGHT,
            vector_weight: float = vocab.VECTOR_WEIGHT) -> Column:
    """Weighted mean of the two scores."""
    total = (signal_weight + vector_weight) or 1.0
    return (signal * signal_weight + vector * vector_weight) / F.lit(total)


def _top(signals: DataFrame, key: str, k: int) -> DataFrame:
    order = [F.col("relevance").desc(), F.col("seq")]
    return spread.top_per_group(signals, [key], order, k, "rank")


def cited(signals: DataFrame, key: str) -> DataFrame:
    """The best signal of each evaluation, and the second if it reaches the floor."""
    return _top(signals, key, 2).filter((F.col("rank") == 1) | (F.col("relevance") >= vocab.SECOND_SIGNAL_FLOOR))


def exposure(signals: DataFrame, key: str) -> DataFrame:
    """Score from 0 to 100 out of the three most relevant signals, with its label."""
    weight = F.element_at(F.array(*[F.lit(w) for w in vocab.EXPOSURE_WEIGHTS]), F.col("rank"))
    raw = F.round(F.sum(weight * F.col("relevance")), 6)
    score = F.greatest(F.least(F.bround(raw * 100, 0).cast("int"), F.lit(100)), F.lit(0))
    per = _top(signals, key, len(vocab.EXPOSURE_WEIGHTS)).groupBy(key).agg(score.alias("score"))
    return per.withColumn("label", steps(F.col("score"), vocab.EXPOSURE_LABELS, "Low"))


def liability_range(signals: DataFrame, key: str) -> DataFrame:
    """Lowest and highest amount of the cited signals; the agency's usual range when none names one.

    Evaluations whose best signal is below the floor have no range.
    """
    picked = cited(signals, key)
    per = picked.groupBy(key).agg(
        F.max("relevance").alias("best"), F.min_by("agency", "rank").alias("agency"), F.count_if("concrete").alias("sources"),
        F.min(F.when(F.col("concrete"), F.col("low"))).alias("_low"), F.max(F.when(F.col("concrete"), F.col("high"))).alias("_high"))
    usual = lambda i: lookup(F.col("agency"), {a: r[i] for a, r in vocab.PENALTY_RANGES.items()}, vocab.DEFAULT_PENALTY_RANGE[i])
    concrete = F.col("sources") > 0
    return per.filter(F.col("best") >= vocab.LIABILITY_FLOOR).select(
        key, F.when(concrete, F.col("_low")).otherwise(usual(0)).cast("bigint").alias("low"),
        F.when(concrete, F.col("_high")).otherwise(usual(1)).cast("bigint").alias("high"),
        F.when(concrete, "cited").otherwise("usual").alias("basis"))


def sector_ceiling(signals: DataFrame, key: str) -> DataFrame:
    """The signal with the largest concrete amount of each evaluation; the first in order among equals."""
    row = F.struct("record_id", "low", "high")
    return signals.filter("concrete").groupBy(key).agg(
        F.max_by(row, F.struct("high", -F.col("seq"))).alias("_top")).select(key, "_top.*")


def layer_groups(signals: DataFrame, layers: Column, layer_ids: list[int]) -> DataFrame:
    """Signals per layer; layers without signals stay with zero. Counts come before the layer list."""
    per = signals.select(F.explode(layers).alias("layer"), "pub_date").groupBy("layer").agg(
        F.count("*").alias("signals"), F.max("pub_date").alias("newest"))
    listed = signals.sparkSession.createDataFrame([(i,) for i in layer_ids], "layer INT")
    return listed.join(per, "layer", "left").select("layer", F.coalesce("signals", F.lit(0)).alias("signals"),
                                                    F.coalesce("newest", F.lit("")).alias("newest"))
