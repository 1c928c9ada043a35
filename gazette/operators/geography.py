"""Counts and pressure per jurisdiction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import dates, places, scores


def _coded(records: DataFrame, world_only: bool = False) -> DataFrame:
    return records.select(places.country_code(world_only).alias("code"), dates.pub_day().alias("day"),
                          scores.score("urgency").alias("urgency")).filter("code IS NOT NULL AND day IS NOT NULL")


def jurisdiction_totals(records: DataFrame, as_of: str, window: int = 90, world_only: bool = False) -> DataFrame:
    """Count, sum, average and largest urgency per code inside the window, with pressure."""
    coded = _coded(records, world_only).filter(dates.within_age(as_of, window, F.col("day")))
    totals = coded.groupBy("code").agg(
        F.count("*").alias("n"), F.sum("urgency").alias("sum_urgency"), F.max("urgency").alias("max_urgency"))
    average = F.round(F.col("sum_urgency") / F.col("n"), 2)
    return totals.withColumn("avg_urgency", average).withColumn(
        "pressure", scores.pressure(F.col("n"), F.col("avg_urgency")))


def pressure_delta(records: DataFrame, as_of: str, current: int = 90, prior: int = 90,
                   world_only: bool = True) -> DataFrame:
    """Pressure of the current and the prior window and their difference, for codes active in either.

    Both windows include both ends, so a record aged exactly `current` days counts in both. One pass and one
    shuffle: the windows are conditions of the same aggregate.
    """
    coded = _coded(records, world_only)
    age = dates.age_days(as_of, F.col("day"))
    coded = coded.filter(age.between(0, current + prior))
    now, before = age.between(0, current), age.between(current, current + prior)
    pick = lambda fold, cond: fold(F.when(cond, F.col("urgency")))
    totals = coded.groupBy("code").agg(
        F.count_if(now).alias("current_count"), F.count_if(before).alias("prior_count"),
        pick(F.sum, now).alias("_now"), pick(F.sum, before).alias("_before"),
        F.coalesce(pick(F.max, now), F.lit(0.0)).alias("current_max_urgency"))
    average = lambda s, n: F.when(F.col(n) > 0, F.round(F.col(s) / F.col(n), 2)).otherwise(0.0)
    return (
        totals
        .withColumn("current_avg_urgency", average("_now", "current_count"))
        .withColumn("current_pressure", scores.pressure(F.col("current_count"), F.col("current_avg_urgency")))
        .withColumn("prior_pressure", scores.pressure(F.col("prior_count"), average("_before", "prior_count")))
        .withColumn("delta", F.round(F.col("current_pressure") - F.col("prior_pressure"), 2))
        .select("code", "current_pressure", "prior_pressure", "delta", "current_count", "current_avg_urgency",
                "current_max_urgency")
    )


def rising_easing(delta: DataFrame, rising: int = 10, easing: int = 5, min_events: int = 5) -> DataFrame:
    """The codes with the strongest rise, and those with the strongest fall."""
    active = delta.filter(F.col("current_count") >= min_events)
    up = active.orderBy(F.col("delta").desc(), "code").limit(rising).withColumn("list", F.lit("rising"))
    down = active.orderBy("delta", "code").limit(easing).withColumn("list", F.lit("easing"))
    return up.unionByName(down)


def weekly_buckets(records: DataFrame, as_of: str, weeks: int = 78) -> DataFrame:
    """Records per code and week, oldest week first, zero where there were none.

    Only codes and weeks that occur are shuffled; the empty weeks are filled in after the counts.
    """
    age = dates.age_days(as_of, F.col("day"))
    counted = (
        _coded(records).filter((age >= 0) & (age < weeks * 7))
        .groupBy("code", (F.lit(weeks - 1) - F.floor(age / 7)).cast("int").alias("week")).agg(F.count("*").alias("n"))
    )
    dense = counted.select("code").distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    return dense.join(counted, ["code", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def window_counts(records: DataFrame, as_of: str, windows: tuple[int, ...] = (30, 90, 180)) -> DataFrame:
    """Records per jurisdiction inside nested windows, keyed by impacted and by topic jurisdiction."""
    age = dates.age_days(as_of)
    kept = records.filter(age.between(0, max(windows)))
    topic = F.when(F.coalesce(F.col("topic_jurisdiction_code"), F.lit("")) != "", F.col("topic_jurisdiction_code"))
    keys = F.concat(
        F.transform(F.col("impacted_business.jurisdiction"), lambda j: F.struct(F.lit("impacted").alias("key"), j.alias("code"))),
        F.array(F.struct(F.lit("topic").alias("key"), topic.alias("code"))))
    single = kept.select(age.alias("age"), F.explode(keys).alias("k")).filter("k.code IS NOT NULL")
    return single.groupBy("k.key", "k.code").agg(
        *[F.count_if(F.col("age") <= w).alias(f"days_{w}") for w in windows])


def cluster_verdict(counts: DataFrame, windows: tuple[int, ...] = (30, 90, 180), codes: int = 8, events: int = 5) -> DataFrame:
    """Per key, whether enough codes have enough events in each window."""
    return counts.groupBy("key").agg(
        *[(F.count_if(F.col(f"days_{w}") >= events) >= codes).alias(f"cluster_{w}") for w in windows])


def state_dashboard(records: DataFrame, as_of: str, window: int = 90) -> DataFrame:
    """Counts and urgency per state, the federal level and other countries.

    A bare two-letter code that is a postal code counts as that state.
    """
    recent = records.filter(dates.within_age(as_of, window))
    single = recent.select(scores.score("urgency").alias("urgency"), F.explode(places.impacted()).alias("j"))
    placed = single.select("urgency", places.place_kind(F.col("j")).alias("kind"),
                           F.coalesce(places.state_of(F.col("j")), F.col("j")).alias("code"))
    return placed.filter("kind IS NOT NULL").groupBy("kind", "code").agg(
        F.count("*").alias("n"), F.max("urgency").alias("max_urgency"),
        F.round(F.sum("urgency") / F.count("*"), 2).alias("avg_urgency"))


def report_headline(records: DataFrame, as_of: str, strict: bool = True) -> DataFrame:
    """Events, active codes and high-urgency events of the last 90 days.

    strict counts ages 0 to 90. Without it age 0 is left out and future dates count, as the first reports did.
    """
    events = (
        _coded(records, world_only=True).filter(dates.within_age(as_of, 90, F.col("day")))
        .groupBy("code").agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("*").alias("active_codes"))
    )
    age = dates.age_days(as_of)
    in_time = age.between(0, 90) if strict else (age <= 90) & (age != 0)
    urgent = records.agg(F.count_if((scores.score("urgency") >= 8) & in_time).alias("n")).scalar()
    return events.withColumn("high_urgency", urgent)


