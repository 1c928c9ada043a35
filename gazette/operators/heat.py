"""Heat of contracts, all read off one small table: matched records per contract and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import dates, scores
from gazette.operators import matching, spread
from gazette.session import stored


def contract_days(contracts: DataFrame, records: DataFrame, since: str | None = None,
                  until: str | None = None, links: DataFrame | None = None) -> DataFrame:
    """contract_id, day, n, urgency, urgency_whole over matching records.

    Records with the same entities on the same day are counted before any join, so a popular entity costs
    one row per day and not one per record.
    """
    day = dates.pub_day()
    bounds = day.isNotNull()
    if since:
        bounds &= day >= F.lit(since).cast("date")
    if until:
        bounds &= day <= F.lit(until).cast("date")
    urgency = scores.score("urgency")
    counted = (
        records.filter(bounds)
        .select(matching.normal_entities(F.col("entities")).alias("entities"), day.alias("day"), urgency.alias("u"))
        .groupBy("entities", "day")
        .agg(F.count("*").alias("n"), F.sum("u").alias("urgency"), F.sum(F.col("u").cast("int")).alias("urgency_whole"))
    )
    # A contract counts a set of entities once, however many of them match.
    single = counted.withColumn("entity", F.explode("entities"))
    hits = (matching.match_entities(single, contracts, links=links).groupBy("contract_id", "entities", "day")
            .agg(F.max("n").alias("n"), F.max("urgency").alias("urgency"), F.max("urgency_whole").alias("urgency_whole")))
    return hits.groupBy("contract_id", "day").agg(
        F.sum("n").alias("n"), F.sum("urgency").alias("urgency"), F.sum("urgency_whole").alias("urgency_whole"))


def decayed_sum(as_of: Column, max_age: int = vocab.HEAT_WINDOW_DAYS) -> Column:
    """Heat over contract days as of a date."""
    age = F.datediff(as_of, F.col("day"))
    in_window = age.between(0, max_age)
    return F.round(F.coalesce(F.sum(F.when(in_window, scores.decayed(F.col("urgency"), age))), F.lit(0.0)), 2)


def heat(contracts: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Heat per contract; contracts without a match have zero."""
    today = F.lit(as_of).cast("date")
    since = F.date_sub(today, vocab.HEAT_WINDOW_DAYS)
    recent = records.filter(dates.pub_day().between(since, today))
    days = contract_days(contracts, recent)
    return (contracts.select("contract_id").join(days, "contract_id", "left")
            .groupBy("contract_id").agg(decayed_sum(today).alias("heat")))


def heat_delta(contracts: DataFrame, records: DataFrame, as_of: str, back: int = 7, links: DataFrame | None = None) -> DataFrame:
    """Heat now, a week earlier and their difference; a resolved contract's "now" is its last day.

    All as-of dates are conditions on the same contract days: one join, one aggregate.
    """
    today = F.lit(as_of).cast("date")
    now = F.when(F.col("kind") == "retrospective", dates.iso_day(F.col("resolved_at"))).otherwise(today)
    days = contract_days(contracts, records, until=as_of, links=links)
    per = (contracts.select("contract_id", "kind", now.alias("now")).join(days, "contract_id", "left")
           .groupBy("contract_id", "kind")
           .agg(decayed_sum(F.col("now")).alias("heat"), decayed_sum(F.date_sub("now", back)).alias("heat_before"),
                decayed_sum(today).alias("heat_today")))
    return per.withColumn("heat_delta", F.round(F.col("heat") - F.col("heat_before"), 2))


def sparkline(contracts: DataFrame, days: DataFrame, as_of: str, value: str = "n", width: int = 14) -> DataFrame:
    """Array of one number per day, oldest first, zero where nothing matched."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("day"))
    points = [F.coalesce(F.sum(F.when(age == width - 1 - i, F.col(value))), F.lit(0)) for i in range(width)]
    return (contracts.select("contract_id").join(days, "contract_id", "left")
            .groupBy("contract_id").agg(F.array(*points).alias("sparkline")))


def match_stats(contracts: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    """Matches in the window, and the last day with a match that is not in the future."""
    today = F.lit(as_of).cast("date")
    age = F.datediff(today, F.col("day"))
    return (
        contracts.select("contract_id").join(days, "contract_id", "left").groupBy("contract_id")
        .agg(F.coalesce(F.sum(F.when(age.between(0, vocab.HEAT_WINDOW_DAYS), F.col("n"))), F.lit(0)).alias("events"),
             F.coalesce(F.max(F.when(F.col("day") <= today, F.col("day"))).cast("string"), F.lit("")).alias("last_day"))
    )


def peer_percentile(heats: DataFrame) -> DataFrame:
    """Share of contracts at or below each contract's heat, itself included, with both tiers."""
    values = heats.groupBy("heat").agg(F.count("*").alias("_rows"))
    upto = spread.running(values, "heat", "_rows", "_upto").select("heat", "_upto")
    total = heats.agg(F.count("*")).scalar()
    percentile = F.bround(F.lit(100) * F.col("_upto") / total, 0).cast("int")
    return (heats.join(upto, "heat").withColumn("percentile", percentile).drop("_upto")
            .withColumn("peer_tier", scores.percentile_tier(F.col("percentile")))
            .withColumn("tier", scores.heat_tier(F.col("heat"))))


def heat_panel(contracts: DataFrame, records: DataFrame, as_of: str, back: int = 7, links: DataFrame | None = None) -> DataFrame:
    """Heat, its change, its share among all contracts and its tier, from one match of contracts and records."""
    both = stored(heat_delta(contracts, records, as_of, back, links), "heat")
    peers = peer_percentile(both.select("contract_id", F.col("heat_today").alias("heat")))
    return both.select("contract_id", "heat_delta").join(peers, "contract_id")


def sectioned(rows: DataFrame) -> DataFrame:
    """Dashboard order: active contracts by heat, then resolved ones by id, both downwards."""
    active = F.col("kind") == "active"
    section = F.when(active, 0).otherwise(1)
    return rows.withColumn("section", section).orderBy(
        "section", F.when(active, F.col("heat")).desc_nulls_last(), F.col("contract_id").desc())
