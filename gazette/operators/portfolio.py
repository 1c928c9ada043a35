"""Judged events rolled up to contracts, portfolios and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.common import text


def condition_counts(conditions: DataFrame, events: DataFrame) -> DataFrame:
    """Direct and background counts, progress and sentiment of each condition (contract_id, condition).

    Events shrink to one row per contract and tag before they meet the conditions.
    """
    up, down = F.col("direction") == "bullish", F.col("direction") == "bearish"
    per = events.groupBy("contract_id", F.col("tag").alias("condition")).agg(
        F.count_if(up).alias("bullish"), F.count_if(down).alias("bearish"))
    background = per.filter(F.col("condition") == "background").select(
        "contract_id", F.col("bullish").alias("background_bullish"), F.col("bearish").alias("background_bearish"))
    joined = conditions.join(per, ["contract_id", "condition"], "left").join(background, "contract_id", "left").fillna(0)
    total = F.col("bullish") + F.col("bearish")
    progress = F.when(total > 0, F.bround(F.col("bullish") / total * 100, 0).cast("int")).otherwise(50)
    sentiment = (F.when(F.col("bullish") > F.col("bearish"), "bullish").when(F.col("bearish") > F.col("bullish"), "bearish")
                 .otherwise("neutral"))
    return joined.withColumn("progress", progress).withColumn("sentiment", sentiment)


def _direction(up: Column, down: Column) -> Column:
    return F.when(up > down * 1.5, "Bullish").when(down > up * 1.5, "Bearish").otherwise("Mixed")


def net_direction(contracts: DataFrame, events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Bullish or Bearish when one side outnumbers the other by more than half, else Mixed.

    Events after the as-of date count too.
    """
    recent = F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days)
    per = events.filter(recent).groupBy("contract_id").agg(
        F.count_if(F.col("direction") == "bullish").alias("up"), F.count_if(F.col("direction") == "bearish").alias("down"))
    return contracts.select("contract_id").join(per, "contract_id", "left").fillna(0).select(
        "contract_id", _direction(F.col("up"), F.col("down")).alias("net_direction"))


def _dated(events: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per filled date field of an event."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.substring(text(F.col(c)), 1, 10).alias("calendar_date"))
                      for c, kind in fields.items()])
    return events.withColumn("_d", F.explode(pairs)).select("*", "_d.kind", "_d.calendar_date").drop("_d") \
                 .filter("calendar_date <> ''")


def next_catalyst(events: DataFrame, as_of: str) -> DataFrame:
    """The earliest future effective date or comment deadline of each contract."""
    ahead = _dated(events, {"effective_date": "effective_date", "comment_deadline": "comment_deadline"}).filter(
        F.col("calendar_date") > as_of)
    order = F.struct("calendar_date", "seq", "kind")
    return ahead.groupBy("contract_id").agg(F.min_by(F.struct("calendar_date", "kind", "title"), order).alias("_n")) \
                .select("contract_id", "_n.*")


def portfolio(contracts: DataFrame, panel: DataFrame, events: DataFrame, conditions: DataFrame, as_of: str,
              days: int = 30, positions: DataFrame | None = None) -> DataFrame:
    """One row per active contract, hottest first: title, heat with tier, change and percentile, direction, counts, next
    catalyst, latest event, position.

    The events are read once: everything about them comes from one aggregate per contract and tag. `panel` has
    contract_id, heat, heat_delta, percentile and tier; `positions` contract_id, side, size and entry_price.
    """
    up, down = F.col("direction") == "bullish", F.col("direction") == "bearish"
    recent = F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days)
    ahead = F.array_min(F.filter(F.array("effective_date", "comment_deadline"), lambda d: d > as_of))
    per_tag = events.groupBy("contract_id", "tag").agg(
        F.count("*").alias("n"), F.count_if(up).alias("up"), F.count_if(down).alias("down"),
        F.count_if(up & recent).alias("recent_up"), F.count_if(down & recent).alias("recent_down"),
        F.max(F.struct("day", (-F.col("seq")).alias("order"), "title", "direction", "magnitude")).alias("latest"), F.min(ahead).alias("catalyst_date"))
    wanted = conditions.select("contract_id", F.col("condition").alias("tag")).withColumn("direct", F.lit(True))
    marked = per_tag.join(wanted, ["contract_id", "tag"], "left")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    direct, background = F.col("direct"), F.col("tag") == "background"
    per = marked.groupBy("contract_id").agg(
        total(direct, "up").alias("bullish"), total(direct, "down").alias("bearish"),
        total(background, "up").alias("background_bullish"), total(background, "down").alias("background_bearish"),
        F.sum("n").alias("events"), F.sum("recent_up").alias("up"), F.sum("recent_down").alias("down"),
        F.max("latest").alias("latest"), F.min("catalyst_date").alias("catalyst_date"))
    active = contracts.filter(F.col("kind") != "retrospective").select("contract_id", "platform", "title", "expires_at")
    rows = active.join(panel, "contract_id", "left").join(per, "contract_id", "left")
    if positions is None:
        held = F.lit(None).cast("struct<side: string, size: double, entry_price: double>")
    else:
        rows = rows.join(positions.select("contract_id", F.struct("side", "size", "entry_price").alias("_held")), "contract_id", "left")
        held = F.col("_held")
    counts = ["bullish", "bearish", "background_bullish", "background_bearish", "events"]
    return rows.select(
        "contract_id", "platform", text(F.col("title")).alias("title"), text(F.col("expires_at")).alias("expires_at"), "heat",
        F.coalesce("tier", F.lit("dormant")).alias("heat_tier"), F.coalesce("heat_delta", F.lit(0.0)).alias("heat_delta"),
        F.coalesce("percentile", F.lit(0)).alias("peer_percentile"),
        _direction(F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))).alias("net_direction"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("catalyst_date", F.lit("")).alias("catalyst_date"),
        *[F.coalesce(F.col(f"latest.{c}").cast("string"), F.lit("")).alias(f"latest_{c}") for c in ("day", "title", "direction", "magnitude")],
        held.alias("position")).orderBy(F.col("heat").desc(), "contract_id")


def calendar_events(contracts: DataFrame, events: DataFrame) -> DataFrame:
    """Settlements, effective dates, deadlines and publications as dated rows."""
    settled = contracts.filter(text(F.col("expires_at")) != "").select(
        "contract_id", F.lit("settlement").alias("kind"), F.substring("expires_at", 1, 10).alias("calendar_date"),
        F.concat(F.lit("Settlement: "), "title").alias("title"))
    dated = _dated(events.withColumn("published", F.col("day").cast("string")), {
        "effective_date": "effective_date", "comment_deadline": "comment_deadline", "published": "regulatory_event"})
    return settled.unionByName(dated.select("contract_id", "kind", "calendar_date", "title"))


def calendar_month(events: DataFrame, first_day: str, busy_from: int = 3) -> DataFrame:
    """Every day of a month with its week (Sunday first), weekday, event count and a busy mark."""
    first = F.lit(first_day).cast("date")
    spark = events.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("day"))
    counted = events.filter(F.col("calendar_date").cast("string").startswith(first_day[:7])).groupBy("calendar_date").agg(F.count("*").alias("events"))
    joined = days.join(counted, F.date_format("day", "yyyy-MM-dd") == F.col("calendar_date"), "left")
    n = F.coalesce("events", F.lit(0))
    week = F.floor((F.dayofmonth("day") + F.dayofweek(first) - 2) / 7).cast("int")
    return joined.select(F.col("day").cast("string").alias("day"), week.alias("week"), (F.dayofweek("day") - 1).alias("weekday"),
                         n.alias("events"), (n >= busy_from).alias("busy"))


def transition_log(tickets: DataFrame) -> DataFrame:
    """Transitions of tickets in time order, each as "from → to"."""
    rows = tickets.select("ticket_id", "title", F.explode("transitions").alias("t"))
    named = lambda c, other: F.when(text(F.col(c)) == "", other).otherwise(F.col(c))
    return rows.select("ticket_id", "title", "t.at", F.concat(named("t.from", "(new)"), F.lit(" → "), named("t.to", "?")).alias("transition")) \
               .orderBy("at", "ticket_id", "transition")


