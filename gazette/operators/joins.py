"""Lookups between records, topics, curated lists and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import dates
from gazette.functions.common import text
from gazette.operators import spread


def enrich_topics(records: DataFrame, catalog: DataFrame, known: DataFrame) -> DataFrame:
    """Records with topic columns; the catalog's name wins over the known one.

    Both topic tables have one row per topic and are merged before they meet the records.
    """
    topics = known.join(catalog.select("topic_id", F.col("name").alias("catalog_name")), "topic_id", "left")
    topics = topics.select("topic_id", F.coalesce(F.nullif("catalog_name", F.lit("")), "name", F.lit("")).alias("topic_label"),
                           "jurisdiction_code")
    return records.join(topics, "topic_id", "left")


def last_per_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key; partial results merge, so repeats of a key never meet in full."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order, *columns)).alias("_last")).select(key, "_last.*")


def annotate_entries(entries: DataFrame, annotations: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Entries with their last annotation; an entry without one keeps nulls."""
    return entries.join(last_per_key(annotations, key, order, columns), key, "left")


def rehydrate(timeline: DataFrame, corpus: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Timeline rows with their corpus record; rows whose record is gone are dropped."""
    return timeline.join(last_per_key(corpus.join(timeline.select(key).distinct(), key, "left_semi"), key, order, columns), key)


def curated(records: DataFrame, ids: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First occurrence of each curated id."""
    return spread.first_per_key(records.join(ids.select(key).distinct(), key, "left_semi"), [key], order)


def featured(ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Featured ids in their order with a mark for those that do not exist."""
    present = items.select(key).distinct().withColumn("found", F.lit(True))
    return ids.join(present, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def curated_order(items: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Items in the order of a curated list (key, pos), then the remaining ones by key."""
    return items.join(order, key, "left").orderBy(F.col("pos").asc_nulls_last(), key)


def roles(footprint: DataFrame) -> DataFrame:
    """One role per code; closed outranks considering, which outranks operating."""
    weight = F.when(F.col("role") == "closed", 3).when(F.col("role") == "considering", 2).otherwise(1)
    return footprint.groupBy("code").agg(F.max_by("role", weight).alias("role"))


HIT_RATE = r"(\d+)\s*/\s*(\d+)\s*\(\s*(\d+)\s*%\s*\)"


def hit_rate(c: Column) -> list[Column]:
    """Adopted, total and percent out of "31/39 (79%)"; zeros when the text has another form."""
    part = lambda i: F.coalesce(F.regexp_extract(text(c), HIT_RATE, i).try_cast("int"), F.lit(0))
    return [part(1).alias("adopted"), part(2).alias("total"), part(3).alias("percent")]


def cascade_terms(cascades: DataFrame) -> DataFrame:
    """Cascades with parsed hit rate and the day by which members should follow."""
    due = F.date_add(dates.iso_day(F.col("trigger_date")), F.col("follow_days"))
    return cascades.select("*", *hit_rate(F.col("hit_text")), due.cast("string").alias("due"))


def cascade_members(cascades: DataFrame, footprint: DataFrame) -> DataFrame:
    """One row per cascade and member code with the platform's role there."""
    single = cascades.select("cascade_id", F.explode("members").alias("code"))
    return single.join(roles(footprint), "code", "left").withColumn("role", F.coalesce("role", F.lit("other")))


def topic_prefilter(topics: DataFrame, names: DataFrame) -> DataFrame:
    """Topics whose name contains a known name.

    The first characters of a known name, up to three, are the join key; a topic offers all its pieces of
    that length. Candidates are then checked in full, so the substring test becomes an equi-join.
    """
    known = names.select(F.lower("name").alias("known")).filter("known <> ''").distinct() \
                 .withColumn("piece", F.substring("known", 1, 3))
    name = F.lower("topic_name")
    starts = F.sequence(F.lit(1), F.length(name))
    pieces = F.array_distinct(F.flatten(F.array(*[F.transform(starts, lambda i: F.substring(name, i, F.lit(n))) for n in (1, 2, 3)])))
    offered = topics.filter(F.length("topic_name") > 0).withColumn("piece", F.explode(pieces))
    return offered.join(known, "piece").filter(name.contains(F.col("known"))).select(*topics.columns).distinct()


def dedupe_then_filter(records: DataFrame, key: str, condition: Column) -> DataFrame:
    """First occurrence per id, then the filter; a rejected first occurrence still claims its id."""
    return spread.first_per_key(records, [key], [F.col("seq")]).filter(condition)


def dedupe_two_keys(signals: DataFrame, first: str, second: str, size: int) -> DataFrame:
    """First occurrence per id, then per link where there is one, then the newest rows.

    Two passes differ from one shared scan only when the first row of an id falls to its link while a later
    row of that id would not.
    """
    unique = spread.first_per_key(signals, [first], [F.col("seq")])
    linked = spread.first_per_key(unique.filter(text(F.col(second)) != ""), [second], [F.col("seq")])
    kept = linked.unionByName(unique.filter(text(F.col(second)) == ""))
    return kept.orderBy(F.col("pub_date").desc(), "seq").limit(size)


def citation_check(published: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """ok, mismatch or unchecked for each published address against the addresses recorded as resolving."""
    joined = published.join(known, key, "left")
    outcome = (F.when(F.col("resolving").isNull(), "unchecked")
               .when(F.array_contains("resolving", F.col("url")), "ok").otherwise("mismatch"))
    return joined.select(key, outcome.alias("outcome"))


def counted(left: DataFrame, rows: DataFrame, key: str, out: str) -> DataFrame:
    """Row counts per key of the left table, zero without rows."""
    per = rows.groupBy(key).agg(F.count("*").alias(out))
    return left.join(per, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))
