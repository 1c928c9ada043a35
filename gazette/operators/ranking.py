"""Orders, top lists and page-sized results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import dates, scores
from gazette.functions.common import text
from gazette.operators import spread


def inbox(records: DataFrame, as_of: str, pinned: str, size: int, assignees: list[str]) -> DataFrame:
    """The best eligible records by score and date, one pinned record first, dealt out to assignees.

    Only the kept rows are numbered. A pinned id that is not eligible fails the query.
    """
    eligible = records.filter(scores.is_substantive() & dates.within_age(as_of, vocab.HEAT_WINDOW_DAYS)) \
                      .withColumn("score", scores.rank_score(as_of))
    order = [F.when(F.col("record_id") == pinned, 0).otherwise(1), F.col("score").desc(), F.col("pub_date").desc(), F.col("seq")]
    top = spread.ranked_limit(eligible, order, size)
    missing = F.raise_error(F.lit(f"pinned record {pinned} is not eligible"))
    lead = F.when((F.col("position") == 1) & (F.col("record_id") != pinned), missing.cast("int")).otherwise(F.col("position"))
    turn = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("position") - 1, F.lit(len(values))) + 1)
    return top.withColumn("position", lead).withColumn("status", turn(vocab.STATUS_CYCLE)) \
              .withColumn("assignee", turn(assignees))


def recent_per_topic(updates: DataFrame, marquee: list[str], latest: str, many: int = 30, few: int = 3) -> DataFrame:
    """The newest usable updates of each topic; marquee topics keep more."""
    usable = updates.filter(dates.usable(F.col("pub_date"), latest) & (text(F.col("title")) != ""))
    capped = usable.withColumn("cap", F.when(F.col("topic_name").isin(marquee), many).otherwise(few))
    order = [F.col("pub_date").desc(), F.col("title"), F.col("seq")]
    return spread.top_per_group(capped, ["topic_id"], order, max(many, few), "rank").filter("rank <= cap")


def relevance_top(judged: DataFrame, top: int = 20, least: int = 5) -> DataFrame:
    """Judged records per contract: the relevant ones by score times urgency, filled up from the rest.

    A score below 4 takes direction and tag away. Both pools are cut per contract before they meet.
    """
    weak = F.col("score") < 4
    settled = (
        judged
        .withColumn("direction", F.when(weak, "neutral").otherwise(F.col("direction")))
        .withColumn("tag", F.when(weak | ~F.col("relevant"), "background").otherwise(F.col("tag")))
        .withColumn("value", F.col("score") * F.col("urgency"))
    )
    order = [F.col("value").desc(), F.col("seq")]
    picked = spread.top_per_group(settled, ["contract_id", "relevant"], order, max(top, least), "rank")
    have = (picked.filter("relevant").groupBy("contract_id").agg(F.count("*").alias("have")))
    pool = picked.join(have, "contract_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    keep = F.when(F.col("relevant"), F.col("rank") <= top).otherwise(F.col("rank") <= least - F.col("have"))
    return pool.filter(keep).drop("have")


def split_pools(items: DataFrame, feed_size: int = 12, horizon_size: int = 8, least: int = 3) -> DataFrame:
    """Items by similarity in two lists: forward-looking ones and the rest.

    With fewer than `least` forward-looking items, the ones that did not fit the other list move over.
    """
    order = [F.col("similarity").desc(), F.col("seq")]
    ahead = spread.ranked_limit(items.filter("forward_looking"), order, horizon_size, "rank")
    rest = spread.ranked_limit(items.filter("NOT forward_looking"), order, feed_size + horizon_size, "rank")
    have = items.filter("forward_looking").limit(least).agg(F.count("*")).scalar()
    feed = rest.filter(F.col("rank") <= feed_size).withColumn("list", F.lit("feed"))
    overflow = rest.filter((F.col("rank") > feed_size) & (F.lit(least) > have)) \
                   .withColumn("rank", F.col("rank") - feed_size + have.cast("int"))
    horizon = ahead.unionByName(overflow).filter(F.col("rank") <= horizon_size).withColumn("list", F.lit("horizon"))
    return feed.unionByName(horizon)


@dataclass(frozen=True)
class DomainQuery:
    """A structured question to the domain records; a field that is None does not filter."""

    date_from: str | None = None
    date_to: str | None = None
    min_impact: float | None = None
    update_type: str | None = None
    regulator: str | None = None
    keyword: str | None = None
    group_by: str | None = None
    order_by: str = "date"
    limit: int = 20

    def condition(self) -> Column:
        """All given filters; a record without an impact score fails a minimum."""
        holds = F.lit(True)
        contains = lambda c, needle: F.lower(text(c)).contains(needle.lower())
        if self.date_from:
            holds &= F.col("pub_date") >= self.date_from
        if self.date_to:
            holds &= F.col("pub_date") <= self.date_to
        if self.min_impact is not None:
            holds &= F.coalesce(F.col("impact_score") >= self.min_impact, F.lit(False))
        if self.update_type:
            holds &= F.lower("update_type") == self.update_type.lower()
        if self.regulator:
            holds &= contains(F.col("regulator"), self.regulator)
        if self.keyword:
            holds &= contains(F.concat_ws("\n", "title", "what_changed", "why_it_matters", F.array_join("tags", " ")), self.keyword)
        return holds

    def groups(self, records: DataFrame) -> DataFrame:
        """Count and best impact per regulator, type or month."""
        return group_views(records.filter(self.condition()), [self.group_by]).drop("view").orderBy(F.col("n").desc(), "key")

    def page(self, records: DataFrame) -> DataFrame:
        """The first rows in order with the number of all matches."""
        found = records.filter(self.condition())
        order = [F.col("pub_date").desc(), F.col("seq")]
        if self.order_by == "impact":
            order = [F.coalesce("impact_score", F.lit(-1.0)).desc(), *order]
        size = min(max(self.limit, 1), 100)
        return spread.ranked_limit(found, order, size).withColumn("matches", found.agg(F.count("*")).scalar())


def group_views(records: DataFrame, views: list[str]) -> DataFrame:
    """(view, key, n, max_impact) for several groupings of the records, by one pass and one aggregate."""
    keys = {"regulator": F.col("regulator"), "update_type": F.col("update_type"), "month": F.substring("pub_date", 1, 7)}
    named = F.array(*[F.struct(F.lit(v).alias("view"), F.when(text(keys[v]) == "", "(unknown)").otherwise(keys[v]).alias("key")) for v in views])
    return (records.select(F.explode(named).alias("_g"), "impact_score").groupBy("_g.view", "_g.key")
            .agg(F.count("*").alias("n"), F.max("impact_score").alias("max_impact")))
