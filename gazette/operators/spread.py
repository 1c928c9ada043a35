"""Ways to keep one heavy key from landing in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.session import stored


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group.

    Spark cuts each group to k rows in every map task before the shuffle (window group limit), so a heavy
    group reaches its final task as k rows per map task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def ranked_limit(df: DataFrame, order: list[Column], k: int, rank: str = "position") -> DataFrame:
    """The first k rows overall, numbered from 1. Only the k kept rows pass through the window."""
    kept = df.orderBy(*order).limit(k)
    return kept.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


#: Bits of an image that a level decides; a window then sees at most two to this power rows.
LEVEL = 16
LEVELS = 64 // LEVEL
#: Rows of a small side that may be copied to all tasks.
COPIED = 1 << 16


def with_image(df: DataFrame, value: str) -> DataFrame:
    """The frame with `_image`, a 64-bit number that orders like the value read as a double; nulls come first.

    The bits of a positive double grow with it, those of a negative one fall, so they are turned round.
    """
    plain = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) + F.lit(0.0)
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("bigint")
    image = F.when(F.col("_bits") >= 0, F.col("_bits")).otherwise(F.col("_bits").bitwiseXOR(F.lit((1 << 63) - 1)))
    return df.withColumn("_bits", bits).withColumn("_image", F.when(F.col(value).isNotNull(), image).otherwise(F.lit(-(1 << 63)))).drop("_bits")


def _prefix(level: int) -> Column:
    """The high bits of the image that levels 0 to `level` have decided."""
    return F.shiftright("_image", 64 - LEVEL * (level + 1))


def order_statistics(df: DataFrame, keys: list[str], value: str, positions: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact values at given 0-based positions of each group's sorted values, by radix selection.

    Equal values are counted first, and the counts are written. A level adds up a group's counts by the next LEVEL bits of the
    image and finds in which of them each position falls; the next level reads only counts there. After LEVELS levels the image,
    and with it the value, is whole. A window sees at most 2^LEVEL rows, whatever the size of a group.
    """
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_rows")))
    counts = stored(with_image(counts, "_value"), "counts")
    # What is asked has a row per group and position; it is copied to all tasks if its counted rows are few, and joined by shuffle if not.
    few = counts.select(*keys).distinct().count() * len(positions) <= COPIED
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("before"))
                       for name, at in positions.items()])
    asked = None
    for level in range(LEVELS):
        inner = [F.sum("_rows").alias("_in"), F.max("_value").alias("_value")]
        if asked is None:
            rows = counts.groupBy(*keys, _prefix(level).alias("_inner")).agg(*inner)
            group = keys
            rows = rows.withColumn("n", F.sum("_in").over(Window.partitionBy(*keys))).withColumn("_asked", wanted)
        else:
            group = [*keys, "_outer"]
            rows = counts.withColumn("_outer", _prefix(level - 1)).join(F.broadcast(asked) if few else asked, group).groupBy(*group, "n", _prefix(level).alias("_inner"))
            rows = rows.agg(*inner, F.any_value("_asked").alias("_asked"))
        rows = rows.withColumn("_upto", F.sum("_in").over(Window.partitionBy(*group).orderBy("_inner")))
        here = F.filter("_asked", lambda t: (t["at"] >= t["before"] + F.col("_upto") - F.col("_in")) & (t["at"] < t["before"] + F.col("_upto")))
        found = rows.withColumn("_t", F.explode(here)).withColumn("_before", F.col("_t.before") + F.col("_upto") - F.col("_in"))
        if level < LEVELS - 1:
            narrowed = F.struct("_t.name", "_t.at", F.col("_before").alias("before"))
            asked = found.groupBy(*keys, "n", F.col("_inner").alias("_outer")).agg(F.collect_list(narrowed).alias("_asked"))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_t.name") == name, F.col("_value"))).alias(name) for name in positions])


def median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact median of each group."""
    found = order_statistics(df, keys, value, {
        "_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)})
    return found.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(out))


def running(df: DataFrame, order: str, value: str, out: str, fold=F.sum, inclusive: bool = True) -> DataFrame:
    """Running sum or max over a whole frame whose order column, read as a double, has no repeats.

    The rows are folded by the first LEVEL bits of the order's image, by twice as many, and so on; at each level a window sees
    the at most 2^LEVEL folds that share the bits before, and gives what lies ahead of each. A row adds up what lies ahead of
    it at all levels. The rows are written first, as every level reads them.
    """
    rows = stored(with_image(df, order), "ordered")
    carried = []
    for level in range(LEVELS - 1):
        folds = rows.groupBy(_prefix(level).alias(f"_p{level}")).agg(fold(value).alias("_fold"))
        ahead = Window.partitionBy(F.shiftright(f"_p{level}", LEVEL) if level else F.lit(0)).orderBy(f"_p{level}")
        folds = folds.select(f"_p{level}", fold("_fold").over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c{level}"))
        rows = rows.withColumn(f"_p{level}", _prefix(level)).join(folds, f"_p{level}")
        carried.append(F.col(f"_c{level}"))
    last = F.col(f"_p{LEVELS - 2}")
    here = fold(value).over(Window.partitionBy(last).orderBy("_image").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    total = F.greatest(here, *carried) if fold is F.max else sum((F.coalesce(c, F.lit(0)) for c in carried), F.coalesce(here, F.lit(0)))
    return rows.withColumn(out, total).select(*df.columns, out)


def next_in_order(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with the named columns of the next row of its group, as `next_*`; null for the last of a group.

    All rows are cut into ranges by group, order and the named columns, as many as the session has shuffle partitions, and written
    with the number of their range, so that ranges stay as they are if a task runs twice. A window sees one range, so a group of any size
    is spread over many tasks; the last row of a range looks at the first of the next, from a table with a row per range. Rows
    that are alike in all of these follow each other.
    """
    place = [*keys, order, *[c for c in columns if c not in keys and c != order]]
    ranged = stored(df.repartitionByRange(*place).withColumn("_range", F.spark_partition_id()), "ranged")
    row = F.struct(*place)
    heads = ranged.groupBy("_range").agg(F.min(row).alias("_head"))
    heads = heads.select("_range", F.lead("_head").over(Window.orderBy("_range")).alias("_later"))
    ahead = F.lead(row).over(Window.partitionBy("_range").orderBy(*place))
    joined = ranged.withColumn("_ahead", ahead).join(heads, "_range")
    following = F.coalesce(F.col("_ahead"), F.col("_later"))
    same = reduce(and_, [following[k].eqNullSafe(F.col(k)) for k in keys], F.lit(True))
    return joined.select(*df.columns, *[F.when(same, following[c]).alias(f"next_{c}") for c in [order, *columns]])
