"""Sampling, sweeps, trials and narrowing of candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import dates, keywords
from gazette.functions.common import text
from gazette.operators import spread

#: Rows of a stratum that are ranked together.
RANKED_TOGETHER = 100_000


def stratum(update_type: Column, place: Column, day: Column) -> Column:
    """Type, place (a listed code or other) and month."""
    bucket = F.when(place.isin(vocab.TOP_JURISDICTIONS), place).otherwise("other")
    month = F.when(F.length(day) >= 7, F.substring(day, 1, 7)).otherwise("unknown")
    return F.concat_ws("|", F.coalesce(F.nullif(update_type, F.lit("")), F.lit("unknown")), bucket, month)


def _fraction(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts; 52 bits, which any SQL engine can repeat."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**13))


def stratified_order(rows: DataFrame, key: str, strata: str, seed: int = 42) -> DataFrame:
    """Rows with `place`, a number by which every prefix of the order holds each stratum in its share.

    Inside a stratum of n rows a seeded hash ranks the rows, and rank r is placed at (r - u) / n with an offset u in (0, 1]
    of the stratum: a prefix up to x then holds n * x rows of it, give or take one. Ranks are counted in two
    levels: the hash cuts a stratum into as many slices as its size asks for, so no task ranks a whole large stratum.
    """
    sizes = rows.groupBy(strata).agg(F.count("*").alias("_size"))
    slices = F.ceil(F.col("_size") / RANKED_TOGETHER)
    hashed = rows.withColumn("_hash", _fraction(F.lit(str(seed)), F.col(key).cast("string"))).join(sizes, strata)
    hashed = hashed.withColumn("_slice", F.floor(F.col("_hash") * slices).cast("bigint"))
    before = Window.partitionBy(strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(strata, "_slice").agg(F.count("*").alias("_n"))
    counts = counts.select(strata, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(strata, "_slice").orderBy("_hash", key))
    ranked = hashed.withColumn("_rank", inside).join(counts, [strata, "_slice"])
    offset = 1 - _fraction(F.lit(str(seed)), F.lit("stratum"), F.col(strata))
    place = (F.col("_before") + F.col("_rank") - offset) / F.col("_size")
    return ranked.withColumn("place", place).select(*rows.columns, "place")


def stratified_prefix(rows: DataFrame, key: str, strata: str, prefix: int, seed: int = 42) -> DataFrame:
    """The first rows of an order whose every prefix keeps the strata's shares, numbered from 1."""
    ordered = stratified_order(rows, key, strata, seed)
    return spread.ranked_limit(ordered, [F.col("place"), F.col(strata), F.col(key)], prefix).drop("place")


def sweep(ordered: DataFrame, order: list[Column], target: int, cap: int) -> DataFrame:
    """Rows probed until enough survive or the cap is reached, with the reason for stopping.

    The cap bounds the rows that are numbered. Both limits are tested before a row, the target first.
    """
    probed = spread.ranked_limit(ordered, order, cap, "position")
    so_far = F.sum(F.col("survivor").cast("int")).over(Window.orderBy("position"))
    counted = probed.withColumn("survivors", so_far)
    kept = counted.filter(F.col("survivors") - F.col("survivor").cast("int") < target)
    done = kept.agg(F.max("survivors")).scalar()
    seen = kept.agg(F.count("*")).scalar()
    reason = F.when(done >= target, "target_reached").when(seen >= cap, "sweep_cap").otherwise("pool_exhausted")
    return kept.withColumn("stop_reason", reason)


def paired_rounds(probes: DataFrame) -> DataFrame:
    """Probes of rounds in which no arm was disqualified."""
    clean = probes.groupBy("round").agg(F.bool_or("disqualified").alias("spoiled")).filter("NOT spoiled").select("round")
    return probes.join(clean, "round", "left_semi")


def scenario_decision(probes: DataFrame, trial_min: int) -> DataFrame:
    """Mean strength and survivors per arm over paired rounds, and the winner; a tie goes to A.

    `probes` has arm, round, disqualified and modes (array of failure modes).
    """
    planned = probes.groupBy("arm").agg(F.count("*").alias("planned"))
    survived = F.size("modes") > 0
    done = paired_rounds(probes).groupBy("arm").agg(
        F.count("*").alias("completed"), F.avg(F.size("modes").cast("double")).alias("strength"),
        F.count_if(survived).alias("survivors"),
        F.count_if(F.array_contains("modes", "violation")).alias("stage_a_survivors"))
    per = planned.join(done, "arm", "left").fillna(0)
    enough = (F.col("planned") > 0) & (F.col("completed") >= F.least(F.col("planned"), F.lit(trial_min)))
    per = per.withColumn("enough", enough)
    decided = per.agg(F.bool_and("enough")).scalar()
    best = per.agg(F.min_by("arm", F.struct(-F.col("strength"), "arm"))).scalar()
    return per.select("arm", "planned", "completed", F.round("strength", 4).alias("strength"), "survivors", "stage_a_survivors",
                      F.when(decided, best).otherwise("undecided").alias("winner"))


def _keyed(df: DataFrame, industry: Column, functions: Column) -> DataFrame:
    """One row per place and tag; two rows that share a place and a tag share a key."""
    place = F.array_compact(F.array(F.when(text(F.col("country")) != "", F.concat(F.lit("c:"), "country")),
                                    F.when(text(F.col("bloc")) != "", F.concat(F.lit("b:"), "bloc"))))
    marked = lambda mark, tags: F.transform(tags, lambda t: F.concat(F.lit(mark), F.lower(t)))
    tags = F.array_distinct(F.concat(marked("i:", industry), marked("f:", functions)))
    return df.withColumn("place", F.explode(place)).withColumn("tag", F.explode(tags)).drop("country", "bloc")


def matching_classes(profiles: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs of profile and record that share a place and an industry or function, each pair once."""
    firm_industry = F.concat("industry", F.array("sector"))
    firms = profiles.withColumn("firm_industry", F.array_distinct(keywords.lowered(firm_industry))) \
                    .withColumn("firm_functions", F.array_distinct(keywords.lowered(F.col("functions")))) \
                    .select("profile_id", "country", "bloc", "firm_industry", "firm_functions")
    firm_keys = _keyed(firms, F.col("firm_industry"), F.col("firm_functions"))
    pairs = _keyed(records, F.col("industry"), F.col("functions")).join(firm_keys, ["place", "tag"])
    return pairs.drop("place", "tag").distinct()


def narrow(profiles: DataFrame, records: DataFrame, snapshot: str, size: int = 5, near_days: int = 180) -> DataFrame:
    """The most pressing records for each firm profile: same place and a shared industry or function.

    Both sides have country, bloc, industry and functions; profiles also have sector. Records with the same
    tags, place and urgency weight rank alike for every profile, so only the first `size` of each such class
    can be among a profile's first `size`. The join therefore meets classes, not records: it emits no more
    rows per class and profile than the answer may hold, however many records share a tag.
    """
    low = lambda c: F.array_sort(keywords.lowered(c))
    day = dates.iso_day(F.col("compliance_date"))
    weight = (F.when(text(F.col("compliance_date")) == "", 0)
              .when(F.datediff(day, F.lit(snapshot).cast("date")) <= near_days, 2).otherwise(1))
    classes = ["country", "bloc", "industry", "functions", "weight"]
    shaped = records.select("record_id", "country", "bloc", low(F.col("industry")).alias("industry"),
                            low(F.col("functions")).alias("functions"), weight.alias("weight"),
                            F.when(text(F.col("compliance_date")) == "", "9999-99-99").otherwise(F.col("compliance_date")).alias("due"))
    heads = spread.top_per_group(shaped, classes, [F.col("due"), F.col("record_id")], size)

    pairs = matching_classes(profiles, heads)
    shared = lambda mine, firms: F.size(F.filter(mine, lambda t: F.array_contains(firms, t)))
    rank = shared(F.col("industry"), F.col("firm_industry")) + shared(F.col("functions"), F.col("firm_functions")) + F.col("weight")
    scored = pairs.select("profile_id", "record_id", "due", rank.alias("value"))
    return spread.top_per_group(scored, ["profile_id"], [F.col("value").desc(), F.col("due"), F.col("record_id")], size, "position")
