"""Statistics over evaluation runs and their grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators import spread


def run_accuracy(grades: DataFrame) -> DataFrame:
    """Share of graded checks passed; 0 when a must-pass check failed, null when none is graded."""
    graded = F.col("pass").isNotNull()
    per = grades.groupBy("run_id").agg(
        F.count_if(graded).alias("graded"), F.count_if(~graded).alias("ungraded"), F.count_if("pass").alias("passed"),
        F.count_if(F.col("must_pass") & ~F.col("pass")).alias("must_failed"))
    share = F.when(F.col("must_failed") > 0, 0.0).otherwise(F.col("passed") / F.col("graded"))
    return per.withColumn("accuracy", F.when(F.col("graded") > 0, share))


def scored_runs(runs: DataFrame, grades: DataFrame) -> DataFrame:
    """Runs with an accuracy; grades shrink to one row per run before the join."""
    accuracy = run_accuracy(grades).select("run_id", "accuracy", "ungraded").filter("accuracy IS NOT NULL")
    return runs.join(accuracy, "run_id")


def error_counts(scored: DataFrame, grades: DataFrame, keys: list[str]) -> DataFrame:
    """Failed checks by error type."""
    failed = grades.filter(~F.col("pass") & F.col("error_type").isNotNull()).groupBy("run_id", "error_type") \
                   .agg(F.count("*").alias("n"))
    return scored.select("run_id", *keys).join(failed, "run_id").groupBy(*keys, "error_type").agg(F.sum("n").alias("n"))


def strata(scored: DataFrame, baseline: str, known_from: float = 0.5) -> DataFrame:
    """Stratum each question falls into by how the baseline arm does on it."""
    base = scored.filter(F.col("arm") == baseline).groupBy("question_id").agg((F.avg("accuracy") >= known_from).alias("known"))
    kind = (F.when(F.col("stratum") == "tail-silent-trigger", F.col("stratum"))
            .when(F.coalesce("known", F.lit(False)), "baseline-knowable").otherwise("baseline-blind"))
    return scored.join(base, "question_id", "left").withColumn("empirical_stratum", kind).drop("known")


def _quartile(i: int) -> dict:
    """Positions around quartile i of the exclusive method; the ends when there are fewer than four values."""
    at = lambda n: F.greatest(F.least(F.floor(i * (n + 1) / 4), n - 1), F.lit(1))
    edge = (lambda n: F.lit(0)) if i == 1 else (lambda n: n - 1)
    return {f"_q{i}a": lambda n: F.when(n < 4, edge(n)).otherwise(at(n) - 1),
            f"_q{i}b": lambda n: F.when(n < 4, edge(n)).otherwise(at(n))}


def _quartile_value(i: int) -> Column:
    n = F.col("n")
    at = F.greatest(F.least(F.floor(i * (n + 1) / 4), n - 1), F.lit(1))
    delta = F.lit(i) * (n + 1) - at * 4
    low, high = F.col(f"_q{i}a"), F.col(f"_q{i}b")
    return F.when(n < 4, low).otherwise((low * (4 - delta) + high * delta) / 4)


def measured(rows: DataFrame, keys: list[str], values: list[str], statistics) -> DataFrame:
    """Order statistics of several measures of each group, by one pass: a measure is one more key.

    `statistics` gives the columns of one measure from its order statistics, by name.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    long = rows.select(*keys, F.explode(pairs).alias("_m")).select(*keys, F.col("_m.name").alias("_measure"), F.col("_m.value").alias("_v"))
    positions, columns = statistics
    found = spread.order_statistics(long, [*keys, "_measure"], "_v", positions)
    wide = [F.max(F.when(F.col("_measure") == v, expression)).alias(f"{v}_{name}") for v in values for name, expression in columns.items()]
    return found.groupBy(*keys).agg(*wide)


_MIDDLE = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}


def _median():
    return _MIDDLE, {"median": (F.col("_low") + F.col("_high")) / 2}


def _distribution():
    """Median, quartiles, 90th percentile by index, least and greatest value."""
    positions = {**_MIDDLE, **_quartile(1), **_quartile(3), "_p90": lambda n: F.least(n - 1, F.floor(n * 9 / 10)), "_min": lambda n: F.lit(0), "_max": lambda n: n - 1}
    return positions, {**_median()[1], "q1": _quartile_value(1), "q3": _quartile_value(3), "p90": F.col("_p90"), "min": F.col("_min"), "max": F.col("_max")}


def distribution(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Median, quartiles, 90th percentile by index, least and greatest value of each measure and group."""
    return measured(rows, keys, list(values), _distribution())


def medians(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    return measured(rows, keys, list(values), _median())


def arm_stats(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, cost, latency and tokens of each group; runs shrink to one row per question first."""
    per_question = scored.groupBy(*keys, "question_id").agg(
        F.count("*").alias("runs"), F.sum("accuracy").alias("accuracy"), F.count_if(F.col("accuracy") == 0).alias("zero"),
        (F.max("accuracy") - F.min("accuracy")).alias("spread"))
    many = F.col("runs") > 1
    totals = per_question.groupBy(*keys).agg(
        F.sum("runs").alias("n_runs"), F.count("*").alias("n_questions"),
        F.round(F.sum("accuracy") / F.sum("runs"), 4).alias("accuracy_mean"),
        F.round(F.sum("zero") / F.sum("runs"), 4).alias("zero_rate"),
        F.round(F.coalesce(F.avg(F.when(many, F.col("spread"))), F.lit(0.0)), 4).alias("repeat_spread"))
    return totals.join(distribution(scored, keys, "cost", "latency", "tokens"), keys).withColumn("cost_per_1k", 1000 * F.col("cost_median"))


def pareto(points: DataFrame) -> DataFrame:
    """Marks points (cost, accuracy) that no other point beats on both; one pass in cost order.

    A point falls to a cheaper one that is at least as accurate, or to a more accurate one of equal cost.
    """
    per_cost = points.groupBy("cost").agg(F.max("accuracy").alias("best_here"))
    before = spread.running(per_cost, "cost", "best_here", "best_before", fold=F.max, inclusive=False)
    beaten = F.coalesce(F.col("best_before") >= F.col("accuracy"), F.lit(False)) | (F.col("best_here") > F.col("accuracy"))
    return points.join(before, "cost").withColumn("on_frontier", ~beaten).drop("best_here", "best_before")


def breakeven(scored: DataFrame, baseline: str) -> DataFrame:
    """Extra cost per flawed answer avoided, per arm against the baseline; null without a gain."""
    per = scored.groupBy("arm").agg(F.avg("accuracy").alias("accuracy"), F.avg((F.col("accuracy") < 1).cast("double")).alias("flawed")) \
                .join(spread.median(scored, ["arm"], "cost", "cost"), "arm")
    base = per.filter(F.col("arm") == baseline).select(F.struct("cost", "accuracy", "flawed")).scalar()
    rows = per.filter(F.col("arm") != baseline).withColumn("_base", base).select(
        "arm", (F.col("cost") - F.col("_base.cost")).alias("extra"), (F.col("accuracy") - F.col("_base.accuracy")).alias("gain"),
        F.col("_base.flawed").alias("flawed"))
    return rows.select(
        "arm", F.round("extra", 4).alias("extra_cost"), F.round("flawed", 4).alias("baseline_flawed_rate"),
        F.round("gain", 4).alias("accuracy_gain"),
        F.when(F.col("gain") > 0, F.round(F.col("extra") / F.col("gain"), 4)).alias("cost_per_flaw"))


def replay_pairs(first: DataFrame, replay: DataFrame) -> DataFrame:
    """Replays next to the first run of the same question and arm; of several first runs the last counts."""
    keys = ["question_id", "arm"]
    one = first.groupBy(*keys).agg(F.max_by("cost", "run_id").alias("first_cost"))
    return replay.join(one, keys).select("run_id", *keys, "first_cost", F.col("cost").alias("replay_cost"), "cached_share")


def replay_summary(pairs: DataFrame) -> DataFrame:
    """Median cost of first runs and replays, change in percent, and cached share, per arm."""
    columns = ["first_cost", "replay_cost", "cached_share"]
    out = pairs.groupBy("arm").agg(F.count("*").alias("pairs")).join(medians(pairs, ["arm"], *columns), "arm")
    out = out.withColumnsRenamed({f"{c}_median": c for c in columns})
    change = 100 * (F.col("replay_cost") - F.col("first_cost")) / F.col("first_cost")
    return out.select("arm", "pairs", F.round(1000 * F.col("first_cost"), 2).alias("first_per_1k"),
                      F.round(1000 * F.col("replay_cost"), 2).alias("replay_per_1k"), F.round(change, 1).alias("change_pct"),
                      F.round("cached_share", 4).alias("cached_share"))


def hit_rate(answers: DataFrame, pattern: str, control: str) -> DataFrame:
    """Share of answers per arm that name the expected thing, and of items where any repeat does.

    For the control arm a mention is a false positive, so silence counts as right. Answers with a cost also give the
    median cost of a thousand.
    """
    per_item = answers.withColumn("hit", F.col("text").rlike(pattern)).groupBy("arm", "item").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    right = F.when(F.col("arm") == control, F.sum("n") - F.sum("hits")).otherwise(F.sum("hits"))
    rates = per_item.groupBy("arm").agg(
        F.sum("n").alias("answers"), F.sum("hits").alias("hits"), right.alias("right"), F.count("*").alias("items"),
        F.count_if(F.col("hits") > 0).alias("any_hit")).withColumn("rate", F.round(F.col("right") / F.col("answers"), 4))
    if "cost" not in answers.columns:
        return rates
    return rates.join(medians(answers, ["arm"], "cost").select("arm", (1000 * F.col("cost_median")).alias("cost_per_1k")), "arm", "left")


def probe_summary(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Median and range of several measures of each group."""
    out = runs.groupBy(*keys).agg(F.count("*").alias("runs"), *[F.min(v).alias(f"{v}_min") for v in values],
                                  *[F.max(v).alias(f"{v}_max") for v in values])
    return out.join(medians(runs, keys, *values), keys)
