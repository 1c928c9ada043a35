"""Skew-proof building blocks against plain computations."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.operators import runs, spread


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, with many repeated values."""
    rng = random.Random(7)
    rows = [("hot", float(rng.choice([1, 1, 2, 3, 500]) + rng.randint(0, 40))) for _ in range(4000)]
    rows += [(k, float(rng.randint(0, 9))) for k in ("a", "b", "c") for _ in range({"a": 1, "b": 3, "c": 50}[k])]
    return rows, spark.createDataFrame(rows, "k STRING, v DOUBLE")


def test_distribution_matches_statistics(skewed):
    rows, df = skewed
    got = {r.k: r for r in runs.distribution(df, ["k"], "v").collect()}
    for key in ("hot", "a", "b", "c"):
        values = sorted(v for k, v in rows if k == key)
        n = len(values)
        low, high = (values[0], values[-1]) if n < 4 else (statistics.quantiles(values, n=4)[0], statistics.quantiles(values, n=4)[2])
        r = got[key]
        assert (r.v_median, r.v_q1, r.v_q3) == pytest.approx((statistics.median(values), low, high))
        assert (r.v_p90, r.v_min, r.v_max) == (values[min(n - 1, int(0.9 * n))], values[0], values[-1])


def test_order_statistics_of_values_of_all_sizes(spark):
    """Values that differ in high bits, in low bits only, in sign, and not at all."""
    rng = random.Random(9)
    rows = [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)) for _ in range(500)]
    rows += [("narrow", 1.0 + k * 2.0 ** -52) for k in rng.sample(range(4000), 500)]
    rows += [("one", 7.5)] * 100 + [("zero", z) for z in (0.0, -0.0, float("inf"), -float("inf"), 1e-310)] + [("none", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r.k: r for r in spread.order_statistics(df, ["k"], "v", {"p": lambda n: F.floor(n / 3), "last": lambda n: n - 1}).collect()}
    assert set(got) == {"wide", "narrow", "one", "zero"}
    for key, r in got.items():
        values = sorted(v for k, v in rows if k == key)
        assert (r.n, r.p, r["last"]) == (len(values), values[len(values) // 3], values[-1])


def test_windows_of_order_statistics_are_bounded(spark, monkeypatch):
    """The result does not hang on the bits of a level."""
    rows = [(float(v * v % 1013) / 7,) for v in range(700)]
    df = spark.createDataFrame(rows, "v DOUBLE").withColumn("k", F.lit(1))
    for level in (8, 32):
        monkeypatch.setattr(spread, "LEVEL", level)
        monkeypatch.setattr(spread, "LEVELS", 64 // level)
        assert spread.order_statistics(df, ["k"], "v", {"p": lambda n: F.lit(400)}).first().p == sorted(rows)[400][0]


def test_running_sum_and_max(spark):
    rng = random.Random(3)
    rows = [(float(i) / 3, rng.randint(-5, 50)) for i in rng.sample(range(-5000, 10_000), 700)]
    df = spark.createDataFrame(rows, "o DOUBLE, v INT")
    for fold, plain in ((F.sum, sum), (F.max, max)):
        for inclusive in (True, False):
            got = {r.o: r.t for r in spread.running(df, "o", "v", "t", fold, inclusive).collect()}
            seen = []
            for o, v in sorted(rows):
                before = plain(seen) if seen else (0 if fold is F.sum else None)
                seen.append(v)
                assert got[o] == (plain(seen) if inclusive else before)


def test_next_in_order_across_periods(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(days=d), d) for d in (0, 1, 40, 41, 200)] + [("b", start, 7)]
    df = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP, v INT")
    got = sorted((r.k, r.v, r.next_v) for r in spread.next_in_order(df, ["k"], "ts", ["v"]).collect())
    assert got == [("a", 0, 1), ("a", 1, 40), ("a", 40, 41), ("a", 41, 200), ("a", 200, None), ("b", 7, None)]


@pytest.mark.parametrize("merged", ["true", "false"])
def test_next_in_order_with_a_heavy_group_against_a_plain_loop(spark, merged):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(40)]), r.randrange(3)) for _ in range(900)]
    rows += [("hot", 7, 1)] * 300
    df = spark.createDataFrame(rows, "k STRING, t INT, v INT")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, merged)
    try:
        got = [tuple(x) for x in spread.next_in_order(df, ["k"], "t", ["v"]).collect()]
    finally:
        spark.conf.unset(name)
    first = lambda x: (x is not None, x or 0)
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", first(x[1]), x[2]))
    wanted = [(*x, *(y[1:] if y and y[0] == x[0] else (None, None))) for x, y in zip(ordered, [*ordered[1:], None])]
    key = lambda x: [str(c) for c in x]
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_next_in_order_cuts_one_group_into_ranges(spark):
    df = spark.range(4000).selectExpr("1 AS k", "id AS t", "id AS v").repartition(3)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        plan = spread.next_in_order(df, ["k"], "t", ["v"])
        (folder,) = {f.rsplit("/", 1)[0] for f in plan.inputFiles()}
        sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("_range").count().collect()]
    finally:
        spark.conf.unset(name)
    assert len(sizes) == 4 and max(sizes) < 2500
    assert spread.next_in_order(df.limit(0), ["k"], "t", ["v"]).count() == 0


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = spread.top_per_group(df, ["k"], [F.col("id").desc()], 3)
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_running_takes_nulls_first_and_keeps_columns(spark):
    df = spark.createDataFrame([(2.0, 1, "b"), (None, 5, "a"), (-3.0, 2, "c")], "o DOUBLE, v INT, x STRING")
    made = spread.running(df, "o", "v", "t")
    assert made.columns == ["o", "v", "x", "t"] and sorted((r.x, r.t) for r in made.collect()) == [("a", 5), ("b", 8), ("c", 7)]
