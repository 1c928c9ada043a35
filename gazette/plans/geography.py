"""Jurisdiction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions import dates, places, scores
from gazette.operators import geography, spread
from gazette.plans.contracts import substantive
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, define, oracle, records

_PRESSURE = "round(least(100.0, {n} * {a} / 5.0), 2)"
define("substantive", "SELECT * FROM recs WHERE substantive AND day IS NOT NULL AND code IS NOT NULL", "recs")


@query("jurisdiction_pressure", oracle(f"""
    SELECT *, {_PRESSURE.format(n='n', a='avg_urgency')} AS pressure FROM (
      SELECT code, count(*) AS n, sum(urgency) AS sum_urgency, max(urgency) AS max_urgency,
             round(sum(urgency) / count(*), 2) AS avg_urgency
      FROM substantive WHERE age BETWEEN 0 AND 90 GROUP BY code)""", "substantive"))
def jurisdiction_pressure(spark, folder):
    return geography.jurisdiction_totals(substantive(spark, folder), AS_OF)


define("deltas", f"""
    SELECT code, {_PRESSURE.format(n='current_count', a='current_avg_urgency')} AS current_pressure,
           {_PRESSURE.format(n='prior_count', a='prior_avg')} AS prior_pressure,
           round({_PRESSURE.format(n='current_count', a='current_avg_urgency')}
                 - {_PRESSURE.format(n='prior_count', a='prior_avg')}, 2) AS delta,
           current_count, current_avg_urgency, current_max_urgency
    FROM (SELECT coalesce(c.code, p.code) AS code, coalesce(c.n, 0) AS current_count, coalesce(p.n, 0) AS prior_count,
                 coalesce(c.a, 0.0) AS current_avg_urgency, coalesce(p.a, 0.0) AS prior_avg,
                 coalesce(c.m, 0.0) AS current_max_urgency
          FROM (SELECT code, count(*) AS n, round(sum(urgency) / count(*), 2) AS a, max(urgency) AS m FROM substantive
                WHERE age BETWEEN 0 AND 90 AND length(code) = 2 GROUP BY code) c
          FULL JOIN (SELECT code, count(*) AS n, round(sum(urgency) / count(*), 2) AS a FROM substantive
                WHERE age BETWEEN 90 AND 180 AND length(code) = 2 GROUP BY code) p ON c.code = p.code)""", "substantive")


@query("pressure_delta", oracle("SELECT * FROM deltas", "deltas"))
def pressure_delta(spark, folder):
    return geography.pressure_delta(substantive(spark, folder), AS_OF)


@query("rising_easing", oracle("""
    SELECT code, delta, 'rising' AS list FROM (SELECT * FROM deltas WHERE current_count >= 5 ORDER BY delta DESC, code LIMIT 10)
    UNION ALL
    SELECT code, delta, 'easing' FROM (SELECT * FROM deltas WHERE current_count >= 5 ORDER BY delta, code LIMIT 5)""", "deltas"))
def rising_easing(spark, folder):
    return geography.rising_easing(pressure_delta(spark, folder)).select("code", "delta", "list")


@query("pressure_text", oracle("""
    SELECT code, format('{} pressure is {} ({:+.1f} vs prior 90d). {} events at avg urgency {:.1f}.', code,
           CASE WHEN delta >= 0 THEN 'rising' ELSE 'easing' END, round(delta, 1), current_count, round(current_avg_urgency, 1)) AS narrative
    FROM deltas""", "deltas"))
def pressure_text(spark, folder):
    """One sentence per code from its numbers."""
    trend = F.when(F.col("delta") >= 0, "rising").otherwise("easing")
    sentence = F.format_string("%s pressure is %s (%+.1f vs prior 90d). %d events at avg urgency %.1f.",
                               F.col("code"), trend, F.col("delta"), F.col("current_count"), F.col("current_avg_urgency"))
    return pressure_delta(spark, folder).select("code", sentence.alias("narrative"))


@query("weekly_buckets", oracle("""
    SELECT c.code, CAST(w AS INT) AS week, count(s.record_id) AS n
    FROM (SELECT DISTINCT code FROM substantive WHERE age BETWEEN 0 AND 545) c, generate_series(0, 77) g(w)
    LEFT JOIN substantive s ON s.code = c.code AND s.age BETWEEN 0 AND 545 AND 77 - s.age // 7 = w
    GROUP BY ALL""", "substantive"))
def weekly_buckets(spark, folder):
    return geography.weekly_buckets(substantive(spark, folder), AS_OF)


define("window_rows", """
    SELECT key, code, count(*) FILTER (age <= 30) AS days_30, count(*) FILTER (age <= 90) AS days_90, count(*) AS days_180
    FROM (SELECT 'impacted' AS key, impacted_1 AS code, age FROM recs UNION ALL
          SELECT 'impacted', impacted_2, age FROM recs UNION ALL
          SELECT 'topic', nullif(jurisdiction_code, ''), age FROM recs)
    WHERE age BETWEEN 0 AND 180 AND code IS NOT NULL GROUP BY key, code""", "recs")


@query("window_counts", oracle("SELECT * FROM window_rows", "window_rows"))
def window_counts(spark, folder):
    return geography.window_counts(records(spark, folder), AS_OF)


@query("cluster_verdict", oracle("""
    SELECT key, count(*) FILTER (days_30 >= 5) >= 8 AS cluster_30, count(*) FILTER (days_90 >= 5) >= 8 AS cluster_90,
           count(*) FILTER (days_180 >= 5) >= 8 AS cluster_180 FROM window_rows GROUP BY key""", "window_rows"))
def cluster_verdict(spark, folder):
    return geography.cluster_verdict(window_counts(spark, folder))


_STATES = "('AL','AK','AZ','AR','CA','CO','CT','DE','FL','GA','HI','ID','IL','IN','IA','KS','KY','LA','ME','MD','MA'," \
          "'MI','MN','MS','MO','MT','NE','NV','NH','NJ','NM','NY','NC','ND','OH','OK','OR','PA','RI','SC','SD','TN'," \
          "'TX','UT','VT','VA','WA','WV','WI','WY','DC','PR','VI','GU','AS','MP')"


@query("state_dashboard", oracle(f"""
    SELECT kind, CASE WHEN kind = 'state' AND length(j) = 2 THEN 'US-' || j ELSE j END AS code, count(*) AS n,
           max(urgency) AS max_urgency, round(sum(urgency) / count(*), 2) AS avg_urgency
    FROM (SELECT urgency, j, CASE WHEN (j LIKE 'US-%' AND length(j) = 5) OR j IN {_STATES} THEN 'state'
                 WHEN j = 'US' THEN 'federal' WHEN regexp_matches(j, '^[A-Za-z]{{2}}$') THEN 'international' END AS kind
          FROM (SELECT urgency, age, unnest([impacted_1, impacted_2]) AS j FROM recs) WHERE age BETWEEN 0 AND 90 AND j <> '')
    WHERE kind IS NOT NULL GROUP BY ALL""", "recs"))
def state_dashboard(spark, folder):
    return geography.state_dashboard(records(spark, folder), AS_OF)


@query("report_headline", oracle("""
    SELECT (SELECT count(*) FROM substantive WHERE age BETWEEN 0 AND 90 AND length(code) = 2) AS events,
           (SELECT count(DISTINCT code) FROM substantive WHERE age BETWEEN 0 AND 90 AND length(code) = 2) AS active_codes,
           (SELECT count(*) FROM recs WHERE substantive AND urgency >= 8 AND age BETWEEN 0 AND 90) AS high_urgency
    """, "substantive"))
def report_headline(spark, folder):
    return geography.report_headline(substantive(spark, folder), AS_OF)


@query("key_union", oracle("""
    SELECT code FROM substantive WHERE age BETWEEN 0 AND 90 UNION
    SELECT code FROM substantive WHERE age BETWEEN 90 AND 180""", "substantive"))
def key_union(spark, folder):
    """Codes active now or in the window before."""
    kept = substantive(spark, folder).select(places.country_code().alias("code"), dates.age_days(AS_OF).alias("age"))
    kept = kept.filter("code IS NOT NULL")
    return kept.filter("age BETWEEN 0 AND 90").select("code").union(
        kept.filter("age BETWEEN 90 AND 180").select("code")).distinct()


@query("code_top_events", oracle("""
    SELECT code, record_id, rank FROM (
      SELECT code, record_id, CAST(row_number() OVER (PARTITION BY code
             ORDER BY round(urgency * exp(-age / 14.0), 6) DESC, seq) AS INT) AS rank
      FROM substantive WHERE age BETWEEN 0 AND 90) WHERE rank <= 3""", "substantive"))
def code_top_events(spark, folder):
    """The three hottest events of each code."""
    age = dates.age_days(AS_OF)
    kept = substantive(spark, folder).filter(dates.within_age(AS_OF, 90)).select(
        places.country_code().alias("code"), "record_id", "seq",
        F.round(scores.decayed(scores.score("urgency"), age), 6).alias("value")).filter("code IS NOT NULL")
    return spread.top_per_group(kept, ["code"], [F.col("value").desc(), F.col("seq")], 3, "rank") \
                 .select("code", "record_id", "rank")


@query("country_code", oracle("""
    SELECT record_id, code, CASE WHEN length(code) = 2 THEN code END AS world_code FROM recs""", "recs"))
def country_code(spark, folder):
    return records(spark, folder).select("record_id", places.country_code().alias("code"),
                                         places.country_code(world_only=True).alias("world_code"))


@query("us_states", oracle("""
    SELECT record_id, concat_ws(',', CASE WHEN impacted_1 LIKE 'US-%' AND length(impacted_1) = 5 THEN impacted_1 END,
           CASE WHEN impacted_2 LIKE 'US-%' AND length(impacted_2) = 5 THEN impacted_2 END) AS states,
           (CASE WHEN impacted_1 <> '' THEN 1 ELSE 0 END) + 1 AS jurisdictions FROM recs""", "recs"))
def us_states(spark, folder):
    return records(spark, folder).select("record_id", F.array_join(places.us_states(), ",").alias("states"),
                                         F.size(places.impacted()).alias("jurisdictions"))
