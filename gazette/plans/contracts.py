"""Contract queries: matching, heat, timelines, dashboard order."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import keywords, scores
from gazette.operators import heat, matching, spread
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, contracts, define, oracle, records

define("contract_days", """SELECT contract_id, day, count(*) AS n, sum(urgency) AS u, sum(CAST(urgency AS INT)) AS ui
    FROM matches JOIN recs USING (record_id) WHERE substantive AND day IS NOT NULL GROUP BY contract_id, day""",
       "matches", "recs")
_HEAT = "coalesce(round(sum(CASE WHEN {asof} - day BETWEEN 0 AND 90 THEN u * exp(-({asof} - day) / 14.0) END), 2), 0)"
_TODAY = f"DATE '{AS_OF}'"
define("heats", f"""SELECT contract_id, kind, {_HEAT.format(asof=_TODAY)} AS heat
    FROM contracts LEFT JOIN contract_days USING (contract_id) GROUP BY contract_id, kind""",
       "contracts", "contract_days")


def substantive(spark, folder, *extra):
    return records(spark, folder, *extra).filter(scores.is_substantive())


@query("heat_score", oracle("SELECT contract_id, heat FROM heats", "heats"))
def heat_score(spark, folder):
    return heat.heat(contracts(spark, folder), substantive(spark, folder), AS_OF)


@query("entity_join", oracle("SELECT contract_id, record_id, pos AS entity_pos FROM matches", "matches"))
def entity_join(spark, folder):
    found = matching.entity_join(contracts(spark, folder), records(spark, folder))
    return found.select("contract_id", "record_id", "first.entity_pos")


@query("entity_window_join", oracle("""
    SELECT contract_id, record_id, age FROM matches JOIN recs USING (record_id)
    WHERE age BETWEEN 0 AND 90""", "matches", "recs"))
def entity_window_join(spark, folder):
    found = matching.entity_window_join(contracts(spark, folder), records(spark, folder), AS_OF, 90)
    return found.select("contract_id", "record_id", "age")


define("timeline", f"""
    SELECT contract_id, record_id, seq, title, link, day, regulator, urgency, impact, name AS matched_entity FROM (
      SELECT m.contract_id, r.*, row_number() OVER (PARTITION BY m.contract_id, lower(trim(r.title)) ORDER BY seq) AS rn,
             k.name
      FROM matches m JOIN recs r USING (record_id) JOIN contracts c ON c.contract_id = m.contract_id
      JOIN contract_rows k ON k.contract_id = m.contract_id AND k.pos = m.pos
      WHERE update_type <> 'other' AND relevance >= 3 AND trim(r.title) <> '' AND link <> ''
        AND day >= CAST(listed_at AS DATE) - 90
        AND day <= CASE WHEN kind = 'retrospective' THEN CAST(resolved_at AS DATE) ELSE {_TODAY} END
    ) WHERE rn = 1""", "matches", "recs", "contracts", "contract_rows")


@query("contract_timeline", oracle("""
    SELECT contract_id, record_id, title, CAST(day AS VARCHAR) AS day, regulator, urgency, impact, matched_entity
    FROM timeline""", "timeline"))
def contract_timeline(spark, folder):
    found = matching.contract_timeline(contracts(spark, folder), records(spark, folder), AS_OF)
    return found.select("contract_id", "record_id", "title", F.col("day").cast("string").alias("day"), "regulator",
                        "urgency", "impact", "matched_entity")


define("scans", """
    SELECT contract_id, record_id, seq, title, urgency, age, urgency * exp(-age / 14.0) AS rank_value FROM (
      SELECT m.contract_id, r.*, row_number() OVER (PARTITION BY m.contract_id, lower(trim(title)) ORDER BY seq) AS rn
      FROM matches m JOIN recs r USING (record_id) WHERE substantive AND age BETWEEN 0 AND 90
    ) WHERE rn = 1""", "matches", "recs")


@query("scan_matches", oracle("""
    SELECT contract_id, record_id, title, urgency, age, round(rank_value, 4) AS rank_value FROM scans""", "scans"))
def scan_matches(spark, folder):
    found = matching.scan_matches(contracts(spark, folder), records(spark, folder), AS_OF)
    return found.select("contract_id", "record_id", "title", "urgency", "age",
                        F.round("rank_value", 4).alias("rank_value"))


@query("heat_delta", oracle(f"""
    SELECT contract_id, heat, heat_before, round(heat - heat_before, 2) AS heat_delta FROM (
      SELECT contract_id, {_HEAT.format(asof='now_day')} AS heat, {_HEAT.format(asof='(now_day - 7)')} AS heat_before
      FROM (SELECT *, CASE WHEN kind = 'retrospective' THEN CAST(resolved_at AS DATE) ELSE {_TODAY} END AS now_day
            FROM contracts) LEFT JOIN contract_days USING (contract_id) GROUP BY contract_id)
    """, "contracts", "contract_days"))
def heat_delta(spark, folder):
    found = heat.heat_delta(contracts(spark, folder), substantive(spark, folder), AS_OF)
    return found.select("contract_id", "heat", "heat_before", "heat_delta")


def _spark_sql(value):
    return oracle(f"""
    SELECT contract_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY g) AS sparkline FROM (
      SELECT contract_id, g, CAST(coalesce(sum({value}), 0) AS BIGINT) AS v
      FROM contracts, generate_series(0, 13) s(g)
      LEFT JOIN contract_days d ON d.contract_id = contracts.contract_id AND {_TODAY} - day = 13 - g
      GROUP BY ALL) GROUP BY contract_id""".replace("SELECT contract_id, g", "SELECT contracts.contract_id, g"),
                  "contracts", "contract_days")


def _sparkline(spark, folder, value):
    book = contracts(spark, folder)
    days = heat.contract_days(book, substantive(spark, folder), since="2001-07-18", until=AS_OF)
    line = heat.sparkline(book, days, AS_OF, value)
    return line.select("contract_id", F.array_join(F.col("sparkline").cast("array<string>"), ",").alias("sparkline"))


@query("sparkline", _spark_sql("n"))
def sparkline(spark, folder):
    return _sparkline(spark, folder, "n")


@query("sparkline_weighted", _spark_sql("ui"))
def sparkline_weighted(spark, folder):
    return _sparkline(spark, folder, "urgency_whole")


@query("match_stats", oracle(f"""
    SELECT contract_id, CAST(coalesce(sum(CASE WHEN {_TODAY} - day BETWEEN 0 AND 90 THEN n END), 0) AS BIGINT) AS events,
           coalesce(CAST(max(CASE WHEN day <= {_TODAY} THEN day END) AS VARCHAR), '') AS last_day
    FROM contracts LEFT JOIN contract_days USING (contract_id) GROUP BY contract_id""", "contracts", "contract_days"))
def match_stats(spark, folder):
    book = contracts(spark, folder)
    return heat.match_stats(book, heat.contract_days(book, substantive(spark, folder)), AS_OF)


_TIER = "CASE {0} ELSE 'dormant' END"
_PERCENTILE_SQL = " ".join(f"WHEN percentile >= {v} THEN '{n}'" for v, n in vocab.PERCENTILE_TIERS)
_HEAT_SQL = " ".join(f"WHEN heat >= {v} THEN '{n}'" for v, n in vocab.HEAT_TIERS)
define("peers", f"""SELECT contract_id, kind, heat, percentile, {_TIER.format(_PERCENTILE_SQL)} AS peer_tier,
    {_TIER.format(_HEAT_SQL)} AS tier
    FROM (SELECT a.contract_id, a.kind, a.heat,
                 CAST(round_even(100.0 * count(*) / (SELECT count(*) FROM heats), 0) AS INT) AS percentile
          FROM heats a JOIN heats b ON b.heat <= a.heat GROUP BY ALL)""", "heats")


@query("peer_percentile", oracle("SELECT contract_id, heat, percentile, peer_tier, tier FROM peers", "peers"))
def peer_percentile(spark, folder):
    return heat.peer_percentile(heat_score(spark, folder))


@query("sectioned_sort", oracle("""
    SELECT contract_id, kind, heat, CASE WHEN kind = 'active' THEN 0 ELSE 1 END AS section FROM heats
    ORDER BY section, CASE WHEN kind = 'active' THEN heat END DESC NULLS LAST, contract_id DESC""", "heats"))
def sectioned_sort(spark, folder):
    book = contracts(spark, folder)
    return heat.sectioned(heat_score(spark, folder).join(book.select("contract_id", "kind"), "contract_id"))


@query("rising_contracts", oracle("""
    SELECT contract_id, heat_delta FROM (SELECT contract_id, kind, round(heat - heat_before, 2) AS heat_delta FROM (
      SELECT contract_id, kind, HEAT_NOW AS heat, HEAT_BEFORE AS heat_before
      FROM contracts LEFT JOIN contract_days USING (contract_id) WHERE kind = 'active' GROUP BY contract_id, kind))
    ORDER BY heat_delta DESC, contract_id LIMIT 2""".replace("HEAT_NOW", _HEAT.format(asof=_TODAY)).replace(
        "HEAT_BEFORE", _HEAT.format(asof=f"({_TODAY} - 7)")), "contracts", "contract_days"))
def rising_contracts(spark, folder):
    """The two active contracts whose heat rose most."""
    rows = heat.heat_delta(contracts(spark, folder), substantive(spark, folder), AS_OF).filter("kind = 'active'")
    return rows.orderBy(F.col("heat_delta").desc(), "contract_id").limit(2).select("contract_id", "heat_delta")


@query("entity_role", oracle("""
    SELECT DISTINCT entity, CASE WHEN regexp_matches(entity,
      'commission|authority|bureau|department|agency|office|board|ministry|administration|service|committee|fed|treasury|reserve')
      THEN 'regulator' ELSE 'company' END AS role FROM entity_rows""", "entity_rows"))
def entity_role(spark, folder):
    single = records(spark, folder).select(F.explode(matching.normal_entities(F.col("entities"))).alias("entity"))
    return single.distinct().withColumn("role", keywords.entity_role(F.col("entity")))


@query("contract_window", oracle(f"""
    SELECT contract_id, CAST(CAST(listed_at AS DATE) - 90 AS VARCHAR) AS first_day,
           CAST(CASE WHEN kind = 'retrospective' THEN CAST(resolved_at AS DATE) ELSE {_TODAY} END AS VARCHAR) AS last_day
    FROM contracts""", "contracts"))
def contract_window(spark, folder):
    start, end = matching.contract_window(AS_OF)
    return contracts(spark, folder).select(
        "contract_id", start.cast("string").alias("first_day"), end.cast("string").alias("last_day"))


@query("topk_per_group", oracle("""
    SELECT contract_id, record_id, rank FROM (
      SELECT contract_id, record_id, CAST(row_number() OVER (PARTITION BY contract_id
             ORDER BY round(rank_value, 6) DESC, seq) AS INT) AS rank FROM scans) WHERE rank <= 10""", "scans"))
def topk_per_group(spark, folder):
    found = matching.scan_matches(contracts(spark, folder), records(spark, folder), AS_OF)
    order = [F.round("rank_value", 6).desc(), F.col("seq")]
    return spread.top_per_group(found, ["contract_id"], order, 10, "rank").select("contract_id", "record_id", "rank")


@query("candidate_cap", oracle("""
    SELECT contract_id, record_id, rank FROM (
      SELECT contract_id, record_id, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY urgency DESC, seq) AS INT)
             AS rank FROM timeline) WHERE rank <= 60""", "timeline"))
def candidate_cap(spark, folder):
    events = matching.contract_timeline(contracts(spark, folder), records(spark, folder), AS_OF)
    return spread.top_per_group(events, ["contract_id"], [F.col("urgency").desc(), F.col("seq")], 60, "rank") \
                 .select("contract_id", "record_id", "rank")
