"""Judged events, portfolio and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.operators import heat, matching, portfolio, ranking
from gazette.plans.contracts import _HEAT, substantive
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, contracts, define, oracle, records
from gazette.session import stored, table

TODAY = f"DATE '{AS_OF}'"
define("verdicts", """SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CASE l_returnflag WHEN 'A' THEN 'bullish' WHEN 'R' THEN 'bearish'
    ELSE 'neutral' END AS direction, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_quantity > 25 THEN 'c1' ELSE 'c2' END ELSE 'background' END AS tag,
    l_linenumber AS score, l_tax <= 0.06 AS relevant FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) = 1""")
define("judged", """SELECT t.*, CASE WHEN score < 4 THEN 'neutral' ELSE direction END AS direction,
    CASE WHEN score < 4 OR NOT relevant THEN 'background' ELSE tag END AS tag, score, relevant, score * urgency AS value,
    effective_date, comment_deadline FROM timeline t JOIN verdicts v USING (record_id)
    JOIN (SELECT record_id, effective_date, comment_deadline FROM records) USING (record_id)""", "timeline", "verdicts", "records")
define("picked", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, relevant ORDER BY value DESC, seq) AS rank,
    count(*) FILTER (relevant) OVER (PARTITION BY contract_id) AS have FROM judged)
    WHERE (relevant AND rank <= 20) OR (NOT relevant AND rank <= 5 - least(have, 20))""", "judged")


def verdicts(spark, folder):
    """The last verdict of each record."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record_id"),
        F.when(F.col("l_returnflag") == "A", "bullish").when(F.col("l_returnflag") == "R", "bearish").otherwise("neutral").alias("direction"),
        F.when(F.col("l_linestatus") == "F", F.when(F.col("l_quantity") > 25, "c1").otherwise("c2")).otherwise("background").alias("tag"),
        F.col("l_linenumber").alias("score"), (F.col("l_tax") <= 0.06).alias("relevant"),
        F.struct("l_shipdate", "l_linenumber", "l_extendedprice").alias("at"))
    return rows.groupBy("record_id").agg(F.max_by(F.struct("direction", "tag", "score", "relevant"), "at").alias("v")).select("record_id", "v.*")


def judged(spark, folder, links=None):
    """Timeline events with their verdicts, before the cut."""
    events = matching.contract_timeline(contracts(spark, folder), records(spark, folder), AS_OF,
                                        "critical_dates.effective_date", "critical_dates.comment_deadline", links=links)
    return events.join(verdicts(spark, folder), "record_id")


def picked(spark, folder, links=None):
    return ranking.relevance_top(judged(spark, folder, links))


@query("relevance_topn", oracle("SELECT contract_id, record_id, direction, tag, CAST(rank AS INT) AS rank FROM picked", "picked"))
def relevance_topn(spark, folder):
    return picked(spark, folder).select("contract_id", "record_id", "direction", "tag", "rank")


def conditions(spark, folder):
    """Two conditions per contract."""
    return contracts(spark, folder).select("contract_id", F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("condition"))


define("conditions", """SELECT c.contract_id, condition, bullish, bearish, coalesce(bb, 0) AS background_bullish, coalesce(bd, 0) AS background_bearish,
    CASE WHEN bullish + bearish > 0 THEN CAST(round_even(bullish / (bullish + bearish) * 100, 0) AS INT) ELSE 50 END AS progress,
    CASE WHEN bullish > bearish THEN 'bullish' WHEN bearish > bullish THEN 'bearish' ELSE 'neutral' END AS sentiment FROM (
      SELECT c.contract_id, k.condition, count(*) FILTER (direction = 'bullish') AS bullish, count(*) FILTER (direction = 'bearish') AS bearish
      FROM contracts c CROSS JOIN (VALUES ('c1'), ('c2')) k(condition) LEFT JOIN picked p ON p.contract_id = c.contract_id AND tag = condition
      GROUP BY ALL) c LEFT JOIN (SELECT contract_id, count(*) FILTER (direction = 'bullish') AS bb, count(*) FILTER (direction = 'bearish') AS bd
      FROM picked WHERE tag = 'background' GROUP BY contract_id) USING (contract_id)""", "contracts", "picked")


@query("condition_counts", oracle("SELECT * FROM conditions", "conditions"))
def condition_counts(spark, folder):
    return portfolio.condition_counts(conditions(spark, folder), picked(spark, folder))


define("directions", f"""SELECT contract_id, CASE WHEN up > down * 1.5 THEN 'Bullish' WHEN down > up * 1.5 THEN 'Bearish' ELSE 'Mixed' END AS net_direction
    FROM (SELECT c.contract_id, count(*) FILTER (direction = 'bullish') AS up, count(*) FILTER (direction = 'bearish') AS down
          FROM contracts c LEFT JOIN picked p ON p.contract_id = c.contract_id AND day >= {TODAY} - 30 GROUP BY c.contract_id)""",
       "contracts", "picked")


@query("net_direction", oracle("SELECT * FROM directions", "directions"))
def net_direction(spark, folder):
    return portfolio.net_direction(contracts(spark, folder), picked(spark, folder), AS_OF)


define("catalysts", f"""SELECT contract_id, calendar_date, kind, title FROM (
    SELECT contract_id, effective_date AS calendar_date, 'effective_date' AS kind, title, seq FROM picked UNION ALL
    SELECT contract_id, comment_deadline, 'comment_deadline', title, seq FROM picked) WHERE calendar_date > '{AS_OF}'
    QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY calendar_date, seq, kind) = 1""", "picked")


@query("next_catalyst", oracle("SELECT * FROM catalysts", "catalysts"))
def next_catalyst(spark, folder):
    return portfolio.next_catalyst(picked(spark, folder), AS_OF)


define("graded", "SELECT *, CASE WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS magnitude FROM picked", "picked")


@query("portfolio", oracle(f"""
    SELECT contract_id, platform, title, expires_at, heat, tier AS heat_tier, heat_delta, percentile AS peer_percentile, net_direction, CAST(coalesce(b, 0) AS BIGINT) AS bullish, CAST(coalesce(d, 0) AS BIGINT) AS bearish,
           coalesce(bb, 0) AS background_bullish, coalesce(bd, 0) AS background_bearish, coalesce(n, 0) AS events,
           coalesce(calendar_date, '') AS catalyst_date, coalesce(CAST(latest.day AS VARCHAR), '') AS latest_day, coalesce(latest.title, '') AS latest_title,
           coalesce(latest.direction, '') AS latest_direction, coalesce(latest.magnitude, '') AS latest_magnitude,
           CASE WHEN CAST(substr(contract_id, 2) AS INT) % 3 = 0 THEN 'YES' END AS position_side
    FROM contracts JOIN (SELECT contract_id, heat, tier, percentile FROM peers) USING (contract_id)
    JOIN (SELECT contract_id, round(h1 - h2, 2) AS heat_delta FROM (SELECT contract_id, {_HEAT.format(asof=TODAY)} AS h1, {_HEAT.format(asof=f'({TODAY} - 7)')} AS h2
          FROM contracts LEFT JOIN contract_days USING (contract_id) GROUP BY contract_id)) USING (contract_id)
    JOIN directions USING (contract_id)
    LEFT JOIN (SELECT contract_id, sum(bullish) AS b, sum(bearish) AS d, max(background_bullish) AS bb, max(background_bearish) AS bd FROM conditions
               GROUP BY contract_id) USING (contract_id)
    LEFT JOIN (SELECT contract_id, count(*) AS n, arg_max({{'day': day, 'title': title, 'direction': direction, 'magnitude': magnitude}}, (day, -seq)) AS latest FROM graded GROUP BY contract_id) USING (contract_id)
    LEFT JOIN catalysts USING (contract_id) WHERE contracts.kind <> 'retrospective'""".replace("LEFT JOIN catalysts USING",
    "LEFT JOIN (SELECT contract_id, calendar_date FROM catalysts) USING"), "contracts", "peers", "contract_days", "directions", "conditions", "graded", "catalysts"))
def portfolio_rows(spark, folder):
    """Positions are those of every third contract; an event's magnitude follows its score.

    Heat and timeline share one table of entity links, and the picked events, read by five branches, are written once.
    """
    book = contracts(spark, folder)
    links = matching.link_table(book, records(spark, folder))
    panel = heat.heat_panel(book, substantive(spark, folder), AS_OF, links=links)
    events = stored(picked(spark, folder, links), "picked").withColumn("magnitude", F.when(F.col("score") >= 6, "high").when(F.col("score") >= 4, "medium").otherwise("low"))
    held = book.filter(F.substring("contract_id", 2, 9).cast("int") % 3 == 0).select(
        "contract_id", F.lit("YES").alias("side"), F.lit(100.0).alias("size"), F.lit(0.5).alias("entry_price"))
    rows = portfolio.portfolio(book, panel, events, conditions(spark, folder), AS_OF, positions=held)
    return rows.withColumn("position_side", F.col("position.side")).drop("position")


define("calendar", """SELECT contract_id, 'settlement' AS kind, substring(expires_at, 1, 10) AS calendar_date, 'Settlement: ' || title AS title FROM contracts
    WHERE expires_at <> '' UNION ALL SELECT contract_id, 'effective_date', effective_date, title FROM picked WHERE effective_date <> ''
    UNION ALL SELECT contract_id, 'comment_deadline', comment_deadline, title FROM picked WHERE comment_deadline <> ''
    UNION ALL SELECT contract_id, 'regulatory_event', CAST(day AS VARCHAR), title FROM picked""", "contracts", "picked")


@query("calendar_events", oracle("SELECT * FROM calendar", "calendar"))
def calendar_events(spark, folder):
    return portfolio.calendar_events(contracts(spark, folder), picked(spark, folder))


@query("calendar_grid", oracle("""
    SELECT CAST(d AS VARCHAR) AS day, CAST((dayofmonth(d) + dayofweek(DATE '2001-07-01') - 1) // 7 AS INT) AS week,
           CAST(dayofweek(d) AS INT) AS weekday, count(c.kind) AS events, count(c.kind) >= 3 AS busy
    FROM (SELECT DATE '2001-07-01' + CAST(g AS INT) AS d FROM generate_series(0, 30) s(g))
    LEFT JOIN calendar c ON c.calendar_date = CAST(d AS VARCHAR) GROUP BY d""", "calendar"))
def calendar_grid(spark, folder):
    return portfolio.calendar_month(calendar_events(spark, folder), "2001-07-01")


@query("transition_log", """
    SELECT o_orderkey AS ticket_id, o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "at", '(new) → open' AS transition FROM orders
    UNION ALL SELECT o_orderkey, o_orderpriority, CAST(CAST(o_orderdate AS DATE) + 2 AS VARCHAR), 'open → ' || CASE o_orderstatus WHEN 'F' THEN 'filed'
      WHEN 'O' THEN '?' ELSE 'parked' END FROM orders""")
def transition_log(spark, folder):
    day = F.col("o_orderdate").cast("date")
    step = lambda at, before, after: F.struct(at.cast("string").alias("at"), before.alias("from"), after.alias("to"))
    status = F.when(F.col("o_orderstatus") == "F", "filed").when(F.col("o_orderstatus") == "O", "").otherwise("parked")
    tickets = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("ticket_id"), F.col("o_orderpriority").alias("title"),
        F.array(step(day, F.lit(""), F.lit("open")), step(F.date_add(day, 2), F.lit("open"), status)).alias("transitions"))
    return portfolio.transition_log(tickets)
