"""Source, sink and lookup queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gazette.functions import keywords
from gazette.operators import devices, joins, matching
from gazette.plans.corpus import candidates
from gazette.plans.fields import RAW_SEVERITY, feed
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, _CODE, contracts, define, oracle, records
from gazette.session import fresh_path, table
from gazette.sources import annotations, tables

TODAY = f"DATE '{AS_OF}'"


@query("scan_json_props", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'""")
def scan_json_props(spark, folder):
    """JSON text of the events; error events carry a cut-off text, which is skipped."""
    cut = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, 4)")).otherwise(F.col("props"))
    raw = table(spark, folder, "events").select("event_id", cut.alias("props"))
    parsed = annotations.parse_json(raw, "props", "k BIGINT")
    return parsed.filter(F.col(annotations.BAD).isNull()).select("event_id", "k")


@query("scan_malformed", "SELECT count(*) AS read, count(*) FILTER (event_type = 'error') AS malformed, "
       "count(*) FILTER (event_type <> 'error') AS with_key FROM events")
def scan_malformed(spark, folder):
    """The same texts written as JSON lines and read back; malformed lines are counted."""
    cut = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, 4)")).otherwise(F.col("props"))
    path = fresh_path(spark, "lines")
    table(spark, folder, "events").select(cut.alias("value")).write.text(path)
    return annotations.quality(annotations.read_jsonl(spark, path, "k BIGINT"))


def raw_annotations(spark, folder):
    """Records folded back into the nested form, written as compressed JSON lines and read like a landed pull.

    Compressed files are read whole by one task, so their rows are bounded.
    """
    score = lambda n: F.struct(F.col(f"scores.{n}.label").alias("label"), F.col(f"scores.{n}.score").alias("score"),
                               F.lit(0.5).alias("confidence")).alias(n)
    s = F.struct
    nested = s(
        F.when(F.col("seq") % 29 != 0, F.col("record_id")).alias("id"),
        F.when(F.col("tag_2") == "Antitrust", "failed").otherwise("completed").alias("state"), F.col("topic_id"),
        F.lit("s1").alias("source_id"),
        s(F.col("record_id").alias("feed_entry_id"), s("title", F.col("link").alias("url")).alias("extracted_metadata")).alias("input_data"),
        F.when(F.col("requirements") > 0, s(
            s(score("impact"), score("urgency"), score("relevance")).alias("scores"),
            s("update_type", s(F.col("regulator_name").alias("name"), F.col("regulator_division").alias("division_office")).alias("regulatory_source"),
              s("country", "bloc").alias("jurisdiction"), "jurisdiction_tier", s("title", "summary").alias("metadata")).alias("classification"),
            s("impact_summary", "critical_dates", "reg_references", "impacted_business", "impacted_functions",
              "penalties_consequences", "tags", "entities").alias("metadata"),
            s(F.col("pub_date").alias("date"), F.col("pub_date_valid").alias("valid")).alias("reconciled_published_date"),
        )).alias("output_data"))
    rows = records(spark, folder, "summary", "country", "bloc", "tag_2", "requirements")
    path = fresh_path(spark, "annotations")
    rows.select(nested.alias("r")).select("r.*").write.option("maxRecordsPerFile", 200_000).json(path, compression="gzip")
    return annotations.read_jsonl(spark, path)


@query("flatten_record", oracle("""
    SELECT record_id AS artifact_id, topic_id, CASE WHEN requirements > 0 THEN update_type END AS update_type,
           CASE WHEN requirements > 0 THEN regulator_name END AS regulator_name,
           CASE WHEN requirements > 0 THEN country END AS jurisdiction_country, CASE WHEN requirements > 0 THEN impact END AS impact_score,
           CASE WHEN requirements > 0 THEN pub_date END AS reconciled_published_date FROM records WHERE seq % 29 <> 0""", "records"))
def flatten_record(spark, folder):
    return annotations.flatten(raw_annotations(spark, folder)).select(
        "artifact_id", "topic_id", "update_type", "regulator_name", "jurisdiction_country", "impact_score",
        "reconciled_published_date")


@query("flatten_artifact", oracle(f"""
    SELECT CASE WHEN seq % 29 <> 0 THEN record_id END AS record_id, n_name AS topic_name, jurisdiction_code AS topic_jurisdiction_code,
           title, link, update_type, coalesce(regulator_name, '') AS regulator_name, pub_date, urgency
    FROM records JOIN nation ON CAST(n_nationkey AS VARCHAR) = topic_id WHERE tag_2 <> 'Antitrust' AND requirements > 0""", "records"))
def flatten_artifact(spark, folder):
    topics = table(spark, folder, "nation").selectExpr(
        "CAST(n_nationkey AS STRING) AS topic_id", "n_name AS name", f"{_CODE} AS jurisdiction_code")
    return annotations.flatten_artifacts(raw_annotations(spark, folder), topics).select(
        "record_id", "topic_name", "topic_jurisdiction_code", "title", "link", "update_type", "regulator_name", "pub_date",
        F.col("scores.urgency.score").alias("urgency"))


def reports(spark, folder):
    """Events read as device reports of three sources."""
    raw = table(spark, folder, "events").select(
        (F.col("user_id") % 3).alias("part"), F.col("event_id").alias("native_id"),
        F.expr(RAW_SEVERITY).alias("raw_severity"), (F.col("value") > 20).alias("recall"), F.col("event_type").alias("device"),
        F.date_format("ts", "yyyyMMdd").alias("packed"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("iso"),
        F.date_format("ts", "d MMMM yyyy").alias("spelled"))
    shapes = [("US", "FDA_MAUDE", "packed"), ("UK", "MHRA", "iso"), ("CH", "Swissmedic", "spelled")]
    return devices.union(*[
        devices.normalise(raw.filter(F.col("part") == i).withColumn("day_text", F.col(day)), country, source)
        for i, (country, source, day) in enumerate(shapes)])


define("reports", """SELECT ['US', 'UK', 'CH'][user_id % 3 + 1] || '-' || event_id AS id, strftime(ts, '%Y-%m-%d') AS day,
    ['FDA_MAUDE', 'MHRA', 'Swissmedic'][user_id % 3 + 1] AS source, value > 20 AS is_recall,
    CASE event_type WHEN 'error' THEN 'malfunction' WHEN 'purchase' THEN 'death' WHEN 'view' THEN 'serious'
         WHEN 'click' THEN 'near-miss' ELSE 'unknown' END AS severity FROM events""")


@query("source_union", oracle("SELECT id, day, source, severity, is_recall FROM reports", "reports"))
def source_union(spark, folder):
    return reports(spark, folder).select("id", "day", "source", "severity", "is_recall")


@query("device_events", oracle("SELECT id, day, source, severity, is_recall FROM reports", "reports"))
def device_events(spark, folder):
    """The reports of all three sources written as JSON arrays, one per file, and read back by one array scan."""
    mine = reports(spark, folder).select("id", "day", "source", "severity", "is_recall")
    path = fresh_path(spark, "arrays")

    def arrays(batches):
        # One array per Arrow batch, whose size Spark bounds.
        for batch in batches:
            yield pd.DataFrame({"value": [batch.to_json(orient="records")]})

    mine.mapInPandas(arrays, "value STRING").write.option("maxRecordsPerFile", 1).text(path)
    return annotations.read_json_array(spark, path, "id STRING, day STRING, source STRING, severity STRING, is_recall BOOLEAN")


@query("event_summary", oracle("""
    SELECT coalesce(source, 'all') AS source, coalesce(severity, 'all') AS severity, count(*) AS n, count(*) FILTER (is_recall) AS recalls,
           count(*) FILTER (severity = 'death') AS deaths, min(day) AS first_day, max(day) AS last_day
    FROM reports GROUP BY CUBE (source, severity)""", "reports"))
def event_summary(spark, folder):
    return devices.summary(reports(spark, folder))


@query("flag_stats", """
    SELECT flag, count(*) AS n FROM (
      SELECT 'systematic_review' AS flag FROM orders WHERE o_orderstatus = 'F' UNION ALL
      SELECT 'meta_analysis' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
      SELECT 'rct' FROM orders WHERE o_orderpriority = '2-HIGH') GROUP BY flag""")
def flag_stats(spark, folder):
    flags = F.array_compact(F.array(
        F.when(F.col("o_orderstatus") == "F", "systematic_review"), F.when(F.col("o_orderpriority") == "1-URGENT", "meta_analysis"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "rct"), F.when(F.col("o_orderstatus") == "O", "letter")))
    articles = table(spark, folder, "orders").select(flags.alias("flags"))
    return devices.flag_stats(articles, ["systematic_review", "meta_analysis", "rct", "clinical_trial"])


@query("latest_snapshot", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS snapshot FROM events
    WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events)""")
def latest_snapshot(spark, folder):
    """Events written as daily snapshot folders, of which only the newest is read."""
    daily = table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("snapshot"))
    version = tables.write_documents(daily, fresh_path(spark, "snapshots"), "snapshot")
    return tables.read_latest(spark, version, "event_id BIGINT").select("event_id", F.col("snapshot").cast("string").alias("snapshot"))


@query("alias_dim", """
    SELECT n_name AS canonical_name, unnest([n_name, 'Agency of ' || n_name, 'N' || n_nationkey]) AS name FROM nation""")
def alias_dim(spark, folder):
    """Seeds written as one JSON array per region and read back."""
    path = fresh_path(spark, "seeds")
    seeds = table(spark, folder, "nation").select("n_regionkey", F.struct(F.col("n_name").alias("canonical_name"), F.array(
        F.concat(F.lit("Agency of "), "n_name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("aliases")).alias("seed"))
    arrays = seeds.groupBy("n_regionkey").agg(F.to_json(F.collect_list("seed")).alias("value"))
    arrays.repartition("n_regionkey").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return tables.aliases(tables.read_seeds(spark, path, "canonical_name STRING, aliases ARRAY<STRING>"))


@query("market_union", """
    SELECT c_name AS external_id, 'Will ' || c_name || ' rise?' AS title, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE')
           THEN 'resolved' ELSE 'active' END AS status, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS entities, 'east' AS platform
    FROM customer UNION ALL
    SELECT CAST(s_suppkey AS VARCHAR), s_name, CASE WHEN s_acctbal < 0 THEN 'resolved' ELSE 'active' END, '', 'west' FROM supplier""")
def market_union(spark, folder):
    none = F.lit(None).cast("string")
    status = (F.when(F.col("c_mktsegment") == "BUILDING", "settled").when(F.col("c_mktsegment") == "FURNITURE", "closed")
              .when(F.col("c_mktsegment") == "MACHINERY", "open").otherwise("paused"))
    east = table(spark, folder, "customer").select(
        F.col("c_name").alias("ticker"), F.concat(F.lit("Will "), "c_name", F.lit(" rise?")).alias("title"), none.alias("subtitle"),
        none.alias("rules_primary"), none.alias("open_time"), none.alias("close_time"), status.alias("status"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("settlement_source"))
    west = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("question"), none.alias("description"), none.alias("start_date"),
        none.alias("end_date"), (F.col("s_acctbal") < 0).alias("closed"))
    both = tables.listings_east(east).unionByName(tables.listings_west(west))
    return both.select("external_id", "title", "status", F.array_join("entities", ",").alias("entities"), "platform")


def prices(spark, folder):
    """Views and purchases read as price candles; purchases carry the close, views the dollar form."""
    whole = F.when(F.col("event_type") == "purchase", F.floor(F.col("value") / 40) / 2.0)
    candles = table(spark, folder, "events").filter(F.col("event_type").isin("view", "purchase")).select(
        F.concat(F.lit("C"), (F.col("user_id") % 25).cast("string")).alias("contract_id"), "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        tables.candle_price(whole, F.when(F.col("value") > 2, F.col("value") / 1000)).alias("p"))
    return candles.filter("p IS NOT NULL")


define("prices", """SELECT contract_id, event_id, ts, CASE WHEN c <> 0 THEN c ELSE d END AS p FROM (
    SELECT 'C' || (user_id % 25) AS contract_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
           CASE WHEN event_type = 'purchase' THEN floor(value / 40) / 2.0 END AS c, CASE WHEN value > 2 THEN value / 1000 END AS d
    FROM events WHERE event_type IN ('view', 'purchase')) WHERE (CASE WHEN c <> 0 THEN c ELSE d END) IS NOT NULL""")


@query("price_series", oracle("SELECT contract_id, event_id, ts, round(p, 5) AS p FROM prices", "prices"))
def price_series(spark, folder):
    return prices(spark, folder).withColumn("p", F.round("p", 5))


@query("contract_prices", oracle("""
    SELECT contract_id, count(p) AS points, CAST(coalesce(max(ts), 0) AS BIGINT) AS last_ts FROM contracts LEFT JOIN prices USING (contract_id)
    GROUP BY contract_id""", "contracts", "prices"))
def contract_prices(spark, folder):
    """Length and end of each contract's price series; a contract without prices keeps an empty one."""
    per = prices(spark, folder).groupBy("contract_id").agg(F.count("*").alias("points"), F.max("ts").alias("last_ts"))
    return contracts(spark, folder).select("contract_id").join(per, "contract_id", "left").fillna(0)


@query("latest_price", oracle("""
    SELECT contract_id, coalesce(yes, 50) AS yes_cents, 100 - coalesce(yes, 50) AS no_cents FROM contracts LEFT JOIN (
      SELECT contract_id, CAST(round_even(arg_max(p, (ts, p)) * 100, 0) AS INT) AS yes FROM prices GROUP BY contract_id) USING (contract_id)
    """, "contracts", "prices"))
def latest_price(spark, folder):
    return tables.latest_price(contracts(spark, folder), prices(spark, folder))


@query("insert_if_absent", """
    SELECT doc_id, 'kept' AS origin, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL
    SELECT doc_id, 'new', text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_if_absent(spark, folder):
    """Labelled documents are cached; all documents arrive, some twice."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("origin", F.lit("kept"))
    again = docs.filter(F.length("text") < 500)
    arrived = docs.unionByName(again).withColumn("origin", F.lit("new"))
    return tables.insert_if_absent(kept, arrived, "doc_id", [F.col("text")])


@query("load_manifest", oracle("""
    SELECT count(*) AS attempted, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
           CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS artifacts
    FROM (SELECT topic_id, count(*) AS n, count(*) FILTER (urgency = 10) < 60 AS ok FROM records GROUP BY topic_id)""", "records"))
def load_manifest(spark, folder):
    """Load log per topic; a topic with 60 or more records of top urgency counts as failed."""
    log = records(spark, folder).groupBy("topic_id").agg(
        F.count("*").alias("artifacts"), (F.count_if(F.col("scores.urgency.score") == 10) < 60).alias("ok"))
    return tables.manifest(log)


@query("sink_partitioned", oracle("SELECT contract_id, record_id, urgency FROM scans", "scans"))
def sink_partitioned(spark, folder):
    """Scan matches written as one folder per contract, then read back."""
    rows = matching.scan_matches(contracts(spark, folder), records(spark, folder), AS_OF).select("contract_id", "record_id", "urgency")
    path = fresh_path(spark, "documents")
    tables.write_documents(rows, path, "contract_id")
    return tables.read_documents(spark, path, "record_id STRING, urgency DOUBLE, contract_id STRING")


@query("stale_outputs", """
    SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)""")
def stale_outputs(spark, folder):
    """Users with output but no large purchase."""
    events = table(spark, folder, "events")
    expected = events.filter("event_type = 'purchase' AND value > 60").select("user_id")
    return events.select("user_id").distinct().join(expected, "user_id", "left_anti")


@query("topic_enrich", oracle(f"""
    SELECT record_id, CASE WHEN n_regionkey <> 2 THEN n_name || ' desk' ELSE n_name END AS topic_label, jurisdiction_code
    FROM records JOIN nation ON CAST(n_nationkey AS VARCHAR) = topic_id""", "records"))
def topic_enrich(spark, folder):
    nation = table(spark, folder, "nation")
    known = nation.selectExpr("CAST(n_nationkey AS STRING) AS topic_id", "n_name AS name", f"{_CODE} AS jurisdiction_code")
    catalog = nation.filter("n_regionkey <> 2").selectExpr("CAST(n_nationkey AS STRING) AS topic_id", "concat(n_name, ' desk') AS name")
    return joins.enrich_topics(records(spark, folder).select("record_id", "topic_id"), catalog, known) \
                .select("record_id", "topic_label", "jurisdiction_code")


@query("entry_annotation_join", """
    SELECT o_orderkey, coalesce(a.l_returnflag, '') AS flag, CAST(coalesce(a.l_partkey, -1) AS BIGINT) AS part FROM orders LEFT JOIN (
      SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC, l_linenumber DESC, l_returnflag DESC, l_partkey DESC) = 1) a ON l_orderkey = o_orderkey""")
def entry_annotation_join(spark, folder):
    notes = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = joins.annotate_entries(table(spark, folder, "orders").select("o_orderkey"), notes, "o_orderkey",
                                   ["l_shipdate", "l_linenumber"], ["l_returnflag", "l_partkey"])
    return found.select("o_orderkey", F.coalesce("l_returnflag", F.lit("")).alias("flag"), F.coalesce("l_partkey", F.lit(-1)).alias("part"))


@query("link_sidecar", "SELECT o_orderkey, coalesce(url, '') AS link FROM orders LEFT JOIN pages ON page_id = o_orderkey")
def link_sidecar(spark, folder):
    sidecar = table(spark, folder, "pages").select(F.col("page_id").alias("o_orderkey"), "url")
    return table(spark, folder, "orders").select("o_orderkey").join(sidecar, "o_orderkey", "left") \
        .select("o_orderkey", F.coalesce("url", F.lit("")).alias("link"))


def cascades(spark, folder):
    """One cascade per region; its nations' codes are the members (at most the 25 nations)."""
    nation = table(spark, folder, "nation").selectExpr("n_regionkey", "n_nationkey", f"{_CODE} AS code")
    members = nation.filter("code <> ''").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("code")).alias("members"))
    hits = F.when(F.col("r_regionkey") == 4, F.lit("unknown")).otherwise(
        F.format_string("%d/%d (%d%%)", F.col("r_regionkey") + 3, F.lit(9), (F.col("r_regionkey") + 3) * 11))
    return table(spark, folder, "region").join(members, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("r_name").alias("cascade_id"), "members", hits.alias("hit_text"), (F.col("r_regionkey") * 30 + 60).alias("follow_days"),
        F.date_sub(F.lit(AS_OF).cast("date"), F.col("r_regionkey") * 10).cast("string").alias("trigger_date"))


def footprint(spark, folder):
    """Roles of codes; a code may be in several lists."""
    codes = table(spark, folder, "nation").selectExpr("n_nationkey", f"{_CODE} AS code").filter("code <> ''")
    lists = F.array_compact(F.array(
        F.when(F.col("n_nationkey") < 12, "operating"), F.when(F.col("n_nationkey").between(8, 16), "considering"),
        F.when(F.col("n_nationkey").between(14, 18), "closed")))
    return codes.select("code", F.explode(lists).alias("role"))


@query("cascade_parse", f"""
    SELECT r_name AS cascade_id, CASE WHEN r_regionkey = 4 THEN 0 ELSE r_regionkey + 3 END AS adopted,
           CASE WHEN r_regionkey = 4 THEN 0 ELSE 9 END AS total, CASE WHEN r_regionkey = 4 THEN 0 ELSE (r_regionkey + 3) * 11 END AS percent,
           CAST({TODAY} - r_regionkey * 10 + r_regionkey * 30 + 60 AS VARCHAR) AS due FROM region""")
def cascade_parse(spark, folder):
    return joins.cascade_terms(cascades(spark, folder)).select("cascade_id", "adopted", "total", "percent", "due")


define("members", f"""SELECT r_name AS cascade_id, {_CODE} AS code, CASE WHEN n_nationkey BETWEEN 14 AND 18 THEN 'closed'
    WHEN n_nationkey BETWEEN 8 AND 16 THEN 'considering' WHEN n_nationkey < 12 THEN 'operating' ELSE 'other' END AS role
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24""")


@query("cascade_cards", oracle("""
    SELECT cascade_id, count(*) AS members, count(*) FILTER (role IN ('operating', 'considering')) AS overlap,
           count(*) FILTER (role = 'closed') AS closed FROM members GROUP BY cascade_id""", "members"))
def cascade_cards(spark, folder):
    rows = joins.cascade_members(cascades(spark, folder), footprint(spark, folder))
    return rows.groupBy("cascade_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("role").isin("operating", "considering")).alias("overlap"),
        F.count_if(F.col("role") == "closed").alias("closed"))


@query("cascade_roles", oracle("SELECT cascade_id, code, role FROM members", "members"))
def cascade_roles(spark, folder):
    return joins.cascade_members(cascades(spark, folder), footprint(spark, folder)).select("cascade_id", "code", "role")


@query("featured_join", oracle("""
    SELECT 'C' || (s_nationkey + 5) AS contract_id, CAST(min(s_suppkey) AS BIGINT) AS pos, s_nationkey + 5 < 25 AS found
    FROM supplier GROUP BY s_nationkey"""))
def featured_join(spark, folder):
    """Contracts featured in the order of the suppliers; some ids have no contract."""
    key = F.concat(F.lit("C"), (F.col("s_nationkey") + 5).cast("string"))
    ids = table(spark, folder, "supplier").groupBy(key.alias("contract_id")).agg(F.min("s_suppkey").alias("pos"))
    return joins.featured(ids, contracts(spark, folder), "contract_id").select("contract_id", "pos", "found")


@query("curated_order", oracle("""
    SELECT contract_id, CAST(coalesce(pos, -1) AS BIGINT) AS pos
    FROM contracts LEFT JOIN (SELECT 'C' || (s_nationkey + 5) AS contract_id, min(s_suppkey) AS pos FROM supplier
                              GROUP BY 1) USING (contract_id) ORDER BY pos = -1, pos, contract_id""", "contracts"))
def curated_order(spark, folder):
    """Contracts in the order of the suppliers first, then the rest by id. The key leaves some contracts without a supplier."""
    order = table(spark, folder, "supplier").groupBy(
        F.concat(F.lit("C"), (F.col("s_nationkey") + 5).cast("string")).alias("contract_id")).agg(F.min("s_suppkey").alias("pos"))
    rows = joins.curated_order(contracts(spark, folder).select("contract_id"), order, "contract_id")
    return rows.withColumn("pos", F.coalesce("pos", F.lit(-1)))


@query("curated_semi", """
    SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 30)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def curated_semi(spark, folder):
    """The first event of each user on the list of large errors."""
    events = table(spark, folder, "events")
    ids = events.filter("event_type = 'error' AND value > 30").select("user_id")
    return joins.curated(events.select("user_id", "event_id"), ids, "user_id", [F.col("event_id")])


@query("rehydrate", """
    SELECT p_partkey + 50 AS p_partkey, l_orderkey, l_quantity FROM part JOIN lineitem ON l_partkey = p_partkey + 50
    QUALIFY row_number() OVER (PARTITION BY part.p_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_quantity DESC) = 1""")
def rehydrate(spark, folder):
    """All parts with their last line. The key leaves some parts without a line, which are dropped."""
    parts = table(spark, folder, "part").select((F.col("p_partkey") + 50).alias("p_partkey"))
    corpus = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return joins.rehydrate(parts, corpus, "p_partkey", ["l_shipdate"], ["l_orderkey", "l_quantity"])


@query("exclude_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_ids(spark, folder):
    used = table(spark, folder, "labels").select("doc_id")
    return table(spark, folder, "documents").select("doc_id").join(used, "doc_id", "left_anti")


@query("citation_check", """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unchecked' WHEN quality = 1 AND source <> 'src0' THEN 'ok' ELSE 'mismatch' END AS outcome
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def citation_check(spark, folder):
    address = F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))
    published = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("source") == "src0", "https://example.com/none").otherwise(address).alias("url"))
    known = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.array(address, F.lit("https://example.org/"))).otherwise(
            F.array(F.lit("https://example.org/"))).alias("resolving"))
    return joins.citation_check(published, known, "doc_id")


@query("refresh_merge", """
    SELECT c_custkey, coalesce(p, c_acctbal) AS c_acctbal, p IS NULL AS stale FROM customer LEFT JOIN (
      SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS p FROM orders WHERE o_orderdate >= DATE '2001-01-01'
      GROUP BY o_custkey) ON o_custkey = c_custkey""")
def refresh_merge(spark, folder):
    """Balances replaced by the last price of the year; customers without an order keep theirs."""
    fresh = table(spark, folder, "orders").filter(F.col("o_orderdate") >= "2001-01-01").groupBy(
        F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_totalprice")).alias("c_acctbal"))
    return tables.refresh(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), fresh, "c_custkey", ["c_acctbal"])


@query("ticket_counts", oracle("""
    SELECT c.contract_id, count(s_suppkey) AS tickets FROM contracts c
    LEFT JOIN supplier ON 'C' || (s_nationkey + 5) = c.contract_id GROUP BY c.contract_id""", "contracts"))
def ticket_counts(spark, folder):
    """Suppliers as tickets. The key leaves some contracts without a ticket, and some tickets without a contract."""
    tickets = table(spark, folder, "supplier").select(F.concat(F.lit("C"), (F.col("s_nationkey") + 5).cast("string")).alias("contract_id"))
    return joins.counted(contracts(spark, folder).select("contract_id"), tickets, "contract_id", "tickets")


_PREFILTER_SQL = """
    SELECT s_suppkey FROM supplier WHERE EXISTS (
      SELECT 1 FROM (SELECT DISTINCT right(c_name, 3) AS name FROM customer) WHERE contains(lower(s_name), lower(name)))"""


@query("topic_prefilter_all", _PREFILTER_SQL)
@query("topic_prefilter", _PREFILTER_SQL)
def topic_prefilter(spark, folder):
    """Suppliers whose name contains the last three digits of any customer's name."""
    names = table(spark, folder, "customer").select(F.expr("right(c_name, 3)").alias("name"))
    topics = table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("topic_name"))
    return joins.topic_prefilter(topics, names).select("s_suppkey")


@query("dedupe_first", oracle("""
    SELECT title, record_id FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY seq) AS rn FROM candidates)
    WHERE rn = 1 AND NOT contains(failed, 'update_type') AND NOT contains(failed, 'key_requirements')""", "candidates"))
def dedupe_first(spark, folder):
    passes = ~F.array_contains("failed", "update_type") & ~F.array_contains("failed", "key_requirements")
    return joins.dedupe_then_filter(candidates(spark, folder), "title", passes).select("title", "record_id")


@query("dedupe_two_keys", oracle("""
    SELECT record_id FROM (
      SELECT *, row_number() OVER (PARTITION BY link2 ORDER BY seq) AS r2 FROM (
        SELECT *, row_number() OVER (PARTITION BY title ORDER BY seq) AS r1, industry || pub_date AS link2 FROM records
        WHERE tag_1 <> 'Merchandise' AND tag_2 <> 'Antitrust' AND update_type IN ('enforcement', 'final rule', 'proposed rule')
          AND (tag_1 IN ('Artificial Intelligence', 'Fair Lending', 'Machine Learning') OR tag_2 IN ('Data Breach', 'Privacy')))
      WHERE r1 = 1) WHERE r2 = 1 ORDER BY pub_date DESC, seq LIMIT 12""", "records"))
def dedupe_two_keys(spark, folder):
    signals = feed(spark, folder).filter(
        keywords.tags_pass(F.col("tags")) & F.col("update_type").isin("enforcement", "final rule", "proposed rule"))
    signals = signals.withColumn("link2", F.concat("industry", "pub_date"))
    return joins.dedupe_two_keys(signals, "title", "link2", 12).select("record_id")

