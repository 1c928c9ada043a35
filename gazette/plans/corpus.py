"""Corpus queries: filters, statistics, rankings, structured questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import dates, keywords, scores, urls
from gazette.operators import audit, ranking, spread
from gazette.plans.fields import feed, shortlist_rows
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, define, oracle, records
from gazette.session import fresh_path, table
from gazette.sources import tables

TODAY = f"DATE '{AS_OF}'"


@query("substantive", oracle("SELECT record_id FROM recs WHERE substantive", "recs"))
def substantive(spark, folder):
    return records(spark, folder).filter(scores.is_substantive()).select("record_id")


@query("substantive_timeline", oracle("""
    SELECT record_id FROM recs WHERE update_type <> 'other' AND relevance >= 3 AND title <> '' AND link <> ''""", "recs"))
def substantive_timeline(spark, folder):
    return records(spark, folder).filter(scores.is_substantive(vocab.TIMELINE_MIN_RELEVANCE)).select("record_id")


@query("inbox_eligible", oracle("SELECT record_id FROM recs WHERE substantive AND age BETWEEN 0 AND 90", "recs"))
def inbox_eligible(spark, folder):
    return records(spark, folder).filter(scores.is_substantive() & dates.within_age(AS_OF, 90)).select("record_id")


EARLIEST, LATEST = "1997-03-01", "2001-03-31"
define("candidates", f"""
    SELECT *, concat_ws(',',
        CASE WHEN NOT (pub_date_valid AND CAST(pub_date AS DATE) BETWEEN DATE '{EARLIEST}' AND DATE '{LATEST}')
             THEN 'reconciled_published_date' END,
        CASE WHEN update_type NOT IN ('enforcement', 'final rule', 'proposed rule') THEN 'update_type' END,
        CASE WHEN impact < 8 THEN 'impact_label' END,
        CASE WHEN trim(requirement) = '' OR requirements = 0 THEN 'key_requirements' END,
        CASE WHEN reference = 'No reference' THEN 'reg_reference_url' END) AS failed FROM recs""", "recs")


def candidates(spark, folder):
    """Records with the names of the candidate tests they fail."""
    found = F.flatten(F.transform(F.col("reg_references.rules"), urls.extract_urls))
    failed = keywords.candidate_failures(
        EARLIEST, LATEST, dates.iso_day(F.col("pub_date")), F.col("pub_date_valid"), F.col("update_type"),
        F.col("scores.impact.label"), F.col("impact_summary.key_requirements"), found)
    return feed(spark, folder).withColumn("failed", failed)


@query("candidate_reasons", oracle("SELECT record_id, failed FROM candidates", "candidates"))
def candidate_reasons(spark, folder):
    return candidates(spark, folder).select("record_id", F.array_join("failed", ",").alias("failed"))


@query("scenario_eligible", oracle("""
    SELECT record_id, (country IN ('FR', 'DE', 'MT') OR bloc = 'EU') AND (country <> '' OR bloc <> '')
           AND (tag_1 IN ('Artificial Intelligence', 'Machine Learning') OR tag_2 = 'Retail AI') AS eligible_a,
           (country <> '' OR bloc <> '') AND tag_1 = 'Securities' AND tag_2 = 'Marketing' AS eligible_b FROM records""", "records"))
def scenario_eligible(spark, folder):
    at = lambda s: keywords.scenario_eligible(s, F.col("country"), F.col("bloc"), F.col("tags"))
    return feed(spark, folder).select("record_id", at("A").alias("eligible_a"), at("B").alias("eligible_b"))


@query("allowlist_or", oracle("""
    SELECT record_id FROM records WHERE tag_1 = 'Securities' OR regulator_name IN ('Agency of NATION_3', 'Agency of NATION_8')
           OR entity_2 = 'ASIA' OR entity_1 = 'BUILDING'""", "records"))
def allowlist_or(spark, folder):
    """Records of listed business types, regulators or entities; the lists are short seeds."""
    holds = (
        F.arrays_overlap("impacted_business.type", F.array(F.lit("Securities"), *map(F.lit, vocab.MARKET_BUSINESS_TYPES)))
        | F.coalesce(F.col("regulator_name").isin("Agency of NATION_3", "Agency of NATION_8"), F.lit(False))
        | F.arrays_overlap("entities", F.array(F.lit("ASIA"), F.lit("BUILDING"))))
    return records(spark, folder).filter(holds).select("record_id")


@query("topic_classify", """
    SELECT s_suppkey, CASE
      WHEN s_nationkey = 0 THEN 'entity_type,name,phrase' WHEN s_nationkey = 1 THEN 'acronym'
      WHEN s_nationkey = 2 THEN 'rejected_by_negative' WHEN s_nationkey = 3 THEN 'phrase'
      WHEN s_nationkey = 4 THEN 'entity_type' ELSE '' END AS reasons,
      s_nationkey IN (0, 1, 3, 4) AS relevant FROM supplier""")
def topic_classify(spark, folder):
    """Suppliers read as topics whose names depend on the nation."""
    pick = lambda values, default: F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("s_nationkey")), F.lit(default))
    name = pick({0: "Nevada Gaming Commission", 1: "Commission One", 2: "Tobacco and Lottery Board", 3: "State Desk",
                 4: "Energy Office"}, "Harbour Office")
    reasons = keywords.topic_reasons(
        name, pick({1: "CFTC"}, ""), pick({0: "Gaming Regulator", 4: "Commodity Regulators"}, ""),
        pick({2: "lottery rules", 3: "rules on sports betting"}, ""))
    return table(spark, folder, "supplier").select("s_suppkey", F.array_join(reasons, ",").alias("reasons"),
                                                   keywords.topic_relevant(reasons).alias("relevant"))


@query("tag_veto", oracle("""
    SELECT record_id FROM records WHERE tag_1 <> 'Merchandise' AND tag_2 <> 'Antitrust'
      AND (tag_1 IN ('Artificial Intelligence', 'Fair Lending', 'Machine Learning') OR tag_2 IN ('Data Breach', 'Privacy'))""", "records"))
def tag_veto(spark, folder):
    return records(spark, folder).filter(keywords.tags_pass(F.col("tags"))).select("record_id")


@query("recent_window", oracle(f"""
    SELECT record_id, age BETWEEN 0 AND 30 AS last_30,
           coalesce(CAST(nullif(effective_date, '') AS DATE), CAST(nullif(comment_deadline, '') AS DATE)) >= {TODAY} - 365
           OR (effective_date = '' AND comment_deadline = '') AS in_window
    FROM (SELECT * REPLACE (coalesce(age, -1) AS age) FROM recs)""", "recs"))
def recent_window(spark, folder):
    """In the last 30 days by publication; in the last year by the first date that parses, undated rows kept."""
    d = F.col("critical_dates")
    first = F.coalesce(dates.iso_day(d["effective_date"]), dates.iso_day(d["comment_deadline"]))
    return records(spark, folder).select(
        "record_id", F.coalesce(dates.within_age(AS_OF, 30), F.lit(False)).alias("last_30"),
        F.coalesce(first >= F.date_sub(F.lit(AS_OF).cast("date"), 365), F.lit(True)).alias("in_window"))


@query("usable_date", oracle("SELECT record_id, pub_date BETWEEN '2000-01-01' AND '2001-07-01' AS usable FROM records", "records"))
def usable_date(spark, folder):
    return records(spark, folder).select("record_id", dates.usable(F.col("pub_date"), "2001-07-01").alias("usable"))


@query("domain_select", oracle("""
    SELECT record_id, lower(coalesce(regulator_name, '')) IN ('agency of nation_1', 'agency of nation_6') AS by_regulator,
           lower(industry) IN ('building', 'furniture') AS by_industry FROM records""", "records"))
def domain_select(spark, folder):
    wanted = F.array(F.lit("building"), F.lit("furniture"))
    by_regulator = F.lower(F.coalesce("regulator_name", F.lit(""))).isin("agency of nation_1", "agency of nation_6")
    return records(spark, folder).select(
        "record_id", by_regulator.alias("by_regulator"),
        F.arrays_overlap(keywords.lowered(F.col("impacted_business.industry")), wanted).alias("by_industry"))


@query("scan_quality_counts", oracle(f"""
    SELECT count(*) AS read, count(*) FILTER (day <= {TODAY}) AS valid, count(*) FILTER (day IS NULL OR day > {TODAY}) AS skipped
    FROM recs""", "recs"))
def scan_quality_counts(spark, folder):
    return audit.quality_counts(records(spark, folder), AS_OF)


@query("headline_stats", oracle(f"""
    SELECT count(*) AS events, count(DISTINCT topic_name) AS topics,
           count(DISTINCT CASE WHEN regexp_matches(jurisdiction_code, '^([A-Z]{{2}}|[A-Z]{{2}}-[A-Z0-9]{{1,3}})$')
                               THEN jurisdiction_code END) AS codes,
           CAST(min(CASE WHEN day BETWEEN DATE '1996-01-01' AND {TODAY} THEN day END) AS VARCHAR) AS first_day,
           CAST(max(CASE WHEN day BETWEEN DATE '1996-01-01' AND {TODAY} THEN day END) AS VARCHAR) AS last_day FROM recs""", "recs"))
def headline_stats(spark, folder):
    return audit.headline(records(spark, folder), AS_OF, "1996-01-01")


# Annotations with more fields than the records, each of them filled in some rows only, and rows without any metadata.
_WIDE = {
    "bare": "seq % 11 = 0", "feed_entry_id": "CASE WHEN seq % 7 = 0 THEN '' ELSE record_id END",
    "topic_acronym": "CASE WHEN n1 THEN 'N1' ELSE ' ' END", "topic_scope": "CASE WHEN country = '' THEN NULL ELSE tier_label END",
    "feed_id": "CASE WHEN urgency > 5 THEN topic_id END", "current_published_date": "CASE WHEN pub_date_valid THEN pub_date ELSE '' END",
    "update_subtype": "CASE WHEN relevance >= 5 THEN update_type END", "regulator_other": "regulator_division",
    "classification_base_url": "CASE WHEN seq % 2 = 0 THEN link END",
    "classification_summary": "CASE WHEN why_it_matters = '' THEN ' ' ELSE summary END",
    "pub_date_content": "CASE WHEN seq % 4 = 0 THEN pub_date ELSE '' END", "objective": "CASE WHEN impact > 3 THEN what_changed END",
    "risk_impact": "CASE WHEN impact > 7 THEN why_it_matters END", "early": "CASE WHEN seq % 13 = 0 THEN pub_date ELSE ' ' END",
    "acts": "seq % 3 = 0", "statute": "seq % 5 = 0", "ruled": "seq % 3 <> 1", "fined": "seq % 6 <> 0", "tagged": "seq % 9 <> 0",
    "functional": "seq % 8 <> 0", "named": "seq % 10 <> 0"}
define("wide", "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _WIDE.items())
       + " FROM (SELECT *, topic_name LIKE '%1%' AS n1 FROM records)", "records")


def wide(spark, folder):
    from_view = ("impact", "relevance", "urgency", "country", "tier_label", "why_it_matters", "what_changed", "summary", "reference", "requirement")
    rows = records(spark, folder, *from_view).withColumn("n1", F.expr("topic_name LIKE '%1%'"))
    rows = rows.withColumns({n: F.expr(e) for n, e in _WIDE.items()})
    kept = lambda c: F.when(~F.col("bare"), c)
    some = lambda flag, *items: F.when(F.col(flag), F.array(*items)).otherwise(F.array().cast("array<string>"))
    inside = lambda c, **more: kept(F.struct(f"{c}.*", *[v.alias(k) for k, v in more.items()]))
    return rows.withColumns({
        "critical_dates": inside("critical_dates", pub_date_content=F.col("pub_date_content"), early_adoption_date=F.col("early")),
        "impact_summary": inside("impact_summary", objective=F.col("objective"), risk_impact=F.col("risk_impact")),
        "reg_references": kept(F.struct(some("ruled", "reference", F.lit(" "), F.lit("")).alias("rules"),
                                        some("statute", "summary").alias("statutes"), some("acts", F.lit("")).alias("other_ref"))),
        "impacted_business": kept(F.col("impacted_business")), "penalties_consequences": kept(some("fined", "summary", F.lit(" "))),
        "tags": kept(F.when(F.col("tagged"), F.col("tags")).otherwise(F.array().cast("array<string>"))),
        "impacted_functions": kept(F.when(F.col("functional"), F.col("impacted_functions")).otherwise(F.array().cast("array<string>"))),
        "entities": F.when(F.col("named"), F.col("entities")), "actionables": some("acts", "requirement")})


@query("corpus_stats", oracle("""
    SELECT count(*) AS records, count(*) FILTER (NOT bare) AS with_metadata,
           CAST(sum(requirements) FILTER (NOT bare) AS BIGINT) AS obligations, count(*) FILTER (requirements > 0 AND NOT bare) AS with_obligations,
           2 * count(*) FILTER (ruled AND NOT bare) + count(*) FILTER (statute AND NOT bare) AS reg_refs,
           count(*) FILTER ((ruled OR statute) AND NOT bare) AS with_refs,
           count(*) FILTER (NOT bare AND (effective_date <> '' OR compliance_date <> '' OR comment_deadline <> '' OR trim(early) <> '')) AS with_dates,
           count(*) FILTER (fined AND NOT bare) AS with_penalties,
           count(*) FILTER (fined AND NOT bare AND (contains(summary, 'fined') OR contains(summary, 'cites'))) AS with_amount,
           2 * count(*) FILTER (fined AND NOT bare AND contains(summary, 'fined'))
             + count(*) FILTER (fined AND NOT bare AND contains(summary, 'cites')) AS money_mentions,
           count(*) FILTER (NOT bare AND NOT tagged) AS tags_missing, count(DISTINCT regulator_name) AS regulators,
           count(DISTINCT CASE WHEN impacted_1 <> '' AND NOT bare THEN impacted_1 END) AS jurisdictions
    FROM wide""", "wide"))
def corpus_stats(spark, folder):
    return audit.corpus_stats(wide(spark, folder))


@query("sector_counts", oracle("""
    SELECT CASE WHEN industry <> 'HOUSEHOLD' THEN industry WHEN n_regionkey < 3 THEN 'Sector ' || n_regionkey ELSE 'Uncategorized' END
           AS sector, count(*) AS docs, CAST(sum(requirements) AS BIGINT) AS obligations
    FROM records JOIN nation ON n_nationkey = CAST(topic_id AS INT) GROUP BY 1""", "records"))
def sector_counts(spark, folder):
    """Sectors from a CSV lookup of topics; one industry is blanked so that the lookup is used."""
    path = fresh_path(spark, "sectors")
    table(spark, folder, "nation").filter("n_regionkey < 3").select(
        F.col("n_nationkey").cast("string").alias("topic_id"), F.concat(F.lit("Sector "), "n_regionkey").alias("sector")).write.option("header", True).csv(path)
    sectors = tables.read_lookup(spark, path, "topic_id STRING, sector STRING")
    own = F.when(F.col("industry") != "HOUSEHOLD", F.col("industry")).otherwise("")
    base = feed(spark, folder).withColumn("impacted_business", F.struct(F.array(own).alias("industry")))
    return audit.sector_counts(base, sectors)


@query("freshness", oracle("""
    SELECT CAST(y AS INT) AS year, count(record_id) AS n, round(100.0 * (SELECT count(*) FROM records
           WHERE year(CAST(pub_date AS DATE)) IN (2001, 2002)) / (SELECT count(*) FROM records), 1) AS recent_share
    FROM generate_series(1993, 2002) g(y) LEFT JOIN records ON year(CAST(pub_date AS DATE)) = y GROUP BY y""", "records"))
def freshness(spark, folder):
    return audit.freshness(records(spark, folder), 1993, 2002)


# The audited fields with their kinds, and when the test rows fill them.
_EVERY = {
    "artifact_id": ("string", "record_id <> ''"), "feed_entry_id": ("string", "feed_entry_id <> ''"), "topic_id": ("string", "topic_id <> ''"),
    "topic_name": ("string", "topic_name <> ''"), "topic_acronym": ("string", "trim(topic_acronym) <> ''"),
    "topic_jurisdiction_code": ("string", "jurisdiction_code <> ''"), "topic_scope": ("string", "coalesce(topic_scope, '') <> ''"),
    "title": ("string", "trim(title) <> ''"), "link": ("string", "link <> ''"), "feed_id": ("string", "feed_id IS NOT NULL"),
    "current_published_date": ("string", "current_published_date <> ''"),
    "update_type": ("string", "update_type <> ''"), "update_subtype": ("string", "update_subtype IS NOT NULL"), "jurisdiction_tier": ("struct", "true"),
    "regulator_name": ("string", "coalesce(regulator_name, '') <> ''"), "regulator_division": ("string", "regulator_division <> ''"),
    "regulator_other": ("string", "regulator_other <> ''"), "classification_base_url": ("string", "coalesce(classification_base_url, '') <> ''"),
    "classification_summary": ("string", "trim(classification_summary) <> ''"),
    "pub_date": ("string", "pub_date <> ''"), "pub_date_valid": ("boolean", "pub_date_valid"),
    "impacted_functions": ("array", "functional AND NOT bare"), "penalties_consequences": ("array", "fined AND NOT bare"),
    "tags": ("array", "tagged AND NOT bare"), "entities": ("array", "named"), "actionables": ("array", "acts"),
    "critical_dates.pub_date_content": ("string", "pub_date_content <> '' AND NOT bare"),
    "critical_dates.effective_date": ("string", "effective_date <> '' AND NOT bare"),
    "critical_dates.compliance_date": ("string", "compliance_date <> '' AND NOT bare"),
    "critical_dates.comment_deadline": ("string", "comment_deadline <> '' AND NOT bare"),
    "impact_summary.what_changed": ("string", "what_changed <> '' AND NOT bare"),
    "impact_summary.why_it_matters": ("string", "why_it_matters <> '' AND NOT bare"),
    "impact_summary.key_requirements": ("array", "requirements > 0 AND NOT bare"),
    "impact_summary.objective": ("string", "objective IS NOT NULL AND NOT bare"),
    "impact_summary.risk_impact": ("string", "coalesce(risk_impact, '') <> '' AND NOT bare"),
    "reg_references.rules": ("array", "ruled AND NOT bare"), "reg_references.statutes": ("array", "statute AND NOT bare"),
    "impacted_business.jurisdiction": ("array", "NOT bare"), "impacted_business.type": ("array", "NOT bare"),
    "impacted_business.industry": ("array", "NOT bare"),
    "scores.urgency.score": ("number", "urgency IS NOT NULL"), "scores.impact.score": ("number", "impact IS NOT NULL"),
    "scores.relevance.score": ("number", "relevance IS NOT NULL"), "jurisdiction_tier.label": ("string", "tier_label <> ''"),
    "jurisdiction_tier.tier": ("number", "true")}
_BY_TYPE = ("title", "link", "regulator_name", "impact_summary.what_changed", "scores.urgency.score")


_AUDIT_SQL = oracle(" UNION ALL ".join(
    f"SELECT '{f}' AS field, round(100.0 * avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 1) AS percent FROM wide"
    for f, (_, c) in _EVERY.items()), "wide")


@query("field_audit_all", _AUDIT_SQL)
@query("field_audit", _AUDIT_SQL)
def field_audit(spark, folder):
    rows = wide(spark, folder).withColumnRenamed("record_id", "artifact_id")
    return audit.field_audit(rows, {f: kind for f, (kind, _) in _EVERY.items()})


_BY_TYPE_SQL = oracle(" UNION ALL ".join(
    f"SELECT update_type, '{f}' AS field, count(*) FILTER ({_EVERY[f][1]}) AS filled, count(*) FILTER (NOT ({_EVERY[f][1]}))"
    " AS empty FROM wide GROUP BY update_type" for f in _BY_TYPE), "wide")


@query("field_audit_by_type_all", _BY_TYPE_SQL)
@query("field_audit_by_type", _BY_TYPE_SQL)
def field_audit_by_type(spark, folder):
    return audit.field_audit_by_type(wide(spark, folder), {f: _EVERY[f][0] for f in _BY_TYPE})


@query("corpus_tops", oracle("""
    SELECT dimension, value, n, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS INT) AS rank FROM (
        SELECT 'sector' AS dimension, industry AS value, count(*) AS n FROM records GROUP BY 2 UNION ALL
        SELECT 'topic_sector', 'Sector ' || n_regionkey, count(*) FROM records JOIN nation ON n_nationkey = CAST(topic_id AS INT)
          WHERE n_regionkey < 3 GROUP BY 2 UNION ALL
        SELECT 'jurisdiction', impacted_1, count(*) FROM records WHERE impacted_1 <> '' GROUP BY 2 UNION ALL
        SELECT 'obligations', industry, CAST(sum(requirements) AS BIGINT) FROM records GROUP BY 2 HAVING sum(requirements) > 0))
    WHERE rank <= CASE dimension WHEN 'jurisdiction' THEN 20 ELSE 14 END""", "records"))
def corpus_tops(spark, folder):
    sectors = table(spark, folder, "nation").filter("n_regionkey < 3").select(
        F.col("n_nationkey").cast("string").alias("topic_id"), F.concat(F.lit("Sector "), "n_regionkey").alias("sector"))
    return audit.corpus_tops(records(spark, folder), sectors)


@query("top_breakdown", oracle("""
    SELECT dimension, value, n, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS INT) AS rank FROM (
        SELECT 'topic' AS dimension, topic_name AS value, count(*) AS n FROM records GROUP BY 2 UNION ALL
        SELECT 'regulator', coalesce(regulator_name, 'unknown'), count(*) FROM records GROUP BY 2 UNION ALL
        SELECT 'update_type', update_type, count(*) FROM records GROUP BY 2 UNION ALL
        SELECT 'tier', tier_label, count(*) FROM records GROUP BY 2 UNION ALL
        SELECT 'code', CASE WHEN jurisdiction_code = '' THEN '(empty)' ELSE jurisdiction_code END, count(*) FROM records GROUP BY 2))
    WHERE rank <= CASE dimension WHEN 'topic' THEN 10 WHEN 'regulator' THEN 10 WHEN 'update_type' THEN 15 ELSE 20 END""", "records"))
def top_breakdown(spark, folder):
    named = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))
    return audit.top_breakdown(records(spark, folder), {
        "topic": (F.col("topic_name"), 10), "regulator": (named("regulator_name", "unknown"), 10),
        "update_type": (named("update_type", "(empty)"), 15), "tier": (named("jurisdiction_tier.label", "(empty)"), 20),
        "code": (named("topic_jurisdiction_code", "(empty)"), 20)})


@query("yield_report", oracle("""
    SELECT view, value, count(*) AS n FROM (
      SELECT 'reason' AS view, unnest(string_split(failed, ',')) AS value FROM candidates WHERE failed <> '' UNION ALL
      SELECT 'month', substring(pub_date, 1, 7) FROM candidates WHERE failed = '' UNION ALL
      SELECT 'update_type', update_type FROM candidates WHERE failed = '' UNION ALL
      SELECT 'place', CASE WHEN country <> '' THEN country WHEN bloc <> '' THEN bloc ELSE '?' END FROM candidates WHERE failed = '' UNION ALL
      SELECT 'affordance', 'compliance_date' FROM candidates WHERE failed = '' AND compliance_date <> '' UNION ALL
      SELECT 'affordance', 'effective_date' FROM candidates WHERE failed = '' AND effective_date <> '' UNION ALL
      SELECT 'affordance', 'penalties' FROM candidates WHERE failed = '') GROUP BY ALL""", "candidates"))
def yield_report(spark, folder):
    rows = candidates(spark, folder).withColumn("compliance_date", F.col("critical_dates.compliance_date")) \
                                    .withColumn("effective_date", F.col("critical_dates.effective_date"))
    return audit.yield_report(rows)


def _pool(spark, folder):
    return candidates(spark, folder).filter(F.size("failed") == 0).select(
        "record_id", "regulator_name", "update_type", "topic_id", F.col("impacted_business.industry").alias("industry"),
        F.size("impact_summary.key_requirements").alias("requirements"),
        F.col("critical_dates.compliance_date").alias("compliance_date"))


@query("domain_score", oracle("""
    SELECT lower(industry) AS domain, count(*) AS n, count(DISTINCT coalesce(regulator_name, '?')) AS regulators,
           median(requirements) AS median_requirements, round(100.0 * count(*) FILTER (compliance_date <> '') / count(*), 2) AS dated_percent,
           round((0.5 + count(DISTINCT coalesce(regulator_name, '?')) / count(*)) * least(median(requirements), 8) / 8, 4) AS score
    FROM candidates WHERE failed = '' GROUP BY 1 HAVING count(*) >= 10""", "candidates"))
def domain_score(spark, folder):
    return audit.domain_scores(_pool(spark, folder), min_size=10)


@query("domain_pool", oracle("""
    SELECT view, value, count(*) AS n FROM (
      SELECT 'regulator' AS view, coalesce(regulator_name, '?') AS value FROM candidates
      WHERE failed = '' AND lower(industry) IN ('building', 'machinery') UNION ALL
      SELECT 'update_type', update_type FROM candidates WHERE failed = '' AND lower(industry) IN ('building', 'machinery'))
    GROUP BY ALL""", "candidates"))
def domain_pool(spark, folder):
    return audit.domain_pool(_pool(spark, folder), ["building", "machinery"])


@query("tag_intersect", oracle("""
    SELECT record_id, concat_ws(',', CASE WHEN lower(tag_1) IN ('machine learning', 'fair lending') THEN lower(tag_1) END,
           CASE WHEN tag_2 = 'Privacy' THEN 'privacy' END) AS shared FROM records""", "records"))
def tag_intersect(spark, folder):
    wanted = F.array(F.lit("machine learning"), F.lit("fair lending"), F.lit("privacy"))
    return records(spark, folder).select(
        "record_id", F.array_join(F.array_intersect(keywords.lowered(F.col("tags")), wanted), ",").alias("shared"))


@query("fk_coverage", """
    SELECT count(*) FILTER (s_suppkey IS NOT NULL) AS hits, count(*) FILTER (s_suppkey IS NULL) AS misses,
           count(DISTINCT CASE WHEN s_suppkey IS NULL THEN l_suppkey END) AS missing_keys, 0.0 AS regulator_share,
           CASE WHEN count(*) FILTER (s_suppkey IS NULL) = 0 THEN 'clean join' ELSE 'significant misses' END AS verdict
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) ON l_suppkey = s_suppkey""")
def fk_coverage(spark, folder):
    """Line items against the suppliers in good standing."""
    dim = table(spark, folder, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    facts = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("key"))
    return audit.key_coverage(facts, dim, "key", "name")


@query("topk_global", oracle("""
    SELECT record_id, total, CAST(row_number() OVER (ORDER BY total DESC, seq) AS INT) AS position FROM components
    QUALIFY position <= 50""", "components"))
def topk_global(spark, folder):
    return shortlist(spark, folder).select("record_id", "total", "position")


def shortlist(spark, folder):
    rows = shortlist_rows(spark, folder).select(
        "record_id", "seq", "total", "parts", "regulator_name", "topic_jurisdiction_code", "jurisdiction_tier")
    return spread.ranked_limit(rows, [F.col("total").desc(), F.col("seq")], 50)


define("shortlist", """SELECT *, row_number() OVER (ORDER BY total DESC, seq) AS position FROM components
       QUALIFY position <= 50""", "components")


@query("shortlist_diag", oracle("""
    SELECT count(*) FILTER (jurisdiction_code = 'US' OR tier_label = 'us_federal') AS federal,
           count(*) FILTER (regexp_matches(jurisdiction_code, '^US-[A-Z]{2}$')) AS state,
           count(*) FILTER (tier_label = 'international' AND jurisdiction_code NOT LIKE 'US%') AS international,
           count(*) FILTER (position <= 15 AND recency >= 5) AS recent, 0 AS recognised,
           (SELECT max(n) FROM (SELECT count(*) AS n FROM shortlist WHERE position <= 15 GROUP BY regulator_name)) AS top_regulator,
           (SELECT max(n) FROM (SELECT count(*) AS n FROM shortlist WHERE position <= 15 GROUP BY regulator_name)) >= 7.5 AS dominated
    FROM shortlist""", "shortlist"))
def shortlist_diag(spark, folder):
    return audit.shortlist_diagnostics(shortlist(spark, folder))


def _pinned(spark, folder):
    """The oldest eligible record, as a curator might pin it."""
    kept = records(spark, folder).filter(scores.is_substantive() & dates.within_age(AS_OF, 90))
    return kept.agg(F.min_by("record_id", F.struct("pub_date", "seq"))).first()[0]


define("inbox", """SELECT *, row_number() OVER (ORDER BY CASE WHEN record_id = (SELECT arg_min(record_id, (pub_date, seq)) FROM recs
       WHERE substantive AND age BETWEEN 0 AND 90) THEN 0 ELSE 1 END, score DESC, pub_date DESC, seq) AS position
       FROM ranks WHERE substantive AND age BETWEEN 0 AND 90""", "ranks")


@query("inbox_top", oracle("SELECT record_id, score, CAST(position AS INT) AS position FROM inbox WHERE position <= 25", "inbox"))
def inbox_top(spark, folder):
    return ranking.inbox(records(spark, folder), AS_OF, _pinned(spark, folder), 25, ["Ada", "Ben", "Cleo"]) \
                  .select("record_id", "score", "position")


@query("round_robin", oracle("""
    SELECT record_id, ['new', 'in_review', 'acknowledged', 'new', 'drafted'][(position - 1) % 5 + 1] AS status,
           ['Ada', 'Ben', 'Cleo'][(position - 1) % 3 + 1] AS assignee FROM inbox WHERE position <= 40""", "inbox"))
def round_robin(spark, folder):
    return ranking.inbox(records(spark, folder), AS_OF, _pinned(spark, folder), 40, ["Ada", "Ben", "Cleo"]) \
                  .select("record_id", "status", "assignee")


@query("recent_per_topic", oracle("""
    SELECT record_id, topic_id, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY pub_date DESC, title, seq) AS rank FROM records
      WHERE pub_date BETWEEN '2000-01-01' AND '2001-07-01' AND title <> '')
    WHERE rank <= CASE WHEN topic_name IN ('NATION_1', 'NATION_3') THEN 30 ELSE 3 END""", "records"))
def recent_per_topic(spark, folder):
    return ranking.recent_per_topic(records(spark, folder), ["NATION_1", "NATION_3"], "2001-07-01") \
                  .select("record_id", "topic_id", "rank")


@query("pool_split", oracle(f"""
    WITH items AS (SELECT record_id, seq, similarity,
           regexp_matches(lower(feed_text), '{'|'.join(vocab.FORWARD_WORDS)}') AS forward_looking FROM records WHERE similarity >= 0.03),
    feed AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, seq) AS rank FROM items WHERE NOT forward_looking),
    ahead AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, seq) AS rank FROM items WHERE forward_looking)
    SELECT record_id, 'feed' AS list, CAST(rank AS INT) AS rank FROM feed WHERE rank <= 12 UNION ALL
    SELECT record_id, 'horizon', CAST(rank AS INT) FROM ahead WHERE rank <= 8""", "records"))
def pool_split(spark, folder):
    items = feed(spark, folder).filter("similarity >= 0.03").select(
        "record_id", "seq", "similarity", keywords.is_forward_looking(F.col("feed_text")).alias("forward_looking"))
    return ranking.split_pools(items).select("record_id", "list", "rank")


def domain_records(spark, folder):
    """Trimmed records; some have no impact score."""
    impact = F.when(F.col("seq") % 13 != 0, F.col("scores.impact.score"))
    return records(spark, folder).select(
        "record_id", "seq", "title", "pub_date", "update_type", F.coalesce("regulator_name", F.lit("")).alias("regulator"),
        "impact_summary.what_changed", "impact_summary.why_it_matters", "tags", impact.alias("impact_score"))


define("domain_records", "SELECT *, CASE WHEN seq % 13 <> 0 THEN impact END AS impact_score FROM records", "records")
_ASK = """pub_date BETWEEN '1996-02-01' AND '2000-12-31' AND impact_score >= 4 AND update_type = 'final rule'
    AND contains(lower(coalesce(regulator_name, '')), 'nation_1') AND contains(lower(concat_ws(' ', title, what_changed)), 'building')"""
QUESTION = dict(date_from="1996-02-01", date_to="2000-12-31", min_impact=4, update_type="Final Rule", regulator="Nation_1",
                keyword="Building")


@query("domain_query", oracle(f"SELECT record_id FROM domain_records WHERE {_ASK}", "domain_records"))
def domain_query(spark, folder):
    return domain_records(spark, folder).filter(ranking.DomainQuery(**QUESTION).condition()).select("record_id")


@query("domain_group", oracle("""
    SELECT 'regulator' AS view, CASE WHEN coalesce(regulator_name, '') = '' THEN '(unknown)' ELSE regulator_name END AS key, count(*) AS n,
           max(impact_score) AS max_impact FROM domain_records WHERE pub_date >= '2000-01-01' GROUP BY 2 UNION ALL
    SELECT 'update_type', update_type, count(*), max(impact_score) FROM domain_records WHERE pub_date >= '2000-01-01' GROUP BY 2 UNION ALL
    SELECT 'month', substring(pub_date, 1, 7), count(*), max(impact_score) FROM domain_records WHERE pub_date >= '2000-01-01' GROUP BY 2
    """, "domain_records"))
def domain_group(spark, folder):
    recent = ranking.DomainQuery(date_from="2000-01-01").condition()
    return ranking.group_views(domain_records(spark, folder).filter(recent), ["regulator", "update_type", "month"])


@query("domain_query_page", oracle("""
    SELECT record_id, CAST(position AS INT) AS position, matches FROM (
      SELECT record_id, row_number() OVER (ORDER BY coalesce(impact_score, -1) DESC, pub_date DESC, seq) AS position,
             count(*) OVER () AS matches FROM domain_records WHERE pub_date >= '1999-01-01') WHERE position <= 100""", "domain_records"))
def domain_query_page(spark, folder):
    ask = ranking.DomainQuery(date_from="1999-01-01", order_by="impact", limit=500)
    return ask.page(domain_records(spark, folder)).select("record_id", "position", "matches")
