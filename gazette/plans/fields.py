"""Column queries: scores, dates, labels and text fields of one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import dates, keywords, money, places, scores, text, urls
from gazette.functions.common import first_filled, lookup
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, define, oracle, records
from gazette.session import table

TODAY = f"DATE '{AS_OF}'"


def _in(words):
    return "|".join(w.replace("(", "\\(").replace(")", "\\)") for w in words).replace("'", "''")


@query("score_defaults", """
    SELECT event_id, coalesce(TRY_CAST(CASE event_type WHEN 'error' THEN 'n/a' WHEN 'signup' THEN NULL
           ELSE json_extract_string(props, '$.k') END AS DOUBLE), 0.0) AS urgency FROM events""")
def score_defaults(spark, folder):
    raw = (F.when(F.col("event_type") == "error", "n/a")
           .when(F.col("event_type") != "signup", F.get_json_object("props", "$.k")))
    events = table(spark, folder, "events")
    shaped = events.select("event_id", F.struct(F.struct(raw.alias("score")).alias("urgency")).alias("scores"))
    return shaped.select("event_id", scores.score("urgency").alias("urgency"))


@query("pub_age", oracle("SELECT record_id, CAST(day AS VARCHAR) AS day, CAST(age AS DOUBLE) AS age FROM recs", "recs"))
def pub_age(spark, folder):
    return records(spark, folder).select("record_id", dates.pub_day().cast("string").alias("day"),
                                         dates.age_days(AS_OF).cast("double").alias("age"))


@query("regulator_display", oracle("SELECT record_id, regulator FROM recs", "recs"))
def regulator_display(spark, folder):
    return records(spark, folder).select("record_id", scores.regulator_display().alias("regulator"))


@query("urgency_tier", oracle("""
    SELECT record_id, CASE WHEN urgency >= 8 THEN 'critical' WHEN urgency >= 6.5 THEN 'high'
           WHEN urgency >= 4 THEN 'medium' ELSE 'low' END AS tier FROM records""", "records"))
def urgency_tier(spark, folder):
    return records(spark, folder).select("record_id", scores.urgency_label(scores.score("urgency")).alias("tier"))


@query("mechanism", oracle("""
    SELECT record_id, CASE WHEN update_type IN ('enforcement', 'final rule') THEN 'Binding Action'
           WHEN update_type IN ('proposed rule', 'advisory', 'guidance', 'comment request') THEN 'Signal'
           ELSE 'Context' END AS mechanism FROM records""", "records"))
def mechanism(spark, folder):
    return records(spark, folder).select("record_id", scores.mechanism(F.col("update_type")).alias("mechanism"))


_KIND = """CASE update_type WHEN 'enforcement' THEN 10 WHEN 'final rule' THEN 10 WHEN 'proposed rule' THEN 8
           WHEN 'press release' THEN 2 ELSE 0 END"""
_RECENCY = """CASE WHEN {a} IS NULL THEN 0 WHEN {a} <= 7 THEN 10 WHEN {a} <= 30 THEN 8 WHEN {a} <= 60 THEN 5
              WHEN {a} <= 90 THEN 2 ELSE 0 END"""
define("ranks", f"""SELECT *, round(0.30 * urgency + 0.20 * impact + 0.15 * {_RECENCY.format(a='age')} + 0.15 * {_KIND}
       + 0.10 * CASE WHEN jurisdiction_code LIKE 'US-%' THEN 10 WHEN jurisdiction_code = 'US' THEN 8
                     WHEN tier_label = 'international' THEN 4 ELSE 0 END, 4) AS score FROM recs""", "recs")


@query("rank_score", oracle("SELECT record_id, score FROM ranks", "ranks"))
def rank_score(spark, folder):
    return records(spark, folder).select("record_id", scores.rank_score(AS_OF).alias("score"))


define("components", f"""SELECT *, round(0.30 * urgency + 0.20 * impact + 0.15 * recency + 0.15 * kind_points
       + 0.10 * place, 4) AS total FROM (
       SELECT *, {_RECENCY.format(a=f"({TODAY} - CAST(pub_date AS DATE))")} AS recency, {_KIND} AS kind_points,
              CASE WHEN jurisdiction_code = '' THEN 0 WHEN regexp_matches(jurisdiction_code, '^US-[A-Z]{{2}}$') THEN 10
                   WHEN jurisdiction_code LIKE 'US%' THEN 8 ELSE 4 END AS place
       FROM recs WHERE update_type <> 'website error' AND relevance >= 5 AND title <> '' AND link <> ''
         AND pub_date_valid)""", "recs")


def shortlist_rows(spark, folder):
    """Records that pass the shortlist's own filter, with the parts of their score."""
    kept = records(spark, folder).filter(
        (F.lower(F.trim("update_type")) != "website error") & (scores.score("relevance") >= 5)
        & (F.trim("title") != "") & (F.trim("link") != "") & F.col("pub_date_valid"))
    return kept.withColumn("parts", scores.rank_components(AS_OF)).withColumn("total", scores.components_total("parts"))


@query("rank_components", oracle("""
    SELECT record_id, urgency, impact, CAST(recency AS DOUBLE) AS recency, CAST(kind_points AS DOUBLE) AS kind,
           CAST(place AS DOUBLE) AS place, 0.0 AS recognition, total,
           concat_ws('|', entity_1, entity_2, entity_3) AS top_entities, substring(what_changed, 1, 300) AS what_changed
    FROM components""", "components"))
def rank_components(spark, folder):
    return shortlist_rows(spark, folder).select(
        "record_id", "parts.*", "total", F.array_join(F.slice("entities", 1, 5), "|").alias("top_entities"),
        F.substring("impact_summary.what_changed", 1, 300).alias("what_changed"))


_SPELLED = "CASE o_orderpriority WHEN '1-URGENT' THEN {a} WHEN '2-HIGH' THEN {b} WHEN '3-MEDIUM' THEN {c} " \
           "WHEN '4-NOT SPECIFIED' THEN {d} ELSE {e} END"


def _order_texts(spark, folder, **cases):
    """Orders with a text that depends on the priority."""
    orders = table(spark, folder, "orders")
    by_priority = zip(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], "abcd")
    raw = F
    for value, key in by_priority:
        raw = raw.when(F.col("o_orderpriority") == value, F.expr(cases[key]))
    return orders.select("o_orderkey", raw.otherwise(F.expr(cases["e"])).alias("raw"))


@query("date_normalise", f"""
    SELECT o_orderkey, {_SPELLED.format(a="strftime(o_orderdate, '%Y-%m-%d')", b="strftime(o_orderdate, '%Y-%m-%d')",
                                        c="strftime(o_orderdate, '%Y-%m-%d')", d="'pending re'", e="''")} AS day
    FROM orders""")
def date_normalise(spark, folder):
    rows = _order_texts(spark, folder, a="date_format(o_orderdate, 'yyyyMMdd')",
                        b="date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm\")", c="date_format(o_orderdate, 'd MMMM yyyy')",
                        d="'pending review'", e="CAST(NULL AS STRING)")
    return rows.select("o_orderkey", dates.lenient_day(F.col("raw")).alias("day"))


@query("partial_date", f"""
    SELECT o_orderkey, {_SPELLED.format(a="strftime(o_orderdate, '%Y-%m-%d')", b="strftime(o_orderdate, '%Y-%m-01')",
                                        c="strftime(o_orderdate, '%Y-01-01')", d="'0000-00-00'", e="'2001-01-01'")} AS day,
           {_SPELLED.format(a="strftime(o_orderdate, '%b %Y')", b="strftime(o_orderdate, '%b %Y')",
                            c="strftime(o_orderdate, 'Jan %Y')", d="'n.d.'", e="'Jan 2001'")} AS label
    FROM orders""")
def partial_date(spark, folder):
    rows = _order_texts(spark, folder, a="date_format(o_orderdate, 'yyyy MMM d')", b="date_format(o_orderdate, 'yyyy MMM')",
                        c="date_format(o_orderdate, 'yyyy')", d="'n.d.'", e="'2001 Spring'")
    return rows.select("o_orderkey", dates.partial_day(F.col("raw")).alias("day"),
                       dates.month_label(F.col("raw")).alias("label"))


@query("strict_date", f"""
    SELECT o_orderkey, {_SPELLED.format(a="strftime(o_orderdate, '%Y-%m-%d')", b="strftime(o_orderdate, '%Y-%m-%d')",
                                        c="strftime(o_orderdate, '%Y-%m-%d')", d="NULL", e="NULL")} AS day
    FROM orders""")
def strict_date(spark, folder):
    rows = _order_texts(spark, folder, a="date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
                        b="date_format(o_orderdate, 'd MMMM yyyy')", c="date_format(o_orderdate, 'MMM d, yyyy')",
                        d="date_format(o_orderdate, 'dd/MM/yyyy')", e="'Q3 2026'")
    return rows.select("o_orderkey", dates.strict_day(F.col("raw")).alias("day"))


RAW_SEVERITY = "CASE event_type WHEN 'error' THEN 'Malfunction' WHEN 'purchase' THEN 'Death' " \
               "WHEN 'view' THEN 'Serious Injury' WHEN 'click' THEN 'near-miss' ELSE 'cosmetic' END"


@query("severity_map", """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'malfunction' WHEN 'purchase' THEN 'death' WHEN 'view' THEN 'serious'
           WHEN 'click' THEN 'near-miss' ELSE 'unknown' END AS severity FROM events""")
def severity_map(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", keywords.severity_class(F.expr(RAW_SEVERITY)).alias("severity"))


def feed(spark, folder):
    return records(spark, folder, "feed_text", "feed_type", "similarity", "agency", "summary", "country", "bloc",
                   "industry", "topic_function")


def _first_word(rules, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(feed_text), '{_in(w)}') THEN '{label}'"
                              for label, w in rules) + f" ELSE '{otherwise}' END"


_SOURCE = f"""CASE lower(feed_type) WHEN 'recall' THEN 'vigilance' WHEN 'guidance' THEN 'regulatory'
    WHEN 'standard' THEN 'standards' ELSE {_first_word(vocab.SOURCE_TYPE_WORDS, 'regulatory')} END"""


@query("source_type", oracle(f"SELECT record_id, {_SOURCE} AS source_type FROM records", "records"))
def source_type(spark, folder):
    return feed(spark, folder).select("record_id", keywords.source_type(F.col("feed_type"), F.col("feed_text")).alias("source_type"))


@query("severity_rule", oracle(f"""
    SELECT record_id, CASE WHEN urgency >= 7 OR impact >= 8 THEN 'critical' WHEN impact >= 4 THEN 'high'
           WHEN regexp_matches(lower(feed_text), '{_in(vocab.SEVERITY_WORDS)}') THEN 'critical'
           WHEN similarity > 0.25 THEN 'high' WHEN similarity > 0.12 THEN 'medium' ELSE 'low' END AS severity
    FROM records""", "records"))
def severity_rule(spark, folder):
    severity = keywords.feed_severity(
        F.col("scores.urgency.label"), F.col("scores.urgency.score"), F.col("scores.impact.label"),
        F.col("scores.impact.score"), F.col("feed_text"), F.col("similarity"))
    return feed(spark, folder).select("record_id", severity.alias("severity"))


@query("keyword_category", oracle(f"""
    SELECT record_id, {_first_word(vocab.CATEGORY_WORDS, 'Regulatory Update')} AS category,
           CASE lower(feed_type) WHEN 'recall' THEN 'ALERT' WHEN 'guidance' THEN 'GUIDANCE' WHEN 'standard' THEN 'STANDARD'
                ELSE {_first_word(vocab.HORIZON_TYPE_WORDS, 'REGULATION')} END AS horizon_type,
           regexp_matches(lower(feed_text), '{_in(vocab.FORWARD_WORDS)}') AS forward_looking FROM records""", "records"))
def keyword_category(spark, folder):
    body = F.col("feed_text")
    return feed(spark, folder).select(
        "record_id", keywords.category(body).alias("category"),
        keywords.horizon_type(F.col("feed_type"), body).alias("horizon_type"),
        keywords.is_forward_looking(body).alias("forward_looking"))


@query("deadline", oracle("""
    SELECT record_id, CASE WHEN compliance_date <> '' THEN compliance_date WHEN effective_date <> '' THEN effective_date
           WHEN comment_deadline <> '' THEN comment_deadline WHEN contains(feed_text, 'January 2027') THEN 'January 2027'
           WHEN contains(feed_text, 'march 2028') THEN 'March 2028' WHEN contains(feed_text, 'Q3 2026') THEN 'Q3 2026'
           ELSE '—' END AS deadline FROM records""", "records"))
def deadline(spark, folder):
    d = F.col("critical_dates")
    return feed(spark, folder).select("record_id", dates.deadline(
        F.col("feed_text"), d["compliance_date"], d["effective_date"], d["comment_deadline"]).alias("deadline"))


@query("first_nonblank", oracle(f"""
    SELECT record_id, CASE WHEN why_it_matters <> '' THEN why_it_matters ELSE summary END AS why,
           CASE WHEN trim(requirement) <> '' AND requirements > 2 THEN trim(requirement) ELSE CASE {_SOURCE}
             {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.ACTION_DEFAULTS.items())} END END AS action
    FROM records""", "records"))
def first_nonblank(spark, folder):
    """Why a record matters and what to do, each from the first filled field."""
    kind = keywords.source_type(F.col("feed_type"), F.col("feed_text"))
    third = F.get(F.col("impact_summary.key_requirements"), 2)
    return feed(spark, folder).select(
        "record_id", first_filled(F.col("impact_summary.why_it_matters"), F.col("summary")).alias("why"),
        F.coalesce(first_filled(third), lookup(kind, vocab.ACTION_DEFAULTS)).alias("action"))


@query("age_label", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'recently' WHEN h < 1 THEN 'just now' WHEN h < 24 THEN h || 'h ago'
           ELSE (h // 24) || 'd ago' END AS label
    FROM (SELECT *, CAST(floor((epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts))) / 3600) AS BIGINT) AS h FROM events)""")
def age_label(spark, folder):
    """Age text from the first of two fields that parses; error events carry no readable time."""
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    published = F.when(F.col("event_type") == "view", F.lit("not yet")).when(F.col("event_type") != "error", shown)
    created = F.when(F.col("event_type") != "error", shown)
    found = dates.first_time(published, created)
    return table(spark, folder, "events").select(
        "event_id", dates.age_label(found, F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("label"))


@query("article_type", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'SYSTEMATIC REVIEW + META-ANALYSIS'
           WHEN o_orderstatus = 'F' THEN 'SYSTEMATIC REVIEW' WHEN o_orderpriority = '1-URGENT' THEN 'META-ANALYSIS'
           WHEN o_orderpriority = '2-HIGH' THEN 'RCT' WHEN o_orderpriority = '3-MEDIUM' THEN 'CLINICAL TRIAL'
           ELSE 'REVIEW' END AS article_type,
           CASE WHEN o_custkey % 5 <= 3 THEN array_to_string(list_transform(range(o_custkey % 5), lambda x: 'Author ' || x), ', ')
                ELSE 'Author 0 et al.' END AS authors FROM orders""")
def article_type(spark, folder):
    flags = F.array_compact(F.array(
        F.when(F.col("o_orderstatus") == "F", "systematic_review"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "meta_analysis"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "rct"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "clinical_trial")))
    numbers = F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), (F.col("o_custkey") % 5).cast("int"))
    authors = F.transform(numbers, lambda i: F.concat(F.lit("Author "), i.cast("string")))
    return table(spark, folder, "orders").select("o_orderkey", keywords.article_type(flags).alias("article_type"),
                                                 keywords.short_authors(authors).alias("authors"))


@query("clearance_flag", oracle("""
    SELECT record_id, CASE WHEN contains(feed_text, 'Novel device') THEN 'US' WHEN contains(feed_text, 'de novo') THEN 'AU' END
           AS regulator, feed_type IN ('', 'Recall') AS clinical FROM records""", "records"))
def clearance_flag(spark, folder):
    """Regulator of clearance notices, and whether a supplement reason is clinical."""
    reason = F.when(F.col("feed_type") == "Recall", "Labeling Change - PAS").otherwise(F.col("feed_type"))
    return feed(spark, folder).select("record_id", keywords.clearance_regulator(F.col("feed_text")).alias("regulator"),
                                      keywords.is_clinical(reason).alias("clinical"))


@query("jurisdiction_tags", oracle("""
    SELECT record_id, CASE WHEN contains(feed_text, 'Novel') THEN 'US,CH' WHEN contains(feed_text, 'FDA') THEN 'US'
           WHEN contains(feed_text, 'MHRA') THEN 'UK' WHEN contains(feed_text, 'TGA') THEN 'AU'
           WHEN contains(feed_text, 'EU MDR') OR contains(feed_text, 'pacemaker') THEN 'EU' WHEN contains(feed_text, 'ANSM') THEN 'EU,FR,DE' ELSE 'INT' END AS tags,
           regexp_matches(feed_text, 'FDA|MHRA|Swissmedic|TGA|EU MDR|ANSM|pacemaker') AS device_topic FROM records""", "records"))
def jurisdiction_tags(spark, folder):
    body = F.col("feed_text")
    return feed(spark, folder).select("record_id", F.array_join(places.market_tags(body), ",").alias("tags"),
                                      keywords.is_device_topic(body).alias("device_topic"))


define("liabilities", """
    SELECT *, orderkey_status = 'F' AS concrete,
           CASE WHEN orderkey_status = 'F' THEN least(amount, millions) WHEN agency = 'SEC' THEN 100000 ELSE 50000 END AS low,
           CASE WHEN orderkey_status = 'F' THEN greatest(amount, millions) WHEN agency = 'FTC' THEN 500000
                WHEN agency = 'SEC' THEN 10000000 ELSE 1000000 END AS high
    FROM (SELECT *, CASE WHEN contains(summary, 'fined') THEN 'F' ELSE '' END AS orderkey_status,
                 TRY_CAST(regexp_extract(summary, 'fined \\$([0-9]+)', 1) AS BIGINT) AS amount,
                 TRY_CAST(regexp_extract(summary, 'and \\$([0-9]+) million', 1) AS BIGINT) * 1000000 AS millions FROM recs)
    """, "recs")


@query("liability_extract", oracle("SELECT record_id, low, high, concrete FROM liabilities", "liabilities"))
def liability_extract(spark, folder):
    found = money.liability(F.col("summary"), F.col("agency"))
    return feed(spark, folder).withColumn("found", found).select("record_id", "found.low", "found.high", "found.concrete")


@query("money_mentions", oracle("""
    SELECT record_id, CASE WHEN contains(summary, 'fined') THEN 2 WHEN contains(summary, 'cites') THEN 1 ELSE 0 END AS mentions
    FROM records""", "records"))
def money_mentions(spark, folder):
    return feed(spark, folder).select("record_id", money.money_mentions(F.col("summary")).alias("mentions"))


@query("extract_urls", oracle("""
    SELECT record_id, CASE WHEN starts_with(reference, 'See') THEN reference[6:-3] ELSE '' END AS found FROM records""", "records"))
def extract_urls(spark, folder):
    return records(spark, folder).select(
        "record_id", F.array_join(urls.extract_urls(F.col("reg_references.rules")[0]), " ").alias("found"))


@query("url_normal", """
    SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1))
           || rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/')
           || CASE WHEN contains(url, '?') THEN regexp_extract(url, '(\\?[^#]*)', 1) ELSE '' END
           || CASE WHEN contains(url, '#') THEN regexp_extract(url, '(#.*)$', 1) ELSE '' END AS url FROM pages""")
def url_normal(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.normal_url(F.col("url")).alias("url"))


@query("source_url", oracle("""
    SELECT record_id, CASE WHEN link <> '' THEN link ELSE 'https://' || lower(topic_name) || '.example' END AS url
    FROM records""", "records"))
def source_url(spark, folder):
    base = F.concat(F.lit("http://"), F.lower("topic_name"), F.lit(".example"))
    return records(spark, folder).select("record_id", urls.source_url(F.col("link"), base).alias("url"))


@query("trim_record", oracle("""
    SELECT record_id, title, pub_date, update_type, coalesce(regulator_name, '') AS regulator, what_changed,
           CAST(least(requirements, 3) AS INT) AS kept_requirements, tag_1 || '|' || tag_2 AS tags, impact AS impact_score
    FROM records""", "records"))
def trim_record(spark, folder):
    return records(spark, folder).select(
        "record_id", "title", "pub_date", "update_type", F.coalesce("regulator_name", F.lit("")).alias("regulator"),
        "impact_summary.what_changed", F.size(F.slice("impact_summary.key_requirements", 1, 3)).alias("kept_requirements"),
        F.array_join(F.slice("tags", 1, 8), "|").alias("tags"), F.col("scores.impact.score").alias("impact_score"))


@query("search_text", oracle("""
    SELECT record_id, concat_ws(chr(10), nullif(title, ''), what_changed, nullif(why_it_matters, ''),
           tag_1 || ' ' || tag_2) AS body FROM records""", "records"))
def search_text(spark, folder):
    return records(spark, folder).select("record_id", text.search_text(
        F.col("title"), F.col("impact_summary.what_changed"), F.col("impact_summary.why_it_matters"),
        F.array_join("tags", " ")).alias("body"))


@query("domain_bucket", oracle("""
    SELECT record_id, CASE WHEN tag_1 IN ('Artificial Intelligence', 'Machine Learning') THEN 'AI-assisted decisioning'
             WHEN contains(tag_2, 'AI') THEN 'AI-assisted decisioning' ELSE 'AI-assisted decisioning' END AS bucket_a,
           CASE WHEN tag_1 = 'Securities' THEN 'investment product marketing' WHEN tag_2 = 'Marketing'
             THEN 'retail financial promotions' ELSE 'investment product marketing' END AS bucket_b,
           CASE country WHEN 'US' THEN 'the United States' WHEN 'FR' THEN 'France' WHEN 'DE' THEN 'Germany'
             WHEN 'GB' THEN 'the United Kingdom' WHEN 'MT' THEN 'Malta' WHEN '' THEN CASE WHEN bloc = 'EU' THEN 'the EU'
             ELSE 'the applicable jurisdiction' END ELSE country END AS place FROM records""", "records"))
def domain_bucket(spark, folder):
    return feed(spark, folder).select(
        "record_id", keywords.domain_bucket("A", F.col("tags")).alias("bucket_a"),
        keywords.domain_bucket("B", F.col("tags")).alias("bucket_b"),
        places.jurisdiction_phrase(F.col("country"), F.col("bloc")).alias("place"))


@query("priority_score", oracle(f"""
    SELECT record_id, CAST(greatest(least(round_even(0.6 * urgency + 0.4 * impact, 0), 10), 1) AS INT) AS priority,
           CAST({TODAY} + 2 AS VARCHAR) AS due FROM records""", "records"))
def priority_score(spark, folder):
    return records(spark, folder).select(
        "record_id", scores.priority(scores.score("urgency"), scores.score("impact")).alias("priority"),
        F.date_add(F.lit(AS_OF).cast("date"), 2).cast("string").alias("due"))


@query("quarter_bounds", oracle("""
    SELECT record_id, 'Q' || quarter(d) || ' ' || year(d) AS label, CAST(CAST(date_trunc('quarter', d) AS DATE) AS VARCHAR) AS first_day,
           CAST(CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH AS DATE) - 1 AS VARCHAR) AS last_day
    FROM (SELECT record_id, CAST(pub_date AS DATE) AS d FROM records)""", "records"))
def quarter_bounds(spark, folder):
    day = dates.iso_day(F.col("pub_date"))
    return records(spark, folder).select(
        "record_id", dates.quarter_label(day).alias("label"), dates.quarter_start(day).cast("string").alias("first_day"),
        dates.quarter_end(day).cast("string").alias("last_day"))


@query("tag_layers", oracle("""
    SELECT record_id, array_to_string(list_sort(list_distinct(
      CASE tag_1 WHEN 'Artificial Intelligence' THEN [4, 7] WHEN 'Fair Lending' THEN [2, 6] WHEN 'Machine Learning' THEN [3]
           ELSE CAST([] AS INTEGER[]) END || CASE tag_2 WHEN 'Data Breach' THEN [1, 5] WHEN 'Privacy' THEN [1, 4, 7]
           ELSE CAST([] AS INTEGER[]) END)), ',') AS layers FROM records""", "records"))
def tag_layers(spark, folder):
    layers = keywords.tag_layers(F.col("tags")).cast("array<string>")
    return records(spark, folder).select("record_id", F.array_join(layers, ",").alias("layers"))


@query("ai_tag", oracle("SELECT record_id, tag_1 = 'Artificial Intelligence' AS has_ai FROM records", "records"))
def ai_tag(spark, folder):
    return records(spark, folder).select("record_id", keywords.has_ai_tag(F.col("tags")).alias("has_ai"))


def paged(spark, folder):
    """Documents with page furniture around and inside the text."""
    return table(spark, folder, "documents").select("doc_id", F.concat(
        F.lit("12\n"), F.col("text"), F.lit("\n\n\n© 2001 "), F.col("source"), F.lit("\n6 February 2001\nEnd of "),
        F.col("lang")).alias("text"))


@query("strip_chrome", """
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM (
      SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (
        SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
        FROM (SELECT doc_id, '12' || chr(10) || text || chr(10) || chr(10) || chr(10) || '© 2001 ' || source || chr(10)
              || '6 February 2001' || chr(10) || 'End of ' || lang AS t FROM documents))
      WHERE NOT regexp_matches(trim(line), '^[0-9]{1,4}$') AND NOT regexp_matches(trim(line), '^© *[0-9]{4}')
        AND NOT regexp_matches(trim(line), '^[0-9]{1,2}\\s+\\w+\\s+[0-9]{4}$'))
    WHERE NOT (trim(line) = '' AND coalesce(before, 'x') = '') GROUP BY doc_id""")
def strip_chrome(spark, folder):
    return paged(spark, folder).select("doc_id", text.strip_furniture(F.col("text")).alias("body"))


@query("chrome_only", """
    SELECT doc_id, length(regexp_replace(text, '^\\s+$', '')) > 0 AND size < 30 AS furniture_only FROM (
      SELECT doc_id, any_value(text) AS text, sum(CASE WHEN regexp_matches(trim(line), '^[0-9]{1,4}$') THEN 0
             ELSE length(trim(line)) END) AS size
      FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id)""")
def chrome_only(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.furniture_only(F.col("text")).alias("furniture_only"))


@query("token_cost", """
    SELECT event_id, round((value * 1000 * 5 + value * 300 * 0.5 + value * 20 * 30) / 1e6 + (user_id % 3) * 0.01, 8) AS warm,
           round((value * 1300 * 5 + value * 20 * 30) / 1e6 + (user_id % 3) * 0.01, 8) AS cold FROM events""")
def token_cost(spark, folder):
    args = [F.col("value") * 1000, F.col("value") * 300, F.col("value") * 20, F.col("user_id") % 3]
    return table(spark, folder, "events").select(
        "event_id", F.round(scores.token_cost(*args), 8).alias("warm"),
        F.round(scores.token_cost(*args, warm=False), 8).alias("cold"))


@query("content_hash", oracle("""
    SELECT record_id, substring(sha256('{"title":"' || title || '","link":"' || link || '"}'), 1, 16) AS digest
    FROM records""", "records"))
def content_hash(spark, folder):
    return records(spark, folder).select("record_id", text.content_hash(F.struct("title", "link")).alias("digest"))


@query("cap_future", """
    SELECT event_id, strftime(CASE WHEN ts > TIMESTAMP '2024-01-15 00:00:00' THEN TIMESTAMP '2024-01-15 00:00:00' ELSE ts END,
           '%Y-%m-%d %H:%M') AS shown FROM events""")
def cap_future(spark, folder):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, folder, "events").select(
        "event_id", F.date_format(F.least(F.col("ts").cast("timestamp"), now), "yyyy-MM-dd HH:mm").alias("shown"))


@query("any_field_regex", oracle("""
    SELECT record_id FROM records WHERE regexp_matches(feed_text, '(?i)cardiac|pacemaker')""", "records"))
def any_field_regex(spark, folder):
    kept = feed(spark, folder).filter(keywords.is_cardiac(F.col("title"), F.col("feed_text")))
    return kept.select("record_id")


@query("topic_keyword", oracle("""
    SELECT record_id FROM records WHERE regexp_matches(feed_text, 'FDA|MHRA|Swissmedic|TGA|EU MDR|ANSM|pacemaker')""", "records"))
def topic_keyword(spark, folder):
    return feed(spark, folder).filter(keywords.is_device_topic(F.col("feed_text"))).select("record_id")


@query("slim_json", oracle("""
    SELECT record_id, CASE WHEN title <> '' THEN '{"title":"' || title || '",' ELSE '{' END
        || CASE WHEN link <> '' THEN '"link":"' || link || '",' ELSE '' END || '"update_type":"' || update_type || '"'
        || CASE WHEN coalesce(regulator_name, '') <> '' THEN ',"regulator":"' || regulator_name || '"' ELSE '' END || '}' AS doc
    FROM records""", "records"))
def slim_json(spark, folder):
    return records(spark, folder).select("record_id", text.slim_json(
        title=F.col("title"), link=F.col("link"), update_type=F.col("update_type"),
        regulator=F.col("regulator_name")).alias("doc"))
