"""Queries over runs, grades, verdicts and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions import urls
from gazette.operators import curation, runs, verdicts
from gazette.plans.fields import feed
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, define, oracle, records
from gazette.session import table

RUN_COLUMNS = [
    "o_orderkey AS run_id", "CASE o_orderstatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'web' ELSE 'domain' END AS arm",
    "o_custkey % 26 AS question_id", "o_orderkey % 3 AS repeat", "o_totalprice / 1000000 AS cost",
    "CAST(o_orderkey % 97 AS DOUBLE) AS latency", "CAST(floor(o_totalprice / 10) AS DOUBLE) AS tokens",
    "CASE WHEN o_custkey % 26 < 5 THEN 'tail-silent-trigger' ELSE 'head' END AS stratum",
    "CASE WHEN o_orderpriority = '5-LOW' THEN 'replay' ELSE 'main' END AS phase", "o_orderpriority AS scenario",
    "CAST(o_custkey % 10 AS DOUBLE) / 10 AS cached_share"]
GRADE_COLUMNS = [
    "l_orderkey AS run_id", "CASE WHEN l_linenumber <> 7 THEN l_discount >= 0.05 END AS pass",
    "l_linenumber = 1 AS must_pass", "l_linestatus AS error_type"]
define("runs", "SELECT " + ", ".join(RUN_COLUMNS) + " FROM orders")
define("grades", "SELECT " + ", ".join(GRADE_COLUMNS) + " FROM lineitem")
define("accuracy", """SELECT run_id, count(*) FILTER (pass IS NULL) AS ungraded,
    CASE WHEN count(pass) = 0 THEN NULL WHEN count(*) FILTER (must_pass AND NOT pass) > 0 THEN 0.0
         ELSE count(*) FILTER (pass) / count(pass) END AS accuracy FROM grades GROUP BY run_id""", "grades")
define("scored", "SELECT * FROM runs JOIN accuracy USING (run_id) WHERE accuracy IS NOT NULL AND phase = 'main'", "runs", "accuracy")


def all_runs(spark, folder):
    return table(spark, folder, "orders").selectExpr(*RUN_COLUMNS)


def grades(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*GRADE_COLUMNS)


def scored(spark, folder):
    return runs.scored_runs(all_runs(spark, folder).filter("phase = 'main'"), grades(spark, folder))


@query("run_accuracy", oracle("SELECT run_id, ungraded, round(accuracy, 4) AS accuracy FROM accuracy", "accuracy"))
def run_accuracy(spark, folder):
    return runs.run_accuracy(grades(spark, folder)).select("run_id", "ungraded", F.round("accuracy", 4).alias("accuracy"))


@query("run_scores", oracle("SELECT run_id, arm, question_id, round(accuracy, 4) AS accuracy FROM scored", "scored"))
def run_scores(spark, folder):
    return scored(spark, folder).select("run_id", "arm", "question_id", F.round("accuracy", 4).alias("accuracy"))


@query("error_counts", oracle("""
    SELECT arm, error_type, count(*) AS n FROM scored JOIN grades USING (run_id) WHERE NOT pass GROUP BY ALL""", "scored", "grades"))
def error_counts(spark, folder):
    return runs.error_counts(scored(spark, folder), grades(spark, folder), ["arm"])


define("strata", """SELECT s.*, CASE WHEN stratum = 'tail-silent-trigger' THEN stratum WHEN coalesce(known, false) THEN 'baseline-knowable'
    ELSE 'baseline-blind' END AS empirical_stratum FROM scored s LEFT JOIN (SELECT question_id, avg(accuracy) >= 0.25 AS known
    FROM scored WHERE arm = 'baseline' GROUP BY question_id) USING (question_id)""", "scored")


@query("strata", oracle("SELECT empirical_stratum, arm, count(*) AS n FROM strata GROUP BY ALL", "strata"))
def strata(spark, folder):
    return runs.strata(scored(spark, folder), "baseline", 0.25).groupBy("empirical_stratum", "arm").agg(F.count("*").alias("n"))


def _stats_sql(source, keys):
    quartile = lambda v, i: f"""CASE WHEN n < 4 THEN {'s_' + v}[{'1' if i == 1 else 'n'}] ELSE
        (s_{v}[j{i}] * (4 - ({i} * (n + 1) - j{i} * 4)) + s_{v}[j{i} + 1] * ({i} * (n + 1) - j{i} * 4)) / 4.0 END"""
    return f"""
    WITH g AS (SELECT {keys}, count(*) AS n, count(DISTINCT question_id) AS n_questions, avg(accuracy) AS a,
                      avg(CASE WHEN accuracy = 0 THEN 1.0 ELSE 0.0 END) AS z, list_sort(list(cost)) AS s_cost,
                      list_sort(list(latency)) AS s_latency, median(cost) AS mc, median(latency) AS ml, median(tokens) AS mt,
                      greatest(least((count(*) + 1) // 4, count(*) - 1), 1) AS j1,
                      greatest(least(3 * (count(*) + 1) // 4, count(*) - 1), 1) AS j3 FROM {source} GROUP BY {keys}),
    sp AS (SELECT {keys}, avg(d) AS spread FROM (SELECT {keys}, question_id, max(accuracy) - min(accuracy) AS d FROM {source}
           GROUP BY {keys}, question_id HAVING count(*) > 1) GROUP BY {keys})
    SELECT {keys}, n AS n_runs, n_questions, round(a, 4) AS accuracy_mean, round(z, 4) AS zero_rate,
           round(coalesce(spread, 0), 4) AS repeat_spread, round(mc, 5) AS cost_median, round({quartile('cost', 1)}, 5) AS cost_q1,
           round({quartile('cost', 3)}, 5) AS cost_q3, round(s_cost[least(n - 1, n * 9 // 10) + 1], 5) AS cost_p90,
           round(ml, 1) AS latency_median, s_latency[1] AS latency_min, s_latency[n] AS latency_max,
           s_latency[least(n - 1, n * 9 // 10) + 1] AS latency_p90, round(mt, 1) AS tokens_median, round(1000 * mc, 2) AS cost_per_1k
    FROM g LEFT JOIN sp USING ({keys})"""


def _stats(rows, keys):
    rounded = {"cost_median": 5, "cost_q1": 5, "cost_q3": 5, "cost_p90": 5, "latency_median": 1, "tokens_median": 1, "cost_per_1k": 2}
    found = runs.arm_stats(rows, keys)
    return found.select(*keys, "n_runs", "n_questions", "accuracy_mean", "zero_rate", "repeat_spread",
                        *[F.round(c, d).alias(c) for c, d in rounded.items()], "latency_min", "latency_max", "latency_p90")


@query("arm_stats", oracle(_stats_sql("scored", "arm"), "scored"))
def arm_stats(spark, folder):
    return _stats(scored(spark, folder), ["arm"])


@query("arm_stratum_stats", oracle(_stats_sql("strata", "arm, empirical_stratum"), "strata"))
def arm_stratum_stats(spark, folder):
    return _stats(runs.strata(scored(spark, folder), "baseline", 0.25), ["arm", "empirical_stratum"])


@query("pareto_frontier", oracle("""
    WITH p AS (SELECT arm || '-' || question_id AS option, round(avg(cost), 6) AS cost, round(avg(accuracy), 4) AS accuracy
               FROM scored GROUP BY 1)
    SELECT option, cost, accuracy, NOT EXISTS (SELECT 1 FROM p q WHERE q.option <> p.option AND q.accuracy >= p.accuracy
           AND q.cost <= p.cost AND (q.accuracy > p.accuracy OR q.cost < p.cost)) AS on_frontier FROM p""", "scored"))
def pareto_frontier(spark, folder):
    points = scored(spark, folder).groupBy(F.concat_ws("-", "arm", F.col("question_id").cast("string")).alias("option")).agg(
        F.round(F.avg("cost"), 6).alias("cost"), F.round(F.avg("accuracy"), 4).alias("accuracy"))
    return runs.pareto(points)


@query("breakeven", oracle("""
    WITH p AS (SELECT arm, avg(accuracy) AS a, median(cost) AS c, avg(CASE WHEN accuracy < 1 THEN 1.0 ELSE 0.0 END) AS f
               FROM scored GROUP BY arm)
    SELECT x.arm, round(x.c - b.c, 4) AS extra_cost, round(b.f, 4) AS baseline_flawed_rate, round(x.a - b.a, 4) AS accuracy_gain,
           CASE WHEN x.a > b.a THEN round((x.c - b.c) / (x.a - b.a), 4) END AS cost_per_flaw
    FROM p x, p b WHERE b.arm = 'baseline' AND x.arm <> 'baseline'""", "scored"))
def breakeven(spark, folder):
    return runs.breakeven(scored(spark, folder), "baseline")


define("pairs", """SELECT r.run_id, r.question_id, r.arm, first_cost, r.cost AS replay_cost, r.cached_share FROM runs r JOIN (
    SELECT question_id, arm, arg_max(cost, run_id) AS first_cost FROM runs WHERE phase = 'main' AND repeat = 1 GROUP BY ALL)
    USING (question_id, arm) WHERE phase = 'replay'""", "runs")


def _pairs(spark, folder):
    every = all_runs(spark, folder)
    return runs.replay_pairs(every.filter("phase = 'main' AND repeat = 1"), every.filter("phase = 'replay'"))


@query("replay_pairs", oracle("""
    SELECT run_id, question_id, arm, round(first_cost, 6) AS first_cost, round(replay_cost, 6) AS replay_cost FROM pairs""", "pairs"))
def replay_pairs(spark, folder):
    return _pairs(spark, folder).select("run_id", "question_id", "arm", F.round("first_cost", 6).alias("first_cost"),
                                        F.round("replay_cost", 6).alias("replay_cost"))


@query("replay_summary", oracle("""
    SELECT arm, count(*) AS pairs, round(1000 * median(first_cost), 2) AS first_per_1k, round(1000 * median(replay_cost), 2) AS replay_per_1k,
           round(100 * (median(replay_cost) - median(first_cost)) / median(first_cost), 1) AS change_pct,
           round(median(cached_share), 4) AS cached_share FROM pairs GROUP BY arm""", "pairs"))
def replay_summary(spark, folder):
    return runs.replay_summary(_pairs(spark, folder))


@query("hit_rate", """
    WITH i AS (SELECT role AS arm, conv_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)\\b(the|de)\\b')) AS h
               FROM conversations GROUP BY ALL)
    SELECT arm, CAST(sum(n) AS BIGINT) AS answers, CAST(sum(h) AS BIGINT) AS hits,
           CAST(CASE WHEN arm = 'system' THEN sum(n) - sum(h) ELSE sum(h) END AS BIGINT) AS "right", count(*) AS items,
           count(*) FILTER (h > 0) AS any_hit, round(CASE WHEN arm = 'system' THEN sum(n) - sum(h) ELSE sum(h) END / sum(n), 4) AS rate,
           (SELECT round(1000 * median(length(text) / 100000), 3) FROM conversations c WHERE c.role = arm) AS cost_per_1k
    FROM i GROUP BY arm""")
def hit_rate(spark, folder):
    answers = table(spark, folder, "conversations").select(F.col("role").alias("arm"), F.col("conv_id").alias("item"), "text",
                                                             (F.length("text") / 100000).alias("cost"))
    return runs.hit_rate(answers, r"(?i)\b(the|de)\b", "system").withColumn("cost_per_1k", F.round("cost_per_1k", 3))


@query("probe_summary", oracle("""
    SELECT scenario, arm, count(*) AS runs, min(latency) AS latency_min, max(latency) AS latency_max, min(tokens) AS tokens_min,
           max(tokens) AS tokens_max, median(latency) AS latency_median, median(tokens) AS tokens_median FROM runs GROUP BY ALL""", "runs"))
def probe_summary(spark, folder):
    return runs.probe_summary(all_runs(spark, folder), ["scenario", "arm"], ["latency", "tokens"])


# Answers: what an agent said about each record, and what the address it cited leads to.
define("answers", """SELECT *, CASE tag_1 WHEN 'Securities' THEN CASE WHEN starts_with(reference, 'See') THEN
      'HTTPS://Example.COM' || regexp_extract(reference, '(/rule/[0-9]+)', 1) || '/' ELSE 'https://example.org/other/0' END
      WHEN 'Merchandise' THEN NULL ELSE 'https://example.org/other/' || requirements % 4 END AS baseline_url,
    CASE tag_2 WHEN 'Privacy' THEN '' WHEN 'Antitrust' THEN '01/09/2026' WHEN 'Marketing' THEN '1 March 2001' ELSE compliance_date END
      AS claimed FROM recs""", "recs")
define("outcomes", """SELECT *, CASE WHEN citation = 'citation_fabricated' THEN citation END AS e1,
    CASE WHEN date_outcome = 'date_wrong' THEN date_outcome END AS e2, CASE WHEN violation THEN 'violation' END AS e3 FROM (
    SELECT *, CASE WHEN compliance_date = '' THEN 'not_applicable' WHEN claimed = '' THEN 'date_missing'
             WHEN citation <> 'citation_correct' THEN 'date_uncertain_attribution' WHEN claimed = '01/09/2026' THEN 'date_unparseable'
             WHEN claimed = compliance_date OR (claimed = '1 March 2001' AND compliance_date = '2001-03-01') THEN 'date_correct'
             ELSE 'date_wrong' END AS date_outcome,
           CASE WHEN country = '' AND bloc = '' THEN 'not_applicable' WHEN update_type = 'enforcement' THEN 'violation'
                WHEN update_type = 'final rule' THEN 'compliant' ELSE 'uncertain' END AS obligation,
           NOT (country = '' AND bloc = '') AND update_type = 'enforcement' AND urgency / 10 >= 0.7 AND impact > 3 AND relevance > 2 AS violation
    FROM (SELECT *, CASE WHEN baseline_url IS NULL THEN 'citation_missing' WHEN starts_with(baseline_url, 'HTTPS') THEN 'citation_correct'
                 WHEN baseline_url LIKE '%/0' THEN 'citation_alternative_real' WHEN baseline_url LIKE '%/2' THEN 'citation_fabricated'
                 ELSE 'citation_unverifiable' END AS citation FROM answers))""", "answers")


def outcomes(spark, folder):
    rule = F.regexp_extract(F.get("reg_references.rules", F.lit(0)), "(/rule/[0-9]+)", 1)
    other = F.lit("https://example.org/other/")
    cited = (
        F.when(F.col("tag_1") == "Securities", F.when(rule != "", F.concat(F.lit("HTTPS://Example.COM"), rule, F.lit("/")))
               .otherwise(F.concat(other, F.lit("0"))))
        .when(F.col("tag_1") != "Merchandise", F.concat(other, (F.col("requirements") % 4).cast("string"))))
    claimed = (F.when(F.col("tag_2") == "Privacy", "").when(F.col("tag_2") == "Antitrust", "01/09/2026")
               .when(F.col("tag_2") == "Marketing", "1 March 2001").otherwise(F.col("critical_dates.compliance_date")))
    truth = F.flatten(F.transform("reg_references.rules", urls.extract_urls))
    answers = records(spark, folder, "tag_1", "tag_2", "requirements", "country", "bloc").select(
        "record_id", "update_type", "scores", "country", "bloc", cited.alias("baseline_url"), claimed.alias("claimed"),
        truth.alias("ground_truth"), F.col("critical_dates.compliance_date").alias("truth_date"))
    # Recorded statuses of the addresses that were cited.
    statuses = answers.filter(F.col("baseline_url").startswith("https")).select(F.col("baseline_url").alias("url")).distinct().withColumn(
        "status", F.when(F.col("url").endswith("/0"), "resolves").when(F.col("url").endswith("/2"), "not_found")
        .when(F.col("url").endswith("/1"), "unverifiable"))
    found = verdicts.citation_outcome(answers, statuses)
    found = found.withColumn("date_outcome", verdicts.date_outcome(F.col("truth_date"), F.col("claimed"), F.col("citation")))
    given = F.when(F.col("update_type") == "enforcement", "violation").when(F.col("update_type") == "final rule", "compliant")
    eligible = (F.col("country") != "") | (F.col("bloc") != "")
    found = found.withColumn("obligation", verdicts.obligation_outcome(eligible, given))
    score = lambda n: F.col(f"scores.{n}.score")
    return found.withColumn("violation", verdicts.obligation_failed(
        F.col("obligation"), score("urgency") / 10, score("impact") > 3, score("relevance") > 2))


@query("citation_outcome", oracle("SELECT record_id, citation FROM outcomes", "outcomes"))
def citation_outcome(spark, folder):
    return outcomes(spark, folder).select("record_id", "citation")


@query("date_outcome", oracle("SELECT record_id, date_outcome FROM outcomes", "outcomes"))
def date_outcome(spark, folder):
    return outcomes(spark, folder).select("record_id", "date_outcome")


@query("obligation_outcome", oracle("SELECT record_id, obligation, violation AS is_failure FROM outcomes", "outcomes"))
def obligation_outcome(spark, folder):
    return outcomes(spark, folder).select("record_id", "obligation", F.col("violation").alias("is_failure"))


def _evidence():
    return verdicts.evidence(F.col("citation"), F.col("date_outcome"), F.col("obligation"), F.col("violation"))


@query("failure_bar", oracle("""
    SELECT record_id, concat_ws(',', e1, e2, e3) AS evidence, concat_ws(',', e1, e2, e3) <> '' AS admitted FROM outcomes""", "outcomes"))
def failure_bar(spark, folder):
    return outcomes(spark, folder).select("record_id", F.array_join(_evidence(), ",").alias("evidence"),
                                          (F.size(_evidence()) > 0).alias("admitted"))


@query("outcome_dist", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS scorer, {c} AS outcome, count(*) AS n FROM outcomes GROUP BY 2" for c in ("citation", "date_outcome", "obligation")),
    "outcomes"))
def outcome_dist(spark, folder):
    return verdicts.outcome_counts(outcomes(spark, folder), ["citation", "date_outcome", "obligation"])


@query("verdict_validate", oracle("""
    SELECT record_id, 'o' || g AS obligation_id, CASE WHEN state = 'given' THEN v ELSE 'uncertain' END AS verdict,
           CASE WHEN state = 'given' THEN round(c, 4) ELSE 0.0 END AS confidence, state FROM (
      SELECT record_id, g, c, ['violation', 'compliant', 'violation', ''][g] AS v,
             CASE WHEN tag_2 = 'Antitrust' OR g = 4 THEN 'omitted' WHEN g = 1 THEN 'given' WHEN g = 2 AND c <= 1 THEN 'given'
                  WHEN g = 3 AND tag_1 = 'Securities' THEN 'given' ELSE 'discarded' END AS state
      FROM (SELECT *, CASE g WHEN 1 THEN urgency / 10 WHEN 2 THEN impact / 8 WHEN 3 THEN 1 ELSE 0 END AS c
            FROM records, (VALUES (1), (2), (3), (4)) t(g)))""", "records"))
def verdict_validate(spark, folder):
    """One JSON reply per record: a repeated id, a number out of range, a truth value or text as confidence,
    an unknown id and a missing one; some replies are cut off."""
    score = lambda n: F.col(f"scores.{n}.score")
    entry = lambda i, verdict, confidence: F.concat(
        F.lit('{"obligation_id":"' + i + '","verdict":"' + verdict + '","confidence":'), confidence,
        F.lit(',"applies_to_draft":true,"omission_material":true}'))
    third = (F.when(F.col("tag_1") == "Securities", "1").when(F.col("tag_1") == "Merchandise", "true").otherwise('"0.9"'))
    listed = F.concat_ws(",", entry("o1", "violation", (score("urgency") / 10).cast("string")), entry("o1", "compliant", F.lit("0.9")),
                         entry("o2", "compliant", (score("impact") / 8).cast("string")), entry("zz", "violation", F.lit("0.5")),
                         entry("o3", "violation", third))
    whole = F.concat(F.lit('{"verdicts":['), listed, F.lit("]}"))
    reply = F.when(F.col("tag_2") == "Antitrust", F.lit('{"verdicts":[')).otherwise(whole)
    rows = records(spark, folder, "tag_1", "tag_2").select(
        "record_id", reply.alias("response"), F.array(*[F.lit(f"o{i}") for i in (1, 2, 3, 4)]).alias("requested"))
    return verdicts.validate_verdicts(rows).select("record_id", "obligation_id", "verdict", F.round("confidence", 4).alias("confidence"), "state")


def published(spark, folder):
    """Records in the published form, several of them faulty."""
    failure = lambda mode, stage, rationale: F.struct(mode.alias("mode"), F.lit(stage).alias("stage"), rationale.alias("judge_rationale"))
    kind = F.col("update_type")
    none = F.lit(None).cast("string")
    missed = failure(F.lit("missed_obligation"), "A", F.when(F.col("country") != "US", "stated"))
    wrong = failure(F.lit("date_wrong"), "B", none)
    failures = (F.when(kind == "enforcement", F.array(missed)).when(kind == "final rule", F.array(wrong))
                .when(kind == "proposed rule", F.array(missed, failure(F.lit("date_wrong"), "A", none)))
                .otherwise(F.array_remove(F.array(wrong), wrong)))
    confirm = F.when(kind.isin("enforcement", "proposed rule"), F.col("impact") > 2)
    rows = records(spark, folder, "impact", "country", "requirements")
    return rows.select(
        "record_id", "title", F.coalesce("regulator_name", F.lit("")).alias("regulator_name"), "update_type",
        "impact_summary.what_changed", "impact_summary.why_it_matters", F.col("scores.impact.label").alias("impact_label"),
        F.lit("A").alias("scenario"),
        F.col("impact_summary.key_requirements").alias("key_requirements"),
        F.struct(F.lit("law").alias("name"), F.col("link").alias("url")).alias("citation"),
        F.struct(F.lit("2001-08-01").alias("snapshot_date")).alias("source"), failures.alias("baseline_failures"),
        F.struct(F.lit("Ada").alias("reviewer"), F.when(F.col("topic_name") == "NATION_3", "rejected").otherwise("approved").alias("attestation"),
                 *[confirm.alias(c) for c in verdicts.CONFIRMATIONS]).alias("human_review"),
        F.col("impacted_business.industry").alias("industry"), F.col("impacted_functions").alias("functions"), "country", "topic_jurisdiction_code",
        F.col("critical_dates.compliance_date").alias("compliance_date"))


_MISSED = "update_type IN ('enforcement', 'proposed rule')"


@query("stage_b_filter", oracle("SELECT record_id FROM records WHERE update_type IN ('final rule', 'proposed rule')", "records"))
def stage_b_filter(spark, folder):
    return published(spark, folder).filter(verdicts.has_stage_b_failure(F.col("baseline_failures"))).select("record_id")


@query("ledger_check", """
    SELECT doc_id, scorer FROM (SELECT doc_id, unnest(['quality', 'toxic', 'length']) AS scorer, n_chars FROM documents) d
    WHERE NOT (scorer = 'length' AND n_chars <= 5000)
      AND NOT (scorer IN ('quality', 'toxic') AND doc_id IN (SELECT doc_id FROM labels))""")
def ledger_check(spark, folder):
    """Expected scores of every document against those recorded; very long documents have no finite length score."""
    docs = table(spark, folder, "documents")
    expected = docs.select("doc_id", F.explode(F.array(F.lit("quality"), F.lit("toxic"), F.lit("length"))).alias("scorer"))
    labels = table(spark, folder, "labels").selectExpr("doc_id", "stack(2, 'quality', double(quality), 'toxic', double(toxic)) AS (scorer, score)")
    length = docs.select("doc_id", F.lit("length").alias("scorer"), F.when(F.col("n_chars") > 5000, float("inf"))
                         .otherwise(F.col("n_chars").cast("double")).alias("score"))
    return verdicts.ledger_gaps(expected, labels.unionByName(length), ["doc_id", "scorer"])


PROBES = ["o_orderkey AS probe_id", "CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS arm", "o_custkey AS round",
          "o_orderpriority = '5-LOW' AND o_totalprice > 450000 AS disqualified", "o_totalprice > 400000 AS fabricated",
          "o_totalprice <= 400000 AND o_totalprice > 300000 AS wrong", "o_orderpriority = '1-URGENT' AS violates"]
define("probes", "SELECT " + ", ".join(PROBES) + " FROM orders")


def probes(spark, folder):
    modes = F.array_compact(F.array(F.when(F.col("fabricated"), "citation_fabricated"), F.when(F.col("wrong"), "date_wrong"),
                                    F.when(F.col("violates"), "violation")))
    return table(spark, folder, "orders").selectExpr(*PROBES).withColumn("modes", modes)


@query("paired_rounds", oracle("""
    SELECT probe_id FROM probes WHERE round NOT IN (SELECT round FROM probes WHERE disqualified)""", "probes"))
def paired_rounds(spark, folder):
    return curation.paired_rounds(probes(spark, folder)).select("probe_id")


@query("scenario_winner", oracle("""
    WITH k AS (SELECT *, fabricated::INT + wrong::INT + violates::INT AS m FROM probes WHERE round NOT IN (SELECT round FROM probes WHERE disqualified)),
    s AS (SELECT arm, count(*) AS completed, round(avg(m), 4) AS strength, count(*) FILTER (m > 0) AS survivors,
                 count(*) FILTER (violates) AS stage_a_survivors FROM k GROUP BY arm)
    SELECT s.*, p.planned, (SELECT arm FROM s ORDER BY strength DESC, arm LIMIT 1) AS winner
    FROM s JOIN (SELECT arm, count(*) AS planned FROM probes GROUP BY arm) p USING (arm)""", "probes"))
def scenario_winner(spark, folder):
    return curation.scenario_decision(probes(spark, folder), 30)


@query("sweep_until", oracle("""
    WITH p AS (SELECT *, row_number() OVER (ORDER BY probe_id) AS position, fabricated OR wrong OR violates AS survivor FROM probes
               QUALIFY position <= 900),
    c AS (SELECT *, sum(survivor::INT) OVER (ORDER BY position) AS survivors FROM p)
    SELECT probe_id, CAST(position AS INT) AS position, CAST(survivors AS BIGINT) AS survivors, 'target_reached' AS stop_reason
    FROM c WHERE survivors - survivor::INT < 200""", "probes"))
def sweep_until(spark, folder):
    ordered = probes(spark, folder).withColumn("survivor", F.size("modes") > 0)
    return curation.sweep(ordered, [F.col("probe_id")], 200, 900).select("probe_id", "position", "survivors", "stop_reason")


@query("stratified_prefix", oracle("""
    WITH s AS (SELECT record_id, coalesce(nullif(update_type, ''), 'unknown') || '|'
                      || CASE WHEN country IN ('US', 'FR', 'CA', 'CN', 'AU', 'DE', 'GB', 'IT', 'CH', 'NL') THEN country ELSE 'other' END || '|'
                      || CASE WHEN length(CAST(pub_date AS VARCHAR)) >= 7 THEN substr(CAST(pub_date AS VARCHAR), 1, 7) ELSE 'unknown' END AS stratum FROM records),
    h AS (SELECT *, CAST('0x' || substr(md5('42|' || record_id), 1, 13) AS BIGINT) / 16.0::DOUBLE ** 13 AS hash,
                 1 - CAST('0x' || substr(md5('42|stratum|' || stratum), 1, 13) AS BIGINT) / 16.0::DOUBLE ** 13 AS u FROM s),
    p AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY hash, record_id) - u) / count(*) OVER (PARTITION BY stratum) AS place FROM h)
    SELECT record_id, stratum, CAST(row_number() OVER (ORDER BY place, stratum, record_id) AS INT) AS position FROM p
    QUALIFY position <= 200""", "records"))
def stratified_prefix(spark, folder):
    """A proportional sample of the records; strata are type, place and month."""
    rows = feed(spark, folder).select("record_id", curation.stratum(
        F.col("update_type"), F.col("country"), F.col("pub_date")).alias("stratum"))
    return curation.stratified_prefix(rows, "record_id", "stratum", 200).select("record_id", "stratum", "position")


def firms(spark, folder):
    """One firm profile per customer segment, place and function seen in the records."""
    return feed(spark, folder).select(
        "country", "bloc", F.array("industry").alias("industry"), F.col("industry").alias("sector"),
        F.array("topic_function").alias("functions")).distinct().withColumn(
        "profile_id", F.concat_ws("/", "country", "bloc", "sector", F.col("functions")[0]))


def obligations(spark, folder):
    return feed(spark, folder).select(
        "record_id", "country", "bloc", F.array("industry").alias("industry"), F.array("topic_function").alias("functions"),
        F.col("critical_dates.compliance_date").alias("compliance_date"))


define("firms", "SELECT DISTINCT concat_ws('/', country, bloc, industry, topic_function) AS profile_id, country, bloc, industry, topic_function FROM records", "records")
define("narrowed", f"""SELECT profile_id, record_id, row_number() OVER (PARTITION BY profile_id ORDER BY value DESC, due, record_id) AS position FROM (
    SELECT f.profile_id, r.record_id, CASE WHEN compliance_date = '' THEN '9999-99-99' ELSE compliance_date END AS due,
           (r.industry = f.industry)::INT + (r.topic_function = f.topic_function)::INT + CASE WHEN compliance_date = '' THEN 0
             WHEN CAST(compliance_date AS DATE) - DATE '{AS_OF}' <= 180 THEN 2 ELSE 1 END AS value
    FROM firms f JOIN records r ON ((r.country <> '' AND r.country = f.country) OR (r.bloc <> '' AND r.bloc = f.bloc))
      AND (r.industry = f.industry OR r.topic_function = f.topic_function)) QUALIFY position <= 5""".replace(
    "CAST(compliance_date AS DATE)", "CAST(nullif(compliance_date, '') AS DATE)"), "firms", "records")


@query("narrow_top5", oracle("SELECT profile_id, record_id, CAST(position AS INT) AS position FROM narrowed", "narrowed"))
def narrow_top5(spark, folder):
    return curation.narrow(firms(spark, folder), obligations(spark, folder), AS_OF).select("profile_id", "record_id", "position")


@query("narrow_obligations", oracle("""
    SELECT profile_id, count(*) AS candidates FROM (
      SELECT DISTINCT f.profile_id, r.record_id FROM firms f JOIN records r
        ON ((r.country <> '' AND r.country = f.country) OR (r.bloc <> '' AND r.bloc = f.bloc))
       AND (r.industry = f.industry OR r.topic_function = f.topic_function)) GROUP BY profile_id""", "firms", "records"))
def narrow_obligations(spark, folder):
    """How many records concern each firm; records count by their tags and place, so no pair of record and
    firm is built."""
    keys = ["country", "bloc", "industry", "functions"]
    classes = obligations(spark, folder).groupBy(*keys).agg(F.count("*").alias("n"))
    shaped = classes.select(F.concat_ws("/", "country", "bloc", F.col("industry")[0], F.col("functions")[0]).alias("record_id"),
                            *keys, F.lit("").alias("compliance_date"))
    pairs = curation.matching_classes(firms(spark, folder), shaped)
    sizes = classes.select(F.concat_ws("/", "country", "bloc", F.col("industry")[0], F.col("functions")[0]).alias("record_id"), "n")
    return pairs.join(sizes, "record_id").groupBy("profile_id").agg(F.sum("n").alias("candidates"))


@query("scoreboard", oracle(f"""
    SELECT part, count(*) AS n, round(avg(blocked), 4) AS blocked_rate, round(avg(caught), 4) AS catch_rate FROM (
      SELECT r.record_id, CASE WHEN NOT ({_MISSED} AND impact > 2) THEN 'knowledge_only' WHEN k.record_id IS NOT NULL THEN 'scored'
             ELSE 'crowded_out' END AS part, (urgency > 5)::INT AS blocked, (urgency > 5 AND relevance > 5)::INT AS caught
      FROM records r LEFT JOIN narrowed k ON k.record_id = r.record_id
        AND k.profile_id = concat_ws('/', r.country, r.bloc, r.industry, r.topic_function)) GROUP BY part""", "records", "narrowed"))
def scoreboard(spark, folder):
    """Published records by whether their own firm's narrowing keeps them, with mean delivery scores."""
    rows = feed(spark, folder).select(
        "record_id", F.concat_ws("/", "country", "bloc", "industry", "topic_function").alias("profile_id"),
        (F.col("scores.urgency.score") > 5).alias("blocked"), (F.col("scores.relevance.score") > 5).alias("named"))
    predicts = published(spark, folder).select("record_id", verdicts.predicts_block(
        F.col("baseline_failures"), F.col("human_review")).alias("predicts"))
    top = narrow_top5(spark, folder).withColumn("kept", F.lit(True))
    joined = rows.join(predicts, "record_id").join(top, ["record_id", "profile_id"], "left")
    part = (F.when(~F.col("predicts"), "knowledge_only").when(F.coalesce("kept", F.lit(False)), "scored").otherwise("crowded_out"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    return joined.groupBy(part.alias("part")).agg(
        F.count("*").alias("n"), rate(F.col("blocked")).alias("blocked_rate"), rate(F.col("blocked") & F.col("named")).alias("catch_rate"))

