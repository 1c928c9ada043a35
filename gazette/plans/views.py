"""The test tables seen as regulatory data: records, contracts, runs, signals and so on.

Scalar columns are plain SQL that reads the same in Spark and in DuckDB, so both sides start from the same
values. Everything after them is written twice: with DataFrame operators here, in SQL next to each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.session import table

AS_OF = "2001-08-01"

# Jurisdiction code of each nation; 20 is no valid code on purpose and the rest have none.
CODES = {
    0: "ZA", 1: "US-CA", 2: "JP", 3: "FR", 4: "AE", 5: "KE", 6: "US-NY", 7: "SG", 8: "DE", 9: "SA", 10: "NG",
    11: "US-TX", 12: "IN", 13: "GB", 14: "IL", 15: "EG", 16: "US-NV", 17: "KR", 18: "EU", 19: "QA", 20: "APAC",
    21: "US", 22: "HK", 23: "MT",
}
_CODE = "CASE n_nationkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CODES.items()) + " ELSE '' END"
_DAY = "CAST(o_orderdate AS DATE)"

RECORD_SCALARS = {
    "record_id": "CAST(o_orderkey AS STRING)",
    "seq": "o_orderkey",
    "topic_id": "CAST(n_nationkey AS STRING)",
    "topic_name": "n_name",
    "regulator_name": "CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE concat('Agency of ', n_name) END",
    "regulator_division": "CASE WHEN o_orderstatus = 'P' THEN concat(c_mktsegment, ' Division') ELSE '' END",
    "update_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'enforcement' WHEN '2-HIGH' THEN 'final rule' "
                   "WHEN '3-MEDIUM' THEN 'proposed rule' WHEN '4-NOT SPECIFIED' THEN 'other' "
                   "ELSE 'press release' END",
    "title": "CASE WHEN o_orderkey % 101 = 0 THEN '' "
             "ELSE concat(c_mktsegment, ' notice ', CAST(o_custkey % 50 AS STRING)) END",
    "link": "CASE WHEN o_orderkey % 103 = 0 THEN '' "
            "ELSE concat('https://example.com/', CAST(o_orderkey AS STRING)) END",
    "pub_date": f"CAST({_DAY} AS STRING)",
    "pub_date_valid": "o_orderkey % 17 <> 0",
    "urgency": "CAST(o_orderkey % 11 AS DOUBLE)",
    "impact": "CAST(o_custkey % 11 AS DOUBLE)",
    "relevance": "CAST((o_orderkey + o_custkey) % 11 AS DOUBLE)",
    "jurisdiction_code": _CODE,
    "tier_label": "CASE WHEN n_regionkey = 1 THEN 'us_federal' ELSE 'international' END",
    "impacted_1": _CODE,
    "impacted_2": "CASE o_orderstatus WHEN 'F' THEN 'US' WHEN 'O' THEN 'CA' ELSE 'US-NY' END",
    "entity_1": "c_mktsegment",
    "entity_2": "r_name",
    "entity_3": "concat('Agency of ', n_name)",
    "tag_1": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Artificial Intelligence' WHEN 'BUILDING' THEN 'Fair Lending' "
             "WHEN 'FURNITURE' THEN 'Merchandise' WHEN 'MACHINERY' THEN 'Machine Learning' ELSE 'Securities' END",
    "tag_2": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Data Breach' WHEN '2-HIGH' THEN 'Marketing' "
             "WHEN '3-MEDIUM' THEN 'Privacy' WHEN '4-NOT SPECIFIED' THEN 'Antitrust' ELSE 'Retail AI' END",
    "country": f"CASE WHEN n_nationkey = 18 OR n_nationkey = 20 OR n_nationkey = 24 THEN '' "
               f"ELSE substring({_CODE}, 1, 2) END",
    "bloc": "CASE WHEN r_name = 'EUROPE' THEN 'EU' ELSE '' END",
    "effective_date": f"CASE WHEN o_orderstatus = 'O' THEN CAST({_DAY} + CAST(o_custkey % 400 AS INT) AS STRING) "
                      "ELSE '' END",
    "comment_deadline": f"CASE WHEN o_orderstatus = 'P' THEN CAST({_DAY} + CAST(o_custkey % 60 + 1 AS INT) AS STRING) "
                        "ELSE '' END",
    "compliance_date": f"CASE WHEN c_acctbal > 5000 THEN CAST({_DAY} + CAST(o_custkey % 300 AS INT) AS STRING) "
                       "ELSE '' END",
    "summary": "concat('Action ', CAST(o_orderkey AS STRING), CASE o_orderstatus "
               "WHEN 'F' THEN concat(' fined $', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' and $', "
               "CAST(o_custkey % 40 AS STRING), ' million') "
               "WHEN 'O' THEN concat(' cites EUR ', CAST(o_custkey % 90 + 1 AS STRING), 'k') ELSE '' END)",
    "what_changed": "concat('Update to ', lower(c_mktsegment), ' rules')",
    "why_it_matters": "CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('Affects ', r_name, ' firms') END",
    "requirement": "CASE WHEN c_acctbal < 0 THEN ' ' ELSE 'File a report' END",
    "requirements": "CAST(o_custkey % 5 AS INT)",
    "reference": "CASE WHEN o_custkey % 3 = 0 THEN 'No reference' "
                 "ELSE concat('See (https://example.com/rule/', CAST(o_custkey % 200 AS STRING), ').') END",
    "industry": "c_mktsegment",
    "topic_function": "CASE o_orderstatus WHEN 'F' THEN 'Compliance' WHEN 'O' THEN 'Marketing' ELSE 'Legal' END",
}

# Free text of a feed entry, so that keyword rules have something to find.
FEED_SCALARS = {
    "feed_text": "concat(CASE o_custkey % 12 WHEN 0 THEN 'Field safety recall by the FDA' "
                 "WHEN 1 THEN 'New ISO 14971 amendment, effective January 2027' "
                 "WHEN 2 THEN 'Draft guidance from MHRA due Q3 2026' WHEN 3 THEN 'Customs tariff notice' "
                 "WHEN 4 THEN 'Adverse event signal for cardiac pacemaker' WHEN 5 THEN 'EU MDR directive' "
                 "WHEN 6 THEN 'Novel device approved, FDA and Swissmedic' WHEN 7 THEN 'Speech on consumer matters' "
                 "WHEN 8 THEN 'ARTG de novo entry by TGA' WHEN 9 THEN 'Proposed rule expected in march 2028' "
                 "WHEN 10 THEN 'ANSM and BfArM vigilance report' ELSE 'Market letter' END, ' for ', lower(c_mktsegment))",
    "feed_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Recall' WHEN '2-HIGH' THEN 'guidance' "
                 "WHEN '3-MEDIUM' THEN 'standard' ELSE '' END",
    "similarity": "CAST(o_orderkey % 40 AS DOUBLE) / 100.0",
    "agency": "CASE o_orderpriority WHEN '1-URGENT' THEN 'FTC' WHEN '2-HIGH' THEN 'SEC' ELSE n_name END",
}
RECORD_SCALARS.update(FEED_SCALARS)

CONTRACT_SCALARS = {
    "contract_id": "concat('C', CAST(n_nationkey AS STRING))",
    "nation_key": "n_nationkey",
    "platform": "CASE WHEN n_regionkey % 2 = 0 THEN 'east' ELSE 'west' END",
    "kind": "CASE WHEN n_nationkey % 4 = 0 THEN 'retrospective' ELSE 'active' END",
    "title": "concat('Will ', n_name, ' act?')",
    "entity_1": "n_name",
    "entity_2": "r_name",
    "listed_at": f"CAST(DATE '{AS_OF}' - 30 * (n_nationkey + 3) AS STRING)",
    "resolved_at": f"CASE WHEN n_nationkey % 4 = 0 THEN CAST(DATE '{AS_OF}' - 7 * n_nationkey AS STRING) ELSE '' END",
    "expires_at": f"CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE CAST(DATE '{AS_OF}' + 20 * n_nationkey AS STRING) END",
}

_DUCK = {
    "records": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in RECORD_SCALARS.items())
               + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
                 " JOIN region ON n_regionkey = r_regionkey",
    "contracts": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in CONTRACT_SCALARS.items())
                 + " FROM nation JOIN region ON n_regionkey = r_regionkey",
    # Records with the derived columns most queries want.
    "recs": f"""SELECT *, CASE WHEN pub_date_valid THEN CAST(pub_date AS DATE) END AS day,
        CASE WHEN pub_date_valid THEN DATE '{AS_OF}' - CAST(pub_date AS DATE) END AS age,
        update_type <> 'other' AND relevance >= 5 AND trim(title) <> '' AND trim(link) <> '' AS substantive,
        CASE WHEN regexp_matches(CASE WHEN jurisdiction_code <> '' THEN jurisdiction_code ELSE impacted_1 END,
                 '^([A-Z]{{2}}|[A-Z]{{2}}-[A-Z0-9]{{1,3}})$')
             THEN CASE WHEN jurisdiction_code <> '' THEN jurisdiction_code ELSE impacted_1 END END AS code,
        CASE WHEN coalesce(regulator_name, '') <> '' AND regulator_division <> ''
             THEN regulator_name || ' — ' || regulator_division
             WHEN coalesce(regulator_name, '') <> '' THEN regulator_name ELSE topic_name END AS regulator
        FROM records""",
    "entity_rows": "SELECT record_id, trim(lower(unnest([entity_1, entity_2, entity_3]))) AS entity FROM records",
    "contract_rows": "SELECT contract_id, 0 AS pos, entity_1 AS name FROM contracts "
                     "UNION ALL SELECT contract_id, 1, entity_2 FROM contracts",
    # A naive theta join of every contract entity with every distinct record entity.
    "links": """SELECT contract_id, pos, name, entity FROM contract_rows,
        (SELECT DISTINCT entity FROM entity_rows) e
        WHERE lower(name) = entity
           OR regexp_matches(entity, '\\b' || regexp_escape(lower(name)) || '\\b')
           OR regexp_matches(lower(name), '\\b' || regexp_escape(entity) || '\\b')""",
    "matches": """SELECT contract_id, record_id, min(pos) AS pos FROM links JOIN entity_rows USING (entity)
        GROUP BY contract_id, record_id""",
}
_NEEDS = {
    "recs": ["records"], "entity_rows": ["records"], "contract_rows": ["contracts"],
    "links": ["contract_rows", "entity_rows"], "matches": ["links", "entity_rows"],
}


def define(name: str, sql: str, *needs: str) -> None:
    """Add a view that oracle statements can name."""
    _DUCK[name] = sql
    _NEEDS[name] = list(needs)


def oracle(body: str, *names: str) -> str:
    """A DuckDB statement with the named views, and the ones they need, in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    if not ordered:
        return body
    views = ", ".join(f"{n} AS ({_DUCK[n]})" for n in ordered)
    return f"WITH {views}, " + body[4:].lstrip() if body.upper().startswith("WITH") else f"WITH {views} {body}"


def _scalars(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    places = table(spark, folder, "nation").join(
        F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in RECORD_SCALARS.items()])


def _score(name: str) -> Column:
    label = F.when(F.col(name) >= 8, "high").when(F.col(name) >= 4, "medium").otherwise("low")
    return F.struct(F.col(name).alias("score"), label.alias("label")).alias(name)


def requirement_list() -> Column:
    return F.array_repeat(F.col("requirement"), F.col("requirements"))


def records(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Records in the flat record shape; `extra` keeps further scalar columns. Unused columns are pruned."""
    none = F.array().cast("array<string>")
    return _scalars(spark, folder).select(
        "record_id", "seq", "topic_id", "topic_name", "title", "link", "update_type", "regulator_name",
        "regulator_division", "pub_date", "pub_date_valid", F.col("jurisdiction_code").alias("topic_jurisdiction_code"),
        F.struct(F.col("tier_label").alias("label"), F.lit(1).alias("tier")).alias("jurisdiction_tier"),
        F.struct(_score("urgency"), _score("impact"), _score("relevance")).alias("scores"),
        F.struct(F.array("impacted_1", "impacted_2").alias("jurisdiction"), F.array("industry").alias("industry"),
                 F.array(F.col("tag_1")).alias("type")).alias("impacted_business"),
        F.array("topic_function").alias("impacted_functions"),
        F.struct("what_changed", "why_it_matters", requirement_list().alias("key_requirements")).alias("impact_summary"),
        F.struct("effective_date", "compliance_date", "comment_deadline").alias("critical_dates"),
        F.struct(F.array("reference").alias("rules"), none.alias("statutes"), none.alias("other_ref")).alias("reg_references"),
        F.array("summary").alias("penalties_consequences"),
        F.array("tag_1", "tag_2").alias("tags"),
        F.array("entity_1", "entity_2", "entity_3").alias("entities"),
        *extra,
    )


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts made of the nations."""
    base = table(spark, folder, "nation").join(
        F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (base.selectExpr(*[f"{e} AS {n}" for n, e in CONTRACT_SCALARS.items()])
            .withColumn("settlement_entities", F.array("entity_1", "entity_2")).drop("entity_1", "entity_2"))
