"""Corpus statistics: headline numbers, field audits, breakdowns, yield reports."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from gazette import vocab
from gazette.functions import dates, keywords, money, places
from gazette.functions.common import blank, text
from gazette.operators import spread

#: Critical dates that make a record a dated one.
DATE_FIELDS = ("effective_date", "compliance_date", "comment_deadline", "early_adoption_date", "updated_date")


def unpivot(row: DataFrame, names: list[str], label: str, value: str) -> DataFrame:
    """One row per named column of a frame that is already aggregated."""
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias(label), F.col(n).alias(value)) for n in names])).alias("_r")).select("_r.*")


def quality_counts(records: DataFrame, as_of: str) -> DataFrame:
    """Rows read, rows with a usable past date, rows skipped."""
    day = dates.pub_day()
    valid = F.coalesce(day <= F.lit(as_of).cast("date"), F.lit(False))
    return records.agg(F.count("*").alias("read"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("skipped"))


def headline(records: DataFrame, as_of: str, earliest: str = "2020-01-01") -> DataFrame:
    """Total, distinct topics, distinct well-formed codes, first and last plausible day."""
    code = F.trim(text(F.col("topic_jurisdiction_code")))
    day = dates.pub_day()
    plausible = F.when(day.between(F.lit(earliest).cast("date"), F.lit(as_of).cast("date")), day)
    return records.agg(
        F.count("*").alias("events"),
        F.countDistinct(F.when(~blank(F.col("topic_name")), F.col("topic_name"))).alias("topics"),
        F.countDistinct(F.when(places.valid_code(code), code)).alias("codes"),
        F.min(plausible).cast("string").alias("first_day"), F.max(plausible).cast("string").alias("last_day"))


def _filled(values: Column) -> Column:
    return F.size(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: ~blank(v)))


#: Fields that are metadata; a record without any of them was never annotated.
METADATA = ("impacted_business", "impact_summary", "reg_references", "critical_dates", "penalties_consequences", "tags")


def corpus_stats(records: DataFrame) -> DataFrame:
    """Metadata, obligations, references, critical dates, penalties, and distinct regulators and jurisdictions in one pass.

    A record is dated by any of its critical dates that the frame has a field for. References count unless they are empty, also
    those of spaces. A record's jurisdiction is its first; tags are missing where a record with metadata has none that says something.
    """
    requirements = F.greatest(F.coalesce(F.size("impact_summary.key_requirements"), F.lit(0)), F.lit(0))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    refs = sum((F.size(F.filter(texts(F.col(f"reg_references.{k}")), lambda v: text(v) != "")) for k in ("rules", "statutes", "other_ref")), F.lit(0))
    have = records.schema["critical_dates"].dataType.fieldNames()
    dated = reduce(or_, [~blank(F.col(f"critical_dates.{f}")) for f in DATE_FIELDS if f in have], F.lit(False))
    if "other_dates" in have:
        dated |= populated(F.col("critical_dates.other_dates"), "array")
    penalties = _filled(F.col("penalties_consequences"))
    mentions = money.money_mentions(F.array_join("penalties_consequences", " "))
    annotated = reduce(or_, [F.col(c).isNotNull() for c in METADATA if c in records.columns])
    place = F.trim(F.get(F.col("impacted_business.jurisdiction"), 0))
    return records.agg(
        F.count("*").alias("records"), F.count_if(annotated).alias("with_metadata"), F.sum(requirements).alias("obligations"),
        F.count_if(requirements > 0).alias("with_obligations"), F.sum(refs).alias("reg_refs"),
        F.count_if(refs > 0).alias("with_refs"), F.count_if(dated).alias("with_dates"),
        F.count_if(penalties > 0).alias("with_penalties"),
        F.count_if((penalties > 0) & (mentions > 0)).alias("with_amount"),
        F.sum(F.when(penalties > 0, mentions).otherwise(0)).alias("money_mentions"),
        F.count_if(annotated & (_filled(F.col("tags")) == 0)).alias("tags_missing"),
        F.countDistinct(F.nullif(F.trim("regulator_name"), F.lit(""))).alias("regulators"),
        F.countDistinct(F.nullif(place, F.lit(""))).alias("jurisdictions"))


def corpus_tops(records: DataFrame, sectors: DataFrame) -> DataFrame:
    """The largest sectors, topic sectors, jurisdictions and sectors by obligations, each with its own limit.

    `sectors` (topic_id, sector) is a lookup as in `sector_counts`. Topics without a sector and records without a jurisdiction
    are in no list of theirs; equal counts go by value.
    """
    own, topic = F.trim(F.get(F.col("impacted_business.industry"), 0)), F.trim("sector")
    by_topic = F.when(~blank(topic), topic)
    place = F.get(F.col("impacted_business.jurisdiction"), 0)
    sector = F.when(text(own) != "", own).otherwise(F.coalesce(by_topic, F.lit("Uncategorized")))
    one, due = F.lit(1), F.greatest(F.coalesce(F.size("impact_summary.key_requirements"), F.lit(0)), F.lit(0))
    lists = {"sector": (sector, one, 14), "topic_sector": (by_topic, one, 14),
             "jurisdiction": (F.when(place != "", F.trim(place)), one, 20), "obligations": (sector, due, 14)}
    rows = F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value"), w.alias("weight")) for n, (c, w, _) in lists.items()])
    counted = (records.join(sectors, "topic_id", "left").select(F.explode(rows).alias("p")).filter("p.value IS NOT NULL AND p.weight > 0")
               .groupBy("p.dimension", "p.value").agg(F.sum("p.weight").alias("n")))
    ranked = spread.top_per_group(counted, ["dimension"], [F.col("n").desc(), F.col("value")], 20, "rank")
    limits = F.create_map(*[F.lit(x) for n, (_, _, limit) in lists.items() for x in (n, limit)])
    return ranked.filter(F.col("rank") <= limits[F.col("dimension")])


def sector_counts(records: DataFrame, sectors: DataFrame) -> DataFrame:
    """Records and obligations per sector: own industry, else the topic's sector, else Uncategorized.

    `sectors` (topic_id, sector) is a lookup file; AQE broadcasts it when its size allows.
    """
    own = F.trim(F.get(F.col("impacted_business.industry"), 0))
    sector = (F.when(text(own) != "", own).when(~blank(F.col("sector")), F.trim("sector")).otherwise("Uncategorized"))
    joined = records.join(sectors, "topic_id", "left")
    return joined.groupBy(sector.alias("sector")).agg(
        F.count("*").alias("docs"), F.sum(F.greatest(F.size("impact_summary.key_requirements"), F.lit(0))).alias("obligations"))


def freshness(records: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Records per year of a fixed range, zeros included, and the share of the last two years."""
    year = F.year(dates.iso_day(F.col("pub_date")))
    counted = records.groupBy(year.alias("year")).agg(F.count("*").alias("n"))
    total = records.agg(F.count("*")).scalar()
    years = records.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    dense = years.join(counted, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    recent = counted.filter(F.col("year").between(last_year - 1, last_year)).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return dense.withColumn("recent_share", F.round(F.lit(100.0) * recent / total, 1))


def populated(c: Column, kind: str) -> Column:
    """Whether a value says something: no null, no false, no blank text, no empty list; zero counts."""
    if kind == "string":
        return ~blank(c)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def _has(kind: DataType, path: list[str]) -> bool:
    return not path or isinstance(kind, StructType) and path[0] in kind.fieldNames() and _has(kind[path[0]].dataType, path[1:])


def _said(records: DataFrame, path: str, kind: str) -> Column:
    """Whether a field is filled; null for a field that the frame does not have, so that a wrong path is not taken for an empty field."""
    return F.coalesce(populated(F.col(path), kind), F.lit(False)) if _has(records.schema, path.split(".")) else F.lit(None).cast("boolean")


def field_audit(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Share of records with each field filled; `fields` maps a column path to its kind.

    All fields are counters of one aggregate, turned into rows afterwards. The share of a field that the frame does not have is null.
    """
    flat = {path.replace(".", "__"): path for path in fields}
    row = records.agg(*[F.avg(_said(records, path, fields[path]).cast("double")).alias(n) for n, path in flat.items()])
    shares = unpivot(row, list(flat), "field", "share")
    return shares.select(F.regexp_replace("field", "__", ".").alias("field"),
                         F.round(100 * F.col("share"), 1).alias("percent"))


def field_audit_by_type(records: DataFrame, fields: dict[str, str], top: int = 5) -> DataFrame:
    """The audit inside each of the most frequent update types; counts of a field that the frame does not have are null."""
    flat = {path.replace(".", "__"): path for path in fields}
    per = records.groupBy("update_type").agg(F.count("*").alias("n"), *[
        F.sum(_said(records, path, fields[path]).cast("bigint")).alias(n) for n, path in flat.items()])
    best = per.orderBy(F.col("n").desc(), "update_type").limit(top)
    rows = best.select("update_type", "n", F.explode(F.array(*[
        F.struct(F.lit(path).alias("field"), F.col(n).alias("filled")) for n, path in flat.items()])).alias("r"))
    return rows.select("update_type", "r.field", "r.filled", (F.col("n") - F.col("r.filled")).alias("empty"))


def top_breakdown(records: DataFrame, dimensions: dict[str, tuple[Column, int]]) -> DataFrame:
    """The most frequent values of several dimensions, each with its own limit.

    Each record gives one row per dimension, counted in the map task before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, (c, _) in dimensions.items()])
    counted = records.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    widest = max(limit for _, limit in dimensions.values())
    ranked = spread.top_per_group(counted, ["dimension"], [F.col("n").desc(), F.col("value")], widest, "rank")
    limits = F.create_map(*[F.lit(x) for n, (_, limit) in dimensions.items() for x in (n, limit)])
    return ranked.filter(F.col("rank") <= limits[F.col("dimension")])


def yield_report(candidates: DataFrame) -> DataFrame:
    """Counts of a candidate scan by several views: failure reasons of rejected rows, month, type, place and
    affordances of accepted ones. `candidates` carries `failed` (array) and the reported columns."""
    passed = F.size("failed") == 0
    item = lambda view, c: F.struct(F.lit(view).alias("view"), c.cast("string").alias("value"))
    reasons = F.transform("failed", lambda r: item("reason", r))
    views = F.when(passed, F.array_compact(F.array(
        item("month", F.substring("pub_date", 1, 7)),
        item("update_type", F.lower(F.trim("update_type"))),
        item("place", F.coalesce(F.nullif(F.col("country"), F.lit("")), F.nullif(F.col("bloc"), F.lit("")), F.lit("?"))),
        F.when(~blank(F.col("compliance_date")), item("affordance", F.lit("compliance_date"))),
        F.when(~blank(F.col("effective_date")), item("affordance", F.lit("effective_date"))),
        F.when(F.size("penalties_consequences") > 0, item("affordance", F.lit("penalties")))))).otherwise(reasons)
    return candidates.select(F.explode(views).alias("v")).groupBy("v.view", "v.value").agg(F.count("*").alias("n"))


def domain_scores(candidates: DataFrame, min_size: int = 80) -> DataFrame:
    """How promising each industry is: few famous regulators, many regulators, many requirements.

    `candidates` has industry (array), regulator_name, requirements (count) and compliance_date.
    """
    regulator = F.coalesce(F.trim("regulator_name"), F.lit("?"))
    single = candidates.select(
        F.explode(F.transform("industry", lambda i: F.lower(F.trim(i)))).alias("domain"), regulator.alias("regulator"),
        F.col("requirements"), blank(F.col("compliance_date")).alias("undated"))
    # Counting per regulator first keeps a popular industry from meeting in one task.
    per = single.groupBy("domain", "regulator").agg(F.count("*").alias("n"), F.count_if(~F.col("undated")).alias("dated"))
    famous = F.lower(F.col("regulator")).isin(vocab.FAMOUS_REGULATORS)
    totals = per.groupBy("domain").agg(
        F.sum("n").alias("n"), F.count("*").alias("regulators"), F.sum("dated").alias("dated"),
        F.coalesce(F.sum(F.when(famous, F.col("n"))), F.lit(0)).alias("famous")).filter(F.col("n") >= min_size)
    medians = spread.median(single, ["domain"], "requirements", "median_requirements")
    obscurity = 1 - F.col("famous") / F.col("n")
    reach = F.least(F.col("median_requirements"), F.lit(8.0)) / 8
    return totals.join(medians, "domain").select(
        "domain", "n", "regulators", "median_requirements", F.round(100 * F.col("dated") / F.col("n"), 2).alias("dated_percent"),
        F.round(obscurity * (0.5 + F.col("regulators") / F.col("n")) * reach, 4).alias("score"))


def domain_pool(candidates: DataFrame, domains: list[str]) -> DataFrame:
    """Candidates of some industries, counted by regulator and by type."""
    wanted = F.array(*[F.lit(d) for d in domains])
    kept = candidates.filter(F.arrays_overlap(keywords.lowered(F.col("industry")), wanted))
    pairs = F.array(F.struct(F.lit("regulator").alias("view"), F.coalesce(F.trim("regulator_name"), F.lit("?")).alias("value")),
                    F.struct(F.lit("update_type").alias("view"), F.lower("update_type").alias("value")))
    return kept.select(F.explode(pairs).alias("p")).groupBy("p.view", "p.value").agg(F.count("*").alias("n"))


def key_coverage(facts: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Hits, misses, distinct missing keys, and a verdict on a foreign key.

    Facts are counted per key first, so the join sees one row per key.
    """
    per = facts.groupBy(key).agg(F.count("*").alias("n")).join(dim.select(key, name), key, "left")
    hit = F.col(name).isNotNull()
    best = per.filter(hit).groupBy(name).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), name).limit(20)
    share = best.agg(F.coalesce(F.avg(keywords.looks_like_regulator(F.col(name)).cast("double")), F.lit(0.0))).scalar()
    totals = per.agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("misses"),
        F.count_if(~hit).alias("missing_keys")).withColumn("regulator_share", share)
    rate = F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1))
    verdict = (F.when(F.col("misses") == 0, "clean join")
               .when((F.col("regulator_share") >= 0.75) & (rate > 0.95), "messy").otherwise("significant misses"))
    return totals.withColumn("verdict", verdict)


def shortlist_diagnostics(shortlist: DataFrame, top: int = 15) -> DataFrame:
    """Place mix of a shortlist, and regulator dominance, recency and recognition among its first rows."""
    code = F.col("topic_jurisdiction_code")
    first = F.col("position") <= top
    heads = shortlist.filter(first).groupBy("regulator_name").agg(F.count("*").alias("n"))
    most = heads.agg(F.max("n")).scalar()
    return shortlist.agg(
        F.count_if((code == "US") | (F.col("jurisdiction_tier.label") == "us_federal")).alias("federal"),
        F.count_if(code.rlike("^US-[A-Z]{2}$")).alias("state"),
        F.count_if((F.col("jurisdiction_tier.label") == "international") & ~code.startswith("US")).alias("international"),
        F.count_if(first & (F.col("parts.recency") >= 5)).alias("recent"),
        F.count_if(first & (F.col("parts.recognition") > 0)).alias("recognised"),
    ).withColumn("top_regulator", most).withColumn("dominated", F.col("top_regulator") >= top * 0.5)


