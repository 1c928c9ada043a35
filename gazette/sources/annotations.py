"""Nested annotations from JSON lines to flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.common import text
from gazette.schemas import ANNOTATION, FLAT_PATHS

BAD = "_bad"


def read_jsonl(spark: SparkSession, path: str, schema: str = ANNOTATION) -> DataFrame:
    """One row per line; a malformed line keeps its text in `_bad`. Blank lines are ignored."""
    reader = spark.read.schema(f"{schema}, {BAD} STRING").option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", BAD).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per element of files that hold a JSON array each; Spark splits the work by file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text of a column as fields, with `_bad` for text that does not parse."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = F.from_json(F.col(column), f"{schema}, {BAD} STRING", options)
    return df.withColumn("_parsed", parsed).select(*[c for c in df.columns if c != column], "_parsed.*")


def flatten(raw: DataFrame) -> DataFrame:
    """Flat columns of nested annotations; rows without an id are dropped. Unused paths are never read."""
    flat = raw.select(*[F.col(path).alias(name) for name, path in FLAT_PATHS.items()])
    return flat.filter(text(F.col("artifact_id")) != "")


def completed() -> Column:
    return (F.col("state") == "completed") & F.col("output_data").isNotNull()


def flatten_artifacts(raw: DataFrame, topics: DataFrame) -> DataFrame:
    """Records of completed artifacts with the columns of their topic (topic_id, name, jurisdiction_code).

    A topic table is one row per topic; AQE broadcasts it when it is small and splits heavy topics when not.
    """
    out, kind, meta = "output_data", "output_data.classification", "output_data.metadata"
    kept = raw.filter(completed()).join(topics, "topic_id", "left")
    return kept.select(
        F.col("id").alias("record_id"), "topic_id", text(F.col("name")).alias("topic_name"),
        F.col("jurisdiction_code").alias("topic_jurisdiction_code"),
        text(F.col("input_data.extracted_metadata.title")).alias("title"),
        text(F.col("input_data.extracted_metadata.url")).alias("link"),
        text(F.col(f"{kind}.update_type")).alias("update_type"),
        text(F.col(f"{kind}.regulatory_source.name")).alias("regulator_name"),
        text(F.col(f"{kind}.regulatory_source.division_office")).alias("regulator_division"),
        F.col(f"{kind}.jurisdiction_tier").alias("jurisdiction_tier"),
        text(F.col(f"{out}.reconciled_published_date.date")).alias("pub_date"),
        F.coalesce(F.col(f"{out}.reconciled_published_date.valid"), F.lit(False)).alias("pub_date_valid"),
        *[F.col(f"{meta}.{c}").alias(c) for c in (
            "critical_dates", "impact_summary", "reg_references", "impacted_business", "impacted_functions",
            "penalties_consequences", "tags", "entities")],
        F.col(f"{out}.scores").alias("scores"))


def quality(raw: DataFrame) -> DataFrame:
    """Rows read, rows that did not parse, and rows with a value in the first field."""
    return raw.agg(F.count("*").alias("read"), F.count_if(F.col(BAD).isNotNull()).alias("malformed"),
                   F.count(raw.columns[0]).alias("with_key"))
