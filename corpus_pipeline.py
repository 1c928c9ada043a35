"""From raw documents to packed sequences: five stages, each written as a table before the next one reads it.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return
the columns of documents. sf_dir names the folder with the labels and the benchmark.

Rows without a doc_id cannot be named by a link or a match, so the Jaccard and benchmark stages keep them. Rows that repeat an
id stay or go one by one; of rows that repeat both the id and the text one is left by the Jaccard stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm import decontaminate, jaccard, secret_scan
from gazette.llm.batches import bounded
from gazette.llm.queries import packed, toxic_scores
from gazette.session import fresh_path, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    return toxic_scores(spark, docs.select(*COLUMNS), sf_dir).filter("score < 0.5").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with `repeats`, whether their id occurs more than once, and `row`, a key of the id and text: the id if it occurs once, else a 64-bit hash."""
    ids = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("repeats")), "repeats")
    docs = docs.select(*COLUMNS).join(ids, "doc_id", "left").withColumn("repeats", F.coalesce("repeats", F.lit(False)))
    # Null and empty texts differ.
    return docs.withColumn("row", F.when(F.col("repeats"), F.xxhash64("doc_id", F.col("text").isNull(), "text")).otherwise(F.col("doc_id").cast("bigint")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by a Jaccard similarity of 0.8 on shingles of five words."""
    docs = _keyed(docs)
    groups = stored(jaccard.classes(docs, key="row", size=5, num=80, den=100).filter("row IS NOT NULL").select("row", "component_id"), "groups")
    # Groups with a repeated id: keys that are hashes do not tell the least id, so the first row is looked for by its id.
    owners = stored(docs.filter("repeats").select("row", "doc_id").distinct(), "owners")
    mixed = groups.join(owners, "row", "left_semi").select("component_id").distinct()
    inside = groups.join(mixed, "component_id", "left_semi").join(owners, "row", "left")
    first = F.min(F.struct(F.coalesce("doc_id", "row").alias("id"), "row"))
    firsts = stored(inside.groupBy("component_id").agg(first["row"].alias("first")), "firsts")
    gone = groups.join(firsts, "component_id", "left").filter(F.col("row") != F.coalesce("first", "component_id")).select("row").distinct()
    kept = docs.join(stored(gone, "gone"), "row", "left_anti")
    same = Window.partitionBy("row", F.xxhash64("text")).orderBy("source", "lang", "n_chars")
    again = kept.filter("repeats").withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    return kept.filter("NOT repeats").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item has half of its words under tiles."""
    docs = _keyed(docs)
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), key="row", seed=5, least=0.5)
    return docs.join(found.select("row").distinct(), "row", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars is the length of the new text where the text changed."""
    forest = secret_scan.train(spark)
    made = bounded(docs).select(*COLUMNS).withColumn("new", secret_scan.redacted(F.col("text"), F.col("source").cast("string"), forest))
    changed = F.coalesce(F.col("new") != F.col("text"), F.lit(False))
    return made.select("doc_id", F.col("new").alias("text"), "lang", "source",
                       F.when(changed, F.length("new").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, mixed by source."""
    return packed(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("decontamination", drop_benchmark),
          ("secrets", redact_secrets), ("packing", pack)]

#: A classifier, greedy tiling and a tokenizer have no SQL; the tests compare with direct computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage's table lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
