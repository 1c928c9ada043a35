"""TF-IDF ranking and name resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import text
from gazette.functions.common import bound
from gazette.functions.common import text as filled
from gazette.operators import spread
from gazette.session import stored


COMMON = 200_000


def _one_per_key(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Texts of each document; rows that share a key are one document. Only texts of repeated keys are shuffled."""
    texts = docs.select(key, F.col(body).alias("_text"))
    twice = stored(texts.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(key), "repeated-keys")
    single = texts.join(twice, key, "left_anti").select(key, F.array("_text").alias("_texts"))
    return single.unionByName(texts.join(twice, key, "left_semi").groupBy(key).agg(F.collect_list("_text").alias("_texts")))


def document_terms(docs: DataFrame, key: str, body: str) -> DataFrame:
    """The number of tokens of each document, and its terms, each with its count. Counted inside the row, so nothing is shuffled for it."""
    found = _one_per_key(docs, key, body).select(key, F.flatten(F.transform("_texts", text.tokens)).alias("_tokens"))
    return found.select(key, F.size("_tokens").alias("length"), text.counted(F.col("_tokens")).alias("words"))


def query_terms(texts: DataFrame, body: str) -> DataFrame:
    """Terms of a query, read as one document however many rows it has."""
    counted = texts.select(F.explode(text.tokens(F.col(body))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counted.select("term", (F.col("n") / counted.agg(F.sum("n")).scalar()).alias("query_tf"))


@dataclass(frozen=True)
class TextIndex:
    """A kept index of documents: their terms by document and by part, the squares of their norms, and in how many documents a term is."""

    documents: DataFrame  # key, length, words (term, n)
    postings: DataFrame  # part, term, key, tf
    norms: DataFrame  # key, square
    terms: DataFrame  # term, rows
    key: str
    total: int
    parts: int
    size: int  # of postings


def _part(parts: int, term: Column | str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int").alias("part")


def _idf(rows: Column, documents: int) -> Column:
    """Smooth inverse frequency of a term of so many of the documents."""
    return F.log(F.lit(float(documents + 1)) / (rows + 1)) + 1.0


def _singly(documents: DataFrame, key: str) -> DataFrame:
    """A row per document and term."""
    each = documents.select(key, "length", F.explode("words").alias("_word"))
    return each.select(key, F.col("_word.term").alias("term"), (F.col("_word.n") / F.col("length")).alias("tf"))


def _with_terms(single: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """Rows of documents and terms, `size` of them, with what the table of terms says of their term.

    A term that has a `COMMON`th of all rows is looked up in a broadcast table, which has `COMMON` terms at most. Only rows
    of the other terms are shuffled, and none of these is frequent.
    """
    common = F.broadcast(terms.filter(F.col("rows") * COMMON >= size))
    near = single.join(common, "term")
    if size <= COMMON:
        return near
    rare = single.join(F.broadcast(common.select("term")), "term", "left_anti").join(terms.filter(F.col("rows") * COMMON < size), "term")
    return near.unionByName(rare)


def build_index(docs: DataFrame, key: str, body: str, path: str, rows_a_part: int = 20_000_000, rows_a_task: int = 4_000_000) -> str:
    """Writes the index of all documents; returns its folder.

    Parts are hash ranges of terms, one for so many postings and 4,096 at most. Inside a part, files are cut by document, so a
    term of most documents fills several files and no task holds it whole. A document's words of one part travel as one row with
    one text. The file that names the sizes is written last: a folder without it is no index.
    """
    spark = docs.sparkSession
    document_terms(docs, key, body).write.mode("overwrite").parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    terms = documents.select(F.explode("words.term").alias("term")).groupBy("term").agg(F.count("*").alias("rows"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    size = terms.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    total, parts = docs.count(), min(4096, max(1, -(-size // rows_a_part)))
    dealt = F.sort_array(F.transform("words", lambda w: F.struct(
        _part(parts, w["term"]), w["term"].alias("term"), w["n"].alias("n"))))
    packed = bound(dealt, lambda words: F.transform(text.runs(words, lambda w: w["part"]), lambda run: bound(
        F.slice(words, run["start"] + 1, run["size"]), lambda own: F.struct(
            F.get(own["part"], F.lit(0)).alias("part"), F.array_join(own["term"], " ").alias("terms"), own["n"].alias("counts")))))
    sent = documents.select(key, "length", F.explode(packed).alias("_of")).select("_of.part", key, "length", "_of.terms", "_of.counts")
    sent = sent.repartitionByRange(max(1, -(-size // rows_a_task)), "part", key)
    single = sent.select("part", key, "length", "counts", F.posexplode(F.split("terms", " ")).alias("_at", "term"))
    (single.select("part", "term", key, (F.get("counts", F.col("_at")) / F.col("length")).alias("tf")).sortWithinPartitions("part", "term")
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings"))
    weight = F.col("tf") * _idf(F.col("rows"), total + 1)
    (_with_terms(_singly(documents, key), terms, size).groupBy(key).agg(F.sum(weight * weight).alias("square"))
     .write.mode("overwrite").parquet(f"{path}/norms"))
    about = spark.createDataFrame([(key, total, parts, size)], "key STRING, total BIGINT, parts INT, size BIGINT")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return path


def open_index(spark: SparkSession, path: str) -> TextIndex:
    about = spark.read.parquet(f"{path}/about").first()
    norms = spark.read.parquet(f"{path}/norms")
    shape = f"term STRING, {about.key} {norms.schema[about.key].dataType.simpleString()}, tf DOUBLE, part INT"
    return TextIndex(spark.read.parquet(f"{path}/documents"), spark.read.schema(shape).parquet(f"{path}/postings"), norms,
                     spark.read.parquet(f"{path}/terms"), about.key, about.total, about.parts, about.size)


def term_table(index: TextIndex, query: DataFrame) -> DataFrame:
    """Terms of documents and query with smooth IDF. The query is one more document in N and in each frequency."""
    merged = index.terms.join(query, "term", "full").withColumn("rows", F.coalesce("rows", F.lit(0)))
    seen = F.col("rows") + F.when(F.col("query_tf").isNotNull(), 1).otherwise(0)
    return merged.select("term", "rows", "query_tf", _idf(seen, index.total + 1).alias("idf"))


def weights(index: TextIndex, query: DataFrame) -> DataFrame:
    """TF-IDF weight of each term in each document; only rows of terms that are not common are shuffled."""
    joined = _with_terms(_singly(index.documents, index.key), stored(term_table(index, query), "term-table"), index.size)
    return joined.select(index.key, "term", (F.col("tf") * F.col("idf")).alias("weight"),
                         (F.col("query_tf") * F.col("idf")).alias("query_weight"))


def cosine_to_query(index: TextIndex, query: DataFrame) -> DataFrame:
    """Cosine of each document with a shared word to the query; documents without one would be zero.

    Only the postings of the query's own terms are read. A query changes the frequencies of its own terms alone, by one, so
    the kept square of a document's norm is put right from the same postings. To the driver come the numbers of the parts that hold
    terms of the query, 4,096 at most.
    """
    query = stored(query, "query-terms")
    asked = query.join(index.terms, "term", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    # Written, so that the planner knows its size and a query of usual length is broadcast.
    asked = stored(asked.select(_part(index.parts), "term", "query_tf", _idf(F.col("rows") + 1, index.total + 1).alias("idf"),
                                _idf(F.col("rows"), index.total + 1).alias("kept_idf")), "asked-terms")
    parts = [r.part for r in query.select(_part(index.parts)).distinct().collect()]
    tf, idf, kept = F.col("tf"), F.col("idf"), F.col("kept_idf")
    per = index.postings.filter(F.col("part").isin(parts)).join(asked, ["part", "term"]).groupBy(index.key).agg(
        F.sum(tf * idf * F.col("query_tf") * idf).alias("dot"), F.sum(tf * tf * (idf * idf - kept * kept)).alias("change"))
    norm = F.sqrt(F.col("square") + F.col("change")) * asked.agg(F.sqrt(F.sum(F.col("query_tf") * idf * F.col("query_tf") * idf))).scalar()
    return per.join(index.norms, index.key).select(index.key, (F.col("dot") / norm).alias("score"))


def name_tier(query: str, acronym: Column, name: Column) -> Column:
    """How a name answers a query: 1 acronym, 2 name, 3 prefix, 4 inside the name, 5 around it; null for not."""
    q, acronym, name = query.strip().lower(), F.lower(filled(acronym)), F.lower(filled(name))
    return (
        F.when(acronym == q, 1).when(name == q, 2).when(name.startswith(q), 3).when(name.contains(q), 4)
        .when((name != "") & F.lit(q).contains(name), 5)
    )


def resolve_names(topics: DataFrame, queries: list[str]) -> DataFrame:
    """Topics of the best tier that each query has, with the lower-cased query; nothing for an empty one.

    All queries share one pass over the topics. The table of best tiers has a row per query.
    """
    asked = [q for q in queries if q.strip()]
    if not asked:
        return topics.withColumn("query", F.lit("")).withColumn("tier", F.lit(None).cast("int")).limit(0)
    tiers = F.array(*[F.struct(F.lit(q.strip().lower()).alias("query"), name_tier(q, F.col("acronym"), F.col("name")).alias("tier")) for q in asked])
    tiered = topics.withColumn("_q", F.explode(F.filter(tiers, lambda t: t["tier"].isNotNull()))).select(*topics.columns, "_q.query", "_q.tier")
    best = tiered.groupBy("query").agg(F.min("tier").alias("tier"))
    return tiered.join(best, ["query", "tier"], "left_semi")


def resolve_name(topics: DataFrame, query: str) -> DataFrame:
    """Topics of the best tier that has any; nothing for an empty query."""
    return resolve_names(topics, [query]).drop("query")


def search_updates(topics: DataFrame, updates: DataFrame, name: str, keyword: str | None, limit: int = 5) -> DataFrame:
    """The newest updates of the topics a name resolves to, with the number of matches and of topics."""
    resolved = resolve_name(topics, name)
    found = updates.join(resolved.select("topic_id"), "topic_id", "left_semi")
    if keyword and keyword.strip():
        has = lambda c: F.lower(c).contains(keyword.strip().lower())
        found = found.filter(has(F.col("title")) | has(F.col("what_changed")) | F.exists("tags", has))
    topics_found = resolved.agg(F.count("*")).scalar()
    rows = spread.ranked_limit(found, [F.col("pub_date").desc(), F.col("seq")], limit)
    return rows.withColumn("matches", found.agg(F.count("*")).scalar()).withColumn(
        "ambiguous", F.when(topics_found > 1, topics_found).otherwise(0))
