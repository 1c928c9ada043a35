"""Text, vector and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import keywords, money, text
from gazette.operators import retrieval, signals, spread, vectors
from gazette.plans.fields import feed
from gazette.plans.registry import query
from gazette.plans.views import define, oracle, records
from gazette.session import fresh_path, table

_STOP = "(" + ", ".join(f"'{w}'" for w in vocab.STOP_WORDS) + ")"
# DuckDB's word ends know ASCII only, so whole words are cut out first and then tested.
_WORDS = ("SELECT * FROM (SELECT {key}, unnest(regexp_extract_all(lower({body}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS term FROM {source}) "
          "WHERE regexp_full_match(term, '[a-z0-9]{{2,}}')")
define("doc_tokens", f"SELECT * FROM ({_WORDS.format(key='doc_id', body='text', source='documents')}) WHERE term NOT IN {_STOP}")
define("tf", """SELECT doc_id, term, count(*) / any_value(length) AS tf FROM doc_tokens JOIN
    (SELECT doc_id, count(*) AS length FROM doc_tokens GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, term""", "doc_tokens")
define("query_tf", f"""SELECT term, count(*) / (SELECT count(*) FROM ({_WORDS.format(key='item_id', body='text', source='benchmark')})
    WHERE term NOT IN {_STOP}) AS query_tf FROM ({_WORDS.format(key='item_id', body='text', source='benchmark')})
    WHERE term NOT IN {_STOP} GROUP BY term""")
define("idf", """SELECT term, query_tf, ln(((SELECT count(*) FROM documents) + 2) / (n + 1 + (query_tf IS NOT NULL)::INT)) + 1 AS idf FROM (
    SELECT coalesce(t.term, q.term) AS term, coalesce(n, 0) AS n, query_tf FROM (SELECT term, count(*) AS n FROM tf GROUP BY term) t
    FULL JOIN query_tf q ON q.term = t.term)""", "tf", "query_tf")
define("cosines", """SELECT doc_id, sum(tf * idf * query_tf * idf) / (sqrt(sum(tf * idf * tf * idf))
    * (SELECT sqrt(sum(query_tf * idf * query_tf * idf)) FROM idf)) AS score FROM tf JOIN idf USING (term)
    GROUP BY doc_id HAVING count(query_tf) > 0""", "tf", "idf")


@query("tokens", oracle("""
    SELECT doc_id, count(t.term) AS tokens, count(DISTINCT t.term) AS terms FROM documents LEFT JOIN doc_tokens t USING (doc_id)
    GROUP BY doc_id""", "doc_tokens"))
def tokens(spark, folder):
    found = text.tokens(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(found).alias("tokens"), F.size(F.array_distinct(found)).alias("terms"))


def _benchmark(spark, folder):
    return retrieval.query_terms(table(spark, folder, "benchmark"), "text")


def _index(spark, folder):
    """The documents' index, made anew for the test tables; a user builds it once and opens it for every query."""
    path = retrieval.build_index(table(spark, folder, "documents"), "doc_id", "text", fresh_path(spark, "index"))
    return retrieval.open_index(spark, path)


@query("tfidf_terms", oracle("SELECT doc_id, term, round(tf * idf, 8) AS weight FROM tf JOIN idf USING (term)", "tf", "idf"))
def tfidf_terms(spark, folder):
    w = retrieval.weights(_index(spark, folder), _benchmark(spark, folder))
    return w.select("doc_id", "term", F.round("weight", 8).alias("weight"))


@query("tfidf_rank", oracle("SELECT doc_id, round(score, 6) AS score FROM cosines WHERE round(score, 6) >= 0.03", "cosines"))
def tfidf_rank(spark, folder):
    """Documents by cosine to the benchmark passages read as one query."""
    scored = retrieval.cosine_to_query(_index(spark, folder), _benchmark(spark, folder))
    return scored.withColumn("score", F.round("score", 6)).filter("score >= 0.03")


@query("tfidf_top", oracle("""
    SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS INT) AS position
    FROM cosines WHERE round(score, 6) >= 0.03 QUALIFY position <= 150""", "cosines"))
def tfidf_top(spark, folder):
    return spread.ranked_limit(tfidf_rank(spark, folder), [F.col("score").desc(), F.col("doc_id")], 150)


define("means", """SELECT label, list(v ORDER BY pos) AS mean FROM (SELECT label, pos, avg(v::DOUBLE) AS v FROM (
    SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label""")
define("grand_mean", """SELECT list(v ORDER BY pos) AS mean FROM (SELECT pos, avg(v::DOUBLE) AS v FROM (
    SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)""")


@query("vector_topk", oracle("""
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS score FROM embeddings, grand_mean
    WHERE round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) >= 0 ORDER BY score DESC, vec_id LIMIT 50""", "grand_mean"))
def vector_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    mean = rows.agg(vectors.centroid("embedding", 64).alias("embedding")).select(F.lit(0).alias("query_id"), "embedding")
    return vectors.top_many(rows, mean, 50).select("vec_id", "score")


@query("vector_topk_many", """
    SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE score >= 0 QUALIFY rank <= 10""")
def vector_topk_many(spark, folder):
    """The ten nearest vectors of every hundredth one."""
    rows = table(spark, folder, "embeddings")
    return vectors.top_many(rows, rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)


define("vector_scores", """SELECT vec_id, label, round(least(greatest((list_cosine_similarity(embedding::DOUBLE[], mean) + 1) / 2, 0), 1), 6)
    AS score FROM embeddings JOIN means USING (label)""", "means")


def _scored_vectors(spark, folder):
    """Vectors scored against the mean of their own label; labels meet in an equi-join."""
    rows = table(spark, folder, "embeddings")
    means = rows.groupBy("label").agg(vectors.centroid("embedding", 64).alias("mean"))
    score = vectors.unit_score(vectors.cosine(F.col("embedding"), F.col("mean")))
    return rows.join(means, "label").select("vec_id", "label", F.round(score, 6).alias("score"))


@query("vector_score", oracle("SELECT vec_id, score FROM vector_scores", "vector_scores"))
def vector_score(spark, folder):
    return _scored_vectors(spark, folder).select("vec_id", "score")


@query("vector_topk_per_label", oracle("""
    SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INT) AS rank FROM vector_scores
    QUALIFY rank <= 5""", "vector_scores"))
def vector_topk_per_label(spark, folder):
    return spread.top_per_group(_scored_vectors(spark, folder), ["label"], [F.col("score").desc(), F.col("vec_id")], 5, "rank") \
                 .select("label", "vec_id", "rank")


def topics(spark, folder):
    """Customers read as topics, with the last digits as acronym."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("topic_id"), F.col("c_name").alias("name"), F.expr("right(c_name, 4)").alias("acronym"))


# Queries that end in each of the five tiers, and one that matches nothing.
NAMES = ["0012", "customer#000000100", "Customer#00000000", "0000077", "about customer#000000042 and others", "nobody"]


def _tiers(q):
    q = q.lower()
    return f"""SELECT '{q}' AS query, c_custkey AS topic_id, CASE WHEN lower(right(c_name, 4)) = '{q}' THEN 1 WHEN lower(c_name) = '{q}' THEN 2
        WHEN starts_with(lower(c_name), '{q}') THEN 3 WHEN contains(lower(c_name), '{q}') THEN 4 WHEN contains('{q}', lower(c_name)) THEN 5 END
        AS tier FROM customer"""


@query("name_resolve", "SELECT query, topic_id, tier FROM (" + " UNION ALL ".join(_tiers(q) for q in NAMES)
       + ") WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY query)")
def name_resolve(spark, folder):
    return retrieval.resolve_names(topics(spark, folder), NAMES).select("query", "topic_id", "tier")


@query("update_search", oracle("""
    WITH found AS (SELECT * FROM records WHERE topic_name LIKE 'NATION_1%' AND topic_name <> 'NATION_1' AND (contains(lower(title), 'building')
      OR contains(lower(what_changed), 'building') OR contains(lower(tag_1 || ' ' || tag_2), 'building')))
    SELECT record_id, CAST(row_number() OVER (ORDER BY pub_date DESC, seq) AS INT) AS position, (SELECT count(*) FROM found) AS matches,
           10 AS ambiguous FROM found QUALIFY position <= 20""", "records"))
def update_search(spark, folder):
    catalog = table(spark, folder, "nation").selectExpr(
        "CAST(n_nationkey AS STRING) AS topic_id", "n_name AS name", "CAST(n_nationkey AS STRING) AS acronym").filter("name <> 'NATION_1'")
    updates = records(spark, folder).select("record_id", "seq", "topic_id", "title", "impact_summary.what_changed", "tags", "pub_date")
    return retrieval.search_updates(catalog, updates, "nation_1", "Building", 20).select("record_id", "position", "matches", "ambiguous")


define("signals", """SELECT *, round((0.5 * urgency / 10 + 0.5 * similarity) / 1.0, 6) AS rel FROM liabilities""", "liabilities")


def signal_rows(spark, folder):
    """Records as signals of one evaluation per topic."""
    found = money.liability(F.col("summary"), F.col("agency"))
    relevance = F.round(signals.blended(F.col("scores.urgency.score") / 10, F.col("similarity")), 6)
    return feed(spark, folder).select("record_id", "seq", "topic_id", "agency", "pub_date", "tags", relevance.alias("relevance"),
                                      found.alias("found")).select("*", "found.*")


@query("blend_rank", oracle("SELECT record_id, rel AS relevance FROM signals", "signals"))
def blend_rank(spark, folder):
    return signal_rows(spark, folder).select("record_id", "relevance")


define("cited", """SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY rel DESC, seq) AS rank FROM signals
    QUALIFY rank = 1 OR (rank = 2 AND rel >= 0.3)""", "signals")


@query("cited_pair", oracle("SELECT topic_id, record_id, CAST(rank AS INT) AS rank FROM cited", "cited"))
def cited_pair(spark, folder):
    return signals.cited(signal_rows(spark, folder), "topic_id").select("topic_id", "record_id", "rank")


@query("exposure_score", oracle("""
    SELECT topic_id, score, CASE WHEN score >= 75 THEN 'High' WHEN score >= 50 THEN 'Elevated' WHEN score >= 25 THEN 'Moderate' ELSE 'Low' END
           AS label FROM (SELECT topic_id, CAST(round_even(round(sum([0.5, 0.3, 0.2][rank] * rel), 6) * 100, 0) AS INT) AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY rel DESC, seq) AS rank FROM signals QUALIFY rank <= 3) GROUP BY topic_id)
    """, "signals"))
def exposure_score(spark, folder):
    return signals.exposure(signal_rows(spark, folder), "topic_id")


@query("liability_range", oracle("""
    SELECT topic_id, CAST(coalesce(min(CASE WHEN concrete THEN low END), CASE arg_min(agency, rank) WHEN 'SEC' THEN 100000 ELSE 50000 END) AS BIGINT) AS low,
           CAST(coalesce(max(CASE WHEN concrete THEN high END), CASE arg_min(agency, rank) WHEN 'FTC' THEN 500000 WHEN 'SEC' THEN 10000000
             ELSE 1000000 END) AS BIGINT) AS high, CASE WHEN bool_or(concrete) THEN 'cited' ELSE 'usual' END AS basis
    FROM cited GROUP BY topic_id HAVING max(rel) >= 0.3""", "cited"))
def liability_range(spark, folder):
    return signals.liability_range(signal_rows(spark, folder), "topic_id")


@query("sector_ceiling", oracle("""
    SELECT topic_id, record_id, low, high FROM signals WHERE concrete
    QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY high DESC, seq) = 1""", "signals"))
def sector_ceiling(spark, folder):
    return signals.sector_ceiling(signal_rows(spark, folder), "topic_id")


@query("layer_groups", oracle("""
    SELECT CAST(g AS INT) AS layer, count(record_id) AS signals, coalesce(max(pub_date), '') AS newest FROM generate_series(1, 7) s(g) LEFT JOIN (
      SELECT record_id, pub_date, unnest(list_distinct(CASE tag_1 WHEN 'Artificial Intelligence' THEN [4, 7] WHEN 'Fair Lending' THEN [2, 6]
        WHEN 'Machine Learning' THEN [3] ELSE CAST([] AS INTEGER[]) END || CASE tag_2 WHEN 'Data Breach' THEN [1, 5]
        WHEN 'Privacy' THEN [1, 4, 7] ELSE CAST([] AS INTEGER[]) END)) AS layer FROM records) r ON r.layer = g GROUP BY g""", "records"))
def layer_groups(spark, folder):
    return signals.layer_groups(records(spark, folder), keywords.tag_layers(F.col("tags")), list(vocab.LAYER_TAGS))
