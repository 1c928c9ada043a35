"""Version, section and change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions import text
from gazette.operators import versions
from gazette.plans.registry import query
from gazette.plans.views import define, oracle
from gazette.session import table

# Three versions of the documents: the first without toxic ones, the others without poor ones, each reworded.
_SECTION = "concat(CAST(doc_id % 12 + 1 AS STRING), '.', CAST(doc_id AS STRING)) AS section_id, source AS title, lang"
_DROP = {1: "toxic = 1", 2: "quality = 0", 3: "quality = 0"}
_TEXT = {1: "text", 2: "replace(text, ' with ', ' including ')",
         3: "replace(replace(text, ' with ', ' including '), ' for ', ' on behalf of ')"}
for _v in _TEXT:
    define(f"v{_v}", f"SELECT {_SECTION}, {_TEXT[_v]} AS markdown FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE {_DROP[_v]})")
_DELTA = """SELECT coalesce(b.section_id, a.section_id) AS section_id, coalesce(b.title, a.title) AS title, coalesce(b.lang, a.lang) AS lang,
    CASE WHEN a.section_id IS NULL THEN 'added' WHEN b.section_id IS NULL THEN 'removed' ELSE 'modified' END AS kind,
    coalesce(a.markdown, '') AS before, coalesce(b.markdown, '') AS after, '{r}' AS release
    FROM {a} a FULL JOIN {b} b ON a.section_id = b.section_id
    WHERE a.markdown IS DISTINCT FROM b.markdown"""
define("deltas_doc", f"{_DELTA.format(r='2001-02', a='v1', b='v2')} UNION ALL {_DELTA.format(r='2001-05', a='v2', b='v3')}", "v1", "v2", "v3")
define("changes", """SELECT *, release || ':' || section_id AS change_id, CAST(split_part(section_id, '.', 1) AS INT) AS family,
    CASE kind WHEN 'removed' THEN 'breaking' WHEN 'added' THEN 'substantive' ELSE CASE WHEN lang = 'en' THEN 'clarifying' ELSE 'cosmetic' END END
    AS materiality FROM deltas_doc""", "deltas_doc")


def version(spark, folder, number):
    labels = table(spark, folder, "labels").filter(_DROP[number]).select("doc_id")
    docs = table(spark, folder, "documents").join(labels, "doc_id", "left_anti")
    return docs.selectExpr(*[c.strip() for c in (
        "concat(CAST(doc_id % 12 + 1 AS STRING), '.', CAST(doc_id AS STRING)) AS section_id", "source AS title", "lang",
        f"{_TEXT[number]} AS markdown", "doc_id")])


def changes(spark, folder, texts=False):
    """Change records of both releases; how material a change is comes from its kind and language."""
    out = None
    for release, old, new in (("2001-02", 1, 2), ("2001-05", 2, 3)):
        a, b = version(spark, folder, old), version(spark, folder, new)
        found = versions.section_changes(a, b)
        if texts:
            found = versions.with_texts(found, a, b)
        found = found.withColumn("release", F.lit(release))
        out = found if out is None else out.unionByName(found)
    langs = table(spark, folder, "documents").selectExpr(
        "concat(CAST(doc_id % 12 + 1 AS STRING), '.', CAST(doc_id AS STRING)) AS section_id", "lang")
    material = (F.when(F.col("kind") == "removed", "breaking").when(F.col("kind") == "added", "substantive")
                .when(F.col("lang") == "en", "clarifying").otherwise("cosmetic"))
    return out.join(langs, "section_id").select(
        "*", F.concat_ws(":", "release", "section_id").alias("change_id"), material.alias("materiality"),
        F.concat(F.col("kind"), F.lit(" section "), "section_id").alias("summary"),
        F.array(F.concat(F.lit("policies/"), "title", F.lit("/rules.yaml")), F.concat(F.lit("policies/"), "lang", F.lit("/policy.md"))).alias("paths"))


@query("section_diff", oracle("SELECT change_id, title, kind, family, sha256(before) AS before, sha256(after) AS after FROM changes", "changes"))
def section_diff(spark, folder):
    return changes(spark, folder, texts=True).select(
        "change_id", "title", "kind", "family", F.sha2("before", 256).alias("before"), F.sha2("after", 256).alias("after"))


@query("change_siblings", oracle("""
    SELECT a.change_id, a.release, a.family, count(b.change_id) AS siblings, count(*) FILTER (b.materiality = 'breaking') AS breaking_siblings,
           count(*) FILTER (b.materiality = 'substantive') AS substantive_siblings, count(*) FILTER (b.materiality = 'clarifying') AS clarifying_siblings,
           count(*) FILTER (b.materiality = 'cosmetic') AS cosmetic_siblings
    FROM changes a LEFT JOIN changes b ON a.release = b.release AND a.family = b.family AND a.change_id <> b.change_id GROUP BY ALL""", "changes"))
def change_siblings(spark, folder):
    return versions.siblings(changes(spark, folder))


_COUNTS = ", ".join(f"count(*) FILTER (materiality = '{m}') AS {m}, round(100.0 * count(*) FILTER (materiality = '{m}') / count(*), 2) AS {m}_pct"
                    for m in ("breaking", "substantive", "clarifying", "cosmetic"))


@query("release_rollup", oracle(f"""
    SELECT release, count(*) AS changes, {_COUNTS}, count(DISTINCT title) + count(DISTINCT lang) AS policies FROM changes GROUP BY release""", "changes"))
def release_rollup(spark, folder):
    return versions.release_rollup(changes(spark, folder))


@query("policy_rollup", oracle(f"""
    SELECT policy, CAST(coalesce(changes, 0) AS BIGINT) AS changes, CAST(coalesce(releases, 0) AS BIGINT) AS releases,
           {', '.join(f"CAST(coalesce({m}, 0) AS BIGINT) AS {m}, coalesce({m}_pct, 0) AS {m}_pct" for m in ('breaking', 'substantive', 'clarifying', 'cosmetic'))}
    FROM (SELECT DISTINCT source AS policy FROM documents UNION SELECT DISTINCT lang FROM documents UNION SELECT 'role ' || role FROM conversations)
    LEFT JOIN (SELECT policy, count(*) AS changes, count(DISTINCT release) AS releases, {_COUNTS} FROM (
      SELECT title AS policy, release, materiality FROM changes UNION ALL SELECT lang, release, materiality FROM changes) GROUP BY policy)
    USING (policy)""", "changes"))
def policy_rollup(spark, folder):
    docs, talks = table(spark, folder, "documents"), table(spark, folder, "conversations")
    known = docs.select(F.col("source").alias("policy")).distinct().union(docs.select("lang").distinct()).union(
        talks.select(F.concat(F.lit("role "), "role")).distinct())
    return versions.policy_rollup(changes(spark, folder), known)


@query("materiality_groups", oracle("""
    SELECT release, materiality, count(*) AS changes, CASE materiality WHEN 'breaking' THEN 1 WHEN 'substantive' THEN 2 WHEN 'clarifying' THEN 3
           ELSE 4 END AS place FROM changes GROUP BY ALL""", "changes"))
def materiality_groups(spark, folder):
    return versions.materiality_groups(changes(spark, folder))


@query("change_summary", oracle("""
    SELECT change_id, title AS display_title, CASE WHEN title < lang THEN title || ',' || lang ELSE lang || ',' || title END AS policy_keys,
           lower(concat_ws(' ', title, kind || ' section ' || section_id, section_id, 'policies/' || title || '/rules.yaml policies/' || lang
             || '/policy.md', CASE WHEN title < lang THEN title || ' ' || lang ELSE lang || ' ' || title END)) AS search_text FROM changes""", "changes"))
def change_summary(spark, folder):
    rows = versions.change_summary(changes(spark, folder))
    return rows.select("change_id", "display_title", F.array_join("policy_keys", ",").alias("policy_keys"), "search_text")


@query("cumulative_state", """
    WITH e AS (SELECT l_suppkey AS path, year(l_shipdate) AS release, arg_max(l_partkey, (l_shipdate, l_orderkey, l_partkey)) AS contents
               FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    r AS (SELECT DISTINCT year(l_shipdate) AS release FROM lineitem)
    SELECT s_suppkey AS path, r.release, coalesce((SELECT arg_max(contents, e.release) FROM e WHERE e.path = s_suppkey AND e.release < r.release), -1)
           AS state FROM supplier, r""")
def cumulative_state(spark, folder):
    """Suppliers as files, returned items as edits, years as releases."""
    lines = table(spark, folder, "lineitem").withColumn("release", F.year("l_shipdate"))
    return versions.cumulative_state(edits(spark, folder), baseline(spark, folder), lines.select("release"))


def edits(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("release", F.year("l_shipdate"))
    return lines.filter("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("path"), "release", F.struct("l_shipdate", "l_orderkey").alias("seq"), F.col("l_partkey").alias("contents"))


def baseline(spark, folder):
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("path"), F.lit(-1).cast("bigint").alias("contents"))


define("state_spans", """SELECT path, valid_from, lead(valid_from) OVER (PARTITION BY path ORDER BY valid_from NULLS FIRST) AS valid_to, state FROM (
    SELECT s_suppkey AS path, CAST(NULL AS BIGINT) AS valid_from, -1 AS state FROM supplier UNION ALL
    SELECT l_suppkey, year(l_shipdate), arg_max(l_partkey, (l_shipdate, l_orderkey, l_partkey)) FROM lineitem
    WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL)""")


@query("state_intervals", oracle("SELECT path, valid_from, valid_to, state FROM state_spans", "state_spans"))
def state_intervals(spark, folder):
    return versions.state_intervals(edits(spark, folder), baseline(spark, folder))


@query("state_merge", oracle("SELECT path, valid_from, valid_to, state FROM state_spans", "state_spans"))
def state_merge(spark, folder):
    """Intervals of the edits up to 1997, to which the later ones are merged."""
    every = edits(spark, folder)
    return versions.merge_edits(versions.state_intervals(every.filter("release <= 1997"), baseline(spark, folder)), every.filter("release > 1997"))


@query("state_as_of", oracle("""
    SELECT path, state FROM state_spans WHERE coalesce(valid_from < 1998, true) AND coalesce(1998 <= valid_to, true)""", "state_spans"))
def state_as_of(spark, folder):
    return versions.state_before(versions.state_intervals(edits(spark, folder), baseline(spark, folder)), F.lit(1998))


def snapshots(spark, folder):
    """Events as page snapshots: a page per user, a digest per type and rounded value."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("page"), "ts", "event_id", F.concat("event_type", F.floor("value").cast("string")).alias("digest"),
        F.when(F.col("event_type") == "error", "404").otherwise("200").alias("status"),
        F.when(F.col("event_type") == "signup", "warc/revisit").otherwise("text/html").alias("mimetype"))


define("versions", """SELECT user_id AS page, event_type || CAST(floor(value) AS BIGINT) AS digest, min(ts) AS ts, arg_min(event_id, ts) AS event_id
    FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY ALL""")


@query("version_dedupe", oracle("SELECT page, digest, event_id FROM versions", "versions"))
def version_dedupe(spark, folder):
    return versions.dedupe_versions(snapshots(spark, folder), "page").select("page", "digest", "event_id")


@query("version_pairs", oracle("""
    SELECT * FROM (SELECT page, event_id, lead(event_id) OVER (PARTITION BY page ORDER BY ts, event_id) AS next_event_id FROM versions)
    WHERE next_event_id IS NOT NULL""", "versions"))
def version_pairs(spark, folder):
    kept = versions.dedupe_versions(snapshots(spark, folder), "page").select("page", "ts", "event_id")
    return versions.version_pairs(kept, "page", ["event_id"]).select("page", "event_id", "next_event_id")


def numbered(spark, folder):
    """Documents whose every third line, from the first, is a numbered heading."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda l, i: F.when(i % 3 == 0, F.concat((i / 3 + 1).cast("int").cast("string"), F.lit(". "), l)).otherwise(l))
    return table(spark, folder, "documents").select("doc_id", "source", F.array_join(marked, "\n").alias("body"))


define("numbered", """SELECT doc_id, source, i, line, (i - 1) % 3 = 0 AND trim(line, chr(32) || chr(9)) <> '' AS heading, (i - 1) // 3 + 1 AS num
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")


_BLANK = "chr(32) || chr(9) || chr(10) || chr(13)"


@query("section_split", oracle(f"""
    SELECT doc_id, CAST(position AS INT) AS position, any_value(num) FILTER (heading) || '' AS section_id,
           any_value(trim(line, {_BLANK})) FILTER (heading) AS title,
           sha256(trim(coalesce(string_agg(CASE WHEN (i - 1) % 3 = 0 THEN num || '. ' ELSE '' END || line, chr(10) ORDER BY i) FILTER (NOT heading), ''), {_BLANK})) AS body
    FROM (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position FROM numbered) WHERE position >= 0
    GROUP BY doc_id, position""", "numbered"))
def section_split(spark, folder):
    rows = numbered(spark, folder).select("doc_id", F.posexplode(text.sections(F.col("body"))).alias("position", "s"))
    return rows.select("doc_id", "position", "s.section_id", "s.title", F.sha2("s.markdown", 256).alias("body"))


@query("section_first_page", oracle("""
    SELECT source, num || '' AS section_id, min(doc_id) AS first_page FROM numbered WHERE heading GROUP BY ALL""", "numbered"))
def section_first_page(spark, folder):
    """Documents as the pages of the book they come from."""
    pages = numbered(spark, folder).withColumnRenamed("doc_id", "page")
    return versions.section_first_page(pages, "source")
