"""Versions of documents: section changes, releases, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import text
from gazette.functions.common import text as filled
from gazette.operators import spread


def dedupe_versions(snapshots: DataFrame, key: str) -> DataFrame:
    """The earliest good snapshot of each digest; revisits and failed fetches are dropped."""
    good = snapshots.filter((F.col("mimetype") != "warc/revisit") & (F.col("status") == "200"))
    row = F.struct("ts", *[c for c in snapshots.columns if c not in (key, "digest", "ts")])
    return good.groupBy(key, "digest").agg(F.min(row).alias("_r")).select(key, "digest", "_r.*")


def version_pairs(versions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each version with the next one of its document."""
    return spread.next_in_order(versions, [key], "ts", columns).filter("next_ts IS NOT NULL")


def section_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sections added, removed or modified between two versions, without their texts.

    Both sides bring a digest of the text to the join, so the texts themselves are not shuffled.
    """
    digest = F.sha2(F.col("markdown"), 256)
    old = before.select("section_id", F.col("title").alias("old_title"), digest.alias("old"))
    new = after.select("section_id", F.col("title").alias("new_title"), digest.alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    joined = old.join(new, "section_id", "full").withColumn("kind", kind).filter("kind IS NOT NULL")
    return joined.select("section_id", F.coalesce("new_title", "old_title").alias("title"), "kind", family("section_id").alias("family"))


def family(c: str) -> Column:
    """Top-level number of a section id."""
    return F.split_part(F.col(c), F.lit("."), F.lit(1)).try_cast("int")


def with_texts(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes with the texts of both versions; an absent one is empty."""
    old = before.select("section_id", F.col("markdown").alias("before"))
    new = after.select("section_id", F.col("markdown").alias("after"))
    joined = changes.join(old, "section_id", "left").join(new, "section_id", "left")
    return joined.withColumn("before", filled(F.col("before"))).withColumn("after", filled(F.col("after")))


def policy_key(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.get(parts, 1)).otherwise(path)


def change_summary(changes: DataFrame) -> DataFrame:
    """Display fields, policy keys and search text of each change (title, summary, section_id, paths)."""
    keys = F.array_sort(F.array_distinct(F.transform("paths", policy_key)))
    title = F.when(filled(F.col("title")) != "", F.col("title")).otherwise(F.substring("summary", 1, 60))
    blob = F.lower(F.concat_ws(" ", title, "summary", "section_id", F.array_join("paths", " "), F.array_join(keys, " ")))
    return changes.withColumn("display_title", title).withColumn("policy_keys", keys).withColumn("search_text", blob)


def _materiality_counts() -> list[Column]:
    return [F.count_if(F.col("materiality") == m).alias(m) for m in vocab.MATERIALITY_ORDER]


def _shares(df: DataFrame) -> DataFrame:
    total = sum((F.col(m) for m in vocab.MATERIALITY_ORDER), F.lit(0))
    share = lambda m: F.round(F.when(total > 0, F.col(m) / total * 100).otherwise(0.0), 2).alias(f"{m}_pct")
    return df.select("*", *[share(m) for m in vocab.MATERIALITY_ORDER])


def _policies(changes: DataFrame) -> DataFrame:
    """One row per release, change and policy."""
    keys = F.array_distinct(F.transform("paths", policy_key))
    return changes.select("release", "change_id", "materiality", F.explode(keys).alias("policy"))


def release_rollup(changes: DataFrame) -> DataFrame:
    """Changes per release by materiality with shares, and the number of policies they touch."""
    per = changes.groupBy("release").agg(F.count("*").alias("changes"), *_materiality_counts())
    touched = _policies(changes).groupBy("release", "policy").agg(F.count("*").alias("n")).groupBy("release").agg(F.count("*").alias("policies"))
    return _shares(per.join(touched, "release", "left").withColumn("policies", F.coalesce("policies", F.lit(0))))


def policy_rollup(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Changes per policy over all releases; policies that nothing touched stay at zero."""
    per_release = _policies(changes).groupBy("policy", "release").agg(F.count("*").alias("n"), *_materiality_counts())
    totals = per_release.groupBy("policy").agg(
        F.sum("n").alias("changes"), F.count("*").alias("releases"), *[F.sum(m).alias(m) for m in vocab.MATERIALITY_ORDER])
    every = known.select("policy").union(totals.select("policy")).distinct()
    return _shares(every.join(totals, "policy", "left").fillna(0))


def materiality_groups(changes: DataFrame) -> DataFrame:
    """Size of each materiality group of a release with its place in the fixed order."""
    order = F.array_position(F.array(*[F.lit(m) for m in vocab.MATERIALITY_ORDER]), F.col("materiality"))
    return changes.groupBy("release", "materiality").agg(F.count("*").alias("changes")).withColumn("place", order.cast("int"))


def siblings(changes: DataFrame) -> DataFrame:
    """Each change with its family and how many other changes the family has, by materiality.

    The siblings of a change are the other members of (release, family), in order of materiality and section.
    Listing them per change would square a large family; the family key says the same once per change.
    """
    keys = ["release", "family"]
    sizes = changes.groupBy(*keys).agg(F.count("*").alias("members"), *[c.alias(f"family_{m}") for c, m in zip(
        [F.count_if(F.col("materiality") == m) for m in vocab.MATERIALITY_ORDER], vocab.MATERIALITY_ORDER)])
    joined = changes.join(sizes, keys)
    own = lambda m: (F.col("materiality") == m).cast("int")
    return joined.select("change_id", *keys, (F.col("members") - 1).alias("siblings"),
                         *[(F.col(f"family_{m}") - own(m)).alias(f"{m}_siblings") for m in vocab.MATERIALITY_ORDER])


def _intervals(points: DataFrame) -> DataFrame:
    """Points (path, release, state), one per path and release, as intervals that end where the next one begins."""
    following = F.lead("release").over(Window.partitionBy("path").orderBy(F.col("release").asc_nulls_first()))
    return points.select("path", F.col("release").alias("valid_from"), following.alias("valid_to"), "state")


def _last_edits(edits: DataFrame) -> DataFrame:
    """One edit per file and release, merged in the map tasks: the last one."""
    return edits.groupBy("path", "release").agg(F.max_by("contents", F.struct("seq", "contents")).alias("state"))


def state_intervals(edits: DataFrame, baseline: DataFrame) -> DataFrame:
    """(path, valid_from, valid_to, state) of the files of a baseline (path, contents).

    A row for the baseline and one for each release that edits the file (path, release, seq, contents), and none for releases
    that do not. A state stands before every release r with valid_from < r <= valid_to; null bounds are open. Edits of
    files that the baseline lacks are left out.
    """
    first = baseline.select("path", F.lit(None).cast(edits.schema["release"].dataType).alias("release"), F.col("contents").alias("state"))
    return _intervals(first.unionByName(_last_edits(edits).join(baseline.select("path"), "path", "left_semi")))


def merge_edits(intervals: DataFrame, edits: DataFrame) -> DataFrame:
    """The intervals after further edits, which win over an earlier edit of the same release.

    Only files that the edits touch are laid out anew; the others are passed on as they are.
    """
    touched = edits.select("path").distinct()
    new = _last_edits(edits).join(intervals.select("path").distinct(), "path", "left_semi")
    old = intervals.join(touched, "path", "left_semi").select("path", F.col("valid_from").alias("release"), "state")
    kept = old.join(new.select("path", "release"), ["path", "release"], "left_anti")
    return intervals.join(touched, "path", "left_anti").unionByName(_intervals(kept.unionByName(new)))


def state_before(intervals: DataFrame, release: Column) -> DataFrame:
    """(path, state) of all files before a release."""
    begun, open_ = F.col("valid_from").isNull() | (F.col("valid_from") < release), F.col("valid_to").isNull() | (release <= F.col("valid_to"))
    return intervals.filter(begun & open_).select("path", "state")


def cumulative_state(edits: DataFrame, baseline: DataFrame, releases: DataFrame) -> DataFrame:
    """Content of each file as it stands before each release: the last earlier edit, else the baseline.

    Each interval meets the releases that lie in it; the sorted list of releases travels with the plan.
    """
    listed = F.sort_array(releases.agg(F.collect_set("release")).scalar())
    inside = F.filter("_all", lambda r: (F.col("valid_from").isNull() | (r > F.col("valid_from"))) & (F.col("valid_to").isNull() | (r <= F.col("valid_to"))))
    rows = state_intervals(edits, baseline).withColumn("_all", listed)
    return rows.select("path", F.explode(inside).alias("release"), "state")


def split_documents(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Sections of each text as rows."""
    found = text.sections(text.strip_furniture(F.col(body)))
    return docs.select(key, F.posexplode(found).alias("position", "s")).select(key, "position", "s.*")


def section_first_page(pages: DataFrame, key: str) -> DataFrame:
    """First page that carries each section's heading; lines of a table of contents do not count."""
    lines = pages.select(key, "page", F.explode(text.lines(F.col("body"))).alias("line"))
    line = F.trim("line")
    kept = lines.filter(text.is_heading(F.col("line")) & ~line.rlike(text.TOC_LINE))
    number = F.rtrim(F.regexp_extract(line, text.HEADING, 1), F.lit("."))
    return kept.groupBy(key, number.alias("section_id")).agg(F.min("page").alias("first_page"))
