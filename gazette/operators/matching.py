"""Contracts matched to records by whole-word entity overlap.

The theta join runs as an equi-join: a phrase that sits in another at word boundaries has all its words among
the other's words, so any one of them is a complete key. The key is the word that the fewest texts have, by a table of
document frequencies; a pattern then checks each candidate pair. A word that half of all texts have is a key only
where a text has no other, so candidates stay near the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import dates, scores
from gazette.functions.common import text
from gazette.session import stored


def normal(entity: Column) -> Column:
    return F.lower(F.trim(entity))


def normal_entities(entities: Column) -> Column:
    """Sorted distinct normal forms without blanks."""
    cleaned = F.transform(F.coalesce(entities, F.array().cast("array<string>")), normal)
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda e: e.isNotNull() & (e != ""))))


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))


def _pieces(c: Column) -> Column:
    """Words and the symbol runs between them; a text without words is one piece.

    A phrase of symbols only can sit between two words and nowhere else, so these pieces hold a key of every
    phrase that the text contains.
    """
    runs = F.filter(F.regexp_extract_all(c, F.lit(r"(?U)(?<=\w)\W+(?=\w)"), F.lit(0)), lambda r: F.trim(r) != "")
    return F.when(F.size(_words(c)) > 0, F.array_distinct(F.concat(_words(c), runs))).otherwise(F.array(c))


#: A piece is common if it is over one in this many of all pieces; fewer than this many pieces can be.
COMMON = 1024


def _with_pieces(texts: DataFrame) -> DataFrame:
    """(text, piece): the pieces of distinct texts."""
    return texts.select("text", F.explode(_pieces(F.col("text"))).alias("piece"))


def piece_frequencies(texts: DataFrame) -> DataFrame:
    """(piece, rows): in how many of the distinct texts each piece is."""
    return _with_pieces(texts).groupBy("piece").agg(F.count("*").alias("rows"))


def rarest_pieces(texts: DataFrame) -> DataFrame:
    """(text, piece): for every distinct text the word that the fewest of them have, of equally rare ones the longest and
    then the first; a text without words is its own piece.

    The common pieces, fewer than COMMON, come from a copied table, so no common piece brings its texts into one
    task; the others are joined by shuffle.
    """
    counted = stored(piece_frequencies(texts), "pieces")
    total = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    often = F.col("rows") * COMMON > total
    words = F.when(F.size(_words(F.col("text"))) > 0, _words(F.col("text"))).otherwise(F.array("text"))
    asked = texts.select("text", F.explode(words).alias("piece"))
    hot = F.broadcast(counted.filter(often))
    known = asked.join(hot, "piece").unionByName(asked.join(hot, "piece", "left_anti").join(counted.filter(~often), "piece"))
    best = F.min_by("piece", F.struct("rows", (-F.length("piece")).alias("size"), "piece"))
    return known.groupBy("text").agg(best.alias("piece"))


def _inside(needle: str, hay: str) -> Column:
    quoted = F.replace(F.col(needle), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.rlike(F.col(hay), F.concat(F.lit(r"(?U)\b\Q"), quoted, F.lit(r"\E\b")))


def contract_entities(contracts: DataFrame, *columns: str) -> DataFrame:
    """One row per contract and settlement entity, with its position and further contract columns."""
    listed = contracts.select("contract_id", *columns, F.posexplode("settlement_entities").alias("entity_pos", "matched_entity"))
    return listed.withColumn("c_entity", normal(F.col("matched_entity"))).filter("c_entity <> ''")


def candidates(entities: DataFrame, phrases: DataFrame) -> DataFrame:
    """(entity, c_entity) that may match: those where one has the rarest piece of the other. Pairs may repeat.

    entities: distinct `entity`; phrases: distinct `c_entity`, both in normal form.
    """
    mine, theirs = phrases.select(F.col("c_entity").alias("text")), entities.select(F.col("entity").alias("text"))
    keys = stored(rarest_pieces(theirs.unionByName(mine).distinct()), "keys")
    asked = keys.join(mine, "text", "left_semi").withColumnRenamed("text", "c_entity")
    given = keys.join(theirs, "text", "left_semi").withColumnRenamed("text", "entity")
    # The phrase inside the entity or equal to it, then the entity inside the phrase.
    inner = asked.join(_with_pieces(theirs).withColumnRenamed("text", "entity"), "piece")
    outer = given.join(_with_pieces(mine).withColumnRenamed("text", "c_entity"), "piece")
    return inner.select("entity", "c_entity").unionByName(outer.select("entity", "c_entity"))


def entity_links(entities: DataFrame, phrases: DataFrame) -> DataFrame:
    """(entity, c_entity) of all distinct texts that are equal or lie in each other at word boundaries."""
    found = (F.col("entity") == F.col("c_entity")) | _inside("c_entity", "entity") | _inside("entity", "c_entity")
    return candidates(entities, phrases).filter(found).distinct()


def _linked(entities: DataFrame, contracts: DataFrame) -> DataFrame:
    """The links of distinct entities to the phrases of contracts, as a written table: the texts are few
    beside the rows that have them, and both sides are read several times on the way."""
    phrases = stored(contract_entities(contracts).select("c_entity").distinct(), "phrases")
    return stored(entity_links(stored(entities.select("entity").distinct(), "entities"), phrases), "links")


def link_table(contracts: DataFrame, records: DataFrame) -> DataFrame:
    """(entity, c_entity) for all entities and topic names of records, for several matches of the same records."""
    return _linked(_exploded(records, _named()), contracts)


def match_entities(rows: DataFrame, contracts: DataFrame, *columns: str, links: DataFrame | None = None) -> DataFrame:
    """Rows with an `entity` (normal form) and the contracts whose entities match it; pairs may repeat.

    The distinct entity texts meet the contracts' distinct texts once, and rows take their contracts from that result. Which side
    of a join is broadcast, and which heavy key is split, is left to adaptive execution, which knows the sizes.
    links: a link table that has the rows' entities.
    """
    mine = contract_entities(contracts, *columns)
    if links is None:
        links = _linked(rows, contracts)
    return rows.join(links.join(mine, "c_entity").drop("c_entity").distinct(), "entity")


def _named() -> Column:
    """A record's entities and its topic's name."""
    return F.concat(F.coalesce(F.col("entities"), F.array().cast("array<string>")), F.array(text(F.col("topic_name"))))


def _exploded(records: DataFrame, entities: Column | None, *carried: Column | str) -> DataFrame:
    """One row per record and entity. What the result needs of a record is carried along, so that matches
    never have to be joined back to all records."""
    entities = F.col("entities") if entities is None else entities
    return records.select("record_id", *carried, F.explode(normal_entities(entities)).alias("entity"))


def entity_join(contracts: DataFrame, records: DataFrame, entities: Column | None = None) -> DataFrame:
    """Matching (contract_id, record_id) with the first contract entity that matched."""
    return (match_entities(_exploded(records, entities), contracts).groupBy("contract_id", "record_id")
            .agg(F.min(F.struct("entity_pos", "matched_entity")).alias("first")))


def entity_window_join(contracts: DataFrame, records: DataFrame, as_of: str, max_age: int) -> DataFrame:
    """Entity join over records aged 0 to max_age days; the dates cut the records before the join."""
    recent = records.filter(dates.within_age(as_of, max_age))
    rows = _exploded(recent, None, dates.age_days(as_of).alias("age"))
    return match_entities(rows, contracts).groupBy("contract_id", "record_id").agg(F.min("age").alias("age"))


def contract_window(as_of: str) -> tuple[Column, Column]:
    """First and last day of a contract's timeline."""
    today = F.lit(as_of).cast("date")
    start = F.date_sub(dates.iso_day(F.col("listed_at")), vocab.HEAT_WINDOW_DAYS)
    resolved = F.coalesce(dates.iso_day(F.col("resolved_at")), today)
    return start, F.when(F.col("kind") == "retrospective", resolved).otherwise(today)


def _claim_titles(matched: DataFrame, columns: list[str]) -> DataFrame:
    """Of the matches of a contract that share a title, the first in file order, with its first entity.

    One aggregate with partial results in the map tasks; a popular title never meets in full.
    """
    row = F.struct("seq", "matched_entity", *columns)
    return (matched.withColumn("title_key", F.lower(F.trim("title"))).groupBy("contract_id", "title_key")
            .agg(F.min_by(row, F.struct("seq", "entity_pos")).alias("_row")).select("contract_id", "_row.*"))


def contract_timeline(contracts: DataFrame, records: DataFrame, as_of: str, *extra: str, links: DataFrame | None = None) -> DataFrame:
    """Events inside each contract's own window, one per title, with the entity that matched first."""
    start, end = contract_window(as_of)
    windows = contracts.select("contract_id", "settlement_entities", start.alias("start"), end.alias("end"))
    kept = records.filter(scores.is_substantive(vocab.TIMELINE_MIN_RELEVANCE) & dates.pub_day().isNotNull())
    columns = ["record_id", "title", "link", "day", "regulator", "urgency", "impact", *[c.split(".")[-1] for c in extra]]
    rows = _exploded(kept, _named(), "seq", "title", "link", dates.pub_day().alias("day"), scores.regulator_display().alias("regulator"),
                     scores.score("urgency").alias("urgency"), scores.score("impact").alias("impact"), *extra)
    matched = match_entities(rows, windows, "start", "end", links=links).filter(
        (F.col("start").isNull() | (F.col("day") >= F.col("start"))) & (F.col("end").isNull() | (F.col("day") <= F.col("end"))))
    return _claim_titles(matched, columns)


def scan_matches(contracts: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Substantive matches of the last 90 days, one per title, with decayed urgency."""
    kept = records.filter(scores.is_substantive() & dates.within_age(as_of, vocab.HEAT_WINDOW_DAYS))
    rows = _exploded(kept, None, "seq", "title", scores.score("urgency").alias("urgency"), dates.age_days(as_of).alias("age"))
    found = _claim_titles(match_entities(rows, contracts), ["record_id", "title", "urgency", "age"])
    return found.withColumn("rank_value", scores.decayed(F.col("urgency"), F.col("age")))
