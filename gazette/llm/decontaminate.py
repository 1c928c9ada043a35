"""Benchmark passages in documents by greedy string tiling.

Words are lower-cased runs of ASCII letters, digits and any other non-ASCII characters. Every window of `seed` words
has a running Karp-Rabin hash; windows that a document and an item share are seeds, and a run of seeds along a diagonal
is a match. Tiling takes the longest match again and again and marks its words on both sides; what is left of matches that
lose words to it stays in the race while it has `seed` words. An item of fewer words has one window, of all its words. The share of an item's words under tiles is its coverage, whatever
the order of the passages.

Documents are read once. A bit table of the items' seeds, of bounded size whatever the items, drops windows that no item
has; only what passes travels, as one row per document and part of the seeds. The parts hold a bounded number of seeds and
are copied to as many groups of documents as there are shuffle partitions, so that no seed's documents meet in one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import hashing
from gazette.llm.batches import bounded, tidy
from gazette.session import stored

#: Seeds in a part, and the size of the bit table in bits at most.
PART_SEEDS, MOST_BITS = 1 << 20, 1 << 27

_SEEDS = "item bigint, words int, place int, hash bigint"
_ROWS = "part int, salt int, kind int, doc bigint, row bigint, words int, places binary, hashes binary, items binary"
_MATCHES = "doc bigint, row bigint, item bigint, words int, matches binary"


def _windows(texts: pa.Array, size: int, shorter=()):
    """(index of the text, place, hash) of all windows, those of `shorter` sizes included, and the number of words of every text."""
    hashes, owner = hashing.words(pc.utf8_lower(texts.cast(pa.large_string())), "marks")
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    found = []
    for k in (size, *shorter):
        runs = hashing.rolling(hashes, k)
        at = np.flatnonzero(owner[:len(runs)] == owner[k - 1:]) if len(runs) else np.empty(0, np.int64)
        found.append((owner[at], at - first[owner[at]], runs[at]))
    return *(np.concatenate(x) for x in zip(*found)), count


def _items(seed: int):
    def run(batches):
        for batch in batches:
            for at, texts in hashing.pieces_of(batch.column(1)):
                # Windows of fewer words than `seed` are those of items that have no more.
                parts = [(k, _windows(texts, k)) for k in range(1, seed + 1)]
                count = parts[-1][1][3]
                owner, place, hashes = (np.concatenate([x[c][(count[x[0]] == k) | (k == seed)] for k, x in parts]) for c in range(3))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)).take(pa.array(owner)), pa.array(count[owner].astype(np.int32)),
                    pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64))], ["item", "words", "place", "hash"])

    return run


def _hits(seed: int, shorter: list[int], table, parts: int, salts: int):
    """Windows of documents that the bit table knows, a row for each document and part."""

    def run(batches):
        bits = np.frombuffer(table.value, np.uint64)
        mask, task, row = np.uint64(64 * len(bits) - 1), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = {n: [] for n in ("part", "doc", "row", "words", "places", "hashes")}
            for start, texts in hashing.pieces_of(batch.column(1)):
                owner, place, hashes, count = _windows(texts, seed, shorter)
                at = hashes & mask
                known = np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                owner, place, hashes = owner[known], place[known].astype(np.int32), hashes[known]
                part = (hashes >> np.uint64(32)).astype(np.int64) % parts
                order = np.lexsort((part, owner))
                owner, place, hashes, part = owner[order], place[order], hashes[order], part[order]
                heads = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])) if len(owner) else []
                docs = batch.column(0).slice(start, len(texts))
                for a, b in zip(heads, [*heads[1:], len(owner)]):
                    out["part"].append(int(part[a]))
                    out["doc"].append(docs[int(owner[a])].as_py())
                    out["row"].append((task << 40) + row + int(owner[a]))
                    out["words"].append(int(count[owner[a]]))
                    out["places"].append(place[a:b].tobytes())
                    out["hashes"].append(hashes[a:b].tobytes())
                row += len(texts)
            n = len(out["part"])
            yield pa.RecordBatch.from_arrays([
                pa.array(out["part"], pa.int32()), pa.array([r * 0x9E3779B1 % salts for r in out["row"]], pa.int32()),
                pa.array(np.ones(n, np.int32)), pa.array(out["doc"], pa.int64()), pa.array(out["row"], pa.int64()),
                pa.array(out["words"], pa.int32()), pa.array(out["places"], pa.binary()), pa.array(out["hashes"], pa.binary()),
                pa.nulls(n, pa.binary())], ["part", "salt", "kind", "doc", "row", "words", "places", "hashes", "items"])

    return run


def _meet(batches):
    """Streams a partition sorted by part, group and kind: the seeds of a part come first, then its documents."""
    group, have = None, None
    for batch in batches:
        out = {n: [] for n in ("doc", "row", "item", "words", "matches")}
        for i in range(batch.num_rows):
            part, salt, kind, doc, row, words = (batch.column(c)[i].as_py() for c in range(6))
            places = np.frombuffer(batch.column(6)[i].as_buffer(), np.int32)
            hashes = np.frombuffer(batch.column(7)[i].as_buffer(), np.uint64)
            if kind == 0:
                if group != (part, salt):
                    group, have = (part, salt), []
                have.append((hashes, np.frombuffer(batch.column(8)[i].as_buffer(), np.int64), places))
                continue
            if group != (part, salt):
                continue
            if isinstance(have, list):
                known, items, spots = (np.concatenate(x) for x in zip(*have))
                order = np.argsort(known, kind="stable")
                have = known[order], items[order], spots[order]
            known, items, spots = have
            low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            times = high - low
            if not times.any():
                continue
            at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            item, spot, place = items[at], spots[at], np.repeat(places, times)
            order = np.argsort(item, kind="stable")
            item, spot, place = item[order], spot[order], place[order]
            heads = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
            for a, b in zip(heads, [*heads[1:], len(item)]):
                for name, value in zip(out, (doc, row, int(item[a]), 0, np.column_stack([spot[a:b], place[a:b]]).astype(np.int32).tobytes())):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], list(out))


def tiles(spot: np.ndarray, place: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the document, length) of greedy string tiling, from shared windows.

    Longest first; equally long ones go by place in the item, then in the document.
    """
    order = np.lexsort((spot, place - spot))
    spot, place = spot[order], place[order]
    heads = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1] + 1) | (place[1:] != place[:-1] + 1)]))
    lengths = np.diff(np.append(heads, len(spot))) + seed - 1
    race = [(-int(n), int(spot[h]), int(place[h])) for h, n in zip(heads, lengths)]
    heapq.heapify(race)
    taken, used, found = set(), set(), []
    while race:
        n, s, p = heapq.heappop(race)
        n = -n
        free = [s + k not in taken and p + k not in used for k in range(n)]
        if all(free):
            found.append((s, p, n))
            taken.update(range(s, s + n))
            used.update(range(p, p + n))
            continue
        k = 0
        while k < n:
            if free[k]:
                stop = k
                while stop < n and free[stop]:
                    stop += 1
                if stop - k >= seed:
                    heapq.heappush(race, (k - stop, s + k, p + k))
                k = stop
            k += 1
    return found


def _tile(seed: int, least: float):
    def run(batches):
        names = ["doc", "row", "item", "item_words", "covered", "tiles"]
        kind = pa.list_(pa.struct([("item_place", pa.int32()), ("doc_place", pa.int32()), ("words", pa.int32())]))
        for batch in batches:
            out = {n: [] for n in names}
            for doc, row, item, words, parts in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = np.unique(np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in parts]), axis=0)
                size = min(seed, words)
                # A window covers `size` words at most, so fewer windows than this cannot reach the coverage.
                if len(np.unique(pairs[:, 0])) * size < least * words:
                    continue
                found = tiles(pairs[:, 0], pairs[:, 1], size)
                covered = sum(n for _, _, n in found)
                if covered >= least * words:
                    made = [{"item_place": s, "doc_place": p, "words": n} for s, p, n in sorted(found)]
                    for name, value in zip(names, (doc, row, item, words, covered, made)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind))], names)

    return run


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", body: str = "text", item_key: str = "item_id", item_body: str = "text",
            seed: int = 5, least: float = 0.5) -> DataFrame:
    """(key, item_key, item_words, covered, coverage, tiles) for every document and item with a coverage of at least `least`.

    A tile is its place in the item, its place in the document and its number of words. Items of fewer than `seed`
    words match as a whole, null or empty texts match nothing. Rows that repeat a document's key are tiled one by one and give a row
    each; rows that repeat an item's key are one item whose windows come from all of them that have `seed` words, else from the longest. Documents without a key are reported with a
    null key, items without one are not compared. Other columns are not read. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seeds = stored(items.select(F.col(item_key).cast("bigint"), F.col(item_body).cast("string")).filter(F.col(item_key).isNotNull())
                   .mapInArrow(_items(seed), _SEEDS), "seeds")
    n, shorter = seeds.agg(F.count("*"), F.sort_array(F.collect_set(F.when(F.col("words") < seed, F.col("words"))))).first()
    if shorter:
        longest = seeds.groupBy("item").agg(F.max("words").alias("_longest"))
        seeds = stored(seeds.join(longest, "item").filter(F.least("_longest", F.lit(seed)) == F.least("words", F.lit(seed))).drop("_longest"), "seeds")
    bits = min(MOST_BITS, 1 << max(10, (16 * n).bit_length()))
    words = (seeds.select(F.expr(f"(hash & {bits - 1}L) >> 6").alias("word"), F.expr("shiftleft(1L, cast(hash & 63L AS int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    parts = -(-max(n, 1) // PART_SEEDS)
    part = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(parts)).cast("int")
    # The seeds of a part in rows of at most 65,536, for every group of documents.
    packed = (seeds.select(part.alias("part"), "item", "place", "hash", F.pmod(F.xxhash64("hash"), F.lit(PART_SEEDS >> 16)).alias("slice"))
              .groupBy("part", "slice").applyInArrow(_packed, _ROWS))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("part", "salt", *[c.split()[0] for c in _ROWS.split(", ")[2:]])
    hits = bounded(docs).select(F.col(key).cast("bigint"), F.col(body).cast("string")).mapInArrow(
        tidy(_hits(seed, shorter, spark.sparkContext.broadcast(table.tobytes()), parts, salts)), _ROWS)
    met = (hits.unionByName(packed).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind").mapInArrow(_meet, _MATCHES))
    sizes = seeds.groupBy("item").agg(F.max("words").alias("words"))
    pairs = met.groupBy("row", "item").agg(F.first("doc").alias("doc"), F.collect_list("matches").alias("matches")).join(sizes, "item")
    found = pairs.select("doc", "row", "item", "words", "matches").mapInArrow(
        _tile(seed, least), "doc bigint, row bigint, item bigint, item_words int, covered int, "
                            "tiles array<struct<item_place int, doc_place int, words int>>")
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key), "item_words", "covered",
                        (F.col("covered") / F.col("item_words")).alias("coverage"), "tiles")


def _packed(group: pa.Table) -> pa.Table:
    column = lambda c: np.asarray(group.column(c).combine_chunks())
    one = lambda v, t: pa.array([v], t)
    return pa.table({"part": group.column("part").slice(0, 1), "salt": one(0, pa.int32()), "kind": one(0, pa.int32()), "doc": one(None, pa.int64()),
                     "row": one(None, pa.int64()), "words": one(None, pa.int32()), "places": one(column("place").tobytes(), pa.binary()),
                     "hashes": one(column("hash").tobytes(), pa.binary()), "items": one(column("item").tobytes(), pa.binary())})
