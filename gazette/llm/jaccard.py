"""Set-similarity join of documents on word shingles: rare-first prefixes, filters, one verification per pair.

Plan, every step a Spark shuffle of bounded groups:

1. Map tasks turn texts into sets of 52-bit shingle hashes and send them, as packed blocks, to a segment chosen by
   12 or fewer of those bits. Equal sets inside a task go once. A shingle that a task meets in over 1/1024 of its
   documents goes as one count, so no segment gets a list of all documents of a frequent shingle.
2. A segment counts documents per shingle and answers every map task with the counts above one. A shingle of one
   document cannot be shared, so it is never sent back.
3. Per map task, sets are put in rare-first order. The prefix of a set is its n - ceil(t * n) + 1 rarest shingles;
   two sets with Jaccard similarity t or more share one of them. A set whose prefix holds only unshared shingles is
   done.
4. In rounds, every set is compared with a few sets (hubs) of its prefix shingles that are not in its class yet: first those
   with the fewest shingles of their own, which the text that copies were made from has, then others by chance. Links
   found so join copies into classes, with a few rows per copy and none per pair of copies. Rounds go on while they find
   links and the sets of a shingle that are apart could still make many pairs.
5. Sets that share a prefix shingle and are still in different classes are then compared, all of them. The join
   condition holds the length, positional and suffix filters, so pairs that they exclude are never made.
6. Candidate pairs are made distinct, and each is verified once on the exact intersection of the shared shingles.

No link that changes a class is lost: a pair is left out only if both sides are in one class already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import hashing
from gazette.llm.batches import bounded, release, tidy
from gazette.llm.components import components
from gazette.operators import spread
from gazette.session import stored

#: 64-bit words of a set's parity sketch.
WORDS = 8
#: A task sends a shingle as a count once this share of its documents has it.
FREQUENT = 1024
#: Hubs per shingle in the first round and in later ones, and how many of them a set is verified with in a round.
HUBS, MORE_HUBS, TRIED = 4, 32, 4
#: Rounds go on while the sets that are apart could make more than this many pairs for each of their rows. All pairs that
#: are left after the last round are compared whatever their number, so this decides about work, not about links.
ROUNDS, PAIRS_A_ROW = 8, 64

_SENT = "seg int, task int, kind int, at binary, hash binary, count binary, info binary"
_SETS = "doc_id bigint, vid binary, n int, head int, keys array<bigint>, shared binary, sketch array<bigint>"


def _segments(df: DataFrame) -> int:
    """Power of two with a few segments for each shuffle partition; 16 at least, so that 48 bits are left."""
    wanted = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(max((wanted - 1).bit_length(), 4), 40)


def _split(size: int, bits: int):
    """Map side: sets of a partition, as blocks by segment and one description of its documents."""
    low = np.uint64(hashing.PIECE_BITS - bits)
    mask = np.uint64((1 << (hashing.PIECE_BITS - bits)) - 1)

    def run(batches):
        np.seterr(over="ignore")
        ids, counts, digests, owners, hashes, rows = [], [], [], [], [], 0
        known: set[bytes] = set()
        for batch in batches:
            body, key = batch.column(1), batch.column(0)
            for start, texts in hashing.pieces_of(body):
                at, keys = hashing.shingles(texts, size)
                n = np.bincount(at, minlength=len(texts)).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                digest = np.zeros((len(texts), 2), np.uint64)
                for k, salt in enumerate((0x51, 0xA7)):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashing.mix(keys * np.uint64(2) + np.uint64(salt << 54)))])
                    digest[:, k] = sums[first[1:]] - sums[first[:-1]]
                fresh = np.zeros(len(texts), bool)
                for i, d in enumerate(digest):
                    if n[i] and (name := d.tobytes()) not in known:
                        known.add(name)
                        fresh[i] = True
                keep = fresh[at]
                owners.append((at[keep] + rows).astype(np.uint32))
                hashes.append(keys[keep])
                ids += key.slice(start, len(texts)).to_pylist()
                counts.append(np.where(fresh, n, -n))
                digests.append(digest)
                rows += len(texts)
        if not rows:
            return
        task = TaskContext.get().partitionId()
        owner, word = np.concatenate(owners), np.concatenate(hashes)
        del owners, hashes, known
        order = np.argsort(word, kind="stable")
        owner = owner[order]
        word = word[order]
        del order
        release()
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
        times = np.diff(np.append(head, len(word)))
        often = times >= max(8, rows // FREQUENT)
        listed = ~np.repeat(often, times)
        hot_hash, hot_times = word[head[often]], times[often]
        info = {
            "id": pa.array(ids, pa.int64()), "n": np.concatenate(counts), "low": np.concatenate(digests)[:, 0],
            "high": np.concatenate(digests)[:, 1]}
        sink = pa.BufferOutputStream()
        for table in (pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in info.items()}),
                      pa.table({"at": pa.array(owner[~listed]), "hash": pa.array(word[~listed])})):
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
        owner, word = owner[listed], word[listed]

        def rows_of(at, values, times, kind):
            cuts = np.searchsorted(values >> low, np.arange((1 << bits) + 1, dtype=np.uint64))
            for s in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[s], cuts[s + 1])
                within, places, n = values[part] & mask, None, None
                if at is not None:
                    # In the order of documents their places are small steps, which take little room.
                    by_doc = np.argsort(at[part], kind="stable")
                    within, places = within[by_doc], _steps(at[part][by_doc])
                else:
                    n = times[part].astype(np.int64).tobytes()
                yield {"seg": int(s), "task": task, "kind": kind, "at": places, "hash": _packed(within), "count": n, "info": None}

        def everything():
            yield {"seg": task % (1 << bits), "task": task, "kind": 0, "at": None, "hash": None,
                   "count": None, "info": sink.getvalue().to_pybytes()}
            yield from rows_of(owner, word, None, 1)
            yield from rows_of(None, hot_hash, hot_times, 2)

        yield from _batches(everything(), run.schema)

    run.schema = pa.schema([("seg", pa.int32()), ("task", pa.int32()), ("kind", pa.int32()), ("at", pa.binary()),
                            ("hash", pa.binary()), ("count", pa.binary()), ("info", pa.binary())])
    return run


def _packed(values: np.ndarray) -> bytes:
    """The low 48 bits of each value: all low words, then all high ones."""
    return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (values >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, np.uint32, n).astype(np.uint64)
            | np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _steps(places: np.ndarray) -> bytes:
    """Rising places as steps of two bytes, or of four if one is too wide."""
    steps = np.diff(places.astype(np.int64), prepend=0)
    return steps.astype(np.uint16 if not len(steps) or steps.max() < 1 << 16 else np.uint32).tobytes()


def _places(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32), dtype=np.int64)


def _batches(rows, schema: pa.Schema, limit: int = 8 << 20):
    """Record batches of about `limit` bytes."""
    have, size = [], 0
    for row in rows:
        have.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= limit:
            yield pa.RecordBatch.from_pylist(have, schema)
            have, size = [], 0
    if have:
        yield pa.RecordBatch.from_pylist(have, schema)


_ANSWER = "seg int, task int, kind int, at binary, hash binary, count binary, info binary"


def _count(group: pa.Table) -> pa.Table:
    """Segment side: documents per shingle; the answer to each map task names its shingles of several documents.

    Of kind 1 are answers for documents that the task named, of kind 2 those for its frequent shingles.
    """
    schema = pa.schema([("seg", pa.int32()), ("task", pa.int32()), ("kind", pa.int32()), ("at", pa.binary()), ("hash", pa.binary()),
                        ("count", pa.binary()), ("info", pa.binary())])
    kind = np.asarray(group.column("kind").combine_chunks())
    passed = group.filter(pa.array(kind == 0)).cast(schema)
    blocks = group.filter(pa.array(kind > 0))
    if not blocks.num_rows:
        return passed
    seg = blocks.column("seg")[0].as_py()
    parts = [_unpacked(x) for x in blocks.column("hash").to_pylist()]
    at = [_places(x, len(p)) if x is not None else np.zeros(len(p), np.int64) for x, p in zip(blocks.column("at").to_pylist(), parts)]
    times = [np.frombuffer(x, np.int64) if x is not None else np.ones(len(p), np.int64) for x, p in zip(blocks.column("count").to_pylist(), parts)]
    source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    word, at, times = np.concatenate(parts), np.concatenate(at), np.concatenate(times)
    order = np.argsort(word, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], word[order][1:] != word[order][:-1]]))
    total = np.empty(len(word), np.int64)
    total[order] = np.repeat(np.add.reduceat(times[order], head), np.diff(np.append(head, len(word))))
    keep = np.flatnonzero(total > 1)
    cuts = np.searchsorted(source[keep], np.arange(len(parts) + 1))
    out = []
    for k, (task, kind) in enumerate(zip(blocks.column("task").to_pylist(), blocks.column("kind").to_pylist())):
        mine = keep[cuts[k]:cuts[k + 1]]
        if len(mine):
            out.append({"seg": seg, "task": task, "kind": kind, "at": _steps(at[mine]) if kind == 1 else None, "hash": _packed(word[mine]),
                        "count": np.minimum(total[mine], 0xFFFFFFFF).astype(np.uint32).tobytes(), "info": None})
    return pa.concat_tables([passed, pa.Table.from_pylist(out, schema)])


def _prefixes(num: int, den: int, bits: int):
    """Per map task: rare-first order, prefix, and what verification needs of every set that can have a link."""
    low = np.uint64(hashing.PIECE_BITS - bits)
    schema = pa.schema([("doc_id", pa.int64()), ("vid", pa.binary()), ("n", pa.int32()), ("head", pa.int32()),
                        ("keys", pa.list_(pa.int64())), ("shared", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_pylist()
        source = pa.BufferReader(group.column("info")[kind.index(0)].as_py())
        docs = pa.ipc.open_stream(source).read_all()
        hot = pa.ipc.open_stream(source).read_all()
        ids, n = docs.column("id").to_pylist(), np.asarray(docs.column("n").combine_chunks())
        names = np.stack([np.asarray(docs.column(c).combine_chunks()) for c in ("low", "high")], 1)
        at, word, times = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
        often = [], []
        for block in group.filter(pa.array(np.asarray(kind) > 0)).to_pylist():
            found = _unpacked(block["hash"]) | np.uint64(block["seg"]) << low
            total = np.frombuffer(block["count"], np.uint32)
            if block["kind"] == 1:
                for column, part in zip((at, word, times), (_places(block["at"], len(found)), found, total)):
                    column.append(part)
            else:
                often[0].append(found)
                often[1].append(total)
        if often[0]:
            known, known_times = map(np.concatenate, often)
            order = np.argsort(known)
            known, known_times = known[order], known_times[order]
            hot_hash, hot_at = np.asarray(hot.column("hash").combine_chunks()), np.asarray(hot.column("at").combine_chunks())
            place = np.minimum(np.searchsorted(known, hot_hash), len(known) - 1)
            real = known[place] == hot_hash
            for column, part in zip((at, word, times), (hot_at[real].astype(np.int64), hot_hash[real], known_times[place[real]])):
                column.append(part)
        at, word, times = map(np.concatenate, (at, word, times))
        order = np.lexsort((word, times, at))
        at, word = at[order], word[order]
        cuts = np.searchsorted(at, np.arange(len(ids) + 1))
        out = {f.name: [] for f in schema}
        for i, doc in enumerate(ids):
            size = abs(int(n[i]))
            row = (doc, names[i].tobytes() if size else None, size, None, None, None, None)
            mine = word[cuts[i]:cuts[i + 1]]
            alone = size - len(mine)
            prefix = size - -(-num * size // den) + 1
            if n[i] > 0 and alone < prefix:
                odd = np.bincount((mine >> np.uint64(12)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
                row = (*row[:3], alone, mine[:prefix - alone].astype(np.int64), np.sort(mine).tobytes(), sketch)
            for name, value in zip(out, row):
                out[name].append(value)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema})

    return run


def sets(docs: DataFrame, key: str, body: str, size: int, num: int, den: int) -> DataFrame:
    """One row per document: its set's name (vid) and size, and for sets that can have a link the rarest shared
    shingles (keys) after `head` unshared ones, all shared shingles, and their parity sketch: a bit for every hash
    value, set if an odd number of the shared shingles has it."""
    segments = _segments(docs)
    bits = segments.bit_length() - 1
    sent = bounded(docs).select(F.col(key).cast("bigint"), F.col(body).cast("string")).mapInArrow(tidy(_split(size, bits)), _SENT)
    answered = sent.groupBy("seg").applyInArrow(_count, _ANSWER)
    return answered.groupBy("task").applyInArrow(_prefixes(num, den, bits), _SETS)


def _may_link(num: int, den: int):
    """Length, positional and suffix filters for rows x and y of one prefix shingle."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    small, large = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    # Overlap that the similarity asks for; the bound is for the first shingle that the two share.
    need = F.ceil(F.lit(num) * (x("n") + y("n")) / F.lit(num + den))
    rest = F.least(x("n") - x("place"), y("n") - y("place"))
    # A bit of the sketches that differs stands for a shingle of one set only, and so does every unshared shingle.
    differ = sum((F.bit_count(x(f"s{k}").bitwiseXOR(y(f"s{k}"))) for k in range(WORDS)), x("head") + y("head"))
    return (small * den >= large * num) & (rest >= need) & (differ <= x("n") + y("n") - 2 * need)


def _verify(pairs: DataFrame, kept: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among distinct pairs (a, b), by the exact size of the intersection."""

    def run(batches):
        for batch in batches:
            a, b, n, m, left, right = (batch.column(i) for i in range(6))
            hits = []
            for i, (u, v, x, y) in enumerate(zip(n.to_pylist(), m.to_pylist(), left, right)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (u + v - both):
                    hits.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(hits, pa.int32())), b.take(pa.array(hits, pa.int32()))], ["a", "b"])

    side = lambda c: kept.select(F.col("vid").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"s_{c}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
            .mapInArrow(run, "a binary, b binary"))


def classes(docs: DataFrame, key: str = "doc_id", body: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs.

    Words are runs of bytes other than space and control white space, with A-Z lowered; a document's set is its
    distinct shingles of `size` words, or its whole word sequence if it has fewer. Documents link when
    den * intersection >= num * union, and component_id is the least key that links reach, the row's own included.

    Null and empty texts have no shingles, link with nothing and form their own class. Rows without a key get the
    least key of their class, null if it has none. Rows that repeat a key each give a row and count as documents
    of their own. Equal sets are one vertex, however many rows have them. Other columns are not read, so their
    names don't matter. An empty table gives an empty table.
    """
    table = stored(sets(docs, key, body, size, num, den), "sets")
    shared = table.filter("keys IS NOT NULL")
    kept = shared.groupBy("vid").agg(F.first(F.struct("n", "head", "keys", "shared", "sketch")).alias("s")).select("vid", "s.*")
    kept = stored(kept, "kept")
    sketch = [F.col("sketch")[k].alias(f"s{k}") for k in range(WORDS)]
    keyed = kept.select("vid", "n", "head", *sketch, F.posexplode("keys").alias("i", "word"))
    keyed = keyed.withColumn("place", F.col("head") + F.col("i")).drop("i")

    linked = _may_link(num, den)
    pair = [F.least("x.vid", "y.vid").alias("a"), F.greatest("x.vid", "y.vid").alias("b")]
    links, compared, roots = None, None, None
    open_ = stored(_open(keyed, roots), "open")
    for round_ in range(ROUNDS):
        order = lambda c, k: F.xxhash64(c, F.lit(k))
        if round_ == 0:
            # The same sets for most shingles of a group of copies: half of them those with few shingles of their own.
            own = lambda k: F.struct((F.col("head") / F.col("n")).alias("own"), order("vid", k).alias("by"))
            least = [F.min_by("vid", own(k) if k < HUBS // 2 else order("vid", k)) for k in range(HUBS)]
            hubs = open_.groupBy("word").agg(F.array_distinct(F.array(*least)).alias("vid"))
            hubs = open_.join(hubs.select("word", F.explode("vid").alias("vid")), ["word", "vid"], "left_semi")
        else:
            hubs = spread.top_per_group(open_, ["word"], [order("vid", round_)], MORE_HUBS)
        near = open_.alias("x").join(hubs.alias("y"), (F.col("x.word") == F.col("y.word")) & (F.col("x.root") != F.col("y.root")) & linked)
        near = near.select(F.col("x.vid").alias("vid"), F.col("y.vid").alias("hub")).distinct()
        near = spread.top_per_group(near, ["vid"], [order("hub", round_), F.col("hub")], TRIED)
        pairs = near.select(F.least("vid", "hub").alias("a"), F.greatest("vid", "hub").alias("b")).distinct()
        pairs = stored(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        found = stored(_verify(pairs, kept, num, den), "links")
        compared = pairs if compared is None else compared.unionByName(pairs)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        roots = components(links).withColumnsRenamed({"node": "vid"})
        open_ = stored(_open(keyed, roots), "open")
        if not _crowded(open_):
            break
    # What is still apart and shares a prefix shingle is compared, pair by pair.
    apart = (F.col("x.word") == F.col("y.word")) & (F.col("x.root") < F.col("y.root"))
    crossing = open_.alias("x").join(open_.alias("y"), apart & linked).select(*pair).distinct()
    last = stored(_verify(crossing.join(compared, ["a", "b"], "left_anti"), kept, num, den), "links")
    if roots is None or not last.isEmpty():
        roots = components(last if links is None else links.unionByName(last)).withColumnsRenamed({"node": "vid"})
    return _labelled(table, roots, key)


def _open(keyed: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Prefix rows with the class of their set, for shingles that still lie in several classes."""
    if roots is None:
        placed = keyed.withColumn("root", F.col("vid"))
    else:
        placed = keyed.join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    several = placed.groupBy("word").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return placed.join(several.select("word"), "word", "left_semi")


def _crowded(open_: DataFrame) -> bool:
    """Whether the sets of a shingle that are in different classes could make many pairs for each row."""
    per_class = open_.groupBy("word", "root").agg(F.count("*").cast("double").alias("n"))
    per_word = per_class.groupBy("word").agg(F.sum("n").alias("rows"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    pairs, rows = per_word.agg(F.sum("pairs"), F.sum("rows")).first()
    return (pairs or 0) > PAIRS_A_ROW * (rows or 0)


def _labelled(table: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Every document with the least key of its class; classes of one set are labelled by that set's rows."""
    rows = table.select("doc_id", "vid", "n")
    least = rows.filter("vid IS NOT NULL").groupBy("vid").agg(F.min("doc_id").alias("least"))
    joined = least.join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    classes_ = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    names = joined.join(classes_, "root").select("vid", "component_id")
    return rows.join(names, "vid", "left").select(
        F.col("doc_id").alias(key), F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
