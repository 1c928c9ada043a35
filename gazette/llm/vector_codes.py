"""Codes of vectors from codebooks fitted by Lloyd rounds in which the parts of vectors stay with their entry.

A vector is cut into `parts` equal parts, and every part position has a codebook of its own. The parts live in a table
with one row per owner (position, entry, salt), bucketed by that key. The salts follow the number of vectors, so an
owner's row is bounded even if every part had one entry. A round does this:

1. An owner's row holds the sums of its members. Adding them up by position and entry gives the new codebooks, a few
   thousand numbers.
2. Owners compare their members with the new codebook. Members whose nearest entry is another leave as blocks for the
   owner with the same salt there. Only they are shuffled.
3. Owners drop those that left and take in those that arrived: a cogroup whose one side is read in place, by buckets.

The first assignment sends every part to its owner once, without a name, as a part needs none to be counted; a scan of
the vectors with the final codebooks gives the codes.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.session import discard, fresh_path, stored

#: Bytes of the parts of one position that an owner would hold if one entry had them all.
OWNED = 8 << 20
#: Bytes of vectors that a task gathers before it sends them to their owners.
GATHERED = 16 << 20
#: Components of integers are held within these bounds, so that all sums are exact in 64 bits.
LIMIT = 1 << 26

_KEY = ["position", "entry", "salt"]
_OWNER = "position int, entry int, salt int, n bigint, sums array<bigint>, parts binary"
_BLOCK = "position int, entry int, salt int, parts binary"
_BLOCK_ARROW = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("parts", pa.binary())])
_OWNER_ARROW = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()),
                          ("sums", pa.list_(pa.int64())), ("parts", pa.binary())])


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), with zeros behind the end of shorter vectors."""
    sizes = np.asarray(column.value_lengths())
    flat = np.floor(np.asarray(column.flatten()).astype(np.float64) * scale).clip(-LIMIT, LIMIT).astype(np.int32)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equally near ones, and its squared distance; exact."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * max(rows.shape[1], 1) * most * most < 1 << 53:
        # All products and sums are integers below 2^53, which doubles hold exactly.
        x, c = rows.astype(np.float64), book.astype(np.float64)
        far = (c * c).sum(axis=1) - 2 * (x @ c.T) + (x * x).sum(axis=1)[:, None]
    else:
        far = np.stack([((rows.astype(np.int64) - c) ** 2).sum(axis=1) for c in book.astype(np.int64)], 1)
    entry = far.argmin(axis=1)
    return entry, far[np.arange(len(rows)), entry].astype(np.int64)


def _blocks(rows: np.ndarray, entry: np.ndarray, position: int, salt: int, skip: int = -1):
    """One block for each entry that occurs, but for the one to skip."""
    order = np.argsort(entry, kind="stable")
    cuts = np.searchsorted(entry[order], np.arange(entry.max(initial=-1) + 2))
    for e in np.flatnonzero(np.diff(cuts)):
        if e != skip:
            yield {"position": position, "entry": int(e), "salt": salt, "parts": rows[order[cuts[e]:cuts[e + 1]]].tobytes()}


def _sent(book: np.ndarray, width: int, salts: int, scale: int):
    """Map side of the first assignment: blocks of parts for their owners."""
    parts, _, w = book.shape

    def run(batches):
        held, have, turn = [], 0, TaskContext.get().partitionId()

        def out():
            rows = np.concatenate(held).reshape(-1, parts, w)
            made = []
            for p in range(parts):
                mine = np.ascontiguousarray(rows[:, p])
                made += _blocks(mine, nearest(mine, book[p])[0], p, turn % salts)
            return pa.RecordBatch.from_pylist(made, _BLOCK_ARROW)

        for batch in batches:
            column = batch.column(0)
            step = max(1, GATHERED // (4 * max(width, 1)))
            for at in range(0, len(column), step):
                held.append(_integers(column.slice(at, step), width, scale))
                have += held[-1].nbytes
                if have >= GATHERED:
                    yield out()
                    held, have, turn = [], 0, turn + 1
        if held and sum(map(len, held)):
            yield out()

    return run


def _owner(key: tuple, members: np.ndarray) -> pa.Table:
    row = {"position": key[0], "entry": key[1], "salt": key[2], "n": len(members), "sums": members.sum(axis=0, dtype=np.int64).tolist(), "parts": members.tobytes()}
    return pa.Table.from_pylist([row] if len(members) else [], _OWNER_ARROW)


def _members(table: pa.Table, w: int) -> np.ndarray:
    return np.concatenate([np.empty((0, w), np.int32)] + [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, w) for c in table.column("parts").chunks for x in c])


def _gathered(w: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _owner(tuple(k.as_py() for k in key), _members(group, w))

    return run


def _leaving(book: np.ndarray):
    """Blocks of the members that are nearer to another entry."""

    def run(batches):
        for batch in batches:
            for position, entry, salt, data in zip(*(batch.column(c).to_pylist() for c in _KEY), batch.column("parts")):
                rows = np.frombuffer(data.as_buffer(), np.int32).reshape(-1, book.shape[2])
                made = list(_blocks(rows, nearest(rows, book[position])[0], position, salt, skip=entry))
                if made:
                    yield pa.RecordBatch.from_pylist(made, _BLOCK_ARROW)

    return run


def _settled(book: np.ndarray):
    """An owner's members after a round: those that stayed, and those that arrived."""
    w = book.shape[2]

    def run(key: tuple[pa.Scalar, ...], resident: pa.Table, arrived: pa.Table) -> pa.Table:
        key = tuple(k.as_py() for k in key)
        rows = _members(resident, w)
        stay = nearest(rows, book[key[0]])[0] == key[1] if len(rows) else np.empty(0, bool)
        return _owner(key, np.concatenate([rows[stay], _members(arrived, w)]))

    return run


def _coded(book: np.ndarray, width: int, scale: int):
    parts, _, w = book.shape

    def run(batches):
        for batch in batches:
            rows = _integers(batch.column(2), width, scale).reshape(-1, parts, w)
            found = [nearest(np.ascontiguousarray(rows[:, p]), book[p]) for p in range(parts)]
            codes = [bytes(c).hex() for c in np.stack([e for e, _ in found], 1).astype(np.uint8)]
            error = sum((d for _, d in found), np.zeros(len(rows), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error)], ["vec", "label", "code", "error"])

    return run


class _Owners:
    """The table of owners, bucketed by their key; it is replaced as a whole after every round."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.name = spark, buckets, None

    def put(self, rows: DataFrame) -> None:
        name, path = f"members_{uuid.uuid4().hex}", fresh_path(self.spark, "members")
        rows.write.bucketBy(self.buckets, *_KEY).option("path", path).saveAsTable(name)
        self.drop()
        self.name, self.path = name, path

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            discard(self.spark, self.path)


def _updated(owners: DataFrame, book: np.ndarray) -> np.ndarray:
    """Codebooks of the means of all members, rounded down; an entry without members stays."""
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(book.shape[2])]
    book = book.copy()
    # One row for each position and entry comes to the driver.
    for row in owners.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        book[row.position, row.entry] = [row[f"s{i}"] // row.n for i in range(book.shape[2])]
    return book


def _usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).cast("bigint").alias("vec"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(v.isNotNull() & ~odd)


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16,
          rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """A frame (key, label, code, error), and the codebooks as an array (position, entry, component).

    A component x counts as floor(scale * x). Codebooks start as the parts of the `entries` rows with the least keys. Each of
    the `rounds` rounds assigns every part to the nearest entry of its position, by squared distance with ties to the
    lower index, and replaces entries by floor(sum / count) of their parts; entries without parts stay. code holds the
    indices of the last assignment, two hex digits each; error is the sum of its squared distances.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors whose length differs from the
    longest, or is no multiple of `parts`, count as filled up with zeros; an empty vector is all zeros. Integers beyond
    2^26 count as 2^26, so that sums stay exact. Rows that repeat a key are vectors of their own; among the first
    rows equal keys go by their components, and null keys come last. With fewer rows than `entries` the codebooks have
    that many entries. Other columns are not read. An empty table gives no row and codebooks without entries.
    """
    spark = vectors.sparkSession
    if entries > 256:
        raise ValueError("a code has two hex digits for a part")
    kept = _usable(vectors, key, vector, label)
    total, longest = kept.agg(F.count("*"), F.max(F.size("v"))).first()
    w = -(-(longest or 0) // parts)
    width = w * parts
    first = kept.select("vec", "v").orderBy(F.col("vec").asc_nulls_last(), "v").limit(entries).collect()
    column = pa.array([list(r.v) for r in first], pa.list_(pa.float64()))
    book = _integers(column, width, scale).reshape(len(first), parts, w).transpose(1, 0, 2).astype(np.int64)
    if total and w:
        salts = max(1, -(-total * w * 4 // OWNED))
        owners = _Owners(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
        sent = kept.select("v").mapInArrow(_sent(book, width, salts, scale), _BLOCK)
        owners.put(sent.groupBy(*_KEY).applyInArrow(_gathered(w), _OWNER))
        for round_ in range(rounds):
            before, book = book, _updated(owners.read(), book)
            if round_ == rounds - 1 or (book == before).all():
                # Codebooks that come out as they went in stay so for all rounds.
                break
            moved = owners.read().mapInArrow(_leaving(book), _BLOCK)
            owners.put(owners.read().groupBy(*_KEY).cogroup(moved.groupBy(*_KEY)).applyInArrow(_settled(book), _OWNER))
        owners.drop()
    if not total:
        made = kept.select("vec", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    elif not w:
        made = kept.select("vec", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("bigint").alias("error"))
    else:
        schema = kept.schema
        made = kept.select("vec", "label", "v").mapInArrow(
            _coded(book, width, scale), f"vec bigint, label {schema['label'].dataType.simpleString()}, code string, error bigint")
    return made.withColumnsRenamed({"vec": key}), book


def book_digest(book: np.ndarray) -> str:
    """Hex SHA-256 of all components as decimal numbers with commas between, by position, entry and place."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, heavy: int = 1024) -> DataFrame:
    """The coded rows with label_error, the sum of the errors of all rows of a label; null labels are one label.

    Labels with over 1/heavy of the rows, fewer than `heavy` of them, are joined from a copied table, the others by shuffle,
    so no label brings its rows into one task.
    """
    coded = stored(coded, "coded")
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "sums")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    sums = sums.withColumnRenamed("label", "of")
    often = F.col("rows") * heavy > total
    same = F.col("label").eqNullSafe(F.col("of"))
    hot = F.broadcast(sums.filter(often).select("of", "label_error"))
    rest = coded.join(hot, same, "left_anti").join(sums.filter(~often).select("of", "label_error"), same)
    return coded.join(hot, same).unionByName(rest).drop("of")
