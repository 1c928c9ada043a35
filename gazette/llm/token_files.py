"""Token ids of documents in flat binary files with Elias-Fano document boundaries.

An archive is a folder. Rows are range-partitioned and sorted by key; each task encodes its texts in that order and
writes one file, or several if it has many ids:

    magic, ids one after the other (16 or 32 bits each, little-endian), boundaries, keys, trailer

`boundaries` holds where each document starts and where the last ends, `keys` the keys less the first one, both as
Elias-Fano structures with a select structure, so a file of n documents needs a few bits for each and no table
of 64-bit offsets. The trailer has fixed size and says where each section lies. Ids go to the file as they are made, so a task
holds one batch of texts and the lengths of its documents.

A file's name is drawn for the attempt that writes it, and the folder's index, a table written when all tasks have
ended, names the files that count with the ids and documents before each. A task that is run again leaves a
file that nobody reads.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm import elias_fano
from gazette.llm.batches import bounded, gathered, tidy
from gazette.llm.hashing import pieces_of
from gazette.llm.tokens import Words, shared
from gazette.session import fresh_path, stored

MAGIC = b"gztokens"
#: Bytes for an id, ids, documents, documents without a key, first key, and where boundaries and keys begin; then the magic.
TRAILER = struct.Struct("<qqqqqqq8s")
#: Ids after which a task begins another file; places in it fit into 32 bits.
FULL = 1 << 29
#: Bytes of texts that are encoded at a time; more of them have fewer distinct words each.
GATHERED = 8 << 20
#: Ids that a reader takes in at a time, unless one document has more.
TAKEN = 1 << 20

_INDEX = "shard int, part int, path string, docs bigint, ids bigint"
_INDEX_ARROW = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, as named by its scheme, and the path there."""
    return fs.FileSystem.from_uri(path)


class _File:
    """A file that is being written."""

    def __init__(self, folder: str, shard: int, part: int, width: int):
        self.store, base = _store(folder)
        self.name = f"ids-{shard:05d}-{part:03d}-{uuid.uuid4().hex}.bin"
        self.out = self.store.open_output_stream(f"{base}/{self.name}")
        self.out.write(MAGIC)
        self.shard, self.part, self.width, self.sizes, self.keys = shard, part, width, [], []

    def add(self, ids: np.ndarray, sizes: np.ndarray, keys: pa.Array) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.sizes.append(sizes)
        self.keys.append(keys)

    def close(self) -> dict:
        ends = np.cumsum(np.concatenate([[0], *self.sizes])).astype(np.uint64)
        keys = pa.chunked_array(self.keys, pa.int64()).combine_chunks()
        # Rows without a key come first.
        known = np.asarray(keys.slice(keys.null_count), np.int64)
        first = int(known[0]) if len(known) else 0
        boundaries = elias_fano.encode(ends)
        ids = int(ends[-1])
        at = len(MAGIC) + self.width * ids
        self.out.write(boundaries)
        self.out.write(elias_fano.encode(known.view(np.uint64) - np.uint64(first & (1 << 64) - 1)))
        self.out.write(TRAILER.pack(self.width, ids, len(keys), keys.null_count, first, at, at + len(boundaries), MAGIC))
        self.out.close()
        return {"shard": self.shard, "part": self.part, "path": self.name, "docs": len(keys), "ids": ids}


def _written(folder: str, tokenizer: str, end: int, full: int):
    def run(batches):
        words = shared(Words, tokenizer)
        width = 2 if max(words.size, end + 1) <= 1 << 16 else 4
        shard, part, file, have = TaskContext.get().partitionId(), 0, None, 0
        for batch in gathered(batches, GATHERED):
            for at, texts in pieces_of(batch.column(1), min(GATHERED, full), 1 << 16):
                flat, sizes = words.ids(texts)
                flat = np.insert(flat, np.cumsum(sizes), end)
                if file is not None and have + len(flat) > full:
                    yield pa.RecordBatch.from_pylist([file.close()], _INDEX_ARROW)
                    file, part, have = None, part + 1, 0
                file = file or _File(folder, shard, part, width)
                file.add(flat, sizes + 1, batch.column(0).slice(at, len(texts)))
                have += len(flat)
        if file is not None:
            yield pa.RecordBatch.from_pylist([file.close()], _INDEX_ARROW)

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", body: str = "text", full: int = FULL) -> DataFrame:
    """Writes an archive of the ids of all texts in the order of their keys, and returns its index.

    A document is the ids of its whole text, without special tokens, and the id `end`. The index has a row for each file: (shard,
    part, path, docs, ids, start, row): its documents and ids, and how many ids and documents lie before it.
    folder: a path on a store that all tasks reach and pyarrow can open; it should be new.

    A null text is empty: the end id alone. Rows without a key come first, rows that repeat a key are documents of their own in
    the order of a hash of their texts, and rows alike in both are alike in any order. A text of any length is one
    document of one file. Other columns are not read. An empty table gives an index without rows.
    """
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    rows = bounded(docs).select(F.col(key).cast("bigint").alias("key"), F.col(body).cast("string").alias("body"))
    rows = rows.withColumn("tie", F.xxhash64("body"))
    # The hash deals rows without a key, or with one key, to several tasks.
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    files = stored(ordered.select("key", "body").mapInArrow(tidy(_written(folder, tokenizer, end, full)), _INDEX), "files")
    # One row for each file goes through this window.
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    summed = [F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint").alias(name) for c, name in (("ids", "start"), ("docs", "row"))]
    files.select("*", *summed).write.parquet(f"{folder}/index")
    return index(docs.sparkSession, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of an archive."""
    return spark.read.schema(f"{_INDEX}, start bigint, row bigint").parquet(f"{folder}/index")


class Document:
    """A file of an archive, opened for reading; documents are found in place."""

    def __init__(self, folder: str, path: str):
        store, base = _store(folder)
        self.file = store.open_input_file(f"{base}/{path}")
        size = self.file.size()
        self.width, self.ids, self.docs, self.unnamed, self.first, at, keys, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.boundaries = elias_fano.Reader(lambda a, n: self.file.read_at(n, at + a))
        self.named = elias_fano.Reader(lambda a, n: self.file.read_at(n, keys + a))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids from one place to another."""
        return np.frombuffer(self.file.read_at(self.width * (stop - start), len(MAGIC) + self.width * start), f"<u{self.width}")

    def of(self, k: int) -> np.ndarray:
        """The ids of document k of the file."""
        start, stop = self.boundaries.slice(k, k + 2).tolist()
        return self.between(start, stop)

    def keys(self, i: int, j: int) -> pa.Array:
        """The keys of documents i up to j."""
        none = max(0, min(j, self.unnamed) - i)
        known = self.named.slice(max(i, self.unnamed) - self.unnamed, max(j, self.unnamed) - self.unnamed) + np.uint64(self.first & (1 << 64) - 1)
        return pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(known.view(np.int64))])


_DOCS = "key bigint, start bigint, n_tokens bigint, ids binary"


def _read(folder: str, taken: int):
    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with Document(folder, path) as file:
                    at = 0
                    while at < file.docs:
                        # As many documents as hold about `taken` ids; the boundaries of the next ones tell.
                        ends = file.boundaries.slice(at, min(at + 4096, file.docs) + 1).astype(np.int64)
                        count = max(1, int(np.searchsorted(ends, ends[0] + taken, "right")) - 1)
                        ids = file.between(int(ends[0]), int(ends[count])).astype("<u4")
                        cuts = (ends[:count + 1] - ends[0]) * 4
                        body = pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())])
                        yield pa.RecordBatch.from_arrays([file.keys(at, at + count), pa.array(ends[:count] + before), pa.array(np.diff(ends[:count + 1])),
                                                          body.cast(pa.binary())], ["key", "start", "n_tokens", "ids"])
                        at += count

    return run


def read(spark: SparkSession, folder: str, key: str = "doc_id", taken: int = TAKEN) -> DataFrame:
    """(key, start, n_tokens, ids) for every document of an archive, read from its files.

    start: the ids of all documents before it; ids: little-endian unsigned 32-bit numbers. Files are read in parallel,
    a few documents at a time.
    """
    files = index(spark, folder).select("path", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(tidy(_read(folder, taken)), _DOCS).withColumnRenamed("key", key)


def archive(docs: DataFrame, tokenizer: str, end: int, **options) -> DataFrame:
    """Writes an archive in the shared folder and reads it back."""
    folder = fresh_path(docs.sparkSession, "token-files")
    write(docs, folder, tokenizer, end, **options)
    return read(docs.sparkSession, folder)
