"""Exact vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators import spread

#: Vectors of a block, and bytes of query vectors that are copied to all executors in one pass.
BLOCK, COPIED = 2048, 64 << 20


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; zero when either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def unit_score(c: Column) -> Column:
    """Cosine mapped to 0..1."""
    return F.least(F.greatest((c + 1) / 2, F.lit(0.0)), F.lit(1.0))


def centroid(column: str, size: int) -> Column:
    """Mean vector as an aggregate; one number per dimension, merged map-side."""
    return F.array(*[F.avg(F.col(column)[i].cast("double")) for i in range(size)])


_BLOCKS = "dim int, ids binary, data binary"


def _blocks(batches):
    """Blocks of vectors of one dimension, brought to length one, as matrices in bytes; a vector without length stays zero.

    The values of a list column lie side by side in its buffer, so a batch becomes a matrix without a look at its rows.
    Null vectors and those with null components are left out.
    """
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        flat, sizes = column.flatten(), np.asarray(column.value_lengths().fill_null(-1)).astype(np.int64)
        begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        values = np.asarray(flat.fill_null(float("nan"))).astype(np.float64)
        for dim in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == dim)
            matrix = values[begin[rows][:, None] + np.arange(dim)]
            whole = ~np.isnan(matrix).any(axis=1)
            rows, matrix = rows[whole], matrix[whole]
            length = np.sqrt((matrix * matrix).sum(axis=1))
            matrix /= np.where(length > 0, length, 1.0)[:, None]
            names = np.asarray(ids.take(pa.array(rows))).astype(np.int64)
            for at in range(0, len(rows), BLOCK):
                part = slice(at, at + BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([names[part].tobytes()], pa.binary()),
                                                  pa.array([matrix[part].tobytes()], pa.binary())], ["dim", "ids", "data"])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by score downwards, then by id."""
    if len(ids) > k:
        # All that tie with the k-th score stay until the ids decide.
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _searched(k: int, min_score: float):
    """The k best vectors of a task for every query: a bounded list per query, merged block by block."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, ids, data, asked, wanted in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                ids, asked = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(asked.as_buffer(), np.int64)
                scores = np.frombuffer(wanted.as_buffer()).reshape(-1, dim) @ np.frombuffer(data.as_buffer()).reshape(-1, dim).T
                scores = np.round(scores, 6) + 0.0
                for row, name in zip(scores, asked.tolist()):
                    old = held.get(name)
                    fit = np.flatnonzero(row >= (min_score if old is None or len(old[0]) < k else max(min_score, old[1][-1])))
                    if len(fit):
                        some = ids[fit], row[fit]
                        held[name] = _best(*(some if old is None else (np.concatenate(x) for x in zip(old, some))), k)
        names = list(held)
        for at in range(0, len(names), 4096):
            part = names[at:at + 4096]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(part, [len(held[n][0]) for n in part]), pa.int64()), pa.array(np.concatenate([held[n][0] for n in part])),
                pa.array(np.concatenate([held[n][1] for n in part]))], ["query", "vector", "score"])

    return run


def top_many(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0, column: str = "embedding", key: str = "vec_id",
             query_key: str = "query_id", query_column: str = "embedding") -> DataFrame:
    """(query_key, key, score, rank): for every query the k vectors with the largest cosine, of equal ones the least keys.

    Vectors are read once for COPIED bytes of queries: blocks of them are multiplied with blocks of queries, and a task keeps k
    rows per query, so k rows per query and task are shuffled. The bytes of the queries are counted first, and more than COPIED
    go in several passes, by a hash of their keys. Vectors and queries meet if they have the same dimension.
    Null vectors and those with null components or without a key are left out; one without length has cosine zero with all.
    """
    asked = queries.select(F.col(query_key).cast("bigint").alias("q"), F.col(query_column).cast("array<double>").alias("v")).filter("q IS NOT NULL AND v IS NOT NULL")
    size = asked.agg(F.sum(F.size("v") * F.lit(8).cast("bigint"))).first()[0] or 0
    passes = max(1, -(-size // COPIED))
    rows = vectors.select(F.col(key).cast("bigint").alias("i"), F.col(column).alias("v")).filter("i IS NOT NULL AND v IS NOT NULL").mapInArrow(_blocks, _BLOCKS)
    found = None
    for p in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == p) if passes > 1 else asked
        blocks = mine.mapInArrow(_blocks, _BLOCKS).withColumnsRenamed({"ids": "asked", "data": "wanted"})
        part = rows.join(F.broadcast(blocks), "dim").mapInArrow(_searched(k, min_score), "query bigint, vector bigint, score double")
        found = part if found is None else found.unionByName(part)
    ranked = spread.top_per_group(found, ["query"], [F.col("score").desc(), F.col("vector")], k, "rank")
    return ranked.select(F.col("query").alias(query_key), F.col("vector").alias(key), "score", "rank")
