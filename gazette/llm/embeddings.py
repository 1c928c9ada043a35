"""Near-duplicate vectors by cosine, compared tile by tile along their principal directions.

The vectors are turned into their principal directions, strongest first, which leaves cosines as they are. For a pair,
the products of the leading directions are added up first; what the others can still add is at most the product of
the two remaining norms. That bound is itself a dot product, of the leading parts with the remaining norm as one more
entry, so a tile of pairs is bounded by one matrix product, and only pairs that can still reach the threshold go on:
to half of the directions, then to the whole vectors in double precision.

Blocks of vectors lie in order of the first direction. Two blocks whose ranges there are farther apart than linked
vectors can be never meet; all others meet in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.components import components
from gazette.session import stored

TILE = 2048
#: Single precision is used for bounds only, and with this much room.
SLACK = 1e-4


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled by the largest entry first, so that no square overflows."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _usable(batches):
    """(key, vector as bytes of doubles) of vectors that have a direction."""
    for batch in batches:
        ids, rows = [], []
        for key, value in zip(batch.column(0), batch.column(1)):
            values = value.values
            if values is None or not len(values) or values.null_count:
                continue
            v = np.asarray(values).astype(np.float64) + 0.0
            if np.isfinite(v).all() and v.any():
                ids.append(key.as_py())
                rows.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["id", "v"])


def _gram(batches):
    """Entries of the sum of outer products of the unit vectors of a partition, by dimension."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        by: dict[int, list] = {}
        for v in batch.column(0):
            by.setdefault(len(v.as_buffer()) // 8, []).append(np.frombuffer(v.as_buffer(), np.float64))
        for d, rows in by.items():
            u = _unit(np.stack(rows))
            sums[d] = sums.get(d, 0) + u.T @ u
    for d, g in sums.items():
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)),
                                          pa.array(j.astype(np.int32)), pa.array(g[i, j])], ["d", "i", "j", "x"])


def directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For every dimension d, a d x d rotation into principal directions over all vectors, strongest first.

    To the driver come d * d / 2 numbers per dimension, whatever the number of vectors.
    """
    entries = vectors.select("v").mapInArrow(_gram, "d int, i int, j int, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    found: dict[int, np.ndarray] = {}
    for r in entries.collect():
        g = found.setdefault(r.d, np.zeros((r.d, r.d)))
        g[r.i, r.j] = g[r.j, r.i] = r.x
    return {d: np.linalg.eigh(g)[1][:, ::-1].copy() for d, g in found.items()}


def _leading(turn: dict[int, np.ndarray]):
    """Dimension and first coordinate of every vector; a hair of its hash keeps equal coordinates apart."""

    def run(batches):
        for batch in batches:
            d, x = [], []
            for name, v in zip(batch.column(0), batch.column(1)):
                v = np.frombuffer(v.as_buffer(), np.float64)
                salt = int.from_bytes(name.as_py()[:4], "little") / 2**32
                d.append(len(v))
                x.append(float(_unit(v[None])[0] @ turn[len(v)][:, 0]) + 1e-7 * salt)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int32()), pa.array(x, pa.float64())], ["vid", "v", "m", "d", "x"])

    return run


def _pack(group: pa.Table) -> pa.Table:
    """A block's vectors as one row."""
    ids = b"".join(group.column("vid").to_pylist())
    x = np.asarray(group.column("x").combine_chunks())
    return pa.table({
        "d": group.column("d").slice(0, 1), "block": group.column("block").slice(0, 1), "low": pa.array([x.min()]), "high": pa.array([x.max()]),
        "ids": pa.array([ids], pa.binary()), "vs": pa.array([b"".join(group.column("v").to_pylist())], pa.binary()),
        "ms": pa.array([np.asarray(group.column("m").combine_chunks()).astype(np.int64).tobytes()], pa.binary())})


def _links_of(u: np.ndarray, w: np.ndarray, turn: np.ndarray, least: float, same: bool):
    """Index pairs with a cosine of at least `least`, tile by tile."""
    d = u.shape[1]
    steps = sorted({max(1, d // 4), max(1, d // 2)})
    y, z = u @ turn, w @ turn
    left = lambda a, k: np.sqrt(np.maximum(0, 1 - (a[:, :k] ** 2).sum(axis=1)))
    bounds = [(np.column_stack([y[:, :k], left(y, k)]).astype(np.float32), np.column_stack([z[:, :k], left(z, k)]).astype(np.float32)) for k in steps]
    for i in range(0, len(u), TILE):
        for j in range(i if same else 0, len(w), TILE):
            a, b = np.nonzero(bounds[0][0][i:i + TILE] @ bounds[0][1][j:j + TILE].T >= least - SLACK)
            a, b = a + i, b + j
            if same:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 1 << 17):
                p, q = a[at:at + (1 << 17)], b[at:at + (1 << 17)]
                for left_part, right_part in bounds[1:]:
                    go = np.einsum("ij,ij->i", left_part[p], right_part[q]) >= least - SLACK
                    p, q = p[go], q[go]
                go = np.einsum("ij,ij->i", u[p], w[q]) >= least
                if go.any():
                    yield p[go], q[go]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of every index, over links a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _compare(turn: dict[int, np.ndarray], least: float):
    """A pair of blocks: for every vector with links, how many, and one vector that links reach."""
    schema = pa.schema([("vid", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        d = rows[0]["d"]
        ids = [[r["ids"][k:k + 16] for k in range(0, len(r["ids"]), 16)] for r in rows]
        u = [_unit(np.frombuffer(r["vs"], np.float64).reshape(-1, d)) for r in rows]
        m = [np.frombuffer(r["ms"], np.int64) for r in rows]
        same = len(rows) == 1
        names = ids[0] if same else ids[0] + ids[1]
        shift, last = (0, 0) if same else (len(ids[0]), 1)
        weight = m[0] if same else np.concatenate(m)
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for a, b in _links_of(u[0], u[last], turn[d], least, same):
            b = b + shift
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            # Only a forest leaves the task, so a group of near copies gives a row per member and not per pair.
            ra, rb = root[a], root[b]
            root = _roots(len(names), ra, rb)[root]
        has = np.flatnonzero(links)
        return pa.table({"vid": pa.array([names[k] for k in has], pa.binary()), "links": pa.array(links[has]),
                         "root": pa.array([names[root[k]] for k in has], pa.binary())}, schema)

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", body: str = "embedding", least: float = 0.9, block: int = 4096) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows with a cosine of at least `least`, component_id is the least key that links reach,
    the row's own included, kept says whether it is the row's own. Null, empty and zero vectors and those with null or
    non-finite entries link with nothing, and neither do vectors of different length. Equal vectors are compared once,
    with their number as weight; that they link is taken from their equality. Rows without a key count as links and get the least key of their component; rows
    that repeat a key count one by one. Other columns are not read. An empty table gives an empty table.

    `block` vectors are a unit of work. Every pair of blocks within reach is a task that gets both, so data moved grow
    as (number of vectors) * (number of blocks within reach).
    """
    every = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(body).cast("array<double>").alias("v"))
    usable = every.mapInArrow(_usable, "id bigint, v binary").withColumn("vid", F.unhex(F.md5("v")))
    single = stored(usable.groupBy("vid").agg(F.first("v").alias("v"), F.count("*").alias("m"), F.min("id").alias("least")), "vectors")
    turn = directions(single)
    placed = single.select("vid", "v", "m").mapInArrow(_leading(turn), "vid binary, v binary, m bigint, d int, x double")
    placed = stored(placed, "placed")
    sizes = {r.d: r.n for r in placed.groupBy("d").agg(F.count("*").alias("n")).collect()}
    reach = (2 - 2 * min(least, 1.0)) ** 0.5 + 1e-5
    found = None
    for d, n in sizes.items():
        parts = -(-n // block)
        mine = placed.filter(F.col("d") == d)
        cuts = mine.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)], 100_000)).first()[0] if parts > 1 else []
        # The place among the cuts, found by the width of the table of cuts and not by a join.
        number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("x")))
        blocks = mine.withColumn("block", number).groupBy("d", "block").applyInArrow(
            _pack, "d int, block int, low double, high double, ids binary, vs binary, ms binary")
        edges = [-2.0, *cuts, 2.0]
        near = F.array(*[F.struct(F.lit(k).alias("block"), F.lit(edges[k]).alias("low"), F.lit(edges[k + 1]).alias("high")) for k in range(parts)])
        other = F.filter(near, lambda o: (o["low"] <= F.col("high") + reach) & (o["high"] >= F.col("low") - reach))
        meets = blocks.withColumn("other", F.explode(other)).withColumn("other", F.col("other.block"))
        met = meets.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).groupBy("one", "two")
        links = met.applyInArrow(_both(_compare(turn, least)), "vid binary, links bigint, root binary")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = single.sparkSession.createDataFrame([], "vid binary, links bigint, root binary")
    found = stored(found, "found")
    counted = found.groupBy("vid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    classes = single.select("vid", "m", "least").join(roots.withColumnRenamed("node", "vid"), "vid", "left")
    classes = classes.withColumn("root", F.coalesce("root", "vid"))
    names = classes.groupBy("root").agg(F.min("least").alias("component"))
    facts = classes.join(names, "root").join(counted, "vid", "left").select(
        "vid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), "component")
    # Rows without a direction never meet the table of vectors, so they come back by their own branch.
    linked = usable.select("id", "vid").join(facts, "vid").select("id", "links", "component")
    alone = every.mapInArrow(_unusable, "id bigint").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(key), F.col("links").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _unusable(batches):
    """Keys of vectors that have no direction."""
    for batch in batches:
        ids = []
        for key, value in zip(batch.column(0), batch.column(1)):
            values = value.values
            if values is not None and len(values) and not values.null_count:
                v = np.asarray(values).astype(np.float64)
                if np.isfinite(v).all() and v.any():
                    continue
            ids.append(key.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["id"])


def _both(compare):
    """A block within reach of another's range may not find it within reach of its own; such a pair cannot have links."""

    def run(key, group):
        one, two = (k.as_py() for k in key)
        if one != two and group.num_rows < 2:
            return pa.table({"vid": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        return compare(group)

    return run
