"""Packing of documents into sequences, with the sources mixed by deficit round-robin.

Every source is a queue of documents; a document is a row of packets of at most one sequence. In every round a queue
earns its quantum, its share of one window's tokens, and sends packets while its earnings cover them; what is left
is its deficit, carried to the next round. With a queue that always has packets this has a closed form: the packet
that ends at token e of its queue leaves in round ceil(e / quantum). So nothing is simulated: positions in queues
come from running sums over partitions, rounds from a division, and the order of the output from running sums
over rounds. A deficit crosses windows and partitions because e counts from the start of the queue.

The rounds, with their sources one after the other, are one stream of tokens; sequences are cut from it, so only
the last one has padding.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.batches import bounded, gathered, tidy
from gazette.llm.hashing import pieces_of
from gazette.llm.tokens import Encoder, shared
from gazette.session import fresh_path

#: Bytes of texts that are encoded at a time; more of them have fewer distinct words each.
GATHERED = 8 << 20
_TOKENS = "part int, row bigint, doc bigint, queue string, local bigint, doc_tokens bigint, ids binary"
_PIECES = "doc bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, round bigint"


def _tokenize(path: str, end: int, narrow: bool):
    kind = "<u2" if narrow else "<u4"

    def run(batches):
        encoder, part, row, sent = shared(Encoder, path), TaskContext.get().partitionId(), 0, {}
        for batch in gathered(batches, GATHERED):
            for at, texts in pieces_of(batch.column(1), GATHERED, 1 << 16):
                flat, lengths = encoder.ids(texts)
                if narrow and len(flat) and int(flat.max()) > 0xFFFF:
                    raise ValueError("the vocabulary has ids above 65535; pack with wide ids")
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                flat = flat.astype(kind)
                tail = np.array([end], kind).tobytes()
                local, queues = [], batch.column(2).slice(at, len(texts)).to_pylist()
                for i, queue in enumerate(queues):
                    local.append(sent.get(queue, 0))
                    sent[queue] = local[-1] + int(lengths[i]) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(texts), part, np.int32)), pa.array(np.arange(row, row + len(texts))),
                    batch.column(0).slice(at, len(texts)), pa.array(queues, pa.string()), pa.array(local, pa.int64()),
                    pa.array(lengths + 1), pa.array([flat[cuts[i]:cuts[i + 1]].tobytes() + tail for i in range(len(texts))], pa.binary()),
                ], ["part", "row", "doc", "queue", "local", "doc_tokens", "ids"])
                row += len(texts)

    return run


def _cut(narrow: bool):
    """The ids of every piece, from the ids of its document."""
    kind = "<u2" if narrow else "<u4"

    names = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "round"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 4

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                columns = [[] for _ in names]
                docs, totals, every, places = (c.slice(at, 1024) for c in batch.columns)
                for doc, total, ids, pieces in zip(docs.to_pylist(), totals.to_pylist(), every, places.to_pylist()):
                    ids = np.frombuffer(ids.as_buffer(), kind)
                    for p in sorted(pieces, key=lambda p: p["start"]):
                        part = ids[p["start"]:p["start"] + p["length"]].astype("<u4").tobytes()
                        for column, value in zip(columns, (doc, p["start"], p["length"], part, total, p["sequence_id"], p["offset"], p["round"])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", body: str = "text", source: str = "source", sequence: int = 1024,
         window: int = 64, weights: dict[str, float] | None = None, end: int = 0, narrow: bool = True) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset, round) of all documents.

    ids are little-endian unsigned 32-bit numbers. A document is its text's ids and the id `end`; every id lies in
    exactly one piece. Sequences hold `sequence` tokens, all but the last full; a round aims at `window` sequences.
    weights: target share of each source; a source that they don't name has weight 0 and goes with a quantum of one
    token; without weights the targets are the sources' own shares of tokens, so that all queues end together. A
    source that runs dry leaves its place to the others. narrow: ids fit into 16 bits; it raises where they don't.

    A null text is empty: one piece with the end id. Null sources are a queue of their own, null keys are kept, and
    rows that repeat a key are documents of their own. Packets keep the order in which a queue's rows are read. Other
    columns are not read. An empty table gives no piece.
    """
    spark = docs.sparkSession
    queue = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    path = fresh_path(spark, "tokens")
    # Tokens are made once and written: their counts fix the layout, and a lost executor does not make them again.
    (bounded(docs).select(F.col(key).cast("bigint"), F.col(body).cast("string"), queue)
     .mapInArrow(tidy(_tokenize(tokenizer, end, narrow)), _TOKENS).write.option("compression", "zstd").parquet(path))
    tokens = spark.read.schema(_TOKENS).parquet(path)

    parts = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("tokens"))
    queues = parts.groupBy("queue").agg(F.sum("tokens").alias("total"))
    total = queues.agg(F.sum("total")).first()[0] or 0
    room = window * sequence
    if weights is None:
        share = F.col("total") / F.lit(float(max(total, 1)))
    else:
        named = F.create_map(*[F.lit(x) for s, w in weights.items() for x in ("=" + s, float(w))])
        share = F.coalesce(F.try_element_at(named, F.col("queue")), F.lit(0.0)) / F.lit(float(sum(weights.values())))
    queues = queues.select("queue", "total", F.greatest(F.lit(1), F.round(share * room)).cast("bigint").alias("quantum"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")).join(queues.drop("total"), "queue")

    # A document leaves in the rounds from that of its first packet to that of its last; `upto` is how much has left by a round.
    placed = tokens.select("part", "row", "queue", "doc_tokens", "local").join(bases, ["queue", "part"])
    placed = placed.withColumn("at", F.col("base") + F.col("local")).drop("base", "local")
    rounds = F.sequence(F.expr(f"(at + least(doc_tokens, {sequence}L) - 1) div quantum + 1"), F.expr("(at + doc_tokens - 1) div quantum + 1"))
    upto = "CASE WHEN at + doc_tokens <= {r} * quantum THEN doc_tokens ELSE greatest(0L, ({r} * quantum - at) div " + f"{sequence}L * {sequence}L) END"
    runs = (placed.withColumn("round", F.explode(rounds))
            .withColumn("start", F.expr(upto.format(r="(round - 1)"))).withColumn("stop", F.expr(upto.format(r="round")))
            .filter("start < stop").withColumn("first", F.col("at") + F.col("start"))
            .select("part", "row", "queue", "round", "start", "stop", "first"))

    groups = runs.groupBy("round", "queue").agg(F.sum(F.col("stop") - F.col("start")).alias("tokens"), F.min("first").alias("head"))
    # Running sums over the rounds go in two levels of about equal size.
    last = queues.agg(F.max(F.expr("(total - 1) div quantum + 1"))).first()[0] or 0
    block = max(1, math.isqrt(last))
    groups = groups.withColumn("block", F.expr(f"round div {block}"))
    blocks = groups.groupBy("block").agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.select("block", (F.sum("tokens").over(Window.orderBy("block")) - F.col("tokens")).alias("before"))
    inside = Window.partitionBy("block").orderBy("round", "queue")
    groups = groups.withColumn("inside", F.sum("tokens").over(inside) - F.col("tokens")).join(blocks, "block")
    groups = groups.select("round", "queue", (F.col("before") + F.col("inside") - F.col("head")).alias("shift"))

    stream = runs.join(groups, ["round", "queue"]).withColumn("place", F.col("first") + F.col("shift"))
    pieces = stream.withColumn("sequence_id", F.explode(F.expr(
        f"sequence(place div {sequence}L, (place + stop - start - 1) div {sequence}L)")))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * sequence)
    finish = F.least(F.col("place") + F.col("stop") - F.col("start"), (F.col("sequence_id") + 1) * sequence)
    piece = F.struct((F.col("start") + begin - F.col("place")).alias("start"), (finish - begin).alias("length"), "sequence_id",
                     (begin - F.col("sequence_id") * sequence).alias("offset"), "round")
    of_doc = pieces.groupBy("part", "row").agg(F.collect_list(piece).alias("pieces"))
    # One shuffle of the ids brings them to their pieces; part and row are unique, so no source weighs on a task.
    cut = tokens.select("part", "row", "doc", "doc_tokens", "ids").join(of_doc, ["part", "row"])
    return cut.select("doc", "doc_tokens", "ids", "pieces").mapInArrow(tidy(_cut(narrow)), _PIECES).withColumnRenamed("doc", key)
