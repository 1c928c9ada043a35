"""Cross-entropy difference of documents between a target and a background n-gram model.

Both models are interpolated bigram models over one vocabulary, with equal order, smoothing and list of bigrams, so that
per-token losses can be subtracted. They know every word and every bigram of all texts; nothing is left out for being rare.

Texts become chunks of a few megabytes, written once, in buckets, and read in place from then on: the chunk's distinct words and its
tokens as places among them. A chunk sends its distinct words and bigrams, sorted and packed, to segments of the hash range. A segment adds up the counts
and answers each chunk with those that differ from the chunk's own, so a bigram that stands nowhere else never comes back. A chunk
then has all counts that its tokens need, and its documents are scored where it lies. No row stands for a single
bigram, so a word or bigram of all documents is one entry per chunk and weighs on no task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import hashing
from gazette.llm.batches import bounded, gathered, tidy
from gazette.session import discard, fresh_path, stored

#: Bytes of texts in a chunk; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Tokens of all texts for each segment of the hash range, on the average; a segment is one group of a task.
SEGMENT = 1 << 22
#: What stands before the first word of a text.
BEGIN = np.uint64(0xB5297A4D3F84D5B5)
#: Which model a chunk's texts count for.
NEITHER, TARGET, BACKGROUND = 0, 1, 2
WORDS, BIGRAMS = 0, 1

_CHUNKS = "chunk bigint, role int, asks boolean, tokens bigint, docs array<bigint>, lengths array<int>, words binary, stream binary"
_BLOCKS = "kind int, segment int, chunk bigint, asks boolean, base int, n int, keys binary, target binary, background binary, first_target binary, first_background binary"
_ANSWERS = "kind int, chunk bigint, base int, n int, at binary, target binary, background binary, first_target binary, first_background binary"
_SCORES = "doc bigint, n bigint, target double, background double"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(),
          "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
#: What is counted of words, and of bigrams.
_COUNTS = ["target", "background", "first_target", "first_background"], ["target", "background"]


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (column.split(" ") for column in ddl.split(", "))])


def _thin(values: np.ndarray) -> bytes:
    """Numbers from zero up in as few bytes each as the largest takes."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _thick(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else np.uint8).astype(np.int64)


def _keys(hashes: np.ndarray, bits: int) -> bytes:
    """The 48 bits behind the leading `bits`: all low words, then all high ones."""
    values = (hashes << np.uint64(bits)) >> np.uint64(16)
    return values.astype(np.uint32).tobytes() + (values >> np.uint64(32)).astype(np.uint16).tobytes()


def _values(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _chunks(side: int, role: int, asks: bool, size: int):
    """Chunks of texts, with words in falling order of their counts, so that the bytes of places compress; chunk numbers follow from the place in the input."""

    def run(batches):
        number = (TaskContext.get().partitionId() * 4 + side) << 32
        for batch in gathered(batches, size):
            for at, texts in hashing.pieces_of(batch.column(1), size, 1 << 16):
                hashes, owner = hashing.words(texts)
                words, stream, times = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(words), np.uint32)
                rank[order] = np.arange(len(words))
                planes = rank[stream].view(np.uint8).reshape(-1, 4).T
                row = {"chunk": number, "role": role, "asks": asks, "tokens": len(stream), "docs": batch.column(0).slice(at, len(texts)).to_pylist(),
                       "lengths": np.bincount(owner, minlength=len(texts)), "words": words[order].tobytes(), "stream": planes.tobytes()}
                yield pa.RecordBatch.from_pylist([row], _schema(_CHUNKS))
                number += 1

    return run


class _Chunk:
    """A chunk's words, with the begin mark behind them, and its bigrams.

    first, second: places of a bigram's words; place: the bigram of each token; keys: hashes of words and of bigrams, and order
    their sorted order; counts: how often each word stands, and stands before another, in the chunk's texts of the target and
    of the background, and how often each bigram does. picked: places of the texts that are the target.
    """

    def __init__(self, row: dict, picked: list[int]):
        words = np.append(np.frombuffer(row["words"], np.uint64), BEGIN)
        stream = np.ascontiguousarray(np.frombuffer(row["stream"], np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1).astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        before = np.empty_like(stream)
        before[1:] = stream[:-1]
        before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = len(words) - 1
        pairs = hashing.mix((words[before] * np.uint64(0x9FB21C651E98DF25)) ^ words[stream])
        found, at, self.place = np.unique(pairs, return_index=True, return_inverse=True)
        self.first, self.second = before[at], stream[at]
        self.keys, self.order = (words, found), (np.argsort(words, kind="stable"), np.arange(len(found)))
        chosen = np.zeros(len(self.lengths), bool)
        chosen[picked] = True
        inside = np.repeat(chosen, self.lengths) if row["role"] != TARGET else np.ones(len(stream), bool)
        tokens = {"target": inside, "background": np.full(len(stream), row["role"] == BACKGROUND)}
        self.counts = {}, {}
        for name, use in tokens.items():
            for kind, column, values in ((WORDS, name, stream), (WORDS, f"first_{name}", before), (BIGRAMS, name, self.place)):
                self.counts[kind][column] = np.bincount(values[use], minlength=len(self.keys[kind]))


def _picks(rows: pa.Table) -> list[int]:
    return [at for picked in rows.column("picked").to_pylist() for at in picked]


def _blocks(bits: int):
    """The words and bigrams of a chunk, cut into segments by the leading bits of their hashes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, out = left.to_pylist()[0], []
        chunk = _Chunk(row, _picks(right))
        for kind in (WORDS, BIGRAMS):
            order = chunk.order[kind]
            keys = chunk.keys[kind][order]
            cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for s in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[s]:cuts[s + 1]]
                out.append({"kind": kind, "segment": int(s), "chunk": row["chunk"], "asks": row["asks"], "base": int(cuts[s]), "n": len(part),
                            "keys": _keys(keys[cuts[s]:cuts[s + 1]], bits), **{c: _thin(values[part]) for c, values in chunk.counts[kind].items()}})
        return pa.Table.from_pylist(out, _schema(_BLOCKS))

    return run


def _settled(group: pa.Table) -> pa.Table:
    """Segment side: totals of each word or bigram, and the answers to chunks: totals that differ from the chunk's own counts.

    A row without a chunk says how many words of the segment any model has seen.
    """
    kind = group.column("kind")[0].as_py()
    names = _COUNTS[kind]
    rows = group.select(["chunk", "asks", "base", "n", *names]).to_pylist()
    ends = np.cumsum([r["n"] for r in rows])
    keys = np.concatenate([_values(x.as_py()) for x in group.column("keys")])
    order = np.argsort(keys, kind="stable")
    fresh = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(fresh) - 1
    total = {name: np.zeros(int(fresh.sum()), np.int64) for name in names}
    del keys, order, fresh
    for row, end in zip(rows, ends):
        for name in names:
            np.add.at(total[name], which[end - row["n"]:end], _thick(row[name], row["n"]))
    out = []
    if kind == WORDS:
        out.append({"kind": kind, "chunk": None, "base": 0, "n": int((total["target"] + total["background"] > 0).sum())})
    for row, end in zip(rows, ends):
        if row["asks"]:
            mine = which[end - row["n"]:end]
            answer = {name: total[name][mine] for name in names}
            at = np.flatnonzero(np.any([answer[name] != _thick(row[name], row["n"]) for name in names], axis=0))
            if len(at):
                out.append({"kind": kind, "chunk": row["chunk"], "base": row["base"], "n": len(at), "at": _thin(np.diff(at, prepend=0)),
                            **{name: _thin(values[at]) for name, values in answer.items()}})
    return pa.Table.from_pylist(out, _schema(_ANSWERS))


def _scored(weight: float, totals: dict[str, int], vocabulary: int):
    """Chunk side: mean losses of the chunk's documents, from its own counts where there is no answer."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        named = right.column("picked").is_valid()
        chunk = _Chunk(row, _picks(right.filter(named)))
        for answer in right.filter(pc.invert(named)).to_pylist():
            at = chunk.order[answer["kind"]][answer["base"] + np.cumsum(_thick(answer["at"], answer["n"]))]
            for name, values in chunk.counts[answer["kind"]].items():
                values[at] = _thick(answer[name], answer["n"])
        n, mean = chunk.lengths, []
        owner = np.repeat(np.arange(len(n)), n)
        for name, total in totals.items():
            share = chunk.counts[BIGRAMS][name] / np.maximum(chunk.counts[WORDS][f"first_{name}"], 1)[chunk.first]
            word = (chunk.counts[WORDS][name] + 1) / (total + vocabulary)
            loss = -np.log(weight * share + (1 - weight) * word[chunk.second])
            mean.append(np.bincount(owner, loss[chunk.place], minlength=len(n)) / np.maximum(n, 1))
        return pa.table([pa.array(row["docs"], pa.int64()), pa.array(n), *map(pa.array, mean)], schema=_schema(_SCORES))

    return run


def _picked(chunks: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(chunk, picked, tokens): the places of the chosen documents in each chunk, and their tokens.

    Documents of a chunk that repeat a key are one row before they meet the chosen keys, so no key weighs on a task.
    """
    each = chunks.filter("asks").select("chunk", F.posexplode(F.arrays_zip("docs", "lengths")).alias("at", "doc"))
    each = each.groupBy("chunk", F.col("doc.docs").alias("doc")).agg(F.collect_list("at").alias("at"), F.sum("doc.lengths").alias("tokens"))
    found = each.join(chosen.select(F.col(key).cast("bigint").alias("doc")).distinct(), "doc", "left_semi")
    return found.groupBy("chunk").agg(F.flatten(F.collect_list("at")).alias("picked"), F.sum("tokens").alias("tokens"))


def scores(docs: DataFrame, target: DataFrame | None = None, background: DataFrame | None = None, key: str = "doc_id", body: str = "text",
           weight: float = 0.7, chosen: DataFrame | None = None) -> DataFrame:
    """(key, n_tokens, target_loss, background_loss, difference) of every row of docs; nats per token.

    target and background are frames with a column `body`; the background is docs unless given. Where the target is a part of docs,
    `chosen`, a frame with a column `key`, names its rows, and no text is read or moved twice; with both, both count. Words are runs of
    bytes other than space and control white space, with A-Z lowered. A token's probability is weight * (share of the bigram
    among those that begin like it) + (1 - weight) * (smoothed share of the word). A negative difference means
    that a document is closer to the target. Words and bigrams are told apart by 48 bits and those that name their segment, more
    with more tokens. To the driver come three totals.

    Null and empty texts have no tokens and three zeros; very long ones are read whole and make a chunk of their own, which one task
    holds. An empty target knows the vocabulary only and gives every word the same probability. A word that neither side has counts
    as unknown. Repeated rows count as often as they come; keys may be null or repeat, and a chosen key chooses all its rows, a null one
    none. Other columns are not read.
    """
    spark = docs.sparkSession
    sides = [(docs, BACKGROUND if background is None else NEITHER, True)]
    sides += [(df, role, False) for df, role in ((target, TARGET), (background, BACKGROUND)) if df is not None]
    parts = []
    for side, (df, role, asks) in enumerate(sides):
        ids = F.col(key).cast("bigint") if asks else F.lit(None).cast("bigint")
        parts.append(bounded(df).select(ids, F.col(body).cast("string")).mapInArrow(tidy(_chunks(side, role, asks, CHUNK)), _CHUNKS))
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    # Bucketed by chunk, so that the two passes over the chunks read them in place.
    name, path = f"chunks_{uuid.uuid4().hex}", fresh_path(spark, "chunks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.option("compression", "zstd").bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    chunks = spark.table(name)

    row = chunks.agg(*(F.coalesce(F.sum(F.when(F.col("role") == r, F.col("tokens"))), F.lit(0)) for r in (TARGET, BACKGROUND)), F.sum("tokens")).first()
    totals = {"target": int(row[0]), "background": int(row[1])}
    bits = max(1, (int(row[2] or 0) // SEGMENT).bit_length())
    if chosen is None:
        picked = spark.createDataFrame([], "chunk bigint, picked array<int>, tokens bigint")
    else:
        picked = stored(_picked(chunks, chosen, key), "picked")
        totals["target"] += picked.agg(F.sum("tokens")).first()[0] or 0
    picked = picked.select("chunk", "picked")
    blocks = chunks.groupBy("chunk").cogroup(picked.groupBy("chunk")).applyInArrow(_blocks(bits), _BLOCKS)
    answers = stored(blocks.groupBy("kind", "segment").applyInArrow(_settled, _ANSWERS), "answers")
    vocabulary = (answers.filter("chunk IS NULL").agg(F.sum("n")).first()[0] or 0) + 1

    said = answers.filter("chunk IS NOT NULL").unionByName(picked, allowMissingColumns=True)
    made = chunks.filter("asks").groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(_scored(weight, totals, vocabulary), _SCORES)
    scored = stored(made, "scores")
    spark.sql(f"DROP TABLE {name}")
    discard(spark, path)
    return scored.select(F.col("doc").alias(key), F.col("n").alias("n_tokens"), F.col("target").alias("target_loss"),
                         F.col("background").alias("background_loss"), (F.col("target") - F.col("background")).alias("difference"))
