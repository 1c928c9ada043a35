import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gazette.llm import packing
from gazette.llm.queries import QUERIES, TOKENIZER
from gazette.llm.tokens import Encoder

PATH = public_tokenizers.path(TOKENIZER)
SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


ODD = ["a b", " a", "a ", "", "  ", None, "a  b c", "x\n y", "it's 'tis  ok", "<|endoftext|> a <|endoftext|>", "é à ü", "a\tb c\td", " x y  z",
       " \n", "tab\t tab", "日本 語 です", "Ġa Ġ b", "a\x1cb c", "same same same", "x" * 3000]


@pytest.mark.parametrize("keep", [1 << 20, 3])
def test_ids_are_those_of_the_tokenizer(small, tokenizer, keep):
    encoder = Encoder(PATH, keep)
    texts = [r.text for r in small("documents").limit(60).collect()]
    for part in (ODD, texts, ODD[::-1] + texts[::3], [None], [""], []):
        flat, lengths = encoder.ids(pa.array(part, pa.string()))
        wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert lengths.tolist() == [len(w) for w in wanted] and flat.tolist() == [i for w in wanted for i in w]


def check(rows, pieces, tokenizer, sequence):
    """Every id in exactly one piece, every sequence gapless and full but the last."""
    wanted = sorted((d if d is not None else -1, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, _ in rows)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        of_doc[p.doc_id if p.doc_id is not None else -1].append((p.start, ids, p.doc_tokens))
        of_sequence[p.sequence_id].append((p.offset, p.length))
    assert sum(p.length for p in pieces) == sum(len(w) for _, w in wanted)
    for key, ids in wanted:
        if sum(k == key for k, _ in wanted) == 1:
            assert [i for _, part, _ in sorted(of_doc[key]) for i in part] == ids
            assert {n for _, _, n in of_doc[key]} == {len(ids)}
    last = max(of_sequence, default=-1)
    assert sorted(of_sequence) == list(range(last + 1))
    for number, parts in of_sequence.items():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends == sequence or number == last and ends <= sequence


def test_odd_rows(frame, tokenizer):
    rows = [(i, t, [None, "a", "", "b"][i % 4]) for i, t in enumerate(ODD)] + [(None, "no key", "a"), (3, "", "a"), (3, "again", "a")]
    made = packing.pack(frame(rows, SCHEMA), PATH, sequence=16, window=2).collect()
    check(rows, made, tokenizer, 16)


def test_empty_table_and_other_columns(frame, tokenizer):
    assert packing.pack(frame([], SCHEMA), PATH).count() == 0
    rows = [(1, "a b c", "s", 7, "x"), (2, "d", "t", 8, "y")]
    made = packing.pack(frame(rows, SCHEMA + ", ids int, queue string"), PATH, sequence=4).collect()
    check([r[:3] for r in rows], made, tokenizer, 4)


def simulated(queues, quantum, packet):
    """Rounds of deficit round-robin, packet by packet, as it is defined."""
    at, deficit, round_, out = {q: 0 for q in queues}, {q: 0 for q in queues}, 0, {}
    packets = {q: [(doc, k, min(packet, n - k)) for doc, n in docs for k in range(0, n, packet)] for q, docs in queues.items()}
    while any(at[q] < len(packets[q]) for q in queues):
        round_ += 1
        for q in queues:
            deficit[q] += quantum[q]
            while at[q] < len(packets[q]) and packets[q][at[q]][2] <= deficit[q]:
                doc, k, n = packets[q][at[q]]
                deficit[q] -= n
                out[doc, k] = round_
                at[q] += 1
    return out


def test_rounds_are_those_of_deficit_round_robin(spark, tokenizer):
    rows = [(i, "word " * (i * 7 % 40) + "end", "abc"[0 if i % 2 else i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    made = packing.pack(df, PATH, sequence=8, window=4, weights={"a": 1, "b": 2, "c": 1}).collect()
    check(rows, made, tokenizer, 8)
    queues = defaultdict(list)
    for i, t, s in rows:
        queues[s].append((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1))
    wanted = simulated(queues, {"a": 8, "b": 16, "c": 8}, 8)
    got = {}
    for p in made:
        for k in range(-(-p.start // 8) * 8, p.start + p.length, 8):
            got[p.doc_id, k] = p.round
    assert got == wanted


def test_windows_keep_the_proportions(spark):
    """With targets of the sources' own shares every window is within a packet of them, over all partitions."""
    rows = [(i, f"w{i} " * (5 + i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    made = packing.pack(df, PATH, sequence=64, window=32).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    share = made.groupby("source")["length"].sum() / made["length"].sum()
    per = made.pivot_table(index="round", columns="source", values="length", aggfunc="sum").fillna(0).cumsum()
    due = np.outer(per.index, share * 64 * 32)
    whole = per.index < per.index.max() - 1
    assert (np.abs(per.values - due)[whole] <= 64 + per.index.values[whole][:, None]).all()


def test_query_has_the_digests(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    made = QUERIES["op3_mixture_packing"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in texts.items()}
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id]) for p in made)
    assert sum(p.length for p in made) == sum(map(len, ids.values()))
    assert max(p.sequence_id for p in made) + 1 == -(-sum(map(len, ids.values())) // 1024)


def test_wide_ids_are_refused_where_they_do_not_fit(frame):
    made = packing.pack(frame([(1, "a b", "s")], SCHEMA), PATH, narrow=False).select(F.hex("ids").alias("x")).first().x
    assert len(made) == 3 * 8
