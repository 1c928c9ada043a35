import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gazette.llm import elias_fano, token_files
from gazette.llm.queries import QUERIES
from gazette.llm.tokens import Words

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoder():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def brute(docs, end):
    """(key, start, n, crc32) of every document, in order."""
    encode, out, start = encoder(), [], 0
    for key, text in docs:
        ids = np.array([*encode(text), end], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_the_query_agrees_with_plain_encoding(spark, small):
    docs = sorted((r.doc_id, r.text) for r in small("documents").collect())
    made = QUERIES["op12_elias_fano_token_files"](spark, "/root/testdata/sf0.001")
    assert made.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, made.collect())) == brute(docs, 2)


ODD = ["don't, we're!", "ábc", "Á.", "x \x01 y", "\x01", "a b", "<|endoftext|> hi", "...", "can't.'s", "3.14, 2", "ς Σ", "tab\tnew\nline", "İstanbul.",
       "x).", "a.b.", "ͅ.", "日本語。テスト.", ".̸", "", None, " ", "WORD word Word, word."]


def test_odd_rows(spark, frame, tmp_path):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(-5, "first"), (40, "w " * 30_000), (2**62, "x"), (-2**62, "y")]
    rows = [(k, t, 1, "c") for k, t in docs]
    folder = str(tmp_path / "a")
    index = token_files.write(frame(rows, "doc_id bigint, text string, start int, ids string"), folder, PATH, end=2, full=50)
    assert index.count() > 3
    made = token_files.read(spark, folder, taken=10).withColumn("crc", F.crc32("ids")).drop("ids")
    assert sorted(map(tuple, made.collect())) == brute(sorted(docs), 2)


def test_rows_without_key_and_repeated_keys(spark, frame, tmp_path):
    rows = [(None, "a b"), (3, "c"), (None, None), (3, "d e f"), (1, "g"), (3, "c")]
    folder = str(tmp_path / "a")
    token_files.write(frame(rows, "doc_id bigint, text string"), folder, PATH, end=2)
    encode = encoder()
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 3, 3, 3] and got[0].start == 0
    assert all(x.start + x.n_tokens == y.start for x, y in zip(got, got[1:]))
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=key) == sorted(((k, [*encode(t), 2]) for k, t in rows), key=key)


def test_documents_are_found_in_place(spark, small, tmp_path):
    folder = str(tmp_path / "a")
    index = token_files.write(small("documents"), folder, PATH, end=2)
    texts, encode = {r.doc_id: r.text for r in small("documents").collect()}, encoder()
    for row in index.collect():
        with token_files.Document(folder, row.path) as file:
            assert file.docs == row.docs and file.ids == row.ids and file.width == 2
            for k in (0, file.docs // 2, file.docs - 1):
                assert file.of(k).tolist() == [*encode(texts[file.keys(k, k + 1)[0].as_py()]), 2]
            # Boundaries and keys take a few bits, not 64 each.
            assert 8 * (file.boundaries.size - 32) < 24 * file.docs + 400 and 8 * (file.named.size - 32) < 12 * file.docs + 400


def test_files_of_lost_tasks_are_not_read(spark, frame, tmp_path):
    folder = str(tmp_path / "a")
    token_files.write(frame([(1, "a b"), (2, "c")], "doc_id bigint, text string"), folder, PATH, end=2)
    (tmp_path / "a" / "ids-00000-000-lost.bin").write_bytes(b"half a file")
    assert token_files.read(spark, folder).count() == 2


def test_empty_table(spark, frame):
    assert token_files.archive(frame([], "doc_id bigint, text string"), PATH, end=2).count() == 0


def test_words_are_forgotten_and_learned_again():
    import pyarrow as pa

    words, encode = Words(PATH, keep=40), encoder()
    for k in range(6):
        texts = [f"Word{k} number {i}, and {i * k}! thing-{i}" for i in range(20)]
        ids, sizes = words.ids(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=600), st.integers(0, 60), st.data())
def test_elias_fano_gives_numbers_back(values, shift, data):
    values = np.sort(np.array([v >> shift for v in values], np.uint64))
    coded = elias_fano.encode(values)
    reader = elias_fano.Reader(lambda at, size: coded[at:at + size])
    assert reader.size == len(coded) and reader.slice(0, len(values)).tolist() == values.tolist()
    if len(values):
        i = data.draw(st.integers(0, len(values) - 1))
        j = data.draw(st.integers(i, len(values)))
        assert reader.select(i) == values[i] and reader.slice(i, j).tolist() == values[i:j].tolist()
    with pytest.raises(IndexError):
        reader.slice(0, len(values) + 1)
