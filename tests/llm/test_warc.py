import gzip
import hashlib
import random

from gazette.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def wanted(rows, least=100):
    first = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and key is not None:
            first[data] = min(first.get(data, key), key)
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        refers = first.get(data) if key is not None and first.get(data, key) < key else None
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers, True))
    return sorted(out, key=repr)


def check(frame, tmp_path, rows, **options):
    made = warc.archive(frame(rows, SCHEMA), str(tmp_path / "w"), **options).collect()
    assert sorted(map(tuple, made), key=repr) == wanted(rows, options.get("least_revisit", 100))


def odd():
    r = random.Random(1)
    wide = "".join(r.choice("aé日\U0001f600<>\r\n") for _ in range(3000))
    return [(1, "http://a/", wide), (2, "http://b/", wide), (3, None, None), (4, "x", ""), (5, "http://c/", "short"), (6, "http://c/", "short"),
            (7, "a\r\nInjected: yes\r\n\r\n", "WARC/1.1\r\nWARC-Archive: x\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 9), (8, "u: v: w", "\r\n\r\n" * 60),
            (9, "http://d/", "x" * 99), (10, "http://d/", "x" * 99), (11, "http://d/", "x" * 100), (12, "http://d/", "x" * 100), (12, "http://d/", "x" * 100),
            (None, "http://e/", "y" * 300), (13, "http://e/", "y" * 300), (14, "http://f/", "\x00\x01\x7f" * 80)]


def test_odd_pages(frame, tmp_path):
    check(frame, tmp_path, odd())


def test_payloads_in_chunks_cut_inside_characters(frame, tmp_path):
    for size in (7, 64, 1000):
        check(frame, tmp_path / str(size), odd(), chunk_bytes=size)


def test_chunk_table_carries_running_digests(frame):
    rows = warc.chunk_table(frame([(1, "u", "é" * 50)], SCHEMA), "page_id", "url", "html", chunk_bytes=33).orderBy("chunk").collect()
    data = ("é" * 50).encode()
    assert [bytes(r.body) for r in rows] == [data[k:k + 33] for k in range(0, 100, 33)]
    assert [r.digest_so_far for r in rows] == [hashlib.sha256(data[:k + 33]).hexdigest() for k in range(0, 100, 33)]
    assert [r.kind for r in rows] == ["response"] + ["continuation"] * 3 and [r.last for r in rows] == [False, False, False, True]


def test_damage_is_seen(spark, frame, tmp_path):
    path = tmp_path / "w"
    warc.write(warc.chunk_table(frame([(1, "u", "abc" * 50), (2, "v", "d" * 500)], SCHEMA).coalesce(1), "page_id", "url", "html", chunk_bytes=100), str(path))
    for file in path.glob("part-*"):
        file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"d" * 100 + b"\r\n\r\n", b"d" * 99 + b"e\r\n\r\n", 1)))
    for file in path.glob(".part-*.crc"):
        file.unlink()
    records = {r.key: r.intact for r in warc.read_records(warc.read_chunks(spark, str(path))).collect()}
    assert records == {1: True, 2: False}


def test_records_are_framed_as_the_format_asks(frame, tmp_path):
    path = tmp_path / "w"
    warc.write(warc.chunk_table(frame([(1, "u", "abc" * 50)], SCHEMA).coalesce(1), "page_id", "url", "html", chunk_bytes=100), str(path), compression="none")
    data = b"".join(f.read_bytes() for f in sorted(path.glob("part-*")))
    seen = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and {b"WARC-Record-ID", b"WARC-Date", b"WARC-Type", b"Content-Length"} <= set(fields)
        n = int(fields[b"Content-Length"])
        seen.append((fields[b"WARC-Type"], fields.get(b"WARC-Segment-Number")))
        assert data[n:n + 4] == b"\r\n\r\n"
        data = data[n + 4:]
    assert seen == [(b"response", b"1"), (b"continuation", b"2")]


def test_empty_table_and_other_columns(frame, tmp_path):
    assert warc.archive(frame([], SCHEMA), str(tmp_path / "e")).count() == 0
    made = warc.archive(frame([(1, "u", "h", 4, "k")], SCHEMA + ", bytes int, kind string"), str(tmp_path / "x")).first()
    assert (made.key, made.bytes, made.kind) == (1, 1, "response")
