"""Web archives written from and read into a table of chunks.

A payload is streamed as rows of record, chunk number and at most `chunk_bytes` bytes, each with the digest of the
payload up to its end, so no task holds a second copy of a payload and a reader can check a record chunk by chunk.
In the archive a payload of several chunks is a segmented record: a response and its continuations. Of equal payloads
one is kept; the others are revisit records without a payload.

Archives are files of Spark's text writer: every record is one row, and the row separator is the blank line that ends
a record. A field after the version line holds a name drawn for this archive; the pair is the separator by which the
text reader finds records again, in parallel where the file can be split, whatever bytes the payloads hold.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.batches import bounded

CHUNK_BYTES = 1 << 16
_VERSION = "WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"
_CHUNKS = "serial string, chunk int, key bigint, url string, kind string, record_id string, origin_id string, refers_to bigint, bytes bigint, last boolean, head binary, body binary, digest string, digest_so_far string"


def _record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def chunk_table(pages: DataFrame, key: str, url: str, body: str, chunk_bytes: int = CHUNK_BYTES, least_revisit: int = 100) -> DataFrame:
    """One row per chunk of every record; revisits have one row without bytes."""
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    sized = bounded(pages).select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    sized = sized.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    # Keys and digests only: the least key of a payload is found before any payload moves.
    firsts = (sized.filter(F.col("bytes") >= least_revisit).groupBy("digest", "bytes")
              .agg(F.min("key").alias("first"), F.max("key").alias("other")).filter("first < other").drop("other", "bytes"))
    known = sized.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("first") < F.col("key"), F.col("first")))
    names = [c.split()[0] for c in _CHUNKS.split(", ")]

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns, held = [[] for _ in names], 0
            for i in range(batch.num_rows):
                page, link, refers, digest, size = (batch.column(c)[i].as_py() for c in range(5))
                data, serial = memoryview(batch.column(5)[i].as_buffer()), f"{part}-{row}"
                row += 1
                origin = _record_id(page)
                if refers is not None:
                    rows = [(serial, 0, page, link, "revisit", origin, None, refers, size, True, b"", b"", digest, digest)]
                else:
                    rows, so_far = [], hashlib.sha256()
                    for n, at in enumerate(range(0, max(len(data), 1), chunk_bytes)):
                        part_of = data[at:at + chunk_bytes]
                        so_far.update(part_of)
                        name = origin if n == 0 else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{serial}:{n}')}>"
                        rows.append((serial, n, page, link, "response" if n == 0 else "continuation", name, origin, None, size,
                                     at + chunk_bytes >= len(data), _HTTP % size if n == 0 else b"", bytes(part_of), digest, so_far.hexdigest()))
                for one in rows:
                    for column, value in zip(columns, one):
                        column.append(value)
                    held += len(one[11]) + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, run.types)], names)
                    columns, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, run.types)], names)

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    run.types = [kinds[c.split()[1]] for c in _CHUNKS.split(", ")]
    return known.select("key", "url", "refers_to", "digest", "bytes", "payload").mapInArrow(run, _CHUNKS)


def _field(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write(chunks: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", per_file: int = 16_384) -> None:
    """Archives of at most `per_file` records under a folder; chunks of a record stand one after the other."""
    block = F.concat("head", "body")
    segmented = (F.col("kind") == "continuation") | ~F.col("last")
    header = F.concat(
        F.lit(f"{_VERSION}WARC-Archive: {uuid.uuid4().hex}\r\n"),
        _field("WARC-Type", F.col("kind")), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Date", F.lit(date)),
        # A line end inside an address would end the field.
        _field("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.when(F.col("kind") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        _field("WARC-Segment-Number", F.when(segmented, F.col("chunk") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(F.col("kind") == "continuation", F.col("origin_id"))),
        _field("WARC-Segment-Total-Length", F.when(segmented & F.col("last"), F.col("bytes"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        _field("X-Digest-So-Far", F.concat(F.lit("sha256:"), "digest_so_far")),
        _field("X-Serial", F.col("serial")), _field("X-Page", F.col("key")), _field("X-Refers-To-Page", F.col("refers_to")),
        _field("X-Payload-Length", F.col("bytes")), _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    record = F.concat(header.cast("binary"), block).cast("string")
    (chunks.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file)
     .option("compression", compression).text(path))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of an archive folder; `sound` says whether block length and block digest hold."""
    lines = spark.read.option("lineSep", "\r\n").text(path).filter(F.col("value").startswith("WARC-Archive: ")).first()
    schema = spark.range(0).select(F.lit("").alias("value"))
    rows = spark.read.option("lineSep", f"{_VERSION}{lines[0]}\r\n").text(path).filter("value <> ''") if lines else schema
    header = F.substring_index("value", "\r\n\r\n", 1)
    parsed = rows.select(F.str_to_map(header, F.lit("\r\n"), F.lit(": ")).alias("f"), F.octet_length(header).alias("n"),
                         F.col("value").cast("binary").alias("record"))
    get = lambda name: F.try_element_at("f", F.lit(name))
    block = F.substr("record", F.col("n") + 5, get("Content-Length").cast("int"))
    # A record ends with its block and a blank line.
    whole = F.octet_length("record") == F.col("n") + 8 + get("Content-Length").cast("int")
    digest = lambda name: F.substr(get(name), F.lit(len("sha256:") + 1))
    return parsed.select(
        get("X-Serial").alias("serial"), (F.coalesce(get("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk"),
        get("X-Page").cast("bigint").alias("key"), get("WARC-Target-URI").alias("url"), get("WARC-Type").alias("kind"),
        get("X-Refers-To-Page").cast("bigint").alias("refers_to"), get("X-Payload-Length").cast("bigint").alias("bytes"),
        get("WARC-Segment-Number").isNotNull().alias("segmented"), digest("WARC-Payload-Digest").alias("digest"),
        digest("X-Digest-So-Far").alias("digest_so_far"), (whole & (F.sha2(block, 256) == digest("WARC-Block-Digest"))).alias("sound"),
        block.alias("block"))


def _payload(block: Column) -> Column:
    """A response's block without its protocol header."""
    head = F.substring_index(block.cast("string"), "\r\n\r\n", 1)
    return F.substr(block, F.octet_length(head) + 5)


def _stream(batches):
    """Digest and length of every segmented record, chunk by chunk; the running digest is checked at each."""
    names = ["key", "bytes", "digest", "kind", "refers_to", "intact"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    now, state = None, None
    pack = lambda s: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
        (s["key"], s["size"], s["sha"].hexdigest(), "response", None, s["ok"] and s["size"] == s["bytes"] and s["sha"].hexdigest() == s["digest"]), types)], names)
    for batch in batches:
        for i in range(batch.num_rows):
            serial, chunk, key, size, digest, so_far, sound = (batch.column(c)[i].as_py() for c in range(7))
            data = memoryview(batch.column(7)[i].as_buffer())
            if serial != now:
                if state:
                    yield pack(state)
                now, state = serial, {"key": key, "bytes": size, "digest": digest, "size": 0, "sha": hashlib.sha256(), "ok": True, "next": 0}
            state["sha"].update(data)
            state["size"] += len(data)
            state["ok"] &= sound and chunk == state["next"] and state["sha"].hexdigest() == so_far
            state["next"] += 1
    if state:
        yield pack(state)


def read_records(chunks: DataFrame) -> DataFrame:
    """(key, bytes, digest, kind, refers_to, intact) of every record, from its chunks.

    Length and digest of a response are those of the payload read; of a revisit, those that its header names. A record
    of one chunk is checked where it is read; only the chunks of segmented records are brought together, sorted and
    streamed.
    """
    payload = _payload(F.col("block"))
    here = F.col("kind") == "response"
    single = chunks.filter("NOT segmented").withColumn("payload", F.when(here, payload))
    size, sha = F.octet_length("payload").cast("bigint"), F.sha2("payload", 256)
    single = single.withColumns({"size": size, "sha": sha}).select(
        "key", F.coalesce("size", "bytes").alias("bytes"), F.coalesce("sha", "digest").alias("digest"), "kind", "refers_to",
        (F.col("sound") & F.coalesce((F.col("sha") == F.col("digest")) & (F.col("size") == F.col("bytes")), ~here)).alias("intact"))
    many = (chunks.filter("segmented").select("serial", "chunk", "key", "bytes", "digest", "digest_so_far", "sound",
                                              F.when(here, payload).otherwise(F.col("block")).alias("data"))
            .repartition("serial").sortWithinPartitions("serial", "chunk")
            .mapInArrow(_stream, "key bigint, bytes bigint, digest string, kind string, refers_to bigint, intact boolean"))
    return single.unionByName(many)


def archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html",
            chunk_bytes: int = CHUNK_BYTES, least_revisit: int = 100) -> DataFrame:
    """Writes an archive of the pages under `path` and returns the records read back from it.

    Of rows with equal payloads of at least `least_revisit` bytes, those with a key above the least one are revisits of
    it; rows that share the least key are all responses. A null payload is empty; a null key stays null, is never
    revisited and revisits the least key of its payload only if it has one to be compared with, so it is a response.
    A null address leaves its field out. Other columns are not read. An empty table gives an archive without records.
    """
    write(chunk_table(pages, key, url, body, chunk_bytes, least_revisit), path)
    return read_records(read_chunks(pages.sparkSession, path))
