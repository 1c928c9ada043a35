"""Streaming queries over events that land in several files, some of them twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.plans.registry import query
from gazette.session import fresh_path, table
from gazette.streaming import ingest

LATE = "40 days"
EARLIEST, LATEST = "2023-10-01", "2024-02-01"
SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
CHUNKS = 3


def arrive(spark, folder, step, time="ts", again="value > 10"):
    """Events land chunk by chunk in the order of their ids, the large ones once more with the last chunk.

    After each chunk, rows are parted by `triage` and `step` runs on those that were kept. Tasks write the files that they read.
    Returns the folder of the parted rows.
    """
    landing, parted = fresh_path(spark, "landing"), fresh_path(spark, "parted")
    events = table(spark, folder, "events").withColumn("ts", F.expr(time).cast("timestamp"))
    chunk = F.expr(f"least({CHUNKS - 1}, event_id * {CHUNKS} div {_last(events)})")
    for number in range(CHUNKS):
        rows = events.filter(chunk == number)
        if again and number == CHUNKS - 1:
            rows = rows.unionByName(events.filter(again))
        rows.write.mode("append").parquet(landing)
        ingest.triage(ingest.landed(spark, landing, SCHEMA), parted, "ts", EARLIEST, LATEST, LATE)
        step(ingest.kept(spark, parted, SCHEMA))
    return parted


def _last(events):
    """One more than the greatest event id."""
    return (events.agg(F.max("event_id")).first()[0] or 0) + 1


@query("stream_dedupe", "SELECT event_id, user_id, event_type, value FROM events")
def stream_dedupe(spark, folder):
    out = fresh_path(spark, "deduped")
    arrive(spark, folder, lambda rows: ingest.run(
        ingest.dedupe(rows, "event_id", "ts", LATE).select("event_id", "user_id", "event_type", "value"), out))
    return ingest.result(spark, out, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE")


def _windows(spark, folder, length, slide=None):
    out = fresh_path(spark, "windows")
    arrive(spark, folder, lambda rows: ingest.run(ingest.window_counts(rows, "ts", ["event_type"], LATE, length, slide), out, mode="update"))
    rows = ingest.latest(spark, out, "start TIMESTAMP, event_type STRING, n BIGINT", ["start", "event_type"], ["n"])
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_LANDED = "(SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 10)"


@query("stream_daily", f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM {_LANDED} GROUP BY ALL")
def stream_daily(spark, folder):
    """Arrivals per day and type, repeats included."""
    return _windows(spark, folder, "1 day")


@query("stream_sliding", f"""
    SELECT strftime(CAST(ts AS DATE) - CAST(g AS INT), '%Y-%m-%d') AS day, event_type, count(*) AS n
    FROM {_LANDED}, generate_series(0, 6) s(g) GROUP BY ALL""")
def stream_sliding(spark, folder):
    """Arrivals per type in the seven days from each day."""
    return _windows(spark, folder, "7 days", "1 day")


@query("stream_upsert", """
    SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id""")
def stream_upsert(spark, folder):
    """The first event of each user that arrives, inserted once."""
    out = fresh_path(spark, "inserted")
    arrive(spark, folder, lambda rows: ingest.insert_new(rows.select("user_id", "event_id"), out, "user_id", "event_id"))
    return ingest.result(spark, out, "user_id BIGINT, event_id BIGINT")


# Times of some events are moved: a far future, none at all, and two months back, which is too late once later events are in.
_MOVED = "CASE event_id % 50 WHEN 1 THEN ts + INTERVAL '80' YEAR WHEN 2 THEN NULL WHEN 3 THEN ts - INTERVAL '60' DAY ELSE ts END"


@query("stream_quarantine", f"""
    WITH moved AS (SELECT event_id, least({CHUNKS - 1}, event_id * {CHUNKS} // (SELECT max(event_id) + 1 FROM events)) AS chunk,
                          {_MOVED} AS ts FROM events),
         fits AS (SELECT *, coalesce(ts BETWEEN TIMESTAMP '{EARLIEST}' AND TIMESTAMP '{LATEST}', false) AS fits FROM moved),
         marks AS (SELECT c.chunk, max(f.ts) AS mark FROM (SELECT DISTINCT chunk FROM moved) c JOIN fits f ON f.fits AND f.chunk < c.chunk
                   GROUP BY c.chunk)
    SELECT event_id, CASE WHEN NOT fits THEN 'implausible' WHEN ts < mark - INTERVAL '40' DAY THEN 'late' ELSE 'kept' END AS fate
    FROM fits LEFT JOIN marks USING (chunk)""")
def stream_quarantine(spark, folder):
    """Every landed event, kept or set aside with the reason."""
    parted = arrive(spark, folder, lambda rows: None, _MOVED, again=None)
    return ingest.fates(spark, parted, SCHEMA).select("event_id", "fate")
