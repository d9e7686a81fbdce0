"""Queries of the general problems (sessions, instants, deliveries) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators import delivery, instants, sessions
from corpuskiln.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.chat_bursts(table(spark, d, "imessage_messages", "id", "thread_id", "timestamp", "text", "message_type", "created_at"))


def p1_user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the event stream: each user's events cut at gaps over 30 minutes."""
    e = table(spark, d, "events", "user_id", "ts").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    return sessions.sessions(e, "user_id", F.col("_t"), gap_us=1800 * 10**6).select("user_id", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n_events").cast("long").alias("n_events"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.found_instants(
        table(spark, d, "messages", "id", "uid", "folder", "date_str"),
        table(spark, d, "imessage_threads", "id", "source_file", "date_start", "created_at"),
        table(spark, d, "parsed_notes", "id", "source_file", "created_at"),
        table(spark, d, "source_zones"),
    )


def p3_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Every source as if its zone were not declared: what estimation finds, and how many instants come out as declared."""
    rows = instants.dated_rows(
        table(spark, d, "messages", "id", "uid", "folder", "date_str"),
        table(spark, d, "imessage_threads", "id", "source_file", "date_start", "created_at"),
        table(spark, d, "parsed_notes", "id", "source_file", "created_at"),
    )
    return instants.zone_estimates(rows, table(spark, d, "source_zones"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.found_pairs(table(spark, d, "messages", "id", "folder", "uid", "batch_no"), table(spark, d, "email_messages", "id", "message_id", "batch_no"))


def p6_seen_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after all batches: disjoint ranges of uid seen in each folder."""
    m = table(spark, d, "messages", "folder", "uid")
    return delivery.ledger_of(m, delivery.folder_key(F.col("folder")), F.col("uid")).select(F.col("producer").alias("folder"), "lo", "hi")


def p6_unique_headers(spark: SparkSession, d: str) -> DataFrame:
    """Each header once: the copy of the earliest batch."""
    m = table(spark, d, "messages", "id", "folder", "uid", "subject", "batch_no")
    return delivery.keep_once(m, "id", **delivery.header_deliveries(m)).select("id", delivery.folder_key(F.col("folder")).alias("folder"), "uid", "subject")


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """The rows that were delivered more than once, each with the delivery that is kept: one row each instead of pairs."""
    return delivery.found_members(table(spark, d, "messages", "id", "folder", "uid", "batch_no"), table(spark, d, "email_messages", "id", "message_id", "batch_no"))


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batch by batch: what came, what was accepted, what the ranges covered by then."""
    return delivery.by_batch(table(spark, d, "messages", "id", "folder", "uid", "batch_no"))


def p6_later_batches(spark: SparkSession, d: str) -> DataFrame:
    """A second run: the batches from 16 on, against the ledger that the earlier ones left."""
    m = table(spark, d, "messages", "id", "folder", "uid", "batch_no")
    ledger = delivery.ledger_of(m.filter("batch_no < 16"), delivery.folder_key(F.col("folder")), F.col("uid"))
    return delivery.by_batch(m.filter("batch_no >= 16"), delivery.in_blocks(ledger))


QUERIES = {f.__name__: f for f in (p1_found, p1_user_sessions, p3_found, p3_estimates, p6_found, p6_seen_ranges, p6_unique_headers, p6_members, p6_batches, p6_later_batches)}

_FOLDER = r"nullif(regexp_replace(lower(trim(folder)), '[\s/]+$', ''), '')"
_KEY = r"nullif(regexp_replace(regexp_replace(lower(message_id), '\s+', '', 'g'), '^[<\[(]+|[>\])]+$', '', 'g'), '')"

SQL = {
    "p1_found": r"""
        WITH m AS (
          SELECT DISTINCT id, thread_id, epoch_us(timestamp) AS t,
                 length(regexp_replace(coalesce(text, ''), '[\s\x{FFFC}\x{A0}]', '', 'g')) > 0 AS v
          FROM imessage_messages
          WHERE thread_id IS NOT NULL AND timestamp IS NOT NULL AND lower(trim(coalesce(message_type, ''))) <> 'notification'),
        g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY thread_id ORDER BY t) <= 14400000000 THEN 0 ELSE 1 END AS c FROM m),
        s AS (SELECT *, sum(c) OVER (PARTITION BY thread_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT thread_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_messages
        FROM s GROUP BY thread_id, k HAVING bool_or(v)""",
    "p1_user_sessions": """
        WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS c FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(t) AS start_us, max(t) AS end_us, max(t) - min(t) AS duration_us, count(*) AS n_events FROM s GROUP BY user_id, k""",
    "p6_found": f"""
        WITH a AS (SELECT CAST(id AS VARCHAR) AS id, {_FOLDER} AS f, uid FROM messages WHERE uid IS NOT NULL),
        b AS (SELECT id, {_KEY} AS k FROM email_messages)
        SELECT 'messages' AS tbl, x.id AS row_a, y.id AS row_b FROM a x JOIN a y ON x.f = y.f AND x.uid = y.uid AND x.id < y.id
        UNION ALL SELECT 'email_messages', x.id, y.id FROM b x JOIN b y ON x.k = y.k AND x.id < y.id""",
    "p6_seen_ranges": f"""
        WITH u AS (SELECT DISTINCT {_FOLDER} AS folder, CAST(uid AS BIGINT) AS uid FROM messages WHERE uid IS NOT NULL),
        r AS (SELECT *, uid - row_number() OVER (PARTITION BY folder ORDER BY uid) AS k FROM u WHERE folder IS NOT NULL)
        SELECT folder, min(uid) AS lo, max(uid) AS hi FROM r GROUP BY folder, k""",
    "p6_members": f"""
        WITH a AS (SELECT 'messages' AS tbl, CAST(id AS VARCHAR) AS id, {_FOLDER} || '/' || uid AS k, batch_no FROM messages
                   UNION ALL SELECT 'email_messages', id, {_KEY}, batch_no FROM email_messages),
        g AS (SELECT tbl, k, count(*) AS n, arg_min(id, struct_pack(b := coalesce(batch_no, 2147483647), i := id)) AS kept_id FROM (SELECT DISTINCT * FROM a) WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) > 1)
        SELECT a.tbl, a.id AS row_id, kept_id FROM a JOIN g ON a.tbl = g.tbl AND a.k = g.k""",
    "p6_batches": f"""
        WITH c AS (SELECT {_FOLDER} AS f, uid, batch_no, count(*) AS n FROM messages WHERE uid IS NOT NULL AND {_FOLDER} IS NOT NULL GROUP BY 1, 2, 3),
        o AS (SELECT *, row_number() OVER (PARTITION BY f, uid ORDER BY batch_no NULLS FIRST) AS r FROM c)
        SELECT batch_no, CAST(sum(n) AS BIGINT) AS delivered, count(*) FILTER (r = 1) AS accepted, count(*) FILTER (r > 1) AS covered FROM o GROUP BY 1""",
    "p6_later_batches": f"""
        WITH c AS (SELECT {_FOLDER} AS f, uid, batch_no, count(*) AS n FROM messages WHERE uid IS NOT NULL AND {_FOLDER} IS NOT NULL GROUP BY 1, 2, 3),
        o AS (SELECT *, row_number() OVER (PARTITION BY f, uid ORDER BY batch_no) AS r FROM c WHERE batch_no IS NOT NULL)
        SELECT batch_no, CAST(sum(n) AS BIGINT) AS delivered, count(*) FILTER (r = 1) AS accepted, count(*) FILTER (r > 1) AS covered FROM o WHERE batch_no >= 16 GROUP BY 1""",
    "p6_unique_headers": f"""
        WITH m AS (SELECT *, {_FOLDER} AS f FROM messages)
        SELECT id, f AS folder, uid, subject FROM m
        QUALIFY uid IS NULL OR f IS NULL OR row_number() OVER (PARTITION BY f, uid ORDER BY coalesce(batch_no, 2147483647), id) = 1""",
}
