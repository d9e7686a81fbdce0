"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuskiln.llm import conversations, emails, mixing, packing, privacy, residue
from corpuskiln.tables import table

_CHAT = ("id", "thread_id", "sender_name", "timestamp", "text", "message_type", "created_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return emails.old_lines(table(spark, d, "email_messages", "id", "raw_body", "from_name"))


def p2_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Each mail reduced to what its sender newly wrote."""
    return emails.stripped(table(spark, d, "email_messages", "id", "raw_body", "from_name"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.found_items(table(spark, d, "imessage_messages", "id", "text"), table(spark, d, "retrieval_units", "id", "body"), table(spark, d, "parsed_notes", "id", "body"), table(spark, d, "contacts"))


def p4_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the three tables with typed placeholders for personal information."""
    texts = privacy.texts_of(table(spark, d, "imessage_messages", "id", "text"), table(spark, d, "retrieval_units", "id", "body"), table(spark, d, "parsed_notes", "id", "body"))
    return privacy.sanitise(texts, table(spark, d, "contacts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped_threads(table(spark, d, "imessage_messages", *_CHAT), table(spark, d, "imessage_threads", "id"), table(spark, d, "contacts"))


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The ordered messages of the threads that are kept, with roles and turns."""
    return conversations.conversations(table(spark, d, "imessage_messages", *_CHAT), table(spark, d, "imessage_threads", "id"), table(spark, d, "contacts"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container of each kind."""
    return packing.containers(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "container_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.fill(p7_containers(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the mixture and how often each is used."""
    return mixing.mixture(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of the mixture."""
    return mixing.shares(p8_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left."""
    return residue.clean(table(spark, d, "documents", "doc_id", "text", "lang", "source"))


QUERIES = {f.__name__: f for f in (p2_found, p2_stripped, p4_found, p4_sanitised, p5_found, p5_conversations, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_clean)}

_SAID = r"""
    m AS (SELECT DISTINCT id, thread_id, lower(trim(coalesce(sender_name, ''))) AS nm, lower(trim(coalesce(message_type, ''))) AS ty, timestamp AS ts, text
          FROM imessage_messages WHERE thread_id IS NOT NULL AND lower(trim(coalesce(message_type, ''))) <> 'notification'),
    own AS (SELECT lower(trim(unnest([display_name, chat_name]))) AS own_nm FROM contacts WHERE is_self),
    vot AS (SELECT thread_id AS vt, nm AS vn, CASE WHEN 2 * count(*) FILTER (ty = 'outgoing') > count(*) THEN 'owner' ELSE 'other' END AS r
            FROM m WHERE ty <> '' AND nm <> '' GROUP BY 1, 2),
    s AS (SELECT m.*, CASE WHEN ty = 'outgoing' THEN 'owner' WHEN ty <> '' THEN 'other' WHEN m.nm IN (SELECT own_nm FROM own) THEN 'owner' ELSE vot.r END AS role,
                 regexp_matches(text, '^\s*(Liked|Loved|Disliked|Laughed at|Emphasi[sz]ed|Questioned)\s+[“"].*[”"]\s*$', 's') AS echo
          FROM m LEFT JOIN vot ON m.thread_id = vt AND m.nm = vn
          WHERE length(regexp_replace(coalesce(text, ''), '[\s\x{FFFC}\x{A0}]', '', 'g')) > 0),
    g AS (SELECT thread_id, count(*) FILTER (ts IS NULL) AS untimed, count(*) FILTER (role IS NULL) AS roleless, count(DISTINCT role) FILTER (NOT echo) AS roles FROM s GROUP BY 1)"""

SQL = {
    "p5_found": f"""
        WITH {_SAID}
        SELECT DISTINCT t.id AS thread_id FROM imessage_threads t LEFT JOIN g ON t.id = g.thread_id
        WHERE t.id IS NOT NULL AND (g.thread_id IS NULL OR untimed > 0 OR roleless > 0 OR roles < 2)""",
}
