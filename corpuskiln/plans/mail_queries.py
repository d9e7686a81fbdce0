"""Header index and mail threads, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import ids
from corpuskiln.functions import text as tx
from corpuskiln.operators import bursts as b
from corpuskiln.operators import corpus as c
from corpuskiln.operators import mail_index as mi
from corpuskiln.tables import table

_HEAD = ("id", "uid", "folder", "from_addr", "from_display", "to_addrs", "cc_addrs", "subject", "message_id", "in_reply_to", "references_hdr", "downloaded", "batch_no")


def headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", *_HEAD)


def human_senders(spark: SparkSession, d: str) -> DataFrame:
    return mi.human_senders(headers(spark, d))


def commercial_senders(spark: SparkSession, d: str) -> DataFrame:
    h = headers(spark, d)
    return h.groupBy(mi.is_commercial(F.col("from_addr")).alias("commercial")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("from_addr")).alias("senders"))


def search_like(spark: SparkSession, d: str) -> DataFrame:
    return mi.search(headers(spark, d), "GARDEN").select("id", "subject")


def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return mi.by_folder(headers(spark, d))


def contact_mails(spark: SparkSession, d: str) -> DataFrame:
    return mi.contact_mails(headers(spark, d), table(spark, d, "contacts", "id", "email_addresses", "is_self"))


def contact_detail(spark: SparkSession, d: str) -> DataFrame:
    """Per contact: mails received and sent, and folders."""
    return contact_mails(spark, d).groupBy("contact_id").agg(F.count_if(F.col("direction") == "received").alias("received"), F.count_if(F.col("direction") == "sent").alias("sent"), F.countDistinct("folder").alias("folders"))


def downloads_pending(spark: SparkSession, d: str) -> DataFrame:
    return mi.pending(headers(spark, d)).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def thread_roots(spark: SparkSession, d: str) -> DataFrame:
    """Threads of the header index by their root id, with size."""
    h = headers(spark, d)
    root = b.thread_root(F.col("references_hdr"), F.col("in_reply_to"), F.col("message_id"))
    return h.withColumn("root", root).filter("root is not null").groupBy("root").agg(F.countDistinct("message_id").alias("n"), F.min("id").alias("first_id"))


def reply_gap_stats(spark: SparkSession, d: str) -> DataFrame:
    g = mi.reply_gaps(table(spark, d, "email_messages", "id", "thread_root", "date"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap_hours"), 3).alias("mean_hours"), F.round(F.min("gap_hours"), 3).alias("least"), F.round(F.max("gap_hours"), 3).alias("most"))


def gap_histogram(spark: SparkSession, d: str) -> DataFrame:
    g = mi.reply_gaps(table(spark, d, "email_messages", "id", "thread_root", "date"))
    return c.histogram(g, F.col("gap_hours"), [0.25, 1, 4, 12, 24, 72, 168])


def quote_habits(spark: SparkSession, d: str) -> DataFrame:
    return mi.quote_habits(table(spark, d, "email_messages", "id", "raw_body"))


def attachment_types(spark: SparkSession, d: str) -> DataFrame:
    return mi.attachment_types(table(spark, d, "email_messages", "id", "attachments"))


def mail_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of mail threads: index of each mail."""
    m = table(spark, d, "email_messages", "id", "thread_root", "date").filter("thread_root is not null")
    return b.mail_bursts(m).select("id", "thread_root", "burst_index")


def mail_burst_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "email_messages", "id", "thread_root", "date", "subject", "from_addr", "stripped_body", "all_participants").filter("thread_root is not null")
    return b.mail_burst_summary(m).select("thread_root", "burst_index", "subject", "n_mails", "dominant_sender", "thread_type", F.size("participants").alias("n_participants"))


def mail_burst_bodies(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "email_messages", "id", "thread_root", "date", "from_name", "stripped_body").filter("thread_root is not null")
    return b.burst_body(m).select("thread_root", "burst_index", F.length("body").alias("body_length"))


def mail_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Mails by their exact set of people."""
    m = table(spark, d, "email_messages", "id", "all_participants", "date")
    return b.conversations_by_people(m).select("participant_hash", F.size("participants").alias("n_people"), "n_messages", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


def mail_directions(spark: SparkSession, d: str) -> DataFrame:
    """Mails by stored direction and by that of the rule, whether the owner's address is in the sender."""
    owner = b.owner_addresses(table(spark, d, "contacts", "is_self", "email_addresses"))
    m = table(spark, d, "email_messages", "id", "from_addr", "direction")
    return m.groupBy(F.coalesce("direction", F.lit("?")).alias("stored"), b.direction(F.col("from_addr"), owner).alias("by_rule")).agg(F.count(F.lit(1)).alias("n"))


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic ids of documents, from their text."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", ids.short_id(F.col("text")).alias("content_id"), ids.item_hash(F.col("text")).alias("item_hash"))


def signatures_removed(spark: SparkSession, d: str) -> DataFrame:
    """Bodies without the lines that devices and scanners add: length."""
    m = table(spark, d, "email_messages", "id", "raw_body").filter("raw_body is not null")
    return m.select("id", F.length(tx.strip_signatures(F.col("raw_body"))).alias("chars"), F.length(tx.strip_quoted(F.col("raw_body"), signatures=True)).alias("own_chars"))


def new_content(spark: SparkSession, d: str) -> DataFrame:
    """How much of the mail is new, and how much quoted."""
    return mi.new_content(table(spark, d, "email_messages", "raw_body"))


def mail_conversations_by_person(spark: SparkSession, d: str) -> DataFrame:
    """Mails by their exact set of people, the addresses of one contact being one person."""
    people = table(spark, d, "contacts", "id", "email_addresses").select(F.explode("email_addresses").alias("address"), F.col("id").alias("person"))
    m = b.with_identities(table(spark, d, "email_messages", "id", "all_participants", "date").filter("all_participants is not null"), people)
    return b.conversations_by_people(m).select("participant_hash", F.size("participants").alias("n_people"), "n_messages", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


def mirrored_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts beside note chunks in one table: mirrors made anew, the old ones gone."""
    bursts = table(spark, d, "imessage_bursts", "id", "thread_name", "burst_index", "date_start", "text_combined", "resource_links", "privacy_tier")
    chunks = table(spark, d, "retrieval_units", "id", "source_type", "source_id", "body", "privacy_tier")
    chunks = chunks.select("id", "source_type", "source_id", F.col("body").alias("chunk_text"), "privacy_tier", F.length("body").alias("char_end"))
    out = b.mirror_bursts(chunks, bursts)
    return out.groupBy("source_type", "privacy_tier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.sum("char_end").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (human_senders, commercial_senders, search_like, folder_counts, contact_mails, contact_detail, downloads_pending, thread_roots, reply_gap_stats, gap_histogram, quote_habits, attachment_types, mail_bursts, mail_burst_summary, mail_burst_bodies, mail_conversations, mail_directions, content_ids, signatures_removed, new_content, mail_conversations_by_person, mirrored_bursts)
}

_FOLDER = r"nullif(regexp_replace(lower(trim(folder)), '[\s/]+$', ''), '')"
_COMM = (
    "coalesce((" + " OR ".join(f"starts_with(lower(trim(from_addr)), '{p}')" for p in mi.COMMERCIAL_PREFIXES) + ") OR " + " OR ".join(f"(split_part(lower(trim(from_addr)), '@', 2) = '{x}' OR ends_with(split_part(lower(trim(from_addr)), '@', 2), '.{x}'))" for x in mi.COMMERCIAL_DOMAINS) + ", true)"
)
_BULK = ", ".join(f"'{f}'" for f in mi.BULK_FOLDERS)
_GAPS = "g AS (SELECT thread_root, id, (epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY thread_root ORDER BY date, id))) / 3.6e9 AS h FROM email_messages WHERE date IS NOT NULL AND thread_root IS NOT NULL), p AS (SELECT h FROM g WHERE h >= 0)"
_PEOPLE = "list_sort(list_distinct(list_filter(list_transform(all_participants, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')))"
_BURSTS = """x AS (SELECT *, CASE WHEN epoch_us(date) - epoch_us(lag(date) OVER w) > 14400000000 THEN 1 ELSE 0 END AS c FROM email_messages WHERE thread_root IS NOT NULL WINDOW w AS (PARTITION BY thread_root ORDER BY date NULLS FIRST, id)),
    bb AS (SELECT *, CAST(sum(c) OVER (PARTITION BY thread_root ORDER BY date NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst_index FROM x)"""
_CONTACT = rf"""co AS (SELECT DISTINCT contact_id, lower(trim(a)) AS addr FROM (SELECT id AS contact_id, unnest(email_addresses) AS a FROM contacts WHERE NOT coalesce(is_self, false))),
    h AS (SELECT {_FOLDER} AS f, uid, from_addr, concat_ws(', ', to_addrs, cc_addrs) AS others FROM messages WHERE {_FOLDER} IS NOT NULL AND uid IS NOT NULL),
    z AS (SELECT f, uid, unnest(regexp_extract_all(lower(from_addr), '[a-z0-9._%+-]+@[a-z0-9.-]+')) AS addr, 0 AS d FROM h UNION ALL SELECT f, uid, unnest(regexp_extract_all(lower(others), '[a-z0-9._%+-]+@[a-z0-9.-]+')), 1 FROM h),
    cm AS (SELECT contact_id, f AS folder, uid, CASE WHEN min(d) = 0 THEN 'received' ELSE 'sent' END AS direction FROM z JOIN co USING (addr) GROUP BY ALL)"""

SQL = {
    "human_senders": f"""
        SELECT lower(trim(from_addr)) AS sender, count(*) AS n, count(DISTINCT message_id) AS n_messages, min(id) AS first_id, max(id) AS last_id, arg_max(trim(from_display), CASE WHEN trim(coalesce(from_display, '')) <> '' THEN id END) AS display
        FROM messages WHERE coalesce({_FOLDER} NOT IN ({_BULK}), true) AND NOT {_COMM} GROUP BY 1 HAVING count(*) >= 2""",
    "commercial_senders": f"SELECT {_COMM} AS commercial, count(*) AS n, count(DISTINCT lower(from_addr)) AS senders FROM messages GROUP BY 1",
    "search_like": "SELECT id, subject FROM messages WHERE " + " OR ".join(f"coalesce(contains(lower({x}), 'garden'), false)" for x in ("from_addr", "from_display", "to_addrs", "cc_addrs", "subject")),
    "folder_counts": f"SELECT {_FOLDER} AS folder, count(*) AS n, count(DISTINCT message_id) AS n_messages, count(*) FILTER (downloaded = 1) AS downloaded FROM messages GROUP BY 1",
    "contact_mails": f"WITH {_CONTACT} SELECT * FROM cm",
    "contact_detail": f"WITH {_CONTACT} SELECT contact_id, count(*) FILTER (direction = 'received') AS received, count(*) FILTER (direction = 'sent') AS sent, count(DISTINCT folder) AS folders FROM cm GROUP BY 1",
    "downloads_pending": f"""WITH k AS (SELECT {_FOLDER} AS folder, uid, max(CASE WHEN downloaded = 1 THEN 1 ELSE 0 END) AS done FROM messages WHERE {_FOLDER} IS NOT NULL AND uid IS NOT NULL GROUP BY 1, 2)
        SELECT folder, count(*) AS n FROM k WHERE done = 0 GROUP BY 1""",
    "thread_roots": r"""WITH r AS (SELECT id, message_id, coalesce(nullif(regexp_extract(coalesce(references_hdr, ''), '(<[^<>\s]+>)', 1), ''), nullif(regexp_extract(coalesce(in_reply_to, ''), '(<[^<>\s]+>)', 1), ''), trim(message_id)) AS root FROM messages)
        SELECT root, count(DISTINCT message_id) AS n, min(id) AS first_id FROM r WHERE root IS NOT NULL GROUP BY 1""",
    "reply_gap_stats": f"WITH {_GAPS} SELECT count(*) AS n, round(avg(h), 3) AS mean_hours, round(min(h), 3) AS least, round(max(h), 3) AS most FROM p",
    "gap_histogram": f"WITH {_GAPS} SELECT " + " + ".join(f"CAST((h >= {e}) AS INT)" for e in (0.25, 1, 4, 12, 24, 72, 168)) + " AS bucket, count(*) AS n FROM p GROUP BY 1",
    "quote_habits": r"""
        WITH f AS (SELECT regexp_matches(raw_body, '(?m)^\s*>') AS marked, regexp_matches(replace(raw_body, chr(13), ''), '(?m)^On .+ wrote:\s*$') AS attribution,
          regexp_matches(replace(raw_body, chr(13), ''), '(?mi)^-+ ?original message ?-+\s*$') AS original, regexp_matches(raw_body, '(?mi)^(-{5,} forwarded message -{5,}|begin forwarded message:)') AS forwarded,
          regexp_matches(raw_body, '(?m)^\*?From:\*? .+@') AS header FROM email_messages WHERE raw_body IS NOT NULL),
        c AS (SELECT count(*) AS t, count(*) FILTER (marked) AS a, count(*) FILTER (attribution) AS b, count(*) FILTER (original) AS o, count(*) FILTER (forwarded) AS fw, count(*) FILTER (header) AS hd FROM f)
        SELECT 'marked' AS habit, a AS n, a * 100 // t AS percent FROM c UNION ALL SELECT 'attribution', b, b * 100 // t FROM c UNION ALL SELECT 'original', o, o * 100 // t FROM c
        UNION ALL SELECT 'forwarded', fw, fw * 100 // t FROM c UNION ALL SELECT 'header', hd, hd * 100 // t FROM c""",
    "attachment_types": "WITH a AS (SELECT id, unnest(attachments) AS a FROM email_messages) SELECT lower(a.content_type) AS content_type, count(*) AS n, count(DISTINCT id) AS n_mails, CAST(sum(a.size) AS BIGINT) AS bytes FROM a GROUP BY 1",
    "mail_bursts": f"WITH {_BURSTS} SELECT id, thread_root, burst_index FROM bb",
    "mail_burst_summary": f"""
        WITH {_BURSTS}, o AS (SELECT *, coalesce(epoch_us(date), -4611686018427387904) AS t FROM bb),
        v AS (SELECT thread_root, burst_index, from_addr, count(*) AS n, min(struct_pack(t := t, id := id)) AS f FROM o GROUP BY ALL),
        l AS (SELECT thread_root, burst_index, arg_min(from_addr, struct_pack(n := -n, f := f)) AS dominant_sender FROM v GROUP BY 1, 2),
        g AS (SELECT thread_root, burst_index, arg_min(subject, struct_pack(t := t, id := id)) AS subject, count(*) AS n_mails, len(list_distinct(flatten(list(all_participants)))) AS n_participants FROM o GROUP BY 1, 2)
        SELECT thread_root, burst_index, subject, n_mails, dominant_sender, CASE WHEN n_participants <= 2 THEN 'bilateral' ELSE 'group' END AS thread_type, CAST(n_participants AS INT) AS n_participants FROM g JOIN l USING (thread_root, burst_index)""",
    "mail_conversations": f"SELECT sha256(array_to_string({_PEOPLE}, ',')) AS participant_hash, CAST(any_value(len({_PEOPLE})) AS INT) AS n_people, count(*) AS n_messages, epoch_us(min(date)) AS first_us, epoch_us(max(date)) AS last_us FROM email_messages WHERE all_participants IS NOT NULL GROUP BY 1",
    "mail_directions": """WITH o AS (SELECT DISTINCT lower(trim(unnest(email_addresses))) AS addr FROM contacts WHERE is_self)
        SELECT coalesce(direction, '?') AS stored, CASE WHEN EXISTS (SELECT 1 FROM o WHERE contains(lower(coalesce(from_addr, '')), addr)) THEN 'sent' ELSE 'received' END AS by_rule, count(*) AS n FROM email_messages GROUP BY 1, 2""",
    "new_content": r"""
        WITH l AS (SELECT raw_body, list_transform(string_split(raw_body, chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS l FROM email_messages WHERE raw_body IS NOT NULL AND raw_body <> ''),
        f AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)-{5,}\s*Forwarded message\s*-{5,}') AND NOT starts_with(trim(x), '>')), true) AS stop FROM l),
        o AS (SELECT *, CASE WHEN stop > 0 THEN l[1:stop - 1] ELSE l END AS own FROM f),
        q AS (SELECT *, list_position(list_transform(own, lambda x: regexp_matches(x, '^On .+ wrote:\s*$')), true) AS cut FROM o),
        m AS (SELECT *, list_filter(CASE WHEN cut > 0 THEN own[1:cut - 1] ELSE own END, lambda x: NOT starts_with(ltrim(x), '>') AND NOT regexp_matches(x, '^Sent (from my (iPhone|iPad|Tricorder|BlackBerry)|via BlackBerry)')) AS mine FROM q),
        c AS (SELECT len(l) AS a, len(list_filter(own, lambda x: starts_with(ltrim(x), '>') AND NOT regexp_matches(x, '^On .+ wrote:\s*$'))) AS b, len(mine) AS n, coalesce(list_sum(list_transform(mine, lambda x: length(x))), 0) AS nc, length(raw_body) AS tc FROM m)
        SELECT count(*) AS bodies, CAST(sum(a) AS BIGINT) AS total_lines, CAST(sum(b) AS BIGINT) AS quoted_lines, CAST(sum(n) AS BIGINT) AS new_lines, CAST(sum(nc) AS BIGINT) AS new_chars, CAST(sum(tc) AS BIGINT) AS total_chars, CAST(sum(nc) * 100 // sum(tc) AS BIGINT) AS new_percent FROM c""",
    "mail_conversations_by_person": """
        WITH k AS (SELECT lower(trim(a)) AS address, min(id) AS person FROM (SELECT id, unnest(email_addresses) AS a FROM contacts) GROUP BY 1),
        e AS (SELECT id, date, lower(trim(unnest(all_participants))) AS address FROM email_messages WHERE all_participants IS NOT NULL),
        p AS (SELECT e.id, list_sort(list_distinct(list(coalesce(person, e.address)))) AS who FROM e LEFT JOIN k ON e.address = k.address GROUP BY 1),
        m AS (SELECT email_messages.id, date, list_filter(list_transform(coalesce(who, []), lambda x: lower(trim(x))), lambda x: x <> '') AS who FROM email_messages LEFT JOIN p ON p.id = email_messages.id WHERE all_participants IS NOT NULL)
        SELECT sha256(array_to_string(list_sort(who), ',')) AS participant_hash, CAST(any_value(len(who)) AS INT) AS n_people, count(*) AS n_messages, epoch_us(min(date)) AS first_us, epoch_us(max(date)) AS last_us FROM m GROUP BY 1""",
    "mirrored_bursts": """
        WITH x AS (SELECT source_type, source_id, privacy_tier, CAST(length(body) AS BIGINT) AS c FROM retrieval_units WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM imessage_bursts WHERE id IS NOT NULL)
                   UNION ALL SELECT 'imessage', id, privacy_tier, coalesce(length(text_combined), 0) FROM imessage_bursts)
        SELECT source_type, privacy_tier, count(*) AS n, count(DISTINCT source_id) AS sources, CAST(sum(c) AS BIGINT) AS chars FROM x GROUP BY 1, 2""",
    "content_ids": "SELECT doc_id, substr(sha256(text), 1, 32) AS content_id, substr(sha256(text), 1, 16) AS item_hash FROM documents",
}
