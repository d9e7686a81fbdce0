"""Bursts and corpus statistics over chat messages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import text as tx
from corpuskiln.operators import bursts as b
from corpuskiln.operators import corpus as c
from corpuskiln.operators import instants
from corpuskiln.operators.store import once
from corpuskiln.tables import table

OWNER = "the owner"


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Chat messages as ``(id, thread_id, sender, at, text)``, each id once; a blank sender is the owner or Unknown."""
    m = once(table(spark, d, "imessage_messages", "id", "thread_id", "sender_name", "message_type", "timestamp", "text"), "id")
    return m.select("id", "thread_id", b.sender_of(F.col("sender_name"), F.col("message_type"), OWNER).alias("sender"), F.col("timestamp").alias("at"), "text")


def old_bursts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "imessage_bursts", "id", "thread_id", "dominant_sender", "text_combined")


def volume_by_month(spark: SparkSession, d: str) -> DataFrame:
    return c.volume(messages(spark, d))


def volume_by_year(spark: SparkSession, d: str) -> DataFrame:
    return c.volume(messages(spark, d), "year")


def _mails(spark: SparkSession, d: str) -> DataFrame:
    """All mails as messages."""
    return table(spark, d, "email_messages", "id", "date").select("id", F.col("date").alias("at"))


def silent_months(spark: SparkSession, d: str) -> DataFrame:
    """Months without a mail; none where every month has one."""
    return c.silent_months(_mails(spark, d)).select(F.date_format("month", "yyyy-MM").alias("month"))


def silence_periods(spark: SparkSession, d: str) -> DataFrame:
    s = c.silences(_mails(spark, d))
    return s.select(F.date_format("first_month", "yyyy-MM").alias("first_month"), F.date_format("last_month", "yyyy-MM").alias("last_month"), "months")


def missing_years(spark: SparkSession, d: str) -> DataFrame:
    """Years without a note, by the instants (UTC) that the creation texts name."""
    n = instants.note_instants(table(spark, d, "parsed_notes", "id", "source_file", "created_at"), table(spark, d, "source_zones"))
    return c.missing_years(n.select("id", F.timestamp_micros("instant_us").alias("at")))


def peak_day(spark: SparkSession, d: str) -> DataFrame:
    return c.peak(c.volume(messages(spark, d), "day"), "period")


def sender_dynamics(spark: SparkSession, d: str) -> DataFrame:
    return c.sender_shares(messages(spark, d), old_bursts(spark, d))


def burst_depth(spark: SparkSession, d: str) -> DataFrame:
    return c.burst_depth(old_bursts(spark, d))


def length_profile(spark: SparkSession, d: str) -> DataFrame:
    return c.length_profile(messages(spark, d))


def vocabulary_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return c.fingerprint(c.word_counts(messages(spark, d)))


def document_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Words that a source of documents uses more than all do."""
    docs = table(spark, d, "documents", "text", "source").select(F.lower(F.trim("source")).alias("sender"), "text").filter("sender is not null")
    return c.fingerprint(c.word_counts(docs)).withColumnRenamed("sender", "source")


def distinct_words(spark: SparkSession, d: str) -> DataFrame:
    return c.word_counts(messages(spark, d)).groupBy("sender").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("uses"))


def exchange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return c.exchanges(messages(spark, d))


def exchange_samples(spark: SparkSession, d: str) -> DataFrame:
    return c.exchange_samples(messages(spark, d))


def top_words(spark: SparkSession, d: str) -> DataFrame:
    return c.top_words(messages(spark, d))


def top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return c.top_bigrams(messages(spark, d))


def url_domains(spark: SparkSession, d: str) -> DataFrame:
    return c.link_domains(table(spark, d, "email_messages", "raw_body").withColumnRenamed("raw_body", "text"))


def emotional_register(spark: SparkSession, d: str) -> DataFrame:
    return c.register(messages(spark, d))


def hour_profile(spark: SparkSession, d: str) -> DataFrame:
    """Messages by hour, five hours west of UTC."""
    return c.hours(messages(spark, d), -5)


def weekday_profile(spark: SparkSession, d: str) -> DataFrame:
    return c.weekdays(messages(spark, d))


def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "contacts", "display_name").select(F.split("display_name", " ")[0].alias("name"))
    return c.mentions(messages(spark, d), names)


def self_references(spark: SparkSession, d: str) -> DataFrame:
    return c.self_references(messages(spark, d))


def body_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = once(table(spark, d, "parsed_notes", "id", "body"), "id")
    return c.histogram(n, F.length("body"), [1, 200, 500, 1000, 2000, 5000])


def thread_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    t = messages(spark, d).filter("thread_id is not null").groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    return c.histogram(t, F.col("n"), [2, 3, 6, 11, 51])


def event_mix(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and day part: count, mean and spread of the value."""
    e = table(spark, d, "events", "event_type", "ts", "value")
    part = F.expr("hour(ts) div 6").cast("int")
    return e.groupBy("event_type", part.alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))


def burst_details(spark: SparkSession, d: str) -> DataFrame:
    """Bursts with their index, participants, dominant sender and combined text."""
    m = table(spark, d, "imessage_messages", "id", "thread_id", "sender_name", "timestamp", "text", "message_type", "attachment", "created_at")
    return b.chat_bursts(m, OWNER).select("id", "thread_id", "burst_index", "start_us", "end_us", "n_messages", "participants", "dominant_sender", F.length("text_combined").alias("text_length"), F.size("resource_links").alias("n_links"))


def burst_index(spark: SparkSession, d: str) -> DataFrame:
    m = once(table(spark, d, "imessage_messages", "id", "thread_id", "timestamp", "text", "message_type").filter("lower(trim(coalesce(message_type, ''))) <> 'notification'"), "id")
    return b.burst_bounds(m).select("thread_id", F.col("burst_index").cast("long").alias("burst_index"), "start_us", "n_messages")


def burst_contract(spark: SparkSession, d: str) -> DataFrame:
    """Bursts in the universal note contract."""
    m = table(spark, d, "imessage_messages", "id", "thread_id", "sender_name", "timestamp", "text", "message_type", "attachment", "created_at")
    return b.burst_notes(b.chat_bursts(m, OWNER), table(spark, d, "imessage_threads", "id", "thread_name", "thread_type"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of chat texts before and after cleaning, and whether they count as content."""
    m = once(table(spark, d, "imessage_messages", "id", "text"), "id")
    return m.select("id", F.length(tx.clean_chat_text(F.col("text"))).alias("clean_length"), tx.is_content(F.col("text")).alias("is_content"))


QUERIES = {
    f.__name__: f
    for f in (
        volume_by_month, volume_by_year, silent_months, silence_periods, missing_years, peak_day, sender_dynamics, burst_depth, length_profile, vocabulary_fingerprint, document_fingerprint, distinct_words, exchange_pairs, exchange_samples, top_words,
        top_bigrams, url_domains, emotional_register, hour_profile, weekday_profile, mention_counts, self_references, body_length_histogram, thread_size_histogram, event_mix, burst_details, burst_index, burst_contract, clean_texts,
    )
}

_M = f"""
    m AS (SELECT DISTINCT ON (id) id, thread_id, timestamp AS stamp, text,
            CASE WHEN trim(coalesce(sender_name, '')) = '' THEN CASE WHEN lower(trim(message_type)) = 'outgoing' THEN '{OWNER}' ELSE 'Unknown' END ELSE trim(sender_name) END AS sender
          FROM imessage_messages)"""
_CONTENT = r"(trim(text) <> '' AND NOT regexp_matches(text, '^(Liked |Loved |Disliked |Laughed at |Emphasized |Questioned )'))"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS = rf"list_filter(regexp_extract_all(lower(regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g')), '[a-z'']+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w))"
_MONTHS = "s AS (SELECT DISTINCT date_trunc('month', date)::DATE AS mo FROM email_messages WHERE date IS NOT NULL), span AS (SELECT unnest(generate_series((SELECT min(mo) FROM s), (SELECT max(mo) FROM s), INTERVAL 1 MONTH))::DATE AS mo), q AS (SELECT mo FROM span WHERE mo NOT IN (SELECT mo FROM s))"


def _finger(source: str) -> str:
    return f"""
        wc AS ({source}),
        bw AS (SELECT word, sum(n) AS c_word FROM wc GROUP BY word), bs AS (SELECT sender, sum(n) AS c_sender FROM wc GROUP BY sender), tot AS (SELECT sum(n) AS c_all FROM wc),
        f AS (SELECT * FROM wc QUALIFY row_number() OVER (PARTITION BY sender ORDER BY n DESC, word) <= 1000),
        x AS (SELECT f.sender, f.word, f.n, round((CAST(f.n AS DOUBLE) / c_sender) / (CAST(c_word AS DOUBLE) / c_all), 2) AS lift FROM f JOIN bw USING (word) JOIN bs USING (sender), tot WHERE f.n >= 3)
        SELECT sender, word, n, lift FROM x WHERE lift >= 2 QUALIFY row_number() OVER (PARTITION BY sender ORDER BY lift DESC, n DESC, word) <= 20"""


def _has(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in phrases) + ")"


_WC = f"SELECT sender, word, count(*) AS n FROM (SELECT sender, unnest({_TOKENS}) AS word FROM m WHERE {_CONTENT}) GROUP BY ALL"

SQL = {
    "volume_by_month": f"WITH {_M} SELECT strftime(stamp, '%Y-%m') AS period, count(*) AS n FROM m WHERE stamp IS NOT NULL GROUP BY 1",
    "volume_by_year": f"WITH {_M} SELECT strftime(stamp, '%Y') AS period, count(*) AS n FROM m WHERE stamp IS NOT NULL GROUP BY 1",
    "silent_months": f"WITH {_MONTHS} SELECT strftime(mo, '%Y-%m') AS month FROM q",
    "silence_periods": f"""WITH {_MONTHS}, k AS (SELECT mo, year(mo) * 12 + month(mo) - row_number() OVER (ORDER BY mo) AS k FROM q)
        SELECT strftime(min(mo), '%Y-%m') AS first_month, strftime(max(mo), '%Y-%m') AS last_month, count(*) AS months FROM k GROUP BY k HAVING count(*) >= 2""",
    "peak_day": f"""WITH {_M}, v AS (SELECT strftime(stamp, '%Y-%m-%d') AS p, count(*) AS n FROM m WHERE stamp IS NOT NULL GROUP BY 1)
        SELECT (SELECT p FROM v ORDER BY n DESC, p LIMIT 1) AS peak, max(n) AS peak_n, (SELECT p FROM v ORDER BY n, p LIMIT 1) AS quietest, min(n) AS quietest_n FROM v""",
    "sender_dynamics": f"""WITH {_M}, v AS (SELECT sender, count(*) AS n_messages FROM m GROUP BY 1), bu AS (SELECT dominant_sender AS sender, count(*) AS n_bursts FROM imessage_bursts WHERE dominant_sender <> '' GROUP BY 1),
        t AS (SELECT (SELECT sum(n_messages) FROM v) AS am, (SELECT count(*) FROM imessage_bursts) AS ab)
        SELECT sender, n_messages, coalesce(n_bursts, 0) AS n_bursts, round(n_messages * 100.0 / am, 1) AS volume_pct, round(coalesce(n_bursts, 0) * 100.0 / nullif(ab, 0), 1) AS starter_pct,
               CASE WHEN am - n_messages > 0 THEN round(CAST(n_messages AS DOUBLE) / (am - n_messages), 3) END AS response_proxy FROM v LEFT JOIN bu USING (sender), t""",
    "burst_depth": r"""SELECT dominant_sender AS sender, round(avg(len(list_filter(string_split(text_combined, chr(10)), lambda x: trim(x) <> ''))), 2) AS depth, count(*) AS n_bursts
        FROM imessage_bursts WHERE dominant_sender <> '' AND text_combined IS NOT NULL GROUP BY 1""",
    "length_profile": rf"""WITH {_M}, x AS (SELECT sender, text, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS n FROM m WHERE {_CONTENT})
        SELECT sender, count(*) AS n_messages, round(avg(n), 3) AS mean_words, CAST(list_sort(list(n))[count(*) // 2 + 1] AS INT) AS median_words, round(avg(CASE WHEN n <= 3 THEN 1.0 ELSE 0 END), 3) AS short_rate,
               round(avg(CASE WHEN contains(text, 'http') THEN 1.0 ELSE 0 END), 3) AS link_rate FROM x GROUP BY sender""",
    "vocabulary_fingerprint": f"WITH {_M}, {_finger(_WC)}",
    "document_fingerprint": "WITH "
    + _finger(f"SELECT sender, word, count(*) AS n FROM (SELECT lower(trim(source)) AS sender, unnest({_TOKENS}) AS word FROM documents WHERE source IS NOT NULL AND {_CONTENT}) GROUP BY ALL").replace("SELECT sender, word, n, lift FROM x", "SELECT sender AS source, word, n, lift FROM x"),
    "distinct_words": f"WITH {_M}, wc AS ({_WC}) SELECT sender, count(*) AS words, CAST(sum(n) AS BIGINT) AS uses FROM wc GROUP BY sender",
    "exchange_pairs": f"""WITH {_M}, x AS (SELECT *, lag(sender) OVER (PARTITION BY thread_id ORDER BY stamp, id) AS before FROM m WHERE {_CONTENT} AND stamp IS NOT NULL AND thread_id IS NOT NULL)
        SELECT least(sender, before) AS person_a, greatest(sender, before) AS person_b, count(*) AS n, count(*) FILTER ({_has(c.PUSHBACK)}) AS pushback FROM x WHERE before IS NOT NULL AND before <> sender GROUP BY 1, 2""",
    "exchange_samples": f"""WITH {_M}, x AS (SELECT *, lag(sender) OVER (PARTITION BY thread_id ORDER BY stamp, id) AS before FROM m WHERE {_CONTENT} AND stamp IS NOT NULL AND thread_id IS NOT NULL),
        y AS (SELECT least(sender, before) AS person_a, greatest(sender, before) AS person_b, stamp, id FROM x WHERE before IS NOT NULL AND before <> sender),
        z AS (SELECT person_a, person_b, id, row_number() OVER (PARTITION BY person_a, person_b ORDER BY stamp, id) AS place, count(*) OVER (PARTITION BY person_a, person_b) AS n FROM y)
        SELECT person_a, person_b, place, id FROM z WHERE place = 1 OR place = n // 2 + 1 OR place = n""",
    "top_words": f"WITH {_M}, wc AS ({_WC}) SELECT word, CAST(sum(n) AS BIGINT) AS n FROM wc GROUP BY word ORDER BY n DESC, word LIMIT 30",
    "top_bigrams": f"""WITH {_M}, t AS (SELECT {_TOKENS} AS w FROM m WHERE {_CONTENT}), bg AS (SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM t WHERE len(w) > 1),
        c AS (SELECT bigram, count(*) AS n FROM bg GROUP BY 1 ORDER BY n DESC, bigram LIMIT 20) SELECT * FROM c WHERE n >= 3""",
    "url_domains": r"""WITH u AS (SELECT unnest(regexp_extract_all(raw_body, 'https?://\S+')[1:2]) AS u FROM email_messages WHERE raw_body IS NOT NULL), d AS (SELECT lower(regexp_extract(u, '^https?://(?:www\.)?([^/:?#\s>)]+)', 1)) AS domain FROM u)
        SELECT domain, count(*) AS n FROM d WHERE domain <> '' GROUP BY 1 ORDER BY n DESC, domain LIMIT 15""",
    "emotional_register": f"WITH {_M}, x AS (SELECT * FROM m WHERE {_CONTENT}) "
    + " UNION ALL ".join(f"SELECT sender, '{k}' AS register, count(*) FILTER ({_has(p)}) AS n, round(CAST(count(*) FILTER ({_has(p)}) AS DOUBLE) / count(*), 3) AS rate FROM x GROUP BY sender" for k, p in c.REGISTERS.items()),
    "hour_profile": f"""WITH {_M}, h AS (SELECT CAST((hour(stamp) + 19) % 24 AS INT) AS hour, count(*) AS n FROM m WHERE stamp IS NOT NULL GROUP BY 1)
        SELECT CAST(g AS INT) AS hour, CASE WHEN g BETWEEN 6 AND 11 THEN 'morning' WHEN g BETWEEN 12 AND 17 THEN 'afternoon' WHEN g >= 18 THEN 'evening' ELSE 'night' END AS part, coalesce(n, 0) AS n
        FROM (SELECT unnest(generate_series(0, 23)) AS g) LEFT JOIN h ON g = hour""",
    "weekday_profile": f"""WITH {_M}, h AS (SELECT dayofweek(stamp) + 1 AS wd, count(*) AS n FROM m WHERE stamp IS NOT NULL GROUP BY 1)
        SELECT CAST(g AS INT) AS weekday, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(1, 7)) AS g) LEFT JOIN h ON g = wd""",
    "mention_counts": f"""WITH {_M}, w AS (SELECT sender, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS name FROM m WHERE text IS NOT NULL)
        SELECT sender, name, count(*) AS n FROM w WHERE name IN (SELECT lower(split_part(display_name, ' ', 1)) FROM contacts) GROUP BY ALL""",
    "self_references": f"WITH {_M}, x AS (SELECT CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{p}'" for p in c.SELF_PHRASES) + f" END AS phrase FROM m WHERE {_CONTENT}) SELECT phrase, count(*) AS n FROM x WHERE phrase IS NOT NULL GROUP BY 1",
    "body_length_histogram": "WITH n AS (SELECT id, any_value(length(body)) AS l FROM parsed_notes GROUP BY id) SELECT CAST((l >= 1) AS INT) + CAST((l >= 200) AS INT) + CAST((l >= 500) AS INT) + CAST((l >= 1000) AS INT) + CAST((l >= 2000) AS INT) + CAST((l >= 5000) AS INT) AS bucket, count(*) AS n FROM n WHERE l IS NOT NULL GROUP BY 1",
    "thread_size_histogram": f"WITH {_M}, t AS (SELECT count(*) AS k FROM m WHERE thread_id IS NOT NULL GROUP BY thread_id) SELECT CAST((k >= 2) AS INT) + CAST((k >= 3) AS INT) + CAST((k >= 6) AS INT) + CAST((k >= 11) AS INT) + CAST((k >= 51) AS INT) AS bucket, count(*) AS n FROM t GROUP BY 1",
    "event_mix": "SELECT event_type, CAST(hour(ts) // 6 AS INT) AS quarter, count(*) AS n, round(avg(value), 4) AS mean_value, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY 1, 2",
    "burst_index": r"""
        WITH m AS (SELECT DISTINCT id, thread_id, epoch_us(timestamp) AS t, length(regexp_replace(coalesce(text, ''), '[\s\x{FFFC}\x{A0}]', '', 'g')) > 0 AS v FROM imessage_messages
                   WHERE thread_id IS NOT NULL AND timestamp IS NOT NULL AND lower(trim(coalesce(message_type, ''))) <> 'notification'),
        g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY thread_id ORDER BY t) <= 14400000000 THEN 0 ELSE 1 END AS c FROM m),
        s AS (SELECT *, sum(c) OVER (PARTITION BY thread_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g),
        x AS (SELECT thread_id, min(t) AS start_us, count(*) AS n_messages FROM s GROUP BY thread_id, k HAVING bool_or(v))
        SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY start_us) - 1 AS burst_index, start_us, n_messages FROM x""",
    "clean_texts": r"""
        WITH m AS (SELECT DISTINCT ON (id) id, text FROM imessage_messages),
        a AS (SELECT id, text, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>\n]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM m)
        SELECT id, CAST(length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS INT) AS clean_length,
               coalesce(trim(text) <> '' AND NOT regexp_matches(text, '^(Liked |Loved |Disliked |Laughed at |Emphasized |Questioned )'), false) AS is_content FROM a""",
}
