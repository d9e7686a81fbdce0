"""Notes: lines, entries, chunks, mark-up, tags; documents as feed items; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import dates
from corpuskiln.functions import text as tx
from corpuskiln.operators import chunking as ch
from corpuskiln.operators import curation as cu
from corpuskiln.operators import store as st
from corpuskiln.tables import table


def notes(spark: SparkSession, d: str) -> DataFrame:
    return st.once(table(spark, d, "parsed_notes", "id", "title", "notebook", "body", "tags", "created_at", "source_type"), "id")


def doc_lines_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents: how many, how many aren't blank, and the offset of the last one."""
    ls = ch.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return ls.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("line") != "").alias("n_inked"), F.max("char_start").alias("last_start"))


def archetype_counts(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).filter("body is not null")
    return n.groupBy(ch.detect_archetype(F.col("title"), F.col("notebook"), F.col("body")).alias("archetype")).agg(F.count(F.lit(1)).alias("n"))


def note_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ch.chunk_notes(notes(spark, d)).select("id", "archetype", "chunk_index", F.length("chunk_text").alias("chars"), "char_start", "char_end", "entry_timestamp", F.size("resource_ids").alias("n_resources"))


def chunk_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Chunks per archetype: how many, dated, and their mean length."""
    c = ch.chunk_notes(notes(spark, d))
    return c.groupBy("archetype").agg(F.count(F.lit(1)).alias("chunks"), F.count("entry_timestamp").alias("dated"), F.round(F.avg(F.length("chunk_text")), 2).alias("mean_chars"))


def dated_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that head a dated entry, by month."""
    ls = ch.with_headers(ch.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id")
    return ls.filter("header").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """Notes by the year of the ISO date in their creation text."""
    n = notes(spark, d).filter(F.col("created_at").rlike(r"^\d{4}-\d{2}-\d{2}"))
    return n.groupBy(F.year(dates.parse_date(F.substring("created_at", 1, 10))).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def stripped_markup(spark: SparkSession, d: str) -> DataFrame:
    """Documents without vault mark-up: length of the plain text."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.length(tx.strip_vault_syntax(F.col("text"))).alias("plain_length"))


def note_resources(spark: SparkSession, d: str) -> DataFrame:
    """Resource ids linked in notes, and the length without them."""
    return notes(spark, d).select("id", F.array_sort(F.array_distinct(tx.resource_links(F.col("body")))).alias("links"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Mail bodies that hold mark-up, as text: length."""
    m = table(spark, d, "email_messages", "id", "raw_body").filter(F.col("raw_body").rlike("(?i)<(div|p)>"))
    return m.select("id", F.length(tx.strip_html(F.col("raw_body"))).alias("text_length"))


def simply_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Bodies by the simple quoting rule: number of lines kept."""
    m = table(spark, d, "email_messages", "id", "raw_body").filter("raw_body is not null")
    return m.select("id", F.size(tx.text_lines(tx.strip_quoted(F.col("raw_body")))).alias("kept"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    hit = F.lower("title").contains("garden") | F.lower("body").contains("garden")
    return n.filter(F.coalesce(hit, F.lit(False))).select("id", F.substring("body", 1, 300).alias("preview"))


def note_tags(spark: SparkSession, d: str) -> DataFrame:
    return st.tags(notes(spark, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def notebook_universe(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).groupBy(F.trim("notebook").alias("notebook")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("notebook <> ''")


def ingestion_counts(spark: SparkSession, d: str) -> DataFrame:
    """What an ingestion would do if the notes that have units were there already."""
    u = table(spark, d, "retrieval_units", "source_type", "source_id").filter(F.col("source_type").isin("joplin", "obsidian"))
    known = u.select(F.regexp_extract("source_id", r"^((?:obsidian::)?[0-9a-f]+)(?:::.*)?$", 1).alias("id"))
    return st.ingestion_counts(notes(spark, d), known)


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Threads as stored, updated by what their messages say: message count per thread, new threads added."""
    old = table(spark, d, "imessage_threads", "id", "message_count").withColumn("message_count", F.col("message_count").cast("long"))
    new = table(spark, d, "imessage_messages", "id", "thread_id").filter("thread_id is not null").groupBy(F.col("thread_id").alias("id")).agg(F.countDistinct("id").alias("message_count"))
    return st.merge_upsert(old, new, ["id"])


def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "imessage_bursts", "thread_id")
    new = table(spark, d, "imessage_threads", "id", "thread_type").withColumnRenamed("id", "thread_id")
    return st.upsert_actions(old, new, ["thread_id"]).groupBy("thread_type", "action").agg(F.count(F.lit(1)).alias("n"))


def replace_where(spark: SparkSession, d: str) -> DataFrame:
    """Units of mails replaced by one row per thread root."""
    u = table(spark, d, "retrieval_units", "id", "source_type", "source_id")
    m = table(spark, d, "email_messages", "thread_root").filter("thread_root is not null").distinct()
    rows = m.select(F.sha2("thread_root", 256).alias("id"), F.lit("email").alias("source_type"), F.col("thread_root").alias("source_id"))
    return st.replace_where(u, F.col("source_type") == "email", rows).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"))


def latest_mail_copy(spark: SparkSession, d: str) -> DataFrame:
    """Insert or replace: the copy of the last batch of each message id as written."""
    m = table(spark, d, "email_messages", "id", "message_id", "batch_no").filter("message_id is not null")
    return st.keep_last(m, ["message_id"], F.coalesce("batch_no", F.lit(-1)), F.col("id"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as feed items."""
    return table(spark, d, "documents", "doc_id", "title", "source", "lang", "n_chars", "created_at").select(F.col("doc_id").alias("item"), "title", F.lower(F.trim("source")).alias("source"), "lang", "n_chars", F.col("created_at").alias("published"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by length and language: long enough is kept, other languages are undecided."""
    i = _items(spark, d)
    dec = i.filter("lang = 'en'").select("item", F.when(F.col("n_chars").between(1200, 1300), "KEEP").otherwise("KILL").alias("decision"), F.when(F.col("n_chars") < 1220, "strong").when(F.col("n_chars") < 1260, "solid").otherwise("worth_noting").alias("strength"), F.lit(1).alias("seq"))
    again = i.filter("lang = 'en' and n_chars < 1205").select("item", F.lit("KILL").alias("decision"), F.lit("strong").alias("strength"), F.lit(2).alias("seq"))
    return cu.apply_decisions(i, dec.unionByName(again), "item", F.col("seq"))


def editor_apply(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy("decision", "strength").agg(F.count(F.lit(1)).alias("n"))


def editor_trim(spark: SparkSession, d: str) -> DataFrame:
    """What stays if at most ten are kept."""
    return cu.trim_kept(_decided(spark, d), "item").filter("decision = 'KEEP'").select("item", "strength")


def kills_by_source(spark: SparkSession, d: str) -> DataFrame:
    return cu.kill_report(_decided(spark, d).filter("source is not null"), "source")


def fresh_items(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty of each source, of these the ones of the last seven days of 2024, and the undated."""
    i = _items(spark, d).filter("source is not null and (published is null or published < timestamp '2025-01-01 00:00:00')")
    return cu.freshest(i, F.lit("2025-01-01 00:00:00").cast("timestamp")).select("source", "item")


def first_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each title once: from feeds before anything else, then the smallest id."""
    i = _items(spark, d).filter("title is not null")
    return cu.once_per_item(i, "title", F.when(F.col("source") == "feed", 0).otherwise(1), F.col("item")).select("title", "item")


def resource_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Resources that notes declare, as a dry run would have them, and how many notes use each."""
    r = st.declared_resources(table(spark, d, "parsed_notes", "id", "resource_links"))
    return st.rehearsed_resources(r).join(r.groupBy("resource_id").agg(F.count(F.lit(1)).alias("notes")), "resource_id")


def note_validation(spark: SparkSession, d: str) -> DataFrame:
    """Exported notes by which of the required fields they lack."""
    n = st.missing_fields(table(spark, d, "parsed_notes", "id", "title", "body", "notebook", "created_at"), ["id", "title", "body", "notebook", "created_at"])
    return n.groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


def thread_density(spark: SparkSession, d: str) -> DataFrame:
    """Threads by kind, with how many bursts an earlier ingestion connected to each."""
    t = table(spark, d, "imessage_threads", "id", "thread_type").withColumnRenamed("id", "thread_id")
    c = cu.connection_density(t, table(spark, d, "imessage_bursts", "thread_id"), "thread_id")
    return c.groupBy("thread_type").agg(F.count(F.lit(1)).alias("threads"), F.sum("connection_density").alias("connections"), F.max("connection_density").alias("most"))


def malformed_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as feed items, by language: well formed and skipped."""
    good, bad = cu.well_formed(_items(spark, d), "title", "source")
    both = good.withColumn("ok", F.lit(1)).unionByName(bad.withColumn("ok", F.lit(0)))
    return both.groupBy("lang").agg(F.sum("ok").alias("published"), F.sum(1 - F.col("ok")).alias("skipped"))


def kept_by_source(spark: SparkSession, d: str) -> DataFrame:
    return cu.kept_by(_decided(spark, d).filter("source is not null"), "source")


QUERIES = {
    f.__name__: f
    for f in (
        doc_lines_offsets, archetype_counts, note_chunks, chunk_lengths, dated_headings, iso_dates, stripped_markup, note_resources, html_text, simply_stripped, keyword_search, note_tags, notebook_universe, ingestion_counts,
        upsert_merge, upsert_actions, replace_where, latest_mail_copy, editor_apply, editor_trim, kills_by_source, fresh_items, first_copies, resource_stubs, note_validation, thread_density, malformed_items, kept_by_source,
    )
}

_N = "n AS (SELECT id, any_value(title) AS title, any_value(notebook) AS notebook, any_value(body) AS body, any_value(tags) AS tags, any_value(created_at) AS created_at FROM parsed_notes GROUP BY id)"
_I = "i AS (SELECT doc_id AS item, title, lower(trim(source)) AS source, lang, n_chars, created_at AS published FROM documents)"
_DEC = f"""{_I}, e AS (SELECT *, CASE WHEN lang = 'en' AND n_chars >= 1205 AND n_chars BETWEEN 1200 AND 1300 THEN 'KEEP' ELSE 'KILL' END AS decision,
    CASE WHEN n_chars < 1220 THEN 'strong' WHEN n_chars < 1260 THEN 'solid' ELSE 'worth_noting' END AS st FROM i), x AS (SELECT *, CASE WHEN decision = 'KEEP' THEN st END AS strength FROM e)"""

SQL = {
    "doc_lines_offsets": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents) SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: trim(x) <> '')) AS n_inked, CAST(length(text) - length(l[-1]) AS INT) AS last_start FROM l",
    "iso_dates": r"WITH n AS (SELECT DISTINCT id, created_at FROM parsed_notes WHERE regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}')) SELECT CAST(year(TRY_CAST(substr(created_at, 1, 10) AS DATE)) AS INT) AS year, count(*) AS n FROM n GROUP BY 1",
    "note_resources": rf"WITH {_N} SELECT id, list_sort(list_distinct(regexp_extract_all(coalesce(body, ''), '\(:/([a-f0-9]{{32}})\)', 1))) AS links FROM n",
    "keyword_search": f"WITH {_N} SELECT id, substr(body, 1, 300) AS preview FROM n WHERE coalesce(contains(lower(title), 'garden') OR contains(lower(body), 'garden'), false)",
    "note_tags": f"WITH {_N}, t AS (SELECT DISTINCT id, trim(unnest(tags)) AS tag FROM n) SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY 1",
    "notebook_universe": f"WITH {_N} SELECT trim(notebook) AS notebook, count(*) AS n, min(id) AS first_id FROM n WHERE trim(notebook) <> '' GROUP BY 1",
    "ingestion_counts": rf"""WITH {_N}, k AS (SELECT DISTINCT regexp_extract(source_id, '^((?:obsidian::)?[0-9a-f]+)(?:::.*)?$', 1) AS id FROM retrieval_units WHERE source_type IN ('joplin', 'obsidian')),
        a AS (SELECT n.*, trim(coalesce(body, '')) = '' AS blank, k.id IS NOT NULL AS known FROM n LEFT JOIN k USING (id)),
        t AS (SELECT DISTINCT id, trim(unnest(tags)) AS tag FROM a WHERE NOT blank), r AS (SELECT count(DISTINCT tag) AS tags, count(*) AS relations FROM t WHERE tag <> '')
        SELECT count(*) AS processed, count(*) FILTER (blank) AS skipped, count(*) FILTER (NOT blank AND NOT known) AS inserted, count(*) FILTER (NOT blank AND known) AS updated, any_value(r.tags) AS tags, any_value(r.relations) AS relations FROM a, r""",
    "upsert_merge": """WITH m AS (SELECT thread_id AS id, count(DISTINCT id) AS message_count FROM imessage_messages WHERE thread_id IS NOT NULL GROUP BY 1)
        SELECT id, message_count FROM m UNION ALL SELECT id, CAST(message_count AS BIGINT) FROM imessage_threads WHERE id NOT IN (SELECT id FROM m)""",
    "upsert_actions": "SELECT thread_type, CASE WHEN id IN (SELECT thread_id FROM imessage_bursts) THEN 'updated' ELSE 'inserted' END AS action, count(*) AS n FROM imessage_threads GROUP BY 1, 2",
    "replace_where": """WITH x AS (SELECT source_type, source_id FROM retrieval_units WHERE coalesce(source_type, '') <> 'email' UNION ALL SELECT 'email', thread_root FROM (SELECT DISTINCT thread_root FROM email_messages WHERE thread_root IS NOT NULL))
        SELECT source_type, count(*) AS n, count(DISTINCT source_id) AS sources FROM x GROUP BY 1""",
    "latest_mail_copy": "SELECT id, message_id, batch_no FROM email_messages WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY coalesce(batch_no, -1) DESC, id DESC) = 1",
    "editor_apply": f"WITH {_DEC} SELECT decision, strength, count(*) AS n FROM x GROUP BY 1, 2",
    "editor_trim": f"WITH {_DEC}, k AS (SELECT item, strength, count(*) OVER () AS c, row_number() OVER (ORDER BY CASE strength WHEN 'strong' THEN 0 WHEN 'solid' THEN 1 ELSE 2 END, item) AS r FROM x WHERE decision = 'KEEP') SELECT item, strength FROM k WHERE c <= 12 OR r <= 10",
    "kills_by_source": f"WITH {_DEC} SELECT source, count(*) AS items, count(*) FILTER (decision = 'KEEP') AS kept, round(1 - CAST(count(*) FILTER (decision = 'KEEP') AS DOUBLE) / count(*), 2) AS kill_rate FROM x WHERE source IS NOT NULL GROUP BY 1",
    "fresh_items": f"""WITH {_I}, t AS (SELECT * FROM i WHERE source IS NOT NULL AND (published IS NULL OR published < TIMESTAMP '2025-01-01') QUALIFY row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, item) <= 20)
        SELECT source, item FROM t WHERE published IS NULL OR published >= TIMESTAMP '2024-12-25'""",
    "resource_stubs": "WITH r AS (SELECT DISTINCT id, unnest(resource_links) AS resource_id FROM parsed_notes) SELECT resource_id, 'dry-resource-' || resource_id AS id, count(*) AS notes FROM r WHERE resource_id IS NOT NULL GROUP BY 1",
    "note_validation": "SELECT concat_ws(',', CASE WHEN id IS NULL THEN 'id' END, CASE WHEN title IS NULL THEN 'title' END, CASE WHEN body IS NULL THEN 'body' END, CASE WHEN notebook IS NULL THEN 'notebook' END, CASE WHEN created_at IS NULL THEN 'created_at' END) AS missing, count(*) AS n FROM parsed_notes GROUP BY 1",
    "thread_density": """WITH b AS (SELECT thread_id, count(*) AS n FROM imessage_bursts GROUP BY 1), t AS (SELECT id, thread_type, coalesce(n, 0) AS n FROM imessage_threads LEFT JOIN b ON id = b.thread_id)
        SELECT thread_type, count(*) AS threads, CAST(sum(n) AS BIGINT) AS connections, max(n) AS most FROM t GROUP BY 1""",
    "malformed_items": f"WITH {_I}, x AS (SELECT lang, trim(coalesce(title, '')) <> '' AND trim(coalesce(source, '')) <> '' AS ok FROM i) SELECT lang, count(*) FILTER (ok) AS published, count(*) FILTER (NOT ok) AS skipped FROM x GROUP BY 1",
    "kept_by_source": f"WITH {_DEC} SELECT source, count(*) AS kept FROM x WHERE source IS NOT NULL AND decision = 'KEEP' GROUP BY 1",
    "first_copies": f"WITH {_I} SELECT title, item FROM i WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY CASE WHEN source = 'feed' THEN 0 ELSE 1 END, item) = 1",
}
