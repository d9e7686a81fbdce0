"""Vector retrieval: top-k with filters, several queries at once, joins for provenance, hybrid merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import vectors
from corpuskiln.operators import retrieval as r
from corpuskiln.tables import table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as chunks: the label is the notebook, odd ids are tier 3."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", "embedding", F.col("label").alias("notebook"), (2 + F.col("vec_id") % 2).cast("int").alias("privacy_tier"))


def _query(c: DataFrame, at: int = 0) -> DataFrame:
    """The vector of a row as a one-row frame."""
    return c.filter(F.col("vec_id") == at).select(F.col("embedding").alias("q"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "notebook", "privacy_tier", F.round("similarity", 6).alias("similarity"))


def match_chunks_topk(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return _shown(r.match_chunks(c, _query(c), k=10, max_tier=None))


def match_by_label(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return _shown(r.match_chunks(c, _query(c), k=5, notebook=3, max_tier=3))


def match_tier_ceiling(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return _shown(r.match_chunks(c, _query(c, 1), k=5))


def similar_above_threshold(spark: SparkSession, d: str) -> DataFrame:
    """All chunks at least as similar as the floor of connections."""
    c = chunks(spark, d)
    s = r.with_similarity(c, _query(c)).filter(F.round("similarity", 6) >= r.MIN_SIMILARITY)
    return _shown(s)


def match_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest rows of every 50th vector, searched among all."""
    c = chunks(spark, d)
    q = c.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").cast("long").alias("query"), F.col("embedding").alias("q"))
    return vectors.top_k(c, q, 3).select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def label_centroid_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each notebook's mean cosine to a query vector, and its nearest row."""
    c = chunks(spark, d)
    s = r.with_similarity(c, _query(c))
    return s.groupBy("notebook").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.max("similarity"), 6).alias("best"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Three branches with their own k (10, 5, 10), merged by score, the best seven."""
    c = chunks(spark, d)
    q = _query(c)
    part = lambda lo, k: r.best(r.with_similarity(c.filter(F.col("notebook").between(lo, lo + 2)), q), k, "vec_id").select(F.col("vec_id").alias("key"), F.round("similarity", 6).alias("similarity"))
    return r.hybrid([("chunk", part(0, 10)), ("note", part(3, 5)), ("unit", part(6, 10))], limit=7).select("key", "similarity", "branch")


def units_with_provenance(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "retrieval_units", "id", "source_type", "source_id", "title", "notebook", "dominant_sender", "privacy_tier")
    got = r.provenance(u, table(spark, d, "parsed_notes", "id", "title", "notebook"), table(spark, d, "imessage_bursts", "id", "thread_name", "burst_index", "dominant_sender"))
    return got.select("id", "source_type", F.col("note_id").isNotNull().alias("has_note"), F.col("burst_id").isNotNull().alias("has_burst"), "shown_notebook", "shown_sender")


def notes_without_units(spark: SparkSession, d: str) -> DataFrame:
    """Notes that no unit was made from (anti-join), by notebook."""
    u = table(spark, d, "retrieval_units", "source_type", "source_id").filter(F.col("source_type").isin("joplin", "obsidian"))
    key = u.select(F.regexp_extract("source_id", r"^((?:obsidian::)?[0-9a-f]+)(?:::.*)?$", 1).alias("id")).distinct()
    return table(spark, d, "parsed_notes", "id", "notebook").distinct().join(key, "id", "left_anti").groupBy("notebook").agg(F.countDistinct("id").alias("n"))


def threads_with_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Threads that an earlier ingestion has bursts of (semi-join)."""
    t = table(spark, d, "imessage_threads", "id", "thread_type", "privacy_tier")
    return t.join(table(spark, d, "imessage_bursts", "thread_id").withColumnRenamed("thread_id", "id"), "id", "left_semi").groupBy("thread_type", "privacy_tier").agg(F.count(F.lit(1)).alias("n"))


def embeddings_of_units(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic embeddings of unit bodies that aren't blank: norm and first coordinates."""
    u = table(spark, d, "retrieval_units", "id", "body").filter("trim(body) <> ''")
    e = u.select("id", vectors.deterministic_embedding(F.col("body"), 64).alias("e"))
    return e.select("id", F.size("e").alias("dims"), F.round(F.sqrt(vectors.dot(F.col("e"), F.col("e"))), 4).alias("norm"), F.slice("e", 1, 4).alias("first"))


QUERIES = {f.__name__: f for f in (match_chunks_topk, match_by_label, match_tier_ceiling, similar_above_threshold, match_multi_query, label_centroid_similarity, hybrid_search, units_with_provenance, notes_without_units, threads_with_bursts, embeddings_of_units)}

_COS = "list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
_ALL = f"SELECT c.vec_id, c.label AS notebook, CAST(2 + c.vec_id % 2 AS INT) AS privacy_tier, {_COS} AS s FROM embeddings c, embeddings q WHERE q.vec_id = "
_NOTE_KEY = r"regexp_extract(source_id, '^((?:obsidian::)?[0-9a-f]+)(?:::.*)?$', 1)"

SQL = {
    "match_chunks_topk": f"SELECT vec_id, notebook, privacy_tier, round(s, 6) AS similarity FROM ({_ALL} 0) ORDER BY s DESC, vec_id LIMIT 10",
    "match_by_label": f"SELECT vec_id, notebook, privacy_tier, round(s, 6) AS similarity FROM ({_ALL} 0) WHERE notebook = 3 ORDER BY s DESC, vec_id LIMIT 5",
    "match_tier_ceiling": f"SELECT vec_id, notebook, privacy_tier, round(s, 6) AS similarity FROM ({_ALL} 1) WHERE privacy_tier <= 2 ORDER BY s DESC, vec_id LIMIT 5",
    "similar_above_threshold": f"SELECT vec_id, notebook, privacy_tier, round(s, 6) AS similarity FROM ({_ALL} 0) WHERE round(s, 6) >= 0.35",
    "match_multi_query": f"""
        SELECT query, vec_id, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM (
          SELECT q.vec_id AS query, c.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS rank
          FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 3""",
    "label_centroid_similarity": f"SELECT notebook, count(*) AS n, round(avg(s), 6) AS mean_similarity, round(max(s), 6) AS best FROM ({_ALL} 0) GROUP BY notebook",
    "hybrid_search": f"""
        WITH a AS ({_ALL} 0), c AS (
          (SELECT vec_id AS key, round(s, 6) AS similarity, 'chunk' AS branch, 0 AS b FROM a WHERE notebook BETWEEN 0 AND 2 ORDER BY s DESC, vec_id LIMIT 10)
          UNION ALL (SELECT vec_id, round(s, 6), 'note', 1 FROM a WHERE notebook BETWEEN 3 AND 5 ORDER BY s DESC, vec_id LIMIT 5)
          UNION ALL (SELECT vec_id, round(s, 6), 'unit', 2 FROM a WHERE notebook BETWEEN 6 AND 8 ORDER BY s DESC, vec_id LIMIT 10))
        SELECT key, similarity, branch FROM c ORDER BY similarity DESC, b, key LIMIT 7""",
    "units_with_provenance": f"""
        WITH n AS (SELECT id, any_value(notebook) AS notebook FROM parsed_notes GROUP BY id), b AS (SELECT id, any_value(dominant_sender) AS dominant_sender FROM imessage_bursts GROUP BY id),
        u AS (SELECT *, CASE WHEN source_type IN ('joplin', 'obsidian') THEN nullif({_NOTE_KEY}, '') END AS nk, CASE WHEN source_type = 'imessage' THEN source_id END AS bk FROM retrieval_units)
        SELECT u.id, source_type, n.id IS NOT NULL AS has_note, b.id IS NOT NULL AS has_burst, coalesce(u.notebook, n.notebook) AS shown_notebook, coalesce(u.dominant_sender, b.dominant_sender) AS shown_sender
        FROM u LEFT JOIN n ON nk = n.id LEFT JOIN b ON bk = b.id""",
    "notes_without_units": f"""
        SELECT notebook, count(DISTINCT id) AS n FROM parsed_notes WHERE id NOT IN (SELECT {_NOTE_KEY} FROM retrieval_units WHERE source_type IN ('joplin', 'obsidian')) GROUP BY notebook""",
    "threads_with_bursts": "SELECT thread_type, privacy_tier, count(*) AS n FROM imessage_threads WHERE id IN (SELECT thread_id FROM imessage_bursts) GROUP BY ALL",
}
