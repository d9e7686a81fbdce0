"""Top-k semantic retrieval with filters, joins for provenance, and hybrid merging.

Every ``match_*`` function is lazy; filters that aren't asked for aren't in
the plan.  ``orderBy(...).limit(k)`` becomes ``TakeOrderedAndProject``: each
partition keeps its best k, nothing is sorted whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.vectors import cosine

DEFAULT_TIER = 2
MIN_SIMILARITY = 0.35


def with_similarity(vectors: DataFrame, query: DataFrame | list[float], vector: str = "embedding") -> DataFrame:
    """Adds ``similarity`` to the query: a list, or a one-row frame with the column ``q``."""
    v = vectors.filter(F.col(vector).isNotNull())
    if isinstance(query, DataFrame):
        v = v.crossJoin(F.broadcast(query.select("q").limit(1)))
        return v.withColumn("similarity", cosine(F.col(vector), F.col("q"))).drop("q")
    return v.withColumn("similarity", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))


def best(df: DataFrame, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("similarity"), *ties).limit(k)


def match_chunks(chunks: DataFrame, query: DataFrame | list[float], k: int = 5, notebook: object | None = None, max_tier: int | None = DEFAULT_TIER, key: str = "vec_id") -> DataFrame:
    """The ``k`` nearest chunks, of a notebook and up to a privacy tier if given."""
    df = chunks
    if max_tier is not None:
        df = df.filter(F.col("privacy_tier") <= max_tier)
    if notebook is not None:
        df = df.filter(F.col("notebook") == notebook)
    return best(with_similarity(df, query), k, key)


def match_units(units: DataFrame, query: DataFrame | list[float], k: int = 5, notebook: object | None = None, max_tier: int | None = DEFAULT_TIER) -> DataFrame:
    """The nearest units of the common retrieval surface."""
    return match_chunks(units, query, k, notebook, max_tier, key="id")


def match_bursts(bursts: DataFrame, query: DataFrame | list[float], k: int = 5, thread_type: str | None = None, thread_id: str | None = None, max_tier: int | None = DEFAULT_TIER) -> DataFrame:
    """The nearest bursts, of a kind of thread or of one thread if given."""
    df = bursts
    if thread_type is not None:
        df = df.filter(F.col("thread_type") == thread_type)
    if thread_id is not None:
        df = df.filter(F.col("thread_id") == thread_id)
    return match_chunks(df, query, k, None, max_tier, key="id")


def of_notebook(chunks: DataFrame, notes: DataFrame, notebook: str) -> DataFrame:
    """Chunks whose note lies in a notebook (semi-join); chunks without a note are out."""
    return chunks.join(notes.filter(F.col("notebook") == notebook).select(F.col("id").alias("note_id")), "note_id", "left_semi")


def connections(items: DataFrame, found: DataFrame, text: str = "text", floor: float = MIN_SIMILARITY) -> DataFrame:
    """What was found for each item, as similar as the floor, its text cut to 300 characters."""
    return items.join(found.filter(F.col("similarity") >= floor).withColumn(text, F.substring(text, 1, 300)), "item")


def match_notes(notes: DataFrame, chunks: DataFrame, query: DataFrame | list[float], k: int = 5, notebook: object | None = None) -> DataFrame:
    """The nearest notes without an embedded chunk: an anti-join decides, with no tier ceiling."""
    embedded = chunks.filter(F.col("embedding").isNotNull()).select("note_id")
    df = notes.join(embedded, "note_id", "left_anti")
    if notebook is not None:
        df = df.filter(F.col("notebook") == notebook)
    return best(with_similarity(df, query), k, "note_id")


def provenance(units: DataFrame, notes: DataFrame, bursts: DataFrame) -> DataFrame:
    """Units with the note or burst they come from; values of the unit win, then the note's, then the burst's.

    Both joins are on unique keys, so top-k before or after them is the same.
    """
    n = notes.select(F.col("id").alias("note_id"), F.col("title").alias("note_title"), F.col("notebook").alias("note_notebook")).dropDuplicates(["note_id"])
    b = bursts.select(F.col("id").alias("burst_id"), F.col("thread_name"), F.col("burst_index"), F.col("dominant_sender").alias("burst_sender")).dropDuplicates(["burst_id"])
    # a unit names its note before the first '::' that follows the id, a vault's note with a prefix of its own
    note_key = F.regexp_extract("source_id", r"^((?:obsidian::)?[0-9a-f]+)(?:::.*)?$", 1)
    u = units.withColumn("note_key", F.when(F.col("source_type").isin("joplin", "obsidian"), F.nullif(note_key, F.lit("")))).withColumn("burst_key", F.when(F.col("source_type") == "imessage", F.col("source_id")))
    out = u.join(n, F.col("note_key") == F.col("note_id"), "left").join(b, F.col("burst_key") == F.col("burst_id"), "left")
    return out.withColumn("shown_title", F.coalesce("title", "note_title", "thread_name")).withColumn("shown_notebook", F.coalesce("notebook", "note_notebook")).withColumn("shown_sender", F.coalesce("dominant_sender", "burst_sender")).drop("note_key", "burst_key")


def hybrid(branches: list[tuple[str, DataFrame]], limit: int = 5, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Candidates of several branches ``(key, similarity[, entry_date])`` merged by score; branch order breaks ties."""
    parts = [df.withColumn("branch", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(branches)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if date_from is not None:
        merged = merged.filter(F.col("entry_date") >= F.lit(date_from))
    if date_to is not None:
        merged = merged.filter(F.col("entry_date") <= F.lit(date_to))
    return merged.orderBy(F.desc("similarity"), "_rank", "key").limit(limit).drop("_rank")


def check_request(query: str, limit: int) -> None:
    """What the query API accepts: a query that isn't blank, 1 to 20 results."""
    if not query or not query.strip():
        raise ValueError("the query is empty")
    if not 1 <= limit <= 20:
        raise ValueError("the limit is from 1 to 20")


def equals_all(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows that equal every given value (a null value asks for null)."""
    cond: list[Column] = [F.col(k).isNull() if v is None else F.col(k) == v for k, v in conditions.items()]
    return df.filter(reduce(lambda a, b: a & b, cond)) if cond else df
