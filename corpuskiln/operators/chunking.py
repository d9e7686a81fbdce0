"""Notes cut into dated chunks, by five archetypes of notes.

A journal entries below date headings; B the same with template sections;
C a reference block, then a dated log; D a trip by day markers; E recordings.

Everything is windows over the lines of a note: one shuffle by note serves
segmentation, offsets and merging; no window holds more than a note's lines.
Lines end at ``\\n``.  Notes below ``MIN_NOTE`` characters give no chunks; a
note of which nothing remains gives one chunk, itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions import text as tx
from corpuskiln.functions.dates import parse_date, recording_time

MIN_NOTE = 1000
SHORT_ENTRY = 400
LONG_ENTRY = 2000
ONLY_RECORDING = r"(?i)\[[^\]\n]*\.(?:m4a|mp3|wav|ogg)\]\(:/"
DAY_MARKER = r"(?i)^(?:#+ *)?(?:day \d+|(?:mon|tues|wednes|thurs|fri|satur|sun)day)\b"
#: Headings of entry templates; a small invented default.
TEMPLATE_HEADINGS = ["score", "gratitude", "highlights", "intentions", "reflection"]


def _template(line: Column) -> Column:
    return line.rlike(r"(?i)^(?:#+ *|\*\*)(?:" + "|".join(TEMPLATE_HEADINGS) + r")\b")


def detect_archetype(title: Column, notebook: Column, body: Column) -> Column:
    """The archetype of a note; the first rule that holds decides."""
    hint = F.lower(F.concat_ws(" ", title, notebook))
    dated_heading = body.rlike(r"(?m)^#+ +\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b")
    first_line = F.split(F.regexp_replace(body, r"^\s+", ""), "\n")[0]
    return (
        F.when(body.rlike(ONLY_RECORDING), "E")
        .when(hint.rlike(r"\b(?:trip|travel|itinerary)\b") | body.rlike(r"(?im)^(?:#+ *)?(?:day \d|mon|tue|wed|thu|fri|sat|sun)"), "D")
        .when(dated_heading & parse_date(first_line).isNull(), "C")
        .when(body.rlike(r"(?im)^(?:#+ *|\*\*)(?:" + "|".join(TEMPLATE_HEADINGS) + r")\b"), "B")
        .otherwise("A")
    )


def lines(notes: DataFrame, key: str = "id", body: str = "body", *keep: str) -> DataFrame:
    """``(key, keep..., line_no, line, char_start, before)``: lines with their offset and the line before, '' for the first."""
    ls = notes.select(key, *keep, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ls.withColumn("char_start", start.cast("int")).withColumn("before", F.lag("line", 1, "").over(w))


def with_headers(ls: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``date`` of each line and ``header``, whether it heads a dated entry.

    Only lines with a digit are read for a date, each once; the line before
    brings its own along.
    """
    digit = F.col("line").rlike(r"\d")
    ls = ls.withColumn("date", F.when(digit, parse_date(F.col("line"))))
    bare = F.trim(F.regexp_replace("line", r"^#+ *", ""))
    words = F.split(bare, r"\s+")
    w = Window.partitionBy(key).orderBy("line_no")
    early = F.when(digit & (F.size(words) < 10), parse_date(F.array_join(F.slice(words, 1, 4), " ")))
    before = F.trim("before")
    after = (before == "") | before.startswith("#") | F.lag("date").over(w).isNotNull()
    return ls.withColumn("header", (bare != "") & early.isNotNull() & after)


def entries(ls: DataFrame, boundary: Column, stamp: Column, key: str = "id", *keep: str) -> DataFrame:
    """Lines joined to entries at boundaries; entry 0 is what stands before the first one."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = ls.withColumn("_b", F.coalesce(boundary, F.lit(False)).cast("int")).withColumn("entry_no", F.sum("_b").over(w))
    g = cut.groupBy(key, *keep, "entry_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.min("char_start").alias("char_start"), F.max(F.col("char_start") + F.length("line")).alias("char_end"),
        F.max(F.when(F.col("_b") == 1, stamp)).alias("entry_timestamp"),
    )
    return g.filter((F.col("entry_no") > 0) | (F.trim("text") != ""))


def merge_short(parts: DataFrame, key: str = "id", special: Column | None = None, limit: int = SHORT_ENTRY, keep: tuple[str, ...] = ()) -> DataFrame:
    """An entry below ``limit`` characters takes in the next one; both are then done.

    In each run of short entries those at odd places absorb their successor,
    which is the same as the greedy walk.  Special entries never take part.
    """
    special = F.lit(False) if special is None else special
    w = Window.partitionBy(key).orderBy("entry_no")
    p = parts.withColumn("_special", special).withColumn("_short", (F.length("text") < limit) & ~F.col("_special"))
    p = p.withColumn("_rn", F.row_number().over(w)).withColumn("_k", F.col("_rn") - F.row_number().over(Window.partitionBy(key, "_short").orderBy("entry_no")))
    p = p.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_short", "_k").orderBy("entry_no")))
    p = p.withColumn("_takes", F.col("_short") & (F.col("_place") % 2 == 1) & F.lead("_rn").over(w).isNotNull())
    p = p.withColumn("_lead", F.when(F.coalesce(F.lag("_takes").over(w), F.lit(False)), F.col("_rn") - 1).otherwise(F.col("_rn")))
    first = F.struct("entry_no", "entry_timestamp")
    return p.groupBy(key, *keep, "_lead").agg(
        F.min("entry_no").alias("entry_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min(first)["entry_timestamp"].alias("entry_timestamp"), F.bool_or("_special").alias("special"),
    ).drop("_lead")


def _split_long(parts: DataFrame, key: str, *keep: str) -> DataFrame:
    """B entries above ``LONG_ENTRY`` characters cut again at template headings; the pieces keep the entry's date."""
    ls = parts.select(key, *keep, "entry_no", "entry_timestamp", F.col("char_start").alias("_s"), F.length("text").alias("_len"), F.posexplode(F.when((F.col("archetype") == "B") & (F.length("text") > LONG_ENTRY), F.split("text", "\n")).otherwise(F.array("text"))).alias("line_no", "line"))
    w = Window.partitionBy(key, "entry_no").orderBy("line_no")
    at = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_s")
    ls = ls.withColumn("_cut", ((F.col("line_no") > 0) & _template(F.col("line"))).cast("int")).withColumn("_at", at)
    ls = ls.withColumn("_piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = ls.groupBy(key, *keep, "entry_no", "_piece").agg(F.first("entry_timestamp").alias("entry_timestamp"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"), F.min("_at").cast("int").alias("char_start"), F.max(F.col("_at") + F.length("line")).cast("int").alias("char_end"), F.min("entry_no").alias("_entry"))
    # numbered anew, the block before the first boundary staying 0
    n = F.row_number().over(Window.partitionBy(key).orderBy("entry_no", "_piece")) - F.when(F.min("_entry").over(Window.partitionBy(key)) == 0, 1).otherwise(0)
    return g.withColumn("_n", n).drop("entry_no", "_piece", "_entry").withColumnRenamed("_n", "entry_no")


def chunk_notes(notes: DataFrame, key: str = "id") -> DataFrame:
    """``(key, archetype, chunk_index, chunk_text, char_start, char_end, entry_timestamp, resource_ids, metadata)``.

    ``notes`` has the key, title, notebook, body and created_at (text).  Chunks
    that are empty are dropped after numbering, so numbers may have gaps.
    """
    n = notes.filter(F.length("body") >= MIN_NOTE).select(key, "title", "notebook", "body", "created_at").dropDuplicates([key])
    n = n.withColumn("archetype", detect_archetype(F.col("title"), F.col("notebook"), F.col("body")))
    keep = ("archetype", "created_at")
    ls = with_headers(lines(n, key, "body", *keep), key)
    table_row = F.trim("line").startswith("|")
    kind = F.col("archetype")
    boundary = F.when(kind == "E", F.col("line").rlike(ONLY_RECORDING)).when(kind == "D", F.col("line").rlike(DAY_MARKER)).when(kind == "C", F.col("header") & ~table_row).otherwise(F.col("header"))
    stamp = F.when(kind == "E", recording_time(F.col("line"))).when(kind == "D", F.lit(None).cast("string")).otherwise(F.col("date").cast("string"))
    parts = _split_long(entries(ls, boundary, stamp, key, *keep), key, *keep)
    special = (F.col("entry_no") == 0) & F.col("archetype").isin("C", "D", "E")
    merged = merge_short(parts, key, special, keep=keep)
    # the n-th marker of a trip is n days after the note began
    day = F.row_number().over(Window.partitionBy(key, "special").orderBy("entry_no")) - 1
    began = F.try_to_date(F.substring("created_at", 1, 10), "yyyy-MM-dd")
    trip = F.coalesce(parse_date(F.col("text")).cast("string"), F.concat(F.lit("calculated: "), F.date_add(began, day).cast("string")))
    merged = merged.withColumn("entry_timestamp", F.when((F.col("archetype") == "D") & ~F.col("special"), trip).otherwise(F.col("entry_timestamp")))
    merged = merged.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("entry_no")) - 1)
    linked = F.col("archetype").isin("D", "E")
    meta = F.map_filter(
        F.create_map(F.lit("archetype"), F.col("archetype"), F.lit("reference"), F.when(F.col("special") & F.col("archetype").isin("C", "D"), "true"), F.lit("preamble"), F.when(F.col("special") & (F.col("archetype") == "E"), "true"), F.lit("note_type"), F.when(F.col("archetype") == "D", "travel"), F.lit("resource_type"), F.when(F.col("archetype") == "E", "audio")),
        lambda k, v: v.isNotNull(),
    )
    done = merged.select(key, "archetype", "chunk_index", F.when(linked, tx.without_resources(F.col("text"))).otherwise(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("chunk_text"), "char_start", "char_end", "entry_timestamp", F.when(linked, tx.resource_ids(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("resource_ids"), meta.alias("metadata"))
    done = done.filter("chunk_text <> ''")
    bare = n.join(done.select(key).distinct(), key, "left_anti").filter(F.trim("body") != "")
    whole = bare.select(key, "archetype", F.lit(0).alias("chunk_index"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("chunk_text"), F.lit(0).alias("char_start"), F.length("body").alias("char_end"), F.lit(None).cast("string").alias("entry_timestamp"), F.array().cast("array<string>").alias("resource_ids"), F.create_map(F.lit("archetype"), F.col("archetype")).alias("metadata"))
    return done.unionByName(whole)
