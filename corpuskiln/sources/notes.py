"""Note folders: synchronised records, front-matter files and vaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import ids
from corpuskiln.functions import text as tx

_META = r"^([^:]+):(.*)$"


def read_files(spark: SparkSession, folder: str, recursive: bool = False, glob: str = "*.md") -> DataFrame:
    """``(path, modified, content)`` of the files of a folder, whole."""
    r = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.regexp_replace("value", "\r\n", "\n").alias("content"))


def records(files: DataFrame) -> DataFrame:
    """Sync files as records ``(path, title, body, meta, kind)``.

    The first line is the title; the longest run of ``key: value`` lines at
    the end is the metadata; what is between is the body.  An empty file is of
    kind '0'.
    """
    ls = F.split(F.regexp_replace("content", r"\n+$", ""), "\n")
    f = files.withColumn("_l", ls)
    meta_from = F.aggregate(F.reverse("_l"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a["go"] & x.rlike(_META), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & x.rlike(_META)).alias("go")), lambda a: a["n"])
    f = f.withColumn("_m", F.least(meta_from, F.size("_l")))
    tail = F.slice("_l", F.size("_l") - F.col("_m") + 1, F.col("_m"))
    pairs = F.transform(tail, lambda x: F.struct(F.trim(F.regexp_extract(x, _META, 1)).alias("key"), F.trim(F.regexp_extract(x, _META, 2)).alias("value")))
    # a repeated key counts once, as its last line says
    meta = F.map_from_entries(F.aggregate(pairs, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p))))
    # in a relation file even the first line is metadata
    title = F.when(F.col("_m") < F.size("_l"), F.trim(F.element_at("_l", 1))).otherwise("")
    body_lines = F.slice("_l", 2, F.greatest(F.size("_l") - F.col("_m") - 1, F.lit(0)))
    body = F.regexp_replace(F.array_join(body_lines, "\n"), r"^\s+|\s+$", "")
    out = f.select("path", title.alias("title"), body.alias("body"), F.when(F.col("_m") > 0, meta).otherwise(F.expr("cast(map() as map<string,string>)")).alias("meta"))
    return out.withColumn("kind", F.coalesce(F.try_element_at("meta", F.lit("type_")), F.lit("0")))


def notes_of(recs: DataFrame) -> DataFrame:
    """Notes of the records, with notebook title ('' default), known tags, leftover metadata and resource links, by id.

    Encrypted notes are left out, empty bodies kept.
    """
    m = lambda k: F.try_element_at("meta", F.lit(k))
    books = recs.filter("kind = '2'").select(m("id").alias("parent_id"), F.col("title").alias("notebook")).dropDuplicates(["parent_id"])
    tag_names = recs.filter("kind = '5'").select(m("id").alias("tag_id"), F.col("title").alias("tag")).dropDuplicates(["tag_id"])
    rel = recs.filter("kind = '6'").select(m("note_id").alias("id"), m("tag_id").alias("tag_id")).join(tag_names, "tag_id").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    n = recs.filter("kind = '1'").filter(F.coalesce(m("encryption_applied"), F.lit("0")) != "1").withColumn("id", m("id")).withColumn("parent_id", m("parent_id"))
    own = F.array(*[F.lit(k) for k in ("id", "parent_id", "type_", "created_time", "updated_time")])
    out = n.join(books, "parent_id", "left").join(rel, "id", "left")
    return out.select(
        "id", "title", "body", F.coalesce("notebook", F.lit("")).alias("notebook"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce(m("created_time"), F.lit("")).alias("created_at"), F.coalesce(m("updated_time"), F.lit("")).alias("updated_at"),
        F.map_filter("meta", lambda k, v: ~F.array_contains(own, k)).alias("metadata"), F.col("path").alias("source_file"), tx.resource_links(F.col("body")).alias("resource_links"),
    ).orderBy("id")


def parse_sync_folder(spark: SparkSession, folder: str) -> DataFrame:
    return notes_of(records(read_files(spark, folder)))


_FRONT = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n(.*))?$"


def front_matter(files: DataFrame) -> DataFrame:
    """Adds ``front`` (a map of simple ``key: value`` lines, null without front matter) and ``body``.

    Lists may be ``[a, b]`` or ``- a`` lines below their key; they come as
    ``a, b``.  A block with a line that is neither makes the whole text body.
    """
    raw = F.regexp_extract("content", _FRONT, 1)
    # list items are folded into the line of their key
    folded = F.regexp_replace(F.regexp_replace(raw, r"\n[ \t]*- +", ", "), r"(?m)^([^:\n]+:)[ \t]*, ", "$1 ")
    ls = F.filter(F.split(folded, "\n"), lambda x: F.trim(x) != "")
    good = F.forall(ls, lambda x: x.rlike(r"^[^:]+:"))
    unquote = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), r"^\[(.*)\]$", "$1"), r"^([\"'])(.*)\1$", "$2")
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), unquote(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value"))
    has = F.col("content").rlike(_FRONT) & (F.size(ls) > 0) & good
    pairs = F.aggregate(F.transform(ls, entry), F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p)))
    return files.withColumn("front", F.when(has, F.map_from_entries(pairs))).withColumn("body", F.when(F.col("content").rlike(_FRONT) & ((F.size(ls) == 0) | good), F.regexp_extract("content", _FRONT, 2)).otherwise(F.col("content")))


def _list(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_front_matter_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Front-matter files as notes; every key may be missing."""
    f = front_matter(read_files(spark, folder))
    g = lambda k: F.try_element_at("front", F.lit(k))
    return f.select(g("id").alias("id"), g("title").alias("title"), g("created_time").try_cast("long").alias("created_time"), g("updated_time").try_cast("long").alias("updated_time"), _list(g("tags")).alias("tags"), g("notebook").alias("notebook"), "body", tx.resource_links(F.col("body")).alias("resources"), F.col("path").alias("source_file"))


def parse_vault(spark: SparkSession, folder: str, flag: str = "publish") -> DataFrame:
    """Vault notes that opt in by a flag that is true; hidden folders are left out.

    The id is a hash of the relative path; title and dates fall back to file
    name and modification time; other keys are metadata.
    """
    root = folder.rstrip("/")
    f = front_matter(read_files(spark, root, recursive=True))
    rel = F.regexp_replace(F.substring_index("path", root + "/", -1), r"^/+", "")
    f = f.withColumn("rel", F.url_decode(rel)).filter(~F.concat(F.lit("/"), "rel").rlike(r"/\."))
    g = lambda k: F.try_element_at("front", F.lit(k))
    stem = F.regexp_extract("rel", r"([^/]+)\.md$", 1)
    when = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")
    own = F.array(*[F.lit(k) for k in (flag, "title", "created", "updated", "tags", "notebook")])
    out = f.filter(F.lower(g(flag)) == "true")
    return out.select(
        ids.vault_id(F.col("rel")).alias("id"), F.coalesce(F.nullif(g("title"), F.lit("")), stem).alias("title"), tx.strip_vault_syntax(F.col("body")).alias("body"), F.coalesce(g("notebook"), F.lit("")).alias("notebook"), _list(g("tags")).alias("tags"),
        F.coalesce(g("created"), when).alias("created_at"), F.coalesce(g("updated"), when).alias("updated_at"), F.map_filter("front", lambda k, v: ~F.array_contains(own, k)).alias("metadata"), F.col("rel").alias("source_file"),
    ).orderBy("source_file")


def census(files: DataFrame) -> DataFrame:
    """Files by kind: the first ``type_:`` that they hold, else 'other'."""
    kind = F.regexp_extract("content", r"(?m)^type_: ?(\d)", 1)
    return files.groupBy(F.when(kind != "", kind).otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
