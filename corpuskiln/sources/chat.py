"""Chat exports: one CSV per thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import ids
from corpuskiln.operators.bursts import sender_of

#: The columns of an export.
COLUMNS = ["Chat Session", "Message Date", "Delivered Date", "Read Date", "Edited Date", "Deleted Date", "Service", "Type", "Sender ID", "Sender Name", "Status", "Replying to", "Subject", "Text", "Reactions", "Attachment", "Attachment type"]


def read_exports(spark: SparkSession, path: str, owner: str) -> DataFrame:
    """Messages of all files of a folder (or one file), the file being the thread.

    Notifications and rows without a readable date are left out.
    """
    schema = ", ".join(f"`{c}` STRING" for c in COLUMNS)
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', pathGlobFilter="*.csv")
    raw = raw.select("*", F.col("_metadata.file_name").alias("file"))
    at = F.try_to_timestamp("Message Date", F.lit("yyyy-MM-dd HH:mm:ss"))
    m = raw.filter(F.coalesce(F.lower(F.trim("Type")), F.lit("")) != "notification").withColumn("timestamp", at).filter("timestamp is not null")
    thread = ids.short_id(F.col("file"))
    return m.select(
        ids.short_id(F.concat_ws("|", "file", "Message Date", "Sender ID", "Sender Name", "Text", "Attachment")).alias("id"), thread.alias("thread_id"), F.col("Chat Session").alias("thread_name"), sender_of(F.col("Sender Name"), F.col("Type"), owner).alias("sender_name"), F.coalesce("Sender ID", F.lit("")).alias("sender_id"),
        "timestamp", F.coalesce("Text", F.lit("")).alias("text"), F.col("Type").alias("message_type"), F.coalesce("Reactions", F.lit("")).alias("reactions"), F.coalesce("Attachment", F.lit("")).alias("attachment"), F.coalesce("Attachment type", F.lit("")).alias("attachment_type"), F.col("file").alias("source_file"),
    )


def threads_of(messages: DataFrame, owner: str) -> DataFrame:
    """One row per thread: participants, class, dates and size."""
    from corpuskiln.operators.bursts import thread_class

    g = messages.groupBy(F.col("thread_id").alias("id")).agg(F.max("thread_name").alias("thread_name"), F.array_sort(F.collect_set("sender_name")).alias("participants"), F.min("timestamp").alias("date_start"), F.max("timestamp").alias("date_end"), F.count(F.lit(1)).alias("message_count"), F.first("source_file").alias("source_file"))
    kind = thread_class(F.col("participants"), owner)
    return g.withColumn("thread_type", kind).withColumn("privacy_tier", F.when(F.col("thread_type") == "bilateral", 3).otherwise(2))
