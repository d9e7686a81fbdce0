"""Feeds (XML) and news searches (JSON) as items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import ids
from corpuskiln.functions import text as tx
from corpuskiln.operators import instants


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: ``(source, item, title, url, summary, published, item_hash)``; title and link are needed."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    m = instants.read_texts(raw.select("*", F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1).alias("source")), "pubDate")
    m = m.withColumn("published", F.timestamp_micros(instants.instant(F.lit("UTC"), F.lit("DMY"))))
    good = m.filter(F.coalesce(F.trim("title"), F.lit("")) != "").filter(F.coalesce(F.trim("link"), F.lit("")) != "")
    return good.select("source", F.col("link").alias("item"), F.trim("title").alias("title"), F.trim("link").alias("url"), tx.clean_summary(F.col("description")).alias("summary"), "published", F.lit("rss").alias("origin"), ids.item_hash(F.trim("link")).alias("item_hash"))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Articles of search replies; removed ones are left out."""
    schema = "articles array<struct<title:string,url:string,description:string,publishedAt:string,source:struct<name:string>>>"
    a = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("articles").alias("a")).select("a.*")
    good = a.filter("title is not null and url is not null and title <> '[Removed]'")
    return good.select(F.col("source.name").alias("source"), F.col("url").alias("item"), "title", "url", F.substring(tx.clean_summary(F.col("description")), 1, 500).alias("summary"), F.try_to_timestamp("publishedAt").alias("published"), F.lit("news").alias("origin"), ids.item_hash(F.col("url")).alias("item_hash"))
