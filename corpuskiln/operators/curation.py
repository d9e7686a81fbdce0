"""Feed curation: items merged with decisions and connections.

Decisions and notes on connections come from outside (a model or a person);
here is the relational part: merging, trimming, counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.operators.store import keep_first, keep_last

#: Strengths of a kept item, the strongest first.
STRENGTHS = ["strong", "solid", "worth_noting"]


def strength_rank(strength: Column) -> Column:
    out = F.lit(len(STRENGTHS))
    for i, s in reversed(list(enumerate(STRENGTHS))):
        out = F.when(strength == s, i).otherwise(out)
    return out


def freshest(items: DataFrame, now: Column, per_source: int = 20, days: int = 7) -> DataFrame:
    """First the newest ``per_source`` of each source, then of these the ones of the last ``days``; undated ones stay."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("published"), "item")
    top = items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_source).drop("_r")
    return top.filter(F.col("published").isNull() | (F.col("published") >= now - F.make_dt_interval(F.lit(days))))


def once_per_item(items: DataFrame, key: str, *rank: Column) -> DataFrame:
    """The first copy of each item by rank (feeds before searches)."""
    return keep_first(items, [key], *rank)


def apply_decisions(items: DataFrame, decisions: DataFrame, key: str, order: Column) -> DataFrame:
    """Items with ``decision``; the last of repeated decisions counts, none is KILL."""
    d = keep_last(decisions, [key], order).select(key, "decision", "strength")
    out = items.join(d, key, "left")
    return out.withColumn("decision", F.coalesce("decision", F.lit("KILL"))).withColumn("strength", F.when(F.col("decision") == "KEEP", F.col("strength")))


def trim_kept(items: DataFrame, key: str, more_than: int = 12, keep: int = 10) -> DataFrame:
    """If more than ``more_than`` are kept, only the ``keep`` strongest stay; the others become KILL.

    The few that stay are chosen by a limit, not by a window over all items.
    """
    kept = items.filter("decision = 'KEEP'")
    n = kept.agg(F.count(F.lit(1)).alias("_n"))
    best = kept.orderBy(strength_rank(F.col("strength")), key).limit(keep).select(key, F.lit(True).alias("_best"))
    out = items.crossJoin(F.broadcast(n)).join(F.broadcast(best), key, "left")
    drop = (F.col("_n") > more_than) & (F.col("decision") == "KEEP") & F.col("_best").isNull()
    return out.withColumn("decision", F.when(drop, "KILL").otherwise(F.col("decision"))).drop("_n", "_best")


def kill_report(items: DataFrame, group: str) -> DataFrame:
    """Per group: items, kept, kill rate."""
    return items.groupBy(group).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("decision") == "KEEP").alias("kept"), F.round(1 - F.count_if(F.col("decision") == "KEEP") / F.count(F.lit(1)), 2).alias("kill_rate"))


def connection_density(items: DataFrame, connections: DataFrame, key: str) -> DataFrame:
    """Items with ``connection_density``, the number of their connections; 0 where they have none."""
    n = connections.groupBy(key).agg(F.count(F.lit(1)).alias("connection_density"))
    return items.join(n, key, "left").withColumn("connection_density", F.coalesce("connection_density", F.lit(0)))


def well_formed(items: DataFrame, *fields: str) -> tuple[DataFrame, DataFrame]:
    """The items of which all fields say something, and the others, which are skipped rather than published half."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & (F.coalesce(F.trim(f), F.lit("")) != "")
    return items.filter(whole), items.filter(~whole)


def kept_by(items: DataFrame, group: str) -> DataFrame:
    """Per group: how many items survive."""
    return items.filter("decision = 'KEEP'").groupBy(group).agg(F.count(F.lit(1)).alias("kept"))


def annotate(connections: DataFrame, notes: DataFrame) -> DataFrame:
    """Connections with their notes, by item and place; keep=false drops one, a missing note keeps it, books always stay.

    An item without any note is left as it is.
    """
    n = notes.select("item_hash", "ordinal", F.col("keep").alias("_keep"), F.col("relevance_note").alias("_note"))
    out = connections.join(n, ["item_hash", "ordinal"], "left")
    return out.filter((F.col("source") == "book") | F.coalesce("_keep", F.lit(True))).withColumn("relevance_note", F.coalesce("_note", "relevance_note")).drop("_keep", "_note")


def trailing_window(connected: DataFrame, filtered: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Items of the last ``days`` days, each day's from ``connected``, or from ``filtered`` where that has none at all."""
    recent = lambda df: df.filter((F.col("day") <= today) & (F.col("day") > F.date_sub(today, days)))
    have = recent(connected)
    some = have.limit(1).select(F.lit(1).alias("_some"))
    other = recent(filtered).join(F.broadcast(some), how="left_anti", on=F.lit(True))
    return have.unionByName(other.select(*have.columns))
