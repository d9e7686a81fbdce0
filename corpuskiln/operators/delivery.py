"""Exactly-once view of rows that were delivered at least once.

An identifier made of a producer and a sequence number is checked against the
producer's *seen ranges*: disjoint intervals of numbers that were accepted
before.  A sweep over each producer's numbers, batch by batch at each number,
keeps the range that it is in: a number that the range covers was accepted
before, any other is accepted once and lengthens the range or opens one.  The
ranges of earlier runs take part in the same sweep.  Identifiers without such a
number are looked up exactly.

Shape at scale: rows are first reduced to one *claim* per identifier and batch
with a map-side combined aggregate, so an identifier that holds a third of all
rows costs one claim per map task.  The sweep runs per producer and block of
``2**BLOCK_BITS`` numbers, so that a producer with most of the numbers is
spread over as many tasks as it has blocks, and a task sees no more rows than a
block has numbers and batches.

Nulls: a missing identifier matches nothing and its row is always kept.  Ties
in the order columns are broken by the row id; repeated row ids count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16


def folder_key(c: Column) -> Column:
    """Folder spelling: letter case, outer blanks and a closing slash don't count."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s/]+$", ""), F.lit(""))


def message_key(c: Column) -> Column:
    """Message-id spelling: letter case, blanks and enclosing brackets don't count."""
    bare = F.regexp_replace(F.lower(c), r"[\s ]+", "")
    return F.nullif(F.regexp_replace(bare, r"^[<\[(]+|[>\])]+$", ""), F.lit(""))


def _block(number: Column) -> Column:
    return F.shiftright(number.cast("long"), BLOCK_BITS)


def claims(rows: DataFrame, keys: list[str], order: list[Column], row_id: str) -> DataFrame:
    """One row per identifier: ``_first`` is the id of its first delivery, ``_n`` their number."""
    first = F.min_by(F.col(row_id), F.struct(*order, F.col(row_id)))
    return rows.groupBy(*keys).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Joins overlapping and adjacent ``(producer, block, lo, hi)`` into disjoint ranges."""
    w = Window.partitionBy("producer", "block").orderBy("lo", "hi")
    seen = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("_new", (seen.isNull() | (F.col("lo") > seen + 1)).cast("int"))
    runs = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("producer", "block", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def in_blocks(ledger: DataFrame) -> DataFrame:
    """``(producer, block, lo, hi)``: ranges ``(producer, lo, hi)`` cut where blocks end."""
    each = ledger.select("producer", "lo", "hi", F.explode(F.sequence(_block(F.col("lo")), _block(F.col("hi")))).alias("block"))
    return each.select("producer", "block", F.greatest("lo", F.shiftleft("block", BLOCK_BITS)).alias("lo"), F.least("hi", F.shiftleft(F.col("block") + 1, BLOCK_BITS) - 1).alias("hi"))


def accept_numbered(numbered: DataFrame, order: list[Column], row_id: str, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepts each uncovered number of ``(producer, number)`` once, in ``order``.

    ``ledger`` holds the ranges ``(producer, block, lo, hi)`` of earlier runs.
    Returns the claims ``(producer, number, _order, _id, _n, _accepted)``, one
    per number and place in the order, ``_accepted`` false where the ranges
    cover the number by then, and the grown ledger.
    """
    got = numbered.groupBy("producer", "number", F.struct(*order).alias("_order")).agg(F.min(row_id).alias("_id"), F.count(F.lit(1)).alias("_n"))
    events = got.select("producer", _block(F.col("number")).alias("block"), F.col("number").alias("lo"), F.col("number").alias("hi"), F.lit(True).alias("_claim"), "_order", "_id", "_n")
    if ledger is not None:
        events = events.unionByName(ledger.select("producer", "block", "lo", "hi", F.lit(False).alias("_claim")), allowMissingColumns=True)
    # at equal numbers the ranges of earlier runs come first, then the claims in their order
    w = Window.partitionBy("producer", "block").orderBy("lo", "_claim", "_order", "_id")
    seen = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    swept = events.withColumn("_seen", seen).withColumn("_new", (F.col("_seen").isNull() | (F.col("lo") > F.col("_seen") + 1)).cast("int"))
    claimed = swept.filter("_claim").select("producer", F.col("lo").alias("number"), "_order", "_id", "_n", F.coalesce(F.col("lo") > F.col("_seen"), F.lit(True)).alias("_accepted"))
    runs = swept.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return claimed, runs.groupBy("producer", "block", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def ledger_of(rows: DataFrame, producer: Column, number: Column) -> DataFrame:
    """The seen ranges of ``rows``, joined across blocks: ``(producer, lo, hi)``."""
    numbered = rows.select(producer.alias("producer"), number.cast("long").alias("number")).dropna().distinct()
    per_block = merge_ranges(numbered.select("producer", _block(F.col("number")).alias("block"), F.col("number").alias("lo"), F.col("number").alias("hi")))
    # only ranges that touch an end of their block can go on in the next one: at most two a block
    first, last = F.shiftleft(F.col("block"), BLOCK_BITS), F.shiftleft(F.col("block") + 1, BLOCK_BITS) - 1
    edge = (F.col("lo") == first) | (F.col("hi") == last)
    across = merge_ranges(per_block.filter(edge).withColumn("block", F.lit(0).cast("long")))
    return per_block.filter(~edge).unionByName(across).select("producer", "lo", "hi")


def resolve(rows: DataFrame, row_id: str, order: list[Column], producer: Column | None = None, number: Column | None = None, key: Column | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """Adds ``_first``: the id of the delivery that is kept for the row's message.

    With ``producer`` and ``number`` the row is checked against ranges, with
    ``key``, or where the number is missing, by exact lookup.  ``_first`` is
    the row's own id where nothing identifies it and null where a range of
    ``ledger`` already covers it.
    """
    own = rows
    parts = []
    if producer is not None and number is not None:
        numbered = own.withColumn("producer", producer).withColumn("number", number.cast("long"))
        well = numbered.filter(F.col("producer").isNotNull() & F.col("number").isNotNull())
        claimed, _ = accept_numbered(well, order, row_id, ledger)
        kept = claimed.filter("_accepted").select("producer", "number", F.col("_id").alias("_first"))
        parts.append(well.join(kept, ["producer", "number"], "left").drop("producer", "number"))
        own = numbered.filter(F.col("producer").isNull() | F.col("number").isNull()).drop("producer", "number")
    keyed = own.withColumn("_key", key if key is not None else F.lit(None).cast("string"))
    if key is not None:
        named = keyed.filter(F.col("_key").isNotNull())
        parts.append(named.join(claims(named, ["_key"], order, row_id).drop("_n"), "_key").drop("_key"))
        keyed = keyed.filter(F.col("_key").isNull())
    parts.append(keyed.drop("_key").withColumn("_first", F.col(row_id)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_once(rows: DataFrame, row_id: str, order: list[Column], **how) -> DataFrame:
    """Exactly one row of each message."""
    got = resolve(rows, row_id, order, **how)
    return got.filter(F.col("_first").eqNullSafe(F.col(row_id))).drop("_first")


def delivery_pairs(rows: DataFrame, row_id: str, order: list[Column], **how) -> DataFrame:
    """All pairs ``(row_a, row_b)`` of rows that carry the same message, the smaller id first.

    Only redelivered rows enter the self-join; the pairs with the kept row need none.
    """
    again = resolve(rows, row_id, order, **how).filter(F.col("_first") != F.col(row_id)).select("_first", F.col(row_id).alias("_row")).distinct()
    kept = again.select(F.col("_first").alias("row_a"), F.col("_row").alias("row_b"))
    left, right = again.select("_first", F.col("_row").alias("row_a")), again.select("_first", F.col("_row").alias("row_b"))
    rest = left.join(right, "_first").filter("row_a < row_b").drop("_first")
    both = kept.unionByName(rest)
    return both.select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"))


def members(rows: DataFrame, row_id: str, order: list[Column], **how) -> DataFrame:
    """``(row_id, kept_id)`` of rows delivered more than once: a row each, where pairs would be many."""
    got = resolve(rows, row_id, order, **how).select(F.col(row_id).alias("row_id"), F.col("_first").alias("kept_id"))
    again = got.filter("row_id <> kept_id").select("kept_id").distinct()
    return got.join(again, "kept_id", "left_semi").select("row_id", "kept_id")


def header_deliveries(messages: DataFrame) -> dict:
    """How rows of the header index are told apart: ranges of uid per folder."""
    return {"order": [F.coalesce(F.col("batch_no"), F.lit(2**31 - 1)).alias("batch_no")], "producer": folder_key(F.col("folder")), "number": F.col("uid")}


def mail_deliveries(mails: DataFrame) -> dict:
    """How mails are told apart: their ids name no producer and number, so by exact lookup."""
    return {"order": [F.coalesce(F.col("batch_no"), F.lit(2**31 - 1)).alias("batch_no")], "key": message_key(F.col("message_id"))}


def _both(messages: DataFrame, mails: DataFrame, what) -> DataFrame:
    heads = messages.select(F.col("id").cast("string").alias("id"), "folder", "uid", "batch_no")
    post = mails.select(F.col("id").cast("string").alias("id"), "message_id", "batch_no")
    a, b = what(heads, "id", **header_deliveries(heads)), what(post, "id", **mail_deliveries(post))
    return a.select(F.lit("messages").alias("tbl"), "*").unionByName(b.select(F.lit("email_messages").alias("tbl"), "*"))


def found_pairs(messages: DataFrame, mails: DataFrame) -> DataFrame:
    """``(tbl, row_a, row_b)`` of both tables."""
    return _both(messages, mails, delivery_pairs)


def found_members(messages: DataFrame, mails: DataFrame) -> DataFrame:
    """``(tbl, row_id, kept_id)`` of both tables."""
    return _both(messages, mails, members)


def by_batch(messages: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Per batch of the header index: rows delivered, numbers accepted and numbers that the ranges covered by then."""
    h = header_deliveries(messages)
    numbered = messages.withColumns({"producer": h["producer"], "number": h["number"].cast("long")}).filter("producer is not null and number is not null")
    claimed, _ = accept_numbered(numbered, [F.col("batch_no")], "id", ledger)
    return claimed.groupBy(F.col("_order.batch_no").alias("batch_no")).agg(F.sum("_n").alias("delivered"), F.count_if("_accepted").alias("accepted"), F.count_if(~F.col("_accepted")).alias("covered"))
