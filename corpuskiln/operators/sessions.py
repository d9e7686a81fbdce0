"""Sessions: an entity's events cut wherever more than ``gap`` passes between neighbours.

Method: occupancy bitmaps per entity.  Time is divided into cells of
``gap / CELLS``; a 64-bit word holds 64 cells.  A morphological closing by
doubling shifts fills every hole that is surely shorter than the gap, runs of
set bits are extracted, event counts are joined to them and their ends are
trimmed to the first and last event.  Two neighbouring runs whose distance
only the trimmed ends can decide (they are ``CELLS`` cells apart) are joined
if it is at most the gap, so the result is exact to the microsecond.

Shape at scale: events are first reduced to one row per occupied cell by a
map-side combined aggregate.  An entity that holds a third of all events has
no more cells than its time span has (about 1.0 million for 28 years of a
4-hour gap), and no more than a 64th of that in words, which is all that the
two windows per entity see.  Everything stays in generated JVM code.

Nulls: events without entity or time belong to no session.  Ties share a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 16
GAP_US = 4 * 3600 * 1_000_000


def _smear(word: Column, before: Column, steps: list[int]) -> Column:
    """``word`` with every bit repeated upwards over ``sum(steps)`` places, by doubling shifts; ``before`` is the word below."""
    for s in steps:
        word = word.bitwiseOR(F.shiftleft(word, s)).bitwiseOR(F.shiftrightunsigned(before, 64 - s))
        before = before.bitwiseOR(F.shiftleft(before, s))
    return word


def _shrink(word: Column, after: Column, steps: list[int]) -> Column:
    """The erosion that undoes :func:`_smear`; ``after`` is the word above."""
    for s in steps:
        word = word.bitwiseAND(F.shiftrightunsigned(word, s).bitwiseOR(F.shiftleft(after, 64 - s)))
        after = after.bitwiseAND(F.shiftrightunsigned(after, s))
    return word


def doubling(reach: int) -> list[int]:
    """Shifts 1, 2, 4, ... that add up to ``reach``."""
    steps, have = [], 0
    while have < reach:
        steps.append(min(have + 1, reach - have))
        have += steps[-1]
    return steps


def sessions(events: DataFrame, entity: str, at_us: Column, gap_us: int = GAP_US, weight: Column | None = None, flag: Column | None = None) -> DataFrame:
    """``(entity, start_us, end_us, n_events, flagged)``, one row per session.

    ``at_us`` is the event time in microseconds, ``weight`` how many events a
    row stands for (default 1), ``flagged`` whether any row's ``flag`` holds.
    A distance of exactly ``gap_us`` doesn't split.
    """
    width = max(1, gap_us // CELLS)
    cells_in_gap = gap_us // width  # neighbours closer than this many cells surely belong together
    steps = doubling(max(0, min(cells_in_gap, 48) - 2))
    e = events.select(F.col(entity).alias("_e"), at_us.cast("long").alias("_t"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"), (F.lit(True) if flag is None else flag).alias("_f"))
    e = e.filter(F.col("_e").isNotNull() & F.col("_t").isNotNull()).withColumn("_c", F.floor(F.col("_t") / width) if width == 1 else F.expr(f"cast(_t div {width} - if(_t % {width} < 0, 1, 0) as bigint)"))
    cells = e.groupBy("_e", "_c").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.sum("_w").alias("n"), F.bool_or("_f").alias("f"))
    cells = cells.withColumn("_word", F.shiftright(F.col("_c"), 6)).withColumn("_bit", F.col("_c").bitwiseAND(F.lit(63)).cast("int"))
    # the 64 cells of a word travel together: the list is bounded
    words = cells.groupBy("_e", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("x"), F.collect_list(F.struct("_bit", "lo", "hi", "n", "f")).alias("cells"))
    w = Window.partitionBy("_e").orderBy("_word")

    def beside(c: str, step: int) -> Column:
        near = (F.lag if step < 0 else F.lead)(F.struct("_word", c), 1).over(w)
        return F.when(near["_word"] == F.col("_word") + step, near[c]).otherwise(F.lit(0).cast("long"))

    words = words.withColumn("_below", beside("x", -1)).withColumn("_above", beside("x", 1))
    dilated = words.withColumn("d", _smear(F.col("x"), F.col("_below"), steps))
    # the dilation of the word above begins with what this word spills into it, even where that word holds no event
    spilled = _smear(F.col("_above"), F.col("x"), steps)
    closed = dilated.withColumn("_dup", spilled).withColumn("c", _shrink(F.col("d"), F.col("_dup"), steps))
    closed = closed.withColumn("_prev", beside("c", -1))
    starts = F.col("c").bitwiseAND(F.bitwise_not(F.shiftleft(F.col("c"), 1).bitwiseOR(F.shiftrightunsigned(F.col("_prev"), 63))))
    closed = closed.withColumn("s", starts)
    runs_before = F.coalesce(F.sum(F.bit_count("s")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = closed.select("_e", runs_before.alias("_base"), "s", "cells")  # before the explode: the window must see words, not cells
    one = based.select("_e", "_base", "s", F.explode("cells").alias("k")).select("_e", "s", "_base", "k.*")
    upto = F.expr("bit_count(s & shiftrightunsigned(-1L, 63 - _bit))")
    runs = one.withColumn("_run", F.col("_base") + upto).groupBy("_e", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.bool_or("f").alias("f"))
    v = Window.partitionBy("_e").orderBy("lo")
    cut = F.when(F.col("lo") - F.lag("hi").over(v) <= gap_us, 0).otherwise(1)
    joined = runs.withColumn("_cut", cut).withColumn("_s", F.sum("_cut").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("_e", "_s").agg(F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").alias("n_events"), F.bool_or("f").alias("flagged"))
    return out.select(F.col("_e").alias(entity), "start_us", "end_us", "n_events", "flagged")


def visible(text: Column) -> Column:
    """Whether something other than white space and U+FFFC is in the text."""
    return F.coalesce(F.regexp_replace(text, r"[\s\p{Z}\x{FFFC}\x{1C}-\x{1F}\x{85}]+", "") != "", F.lit(False))


def is_notification(message_type: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(message_type, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")) == "notification", F.lit(False))


def once_per_id(messages: DataFrame, *columns: str) -> DataFrame:
    """One row per message id: the earliest arrival; a missing id stands for itself.

    Only the named columns are kept and shuffled.
    """
    first = F.struct(F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp")).alias("_a"), *[F.col(c) for c in columns])
    own = F.when(F.col("id").isNull(), F.xxhash64(*columns))  # rows without id are told apart by what they say
    return messages.groupBy("id", own.alias("_own")).agg(F.min(first).alias("_m")).select("id", *[F.col(f"_m.{c}").alias(c) for c in columns])


def chat_bursts(messages: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Bursts of chat threads: ``(thread_id, start_us, end_us, n_messages)``.

    A message counts once per id, if thread and time are present and it isn't
    a notification; bursts without visible text aren't listed.
    """
    m = messages.filter(F.col("thread_id").isNotNull() & F.col("timestamp").isNotNull() & ~is_notification(F.col("message_type")))
    m = m.select("id", "created_at", "thread_id", F.unix_micros(F.col("timestamp")).alias("_t"), visible(F.col("text")).alias("_v"))
    m = once_per_id(m, "thread_id", "_t", "_v")
    s = sessions(m, "thread_id", F.col("_t"), gap_us, flag=F.col("_v"))
    return s.filter("flagged").select("thread_id", "start_us", "end_us", F.col("n_events").alias("n_messages"))
