"""Conversations rebuilt from message rows.

Method: the clocks of a thread's senders are aligned first.  An echo of a
reaction ("Liked “…”") must come after the message that it quotes; the latest
such demand of each ordered pair of senders bounds how far their clocks are
apart.  Where an echo stands before its message, the offsets are taken that
meet all bounds of the thread with the least squares of corrections (the
owner's clock, or else the first sender's, stays); times are corrected and the
turns merged in that order, an echo after the message of the same time.  A
thread whose bounds contradict each other keeps its clocks; the echoes that
stand before their messages are counted in ``conflicts``, and
:func:`conversations` rejects it if they are more than ``TOLERATED`` of its
echoes (some quote a message that is missing, whose words are said again later).

A thread is also rejected if a message has no time or no role, or if there is
no reply.  ``dropped_threads`` lists by the statement, which doesn't name
contradicting clocks: for it such a thread keeps its clocks as they are.

Shape at scale: messages are reduced to one row per id without the text, which
is checkpointed; a quoted text is looked up by hash in a per-thread table of
first uses (one row per text, so a text said a million times costs one row);
only bounds reach the solver, a row per ordered pair of senders.  Order inside a thread comes
from day buckets: no task sorts a whole thread, the window per thread sees one
row per day, and verdicts are joined to days, not to messages.  Texts are
shuffled once, by id, and joined to the ordered rows.

Nulls: rows without thread are left out; a missing id stands for itself.  Equal
times are ordered by id, echoes last.  Empty input gives empty output.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.operators.instants import zone_table as small_table
from corpuskiln.operators.ordering import in_turn
from corpuskiln.operators.sessions import is_notification, visible
from corpuskiln.session import cut_lineage

#: What a chat export writes for a reaction, before the quoted message.
REACTION_WORDS = ["Liked", "Loved", "Disliked", "Laughed at", "Emphasized", "Emphasised", "Questioned"]
_ECHO = r"(?is)^\s*(?:" + "|".join(REACTION_WORDS) + r")\s+[\"“”„«‘'](.*)[\"“”»’']\s*$"

#: Clocks differ by no more: a quoted text that is first said later than this after its echo isn't the quoted message.
MAX_SKEW_US = 24 * 3600 * 1_000_000

#: The share of a thread's echoes that may contradict the others.
TOLERATED = 0.01


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def owner_names(contacts: DataFrame) -> DataFrame:
    """Names of the owner, one column ``_name``."""
    own = contacts.filter(F.coalesce("is_self", F.lit(False)))
    return own.select(F.explode(F.array("display_name", "chat_name")).alias("n")).select(_plain(F.col("n")).alias("_name")).filter("_name <> ''").distinct()


def _rows(messages: DataFrame) -> tuple[DataFrame, Column]:
    """The rows that count, without the text but for its hashes, and what orders copies of an id."""
    m = messages.filter(F.col("thread_id").isNotNull() & ~is_notification(F.col("message_type")))
    text = F.when(visible(F.col("text")), F.col("text"))
    echo = F.coalesce(text.rlike(_ECHO), F.lit(False))
    m = m.select(
        "id", "created_at", "thread_id", _plain(F.col("sender_name")).alias("_name"), _plain(F.col("message_type")).alias("_type"), F.unix_micros("timestamp").alias("at_us"),
        echo.alias("_echo"), F.when(echo, F.xxhash64(F.trim(F.regexp_extract(text, _ECHO, 1)))).alias("_quoted"), F.when(text.isNotNull(), F.xxhash64(F.trim(text))).alias("_said"), text.alias("text"),
    )
    said = ["thread_id", "_name", "_type", "at_us", "_echo", "_quoted", "_said"]
    m = m.withColumn("_key", F.coalesce("id", F.concat(F.lit("\0"), F.xxhash64(*said).cast("string"))))  # rows without id are told apart by what they say
    return m, F.struct(F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp")).alias("_a"), "id", *said)


def texts_of(messages: DataFrame) -> DataFrame:
    """``(_key, text)``: the text of each message, of the copy that :func:`speakers` takes."""
    m, first = _rows(messages)
    return m.groupBy("_key").agg(F.min(F.struct(first.alias("m"), "text")).alias("x")).select("_key", "x.text").filter("text is not null")


def speakers(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Every message with visible text, once, with ``role`` ('owner', 'other' or null) and ``sender``; hashes for the text."""
    m, first = _rows(messages)
    m = cut_lineage(m.groupBy("_key").agg(F.min(first).alias("m")).select("_key", "m.*").drop("_a"))
    m = m.withColumn("_typed", F.when(F.col("_type") == "outgoing", "owner").when(F.col("_type") != "", "other"))
    # a name's role in its thread: what most of its typed messages say
    votes = m.filter("_typed is not null and _name <> ''").groupBy("thread_id", "_name").agg(F.count_if(F.col("_typed") == "owner").alias("_o"), F.count(F.lit(1)).alias("_k"))
    votes = votes.select("thread_id", "_name", F.when(F.col("_o") * 2 > F.col("_k"), "owner").otherwise("other").alias("_by_name"))
    seen = m.filter("_said is not null")
    plain, bare = seen.filter("_typed is not null"), seen.filter("_typed is null")
    bare = bare.join(small_table(owner_names(contacts)).withColumn("_own", F.lit("owner")), "_name", "left").join(votes, ["thread_id", "_name"], "left")
    bare = bare.withColumn("role", F.coalesce("_own", "_by_name")).drop("_own", "_by_name")
    out = plain.withColumn("role", F.col("_typed")).unionByName(bare)
    sender = F.when(F.col("role") == "owner", "").otherwise(F.col("_name"))  # the owner has one clock, whatever the spelling
    return out.withColumn("sender", sender).drop("_type", "_typed", "_name")


def clock_bounds(said: DataFrame) -> DataFrame:
    """``(thread_id, _a, _b, bound, n, early)``: the clock of ``_b`` must be set ahead of that of ``_a`` by at least ``bound`` microseconds.

    One row per ordered pair of senders of which one echoes the other, ``n``
    times, ``early`` of them before the message; negative bounds hold as it
    stands.
    """
    timed = said.filter("at_us is not null and role is not null")
    echoes = timed.filter("_quoted is not null").select("thread_id", F.col("sender").alias("_b"), F.col("at_us").alias("_tb"), F.col("_quoted").alias("_h"))
    first = timed.groupBy("thread_id", F.col("_said").alias("_h")).agg(F.min(F.struct("at_us", "sender")).alias("_f"))
    met = echoes.join(first, ["thread_id", "_h"]).select("thread_id", F.col("_f.sender").alias("_a"), "_b", (F.col("_f.at_us") - F.col("_tb")).alias("_v"))
    return met.filter((F.col("_a") != F.col("_b")) & (F.col("_v") <= MAX_SKEW_US)).groupBy("thread_id", "_a", "_b").agg(F.max("_v").alias("bound"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") > 0).alias("early"))


def least_offsets(a: np.ndarray, b: np.ndarray, bound: np.ndarray, n: int) -> np.ndarray | None:
    """Offsets with ``x[b] - x[a] >= bound`` and the least sum of squares, ``x[0]`` being 0.

    None if the bounds contradict each other (a cycle asks for more than
    nothing).  Otherwise the squares are
    minimised by projecting on one bound after the other with memory, and what
    rounding leaves is raised to the bounds.
    """
    def raised(x: np.ndarray) -> np.ndarray | None:
        for _ in range(n + 1):
            y = x.copy()
            np.maximum.at(y, b, x[a] + bound)
            if (y == x).all():
                return x
            x = y
        return None

    if raised(np.zeros(n, np.int64)) is None:
        return None
    x, given = np.zeros(n), np.zeros(len(bound))
    free = np.arange(n) > 0
    for _ in range(2000):
        moved = 0.0
        for e in range(len(bound)):
            i, j = a[e], b[e]
            step = max(-given[e], (bound[e] - x[j] + x[i]) / max(1, int(free[i]) + int(free[j])))
            if step:
                given[e] += step
                x[j] += step * free[j]
                x[i] -= step * free[i]
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    x = raised(np.rint(x).astype(np.int64))
    return x - x[0]


def _solve(edges: pd.DataFrame) -> pd.DataFrame:
    """The offsets of one thread's senders; ``edges`` has a row per ordered pair."""
    names = sorted(set(edges["_a"]) | set(edges["_b"]))  # the owner sorts first, having the empty name
    at = {n: i for i, n in enumerate(names)}
    x = least_offsets(edges["_a"].map(at).to_numpy(), edges["_b"].map(at).to_numpy(), edges["bound"].to_numpy(np.int64), len(names))
    conflicts = int(edges["early"].sum()) if x is None else 0
    return pd.DataFrame({"thread_id": edges["thread_id"].iloc[0], "sender": names, "offset_us": np.zeros(len(names), np.int64) if x is None else x, "conflicts": conflicts, "rejected": conflicts > TOLERATED * edges["n"].sum()})


def clock_offsets(said: DataFrame) -> DataFrame:
    """``(thread_id, sender, offset_us, conflicts, rejected)`` of threads in which an echo stands before its message.

    The groups hold a row per ordered pair of senders, not per message.
    """
    edges = clock_bounds(said)
    broken = edges.filter("bound > 0").select("thread_id").distinct()
    return edges.join(broken, "thread_id", "left_semi").groupBy("thread_id").applyInPandas(_solve, "thread_id string, sender string, offset_us long, conflicts int, rejected boolean")


def verdicts(said: DataFrame, threads: DataFrame, reject_conflicts: bool = False, offsets: DataFrame | None = None) -> DataFrame:
    """``(thread_id, n_messages, conflicts, verdict)`` of every thread of ``threads``; a null verdict keeps it.

    ``conflicts`` counts the echoes that stand before their messages because
    clocks contradict each other; with ``reject_conflicts`` threads with too
    many of them get the verdict 'conflicting'.
    """
    per = said.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("at_us").isNull()).alias("_untimed"),
        F.count_if(F.col("role").isNull()).alias("_roleless"),
        F.count_if(~F.col("_echo") & (F.col("role") == "owner")).alias("_owner"),
        F.count_if(~F.col("_echo") & (F.col("role") == "other")).alias("_other"),
    )
    ids = threads.select(F.col("id").alias("thread_id")).filter("thread_id is not null").distinct()
    v = F.when(F.coalesce("n_messages", F.lit(0)) == 0, "empty").when(F.col("_untimed") > 0, "untimed").when(F.col("_roleless") > 0, "roleless").when((F.col("_owner") == 0) | (F.col("_other") == 0), "unanswered")
    clash = (clock_offsets(said) if offsets is None else offsets).groupBy("thread_id").agg(F.max("conflicts").alias("_conflicts"), F.bool_or("rejected").alias("_rejected"))
    if reject_conflicts:
        v = v.when(F.col("_rejected"), "conflicting")
    out = ids.join(per, "thread_id", "left").join(clash, "thread_id", "left")
    return out.select("thread_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.coalesce("_conflicts", F.lit(0)).alias("conflicts"), v.alias("verdict"))


def merged(said: DataFrame, threads: DataFrame, reject_conflicts: bool = True) -> DataFrame:
    """The messages of the threads that are kept, times corrected, with ``position`` and ``new_turn``; hashes for the text."""
    offsets = cut_lineage(clock_offsets(said))  # a few rows, used twice
    good = verdicts(said, threads, reject_conflicts, offsets).filter("verdict is null").select("thread_id")
    moved = offsets.filter("offset_us <> 0").select("thread_id", "sender", "offset_us")
    timed = said.filter("at_us is not null").join(moved, ["thread_id", "sender"], "left")
    timed = timed.withColumn("at_us", F.col("at_us") + F.coalesce("offset_us", F.lit(0))).drop("offset_us", "_quoted", "_said")
    return in_turn(timed, "thread_id", "at_us", F.struct("role", "sender"), "_echo", "_key", only=good)


def conversations(messages: DataFrame, threads: DataFrame, contacts: DataFrame, reject_conflicts: bool = True) -> DataFrame:
    """Ordered messages of the threads that are kept.

    ``(thread_id, position, id, role, sender, at_us, text, new_turn)``: the time
    is corrected by the sender's clock offset; ``new_turn`` marks where the
    speaker changes.
    """
    turns = merged(speakers(messages, contacts), threads, reject_conflicts)
    return turns.join(texts_of(messages), "_key").select("thread_id", "position", "id", "role", "sender", "at_us", "text", "new_turn")


def dropped_threads(messages: DataFrame, threads: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(thread_id)`` of the threads of which no conversation comes out: broken, empty or unanswered."""
    kept = merged(speakers(messages, contacts), threads, reject_conflicts=False).select("thread_id").distinct()
    return threads.select(F.col("id").alias("thread_id")).filter("thread_id is not null").distinct().join(kept, "thread_id", "left_anti")
