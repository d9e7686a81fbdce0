"""Bursts: what a session of a chat or mail thread says, and by whom.

Sessions come from gaps of more than ``gap`` between neighbours.  Text,
senders and attachments of a burst are gathered inside it, which its messages
bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions import ids, text as tx
from corpuskiln.operators.ordering import DAY_US
from corpuskiln.operators.sessions import GAP_US, is_notification, sessions, visible
from corpuskiln.operators.store import once


MAX_OWN = 1000


def burst_bounds(messages: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """``(thread_id, burst_index, start_us, end_us, n_messages)`` of the bursts with text, counted from 0."""
    s = sessions(messages.withColumn("_v", visible(F.col("text"))), "thread_id", F.unix_micros("timestamp"), gap_us, flag=F.col("_v")).filter("flagged")
    w = Window.partitionBy("thread_id").orderBy("start_us")
    return s.select("thread_id", (F.row_number().over(w) - 1).alias("burst_index"), "start_us", "end_us", F.col("n_events").alias("n_messages"))


def sender_of(sender_name: Column, message_type: Column, owner: str) -> Column:
    """Outgoing without a name is the owner, any other without a name is Unknown."""
    blank = F.coalesce(F.trim(sender_name), F.lit("")) == ""
    return F.when(blank & (F.lower(F.trim(message_type)) == "outgoing"), owner).when(blank, "Unknown").otherwise(F.trim(sender_name))


def message_line(sender: Column, text: Column, attachment: Column) -> Column:
    """``sender: text``, ``[attachment.ext]`` for an attachment alone, null for neither."""
    clean = tx.clean_chat_text(text)
    ext = tx.extension(attachment)
    return F.when(visible(text), F.concat_ws(": ", sender, clean)).when(F.coalesce(attachment, F.lit("")) != "", F.concat(F.lit("[attachment"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""), F.lit("]")))


def thread_class(participants: Column, owner: str) -> Column:
    """bilateral with exactly one other participant, else group."""
    return F.when(F.size(F.array_remove(participants, owner)) == 1, "bilateral").otherwise("group")


def chat_bursts(messages: DataFrame, owner: str, gap_us: int = GAP_US) -> DataFrame:
    """Bursts with participants, dominant sender, combined text and attachments.

    Messages find their burst by a range join inside their thread and the days
    that the burst touches: no message meets another.
    """
    m = messages.filter(F.col("thread_id").isNotNull() & F.col("timestamp").isNotNull() & ~is_notification(F.col("message_type")))
    m = once(m, "id", *[F.col(c) for c in ("created_at",) if c in m.columns])
    m = m.withColumn("t", F.unix_micros("timestamp")).withColumn("sender", sender_of(F.col("sender_name"), F.col("message_type"), owner))
    day = 86_400_000_000
    b = burst_bounds(m, gap_us).withColumn("_day", F.explode(F.sequence(F.expr(f"start_us div {day}"), F.expr(f"end_us div {day}"))))
    inside = m.withColumn("_day", F.expr(f"t div {day}")).join(b, ["thread_id", "_day"]).filter(F.col("t").between(F.col("start_us"), F.col("end_us")))
    inside = inside.withColumn("line", message_line(F.col("sender"), F.col("text"), F.col("attachment"))).withColumn("_spoke", visible(F.col("text")))
    votes = inside.filter("_spoke").groupBy("thread_id", "burst_index", "sender").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "id")).alias("first"))
    # the most messages, then who spoke first
    lead = votes.groupBy("thread_id", "burst_index").agg(F.min_by("sender", F.struct(-F.col("n"), F.col("first"))).alias("dominant_sender"))
    joined = inside.groupBy("thread_id", "burst_index", "start_us", "end_us", "n_messages").agg(
        F.array_sort(F.collect_set("sender")).alias("participants"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("t", "id", "line")))), lambda x: x["line"]), "\n\n").alias("text_combined"),
        F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("attachment", F.lit("")) != "", F.struct("t", "id", "attachment")))), lambda x: x["attachment"]).alias("resource_links"),
    )
    out = joined.join(lead, ["thread_id", "burst_index"], "left").withColumn("dominant_sender", F.coalesce("dominant_sender", F.lit("")))
    return out.withColumn("id", ids.short_id(F.concat_ws(":", "thread_id", "burst_index")))


def burst_notes(bursts: DataFrame, threads: DataFrame) -> DataFrame:
    """Bursts in the universal note contract: title, notebook by thread type, tier 3 for two people, metadata as JSON."""
    t = threads.select(F.col("id").alias("thread_id"), "thread_name", "thread_type")
    b = bursts.join(t, "thread_id", "left")
    day = F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd")
    return b.select(
        "id", F.concat_ws(" — ", "thread_name", day).alias("title"), F.col("text_combined").alias("body"),
        F.when(F.col("thread_type") == "bilateral", "iMessage — Bilateral").otherwise("iMessage — Group").alias("notebook"),
        F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.date_format(F.timestamp_micros("end_us"), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
        "resource_links", "participants", "dominant_sender", "thread_id", "thread_type",
        F.when(F.col("thread_type") == "bilateral", 3).otherwise(2).alias("privacy_tier"),
        F.to_json(F.struct("burst_index", F.col("n_messages").alias("message_count"))).alias("metadata"),
    )


# --- mail -----------------------------------------------------------------


def thread_root(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    """The first id of the references, else of the reply header, else the mail's own."""
    first = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(<[^<>\s]+>)", 1), F.lit(""))
    return F.coalesce(first(references), first(in_reply_to), F.trim(message_id))


def owner_addresses(contacts: DataFrame) -> list[str]:
    """The addresses of the contacts that are the owner; refused if they are more than a person has."""
    a = contacts.filter("is_self").select(F.explode("email_addresses").alias("a")).select(F.lower(F.trim("a")).alias("addr")).filter("addr <> ''").distinct().limit(MAX_OWN + 1).collect()
    if len(a) > MAX_OWN:
        raise ValueError(f"more than {MAX_OWN} addresses of the owner")
    return sorted(r["addr"] for r in a)


def direction(from_addr: Column, owner_addresses: list[str]) -> Column:
    """sent where an address of the owner stands in the sender, else received."""
    low = F.lower(F.coalesce(from_addr, F.lit("")))
    hit = F.lit(False)
    for a in owner_addresses:
        hit = hit | low.contains(a.lower())
    return F.when(hit, "sent").otherwise("received")


def mail_bursts(mails: DataFrame, gap_hours: float = 4.0) -> DataFrame:
    """Adds ``burst_index`` to mails of each thread root.

    Undated mails come first: they belong to burst 0; mails without a root
    belong to no burst (null).  The cuts are those of :func:`sessions`, so no
    task sorts a thread; mails find their burst by the days that it touches.
    """
    at = F.unix_micros("date")
    timed = F.col("date").isNotNull() & F.col("thread_root").isNotNull()
    s = sessions(mails.filter(timed).select("thread_root", "date"), "thread_root", at, int(gap_hours * 3_600_000_000))
    s = s.select("thread_root", "start_us", "end_us", (F.row_number().over(Window.partitionBy("thread_root").orderBy("start_us")) - 1).cast("long").alias("burst_index"))
    days = s.withColumn("_day", F.explode(F.sequence(F.expr(f"start_us div {DAY_US}"), F.expr(f"end_us div {DAY_US}"))))
    placed = mails.filter(timed).withColumn("_t", at).withColumn("_day", F.expr(f"_t div {DAY_US}")).join(days, ["thread_root", "_day"]).filter(F.col("_t").between(F.col("start_us"), F.col("end_us")))
    rest = mails.filter(~timed).withColumn("burst_index", F.when(F.col("thread_root").isNotNull(), F.lit(0).cast("long")))
    return placed.select(*mails.columns, "burst_index").unionByName(rest)


def mail_burst_summary(mails: DataFrame, gap_hours: float = 4.0) -> DataFrame:
    """One row per mail burst: subject and date of the first, body of the last, participants, dominant sender, class."""
    b = mail_bursts(mails, gap_hours)
    order = F.struct(F.coalesce(F.unix_micros("date"), F.lit(-(2**62))).alias("t"), F.col("id"))
    votes = b.groupBy("thread_root", "burst_index", "from_addr").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    lead = votes.groupBy("thread_root", "burst_index").agg(F.min_by("from_addr", F.struct(-F.col("n"), F.col("first"))).alias("dominant_sender"))
    g = b.groupBy("thread_root", "burst_index").agg(
        F.min_by("subject", order).alias("subject"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("stripped_body", order).alias("last_body"),
        F.count(F.lit(1)).alias("n_mails"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("all_participants")))).alias("participants"),
    )
    out = g.join(lead, ["thread_root", "burst_index"])
    return out.withColumn("thread_type", F.when(F.size("participants") <= 2, "bilateral").otherwise("group"))


def burst_body(mails: DataFrame) -> DataFrame:
    """``(thread_root, burst_index, body)``: the last mail, before it the earlier ones that it doesn't contain."""
    b = mail_bursts(mails)
    item = F.struct(F.coalesce(F.unix_micros("date"), F.lit(-(2**62))).alias("t"), F.col("id"), F.col("date"), F.coalesce("from_name", F.lit("")).alias("who"), F.trim(F.coalesce("stripped_body", F.lit(""))).alias("body"))
    g = b.groupBy("thread_root", "burst_index").agg(F.array_sort(F.collect_list(item)).alias("items"))
    last = F.element_at("items", -1)["body"]
    earlier = F.filter(F.slice("items", 1, F.greatest(F.size("items") - 1, F.lit(0))), lambda x: (x["body"] != "") & ~last.contains(F.substring(x["body"], 1, 100)))
    shown = F.transform(earlier, lambda x: F.concat(F.lit("["), F.coalesce(F.date_format(x["date"], "yyyy-MM-dd"), F.lit("")), F.lit(" "), F.split(x["who"], " ")[0], F.lit("]: "), x["body"]))
    g = g.filter(F.size("items") > 0)
    return g.select("thread_root", "burst_index", F.when(F.size(earlier) > 0, F.concat(F.array_join(shown, "\n\n"), F.lit("\n\n---\n\n"), last)).otherwise(last).alias("body"))


def with_identities(mails: DataFrame, identities: DataFrame) -> DataFrame:
    """``all_participants`` with every address replaced by whom ``(address, person)`` says it belongs to; others stay as they are.

    The map is a table of any size: participants are joined to it one by one.
    """
    one = mails.select("id", F.explode_outer("all_participants").alias("a")).select("id", F.lower(F.trim("a")).alias("address"))
    known = identities.select(F.lower(F.trim("address")).alias("address"), "person").groupBy("address").agg(F.min("person").alias("person"))
    people = one.join(known, "address", "left").groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("person", "address"))).alias("all_participants"))
    return mails.drop("all_participants").join(people, "id")


def mirror_to_chunks(bursts: DataFrame) -> DataFrame:
    """Bursts as rows of the chunk table, so that both are searched together; the embedding is filled in later."""
    return bursts.select(
        ids.short_id(F.concat(F.lit("burst:"), F.col("id"))).alias("id"), F.lit(None).cast("string").alias("note_id"), F.col("burst_index").alias("chunk_index"), F.col("text_combined").alias("chunk_text"), F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(0).alias("char_start"), F.coalesce(F.length("text_combined"), F.lit(0)).alias("char_end"), F.col("thread_name").alias("section_title"), F.col("date_start").alias("entry_timestamp"), F.col("resource_links").alias("resource_ids"),
        F.lit("imessage").alias("source_type"), F.col("id").alias("source_id"), "privacy_tier",
    )


def mirror_bursts(chunks: DataFrame, bursts: DataFrame) -> DataFrame:
    """``chunks`` with the mirrors of ``bursts``, in place of the ones they had."""
    new = mirror_to_chunks(bursts)
    kept = chunks.join(new.select("source_id").distinct(), "source_id", "left_anti")
    return kept.select(*chunks.columns).unionByName(new.select(*chunks.columns))


def conversations_by_people(mails: DataFrame) -> DataFrame:
    """``(participant_hash, participants, n_messages, first_at, last_at)``: mails by their exact set of people."""
    p = ids.participant_set(F.col("all_participants"))
    return mails.filter("all_participants is not null").groupBy(ids.participant_hash(F.col("all_participants")).alias("participant_hash")).agg(F.first(p).alias("participants"), F.count(F.lit(1)).alias("n_messages"), F.min("date").alias("first_at"), F.max("date").alias("last_at"))
