"""Queries of the mail header index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import text as tx
from corpuskiln.operators.delivery import folder_key
from corpuskiln.operators.ordering import with_previous

#: Small invented defaults; pass your own.
COMMERCIAL_PREFIXES = ["noreply", "no-reply", "newsletter", "offers", "info", "support", "alerts", "marketing"]
COMMERCIAL_DOMAINS = ["shop.example", "deals.example", "news.example"]
BULK_FOLDERS = ["server/cron", "lists/rowing", "lists/allotment"]


def is_commercial(addr: Column, prefixes: list[str] | None = None, domains: list[str] | None = None) -> Column:
    """A missing address, a local part that begins like a sender of bulk mail, or a domain (or one above it) of the list."""
    a = F.lower(F.trim(addr))
    local, domain = F.substring_index(a, "@", 1), F.substring_index(a, "@", -1)
    hit = F.lit(False)
    for p in COMMERCIAL_PREFIXES if prefixes is None else prefixes:
        hit = hit | local.startswith(p)
    labels = F.split(domain, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = F.arrays_overlap(above, F.array(*[F.lit(d) for d in (COMMERCIAL_DOMAINS if domains is None else domains)]))
    return F.coalesce(hit | listed, F.lit(True))


def human_senders(headers: DataFrame, least: int = 2) -> DataFrame:
    """Senders outside bulk folders that aren't commercial: mails, first and last id, latest display name that isn't empty."""
    h = headers.filter(F.coalesce(~folder_key(F.col("folder")).isin(BULK_FOLDERS), F.lit(True)) & ~is_commercial(F.col("from_addr")))
    named = F.when(F.coalesce(F.trim("from_display"), F.lit("")) != "", F.col("id"))
    g = h.groupBy(F.lower(F.trim("from_addr")).alias("sender")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message_id").alias("n_messages"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max_by(F.trim("from_display"), named).alias("display"))
    return g.filter(F.col("n") >= least)


def search(headers: DataFrame, query: str) -> DataFrame:
    """Headers that contain the query in sender, name, recipients, copies or subject, whatever the letter case."""
    q = query.lower()
    hit = F.lit(False)
    for c in ("from_addr", "from_display", "to_addrs", "cc_addrs", "subject"):
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return headers.filter(hit)


def by_folder(headers: DataFrame) -> DataFrame:
    return headers.groupBy(folder_key(F.col("folder")).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message_id").alias("n_messages"), F.count_if(F.col("downloaded") == 1).alias("downloaded"))


def contact_mails(headers: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(contact_id, folder, uid, direction)``: mails with a contact, received before sent where both hold.

    Addresses are taken out of the headers and joined by equality, so no header
    meets every contact.
    """
    c = contacts.filter(~F.coalesce("is_self", F.lit(False))).select(F.col("id").alias("contact_id"), F.explode("email_addresses").alias("a")).select("contact_id", F.lower(F.trim("a")).alias("addr")).distinct()
    h = headers.select(folder_key(F.col("folder")).alias("folder"), "uid", "from_addr", "to_addrs", "cc_addrs").filter("folder is not null and uid is not null")
    got = h.select("folder", "uid", F.explode(tx.addresses(F.col("from_addr"))).alias("addr"), F.lit(0).alias("d"))
    sent = h.select("folder", "uid", F.explode(tx.addresses(F.concat_ws(", ", "to_addrs", "cc_addrs"))).alias("addr"), F.lit(1).alias("d"))
    hit = got.unionByName(sent).join(c, "addr").groupBy("contact_id", "folder", "uid").agg(F.min("d").alias("d"))
    return hit.select("contact_id", "folder", "uid", F.when(F.col("d") == 0, "received").otherwise("sent").alias("direction"))


def pending(headers: DataFrame) -> DataFrame:
    """Headers whose mail isn't downloaded: those of all rows less those of a downloaded one."""
    k = headers.select(folder_key(F.col("folder")).alias("folder"), "uid", "downloaded").filter("folder is not null and uid is not null")
    return k.select("folder", "uid").distinct().join(k.filter("downloaded = 1").select("folder", "uid").distinct(), ["folder", "uid"], "left_anti")


def reply_gaps(mails: DataFrame) -> DataFrame:
    """``(thread_root, id, gap_hours)`` between neighbouring dated mails of a thread, none negative."""
    m = mails.filter("date is not null and thread_root is not null").select("thread_root", "id", F.unix_micros("date").alias("_us"))
    m = with_previous(m, "thread_root", "_us", F.col("_us"), "_before", "id")
    return m.select("thread_root", "id", ((F.col("_us") - F.col("_before")) / 3.6e9).alias("gap_hours")).filter("gap_hours >= 0")


def quote_habits(mails: DataFrame) -> DataFrame:
    """How many bodies show each quoting habit, with whole percents, rounded down."""
    flags = tx.quote_flags(F.col("raw_body"))
    g = mails.filter("raw_body is not null").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    return g.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("habit"), F.col(k).alias("n")) for k in flags])).alias("x")).select("x.habit", "x.n", F.expr("(x.n * 100) div total").alias("percent"))


def new_content(mails: DataFrame) -> DataFrame:
    """Over all bodies: lines and characters, how many are quoted and new, and the whole percent that is new."""
    x = mails.filter("raw_body is not null and raw_body <> ''").select(tx.new_lines(F.col("raw_body")).alias("x")).select("x.*")
    g = x.agg(F.count(F.lit(1)).alias("bodies"), *[F.sum(c).alias(c) for c in ("total_lines", "quoted_lines", "new_lines", "new_chars", "total_chars")])
    return g.withColumn("new_percent", F.expr("(new_chars * 100) div total_chars"))


def attachment_types(mails: DataFrame) -> DataFrame:
    """Attachments by content type: how many, in how many mails, and their bytes."""
    a = mails.select("id", F.explode("attachments").alias("a"))
    return a.groupBy(F.lower("a.content_type").alias("content_type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_mails"), F.sum("a.size").alias("bytes"))
