"""Mailboxes in MBOX format."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import ids
from corpuskiln.functions import text as tx
from corpuskiln.operators.bursts import direction, thread_root

_SCHEMA = "raw string, message_id string, subject string, from_hdr string, to_hdr string, cc_hdr string, date_hdr string, in_reply_to string, references_hdr string, plain string, html string, attachments array<struct<filename:string,content_type:string,size:bigint>>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """MIME parts by the standard library: headers decoded, the first plain and HTML text, attachments named."""
    from email import message_from_string, policy

    for pdf in batches:
        rows = []
        for raw in pdf["raw"]:
            m = message_from_string(raw, policy=policy.default)
            plain = html = None
            files = []
            for p in m.walk():
                if p.is_multipart():
                    continue
                name = p.get_filename()
                if name or p.get_content_disposition() == "attachment":
                    files.append({"filename": name or "", "content_type": p.get_content_type(), "size": len(p.get_payload(decode=True) or b"")})
                elif p.get_content_type() in ("text/plain", "text/html"):
                    try:
                        text = p.get_content()
                    except (LookupError, UnicodeDecodeError):
                        text = (p.get_payload(decode=True) or b"").decode("utf-8", "replace")
                    if p.get_content_type() == "text/plain" and plain is None:
                        plain = text
                    elif p.get_content_type() == "text/html" and html is None:
                        html = text
            g = lambda k: None if m[k] is None else str(m[k])  # noqa: B023, E731
            rows.append((raw, g("Message-ID"), g("Subject"), g("From"), g("To"), g("Cc"), g("Date"), g("In-Reply-To"), g("References"), plain, html, files))
        yield pd.DataFrame(rows, columns=["raw", "message_id", "subject", "from_hdr", "to_hdr", "cc_hdr", "date_hdr", "in_reply_to", "references_hdr", "plain", "html", "attachments"])


def read_mbox(spark: SparkSession, path: str, owner_addresses: list[str]) -> DataFrame:
    """Mails of MBOX files; those with an empty body are left out, a missing id is made from the content.

    Files are cut at ``From `` lines by the reader, so a large mailbox is read
    by many tasks.
    """
    lines = spark.read.option("lineSep", "\nFrom ").text(path).select(F.regexp_replace("value", r"^(?:From )?[^\n]*\n", "").alias("raw")).filter("trim(raw) <> ''")
    m = lines.mapInPandas(_parse, _SCHEMA)
    body = F.when(F.col("plain").rlike(r"\S"), F.col("plain")).otherwise(tx.strip_html(F.col("html")))
    from corpuskiln.operators import instants as I

    m = m.withColumn("raw_body", body).filter(F.col("raw_body").rlike(r"\S"))
    m = I.read_texts(m, "date_hdr").withColumn("date", F.timestamp_micros(I.instant(F.lit("UTC"), F.lit("DMY"))))
    mid = F.coalesce(F.nullif(F.trim("message_id"), F.lit("")), F.concat(F.lit("<"), ids.short_id(F.col("raw")), F.lit("@local>")))
    people = ids.participant_set(F.concat(tx.addresses(F.col("from_hdr")), tx.addresses(F.col("to_hdr")), tx.addresses(F.col("cc_hdr"))))
    sender = F.try_element_at(tx.addresses(F.col("from_hdr")), F.lit(1))
    return m.select(
        mid.alias("message_id"), "subject", sender.alias("from_addr"), tx.display_name(F.col("from_hdr")).alias("from_name"), tx.addresses(F.col("to_hdr")).alias("to_addrs"), tx.addresses(F.col("cc_hdr")).alias("cc_addrs"), people.alias("all_participants"),
        "date", "raw_body", tx.strip_quoted(F.col("raw_body")).alias("stripped_body"), thread_root(F.col("references_hdr"), F.col("in_reply_to"), mid).alias("thread_root"), "in_reply_to", direction(sender, owner_addresses).alias("direction"), (F.size("attachments") > 0).alias("has_attachments"), "attachments",
    )


def mime_summary(mails: DataFrame) -> DataFrame:
    """Mails in all, with attachments, and attachments by type."""
    a = mails.select(F.explode_outer("attachments.content_type").alias("content_type"))
    return a.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))
