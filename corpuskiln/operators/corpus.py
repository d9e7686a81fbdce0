"""Corpus statistics: volume and silence, senders, words, exchanges, themes, register, time, mentions.

Each function is one to three aggregations that return long-form rows.  They
take messages as ``(id, thread_id, sender, at, text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions import text as tx
from corpuskiln.operators.ordering import in_order, with_previous

#: Small invented defaults; pass your own.
PUSHBACK = ["no idea", "not sure", "wait, ", "ugh", "actually", "disagree", "but "]
REGISTERS = {"warmth": ["thanks", "love", "happy", "please"], "humour": ["haha", "lol"], "friction": ["ugh", "sorry", "broke"], "doubt": ["not sure", "no idea", "maybe"]}
SELF_PHRASES = ["i think", "i feel", "i forgot", "i should", "not sure", "running"]


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase occurs in the lower-cased text, inside words too."""
    low = F.lower(text)
    hit = F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p)
    return F.coalesce(hit, F.lit(False))


def content(messages: DataFrame) -> DataFrame:
    return messages.filter(tx.is_content(F.col("text")))


def volume(messages: DataFrame, unit: str = "month") -> DataFrame:
    fmt = {"month": "yyyy-MM", "year": "yyyy", "day": "yyyy-MM-dd"}[unit]
    return messages.filter("at is not null").groupBy(F.date_format("at", fmt).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def _active(messages: DataFrame) -> DataFrame:
    return messages.filter("at is not null").select(F.trunc(F.col("at").cast("date"), "month").alias("month")).distinct()


def silent_months(messages: DataFrame) -> DataFrame:
    """Months without a message between the first and the last."""
    active = _active(messages)
    span = active.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(active, "month", "left_anti")


def silences(messages: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` silent months.  The window sees months, of which any span has few."""
    m = silent_months(messages).withColumn("_i", F.year("month") * 12 + F.month("month"))
    w = Window.partitionBy(F.lit(1)).orderBy("_i")
    runs = m.withColumn("_k", F.col("_i") - F.row_number().over(w))
    return runs.groupBy("_k").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("months")).filter(F.col("months") >= least).drop("_k")


def missing_years(messages: DataFrame) -> DataFrame:
    years = messages.filter("at is not null").select(F.year("at").alias("year")).distinct()
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("year")).join(years, "year", "left_anti")


def peak(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The key with the most, the smallest key among equals; and the one with the fewest."""
    return counts.agg(F.min_by(key, F.struct(-F.col(n), F.col(key))).alias("peak"), F.max(n).alias("peak_n"), F.min_by(key, F.struct(F.col(n), F.col(key))).alias("quietest"), F.min(n).alias("quietest_n"))


def sender_shares(messages: DataFrame, bursts: DataFrame) -> DataFrame:
    """Per sender: messages, share of all, bursts that it dominates, their share, and the guarded response proxy."""
    v = messages.groupBy("sender").agg(F.count(F.lit(1)).alias("n_messages"))
    b = bursts.filter("dominant_sender <> ''").groupBy(F.col("dominant_sender").alias("sender")).agg(F.count(F.lit(1)).alias("n_bursts"))
    totals = v.agg(F.sum("n_messages").alias("all_messages")).crossJoin(bursts.agg(F.count(F.lit(1)).alias("all_bursts")))
    out = v.join(b, "sender", "left").crossJoin(F.broadcast(totals))
    n_b = F.coalesce("n_bursts", F.lit(0))
    others = F.col("all_messages") - F.col("n_messages")
    return out.select("sender", "n_messages", n_b.alias("n_bursts"), F.round(F.col("n_messages") * 100.0 / F.col("all_messages"), 1).alias("volume_pct"), F.round(F.try_divide(n_b * 100.0, F.col("all_bursts")), 1).alias("starter_pct"), F.when(others > 0, F.round(F.col("n_messages") / others, 3)).alias("response_proxy"))


def burst_depth(bursts: DataFrame) -> DataFrame:
    """Mean number of lines that aren't blank in the bursts of each dominant sender."""
    lines = F.size(F.filter(F.split("text_combined", "\n"), lambda x: F.trim(x) != ""))
    return bursts.filter("dominant_sender <> '' and text_combined is not null").groupBy(F.col("dominant_sender").alias("sender")).agg(F.round(F.avg(lines), 2).alias("depth"), F.count(F.lit(1)).alias("n_bursts"))


def length_profile(messages: DataFrame) -> DataFrame:
    """Per sender: mean and upper median of words, share of up to three words, share with a link.

    The upper median comes from counts per length, not from gathered lists.
    """
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))
    m = content(messages).withColumn("_n", n)
    per = m.groupBy("sender", "_n").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("text").contains("http")).alias("links"))
    w = Window.partitionBy("sender").orderBy("_n")
    per = per.withColumn("_upto", F.sum("k").over(w)).withColumn("_all", F.sum("k").over(Window.partitionBy("sender")))
    middle = F.min(F.when(F.col("_upto") > F.expr("_all div 2"), F.col("_n")))
    return per.groupBy("sender").agg(
        F.sum("k").alias("n_messages"), F.round(F.sum(F.col("k") * F.col("_n")) / F.sum("k"), 3).alias("mean_words"), middle.alias("median_words"),
        F.round(F.sum(F.when(F.col("_n") <= 3, F.col("k")).otherwise(0)) / F.sum("k"), 3).alias("short_rate"), F.round(F.sum("links") / F.sum("k"), 3).alias("link_rate"),
    )


def word_counts(messages: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``(sender, word, n)``, the one table that word statistics start from."""
    return content(messages).select("sender", F.explode(tx.tokens(F.col("text"), stop_words)).alias("word")).groupBy("sender", "word").agg(F.count(F.lit(1)).alias("n"))


def fingerprint(counts: DataFrame, pool: int = 1000, least: int = 3, lift: float = 2.0, top: int = 20) -> DataFrame:
    """Words that a sender uses more than the corpus: ``(sender, word, n, lift)``.

    Of the sender's ``pool`` most frequent words those used ``least`` times
    with a lift of ``lift``, the ``top`` of them.  Equal counts go by word.
    """
    by_word = counts.groupBy("word").agg(F.sum("n").alias("c_word"))
    by_sender = counts.groupBy("sender").agg(F.sum("n").alias("c_sender"))
    total = counts.agg(F.sum("n").alias("c_all"))
    first = counts.withColumn("_r", F.row_number().over(Window.partitionBy("sender").orderBy(F.desc("n"), "word"))).filter(F.col("_r") <= pool).filter(F.col("n") >= least)
    x = first.join(by_word, "word").join(by_sender, "sender").crossJoin(F.broadcast(total))
    x = x.withColumn("lift", F.round((F.col("n") / F.col("c_sender")) / (F.col("c_word") / F.col("c_all")), 2)).filter(F.col("lift") >= lift)
    return x.withColumn("_r", F.row_number().over(Window.partitionBy("sender").orderBy(F.desc("lift"), F.desc("n"), "word"))).filter(F.col("_r") <= top).select("sender", "word", "n", "lift")


def exchanges(messages: DataFrame, pushback: list[str] | None = None) -> DataFrame:
    """Neighbouring messages of two senders inside each thread: ``(person_a, person_b, n, pushback)``.

    Neighbours are taken per thread and found day by day, so that no task
    sorts a whole thread.
    """
    m = content(messages).filter("at is not null and thread_id is not null").withColumn("_us", F.unix_micros("at"))
    m = with_previous(m, "thread_id", "_us", F.col("sender"), "_before", "id").filter(F.col("_before").isNotNull() & (F.col("_before") != F.col("sender")))
    push = any_of(F.col("text"), PUSHBACK if pushback is None else pushback)
    return m.groupBy(F.least("sender", "_before").alias("person_a"), F.greatest("sender", "_before").alias("person_b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(push).alias("pushback"))


def exchange_samples(messages: DataFrame) -> DataFrame:
    """The first, the middle and the last exchange of each pair: ``(person_a, person_b, place, id)``.

    Exchanges are numbered day by day, so that no
    task sorts all exchanges of a pair.
    """
    m = content(messages).filter("at is not null and thread_id is not null").withColumn("_us", F.unix_micros("at"))
    m = with_previous(m, "thread_id", "_us", F.col("sender"), "_before", "id").filter(F.col("_before").isNotNull() & (F.col("_before") != F.col("sender")))
    m = m.select(F.least("sender", "_before").alias("person_a"), F.greatest("sender", "_before").alias("person_b"), "_us", "id")
    m = m.withColumn("_pair", F.to_json(F.array("person_a", "person_b")))
    sizes = m.groupBy("_pair").agg(F.count(F.lit(1)).alias("_n"))
    placed = in_order(m, "_pair", "_us", "id").join(sizes, "_pair")
    return placed.filter((F.col("position") == 1) | (F.col("position") == F.expr("_n div 2") + 1) | (F.col("position") == F.col("_n"))).select("person_a", "person_b", F.col("position").alias("place"), "id")


def top_words(messages: DataFrame, n: int = 30) -> DataFrame:
    return word_counts(messages).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def top_bigrams(messages: DataFrame, n: int = 20, least: int = 3) -> DataFrame:
    """The ``n`` most frequent bigrams, of them those seen ``least`` times."""
    b = content(messages).select(F.explode(tx.bigrams(tx.tokens(F.col("text")))).alias("bigram"))
    return b.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bigram").limit(n).filter(F.col("n") >= least)


def link_domains(texts: DataFrame, n: int = 15) -> DataFrame:
    """Domains of the first two links of each text, without ``www.``."""
    urls = F.slice(F.regexp_extract_all("text", F.lit(r"https?://\S+"), 0), 1, 2)
    d = texts.filter("text is not null").select(F.explode(urls).alias("u")).select(F.lower(F.regexp_extract("u", r"^https?://(?:www\.)?([^/:?#\s>)]+)", 1)).alias("domain"))
    return d.filter("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(n)


def register(messages: DataFrame, lexicons: dict[str, list[str]] | None = None) -> DataFrame:
    """Per sender and register: messages with a phrase of it, and their rate."""
    lex = REGISTERS if lexicons is None else lexicons
    m = content(messages)
    g = m.groupBy("sender").agg(F.count(F.lit(1)).alias("n_messages"), *[F.count_if(any_of(F.col("text"), p)).alias(k) for k, p in lex.items()])
    long = g.select("sender", "n_messages", F.explode(F.array(*[F.struct(F.lit(k).alias("register"), F.col(k).alias("n")) for k in lex])).alias("r"))
    return long.select("sender", "r.register", "r.n", F.round(F.col("r.n") / F.col("n_messages"), 3).alias("rate"))


def hours(messages: DataFrame, shift_hours: int = 0) -> DataFrame:
    """Messages by hour of day (shifted), all 24 listed, with the part of the day."""
    h = messages.filter("at is not null").groupBy(F.pmod(F.hour("at") + shift_hours, F.lit(24)).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    every = messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    part = F.when(F.col("hour").between(6, 11), "morning").when(F.col("hour").between(12, 17), "afternoon").when(F.col("hour") >= 18, "evening").otherwise("night")
    return every.join(h, "hour", "left").select("hour", part.alias("part"), F.coalesce("n", F.lit(0)).alias("n"))


def weekdays(messages: DataFrame) -> DataFrame:
    """Messages by weekday, 1 Sunday to 7 Saturday, all listed."""
    d = messages.filter("at is not null").groupBy(F.dayofweek("at").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    every = messages.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
    return every.join(d, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))


def mentions(messages: DataFrame, names: DataFrame) -> DataFrame:
    """How often each speaker writes each name: ``(sender, name, n)``.

    Words are joined to the names, so the work is that of the words, not of
    speakers times names.
    """
    w = messages.filter("text is not null").select("sender", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), 0)).alias("w"))
    per = w.groupBy("sender", F.lower("w").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return per.join(names.select(F.lower("name").alias("name")).distinct(), "name").select("sender", "name", "n")


def self_references(messages: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """Messages by the first phrase of the list that they contain."""
    ps = SELF_PHRASES if phrases is None else phrases
    first = F.coalesce(*[F.when(F.lower("text").contains(p), F.lit(p)) for p in ps])
    return content(messages).withColumn("phrase", first).filter("phrase is not null").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """``(bucket, n)`` of half-open buckets: bucket i holds values from edge i-1 to below edge i."""
    b = F.lit(0)
    for e in edges:
        b = b + (value >= e).cast("int")
    return df.filter(value.isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
