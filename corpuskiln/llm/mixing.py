"""A mixture of sources with target shares of the total size.

Method: subset-sum budget fitting.  Documents are counted by source and exact
token length.  Each source's budget is its share of the total.  It is filled
by whole passes, then by the same part of every length, then from long to
short; the last ``FINE`` tokens are fitted by a bounded-knapsack dynamic
program over the lengths that are left.  Seeded documents are then selected by
the number asked of each length.

The total is the largest for which every source can give its share with at
most ``max_repeats`` uses of a text (or a smaller one that is asked for), so
small sources bound the mixture rather than distort it.  Exact copies of a
text, in any source, are one text: it belongs to the source of its smallest
document id.

Shape at scale: texts are hashed and counted where they are read; hashes,
lengths and counts are all that is shuffled.  The program sees one row per
length of a source, bounded by the longest text.  Selection ranks inside
buckets of a hash, so no length of a source is sorted in one task.

Nulls: documents without text, tokens or a source that the targets name are
left out.  A source without documents is reported with nothing reached and
doesn't bound the total.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.llm.tokens import TOKENIZER, with_tokens
from corpuskiln.session import cut_lineage

FINE = 1 << 14
BUCKETS = 256
SEED = 17


def source_key(c: Column) -> Column:
    """Source spelling: letter case and outer blanks don't count."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take for the largest sum that isn't above ``budget``."""
    best = np.full(budget + 1, -1, np.int32)  # the item that first reached a sum
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for n, have in zip(lengths, counts):
        k = 1
        have = min(have, budget // n) if n else 0
        while have > 0 and not reach[budget]:
            m = min(k, have)
            w = n * m
            new = np.zeros(budget + 1, bool)
            new[w:] = reach[:-w] & ~reach[w:]
            best[new] = len(items)
            items.append((n, m))
            reach |= new
            have -= m
            k *= 2
    at = int(np.flatnonzero(reach)[-1])
    take: dict[int, int] = {}
    while at:
        n, m = items[best[at]]
        take[n] = take.get(n, 0) + m
        at -= n * m
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int) -> tuple[int, np.ndarray]:
    """``(whole passes, how many of each length once more)`` for a source's budget."""
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    passes = min(max_repeats, budget // total)
    left = budget - passes * total
    take = np.zeros(len(lengths), np.int64)
    if passes >= max_repeats or left <= 0:
        return int(passes), take
    if left > FINE:
        take = (counts * ((left - FINE) / total)).astype(np.int64)
        left -= int((take * lengths).sum())
        for i in np.argsort(-lengths, kind="stable"):
            more = int(min(counts[i] - take[i], max(0, left - FINE) // lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    ok = np.flatnonzero((lengths <= left) & (counts > take))
    for n, m in knapsack([int(lengths[i]) for i in ok[::-1]], [int(counts[i] - take[i]) for i in ok[::-1]], min(left, 4 * FINE)).items():
        take[np.flatnonzero(lengths == n)[0]] += m
    return int(passes), take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("tokens")
    passes, take = fit_budget(pdf["tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0]))
    return pd.DataFrame({"source": pdf["source"].to_numpy(), "tokens": pdf["tokens"].to_numpy(), "passes": passes, "take": take})


def sized_texts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens)``, one row per different text."""
    d = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter("text is not null and text <> ''").withColumn("h", F.md5("text"))
    sized = with_tokens(d, "text", tokenizer).filter("tokens > 0")
    one = sized.groupBy("h").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x"))
    return one.select("x.*")


def targets_of(mix_targets: DataFrame) -> DataFrame:
    return mix_targets.select(source_key(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats")).filter("source is not null and target_share > 0").dropDuplicates(["source"])


def mixture(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens, times)``: the texts of the mixture and how often each is used."""
    sized = cut_lineage(sized_texts(documents, tokenizer))  # used twice: tokens are counted once
    targets = targets_of(mix_targets)
    lengths = sized.join(targets, "source").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"), F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    have = lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("have"), F.first("target_share").alias("share"), F.first("max_repeats").alias("repeats"))
    reach = have.agg(F.floor(F.min(F.col("have") * F.col("repeats") / F.col("share"))).alias("total"))
    if total is not None:
        reach = reach.select(F.least("total", F.lit(total)).alias("total"))
    budgets = lengths.crossJoin(F.broadcast(reach)).withColumn("budget", F.round(F.col("total") * F.col("target_share")).cast("long"))
    plan = budgets.groupBy("source").applyInPandas(_plan, "source string, tokens long, passes int, take long")
    # the first `take` of a length in the order of a seeded hash, ranked bucket by bucket
    h = F.xxhash64("doc_id", F.lit(SEED))
    docs = sized.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    sizes = docs.groupBy("source", "tokens", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source", "tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    planned = sizes.withColumn("_before", before).drop("_n").join(plan, ["source", "tokens"])
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "_b").orderBy("_h", "doc_id"))
    out = docs.join(planned, ["source", "tokens", "_b"]).withColumn("times", F.col("passes") + (F.col("_before") + rank <= F.col("take")).cast("int"))
    return out.filter("times > 0").select("doc_id", "source", "tokens", "times")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per source: target and reached share, texts, tokens and the most uses of a text."""
    per = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_uses"))
    total = per.agg(F.sum("tokens").alias("total"))
    out = targets_of(mix_targets).join(per, "source", "left").crossJoin(F.broadcast(total))
    return out.select("source", "target_share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("reached_share"))
