"""Documents packed into containers of fixed capacity.

Method: first-fit decreasing with a tournament tree of the containers' free
space, run independently in randomised groups of documents.  The tree finds
the first container with enough room in logarithmic time.  A document that
exceeds the capacity is cut into full containers and a rest; no other one is
split.

Shape at scale: only ``(doc_id, tokens)`` is shuffled.  Groups hold about
``GROUP_ITEMS`` items each, whatever the input: tokens are counted and
checkpointed first, so that the number of groups of each kind follows its
pieces, and rows are dealt to groups by hash, copies of a document too, so no
group is hot.  The last, emptier containers of a group are the only loss: of
thousands.  Which group a row gets depends on its place among the others.

Nulls and empty texts have no tokens and fill no container; they aren't
listed.  Ties are ordered by document.  Without a usable capacity (null, zero
or below) a kind of container gets no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.tokens import TOKENIZER, with_tokens
from corpuskiln.session import cut_lineage

GROUP_ITEMS = 20_000
MAX_KINDS = 2_000


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container (from 0) of each size, in the order given, by first fit over a tournament tree."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = []
    for s in sizes:
        i = 1
        while i < leaves:
            i *= 2
            if tree[i] < s:
                i += 1
        out.append(i - leaves)
        tree[i] -= s
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            a = a if a > b else b
            if tree[i] == a:
                break
            tree[i] = a
            i //= 2
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    pdf["container_no"] = np.asarray(first_fit(pdf["tokens"].tolist(), capacity), dtype="int64")
    return pdf[["container_kind", "capacity", "grp", "container_no", "doc_id", "piece", "tokens"]]


def containers(documents: DataFrame, sizes: DataFrame, tokenizer: str = TOKENIZER, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``(container_kind, capacity, grp, container_no, doc_id, piece, tokens)``.

    A container is named by kind, group and number; ``piece`` counts the parts
    of a document that exceeds the capacity, from 0.
    """
    docs = documents.select("doc_id", "text").filter("text is not null and text <> ''").withColumn("_row", F.monotonically_increasing_id())
    items = cut_lineage(with_tokens(docs, "text", tokenizer).filter("tokens > 0").select("doc_id", "_row", "tokens"))
    kinds = sizes.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).filter("container_kind is not null and capacity > 0").groupBy("container_kind").agg(F.min("capacity").alias("capacity"))
    known = kinds.limit(MAX_KINDS + 1).collect()
    if len(known) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers: pack them in turns")
    # a row of counts: the pieces of each kind, whose groups are sized by them
    pieces = items.agg(*[F.sum(F.expr(f"(tokens - 1) div {int(k['capacity'])} + 1")).alias(f"k{i}") for i, k in enumerate(known)]).first() if known else []
    sized = [F.struct(F.lit(k["container_kind"]).alias("container_kind"), F.lit(int(k["capacity"])).cast("long").alias("capacity"), F.lit(max(1, math.ceil((n or 0) / group_items))).alias("groups")) for k, n in zip(known, pieces)]
    each = items.withColumn("_k", F.explode(F.array(*sized) if sized else F.array().cast("array<struct<container_kind:string,capacity:bigint,groups:int>>"))).select("doc_id", "_row", "tokens", "_k.*")
    parts = F.expr("sequence(0L, (tokens - 1) div capacity)")
    cut = each.withColumn("piece", F.explode(parts)).withColumn("tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity"))).withColumn("piece", F.col("piece").cast("int"))
    # the place of a row among others keeps copies of one document apart; pieces of a long one are dealt apart too
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "_row", "piece"), F.col("groups")).cast("int")).drop("_row", "groups")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("container_kind", "grp").applyInPandas(_pack, f"container_kind string, capacity long, grp int, container_no long, doc_id {kind}, piece int, tokens long")


def fill(packed: DataFrame) -> DataFrame:
    """Per kind of container: how many there are, their tokens and the share of their space that is used."""
    one = packed.groupBy("container_kind", "capacity", "grp", "container_no").agg(F.sum("tokens").alias("t"))
    return one.groupBy("container_kind", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.round(F.sum("t") / (F.count(F.lit(1)) * F.col("capacity")), 6).alias("used"))
