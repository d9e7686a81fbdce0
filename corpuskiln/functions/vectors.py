"""Vectors: cosine similarity, exact top-k for batches of queries, deterministic embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries, and rows, that are scored by one matrix product; more are matched block by block.
MAX_QUERIES = 1_024
MAX_ROWS = 4_096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def top_k(vectors: DataFrame, queries: DataFrame | list[tuple[object, list[float]]], k: int, key: str = "vec_id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """``(query, key, similarity, rank)``: for each query vector the ``k`` nearest rows.

    Queries are a list, or a frame of any size with the columns ``query`` and
    ``q``; a frame never comes to the driver.  Queries are gathered to blocks
    of about ``MAX_QUERIES``, rows to blocks of ``MAX_ROWS``, and each block
    meets each other block once, in one matrix product that keeps its best
    ``k`` a query.  Ties go to the smaller key.
    """
    spark = vectors.sparkSession
    if not isinstance(queries, DataFrame):
        if not queries:
            raise ValueError("no queries")
        queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], ["query", "q"])
    asked = queries.select("query", "q").filter("q is not null")
    n = max(1, -(-asked.count() // MAX_QUERIES))
    # all the queries of a block are one row, so the join below sees few of them
    blocks = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("query", "q")).alias("qs"))
    blocks = blocks.select(F.col("qs.query").alias("ids"), F.col("qs.q").alias("qs"))
    kind, asked_kind = vectors.schema[key].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    v_kind = vectors.schema[vector].dataType.simpleString()

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), MAX_ROWS):
                one = pdf.iloc[at : at + MAX_ROWS]
                yield pd.DataFrame({"keys": [one["key"].to_list()], "vs": [one["v"].to_list()]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, vs, ids, qs in zip(pdf["keys"], pdf["vs"], pdf["ids"], pdf["qs"]):
                m = _unit(pd.Series(list(qs)))
                if any(len(v) != m.shape[1] for v in vs):
                    raise ValueError(f"a vector isn't as long as its queries, {m.shape[1]}")
                # in the order of keys, a stable sort leaves ties to the smaller key
                order = np.argsort(keys, kind="stable")
                keys = np.asarray(keys)[order]
                s = (_unit(pd.Series(list(vs))) @ m.T)[order]
                top = np.argsort(-s, axis=0, kind="stable")[: min(len(keys), k)]
                one = pd.DataFrame({"query": np.repeat(np.asarray(ids), top.shape[0]), "key": keys[top.T.ravel()], "similarity": np.take_along_axis(s, top, 0).T.ravel()})
                yield one.sort_values(["query", "similarity", "key"], ascending=[True, False, True]).groupby("query").head(k)

    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter("v is not null").mapInPandas(gather, f"keys array<{kind}>, vs array<{v_kind}>")
    part = rows.crossJoin(blocks).mapInPandas(score, f"query {asked_kind}, key {kind}, similarity double")
    if floor is not None:
        part = part.filter(F.col("similarity") >= floor)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    out = part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("query", F.col("key").alias(key), "similarity", "rank")


def deterministic_embedding(text: Column, dims: int = 1536) -> Column:
    """A reproducible stand-in for a model: bytes folded into ``dims`` sums, then normalised; zeros for an empty text."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            b = np.frombuffer((t or "").encode("utf-8"), np.uint8).astype(np.float64)
            v = np.bincount(np.arange(len(b)) % dims, weights=(b % 97) / 97.0, minlength=dims) if len(b) else np.zeros(dims)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return embed(text)
