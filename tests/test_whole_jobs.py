"""Queries and operators over more rows than they once took."""

from datetime import datetime

import numpy as np
import pytest

from corpuskiln.functions import vectors
from corpuskiln.operators import chunking
from corpuskiln.plans import corpus_queries, retrieval_queries


def nearest(rows, queries, k):
    """Brute force: ``(query, key, rank)``."""
    x = np.array([v for _, v in rows], dtype=float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for name, v in queries:
        s = x @ (np.array(v, dtype=float) / np.linalg.norm(v))
        out |= {(name, rows[i][0], rank) for rank, i in enumerate(sorted(range(len(rows)), key=lambda i: (-s[i], rows[i][0]))[:k], 1)}
    return out


def test_every_50th_vector_is_searched(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)], i % 5) for i in range(2500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(x.query, x.vec_id, x["rank"]) for x in retrieval_queries.match_multi_query(spark, str(tmp_path)).collect()}
    assert got == nearest([x[:2] for x in rows], [x[:2] for x in rows if x[0] % 50 == 0], 3)
    assert len(got) == 150


def test_any_number_of_queries(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(5000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.select(df.vec_id.alias("query"), df.embedding.alias("q"))
    got = {(x.query, x.vec_id) for x in vectors.top_k(df, q, 1).collect()}
    assert got == {(i, i) for i in range(5000)}


def test_all_mails_break_the_silence(spark, tmp_path):
    d = str(tmp_path)
    rows = [("a", datetime(2020, 1, 5), True, "sent"), ("b", datetime(2020, 2, 1), False, "received"), ("c", datetime(2020, 5, 9), None, None), ("d", datetime(2020, 7, 1), True, "sent"), ("e", None, True, "sent")]
    spark.createDataFrame(rows, "id string, date timestamp, has_attachments boolean, direction string").write.parquet(d + "/email_messages.parquet")
    assert sorted(x.month for x in corpus_queries.silent_months(spark, d).collect()) == ["2020-03", "2020-04", "2020-06"]
    assert [tuple(x) for x in corpus_queries.silence_periods(spark, d).collect()] == [("2020-03", "2020-04", 2)]


def test_years_count_in_any_spelling(spark, tmp_path):
    d = str(tmp_path)
    texts = ["2015-03-02", "March 4, 2016 10:00", "31/12/2017", "2018-06-15", "2021-01-01T00:30:00+02:00", "2023-07-07 08:09:10", "never", None]
    spark.createDataFrame([(str(i), "vault/a.md", t) for i, t in enumerate(texts)], "id string, source_file string, created_at string").write.parquet(d + "/parsed_notes.parquet")
    spark.createDataFrame([("parsed_notes", "vault", "UTC", "DMY")], "tbl string, source_key string, zone_id string, date_order string").write.parquet(d + "/source_zones.parquet")
    # the first instant of 2021 two hours east is still 2020
    assert sorted(x.year for x in corpus_queries.missing_years(spark, d).collect()) == [2019, 2021, 2022]


def test_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(99, -1, -1)], "vec_id long, embedding array<double>").coalesce(1)
    assert [x.vec_id for x in vectors.top_k(df, [("a", [3.0, 2.0, 1.0])], 3).orderBy("rank").collect()] == [0, 1, 2]


def test_vectors_of_another_length_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="isn't as long"):
        vectors.top_k(df, [("a", [3.0, 2.0])], 1).collect()


def test_a_heading_below_a_long_dated_line(spark):
    body = "2024-01-05 " + "a long walk along the river " * 9 + "\n2024-01-06 Market\napples"
    ls = chunking.lines(spark.createDataFrame([("n", body)], "id string, body string"))
    assert [x.header for x in chunking.with_headers(ls).orderBy("line_no").collect()] == [False, True, False]
