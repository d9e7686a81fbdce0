import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import dates, ids, vectors
from corpuskiln.functions import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).collect()[0].r


@pytest.mark.parametrize(
    ("text", "year", "want"),
    [("20150621", None, "2015-06-21"), ("1/3/19", None, "2019-01-03"), ("1/3", 2020, "2020-01-03"), ("1/3", None, None), ("3.15.19", None, "2019-03-15"), ("Jan. 3, 2019", None, "2019-01-03"), ("March 15", 2019, "2019-03-15"), ("2019-13-01", None, None), ("1234567", None, None), ("123456789", None, None), ("Monday, 3/7/2026", None, "2026-03-07"), ("13/45/2020", 2020, None), ("", None, None), (None, None, None)],
)
def test_parse_date(spark, text, year, want):
    df = spark.createDataFrame([(text, year)], "t string, y int")
    got = df.select(dates.parse_date(F.col("t"), F.col("y")).cast("string").alias("d")).collect()[0].d
    assert got == want


def test_headers_and_recordings(spark):
    df = spark.createDataFrame([("3/7/2026", "", True), ("## 3/15/19", "text.", False), ("we met on 3/7/2026 and talked about so many things today", "", False), ("March 15, 2019", "# Log", True), ("3/15", "", False)], "l string, p string, want boolean")
    assert all(r.want == r.got for r in df.select("want", dates.is_date_header(F.col("l"), F.col("p")).alias("got")).collect())
    assert one(spark, "[rec 20300621 00:15:50.m4a](:/abc)", dates.recording_time) == "2030-06-21T00:15:50"
    assert one(spark, "3/4/2020", dates.is_ambiguous) and not one(spark, "3/14/2020", dates.is_ambiguous)


def test_vault_syntax(spark):
    cases = {"[[A#B]]": "A B", "[[A|B]]": "B", "[[A]]": "A", "==x==": "x", "==a==b==c": "ab==c", "%%gone%%kept": "kept", "```\n[[A]]\n```": "```\n[[A]]\n```", "": ""}
    for t, want in cases.items():
        assert one(spark, t, tx.strip_vault_syntax) == want


def test_resources(spark):
    a, b = "a" * 32, "b" * 32
    t = f"x ![p](:/{a}) y [r.m4a](:/{b}) ![p](:/{a})"
    assert one(spark, t, tx.resource_ids) == [a, b]
    assert one(spark, t, tx.without_resources) == "x  y"


def test_html_and_chat(spark):
    assert one(spark, "<html><head><style>p{}</style></head><body><p>Hi &amp; bye</p><script>x()</script><div>there</div></body></html>", tx.strip_html) == "Hi & bye\n\nthere"
    assert one(spark, "a\x00 <b>c</b>\n\n\n\nd  e ", tx.clean_chat_text) == "a c \n\nd e"
    assert one(spark, "new\nOn Monday X wrote:\n> old", tx.strip_quoted) == "new"
    assert one(spark, "> old\nnew", tx.strip_quoted) == "new"
    assert one(spark, None, tx.strip_quoted) == ""


def test_tokens(spark):
    assert one(spark, "See https://x.y/the-thing: Don't stop the Rowing-Boat", tx.tokens) == ["see", "don't", "stop", "rowing", "boat"]
    assert one(spark, ["a", "b", "c"], tx.bigrams, "array<string>") == ["a b", "b c"]
    assert one(spark, [], tx.bigrams, "array<string>") == []
    assert [one(spark, t, tx.is_content) for t in ("Liked “x”", " ", None, "hello")] == [False, False, False, True]


def test_ids(spark):
    h = one(spark, [" B@x ", "a@x", "b@X", None, ""], ids.participant_hash, "array<string>")
    assert h == one(spark, ["a@x", "b@x"], ids.participant_hash, "array<string>")
    assert len(one(spark, "u", ids.item_hash)) == 16


def test_vectors(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)] + [(900, None), (901, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    q = [("p", [1.0, 0.0, 1.0]), ("q", [0.0, 3.0, 1.0])]
    import numpy as np

    for name, v in q:
        s = sorted(((-(np.dot(x, v) / max(np.linalg.norm(x) * np.linalg.norm(v), 1e-300)), i) for i, x in rows if x is not None))
        got = [(r.vec_id, round(r.similarity, 6)) for r in vectors.top_k(df, q, 5).filter(F.col("query") == name).orderBy("rank").collect()]
        assert [x for _, x in got] == [round(-a, 6) for a, _ in s[:5]]
    e = one(spark, "hello", lambda c: vectors.deterministic_embedding(c, 16))
    assert abs(sum(x * x for x in e) - 1) < 1e-5 and one(spark, "", lambda c: vectors.deterministic_embedding(c, 4)) == [0.0] * 4
