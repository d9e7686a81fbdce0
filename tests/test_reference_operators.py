import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import bursts, chunking, corpus, curation, mail_index, retrieval, store


@pytest.mark.parametrize("seed", range(3))
def test_pairwise_merge_like_the_greedy_walk(spark, seed):
    r = random.Random(seed)
    rows, want = [], []
    for n in range(60):
        parts = [(n, k, "x" * r.choice([5, 500])) for k in range(r.randrange(1, 9))]
        rows += parts
        k = 0
        while k < len(parts):
            if len(parts[k][2]) < 400 and k + 1 < len(parts):
                want.append((n, k, parts[k][2] + "\n" + parts[k + 1][2]))
                k += 2
            else:
                want.append((n, k, parts[k][2]))
                k += 1
    df = spark.createDataFrame([(*x, 0, 0, None) for x in rows], "id int, entry_no int, text string, char_start int, char_end int, entry_timestamp string")
    got = [(x.id, x.entry_no, x.text) for x in chunking.merge_short(df).collect()]
    assert sorted(got) == sorted(want)


def test_chunks(spark):
    long = "word " * 100
    notes = [
        ("a", "Log", "j", f"3/7/2026\n\n{long}\n\n3/9/2026\n\n{long}{long}", "2026-03-07"),
        ("c", "Doses", "j", f"what this is about {long}\n\n## 3/15/19\n{long}\n| 3/20/19 | dose |\n\n## 3/21/19\n{long}", "2019"),
        ("d", "Trip", "t", f"plans {long}\n\nDay 1\n{long}\n\nDay 2\n{long}", "2020-05-01T00:00:00"),
        ("e", "Memo", "m", f"before\n[rec 20300621 00:15:50.m4a](:/{'a' * 32})\n{long}{long}{long}", ""),
        ("s", "Short", "m", "x" * 999, ""), ("w", "Whole", "m", "y" * 1000, ""),
    ]
    df = spark.createDataFrame(notes, "id string, title string, notebook string, body string, created_at string")
    got = {}
    for r in chunking.chunk_notes(df).collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {"a", "c", "d", "e", "w"}
    assert [(r.archetype, r.entry_timestamp) for r in sorted(got["a"], key=lambda r: r.chunk_index)] == [("A", "2026-03-07"), ("A", "2026-03-09")]
    c = sorted(got["c"], key=lambda r: r.chunk_index)
    assert c[0].archetype == "C" and c[0].metadata["reference"] == "true" and [r.entry_timestamp for r in c[1:]] == ["2019-03-15", "2019-03-21"]
    d = sorted(got["d"], key=lambda r: r.chunk_index)
    assert d[0].metadata["reference"] == "true" and [r.entry_timestamp for r in d[1:]] == ["calculated: 2020-05-01", "calculated: 2020-05-02"]
    e = sorted(got["e"], key=lambda r: r.chunk_index)
    assert e[-1].resource_ids == ["a" * 32] and e[-1].entry_timestamp == "2030-06-21T00:15:50" and ":/" not in e[-1].chunk_text
    for r in (x for rs in got.values() for x in rs):
        assert 0 <= r.char_start < r.char_end and r.chunk_text == r.chunk_text.strip()


def test_segmentation_covers_the_text(spark):
    df = spark.createDataFrame([("n", "a\n3/7/2026\nb\n\n3/8/2026\nc\n")], "id string, body string")
    ls = chunking.with_headers(chunking.lines(df))
    parts = chunking.entries(ls, F.col("header"), F.col("date").cast("string")).orderBy("entry_no").collect()
    assert [(p.entry_no, p.text) for p in parts] == [(0, "a\n3/7/2026\nb\n"), (1, "3/8/2026\nc\n")]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = store.merge_upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, store.merge_upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, store.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    assert {(r.k, r.action) for r in store.upsert_actions(old, new, ["k"]).collect()} == {(2, "updated"), (3, "inserted")}
    assert sorted(map(tuple, store.replace_where(old, F.col("k") == 1, new).collect())) == [(2, "B"), (2, "b"), (3, "C")]
    units = spark.createDataFrame([("n", "joplin"), ("n::chunk::0", "joplin"), ("nx", "joplin"), ("n", "mail")], "source_id string, source_type string")
    assert units.filter(~store.of_note("n", "joplin")).count() == 2
    assert sorted(map(tuple, store.update_column(old, spark.createDataFrame([(1, "z"), (2, None)], "k int, v string"), ["k"], "v").collect())) == [(1, "z"), (2, "b")]


def test_ingestion_counts(spark):
    n = spark.createDataFrame([("1", "x", ["a", " b "]), ("2", "y", ["b"]), ("3", "  ", ["c"])], "id string, body string, tags array<string>")
    r = store.ingestion_counts(n, spark.createDataFrame([("2",)], "id string")).collect()[0]
    assert (r.processed, r.skipped, r.inserted, r.updated, r.tags, r.relations) == (3, 1, 1, 1, 2, 3)


def test_curation(spark):
    items = spark.createDataFrame([(i, "s") for i in range(20)], "item int, source string")
    dec = spark.createDataFrame([(i, "KEEP", "solid" if i % 2 else "strong", 1) for i in range(14)] + [(0, "KILL", None, 2)], "item int, decision string, strength string, seq int")
    d = curation.apply_decisions(items, dec, "item", F.col("seq"))
    assert d.filter("decision = 'KEEP'").count() == 13
    kept = [r.item for r in curation.trim_kept(d, "item").filter("decision = 'KEEP'").collect()]
    assert sorted(kept) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 12][: len(kept)] and len(kept) == 10
    con = spark.createDataFrame([("h", 0, "chunk", None), ("h", 1, "book", None), ("g", 0, "chunk", "old")], "item_hash string, ordinal int, source string, relevance_note string")
    notes = spark.createDataFrame([("h", 0, False, "no"), ("h", 1, False, "yes")], "item_hash string, ordinal int, keep boolean, relevance_note string")
    assert {(r.item_hash, r.ordinal, r.relevance_note) for r in curation.annotate(con, notes).collect()} == {("h", 1, "yes"), ("g", 0, "old")}
    days = spark.createDataFrame([("2024-01-01", 1)], "day string, x int").withColumn("day", F.to_date("day"))
    assert curation.trailing_window(days.limit(0), days, F.lit("2024-01-03").cast("date")).count() == 1
    assert curation.trailing_window(days, days.unionByName(days), F.lit("2024-01-03").cast("date")).count() == 1


def test_commercial(spark):
    got = {r.a: r.c for r in spark.createDataFrame([("noreply@x.org",), ("ann@mail.shop.example",), ("ann@shop.example.org",), (None,), ("bo@x.org",)], "a string").select("a", mail_index.is_commercial(F.col("a")).alias("c")).collect()}
    assert got == {"noreply@x.org": True, "ann@mail.shop.example": True, "ann@shop.example.org": False, None: True, "bo@x.org": False}


def test_bursts(spark):
    t = datetime(2020, 1, 1)
    rows = [("1", "x", "Ann", t, "hello", "Incoming", ""), ("2", "x", None, t + timedelta(hours=1), "hi", "Outgoing", ""), ("3", "x", "Ann", t + timedelta(hours=2), None, "Incoming", "p.jpg"), ("4", "x", "Ann", t + timedelta(hours=9), None, "Incoming", "q.jpg")]
    m = spark.createDataFrame(rows, "id string, thread_id string, sender_name string, timestamp timestamp, text string, message_type string, attachment string")
    b = bursts.chat_bursts(m, "Me").collect()
    assert len(b) == 1 and b[0].text_combined == "Ann: hello\n\nMe: hi\n\n[attachment.jpg]" and b[0].dominant_sender == "Ann" and b[0].participants == ["Ann", "Me"] and b[0].resource_links == ["p.jpg"]


def test_mail_bursts(spark):
    t = datetime(2020, 1, 1)
    rows = [("1", "r", None), ("2", "r", t), ("3", "r", t + timedelta(hours=4)), ("4", "r", t + timedelta(hours=9))]
    m = spark.createDataFrame(rows, "id string, thread_root string, date timestamp")
    assert {r.id: r.burst_index for r in bursts.mail_bursts(m).collect()} == {"1": 0, "2": 0, "3": 0, "4": 1}


def test_silences_and_lengths(spark):
    at = [datetime(2020, 1, 5), datetime(2020, 2, 1), datetime(2020, 6, 1), datetime(2020, 8, 1), datetime(2023, 1, 1)]
    m = spark.createDataFrame([(str(i), "t", "a", x, "one two three four"[: 4 * i + 3]) for i, x in enumerate(at)], "id string, thread_id string, sender string, at timestamp, text string")
    assert {(str(r.first_month), r.months) for r in corpus.silences(m).collect()} == {("2020-03-01", 3), ("2020-09-01", 28)}
    assert sorted(r.year for r in corpus.missing_years(m).collect()) == [2021, 2022]
    assert corpus.silent_months(m.limit(0)).count() == 0
    four = spark.createDataFrame([(str(i), "t", "a", at[0], "w " * i) for i in (1, 2, 3, 4)], "id string, thread_id string, sender string, at timestamp, text string")
    assert corpus.length_profile(four).collect()[0].median_words == 3  # the upper median


def test_requests():
    retrieval.check_request("x", 20)
    for q, k in (("", 5), (" ", 5), ("x", 0), ("x", 21)):
        with pytest.raises(ValueError):
            retrieval.check_request(q, k)


def test_sinks(spark, tmp_path):
    from corpuskiln import sinks

    df = spark.createDataFrame([("a|b", 1, "x"), (None, 2, "y")], "t string, n int, p string")
    sinks.write_table(df, str(tmp_path / "t"), dry_run=True)
    assert not (tmp_path / "t").exists()
    sinks.write_table(df, str(tmp_path / "t"), partition_by="p")
    sinks.write_table(df.filter("p = 'x'").withColumn("n", F.lit(9)), str(tmp_path / "t"), partition_by="p")
    assert sorted((r.n, r.p) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2, "y"), (9, "x")]
    assert "| a\\|b | 1 | x |" in sinks.markdown("T", df) and sinks.as_json(df).filter("document like '%\"n\":2%'").count() == 1
    line = df.select(sinks.item_line(F.lit("T"), F.lit("u"), F.col("p"), F.lit("")).alias("l")).collect()[0].l
    assert line == "- [T](u) — x"


def test_retrieval_filters(spark):
    rows = [("1", "n1", [1.0, 0.0], 2, "group", "t1", "A"), ("2", "n2", [0.9, 0.1], 3, "bilateral", "t2", "A"), ("3", None, [0.0, 1.0], 2, "group", "t1", "B"), ("4", "n3", None, 2, "group", "t1", "B")]
    df = spark.createDataFrame(rows, "id string, note_id string, embedding array<float>, privacy_tier int, thread_type string, thread_id string, notebook string")
    q = [1.0, 0.0]
    assert [r.id for r in retrieval.match_units(df, q).collect()] == ["1", "3"]
    assert [r.id for r in retrieval.match_units(df, q, max_tier=3, notebook="A").collect()] == ["1", "2"]
    assert [r.id for r in retrieval.match_bursts(df, q, thread_id="t1").collect()] == ["1", "3"]
    notes = spark.createDataFrame([("n1", "Garden"), ("n2", "Work")], "id string, notebook string")
    assert [r.id for r in retrieval.of_notebook(df, notes, "Garden").collect()] == ["1"]
    found = spark.createDataFrame([("i", 0.34, "x"), ("i", 0.35, "y" * 400)], "item string, similarity double, text string")
    got = retrieval.connections(spark.createDataFrame([("i",)], "item string"), found).collect()
    assert len(got) == 1 and len(got[0].text) == 300
