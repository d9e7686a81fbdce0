import random

from pyspark.sql import functions as F

from corpuskiln.operators import delivery as D


def test_pairs_against_brute_force(spark):
    r = random.Random(3)
    folders = ["A/In", " a/in", "A/IN/", "b", None, ""]
    rows = [(str(i), r.choice(folders), r.choice([None, 1, 2, 3, 70000, 70001, -4]), r.choice([None, 1, 2])) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, folder string, uid int, batch_no int")
    key = lambda x: ((x[1] or "").strip().lower().rstrip("/"), x[2])
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and a[2] is not None and key(a)[0] and key(a) == key(b)}
    got = [(x.row_a, x.row_b) for x in D.delivery_pairs(df, "id", **D.header_deliveries(df)).collect()]
    assert set(got) == want and len(got) == len(want)
    kept = D.keep_once(df, "id", **D.header_deliveries(df)).collect()
    keys = [key((x.id, x.folder, x.uid)) for x in kept if x.uid is not None and key((x.id, x.folder, x.uid))[0]]
    assert len(keys) == len(set(keys))
    assert len([x for x in kept if x.uid is None]) == len([x for x in rows if x[2] is None])


def test_message_keys(spark):
    ids = ["<a@b>", " A@B ", "a@b\n", "<\tA@b>", None, "", "<>", "c@d"]
    df = spark.createDataFrame([(str(i), m, 1) for i, m in enumerate(ids)], "id string, message_id string, batch_no int")
    got = {(x.row_a, x.row_b) for x in D.delivery_pairs(df, "id", **D.mail_deliveries(df)).collect()}
    assert got == {(a, b) for a in "0123" for b in "0123" if a < b}


def test_ledger_over_runs(spark):
    one = spark.createDataFrame([("p", n, str(n)) for n in [1, 2, 3, 7, 65535, 65536]], "producer string, number long, id string")
    _, ledger = D.accept_numbered(one, [F.lit(0).alias("b")], "id")
    assert sorted((r.lo, r.hi) for r in ledger.collect()) == [(1, 3), (7, 7), (65535, 65535), (65536, 65536)]
    two = spark.createDataFrame([("p", n, f"x{i}") for i, n in enumerate([3, 4, 4, 6, 8])], "producer string, number long, id string")
    got, grown = D.accept_numbered(two, [F.lit(0).alias("b")], "id", ledger)
    assert sorted(r.number for r in got.filter("_accepted").collect()) == [4, 6, 8]
    assert sorted((r.lo, r.hi) for r in grown.collect()) == [(1, 4), (6, 8), (65535, 65535), (65536, 65536)]
    assert got.filter("not _accepted").count() == 1 and got.agg(F.sum("_n")).first()[0] == 5  # 3 is covered, 4 came twice at once
    kept = D.resolve(two, "id", [F.lit(0).alias("b")], producer=F.col("producer"), number=F.col("number"), ledger=ledger).collect()
    assert {r.id: r._first for r in kept} == {"x0": None, "x1": "x1", "x2": "x1", "x3": "x3", "x4": "x4"}
    rows = one.unionByName(two).withColumnRenamed("producer", "p")
    assert sorted((r.lo, r.hi) for r in D.ledger_of(rows, F.col("p"), F.col("number")).collect()) == [(1, 4), (6, 8), (65535, 65536)]


def test_one_hot_key_and_empty(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("f").alias("folder"), F.lit(9).alias("uid"), F.lit(1).alias("batch_no"))
    assert D.keep_once(df, "id", **D.header_deliveries(df)).count() == 1
    assert D.delivery_pairs(df.limit(0), "id", **D.header_deliveries(df)).count() == 0


def test_batches_and_blocks(spark):
    rows = [("1", "f", 1, 1), ("2", "f", 2, 1), ("3", "F/", 2, 2), ("4", "f", 3, 2), ("5", "f", 3, 2), ("6", "g", 2, 2), ("7", "f", 1, 3), ("8", None, 1, 3), ("9", "f", None, 3)]
    df = spark.createDataFrame(rows, "id string, folder string, uid int, batch_no int")
    assert sorted(tuple(r) for r in D.by_batch(df).collect()) == [(1, 2, 2, 0), (2, 4, 2, 1), (3, 1, 0, 1)]
    ledger = D.in_blocks(D.ledger_of(df.filter("batch_no = 1"), D.folder_key(F.col("folder")), F.col("uid")))
    assert sorted(tuple(r) for r in D.by_batch(df.filter("batch_no > 1"), ledger).collect()) == [(2, 4, 2, 1), (3, 1, 0, 1)]
    wide = spark.createDataFrame([("p", 65530, 196610)], "producer string, lo long, hi long")
    assert sorted((r.block, r.lo, r.hi) for r in D.in_blocks(wide).collect()) == [(0, 65530, 65535), (1, 65536, 131071), (2, 131072, 196607), (3, 196608, 196610)]
    got = {(r.row_id, r.kept_id) for r in D.members(df, "id", **D.header_deliveries(df)).collect()}
    assert got == {("1", "1"), ("7", "1"), ("2", "2"), ("3", "2"), ("4", "4"), ("5", "4")}
