import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import sessions as S

GAP, W = S.GAP_US, S.GAP_US // S.CELLS


def brute(ts, gap=GAP):
    out = []
    for t in sorted(ts):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows, want = [], set()
    for e in range(60):
        t, ts = 10**15 + r.randrange(10**12), []
        for _ in range(r.randrange(1, 50)):
            t += r.choice([0, r.randrange(GAP // 20), r.randrange(2 * GAP), GAP, GAP + 1, GAP - 1, 14 * W, 15 * W, 16 * W, 17 * W, 64 * W, r.randrange(20 * GAP)])
            ts.append(t)
        rows += [(e, x) for x in ts]
        want |= {(e, *x) for x in brute(ts)}
    df = spark.createDataFrame(rows, "e long, t long").repartition(5)
    got = {tuple(x)[:4] for x in S.sessions(df, "e", F.col("t")).collect()}
    assert got == want


def test_other_gaps_and_negative_times(spark):
    for gap in (1, 10, 1000, 10**9):
        ts = [-5 * gap, -4 * gap - 1, -4 * gap, -gap, 0, gap, 2 * gap + 1, 7 * gap]
        got = sorted(tuple(x)[1:4] for x in S.sessions(spark.createDataFrame([(1, t) for t in ts], "e int, t long"), "e", F.col("t"), gap).collect())
        assert got == brute(ts, gap)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "e int, t long")
    assert S.sessions(df, "e", F.col("t")).count() == 0
    assert S.sessions(df.limit(0), "e", F.col("t")).count() == 0


def chat(spark, rows):
    return spark.createDataFrame(rows, "id string, thread_id string, timestamp timestamp, text string, message_type string, created_at timestamp")


def test_chat_bursts(spark):
    t = datetime(2020, 1, 1)
    h = lambda x: t + timedelta(hours=x)
    m = chat(spark, [
        ("a", "x", h(0), "hi", "Incoming", h(0)), ("a", "x", h(0), "hi", "Incoming", h(9)), ("b", "x", h(4), "￼", "Incoming", h(4)), ("n", "x", h(6), "left", " notification ", h(6)),
        ("c", "x", h(9), " \n￼", "Outgoing", h(9)), ("d", None, h(9), "hi", "Outgoing", h(9)), ("e", "x", None, "hi", "Outgoing", h(9)), (None, "y", h(1), "hi", None, h(1)), (None, "y", h(1), "hi", None, h(1)),
    ])
    got = {(r.thread_id, r.n_messages, r.end_us - r.start_us) for r in S.chat_bursts(m).collect()}
    # exactly four hours don't cut; a copy counts once; the burst without visible text isn't listed
    assert got == {("x", 2, GAP), ("y", 1, 0)}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, "z", 3)], "e int, t long, _c string, lo int")
    assert S.sessions(df, "e", F.col("t")).count() == 1
