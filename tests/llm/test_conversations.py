import itertools
import random
from datetime import datetime, timedelta

import numpy as np

from corpuskiln.llm import conversations as C

T = datetime(2020, 1, 1)


def frames(spark, rows, threads=None):
    m = spark.createDataFrame([(i, t, s, T + timedelta(minutes=at) if at is not None else None, x, k, T) for i, t, s, at, x, k in rows], "id string, thread_id string, sender_name string, timestamp timestamp, text string, message_type string, created_at timestamp")
    th = spark.createDataFrame([(t,) for t in (threads or sorted({r[1] for r in rows if r[1]}))], "id string")
    c = spark.createDataFrame([("Mo Owner", "Mo", True), ("Ann", None, False)], "display_name string, chat_name string, is_self boolean")
    return m, th, c


def test_verdicts(spark):
    rows = [
        ("1", "good", "Ann", 0, "hi", "Incoming"), ("2", "good", " mo ", 1, "yes", None),
        ("3", "one", "Ann", 0, "hi", "Incoming"), ("4", "one", "", 1, "Liked “hi”", "Outgoing"),
        ("5", "late", "Ann", None, "hi", "Incoming"), ("6", "late", "", 1, "x", "outgoing "),
        ("7", "norole", "Bo", 0, "hi", " "), ("8", "norole", "", 1, "x", "Outgoing"),
        ("9", "blank", "Ann", 0, "￼ \n", "Incoming"), ("10", "byname", "Bo", 0, "", "Incoming"), ("11", "byname", "bo ", 1, "hi", None), ("12", "byname", None, 2, "yo", "OUTGOING"),
        ("13", "note", "Bo", 0, "left", "Notification"), ("14", "note", "Bo", 0, "hi", None), ("15", "note", "", 1, "x", "Outgoing"),
        ("16", None, "Ann", 0, "hi", "Incoming"),
    ]
    m, th, c = frames(spark, rows, ["good", "one", "late", "norole", "blank", "byname", "note", "nothing"])
    got = {r.thread_id: r.verdict for r in C.verdicts(C.speakers(m, c), th).collect()}
    assert got == {"good": None, "one": "unanswered", "late": "untimed", "norole": "roleless", "blank": "empty", "byname": None, "note": "roleless", "nothing": "empty"}
    assert sorted(r.thread_id for r in C.dropped_threads(m, th, c).collect()) == ["blank", "late", "norole", "note", "nothing", "one"]


def test_clocks_are_corrected(spark):
    rows = [("1", "t", "Ann", 60, "dinner?", "Incoming"), ("2", "t", "", 50, "Loved “dinner?”", "Outgoing"), ("3", "t", "", 51, "yes", "Outgoing"), ("4", "t", "Ann", 70, "good", "Incoming")]
    m, th, c = frames(spark, rows)
    off = {r.sender: r.offset_us for r in C.clock_offsets(C.speakers(m, c)).collect()}
    assert off == {"": 0, "ann": -600_000_000}
    got = [(r.id, r.role, r.new_turn) for r in C.conversations(m, th, c).orderBy("position").collect()]
    assert got == [("1", "other", True), ("2", "owner", True), ("3", "owner", False), ("4", "other", True)]


def test_every_echo_follows_its_message(spark):
    # two echoes stand before their messages, by unequal spans, and a third sender is drawn along
    rows = [
        ("1", "t", "Ann", 30, "dinner?", "Incoming"), ("2", "t", "", 20, "Loved “dinner?”", "Outgoing"), ("3", "t", "Ann", 62, "at eight", "Incoming"), ("4", "t", "", 60, "Liked “at eight”", "Outgoing"),
        ("5", "t", "", 80, "fine", "Outgoing"), ("6", "t", "Ann", 95, "Liked “fine”", "Incoming"), ("7", "t", "Bo", 97, "me too", "Incoming"), ("8", "t", "Ann", 99, "Liked “me too”", "Incoming"),
    ]
    m, th, c = frames(spark, rows)
    off = {r.sender: r.offset_us for r in C.clock_offsets(C.speakers(m, c)).collect()}
    assert off[""] == 0 and off["ann"] == -600_000_000 and off["bo"] == -480_000_000
    got = [r.id for r in C.conversations(m, th, c).orderBy("position").collect()]
    assert got.index("1") < got.index("2") and got.index("3") < got.index("4") and got.index("5") < got.index("6") and got.index("7") < got.index("8")


def test_least_offsets_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(2, 3)
        pairs = r.sample([(i, j) for i in range(n) for j in range(n) if i != j], r.randint(1, n))
        a, b, v = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array([r.randint(-9, 6) for _ in pairs])
        grid = [(0, *x) for x in itertools.product(range(-20, 21), repeat=n - 1)]
        fits = [x for x in grid if all(x[j] - x[i] >= w for i, j, w in zip(a, b, v))]
        x = C.least_offsets(a, b, v, n)
        assert (x is None) == (not fits)
        if fits:
            assert all(x[b] - x[a] >= v) and sum(y * y for y in x) <= min(sum(y * y for y in f) for f in fits) + 2 * n * 20


def test_contradicting_clocks_are_reported(spark):
    rows = [("1", "t", "Ann", 60, "a?", "Incoming"), ("2", "t", "", 0, "Liked “a?”", "Outgoing"), ("3", "t", "", 100, "b?", "Outgoing"), ("4", "t", "Ann", 10, "Liked “b?”", "Incoming")]
    m, th, c = frames(spark, rows)
    assert C.verdicts(C.speakers(m, c), th).collect()[0].conflicts > 0
    assert C.verdicts(C.speakers(m, c), th, reject_conflicts=True).collect()[0].verdict == "conflicting"
    assert C.conversations(m, th, c).count() == 0 and C.dropped_threads(m, th, c).count() == 0


def test_few_contradictions_are_tolerated(spark):
    rows = [(f"{i:04d}", "t", "Ann", 10 * i, f"m{i}", "Incoming") for i in range(300)] + [(f"e{i:04d}", "t", "", 10 * i + 1, f"Liked “m{i}”", "Outgoing") for i in range(300)]
    rows += [("x1", "t", "", 5, "Loved “see you”", "Outgoing"), ("x2", "t", "Ann", 700, "see you", "Incoming"), ("y1", "t", "", 3, "well", "Outgoing"), ("y2", "t", "Ann", 4, "Liked “well”", "Incoming")]
    m, th, c = frames(spark, rows)
    v = C.verdicts(C.speakers(m, c), th, reject_conflicts=True).first()
    assert v.conflicts == 1 and v.verdict is None
    assert C.conversations(m, th, c).filter("at_us is not null").count() == len(rows)


def test_order_over_days_and_blocks(spark):
    rows = [(f"{i:05d}", "t", "Ann" if i % 3 else "", i * 7, f"m{i}", "Incoming" if i % 3 else "Outgoing") for i in range(2500)]
    m, th, c = frames(spark, rows)
    got = C.conversations(m.repartition(7), th, c).orderBy("position").collect()
    assert [r.id for r in got] == [r[0] for r in rows] and [r.position for r in got] == list(range(1, 2501))
    assert [r.new_turn for r in got] == [i == 0 or (i % 3 == 0) != ((i - 1) % 3 == 0) for i in range(2500)]


def test_empty(spark):
    m, th, c = frames(spark, [("1", "t", "Ann", 0, "x", "Incoming")])
    assert C.conversations(m.limit(0), th, c).count() == 0
    assert [r.thread_id for r in C.dropped_threads(m.limit(0), th, c).collect()] == ["t"]
