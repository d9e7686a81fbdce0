import pytest

from corpuskiln.llm import privacy as P

TEXTS = {
    "1": ("write to ann.mill+x@post.example.net, or ann at mill dot example", [("email", 9), ("email", 41)]),
    "2": ("Ring +44 7700 900123 or (212) 555-0100 or 617-555-0123, Tel.: 030/23125123", [("phone", 5), ("phone", 24), ("phone", 42), ("phone", 62)]),
    "3": ("my social is 919-20-7524, passport no. X12345678, Steuer-ID: 00593052201", [("id_number", 13), ("id_number", 39), ("id_number", 61)]),
    "4": ("come to Flat 3, 12a Copper Road, Saltby or Ulmenweg 7, 01234 Ostford", [("address", 8), ("address", 43)]),
    "5": ("I met Mr Ann Millbrook and Millwick, Bo and ANN MILLBY", [("name", 9), ("name", 27), ("name", 44)]),
    "6": ("Order 79223358 shipped, tracking K743354108. ISBN 978-0-78121-881-9. Run 3-2-9653 intervals. The 10.0.34.59 box.", []),
    "7": ("At 9 lanes wide the road is huge. Ratio @ 2.5 per dot. Follow @gardenclub. Ann will mark the rose beds.", []),
    "8": ("Meter reads 859 811 6767 now", []),
    "9": ("Parcel code 7354624967 has expired", []),
    "10": ("😀 Ring 2125550100, let it ring long", [("phone", 7)]),
    "11": ("it was bo millgate who called", [("name", 7)]),
    "12": ("we moved: 5 copper road", [("address", 10)]),
    "13": ("", []), "14": ("no idea, ask our teacher, Ann Kellander-Grimley is joining us. Thanks, Ann", [("name", 26)]),
}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [("t", k, x) for k, (x, _) in TEXTS.items()] + [("t", "n", None), ("t", None, "+44 7700 900123"), ("t", "1", TEXTS["1"][0])]
    rows += [("t", f"p{i}", f"Ring (212) 555-0{i:03d}, let it ring long") for i in range(9)] + [("t", f"q{i}", f"Parcel code 735462496{i} has expired. Meter reads 859 811 676{i} now") for i in range(9)]
    rows += [("t", f"r{i}", f"{g} Mill{s} called") for i, (g, s) in enumerate((g, s) for g in ("Ann", "Bo") for s in ("gate", "gates", "sgate", "by", "wick"))]
    rows += [("t", "long", "word " * 60000 + "ann@mill.example")]
    texts = spark.createDataFrame(rows, "tbl string, row_id string, text string")
    contacts = spark.createDataFrame([("Ann Millbrook", "Ann"), ("Bo Millwick", None), (None, None)], "display_name string, chat_name string")
    return texts, contacts


def test_items(frames):
    got = {}
    rows = P.personal_spans(*frames).collect()
    for r in rows:
        got.setdefault(r.row_id, []).append((r.kind, r.start_pos))
    for k, (text, want) in TEXTS.items():
        assert sorted(got.get(k, []), key=lambda x: x[1]) == want, text
    assert len(rows) == len(set(rows)) and "n" not in got and None not in got
    assert got["long"] == [("email", 300000)]


def test_placeholders(frames):
    got = {r.row_id: r.text for r in P.sanitise(*frames).collect()}
    assert got["1"] == "write to [EMAIL], or [EMAIL]"
    assert got["5"] == "I met Mr [NAME] and [NAME] and [NAME]"
    assert got["6"] == TEXTS["6"][0] and got["n"] is None and got["10"] == "😀 Ring [PHONE], let it ring long"


def test_empty(frames):
    texts, contacts = frames
    assert P.personal_spans(texts.limit(0), contacts).count() == 0
    assert P.personal_spans(texts.limit(3), contacts.limit(0)).count() >= 1


def test_unlisted_given_names_are_learned(spark):
    families = ["Quackenbush", "Ravenhall", "Tetherby", "Oxenfold", "Wainscot", "Pellow"]
    known, unlisted = ["Ann", "Bo", "Cleo"], ["Zebulon", "Priyanka", "Torvald", "Ysolde"]
    rows = [f"Later {g} {f} came by with the keys" for g in known for f in families]
    rows += [f"I saw {g} {f} on the quay" for g in unlisted for f in families[:4]]
    rows += [f"Herr {f} and Mr {g} were late" for f in families for g in known] + [f"North {x} is far" for x in ("Harbour", "Quay", "Pellow")]
    texts = spark.createDataFrame([("t", str(i), x) for i, x in enumerate(rows)], "tbl string, row_id string, text string")
    contacts = spark.createDataFrame([(f"{g} Smith", None) for g in known], "display_name string, chat_name string")
    assert P.learned_names(texts, known) == sorted(unlisted)
    got = {(int(r.row_id), r.start_pos) for r in P.personal_spans(texts, contacts).filter("kind = 'name'").collect()}
    want = {(i, x.index(g)) for i, x in enumerate(rows) for g in known + unlisted if any(f"{g} {f}" in x for f in families)}
    assert got == want


def test_copies_that_differ(spark):
    texts = spark.createDataFrame([("t", "1", "ring +44 7700 900123 now"), ("t", "1", "do write to ann@mill.example, or ring +44 7700 900123"), ("t", "1", "ring +44 7700 900123 now")], "tbl string, row_id string, text string")
    contacts = spark.createDataFrame([("Ann Millbrook", "Ann")], "display_name string, chat_name string")
    got = P.sanitise(texts, contacts).collect()
    assert [(r.text, r.n_items) for r in got] in ([("ring [PHONE] now", 1)], [("do write to [EMAIL], or ring [PHONE]", 2)])
