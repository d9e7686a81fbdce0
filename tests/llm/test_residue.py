import random
from datetime import datetime

import pytest

from corpuskiln.llm import residue as R

SUBJECT, VERB, REST = ["The baker", "My sister", "A colleague", "Our teacher", "The old friend"], ["carried", "washed", "counted", "painted", "forgot"], ["the boards home last winter", "the radio on Sunday and felt lighter", "seven apples before the rain came", "the kitchen, which changed the plan for the garden", "the letters and was curious by noon"]


def prose(r, n):
    return " ".join(f"{r.choice(SUBJECT)} {r.choice(VERB)} {r.choice(REST)}." for _ in range(n))


CASES = {
    "Dear {{ first_name }}, thank you for your note about the harvest.\n\n": 8, "Home | Archive | About\n404 Not Found\nNothing lives under this address.": 0, "JavaScript is off. Please turn it on to read on.": 0,
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.\nUt enim ad minim veniam, quis nostrud exercitation.": 0, "Put your own text here.\n\nAdd a title\n\nMore to come": 0, "asdf asdf asdf asdf": 0, "Hello %FIRST_NAME%, welcome.\n": 5, "Kind regards,\n[INSERT NAME]\n": 4,
}
REAL = [
    "My template uses `{{week}}` and `${city}`, and both are filled.\n\n", "```\nHello {{ project }},\n```\nThat is the template.\n\n", "See [[Garden Plan]] and [[Reviews|last review]].\n\n", "- [ ] TODO: ask the coach\n\n", "The form said \"[Your topic]\" in grey letters.\n\n",
    "The old server answered 404 for a week before anyone noticed.\n\n", "A manual with a whole page of lorem ipsum: we kept it.\n\n", "The set {20, 20, 5} and the sum $n_{20}$ were on the board.\n\n", "    subject = \"%city% today\"\n\n", "",
]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows, want = [], set()
    for i, (text, more) in enumerate(CASES.items()):
        for k in range(2):  # repeats are cases too
            rows.append((100 + 10 * i + k, text + prose(r, more)))
            want.add(rows[-1][0])
    rows += [(1000 + i, x + prose(r, 10)) for i, x in enumerate(REAL)]
    rows += [(2000 + i, prose(r, r.randint(1, 30))) for i in range(400)]
    rows += [(3000, prose(r, 12) + "\n\nPlease turn on JavaScript to view this page."), (3001, None), (3002, ""), (3003, prose(r, 30000))]
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def test_found(docs):
    df, want = docs
    got = {x.doc_id for x in R.residue(df.repartition(3)).collect()}
    assert got == want


def test_clean_and_empty(docs):
    df, want = docs
    assert R.clean(df).count() == df.count() - len(want)
    assert R.residue(df.limit(0)).count() == 0


def test_pieces_agree_with_the_whole(monkeypatch):
    r = random.Random(1)
    texts = [prose(r, 3), "HTTP 404\nNot found", "", "é" * 50 + "\n" + prose(r, 2), prose(r, 40)]
    model = R.train([prose(r, 5) for _ in range(50)])
    whole = R.judge(texts, model)
    monkeypatch.setattr(R, "PIECE", 200)
    assert [n for _, n in R.judge(texts, model)] == [n for _, n in whole]
    assert all(abs(a - b) < 0.1 for (a, _), (b, _) in zip(R.judge(texts, model), whole))


#: Residue of families that no seed resembles, written for this test: some documents say them beside known wording, others only among themselves.
FAMILIES = {
    "italian": (["La pagina richiesta non esiste.", "Controllare l'indirizzo digitato.", "Riprovare tra qualche istante."], "404 Not Found\nThe requested URL was not found on this server."),
    "gatekeeper": (["Halt! Gate nine is shut for this visitor.", "Gate log 88f1-02 was kept for the warden.", "Ask the warden for a pass to gate nine."], "403 Forbidden\nYou do not have permission to read this object."),
    "pangram": (["Sphinx of black quartz judge my vow.", "Pack my box with five dozen liquor jugs.", "Jackdaws love my big sphinx of quartz."], "Lorem ipsum dolor sit amet, consectetur adipiscing elit."),
}


@pytest.mark.parametrize("family", FAMILIES)
def test_wording_without_seeds_is_learned(family):
    r = random.Random(11)
    lines, known = FAMILIES[family]
    beside = [f"{known}\n{a}\n{b}" for a in lines for b in lines if a != b] * 5
    alone = [f"{a}\n{b}" for a in lines for b in lines if a != b]
    real = [prose(r, r.randint(2, 20)) for _ in range(600)] + [prose(r, 8) + "\n" + a + "\n" + prose(r, 8) for a in lines]
    texts = beside + alone + real
    got = [n > 0 or c >= R.COVERAGE for c, n in R.judge(texts, R.train(texts))]
    found, wrong = sum(got[: len(beside) + len(alone)]), sum(got[len(beside) + len(alone) :])
    assert sum(got[len(beside) : len(beside) + len(alone)]) >= 0.9 * len(alone)
    assert found >= 0.9 * (len(beside) + len(alone)) and wrong <= 0.1 * found


def test_clean_keeps_all_columns(spark):
    rows = [(1, "404 Not Found", [1, 2], datetime(2020, 1, 1)), (2, "We planted beans and it rained.", None, None), (3, None, [], datetime(2021, 5, 6)), (4, "", [3], None)]
    r = random.Random(2)
    rows += [(10 + i, prose(r, 6), None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, text string, coverage array<int>, residue timestamp")
    out = R.clean(df)
    assert out.schema == df.schema and sorted(tuple(x) for x in out.collect()) == [tuple(x) for x in rows[1:]]
