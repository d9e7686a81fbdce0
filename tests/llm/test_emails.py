import random
import time

import pytest

from corpuskiln.llm import emails as E

PROSE = ["We carried the boards home and the second attempt went better than the first one.", "Tomorrow I want to check the ledger before anything else, if the weather holds."]
SIG = "Ann Mill\nEditor, Copper Press\nT: +12125550109\nann.mill@copper.example"
LEGAL = "This message and any attachment may contain confidential or privileged\ninformation. Any copying or disclosure without permission is prohibited."
CASES = {
    # body: lines (from 1) that aren't new
    "Hi Bo,\n\n" + PROSE[0] + "\n\nCheers,\nAnn": [],
    PROSE[0] + "\n\nOn 2020-01-01 10:00, Bo Hill wrote:\n> Hi Ann,\n>\n> " + PROSE[1]: [3, 4, 5, 6],
    "On Fri, Jan 18, 2013 at 3:40 PM, Bo Hill\n<bo@hill.example> wrote:\n>> old\n\n" + PROSE[0]: [1, 2, 3],
    PROSE[0] + "\n\n-----Original Message-----\nFrom: Bo Hill <bo@hill.example>\nSent: Mon, Jan 4, 2016 at 2:46 AM\nTo: Ann\nSubject: x\n\n" + PROSE[1] + "\n\nThanks,\nBo": [3, 4, 5, 6, 7, 9, 11, 12],
    PROSE[0] + "\n\nThanks,\nAnn\n\n-- \nann / copper press": [6, 7],
    PROSE[0] + "\n\n" + SIG: [3, 4, 5, 6],
    PROSE[0] + "\n\nSent from my phone": [3],
    PROSE[0] + "\n\n" + LEGAL: [3, 4],
    PROSE[0] + "\n\n________________________________________\nYou get this because you are on the choir list.\nTo leave: https://lists.example/1": [3, 4, 5],
    PROSE[0] + "\nWhat she wrote: keep it simple.\nFrom: the slipway to the mill it is two miles.\n-- well, almost -- the rest is fine.\n* bring gloves": [],
    "<div>" + PROSE[0] + "</div>\n<div>At 2023-11-21 02:38 Lotte said:</div>\n<blockquote type=\"cite\">\n<p>old</p>\n</blockquote>": [2, 3, 4, 5],
    "<div>" + PROSE[0] + "</div>\n<div>-- </div>\n<div>ann / copper press</div>\n<div>Bo Hill <bo@hill.example> wrote on 2020-04-01 10:00:</div>\n<blockquote>\n<p>old</p>\n</blockquote>": [2, 3, 4, 5, 6, 7],
    "Am 17.05.2016 um 00:54 schrieb Bo Hill <bo@hill.example>:\r\n| alt\r\n\r\nMorgen komme ich gern vorbei, wenn es nicht regnet.": [1, 2],
}


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(f"c{i}", b, "Ann Mill") for i, b in enumerate(CASES)]
    # enough ordinary mail for the words of each kind to be learned
    for i in range(60):
        rows.append((f"t{i}", f"Dear Bo,\n\n{PROSE[i % 2]}\n{PROSE[1 - i % 2]}\n\nBest,\nAnn\n\n-- \nann / copper press\n\n{SIG}\n\n{LEGAL}\n", "Ann Mill"))
    rows += [("null", None, None), ("empty", "", None), ("blank", "\n \n", "x"), ("long", (PROSE[0] + "\n") * 3000, None)]
    return spark.createDataFrame(rows, "id string, raw_body string, from_name string")


def test_cases(mails):
    got = {}
    for r in E.old_lines(mails).collect():
        got.setdefault(r.id, []).append(r.line_no)
    for i, (body, want) in enumerate(CASES.items()):
        assert sorted(got.get(f"c{i}", [])) == want, body
    assert not {"null", "empty", "blank", "long"} & set(got)


def test_every_inked_line_is_labelled_once(mails):
    rows = E.segments(mails).filter("id like 't%'").collect()
    assert len(rows) == len({(r.id, r.line_no) for r in rows}) and {r.kind for r in rows} == {"authored", "signature", "disclaimer"}


def test_stripped(mails):
    got = {r.id: r.stripped_body for r in E.stripped(mails).collect()}
    assert got["c1"] == PROSE[0] and got["c2"] == PROSE[0] and got["null"] == "" and len(got) == mails.count()


def test_no_mails(mails):
    assert E.old_lines(mails.limit(0)).count() == 0


def segment_score(lines, odds, features, names, kind, i, j):
    """A segment's score from its whole span, None where the kind can't have it."""
    span, first = lines[i:j], lines[i]
    m = j - i
    head = [x.intro or x.header or x.said.forward for x in span]
    quoted = sum(x.quoted for x in span)
    if kind == E.A:
        return sum(-9.0 * x.quoted - 6.0 * x.said.device - 6.0 * x.said.footer for x in span) - 40.0 * sum(head)
    sep = first.said.sep
    if kind == E.Q:
        if first.intro or first.header or first.said.forward or (sep and i + 1 < len(lines) and lines[i + 1].header):
            k = i
            while k < len(lines) and (lines[k].intro or lines[k].header or lines[k].said.forward or lines[k].said.sep):
                k += 1
            if k < len(lines) and not lines[k].quoted and not (lines[k].html and not first.html):
                return 2.0 * m + 4.5 * quoted + 3.0 if j == len(lines) else None
            rest = sum(not x.quoted and not h and (first.html or not x.html) for x, h in zip(span, head)) - sep
            return 4.0 * (m - rest) + 2.0 - 9.0 * rest
        return 6.0 * quoted - 9.0 * (m - quoted) + 0.5
    if quoted or any(head):
        return None
    value = [sum(odds[kind][b] for b in features(x.said)) * 6.0 / max(6.0, len(features(x.said))) * (not x.said.sep) for x in span]
    s = -E.OVER_LENGTH * max(0, m - E.USUAL_LENGTH[kind])
    talk = [x.said.greeting or x.said.closing for x in span]
    edge = 0.0 if not sep else (3.0 if kind == E.S else 2.0) if m > 1 and not lines[i + 1].gap else -6.0
    if kind == E.S:
        if any(talk) or any(x.said.words == 1 and k > 0 and lines[k - 1].said.closing for k, x in enumerate(span, i)):
            return None
        s += E.WORDS_S * sum(value) + sum(5.0 * x.said.device - 3.0 * x.said.footer for x in span) - 3.0 * sum(x.gap for x in span[1:])
        s += E.CUES_S * sum(odds[E.S][E.BUCKETS + c] for x in span for c in E.cues(x, names) if c < 4)
        return s + edge + (0.5 if first.gap else -0.5 if first.html or sep or first.said.device else -2.5)
    legal, words, footer = sum(x.said.legal for x in span), max(1, sum(x.said.words for x in span)), sum(x.said.footer for x in span)
    s += E.WORDS_D * sum(value) + 5.0 * footer - 4.0 * sum(x.gap for x in span[1:]) - 4.0 * sum(talk)
    s += (4.0 if first.said.notice and legal / words > 0.04 else 0.0) + 3.0 * min(3, legal) * (1.0 if legal / words > 0.05 else 0.2) - (4.0 if not footer and legal < 2 else 0.0)
    return s + edge + (0.5 if first.gap else -1.5)


def best_score(lines, odds, names):
    """The best segmentation's score, every segment tried."""
    starts, features = E._borders(lines), E._Features()
    best = [{E.A: 0.0, E.Q: 0.0, E.S: -1.0, E.D: -1.0}]
    for b, j in enumerate(starts[1:], 1):
        best.append({})
        for kind in range(4):
            for c in range(b):
                s = segment_score(lines, odds, features, names, kind, starts[c], j)
                if s is not None:
                    s += max(v - (0.0 if k == kind or not c else E.NEW_SEGMENT) - (E.AFTER_SIGNATURE if c and kind == E.A and k == E.S else 0.0) for k, v in best[c].items())
                    best[b][kind] = max(s, best[b].get(kind, -1e9))
    return max(best[-1].values())


def test_decoder_against_all_segmentations():
    r = random.Random(9)
    pool = [*PROSE, *SIG.split("\n"), *LEGAL.split("\n"), "-- ", "", "", "> old", ">> older", "Cheers,", "Ann", "Hi Bo,", "On 2020-01-01 10:00, Bo Hill wrote:", "From: Bo <bo@hill.example>", "Sent: Monday", "Begin forwarded message:", "<div>hm</div>", "Sent from my phone", "You get this because you are on the choir list.", "________", "***", "Ok."]
    odds = [[r.gauss(0, 0.6) for _ in range(E.WIDTH)] for _ in range(4)]
    for _ in range(150):
        lines = E.lines_of("\n".join(r.choice(pool) for _ in range(r.randint(1, 25))))
        if not lines:
            continue
        features, names = E._Features(), E.names_of("Ann Mill")
        got = E.decode(lines, odds, features, "Ann Mill")
        # the kinds that came out must score what the best segmentation scores: segments of one kind may be cut in several ways
        keep = [[k == g for k in range(4)] for g in got]
        starts = E._borders(lines)
        best = [{E.A: 0.0, E.Q: 0.0, E.S: -1.0, E.D: -1.0}]
        for b, j in enumerate(starts[1:], 1):
            best.append({})
            for c in range(b):
                for kind in range(4):
                    if all(keep[x][kind] for x in range(starts[c], j)):
                        s = segment_score(lines, odds, features, names, kind, starts[c], j)
                        if s is not None and best[c]:
                            s += max(v - (0.0 if k == kind or not c else E.NEW_SEGMENT) - (E.AFTER_SIGNATURE if c and kind == E.A and k == E.S else 0.0) for k, v in best[c].items())
                            best[b][kind] = max(s, best[b].get(kind, -1e9))
        assert abs(max(best[-1].values()) - best_score(lines, odds, names)) < 1e-6


def test_long_bodies_and_long_spans(mails):
    odds = E.word_odds(E.count_words(mails).toPandas()).tolist()
    block = f"{PROSE[0]}\nFine.\n\n> quoted\n\nOk then.\n{PROSE[1]}\n\n"
    body = block * 600 + "Regards,\nAnn"
    began = time.perf_counter()
    lines = E.lines_of(body)
    kinds = E.decode(lines, odds, E._Features(), "Ann Mill")
    assert len(lines) > 3000 and time.perf_counter() - began < 3
    assert all((k == E.Q) == ln.quoted for k, ln in zip(kinds, lines))
    notice = [f"This message may contain confidential information number {i}; copying or disclosure by other recipients is prohibited." for i in range(30)]
    lines = E.lines_of(PROSE[0] + "\n\n" + "\n".join(notice))
    assert E.decode(lines, odds, E._Features(), "Ann Mill") == [E.A] + [E.D] * 30
    lines = E.lines_of(PROSE[0] + "\n\nOn Friday the 18th of January 2013,\nat twenty to four in the\nafternoon, our neighbour\nBo Hill\n<bo@hill.example> wrote:\n> old")
    assert E.decode(lines, odds, E._Features(), "Ann Mill") == [E.A] + [E.Q] * 6
