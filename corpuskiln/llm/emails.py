"""The text that an e-mail's sender newly wrote.

Method: a semi-Markov model over the lines of a body.  A body is cut into
segments of four kinds (authored, quoted, signature, disclaimer); the best
segmentation is found by dynamic programming over segment ends.  A segment is
scored by the words and cues of its lines (log-odds learned from the corpus),
by its length (beyond the usual one each line costs more, none is too many), by
cues at its borders (separators, attributions, header blocks, blank lines, the
body's end) and by the whole span (one prefix throughout, the density of legal
words).

The log-odds of words and of the cues "contact data", "the sender's name" and
"many words" are trained on all mails: what leaves no doubt (lines below a
``--``, blocks with contact data, paragraphs dense with legal words) labels
lines, and words and cues are counted by label.  Words are hashed into
``BUCKETS`` buckets, so counts of any corpus fit into one small array.  The
weights of borders and quotation marks are set by hand, below.

Shape at scale: two narrow passes over whole bodies; the counts are summed by
bucket before they reach the driver.  A body's work grows with its lines.
Bodies are shuffled only where a table comes in fewer splits than there are
cores.

Nulls and empty bodies have no lines and give nothing.  Line ends may be LF or
CR LF.  Repeated deliveries are rows of their own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.session import spread

BUCKETS = 1 << 14
A, Q, S, D = range(4)
KINDS = ["authored", "quoted", "signature", "disclaimer"]

# --- cues -----------------------------------------------------------------

_PREFIX = re.compile(r"^(?:\s*(?:[>|»]|[A-Z]{1,3}>)\s?)+")
_TAG = re.compile(r"</?(?:div|p|br|span|font|b|i|u|a|html|body|blockquote|pre|table|tr|td)\b[^>\n]*>", re.I)
_DATE = r"(?=.*\d)"
_INTRO = re.compile(
    r"^(?:-+ ?)?(?:" + _DATE + r"(?:On|Am|Le|El|At|Em|Il|Den|Op)\s.{3,240}?\b(?:wrote|schrieb|écrit|escribió|said|writes|escreveu|ha scritto)\b[^:]{0,120}:"
    + r"|" + _DATE + r"[^:]{2,110}(?:\s<\S+@\S+>)?\s(?:wrote on|schrieb am|escribió el|a écrit le|said on)\s[\d][\d.\-/: ]*:"
    + r"|[^:]{0,110}<\S+@\S+>\s(?:wrote|schrieb|a écrit|escribió|said)\s?:)$"
)
_INTRO_WORD = re.compile(r"^(?:-+ ?)?(?:On|Am|Le|El|At|Em|Il|Den|Op)\s")
_FORWARD = re.compile(
    r"^(?:[-_=~*> ]{2,}\s?(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|mensaje reenviado|mensaje original|message transféré|message d'origine|message original|messaggio originale)\s?[-_=~* ]{2,}"
    r"|begin forwarded message ?:|\[forwarded\]|anfang der weitergeleiteten nachricht ?:|début du message transféré ?:|(?:inicio|comienzo) del mensaje reenviado ?:|-+ ?forwarded by .*)$",
    re.I,
)
_HEADER = re.compile(r"^\*?(?P<k>From|Von|De|Sent|Gesendet|Envoyé|Enviado(?: el)?|To|An|À|Para|Cc|Kopie|Date|Datum|Fecha|Subject|Betreff|Asunto|Objet|Reply-To) ?:\*?\s*(?P<v>.*)$")
_ADDRESS = re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")
_URL = re.compile(r"(?:https?://|www\.)\S+")
_TEL = re.compile(r"(?:\+\d[\d ().\-]{6,}\d|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}|\d{4,5} \d{6})")
_SEP = re.compile(r"^(?:--\s?|_{4,}|-{3,}|={3,}|\*{4,}|~{3,}|#{3,})$")
_DEVICE = re.compile(
    r"^(?:sent (?:from|via|with|using)\b.{2,60}|(?:von|mit) (?:meinem|meiner)\b.{2,50}gesendet\.?|gesendet (?:von|mit|über)\b.{2,50}|enviado (?:desde|con)\b.{2,50}|envoyé (?:de|depuis|avec|à partir)\b.{2,50}|get \S.{2,40} for (?:mobile|ios|android)\b.*|inviato da\b.{2,50}|typed with .{2,50}|diese nachricht wurde von .{2,40} gesendet\.?)$",
)
_FOOTER = re.compile(
    r"(?:^you (?:get|receive|are receiving) this\b.*(?:list|because|subscrib)|^to (?:leave|unsubscribe|stop)\b.*(?:https?://|www\.|@|:)|^unsubscribe\b|^this e-?mail (?:was|has been) (?:checked|scanned)\b|^scanned by\b|\bno (?:threats|virus(?:es)?) found\b|^virus-free\b|^(?:sie erhalten|abmelden|para darse de baja|pour vous désabonner|se désabonner)\b)",
)

# these are matched with lower-case text
#: Words of legal notices, by stem, and what such notices are called.
LEGAL = re.compile(
    r"\b(?:confidential\w*|privileged|intended (?:solely|only)|meant only|addressee\w*|recipients?|disclos\w+|prohibited|liabilit\w+|transmission|disclaimer|copying|dissemination|unauthori[sz]ed|attachments?|delete it|in error|views expressed|before printing"
    r"|vertraulich\w*|empfänger\w*|weitergabe|untersagt|irrtümlich\w*|anlagen|verständigen|unzulässig"
    r"|confidencial\w*|destinatari\w*|prohibid\w*|difusión|bórrelo|remitente"
    r"|confidentiel\w*|destinataires?|interdite?s?|diffusion|supprimer|supprimez|expéditeur)\b",
)
_NOTICE = re.compile(r"^\s*(?:\*{3}\s|(?:confidentiality notice|legal note|legal notice|disclaimer|notice|hinweis|rechtlicher hinweis|aviso legal|aviso|avis|avis de confidentialité|mention légale|vertraulichkeitshinweis)\s?[:–\-])")
_GREETING = re.compile(r"^(?:hi|hello|hey|dear|hola|buenos días|buenas tardes|hallo|liebe|lieber|guten (?:morgen|tag|abend)|bonjour|salut|chère?|good (?:morning|day|evening)|moin|estimad[oa])\b.{0,40}$")
_CLOSING = re.compile(r"^(?:best|best (?:regards|wishes)|kind regards|regards|cheers|thanks|many thanks|thank you|warmly|talk soon|yours|sincerely|love|take care|viele grüße|liebe grüße|mit freundlichen grüßen|gruß|danke|un saludo|saludos|abrazos|gracias|cordialement|merci|bien à toi|à bientôt|amitiés|bises)[,.!]?$")
_WROTE = re.compile(r"\b(?:wrote|schrieb|écrit|escribió|said|writes|escreveu|ha scritto)\b")
_DIGIT = re.compile(r"\d")
_FORWARD_WORDS = ("begin ", "anfang ", "début ", "inicio ", "comienzo ")
_DEVICE_WORDS = ("sent ", "von ", "mit ", "gesendet ", "enviado ", "envoyé ", "get ", "inviato ", "typed ", "diese ")
_FOOTER_WORDS = ("you ", "to ", "unsubscribe", "this e", "scanned by", "virus", "sie ", "abmelden", "para ", "pour ", "se ")
#: Characters beyond which no attribution matches.
_LONGEST = 420
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


class Said:
    """What a line's text says by itself; lines of the same text share it."""

    __slots__ = ("text", "forward", "sep", "device", "footer", "greeting", "closing", "contact", "legal", "words", "notice", "head", "buckets", "odds")

    def __init__(self, text: str):
        low = text.lower()
        self.text = text
        self.words = len(text.split())
        self.forward = bool(_FORWARD.match(text)) if text[:1] in "-_=~*> \t[" or low.startswith(_FORWARD_WORDS) else False
        self.sep = bool(_SEP.match(text))
        self.device = bool(_DEVICE.match(low)) if low.startswith(_DEVICE_WORDS) else False
        self.footer = bool(_FOOTER.search(low)) if low.startswith(_FOOTER_WORDS) or " found" in low else False
        self.greeting = bool(_GREETING.match(low))
        self.closing = bool(_CLOSING.match(low)) if self.words <= 4 else False
        self.contact = bool(_DIGIT.search(text) and _TEL.search(text)) + bool("@" in text and _ADDRESS.search(text)) + bool(("://" in text or "www." in text) and _URL.search(text))
        self.legal = len(LEGAL.findall(low)) if self.words > 1 else 0
        self.notice = bool(_NOTICE.match(low))
        self.head = _HEADER.match(text) if ":" in text else None
        self.buckets: list[int] | None = None
        self.odds: tuple[float, float] | None = None


class Line:
    """One line of a body that isn't blank: what it says, and its place among the others."""

    __slots__ = ("no", "said", "quoted", "html", "gap", "intro", "header")

    def __init__(self, no: int, said: Said, quoted: bool, html: bool, gap: bool):
        self.no, self.said, self.quoted, self.html, self.gap = no, said, quoted, html, gap
        self.intro = self.header = False

    @property
    def text(self) -> str:
        return self.said.text


class Reader:
    """Takes bodies apart into lines; texts that come again are read once, as far as ``KEPT`` of them go."""

    KEPT = 100_000

    def __init__(self) -> None:
        self.known: dict[str, Said] = {}

    def said(self, text: str) -> Said:
        got = self.known.get(text)
        if got is None:
            got = Said(text)
            if len(self.known) < self.KEPT:
                self.known[text] = got
        return got

    def __call__(self, body: str) -> list[Line]:
        """The lines that aren't blank; attributions and header blocks are marked over all their lines."""
        out: list[Line] = []
        depth, gap = 0, True
        for no, raw in enumerate(body.split("\n"), 1):
            bare = raw.strip()
            if not bare:
                gap = True
                continue
            html = inside = False
            if "<" in raw or depth:
                low = raw.lower()
                html = bare[0] == "<" and bool(_TAG.match(bare))
                opened, closed = low.count("<blockquote"), low.count("</blockquote")
                inside = depth > 0 or opened > 0 or closed > 0
                depth = max(0, depth + opened - closed)
                if html:
                    bare = _TAG.sub("", raw).strip()
            m = _PREFIX.match(bare) if bare[:1] in ">|»" or (">" in bare[:8] and bare[:1].isupper()) else None
            if not bare and not inside:
                gap = True  # mark-up alone
                continue
            out.append(Line(no, self.said(bare[m.end() :].strip() if m else bare), inside or bool(m), html, gap))
            gap = False
        _mark_attributions(out)
        _mark_headers(out)
        return out


_readers: dict[str, Reader] = {}


def _reader(job: str) -> Reader:
    """The reader of this process for a job, so that its second pass needn't read again what its first one did."""
    if job not in _readers:
        _readers.clear()
        _readers[job] = Reader()
    return _readers[job]


def _mark_attributions(lines: list[Line]) -> None:
    """An attribution ends with a colon and begins in the same paragraph, with a word that attributions begin with, or else as late as it can."""
    for j, last in enumerate(lines):
        if last.quoted or not last.text.endswith(":"):
            continue
        joined, start, i = "", None, j
        while i >= 0 and not lines[i].quoted and not lines[i].intro:
            joined = lines[i].text + (" " + joined if joined else "")
            if i == j - 1 and start is None and not _WROTE.search(joined):
                break
            if _INTRO.match(joined):
                worded = bool(_INTRO_WORD.match(lines[i].text))
                if start is None or worded:
                    start = i
                if worded:
                    break
            if lines[i].gap or len(joined) > _LONGEST:
                break
            i -= 1
        if start is not None:
            for k in range(start, j + 1):
                lines[k].intro = True


def _mark_headers(lines: list[Line]) -> None:
    i, n = 0, len(lines)
    while i < n:
        j, keys, addressed = i, set(), False
        while j < n and not lines[j].quoted and (j == i or not lines[j].gap) and (m := lines[j].said.head):
            keys.add(m["k"])
            addressed |= m["k"] in ("From", "Von", "De") and bool(_ADDRESS.search(m["v"]))
            j += 1
        if j - i >= 2 and len(keys) >= 2 and addressed:
            for k in range(i, j):
                lines[k].header = True
        i = max(j, i + 1)


def lines_of(body: str) -> list[Line]:
    return Reader()(body)


# --- word log-odds --------------------------------------------------------


def _bucket(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h >> 7) % BUCKETS


#: Cues of a line whose log-odds are learned like those of words; their buckets follow the words'.
CUES = ["contact", "contacts", "named", "wordy", "apart", "inner"]
WIDTH = BUCKETS + len(CUES)


class _Features:
    """Buckets of a line's words and shapes; words are hashed once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, said: Said) -> list[int]:
        if said.buckets is not None:
            return said.buckets
        t = said.text
        if "@" in t or "://" in t or "www." in t:
            t = _ADDRESS.sub(" EMAIL ", _URL.sub(" URL ", t))
        shapes = ["#short" if len(t) < 42 else "#long", "#caps" if t.isupper() and len(t) > 3 else "#mixed", "#stop" if t[-1:] in ".!?" else "#open", "#boxed" if t[:1] == "[" and t[-1:] == "]" else "#plain"]
        out = []
        for w in [*shapes, *("0" if x[0] in "0123456789" else x for x in _TOKEN.findall(t.lower()))]:
            k = self.known.get(w)
            if k is None:
                k = _bucket(w)
                if len(self.known) < 200_000:
                    self.known[w] = k
            out.append(k)
        said.buckets = out
        return out


def names_of(sender: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]{3,}", sender)]


def named(said: Said, names: list[str]) -> bool:
    """Whether a short line has two words of the sender's name."""
    if said.words > 8 or len(names) < 2:
        return False
    low = said.text.lower()
    return sum([w in low for w in names]) > 1


def cues(ln: Line, names: list[str]) -> list[int]:
    """Which of ``CUES`` a line shows, by number."""
    said = ln.said
    out = [1 if said.contact > 1 else 0] if said.contact else []
    if named(said, names):
        out.append(2)
    if said.words > 9 and not said.device:
        out.append(3)
    out.append(4 if ln.gap else 5)
    return out


def seed_labels(lines: list[Line]) -> list[int | None]:
    """Labels that cues leave no doubt about; quoted lines are judged like others, so that quotes teach too."""
    out: list[int | None] = [None] * len(lines)
    below = 0
    block: list[int] = []

    def close() -> None:
        if not block:
            return
        legal = sum(lines[i].said.legal for i in block)
        words = sum(lines[i].said.words for i in block)
        if legal >= 2 and legal * 14 >= words and not any(lines[i].said.greeting for i in block):
            kind = D
        elif any(lines[i].said.contact for i in block) and all(lines[i].said.words <= 8 for i in block) and len(block) <= 6:
            kind = S
        else:
            kind = A
        for i in block:
            if out[i] is None:
                out[i] = kind
        block.clear()

    for i, ln in enumerate(lines):
        if ln.gap:
            close()
            below = 0
        if ln.intro or ln.header or ln.said.forward or not ln.text:
            close()
            out[i] = Q
            below = 0
        elif ln.said.device or ln.said.footer:
            if ln.said.device and not ln.gap and 0 < len(block) <= 3 and all(lines[k].said.words <= 6 for k in block):
                for k in block:  # what stands right above "Sent from ..."
                    out[k] = S
                block.clear()
            close()
            out[i] = S if ln.said.device else D
        elif ln.said.sep:
            close()
            below, out[i] = 5, None
        elif below and ln.said.words <= 8:
            below -= 1
            out[i] = S
        else:
            below = 0
            block.append(i)
    close()
    return out


def count_words(mails: DataFrame, job: str = "") -> DataFrame:
    """``(label, bucket, n)`` over all bodies; at most three times ``WIDTH`` rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, features, read = np.zeros((4, WIDTH), np.int64), _Features(), _reader(job) if job else Reader()
        for pdf in batches:
            seen: list[list[int]] = [[], [], [], []]
            for body, sender in zip(pdf["raw_body"], pdf["from_name"]):
                lines, names = read(body), names_of(sender or "")
                for ln, k in zip(lines, seed_labels(lines)):
                    if k is not None and k != Q:
                        seen[k] += features(ln.said)
                        seen[k] += [BUCKETS + c for c in cues(ln, names)]
            for k in (A, S, D):
                table[k] += np.bincount(seen[k], minlength=WIDTH)
        at = np.nonzero(table)
        yield pd.DataFrame({"label": at[0].astype("int32"), "bucket": at[1].astype("int32"), "n": table[at]})

    part = spread(mails.select("raw_body", "from_name").filter("raw_body is not null and raw_body <> ''")).mapInPandas(count, "label int, bucket int, n long")
    return part.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def word_odds(counts: pd.DataFrame) -> np.ndarray:
    """Log-odds of each word bucket, and of each cue, for signature and disclaimer against authored text, bounded."""
    n = np.zeros((4, WIDTH))
    if len(counts):
        n[counts["label"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    lines = n[:, BUCKETS + 4 : BUCKETS + 6].sum(1, keepdims=True)  # every line stands apart or doesn't
    share = (n[:, BUCKETS:] + 0.5) / (lines + 1.0)
    n = n[:, :BUCKETS]
    # each kind is mixed with all kinds by the same weight, so that a word never seen speaks for none
    q = (n[[A, S, D]].sum(0) + 0.01) / (n[[A, S, D]].sum() + 0.01 * BUCKETS)
    p = np.log(0.8 * n / np.maximum(n.sum(1, keepdims=True), 1.0) + 0.2 * q)
    out = np.zeros((4, WIDTH))
    for k in (S, D):
        out[k, :BUCKETS] = p[k] - p[A]
        if lines[k, 0] and lines[A, 0]:
            out[k, BUCKETS:] = np.log(share[k]) - np.log(share[A])
    return np.clip(out, -3.0, 3.0)


# --- the model ------------------------------------------------------------

#: Usual lines of a segment, and what each further one costs.
USUAL_LENGTH = {S: 6, D: 9}
OVER_LENGTH = 3.0
NEW_SEGMENT = 2.0
AFTER_SIGNATURE = 4.0
#: Weights of learned log-odds: of the words for signature and disclaimer, and of the cues.
WORDS_S, WORDS_D, CUES_S = 1.0, 0.6, 0.8
_NEVER = -1e18


def _borders(lines: list[Line]) -> list[int]:
    """Where segments may begin, and the end; inside a run of marked lines none does."""
    out, prev = [0], lines[0]
    for i in range(1, len(lines)):
        ln = lines[i]
        if not (ln.quoted and prev.quoted):
            s, p = ln.said, prev.said
            if (
                ln.gap or ln.quoted != prev.quoted or s.words <= 5 or p.words <= 5 or ln.html != prev.html or ln.intro != prev.intro or ln.header != prev.header or s.forward or p.forward or s.sep or p.sep or p.closing
                or s.device or p.device or s.footer or p.footer or s.notice or s.text[:1] in "[~"
            ):
                out.append(i)
        prev = ln
    out.append(len(lines))
    return out


def decode(lines: list[Line], odds: list[list[float]], features: _Features, sender: str = "") -> list[int]:
    """The kind of each line, by the best segmentation.

    The scores of authored and quoted segments are sums over lines, so the
    best one that ends at a border follows from the best at the border before.
    Signatures and disclaimers have features of the whole span; their starts
    are tried from the nearest on, until none further back can win.
    """
    n = len(lines)
    if not n:
        return []
    names = names_of(sender)
    odds_s, odds_d, cue = odds[S].__getitem__, odds[D].__getitem__, odds[S][BUCKETS:]
    starts = _borders(lines)
    # at each border the sums over the lines before it: what they say for a signature and a disclaimer, legal words, words and footers,
    # authored, quoted by prefix, quoted below an attribution (in text and mark-up, in text alone), quoted to the end;
    # and from which line on a span up to here is without what a signature or a disclaimer can't have
    at: list[tuple] = []
    f_s = f_d = sum_a = sum_q = sum_c = sum_h = sum_o = 0.0
    legal = words = footers = wall_s = wall_d = 0
    closed = any_html = False
    for i, ln in enumerate(lines):
        if i == starts[len(at)]:
            at.append((f_s, f_d, legal, words, footers, sum_a, sum_q, sum_c, sum_h, sum_o, wall_s, wall_d))
        said = ln.said
        talk = said.greeting or said.closing
        if said.odds is None:
            f = features(said)
            scale = 6.0 / max(6.0, len(f))  # words of a line depend on each other
            s, d = (0.0, 0.0) if said.sep else (sum(map(odds_s, f)) * scale, sum(map(odds_d, f)) * scale)
            known = CUES_S * ((cue[1] if said.contact > 1 else cue[0] if said.contact else 0.0) + (cue[3] if said.words > 9 and not said.device else 0.0))
            said.odds = (WORDS_S * s + 5.0 * said.device - 3.0 * said.footer + known, WORDS_D * d + 5.0 * said.footer - 4.0 * talk)
        s, d = said.odds
        f_s += s
        f_d += d
        if ln.gap:
            f_s -= 3.0
            f_d -= 4.0
        if names and named(said, names):
            f_s += CUES_S * cue[2]
        legal += said.legal
        words += said.words
        footers += said.footer
        head = ln.intro or ln.header or said.forward
        if head:
            sum_a -= 40.0
        if said.device or said.footer:
            sum_a -= 6.0 * (said.device + said.footer)
        sum_o += 2.0
        if ln.quoted:
            sum_a -= 9.0
            sum_q += 6.0
            sum_o += 4.5
        else:
            sum_q -= 9.0
        rest = not ln.quoted and not head
        sum_c += -9.0 if rest and not ln.html else 4.0
        sum_h += -9.0 if rest else 4.0
        any_html |= ln.html
        if ln.quoted or head:
            wall_s = wall_d = i + 1
        elif talk or (closed and said.words == 1):
            wall_s = i + 1
        closed = said.closing
    at.append((f_s, f_d, legal, words, footers, sum_a, sum_q, sum_c, sum_h, sum_o, wall_s, wall_d))

    def opens(i: int) -> bool | None:
        """Whether what an attribution or header block at ``i`` brings in carries no prefix of its own; None where none is."""
        ln = lines[i]
        if not (ln.intro or ln.header or ln.said.forward or (ln.said.sep and i + 1 < n and lines[i + 1].header)):
            return None
        j = i
        while j < n and (lines[j].intro or lines[j].header or lines[j].said.forward or lines[j].said.sep):
            j += 1
        return j < n and not lines[j].quoted and not (lines[j].html and not ln.html)

    def begin(i: int) -> tuple[float, float]:
        """What the first line of a signature or disclaimer adds, at most."""
        ln = lines[i]
        s = (0.5 if ln.gap else -0.5 if ln.html or ln.said.sep or ln.said.device else -2.5) + 3.0 * ln.gap
        d = (0.5 if ln.gap else -1.5) + 4.0 * ln.gap
        return s, d

    def edge(i: int, j: int, good: float) -> float:
        """A separator heads a span, it doesn't stand alone."""
        return good if j - i > 1 and not lines[i + 1].gap else -6.0

    def disclaimer(c: int, b: int) -> float:
        many = at[b][2] - at[c][2]
        density = many / max(1, at[b][3] - at[c][3])
        return (4.0 if lines[starts[c]].said.notice and density > 0.04 else 0.0) + 3.0 * min(3, many) * (1.0 if density > 0.05 else 0.2) - (4.0 if at[b][4] == at[c][4] and many < 2 else 0.0)

    # best segmentations up to a border by their last kind, where that segment began, and the kind before it
    best: list[list[float]] = [[0.0, 0.0, -1.0, -1.0]]
    back: list[list[tuple[int, int]]] = [[(0, A)] * 4]
    running = [(_NEVER, 0, A)] * 4  # authored, quoted by prefix, quoted below an attribution (two ways): score less the sum, start, kind before
    enter: list[list[tuple[float, int]]] = []  # by border and kind: the best before a segment that begins there
    far: list[tuple[float, float]] = []  # the most that starts up to here can bring to a signature, a disclaimer
    openings: list[int] = []
    begins: list[tuple[float, float]] = []
    for b in range(1, len(starts)):
        i, j = starts[b - 1], starts[b]
        came = []
        if i:
            a, q, u, d = best[b - 1]
            other_a = (Q, q - NEW_SEGMENT) if q >= d else (D, d - NEW_SEGMENT)
            if u - AFTER_SIGNATURE - NEW_SEGMENT > other_a[1]:
                other_a = (S, u - AFTER_SIGNATURE - NEW_SEGMENT)
            top = max(a, q, u, d)
            other = (D if d == top else S if u == top else Q if q == top else A, top - NEW_SEGMENT)
        for kind in (A, Q, S, D):
            if not i:
                came.append((0.0, A))
            else:
                k, v = other_a if kind == A else other
                same = best[b - 1][kind]
                came.append((same, kind) if same >= v else (v, k))
        enter.append(came)
        first, ln = opens(i), lines[i]
        here, there = at[b - 1], at[b]
        tries = [(0, A, 0.0)]
        if first is None:
            tries.append((1, Q, 0.5))
        elif first:
            openings.append(b - 1)
        else:
            tries.append((2 if any_html and not ln.html else 3, Q, 2.0 + 13.0 * ln.said.sep))
        for way, kind, bonus in tries:
            v = came[kind][0] + bonus - here[5 + way]
            if v > running[way][0]:
                running[way] = (v, b - 1, came[kind][1])
        s0, d0 = begin(i)
        begins.append((s0, d0))
        reach_s = came[S][0] - here[0] + OVER_LENGTH * i + s0 + 3.0 * ln.said.sep
        reach_d = came[D][0] - here[1] + OVER_LENGTH * i + d0 + 13.0 + 2.0 * ln.said.sep
        before = far[-1] if far else (_NEVER, _NEVER)
        far.append((max(before[0], reach_s), max(before[1], reach_d)))
        now = [_NEVER] * 4
        whence = [(0, A)] * 4
        now[A] = running[0][0] + there[5]
        whence[A] = running[0][1:]
        for way in (1, 2, 3):
            v = running[way][0] + there[5 + way]
            if v > now[Q]:
                now[Q], whence[Q] = v, running[way][1:]
        if j == n:
            for o in openings:  # an open quotation runs to the end, whatever it quotes itself
                v = enter[o][Q][0] + there[9] - at[o][9] + 3.0
                if v > now[Q]:
                    now[Q], whence[Q] = v, (o, enter[o][Q][1])
        for kind, way, good in ((S, 0, 3.0), (D, 1, 2.0)):
            c, wall, usual, f = b - 1, there[10 + way], USUAL_LENGTH[kind], there[way]
            while c >= 0 and starts[c] >= wall:
                if now[kind] >= far[c][way] + f - OVER_LENGTH * (j - usual):
                    break
                x = starts[c]
                v = enter[c][kind][0] + f - at[c][way] - OVER_LENGTH * max(0, j - x - usual) + begins[c][way]
                if lines[x].said.sep:
                    v += edge(x, j, good)
                if kind == D:
                    v += disclaimer(c, b)
                if v > now[kind]:
                    now[kind], whence[kind] = v, (c, enter[c][kind][1])
                c -= 1
        best.append(now)
        back.append(whence)
    out = [A] * n
    b = len(starts) - 1
    kind = max(range(4), key=lambda k: (best[b][k], k))
    while b > 0:
        c, before = back[b][kind]
        out[starts[c] : starts[b]] = [kind] * (starts[b] - starts[c])
        b, kind = c, before
    return out


def _fit(mails: DataFrame, job: str) -> np.ndarray:
    return word_odds(count_words(mails, job).toPandas())


def segments(mails: DataFrame) -> DataFrame:
    """``(id, line_no, kind, text)`` of every line that isn't blank."""
    job = uuid.uuid4().hex
    odds = mails.sparkSession.sparkContext.broadcast(_fit(mails, job))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, reader, odds_ = _Features(), _reader(job), odds.value.tolist()
        for pdf in batches:
            rows = []
            for key, body, sender in zip(pdf["id"], pdf["raw_body"], pdf["from_name"]):
                lines = reader(body)
                rows += [(key, ln.no, KINDS[k], ln.text) for ln, k in zip(lines, decode(lines, odds_, features, sender or ""))]
            yield pd.DataFrame(rows, columns=["id", "line_no", "kind", "text"])

    return spread(mails.select("id", "raw_body", "from_name").filter("raw_body is not null and raw_body <> ''")).mapInPandas(read, "id string, line_no int, kind string, text string")


def old_lines(mails: DataFrame) -> DataFrame:
    """``(id, line_no)`` of the lines that the sender didn't newly write."""
    return segments(mails).filter("kind <> 'authored'").select("id", "line_no")


def stripped(mails: DataFrame) -> DataFrame:
    """``(id, stripped_body)``: only what the sender newly wrote; '' where that is nothing."""
    job = uuid.uuid4().hex
    odds = mails.sparkSession.sparkContext.broadcast(_fit(mails, job))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, reader, odds_ = _Features(), _reader(job), odds.value.tolist()
        for pdf in batches:
            out = []
            for body, sender in zip(pdf["raw_body"], pdf["from_name"]):
                lines = reader(body or "")
                drop = {ln.no for ln, k in zip(lines, decode(lines, odds_, features, sender or "")) if k != A}
                kept = [x.rstrip("\r") for no, x in enumerate((body or "").split("\n"), 1) if no not in drop]
                out.append(re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip())
            yield pd.DataFrame({"id": pdf["id"], "stripped_body": out})

    return spread(mails.select("id", "raw_body", "from_name")).mapInPandas(read, "id string, stripped_body string")
