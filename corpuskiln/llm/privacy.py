"""Personal information in free text: found, and replaced by typed placeholders.

Method: information-theoretic sanitisation.  Every text gives *candidates*:
spans whose shape could be an e-mail address, phone number, identity number,
street address or full name.  Some shapes prove their kind (``+44 ...``,
``123-45-6789``); others don't (ten bare digits may be a phone or a parcel
code, two lower-case words a name or a sentence).  For these the corpus says
how strongly the words beside them, or the words themselves, reveal a
protected entity:

* the disclosure of a context word is the log-odds of standing beside a proven
  number against standing beside an unproven one; an unproven number counts
  if the disclosure of its contexts adds up to more than ``THRESHOLD``;
* a family name written in lower case, or before the given name, counts if it
  occurs capitalised after given names whose entropy is at least ``MIN_ENTROPY`` bits, is a known
  contact's, or begins and ends as many such names do: a word that follows
  one name only ("rose beds") reveals nobody;
* a street in lower case counts if the corpus also writes it with a capital.

Given names are those of the contacts and what the corpus adds to them: a
capitalised word that stands before at least ``MIN_FAMILIES`` families (words
that follow several known given names), mostly before families, and hardly
before given names (as titles do).  A name of which neither part occurs with
another known one anywhere reveals itself to no count and isn't found.

Shape at scale: one JVM pass counts pairs of capitalised words, one Python pass
over the texts emits the few candidates, which are checkpointed.  To find
items no text is shuffled; :func:`sanitise` shuffles each text once, to keep
one copy of an id.  Context counts are hashed into ``BUCKETS`` buckets, so what
reaches the driver is bounded by construction; given names are refused beyond
``MAX_GIVEN_NAMES``.

Nulls: rows without id or text give nothing.  Repeated ids count once; where
copies of an id differ, all their items are listed, and the sanitised text is
that of one copy with its own items.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.session import cut_lineage

BUCKETS = 1 << 15
THRESHOLD = 0.0
MIN_ENTROPY = 0.9
MIN_ALIKE = 3
MAX_GIVEN_NAMES = 20_000
MIN_FAMILIES = 3

#: Titles, which stand before families too.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "señor", "señora", "don", "doña", "monsieur", "madame", "mme"]

_LEFT, _RIGHT = r"(?<![\w.\-/+#@])", r"(?![\d@])(?![.\-/,:]\d)"

_EMAIL = re.compile(r"(?<![\w.+\-@])[\w.+\-]*\w ?@ ?(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", re.A)
_SPELLED = re.compile(
    r"(?<![\w.+\-@])[\w+\-]+(?:\.[\w+\-]+)*(?: at | ?[(\[{]\s?(?:at|ät|arroba|@)\s?[)\]}] ?| arroba )[a-z0-9\-]+(?:(?: dot | punto | punkt | ?[(\[{]\s?(?:dot|punto|punkt|\.)\s?[)\]}] ?)[a-z0-9\-]+)+",
    re.I,
)
_PHONE = re.compile(
    _LEFT
    + r"(?:"
    + r"\+\d{8,15}(?!\d)"
    + r"|\+\d{1,3}(?:[ .\-](?:\(\d{1,5}\)|\d{1,8})){2,6}(?!\d)"
    + r"|\(\d{2,5}\) ?\d{3,4}[ .\-]?\d{3,8}(?!\d)"
    + r"|(?:1[ .\-])?\d{3}([.\-])\d{3}\1\d{4}" + _RIGHT
    + r"|0\d{2,4}/\d{5,9}" + _RIGHT
    + r"|0\d([. ])\d{2}(?:\2\d{2}){3}" + _RIGHT
    + r"|0\d{4} \d{6}" + _RIGHT
    + r"|0\d{2} \d{4} \d{4}" + _RIGHT
    + r"|(?P<open>\d{3} \d{3} \d{4}|\d{10})" + _RIGHT
    + r")"
)
_EXTENSION = re.compile(r" ?(?:ext\.?|x) ?\d{1,5}\b", re.I)

#: What numbers given by an authority to one person are called.
ID_LABELS = [
    r"social security(?: (?:number|no\.?))?", r"my social(?: is)?", r"ssn", r"ni (?:number|no\.?)", r"nino", r"national insurance(?: (?:number|no\.?))?", r"steuer-?id(?:entifikationsnummer)?", r"steuernummer", r"tax (?:id|number|no\.?)", r"tin", r"itin",
    r"(?:reise)?pass(?:port)?(?:-?nr\.?| (?:number|no\.?|nr\.?))?", r"driv(?:er'?s|ing) licen[cs]e(?: (?:number|no\.?))?", r"führerschein(?:-?nr\.?)?", r"(?:national )?identity card(?: (?:number|no\.?))?", r"id card(?: (?:number|no\.?))?", r"personalausweis(?:-?nr\.?)?", r"dni", r"nie", r"nif", r"carte d'identité", r"numéro de sécurité sociale",
]
_ID = re.compile(
    r"(?P<sure>" + _LEFT + r"\d{3}-\d{2}-\d{4}" + _RIGHT + r")"
    + r"|(?<![\w.\-/+#@])(?P<ni>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?!\w)"
    + r"|(?<![\w\-])(?:" + "|".join(ID_LABELS) + r")(?:\s?[:#=]\s?| is | )\s?(?P<labelled>[A-Z]{0,3}[ \-]?\d(?:[ \-/.]?[A-Z]?\d){4,16}(?: ?[A-Z])?(?![\w\-]))",
    re.I,
)

#: Kinds of streets.
STREET_TYPES = ["street", "str", "st", "road", "rd", "lane", "ln", "avenue", "ave", "close", "court", "ct", "way", "terrace", "drive", "dr", "boulevard", "blvd", "crescent", "square", "sq", "place", "grove", "gardens", "hill", "row", "walk", "mews", "parade", "highway", "parkway"]
_FLAT = r"(?:(?:flat|apt\.?|apartment|unit|suite|wohnung|whg\.?|piso|appt\.?|appartement)\s\w{1,5},?\s+)?"
_PLACE = r"(?:,\s(?:\d{4,5}\s)?[A-ZÄÖÜÉ][\wÀ-ÿ\-]+(?:\s\d{4,5}(?!\d))?)?"
_ADDRESS = re.compile(
    r"(?<![\w.\-/+#@:])(?:"
    + r"(?i:" + _FLAT + r"\d{1,5}[a-z]?[ ](?P<street>(?!(?:the|a|an|of|and|or|to|in|on|at|by)[ ])[a-zà-ÿ][\wà-ÿ'\-]*(?:[ ](?!(?:the|a|an|of|and|or|to|in|on|at|by)[ ])[a-zà-ÿ][\wà-ÿ'\-]*)??)[ ](?:" + "|".join(STREET_TYPES) + r")\b\.?)" + _PLACE
    + r"|(?i:" + _FLAT + r"\d{1,4}(?:[ ]?(?:bis|ter|[a-d]))?,?[ ](?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours)[ ](?:(?:de|du|des|la|le|les|d'|l')[ ]?){0,3})[A-ZÀ-Ý][\wÀ-ÿ'\-]+(?:[ ][A-ZÀ-Ý][\wÀ-ÿ'\-]+)*" + _PLACE
    + r"|(?:[A-ZÄÖÜ][a-zäöüß\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig)|[A-ZÄÖÜ][a-zäöüß]+-(?:Straße|Weg|Platz)|(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf dem|Auf der|Unter den|Hinter der|Hinter dem)[ ](?:[A-ZÄÖÜ][a-zäöüß]+[ ]?){1,3})[ ]?\d{1,4}[ ]?[a-z]?(?![\w\-])" + _PLACE
    + r"|(?i:(?:calle|avenida|avda\.?|plaza|paseo|camino|ronda|c/)[ ]?(?:(?:de|del|la|las|el|los)[ ]){0,3})(?:[A-ZÁÉÍÓÚÑ][\wÀ-ÿ\-]+[ ]?){1,4},?[ ]?\d{1,4}(?![\w\-])" + _PLACE
    + r")"
)

#: Blanks and hyphens that look like the plain ones; one character each, so positions stay.
SAME_LENGTH = {0xA0: " ", 0x2007: " ", 0x2009: " ", 0x202F: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0xFF20: "@"}

_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "tbl string, row_id string, h long, kind string, start_pos int, length int, proven boolean, contexts array<int>, given string, family string"


def _bucket(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % BUCKETS


def _contexts(text: str, a: int, b: int) -> list[int]:
    """Buckets of the words beside a span: one and two to the left, one to the right; '' at an end."""
    left = [w.lower() for w in _WORD.findall(text[max(0, a - 40) : a])][-2:]
    right = [w.lower() for w in _WORD.findall(text[b : b + 30])][:1]
    return [_bucket("<" + (left[-1] if left else "")), _bucket("<<" + " ".join(left)), _bucket(">" + (right[0] if right else ""))]


def name_pattern(given: list[str]) -> re.Pattern:
    """Given and family name together, in either order and any case."""
    g = "|".join(re.escape(x) for x in sorted(given, key=lambda x: (-len(x), x))) or r"(?!)"
    family = r"[^\W\d_]{3,}(?:['’][^\W\d_]{2,})?(?:-[^\W\d_]{3,})?"
    return re.compile(rf"(?<![\w\-@.+])(?:(?P<g>{g}) (?:[A-Z]\. )?(?P<f>{family})|(?P<f2>(?-i:[A-ZÀ-Ý]){family}), (?P<g2>(?-i:{g}))(?! (?-i:[A-ZÀ-Ý])))(?![\w@]|[.\-]\w+@)", re.I)


def spans(text: str, names: re.Pattern) -> Iterator[tuple]:
    """Candidates of one text: ``(kind, start, end, proven, contexts, given, family)``."""
    text = text.translate(SAME_LENGTH)
    digits = any(c.isdigit() for c in text)
    taken: list[tuple[int, int]] = []  # sorted, none overlaps another

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (a, b))
        if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
            return False
        taken.insert(i, (a, b))
        return True

    if "@" in text:
        for m in _EMAIL.finditer(text):
            if free(*m.span()):
                yield "email", m.start(), m.end(), True, [], None, None
    low = text.lower()
    if " at " in low or "(at" in low or "[at" in low or "{at" in low or "arroba" in low or "(ät" in low:
        for m in _SPELLED.finditer(text):
            if free(*m.span()):
                yield "email", m.start(), m.end(), True, [], None, None
    if digits:
        for m in _ID.finditer(text):
            k = m.lastgroup
            if k and free(*m.span(k)):
                yield "id_number", *m.span(k), True, [], None, None
        for m in _PHONE.finditer(text):
            if free(*m.span()):
                e = _EXTENSION.match(text, m.end())
                yield "phone", m.start(), e.end() if e else m.end(), m["open"] is None, _contexts(text, *m.span()), None, None
        for m in _ADDRESS.finditer(text):
            if free(*m.span()):
                street = m["street"]
                yield "address", m.start(), m.end(), street is None or street[0].isupper(), [], None, street and street.lower()
    for m in names.finditer(text):
        g, f = m["g"] or m["g2"], m["f"] or m["f2"]
        cased = g[0].isupper() and f[0].isupper()
        if (cased or (g.islower() and f.islower() and m["g"])) and free(*m.span()):
            # "Thanks, Ann" is written like "Millbrook, Ann": the family name has to be one
            yield "name", m.start(), m.end(), cased and m["g"] is not None, [], g.lower(), f.lower().split("-")[0]


def candidates(texts: DataFrame, given: list[str]) -> DataFrame:
    """Candidate spans of ``(tbl, row_id, text)``, see :data:`SCHEMA`."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = name_pattern(given)
        for pdf in batches:
            out = []
            for tbl, row, h, text in zip(pdf["tbl"], pdf["row_id"], pdf["h"], pdf["text"]):
                for kind, a, b, proven, contexts, g, f in spans(text, names):
                    out.append((tbl, row, h, kind, a, b - a, proven, contexts, g, f))
            yield pd.DataFrame(out, columns=["tbl", "row_id", "h", "kind", "start_pos", "length", "proven", "contexts", "given", "family"])

    return texts.filter("row_id is not null and text is not null and text <> ''").select("tbl", "row_id", F.xxhash64("text").alias("h"), "text").mapInPandas(find, SCHEMA)


def given_names(contacts: DataFrame) -> list[str]:
    """Given names of the contacts; the table is refused if it has more than a list can hold."""
    names = contacts.select(F.explode(F.array("display_name", "chat_name")).alias("n")).select(F.regexp_extract(F.trim("n"), r"^(\p{L}+)", 1).alias("g")).filter("length(g) > 1").distinct().limit(MAX_GIVEN_NAMES + 1).collect()
    if len(names) > MAX_GIVEN_NAMES:
        raise ValueError(f"more than {MAX_GIVEN_NAMES} given names: give a list instead")
    return sorted({r["g"].title() for r in names})


_PAIR = r"(?<![\p{L}\p{N}])(?=(\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}{2,}))"


def learned_names(texts: DataFrame, given: list[str]) -> list[str]:
    """Given names that the corpus adds: words that stand before families as the known given names do."""
    if not given:
        return []
    known = [g.lower() for g in given]
    pair = F.explode(F.regexp_extract_all("text", F.lit(_PAIR), F.lit(1))).alias("p")
    n = texts.filter("text is not null").select(pair).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    n = n.select(F.lower(F.substring_index("p", " ", 1)).alias("x"), F.lower(F.substring_index("p", " ", -1)).alias("y"), "n").groupBy("x", "y").agg(F.sum("n").alias("n"))
    n = cut_lineage(n)  # used several times: texts are read once
    is_given = lambda c: F.col(c).isin(known)
    before = n.filter(is_given("x") & ~is_given("y")).groupBy("y").agg(F.count(F.lit(1)).alias("givens")).filter("givens >= 2").select("y", F.lit(True).alias("family"))
    new = n.filter(~is_given("x") & ~F.col("x").isin(TITLES)).join(before, "y", "left")
    per = new.groupBy("x").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("family"), F.col("n"))).alias("f"), F.count("family").alias("families"), F.sum(F.when(is_given("y"), F.col("n"))).alias("g"))
    per = per.filter((F.col("families") >= MIN_FAMILIES) & (F.col("f") * 2 >= F.col("n")) & (F.coalesce("g", F.lit(0)) * 10 <= F.col("n")))
    got = per.join(before.select(F.col("y").alias("x")), "x", "left_anti").select("x").limit(MAX_GIVEN_NAMES + 1).collect()  # a family isn't a given name
    if len(got) > MAX_GIVEN_NAMES:
        raise ValueError(f"more than {MAX_GIVEN_NAMES} given names: give a list instead")
    return sorted(r["x"].title() for r in got)


def disclosure(found: DataFrame) -> dict[int, float]:
    """Log-odds of each context bucket beside proven against unproven numbers; at most ``BUCKETS`` entries.

    They are meant for unproven numbers, so the one that asks isn't counted.
    """
    c = found.filter("kind = 'phone'").select("proven", F.explode("contexts").alias("c")).groupBy("c").agg(F.count_if("proven").alias("p"), F.count_if(~F.col("proven")).alias("u"))
    return {r["c"]: math.log((r["p"] + 0.5) / (max(r["u"] - 1, 0) + 0.5)) for r in c.collect()}


def family_names(found: DataFrame, contacts: DataFrame) -> DataFrame:
    """Words written in lower case that reveal a person's family: ``(family)``."""
    named = found.filter("kind = 'name' and proven")
    pairs = named.groupBy("family", "given").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("family").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    known = contacts.select(F.lower(F.regexp_extract(F.trim("display_name"), r"(\p{L}+)$", 1)).alias("family")).filter("family <> ''")
    sure = per.filter(F.log2("t") - F.col("s") / F.col("t") >= MIN_ENTROPY).select("family").unionByName(known).distinct()
    every = per.select("family").unionByName(known).distinct().filter("length(family) >= 6")
    heads = every.groupBy(F.substring("family", 1, 4).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_ALIKE).select("h")
    tails = every.groupBy(F.substring("family", -3, 3).alias("e")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_ALIKE).select("e")
    open_words = found.filter("kind = 'name' and not proven and length(family) >= 6").select("family").distinct()
    alike = open_words.withColumn("h", F.substring("family", 1, 4)).withColumn("e", F.substring("family", -3, 3)).join(heads, "h", "left_semi").join(tails, "e", "left_semi")
    return sure.unionByName(alike.select("family")).distinct()


def street_names(found: DataFrame) -> DataFrame:
    """Streets that the corpus also writes with a capital: ``(family)``."""
    return found.filter("kind = 'address' and proven and family is not null").select("family").distinct()


def personal_spans(texts: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(tbl, row_id, h, kind, start_pos, length)`` of all personal information in ``(tbl, row_id, text)``; ``h`` is the text's hash."""
    given = given_names(contacts)
    found = cut_lineage(candidates(texts, given + learned_names(texts, given)))
    weight = disclosure(found)
    rows = found.sparkSession.createDataFrame([(k, float(v)) for k, v in weight.items()], "c int, w double")
    open_numbers = found.filter("kind = 'phone' and not proven").select("tbl", "row_id", "h", "kind", "start_pos", "length", F.explode("contexts").alias("c"))
    scored = open_numbers.join(F.broadcast(rows), "c", "left").groupBy("tbl", "row_id", "h", "kind", "start_pos", "length").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("w"))
    revealed = scored.filter(F.col("w") > THRESHOLD).drop("w")
    plain_names = found.filter("kind = 'name' and not proven").join(family_names(found, contacts), "family", "left_semi")
    plain_streets = found.filter("kind = 'address' and not proven").join(street_names(found), "family", "left_semi")
    keep = ["tbl", "row_id", "h", "kind", "start_pos", "length"]
    return found.filter("proven").select(*keep).unionByName(revealed.select(*keep)).unionByName(plain_names.select(*keep)).unionByName(plain_streets.select(*keep)).distinct()


def texts_of(messages: DataFrame, units: DataFrame, notes: DataFrame) -> DataFrame:
    """The texts of the three tables as ``(tbl, row_id, text)``."""
    one = lambda df, t, c: df.select(F.lit(t).alias("tbl"), F.col("id").cast("string").alias("row_id"), F.col(c).alias("text"))
    return one(messages, "imessage_messages", "text").unionByName(one(units, "retrieval_units", "body")).unionByName(one(notes, "parsed_notes", "body"))


def _placeholders(text: Column, items: Column) -> Column:
    """``text`` with each ``(start_pos, length, kind)`` of ``items``, sorted by start, replaced by ``[KIND]``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, i: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, i["start_pos"] - acc["at"]), F.lit("["), F.upper(i["kind"]), F.lit("]")).alias("out"), (i["start_pos"] + i["length"]).alias("at"))
    return F.aggregate(items, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(texts: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(tbl, row_id, text, n_items)``: each id once, its personal information replaced by typed placeholders.

    The items of a text are gathered, which its length bounds.
    """
    items = personal_spans(texts, contacts).groupBy("tbl", "row_id", "h").agg(F.sort_array(F.collect_list(F.struct("start_pos", "length", "kind"))).alias("items"))
    copy = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")
    once = texts.filter("row_id is not null").groupBy("tbl", "row_id").agg(copy).select("tbl", "row_id", "x.h", "x.text")
    out = once.join(items, ["tbl", "row_id", "h"], "left")
    return out.select("tbl", "row_id", F.when(F.col("items").isNull(), F.col("text")).otherwise(_placeholders(F.col("text"), F.col("items"))).alias("text"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"))


def found_items(messages: DataFrame, units: DataFrame, notes: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(tbl, row_id, kind, start_pos)`` of the three tables."""
    return personal_spans(texts_of(messages, units, notes), contacts).select("tbl", "row_id", "kind", "start_pos").distinct()
