"""One UTC instant from date texts of mixed formats, precisions and zones.

A text is taken apart by a few regular expressions (JVM side) into calendar
date, wall time and zone.  A zone or offset in the text wins; else the zone is
that of the text's source.  Sources that declare no zone get one by
estimation (:func:`estimate_zones`): the wall times of the source are aligned
with instants known from the same source (texts with an offset, ingestion
times) in sequence order, and the zone whose offset history breaks that order,
or the offsets that other texts of the source state, least often is taken.

Wall times that occur twice mean the first, skipped ones move forward by the
skipped span; both is what ``try_make_timestamp`` does with a zone.

Nulls, blanks, impossible or partial dates give null.  Nothing here shuffles
by text; the zone table is joined by broadcast, its size being that of a
declaration (checked, see :func:`zone_table`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.session import cut_lineage

#: Month names (first three letters, English and German, then the other languages of the texts).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mrz": 3, "mai": 5, "okt": 10, "dez": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12,
    "fév": 2, "avr": 4, "aoû": 8, "déc": 12,
}

#: What abbreviations of zones mean where they are used, in minutes east of UTC.
LOCAL_ABBREVIATIONS = {
    "America/New_York": {"est": -300, "edt": -240},
    "America/Chicago": {"cst": -360, "cdt": -300},
    "America/Denver": {"mst": -420, "mdt": -360},
    "America/Los_Angeles": {"pst": -480, "pdt": -420},
    "Europe/Berlin": {"cet": 60, "cest": 120, "mez": 60, "mesz": 120},
    "Europe/London": {"gmt": 0, "bst": 60},
    "Europe/Lisbon": {"wet": 0, "west": 60},
    "Australia/Sydney": {"aest": 600, "aedt": 660, "est": 600, "edt": 660},
    "Asia/Kolkata": {"ist": 330},
    "Asia/Tokyo": {"jst": 540},
    "Asia/Kathmandu": {"npt": 345},
}

#: Their usual meaning elsewhere.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "npt": 345, "jst": 540, "aest": 600, "aedt": 660,
}

#: Origins of bare numbers (microseconds from 1970) and ticks per second. No number has two readings in 2010-2037.
EPOCHS = [(0, 1), (0, 10**3), (0, 10**6), (0, 10**9), (978307200 * 10**6, 1), (978307200 * 10**6, 10**3), (978307200 * 10**6, 10**6), (978307200 * 10**6, 10**9), (-11644473600 * 10**6, 10**6), (-11644473600 * 10**6, 10**7)]
EARLIEST_US, LATEST_US = 1262304000 * 10**6, 2145916800 * 10**6

#: Parts of a source's sequence in which its zone is estimated.
SLICES = 64

#: A zone table larger than this isn't a declaration; it is then joined by a shuffle.
MAX_ZONES = 10_000

_BLANK = r"[\s\x{A0}\x{202F}\x{2009}\x{FEFF}]+"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def bare_number(text: Column) -> Column:
    """Microseconds from a bare number of 9 to 19 digits, by the one reading in 2010-2037."""
    v = F.when(text.rlike(r"^\d{9,19}(\.\d{1,9})?$"), text).cast("decimal(38,9)")
    readings = []
    for origin, ticks in EPOCHS:
        us = (F.floor(v * F.lit(10**6 // ticks).cast("decimal(10,0)")) if ticks <= 10**6 else F.floor(v / F.lit(ticks // 10**6).cast("decimal(10,0)"))) + F.lit(origin).cast("decimal(20,0)")
        readings.append(F.when((us >= EARLIEST_US) & (us < LATEST_US), us.cast("long")))
    return F.coalesce(*readings)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a pattern that matches the whole text, null where it doesn't; one replacement instead of an extraction each."""
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001"))


_CLOCK = r"^(.*?)(?:(?<=\d)t|,? at |,? um |,? |^)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([ap])\.?m\.?(?![a-z]))?((?:[ (+\-z].*)?)$"
_DATES = {"iso": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 3), "num": (r"^(\d{1,2})([/.\-])(\d{1,2})\2(\d{4}|\d{2})$", 4), "dmy": (r"^(\d{1,2})\.? ?-?([a-zäéû]{3,10})\.?,? ?-?(\d{4}|\d{2})$", 3), "mdy": (r"^([a-zäéû]{3,10})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$", 3)}


def _cleaned(text: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(text, _BLANK, " ")))
    s = F.regexp_replace(s, r"^calculated: ?| ?uhr$", "")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})(?=[z+\-.,]|$)", "$1-$2-$3t$4:$5:$6")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.regexp_replace(s, r"^(mon|tue|wed|thu|fri|sat|sun|mo|di|mi|do|fr|sa|so)[a-zäöü]*\.?,? (?=\S)", "")


def read_texts(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_us`` (bare numbers), ``_y _m _d _h _mi _s`` and ``_zone`` of the text, null where it has none.

    An all-number date keeps its first two fields in ``_a`` and ``_b``; the
    order of the source decides them in :func:`wall_time`.  Each step is a
    projection of its own, so that no pattern is matched twice.
    """
    df = rows.withColumn("_p_s", _cleaned(F.col(text)))
    df = df.withColumn("_p_c", _groups(F.col("_p_s"), _CLOCK, 7))
    c = lambda i: F.coalesce(F.col("_p_c")[i - 1], F.lit(""))
    timed = F.col("_p_c").isNotNull()
    df = df.withColumns({"_p_note": F.regexp_extract(c(7), r"\(([a-z]+)\)$", 1), "_p_after": F.trim(F.regexp_replace(c(7), r" ?\([^)]*\)$", ""))})
    df = df.withColumn("_p_last", _groups(F.col("_p_after"), r"^(?:([a-z]{1,5}) )?(\d{4})$", 2))  # Wed Mar 28 11:40:16 [EST] 2012
    last = F.col("_p_last")
    zone = F.when(last.isNotNull(), last[0]).otherwise(F.col("_p_after"))
    date = F.trim(F.when(timed, F.concat_ws(" ", c(1), last[1])).otherwise(F.col("_p_s")))
    df = df.withColumns({"_p_date": F.regexp_replace(date, r",$", ""), "_zone": F.nullif(F.when(zone == "", F.col("_p_note")).otherwise(zone), F.lit(""))})
    df = df.withColumns({f"_p_{k}": _groups(F.col("_p_date"), rx, n) for k, (rx, n) in _DATES.items()})
    iso, num, dmy, mdy = (F.col(f"_p_{k}") for k in _DATES)
    year = F.coalesce(iso[0], dmy[2], mdy[2], num[3])
    name = F.substring(F.coalesce(dmy[1], mdy[0]), 1, 3)
    hour = c(2).try_cast("int")
    noon = c(6) != ""
    hour = F.when(~timed, 0).when(noon & ~hour.between(1, 12), None).when(c(6) == "a", hour % 12).when(c(6) == "p", hour % 12 + 12).otherwise(hour)
    sec = F.concat(F.when(c(4) == "", "0").otherwise(c(4)), F.lit("."), F.rpad(F.substring(F.concat(c(5), F.lit("0")), 1, 6), 6, "0"))
    return df.withColumns({
        "_us": bare_number(F.col("_p_s")),
        "_y": F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).cast("int"),
        "_m": F.coalesce(iso[1].cast("int"), _map(MONTHS)[name]),
        "_d": F.coalesce(iso[2], dmy[0], mdy[1]).cast("int"),
        "_a": num[0].cast("int"), "_b": num[2].cast("int"),
        "_h": hour, "_mi": F.when(timed, c(3).try_cast("int")).otherwise(0), "_s": F.when(timed, sec.try_cast("decimal(16,6)")).otherwise(F.lit(0).cast("decimal(16,6)")),
    }).drop("_p_s", "_p_c", "_p_note", "_p_after", "_p_last", "_p_date", *[f"_p_{k}" for k in _DATES])


def wall_time(zone: Column, order: Column) -> Column:
    """The instant of the parts read by :func:`read_texts` as wall time in ``zone``; null if impossible."""
    month = F.coalesce("_m", F.when(order == "DMY", F.col("_b")).otherwise(F.col("_a")))
    day = F.coalesce("_d", F.when(order == "DMY", F.col("_a")).otherwise(F.col("_b")))
    ok = F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & (F.col("_s") < 60)
    return F.unix_micros(F.when(ok & zone.isNotNull(), F.try_make_timestamp(F.col("_y"), month, day, F.col("_h"), F.col("_mi"), F.col("_s"), zone)))


def offset_minutes(token: Column, zone: Column) -> Column:
    """Minutes east of UTC that a zone token says: an offset, or an abbreviation as used in ``zone``, else as usual."""
    rx = r"^(?:utc|gmt)? ?([+\-])(\d{1,2}):?(\d{2})?$"
    n = F.regexp_extract(token, rx, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(token, rx, 3).try_cast("int"), F.lit(0))
    n = F.when(n > 14 * 60, None).otherwise(n)
    local = F.coalesce(*[F.when(zone == z, _map(m)[token]) for z, m in LOCAL_ABBREVIATIONS.items()])
    return F.when(token.rlike(rx), F.when(F.regexp_extract(token, rx, 1) == "-", -n).otherwise(n)).otherwise(F.coalesce(local, _map(ABBREVIATIONS)[token]))


def instant(zone: Column, order: Column, offset: Column | None = None) -> Column:
    """Microseconds from 1970 UTC of a row of :func:`read_texts`; ``offset`` is :func:`offset_minutes` of ``_zone``, if it is at hand."""
    offset = offset_minutes(F.col("_zone"), zone) if offset is None else offset
    # a token that no table knows says nothing: then the source's zone counts
    wall = wall_time(F.when(offset.isNotNull(), "UTC").otherwise(zone), order)
    return F.coalesce("_us", wall - F.coalesce(offset, F.lit(0)).cast("long") * 60_000_000)


def zone_table(zones: DataFrame) -> DataFrame:
    """``zones`` marked for broadcast if it is small enough to be a declaration."""
    return F.broadcast(zones) if zones.limit(MAX_ZONES + 1).count() <= MAX_ZONES else zones


def estimate_zones(texts: DataFrame, candidates: list[str], slack_us: int = 0) -> DataFrame:
    """The zone of each source by order: ``(source, zone_id, date_order, violations, n)``.

    ``texts`` is a :func:`read_texts` result with ``source``, ``seq`` (what
    orders the source's rows) and ``ingested_us`` (arrival, or null).  Each
    candidate turns every zoneless row into an instant; it is violated where
    that is later than the arrival, or falls outside the nearest instants
    before and after it in sequence whose zone is stated.  A row that states an
    offset in numbers is violated by the zones that had another one at its
    instant.  Fewest violations win, then the least mean delay to the arrival,
    then the name.

    ``seq`` is a number.  It is cut into ``SLICES`` parts of about equal size
    per source; anchors are looked up inside a part, and beyond it in one row
    per part, so no task sorts a whole source.
    """
    t = texts.withColumns({"_seq": F.col("seq").cast("double"), "_said": offset_minutes(F.col("_zone"), F.lit("UTC"))})
    t = t.withColumn("_anchor", F.coalesce("_us", wall_time(F.lit("UTC"), F.lit("MDY")) - F.col("_said").cast("long") * 60_000_000))
    t = cut_lineage(t.select("source", "_seq", "ingested_us", "_anchor", "_said", "_zone", "_y", "_m", "_d", "_a", "_b", "_h", "_mi", "_s"))  # used several times: texts are read once
    cuts = t.groupBy("source").agg(F.percentile_approx("_seq", F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])).alias("_cuts"))
    a = t.join(cuts, "source").withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_seq"))), F.lit(0))).drop("_cuts")
    up, down = Window.partitionBy("source", "_part").orderBy("_seq"), Window.partitionBy("source", "_part").orderBy(F.desc("_seq"))
    sure = F.when(F.col("_anchor").isNotNull() & F.col("_seq").isNotNull(), F.col("_seq"))
    ends = a.groupBy("source", "_part").agg(F.min_by("_anchor", sure).alias("_first"), F.max_by("_anchor", sure).alias("_last"))
    pu, pd = Window.partitionBy("source").orderBy("_part"), Window.partitionBy("source").orderBy(F.desc("_part"))
    rows = (Window.unboundedPreceding, -1)
    ends = ends.select("source", "_part", F.last("_last", ignorenulls=True).over(pu.rowsBetween(*rows)).alias("_pb"), F.last("_first", ignorenulls=True).over(pd.rowsBetween(*rows)).alias("_pa"))
    a = a.withColumn("_before", F.last("_anchor", ignorenulls=True).over(up.rowsBetween(*rows))).withColumn("_after", F.last("_anchor", ignorenulls=True).over(down.rowsBetween(*rows)))
    a = a.join(ends, ["source", "_part"]).withColumn("_before", F.when(F.col("_seq").isNotNull(), F.coalesce("_before", "_pb"))).withColumn("_after", F.when(F.col("_seq").isNotNull(), F.coalesce("_after", "_pa")))
    loose = a.filter(F.col("_anchor").isNull())
    each = F.explode(F.array(*[F.struct(F.lit(z).alias("zone_id"), F.lit(o).alias("date_order")) for z in candidates for o in ("MDY", "DMY")]))
    loose = loose.filter(F.col("_before").isNotNull() | F.col("_after").isNotNull() | F.col("ingested_us").isNotNull() | F.col("_a").isNotNull())  # all numbers: an order may be impossible
    tried = loose.withColumn("c", each).select("*", "c.*").withColumn("t", wall_time(F.col("zone_id"), F.col("date_order")))
    bad = F.coalesce(F.col("t") > F.col("ingested_us") + slack_us, F.lit(False)) | F.coalesce(F.col("t") < F.col("_before") - slack_us, F.lit(False)) | F.coalesce(F.col("t") > F.col("_after") + slack_us, F.lit(False)) | F.col("t").isNull()
    tried = tried.select("source", "zone_id", "date_order", bad.alias("_bad"), F.abs(F.col("ingested_us") - F.col("t")).alias("_late"))
    stated = t.filter(F.col("_zone").rlike(r"^[+\-]\d") & F.col("_anchor").isNotNull() & F.col("_said").isNotNull())
    own = (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("_anchor"), F.col("zone_id"))) - F.col("_anchor")) / 60_000_000
    shown = stated.select("source", "_anchor", "_said", each.alias("c")).select("source", "_anchor", "_said", "c.*").select("source", "zone_id", "date_order", (own != F.col("_said")).alias("_bad"))
    tried = tried.unionByName(shown.withColumn("_late", F.lit(None).cast("long")))
    bad, delay = F.col("_bad"), F.avg("_late")
    sums = tried.groupBy("source", "zone_id", "date_order").agg(F.count_if(bad).alias("violations"), F.count(F.lit(1)).alias("n"), delay.alias("_delay"))
    best = F.min_by(F.struct("zone_id", "date_order", "violations", "n"), F.struct("violations", "_delay", "zone_id", "date_order")).alias("b")
    return sums.groupBy("source").agg(best).select("source", "b.*")


def candidate_zones(zones: DataFrame) -> list[str]:
    """The zone names that ``zones`` knows; refused if they are more than there are zones in the world."""
    got = zones.select("zone_id").filter("zone_id is not null").distinct().limit(MAX_ZONES + 1).collect()
    if len(got) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} zones")
    return sorted(r["zone_id"] for r in got)


def normalise(rows: DataFrame, text: str, source: Column, zones: DataFrame, seq: Column, ingested: Column | None = None) -> DataFrame:
    """Adds ``instant_us``; ``zones`` has ``(source, zone_id, date_order)``.

    Rows of sources that ``zones`` doesn't name are estimated first, with the
    zones that are named as candidates.
    """
    named = rows.withColumns({"source": source, "seq": seq, "ingested_us": F.unix_micros(ingested) if ingested is not None else F.lit(None).cast("long")})
    read = read_texts(named, text)
    known = zones.select("source", "zone_id", "date_order")
    given = known.limit(MAX_ZONES + 1).collect()
    if len(given) <= MAX_ZONES:  # a declaration: one row a source, broadcast
        given = {r["source"]: tuple(r) for r in sorted(given, key=lambda r: tuple(x or "" for x in r), reverse=True)}
        small = known = F.broadcast(rows.sparkSession.createDataFrame(list(given.values()), known.schema))
    else:
        small = known = known.groupBy("source").agg(F.min(F.struct("zone_id", "date_order")).alias("z")).select("source", "z.*")
    # a scan of the source column alone says whether anything has to be estimated
    if named.filter(F.col("source").isNotNull()).join(small.select("source"), "source", "left_anti").limit(1).count():
        candidates = candidate_zones(zones)
        undeclared = read.filter(F.col("source").isNotNull()).join(small.select("source"), "source", "left_anti")
        # the estimates aren't hinted: their number is that of the sources
        known = known.unionByName(estimate_zones(undeclared, candidates).select("source", "zone_id", "date_order")) if candidates else known
    # a row of a source without any zone still has what its text states
    placed = read.join(known, "source", "left").withColumn("_offset", offset_minutes(F.col("_zone"), F.col("zone_id")))
    return placed.withColumn("instant_us", instant(F.col("zone_id"), F.col("date_order"), F.col("_offset"))).drop("_offset")


def first_directory(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(path, r"^/*([^/]+)/", 1)), F.lit(""))


def declared(source_zones: DataFrame) -> DataFrame:
    """``(source, zone_id, date_order)`` that ``source_zones`` declares, ``source`` being table and key."""
    from corpuskiln.operators.delivery import folder_key

    return source_zones.select(F.concat_ws(":", "tbl", folder_key(F.col("source_key"))).alias("source"), "zone_id", "date_order").filter("source is not null")


def dated_rows(messages: DataFrame | None = None, threads: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """``(tbl, row_id, source, seq, arrived, date_text)`` of the tables with date texts.

    Headers come in the order of their uid, threads in that of their arrival;
    notes have neither, for them only the offsets that texts state can speak.
    """
    from corpuskiln.operators.delivery import folder_key

    out = None
    never = F.lit(None).cast("timestamp")
    for tbl, df, text, key, seq, arrived in (
        ("messages", messages, "date_str", lambda: folder_key(F.col("folder")), "uid", never),
        ("imessage_threads", threads, "date_start", lambda: first_directory(F.col("source_file")), F.unix_micros("created_at") if threads is not None else None, F.col("created_at")),
        ("parsed_notes", notes, "created_at", lambda: first_directory(F.col("source_file")), F.lit(None), never),
    ):
        if df is None:
            continue
        seq = F.col(seq) if isinstance(seq, str) else seq
        one = df.select(F.lit(tbl).alias("tbl"), F.col("id").cast("string").alias("row_id"), F.when(key().isNotNull(), F.concat(F.lit(tbl + ":"), key())).alias("source"), seq.cast("long").alias("seq"), arrived.alias("arrived"), F.col(text).alias("date_text"))
        out = one if out is None else out.unionByName(one)
    return out


def instants_of(rows: DataFrame, source_zones: DataFrame) -> DataFrame:
    """``(tbl, row_id, instant_us)`` of :func:`dated_rows`, each id once."""
    got = normalise(rows, "date_text", F.col("source"), declared(source_zones), F.col("seq"), F.col("arrived"))
    # filtered when it is computed: a filter below would compute it twice
    return got.groupBy("tbl", "row_id").agg(F.min("instant_us").alias("instant_us")).filter(F.col("instant_us").isNotNull())


def note_instants(notes: DataFrame, source_zones: DataFrame) -> DataFrame:
    """``(id, instant_us)`` of the notes whose creation text names an instant, each id once."""
    return instants_of(dated_rows(notes=notes), source_zones).select(F.col("row_id").alias("id"), "instant_us")


def found_instants(messages: DataFrame, threads: DataFrame, notes: DataFrame, source_zones: DataFrame) -> DataFrame:
    """``(tbl, row_id, instant_us)`` of the three tables with date texts."""
    return instants_of(dated_rows(messages, threads, notes), source_zones)


def zone_estimates(rows: DataFrame, source_zones: DataFrame) -> DataFrame:
    """What estimation says of every source without looking at its declaration, and how many instants come out as declared.

    ``(source, declared_zone, declared_order, zone_id, date_order, violations, n, dated, agree)``.
    """
    read = cut_lineage(read_texts(rows.withColumn("ingested_us", F.unix_micros("arrived")), "date_text").filter("source is not null"))
    guess = estimate_zones(read, candidate_zones(source_zones))
    known = declared(source_zones).groupBy("source").agg(F.min(F.struct("zone_id", "date_order")).alias("z")).select("source", F.col("z.zone_id").alias("declared_zone"), F.col("z.date_order").alias("declared_order"))
    both = read.join(guess.join(known, "source", "left"), "source")
    said, guessed = instant(F.col("declared_zone"), F.col("declared_order")), instant(F.col("zone_id"), F.col("date_order"))
    keys = ["source", "declared_zone", "declared_order", "zone_id", "date_order", "violations", "n"]
    each = both.select(*keys, said.alias("_said"), guessed.alias("_guessed"))
    return each.groupBy(*keys).agg(F.count("_said").alias("dated"), F.count_if(F.col("_said") == F.col("_guessed")).alias("agree"))
