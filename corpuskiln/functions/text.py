"""Text functions as Column expressions: they stay in generated JVM code.

Regular expressions use what Java and RE2 read alike, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A small invented default; pass your own.
STOP_WORDS = ["the", "and", "for", "that", "this", "with", "was", "are", "but", "not", "you", "have", "had", "from", "they", "his", "her", "she", "him", "our", "out", "one", "all", "can", "will", "what", "how", "there", "their", "then", "than", "said", "were", "been", "which", "when", "who", "into", "could", "about", "before", "after", "more", "anyway", "went", "did", "made", "some"]

URL = r"https?://\S+|www\.\S+"

#: How a chat export begins the text of a reaction.
REACTION_PREFIXES = ["Liked ", "Loved ", "Disliked ", "Laughed at ", "Emphasized ", "Questioned "]


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def words(text: Column) -> Column:
    """Lower-case words of letters and apostrophes, URLs left out."""
    return F.regexp_extract_all(F.lower(strip_urls(F.coalesce(text, F.lit("")))), F.lit(r"[a-z']+"), 0)


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """:func:`words` longer than two letters that aren't stop words."""
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)]) if (stop_words is None or stop_words) else F.array().cast("array<string>")
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def bigrams(toks: Column) -> Column:
    """Neighbouring tokens joined by a blank."""
    return F.when(F.size(toks) > 1, F.zip_with(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def is_content(text: Column) -> Column:
    """Not blank and not the echo of a reaction."""
    rx = "^(" + "|".join(REACTION_PREFIXES) + ")"
    return F.coalesce((F.trim(text) != "") & ~text.rlike(rx), F.lit(False))


def clean_chat_text(text: Column) -> Column:
    """Chat text without NULs and tags, blanks collapsed, at most one empty line; URLs stay."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\x00", "")
    t = F.regexp_replace(t, r"<[^>\n]+>", " ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def strip_html(html: Column) -> Column:
    """The text of a page: scripts, styles and head go, block tags break lines, the common entities are resolved."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|blockquote)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def clean_summary(text: Column) -> Column:
    """A feed summary: no tags, entities resolved, 500 characters."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.substring(F.trim(t), 1, 500)


#: Lines that begin a quoted mail.
QUOTE_START = r"^(?:-{2,} ?Original Message ?-{2,}|-{5,} Forwarded message -{5,}.*|Begin forwarded message:|On .+ wrote:|_{10,})\s*$"


def text_lines(text: Column) -> Column:
    """The lines of a text; a blank text has none."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.trim(t) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(t, "\n"), lambda ln: F.regexp_replace(ln, "\r$", "")))


#: Lines that phones and scanners add below a mail, and a separator at the very top with all below it.
SIGNATURES = [r"(?m)^Sent (?:from my (?:iPhone|iPad|Tricorder|BlackBerry)|via BlackBerry).*$", r"(?m)^Get Outlook for (?:iOS|Android).*$", r"(?s)\A-- \n.*", r"(?m)No virus found in this (?:incoming|outgoing) message\..*$", r"(?m)^Checked by AVG.*$", r"(?m)^M: \d{3}\.\d{3}\.\d{4}\s*$"]


def strip_signatures(body: Column) -> Column:
    """A body without the lines that devices and scanners add; quoted mails stay."""
    t = F.coalesce(body, F.lit(""))
    for rx in SIGNATURES:
        t = F.regexp_replace(t, rx, "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def new_lines(body: Column) -> Column:
    """``(total_lines, quoted_lines, new_lines, new_chars, total_chars)`` of a body.

    Nothing counts from a forwarded mail on; below an attribution only marked
    lines count, as quoted; device lines are neither.
    """
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)-{5,}\s*Forwarded message\s*-{5,}") & ~F.trim(x).startswith(">")), True).cast("int")
    own = F.when(stop > 0, F.slice(lines, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(lines)
    begun = lambda x: x.rlike(r"^On .+ wrote:\s*$")
    marked = lambda x: F.ltrim(x).startswith(">")
    quote = F.array_position(F.transform(own, begun), True).cast("int")
    mine = F.filter(F.when(quote > 0, F.slice(own, 1, F.greatest(quote - 1, F.lit(0)))).otherwise(own), lambda x: ~marked(x) & ~x.rlike(SIGNATURES[0]))
    quoted = F.size(F.filter(own, lambda x: marked(x) & ~begun(x)))
    chars = F.aggregate(mine, F.lit(0), lambda a, x: a + F.length(x))
    return F.struct(F.size(lines).alias("total_lines"), quoted.alias("quoted_lines"), F.size(mine).alias("new_lines"), chars.alias("new_chars"), F.length(F.coalesce(body, F.lit(""))).alias("total_chars"))


def strip_quoted(body: Column, signatures: bool = False) -> Column:
    """The simple rule: everything before the first quote start, without lines marked by '>', and on request without signatures."""
    ls = text_lines(body)
    flags = F.transform(ls, lambda ln: ln.rlike(QUOTE_START))
    stop = F.array_position(flags, True)
    kept = F.when(stop > 0, F.slice(ls, 1, F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(ls)
    t = F.array_join(F.filter(kept, lambda ln: ~ln.rlike(r"^\s*>")), "\n")
    if signatures:
        return strip_signatures(t)
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def quote_flags(body: Column) -> dict[str, Column]:
    """Which quoting habits a body shows."""
    b = F.coalesce(body, F.lit(""))
    return {
        "marked": b.rlike(r"(?m)^\s*>"),
        "attribution": b.rlike(r"(?m)^On .+ wrote:\s*$"),
        "original": b.rlike(r"(?mi)^-+ ?original message ?-+\s*$"),
        "forwarded": b.rlike(r"(?mi)^(-{5,} forwarded message -{5,}|begin forwarded message:)"),
        "header": b.rlike(r"(?m)^\*?From:\*? .+@"),
    }


def strip_vault_syntax(text: Column) -> Column:
    """Vault mark-up outside fenced code: comments, callouts, links and highlights become plain text."""
    parts = F.split(F.coalesce(text, F.lit("")), "```")

    def plain(p: Column) -> Column:
        p = F.regexp_replace(p, r"(?s)%%.*?%%", "")
        p = F.regexp_replace(p, r"(?m)^> ?\[![^\]\n]*\][-+]? ?", "")
        p = F.regexp_replace(p, r"!?\[\[[^\[\]|\n]*\|([^\[\]\n]*)\]\]", "$1")
        p = F.regexp_replace(p, r"!?\[\[([^\[\]#\n]*)#([^\[\]\n]*)\]\]", "$1 $2")
        p = F.regexp_replace(p, r"!?\[\[([^\[\]\n]*)\]\]", "$1")
        return F.regexp_replace(p, r"==([^=\n]*)==", "$1")

    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, plain(p)).otherwise(p)), "```")


_RESOURCES = [r"!\[[^\]\n]*\]\(:/([a-f0-9]{32})\)", r"<img [^>]*src=\":/([a-f0-9]{32})\"[^>]*>", r"(?<!!)\[[^\]\n]*\.(?:m4a|mp3|wav|ogg)\]\(:/([a-f0-9]{32})\)"]


def resource_ids(text: Column) -> Column:
    """Ids of images and recordings linked in a note, each once, images first."""
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(rx), 1) for rx in _RESOURCES]))


def resource_links(text: Column) -> Column:
    """All resource ids, in order of appearance."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(:/([a-f0-9]{32})\)"), 1)


def without_resources(text: Column) -> Column:
    """The text without links to resources."""
    t = F.coalesce(text, F.lit(""))
    for rx in _RESOURCES:
        t = F.regexp_replace(t, rx, "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def addresses(header: Column) -> Column:
    """E-mail addresses in a header, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(header, F.lit(""))), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+"), 0)


def display_name(header: Column) -> Column:
    """What stands before the address in angle brackets."""
    return F.trim(F.regexp_replace(F.substring_index(F.coalesce(header, F.lit("")), "<", 1), '"', ""))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def json_in_fence(reply: Column) -> Column:
    """A JSON reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
