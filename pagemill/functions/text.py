"""Column expressions for cleaning, splitting and keying recognised text. All run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, and the ideographs that take no blanks between them.
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
CLOSERS = "，。！？；：、）】》"
OPENERS = "（【《"
HEADING_NUMERALS = r"一二三四五六七八九十百千万零〇\p{Nd}"
PAIRED = rf"(?<=[{CJK}])[ \t]+(?=[{CJK}0-9A-Za-z])|(?<=[0-9A-Za-z])[ \t]+(?=[{CJK}])"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, rf"\A{WS}++|{WS}++\z", "")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def cleanup(text: Column) -> Column:
    """Recognised text without the blanks scanners put around ideographs and full-width signs; ends stripped.

    Blanks between Latin words stay. Null gives the empty string. One look-around pass equals repeating the pairwise
    rules until nothing changes, because a removed blank never makes a new pair.
    """
    out = strip(text_or_empty(text))
    out = F.regexp_replace(out, PAIRED, "")
    out = F.regexp_replace(out, rf"[ \t]+(?=[{CLOSERS}])", "")
    return F.regexp_replace(out, rf"(?<=[{OPENERS}])[ \t]+", "")


def squeeze(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, rf"{WS}+", "")


def heading_key(text: Column) -> Column:
    """Key under which headings compare equal: cleaned, without white space. Cleaning removes nothing but white space, so
    one pass does both."""
    return squeeze(text_or_empty(text))


def text_key(text: Column) -> Column:
    return squeeze(text_or_empty(text))


def coverage_length(text: Column) -> Column:
    return F.length(heading_key(text))


def truthy(text: Column) -> Column:
    """A flag given as text: 1, true, yes, y and on are true, whatever the case; null and all else are false."""
    return F.coalesce(F.lower(strip(text)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def paragraphs(text: Column) -> Column:
    """Paragraphs between empty lines; line ends inside a paragraph vanish with the blanks around them."""
    whole = F.split(strip(text_or_empty(text)), rf"\n{WS}*\n+")
    joined = F.transform(whole, lambda p: F.regexp_replace(strip(p), r"[ \t]*\n[ \t]*", ""))
    return F.filter(joined, lambda p: p != "")


def looks_like_heading(text: Column) -> Column:
    """Short text that opens with a chapter number or an enumeration."""
    t = strip(text_or_empty(text))
    return (F.length(t) <= 32) & t.rlike(rf"\A(?:第[{HEADING_NUMERALS}]+[章节回卷部篇]|[{HEADING_NUMERALS}]+[、.．])")


def fallback_blocks(text: Column) -> Column:
    """Blocks of a page that has none: a paragraph each, headings by their look."""
    return F.transform(
        paragraphs(text),
        lambda p: F.struct(
            F.when(looks_like_heading(p), "heading").otherwise("paragraph").alias("type"),
            F.when(looks_like_heading(p), 2).otherwise(0).alias("level"),
            p.alias("text"),
            F.lit(False).alias("continued_from_previous"),
        ),
    )


# Equal blanks, and spelt-out line breaks, from which on a run is left out of a quoted reply.
BLANK_RUN, BREAK_RUN = 9, 8


def compact_reply(text: Column, limit: int = 4000) -> Column:
    """A model reply fit to be quoted: long runs marked, the middle left out beyond ``limit`` characters."""
    out = text_or_empty(text)
    for blank in (" ", "\\t", "\\r", "\\n"):
        out = F.regexp_replace(out, f"{blank}{{{BLANK_RUN},}}", f"{blank}[blank run left out]{blank}".replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n"))
    out = F.regexp_replace(out, rf"(?:[/\\]n[\"'`,，\s]*+){{{BREAK_RUN},}}", "[repeated line breaks left out]")
    half = limit // 2
    return F.when(F.length(out) <= limit, out).otherwise(
        F.concat(F.substring(out, 1, half), F.lit("\n...[middle left out]...\n"), F.substring(out, -half, half))
    )


def is_repeated_unit(text: Column) -> Column:
    """Whether the text is one unit of up to eight characters, repeated (or given once); the empty text is not."""
    return F.coalesce(text.rlike(r"(?s)\A(.{1,8})\1*+\z"), F.lit(False))


def escape(text: Column) -> Column:
    """Text as XHTML content or attribute value."""
    out = text_or_empty(text)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def slug(prefix: str, index: Column) -> Column:
    """``prefix-0001``; wider numbers keep all their digits."""
    digits = index.cast("string")
    return F.concat(F.lit(prefix + "-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def natural_key(name: Column) -> Column:
    """A string that sorts names by their numbers: runs of digits padded to a width of twelve."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"\A\d"), F.lpad(F.regexp_replace(p, r"\A0+(?=\d)", ""), 12, "0")).otherwise(F.lower(p))), "")


def file_name(title: Column, fallback: str = "book") -> Column:
    """A title as a file name: forbidden signs as one ``_``, blank runs as one space, no blanks or dots at the ends."""
    out = F.regexp_replace(strip(text_or_empty(title)), r'[\\/:*?"<>|]+', "_")
    out = F.regexp_replace(F.regexp_replace(out, rf"{WS}+", " "), r"\A[ .]+|[ .]+\z", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def marker_variants(marker: Column) -> Column:
    """The forms in which a note marker may stand in running text, most telling first; none for an empty marker."""
    m = strip(text_or_empty(marker))
    raised = F.when(m.rlike(r"\A[0-9]+\z"), F.translate(m, "0123456789", SUPERSCRIPTS))
    ringed = F.when(m.rlike(r"\A(?:[1-9]|10)\z"), F.element_at(F.array(*[F.lit(c) for c in CIRCLED]), m.try_cast("int")))
    forms = F.array(raised, ringed, *(F.concat(F.lit(a), m, F.lit(b)) for a, b in ("[]", "〔〕", "［］")), m)
    return F.when(m == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & (f != ""))))


def parsed_note(note: Column) -> Column:
    """A note given as plain text: struct of marker, text and type; a leading number, raised or ringed, is the marker."""
    t = strip(text_or_empty(note))
    pattern = rf"(?s)\A(\p{{Nd}}+|[{SUPERSCRIPTS}]+|[{CIRCLED}]){WS}*(.*)\z"
    raw = F.regexp_extract(t, pattern, 1)
    has = (raw != "") & ~F.regexp_extract(t, pattern, 2).contains("\n")
    ring = F.array_position(F.array(*[F.lit(c) for c in CIRCLED]), raw).cast("string")
    marker = F.when(raw.rlike(rf"\A[{SUPERSCRIPTS}]"), F.translate(raw, SUPERSCRIPTS, "0123456789")).when(raw.rlike(rf"\A[{CIRCLED}]"), ring).otherwise(raw)
    return F.struct(
        F.when(has, marker).otherwise("").alias("marker"),
        F.when(has, strip(F.regexp_extract(t, pattern, 2))).otherwise(t).alias("text"),
        F.lit("footnote").alias("type"),
    )


def paragraph_class(text: Column, quote: Column) -> Column:
    """The class attribute of a paragraph: quotes, and speech that opens with a quotation mark."""
    names = F.array_join(F.filter(F.array(F.when(quote, "quote"), F.when(strip(text_or_empty(text)).startswith("“"), "dialogue")), lambda c: c.isNotNull()), " ")
    return F.when(names == "", F.lit("")).otherwise(F.concat(F.lit(' class="'), names, F.lit('"')))


def block_html(block: Column, block_id: Column, inner: Column | None = None) -> Column:
    """One block as XHTML; empty for a block without text. ``inner``: its escaped text, if notes were set into it."""
    text = strip(text_or_empty(block["text"]))
    body = escape(text) if inner is None else inner
    level = F.greatest(F.lit(2), F.least(F.lit(4), F.coalesce(F.nullif(block["level"], F.lit(0)), F.lit(2)) + 1)).cast("string")
    head = F.concat(F.lit("<h"), level, F.lit(' id="'), block_id, F.lit('" class="section-heading">'), escape(text), F.lit("</h"), level, F.lit(">"))
    para = F.concat(F.lit('<p id="'), block_id, F.lit('"'), paragraph_class(text, block["type"] == "quote"), F.lit(">"), body, F.lit("</p>"))
    return F.when(text == "", "").when(block["type"] == "heading", head).otherwise(para)


def paragraph_html(text: Column) -> Column:
    """A bare paragraph, or a second-level heading if it looks like one."""
    t = strip(text_or_empty(text))
    return F.when(looks_like_heading(t), F.concat(F.lit("<h2>"), escape(t), F.lit("</h2>"))).otherwise(
        F.concat(F.lit("<p"), F.when(t.startswith("“"), ' class="dialogue"').otherwise(""), F.lit(">"), escape(t), F.lit("</p>"))
    )


def markdown(blocks: Column) -> Column:
    """Blocks as Markdown: headings by level, quotes, paragraphs, between empty lines. Null blocks give an empty text."""
    level = lambda b: F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.nullif(b["level"], F.lit(0)), F.lit(2))))
    one = lambda b: F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), level(b)), F.lit(" "), b["text"])).when(
        b["type"] == "quote", F.concat(F.lit("> "), b["text"])
    ).otherwise(b["text"])
    return F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(b["text"] != "", F.lit(False))), one), "\n\n"), F.lit(""))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
