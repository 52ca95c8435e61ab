"""Page replies brought to the page schema: blocks, notes and illustrations as typed arrays. Row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx

BLOCK = "struct<type:string,level:int,text:string,continued_from_previous:boolean,note_markers:array<string>>"
NOTE = "struct<marker:string,type:string,text:string,anchor:string>"
#: Blocks that cover less of the text than this are rebuilt from it.
LEAST_COVERAGE = 0.6


def markers(value: Column) -> Column:
    return F.filter(F.transform(F.coalesce(value, F.array().cast("array<string>")), tx.strip), lambda m: F.coalesce(m != "", F.lit(False)))


def split_text(text: Column) -> Column:
    """Cleaned paragraphs of a text, none empty; line ends inside a paragraph stay."""
    return F.filter(F.transform(F.split(tx.text_or_empty(text), rf"\n{tx.WS}*\n+"), tx.cleanup), lambda p: p != "")


def blocks_from_text(text: Column) -> Column:
    """A block a paragraph; hash signs in front make a heading of as many levels, at most six."""
    marks = lambda p: F.length(F.regexp_extract(p, r"\A(#*)", 1))
    return F.transform(split_text(text), lambda p: F.struct(
        F.when(p.startswith("#"), "heading").otherwise("paragraph").alias("type"),
        F.when(p.startswith("#"), F.least(F.lit(6), marks(p))).otherwise(0).alias("level"),
        F.when(p.startswith("#"), tx.strip(F.regexp_replace(p, r"\A#+", ""))).otherwise(p).alias("text"),
        F.lit(False).alias("continued_from_previous"), F.array().cast("array<string>").alias("note_markers"),
    ))


def with_rebuilt(rows: DataFrame, blocks: str = "blocks", text: str = "text", out: str = "rebuilt") -> DataFrame:
    """Rows with blocks made of the text's paragraphs, with types and levels from the given blocks of equal wording.

    A hash-marked one-line paragraph or one that a heading block names is a heading (of equal headings the last gives the
    level), one that a quote names a quote. What the first given block continues, the first paragraph continues, if it
    comes first here too. Maps within the row take the place of a join; they are columns of their own, so that each is
    computed once a row.
    """
    none = F.array().cast("array<string>")
    hints = F.filter(F.transform(blocks, lambda b: F.struct(tx.heading_key(b["text"]).alias("k"), b["type"].alias("type"), F.struct(tx.clamp(F.coalesce(F.nullif(b["level"], F.lit(0)), F.lit(2)), 1, 6).alias("level"), markers(b["note_markers"]).alias("m")).alias("h"))), lambda h: h["k"] != "")
    marked = r"\A(#{1,6})" + tx.WS + r"*([^\n]+)\n?\z"
    parts = F.transform(split_text(F.col(text)), lambda p: F.struct(p.rlike(marked).alias("marked"), F.length(F.regexp_extract(p, marked, 1)).alias("n"), F.when(p.rlike(marked), tx.cleanup(F.regexp_extract(p, marked, 2))).otherwise(p).alias("words")))
    keyed = F.transform("_parts", lambda p: F.struct(p["marked"].alias("marked"), p["n"].alias("n"), p["words"].alias("words"), tx.squeeze(p["words"]).alias("k")))
    heads = F.filter("_hints", lambda h: h["type"] == "heading")
    first = F.try_element_at(blocks, F.lit(1))
    rows = rows.withColumns({"_hints": hints, "_parts": parts, "_carried": F.coalesce(first["continued_from_previous"] & (tx.heading_key(first["text"]) != ""), F.lit(False)), "_first": markers(first["note_markers"])})
    rows = rows.withColumns({"_heads": heads, "_quotes": F.transform(F.filter("_hints", lambda h: h["type"] == "quote"), lambda h: h["k"]), "_keyed": keyed})
    hit = F.transform("_keyed", lambda p: F.struct(p["marked"].alias("marked"), p["n"].alias("n"), p["words"].alias("words"), F.array_contains("_quotes", p["k"]).alias("quote"), F.try_element_at(F.filter("_heads", lambda h: h["k"] == p["k"]), F.lit(-1))["h"].alias("h")))
    rows = rows.withColumn("_hit", hit)

    def one(p: Column, i: Column) -> Column:
        kind = F.when(p["marked"] | p["h"].isNotNull(), "heading").when(p["quote"], "quote").otherwise("paragraph")
        opens = (i == 0) & F.col("_carried") & (kind == "paragraph")
        return F.struct(
            kind.alias("type"), F.when(kind == "heading", F.coalesce(p["h"]["level"], p["n"])).otherwise(0).alias("level"), p["words"].alias("text"), opens.alias("continued_from_previous"),
            F.when(kind == "heading", F.coalesce(p["h"]["m"], none)).when(opens, F.col("_first")).otherwise(none).alias("note_markers"),
        )

    return rows.withColumn(out, F.transform("_hit", one)).drop("_hints", "_parts", "_carried", "_first", "_heads", "_quotes", "_keyed", "_hit")


def with_blocks(rows: DataFrame, raw: str = "raw_blocks", text: str = "text", out: str = "blocks") -> DataFrame:
    """``raw``: array of structs of strings (type, level, text, continued_from_previous, note_markers). Unknown types and
    empty texts go; if what is left covers too little of the text, or nothing is left, blocks come from the text."""
    kind = lambda b: F.coalesce(F.nullif(F.lower(tx.strip(b["type"])), F.lit("")), F.lit("paragraph"))
    typed = F.transform(F.filter(raw, lambda b: b.isNotNull() & kind(b).isin("heading", "paragraph", "quote") & (tx.cleanup(b["text"]) != "")), lambda b: F.struct(
        kind(b).alias("type"),
        F.when(kind(b) == "heading", tx.clamp(F.coalesce(F.nullif(b["level"].try_cast("int"), F.lit(0)), F.lit(2)), 1, 6)).otherwise(0).alias("level"),
        tx.cleanup(b["text"]).alias("text"), tx.truthy(b["continued_from_previous"]).alias("continued_from_previous"), markers(b["note_markers"]).alias("note_markers")))
    rows = rows.withColumn("_typed", F.coalesce(typed, F.array().cast(f"array<{BLOCK}>")))
    have = F.aggregate("_typed", F.lit(0), lambda n, b: n + tx.coverage_length(b["text"]))
    short = (F.size("_typed") > 0) & (have < tx.coverage_length(F.col(text)) * LEAST_COVERAGE)
    rows = with_rebuilt(rows.withColumn("_short", F.when(short, F.col(text))), "_typed", "_short", "_again")  # null text: no work
    chosen = F.when(F.size("_typed") == 0, blocks_from_text(F.col(text))).when(F.size("_again") > 0, F.col("_again")).otherwise(F.col("_typed"))
    return rows.withColumn(out, chosen).drop("_typed", "_short", "_again")


def notes(raw: Column) -> Column:
    """``raw``: array of structs of strings with ``plain`` for notes given as bare text. Notes without text go."""
    text = lambda n: tx.cleanup(F.coalesce(n["plain"], n["text"]))
    out = F.transform(F.filter(raw, lambda n: n.isNotNull() & (text(n) != "")), lambda n: F.struct(
        F.when(n["plain"].isNotNull(), "").otherwise(tx.strip(tx.text_or_empty(n["marker"]))).alias("marker"),
        F.when(n["plain"].isNotNull(), "unknown").otherwise(F.coalesce(F.nullif(tx.strip(n["type"]), F.lit("")), F.lit("unknown"))).alias("type"),
        text(n).alias("text"),
        F.when(n["plain"].isNotNull(), "").otherwise(tx.cleanup(n["anchor"])).alias("anchor")))
    return F.coalesce(out, F.array().cast(f"array<{NOTE}>"))


def illustrations(raw: Column) -> Column:
    """``raw``: array of structs (bbox as strings, caption, insert_after). Boxes need four numbers and are kept within the page."""
    box = lambda i: F.transform(i["bbox"], lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.try_cast("double"))))
    good = lambda i: i.isNotNull() & (F.size(i["bbox"]) == 4) & F.forall(i["bbox"], lambda v: v.try_cast("double").isNotNull())
    out = F.transform(F.filter(raw, good), lambda i: F.struct(box(i).alias("bbox"), tx.cleanup(i["caption"]).alias("caption"), tx.cleanup(i["insert_after"]).alias("insert_after")))
    return F.coalesce(out, F.array().cast("array<struct<bbox:array<double>,caption:string,insert_after:string>>"))


def patched(page_blocks: Column, title: Column, continues: Column, patch: Column) -> Column:
    """Blocks after a repair: those at ``delete_block_indices`` go, but never a heading equal to the title on a page that
    starts afresh; flags are then set on the indices as they are after the deletion."""
    doomed = F.coalesce(patch["delete_block_indices"], F.array().cast("array<int>"))
    listed = F.transform(page_blocks, lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    guarded = lambda b: (b["type"] == "heading") & (tx.text_key(b["text"]) == tx.text_key(title)) & (tx.text_key(title) != "") & ~continues
    left = F.transform(F.filter(listed, lambda z: ~F.array_contains(doomed, z["i"]) | guarded(z["b"])), lambda z: z["b"])
    flags = F.coalesce(patch["set_block_continued_from_previous"], F.array().cast("array<struct<block_index:int,value:boolean>>"))
    flag = lambda i: F.try_element_at(F.filter(flags, lambda f: f["block_index"] == i), F.lit(-1))["value"]
    return F.transform(left, lambda b, i: b.withField("continued_from_previous", F.coalesce(flag(i), b["continued_from_previous"])))


def patched_notes(page_notes: Column, patch: Column) -> Column:
    """Notes after a repair: replaced where the patch replaces them, then the added ones appended."""
    none = F.array().cast(f"array<{NOTE}>")
    return F.concat(F.coalesce(patch["replace_notes"], page_notes, none), F.coalesce(patch["add_notes"], none))


PATCH = "struct<set_title:string,set_page_continues_previous:boolean,delete_block_indices:array<int>,set_block_continued_from_previous:array<struct<block_index:int,value:boolean>>,replace_notes:array<" + NOTE + ">,add_notes:array<" + NOTE + ">>"


def patched_page(page_blocks: Column, page_notes: Column, title: Column, continues: Column, patches: Column) -> Column:
    """(title, continues, blocks, notes) of a page after its patches (an array of :data:`PATCH`), one after the other: each
    sees what the one before left. Null or no patches: the page as it is."""
    start = F.struct(title.alias("title"), continues.alias("continues"), page_blocks.alias("blocks"), page_notes.alias("notes"))

    def one(page: Column, patch: Column) -> Column:
        name = F.coalesce(patch["set_title"], page["title"])
        goes_on = F.coalesce(patch["set_page_continues_previous"], page["continues"])
        return F.struct(name.alias("title"), goes_on.alias("continues"), patched(page["blocks"], name, goes_on, patch).alias("blocks"), patched_notes(page["notes"], patch).alias("notes"))

    return F.aggregate(F.coalesce(patches, F.array().cast(f"array<{PATCH}>")), start, one)
