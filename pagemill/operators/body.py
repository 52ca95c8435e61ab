"""The body of a book from its pages: which blocks stand, where notes and figures go, and paragraphs over page ends.

Matching of notes and figures to blocks is row-local: a page's notes, figures and blocks are one row, so no join and no
shuffle is needed. Order over pages comes from :mod:`pagemill.operators.ordered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import ordered
from pagemill.runtime import join_key_row, written

CHAPTER_ONLY = rf"\A第[{tx.HEADING_NUMERALS}]+章\z"


def blank_pages(pages: DataFrame) -> DataFrame:
    """Pages that add nothing: role blank, without text and illustrations."""
    return pages.where((F.col("page_role") == "blank") & (tx.text_or_empty(F.col("text")) == "") & (F.size("illustrations") == 0))


def is_running_header(block: Column, index: Column, page_title: Column, continues: Column, headings: tuple[str, ...] = ()) -> Column:
    """A heading at the head of a continuing page that repeats the title, is in ``headings``, or is a bare chapter number."""
    key, title = tx.text_key(block["text"]), tx.text_key(page_title)
    same = (title != "") & (key == title)
    listed = key.isin(*headings) if headings else F.lit(False)
    return (index == 0) & continues & (block["type"] == "heading") & (same | listed | key.rlike(CHAPTER_ONLY))


def planned_pages(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Pages with ``_plan``, the planned level by block number, and ``_has_plan``, whether their book has a plan.

    ``plan``: book_id, page, block_index, level, ord; of items with equal keys the last counts."""
    items = plan.groupBy("book_id", "page", "block_index").agg(F.max_by("level", "ord").alias("level"))
    per = items.groupBy("book_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("block_index", "level"))).alias("_plan"))
    books = plan.select("book_id").distinct().withColumn("_has_plan", F.lit(True))
    rows = pages.withColumn("_page", F.coalesce("page", F.lit(0))).join(per.withColumnRenamed("page", "_page"), ["book_id", "_page"], "left").drop("_page")
    rows = join_key_row(rows, books, "book_id", ["result_id"], "planned-books", "left")
    return rows.withColumns({"_has_plan": F.coalesce("_has_plan", F.lit(False)), "_plan": F.coalesce("_plan", F.create_map().cast("map<int,int>"))})


def kept_blocks(pages: DataFrame, headings: tuple[str, ...] = (), plan: DataFrame | None = None) -> DataFrame:
    """Pages with ``kept``: their blocks with text, each with its ``block_index``. Pages without blocks get them from
    their text.

    In a book with a plan exactly the planned headings stay, at their planned level. In any other running headers and
    headings that repeat an illustration's caption are left out.
    """
    pages = pages.withColumns({"_has_plan": F.lit(False), "_plan": F.create_map().cast("map<int,int>")}) if plan is None else planned_pages(pages, plan)
    kind = pages.schema["blocks"].dataType.elementType
    made = F.transform(tx.fallback_blocks(F.col("text")), lambda b: F.struct(b["type"].alias("type"), b["level"].alias("level"), b["text"].alias("text"), b["continued_from_previous"].alias("continued_from_previous"), F.array().cast("array<string>").alias("note_markers")).cast(kind))
    base = pages.withColumn("blocks", F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(made))
    captions = F.array_distinct(F.filter(F.transform("illustrations", lambda i: tx.text_key(i["caption"])), lambda c: c != ""))
    listed = F.transform("blocks", lambda b, i: F.struct(i.alias("block_index"), b["type"].alias("type"), F.coalesce(F.try_element_at("_plan", i), b["level"]).alias("level"), F.map_contains_key("_plan", i).alias("planned"), tx.strip(tx.text_or_empty(b["text"])).alias("text"), F.coalesce(b["continued_from_previous"], F.lit(False)).alias("continued"), F.filter(F.transform(F.coalesce(b["note_markers"], F.array().cast("array<string>")), tx.strip), lambda m: F.coalesce(m != "", F.lit(False))).alias("markers")))
    base = base.withColumns({"_captions": captions, "_listed": listed})
    skip = lambda z: (z["type"] == "heading") & ~z["planned"] & (F.col("_has_plan") | F.array_contains("_captions", tx.text_key(z["text"])) | is_running_header(z, z["block_index"], F.col("title"), F.col("page_continues_previous"), headings))
    return base.withColumn("kept", F.filter("_listed", lambda z: (z["text"] != "") & ~F.coalesce(skip(z), F.lit(False)))).withColumn("_markers", F.array_distinct(F.flatten(F.transform("_listed", lambda z: z["markers"])))).drop("_captions", "_listed", "_has_plan", "_plan")


def _notes(kept: str = "kept") -> Column:
    """The page's notes in order, each with the number of its block; see :func:`matched_notes`."""
    def place(marker: Column, anchor: Column) -> Column:
        named = (marker != "") & F.array_contains("_markers", marker)
        fits = F.filter(kept, lambda b: (named & F.array_contains(b["markers"], marker)) | (~named & (anchor != "") & b["text"].contains(anchor)))
        return F.try_element_at(F.transform(fits, lambda b: b["block_index"]), F.lit(1))

    bare = F.transform("notes", lambda n: F.struct(*(tx.strip(tx.text_or_empty(n[c])).alias(c) for c in ("marker", "type", "text", "anchor"))))
    return F.transform(bare, lambda n: F.struct(n["marker"].alias("marker"), place(n["marker"], n["anchor"]).alias("block_index"), n["type"].alias("type"), n["text"].alias("text"), n["anchor"].alias("anchor")))


def matched_notes(kept: DataFrame) -> DataFrame:
    """(result_id, book_id, page, note_index, marker, block_index, type, text, anchor): the block each note belongs to,
    null for none.

    A marker that any block of the page names decides alone; otherwise the note's anchor may stand in the block's text.
    The first kept block that matches takes the note.
    """
    rows = kept.select("result_id", "book_id", "page", F.posexplode(_notes()).alias("note_index", "m"))
    return rows.select("result_id", "book_id", "page", "note_index", "m.marker", "m.block_index", "m.type", "m.text", "m.anchor")


def _figures(kept: str = "kept") -> Column:
    def place(anchor: Column) -> Column:
        fits = F.filter(kept, lambda b: (anchor == "") | b["text"].contains(anchor))
        return F.try_element_at(F.transform(fits, lambda b: b["block_index"]), F.lit(1))

    return F.transform("illustrations", lambda i: F.struct(place(tx.text_or_empty(i["insert_after"])).alias("block_index"), tx.text_or_empty(i["caption"]).alias("text")))


def placed_figures(kept: DataFrame) -> DataFrame:
    """(result_id, book_id, page, figure_index, block_index, text): the kept block each figure follows; null: the page's end.

    ``text`` is the caption. A figure without anchor follows the first kept block, any other the first whose text holds its anchor.
    """
    rows = kept.select("result_id", "book_id", "page", F.posexplode(_figures()).alias("figure_index", "f"))
    return rows.select("result_id", "book_id", "page", "figure_index", "f.block_index", "f.text")


def crop(bbox: Column, width: int, height: int) -> Column:
    """Pixel rectangle of a box given in shares of the page, at least one pixel wide and high; null for fewer or more
    than four values. ``ordered``: whether the corners come in order."""
    edge = lambda v, size, low: F.greatest(low, F.least(F.lit(size), (v * size).cast("int")))
    x1, y1, x2, y2 = (F.try_element_at(bbox, F.lit(i)) for i in range(1, 5))
    left = F.greatest(F.lit(0), F.least(F.lit(width - 1), (x1 * width).cast("int")))
    top = F.greatest(F.lit(0), F.least(F.lit(height - 1), (y1 * height).cast("int")))
    return F.when((F.size(bbox) == 4) & F.forall(bbox, lambda v: v.isNotNull()), F.struct(left.alias("left"), top.alias("top"), edge(x2, width, left + 1).alias("right"), edge(y2, height, top + 1).alias("bottom"), ((x1 < x2) & (y1 < y2)).alias("ordered")))


def elements(kept: DataFrame) -> DataFrame:
    """(book_id, page, result_id, block_index, slot, sub, kind, text, wants, type, level, marker, anchor): everything the body shows, in its order.

    ``kind`` p, h, note or figure. A page's block comes first, then the notes and figures it takes; figures and notes
    that found no block stand at the page's end. Written once to the shared folder. ``wants``: a first paragraph that continues the page before.
    ``text`` of a figure is its caption; ``level`` is that of a block, ``marker`` and ``anchor`` are those of a note.
    """
    none, end = F.lit(None), F.lit(ordered_end())
    shape = "array<struct<block_index:int,slot:int,sub:int,kind:string,text:string,wants:boolean,type:string,level:int,marker:string,anchor:string>>"
    own = lambda b: (b["block_index"] == 0) & (b["type"] == "paragraph") & (F.col("page_continues_previous") | b["continued"])
    blocks = F.transform("_kept", lambda b: F.struct(b["block_index"], F.lit(0), F.lit(0), F.when(b["type"] == "heading", "h").otherwise("p"), b["text"], own(b), b["type"], b["level"].cast("int"), none, none)).cast(shape)
    notes = F.transform(_notes("_kept"), lambda n, i: F.struct(F.coalesce(n["block_index"], end), F.lit(1), i, F.lit("note"), n["text"], F.lit(False), n["type"], none, n["marker"], n["anchor"])).cast(shape)
    figures = F.transform(_figures("_kept"), lambda f, i: F.struct(F.coalesce(f["block_index"], end), F.lit(2), i, F.lit("figure"), f["text"], F.lit(False), none, none, none, none)).cast(shape)
    # The kept blocks are computed once a row, then everything of a page comes out of one array. The written table between
    # keeps the expressions from being copied into each use.
    rows = written(kept.select("book_id", "page", "result_id", "page_continues_previous", F.col("kept").alias("_kept"), "_markers", "notes", "illustrations"), "kept")
    every = rows.select("book_id", "page", "result_id", F.explode(F.concat(blocks, notes, figures)).alias("x")).select("book_id", "page", "result_id", "x.*")
    return written(every, "elements")  # read by several ordered passes


def ordered_end() -> int:
    """The block number under which a page's unplaced notes and figures stand."""
    return 1_000_000


ORDER = ["page", "block_index", "slot", "sub"]


def merged_paragraphs(parts: DataFrame) -> DataFrame:
    """Elements with ``piece``, the number within the book of the shown piece they belong to, and ``merges``.

    A first paragraph that continues the page before joins the last shown piece if that is a paragraph; a heading, note
    or figure in between keeps them apart.
    """
    rows = ordered.with_previous(parts, "book_id", ORDER, F.col("kind"), "before")
    rows = rows.withColumn("merges", F.col("wants") & F.coalesce(F.col("before") == "p", F.lit(False)))
    return ordered.running_sums(rows, "book_id", ORDER, {"piece": F.when(F.col("merges"), 0).otherwise(1)}).drop("before")


def counters(parts: DataFrame) -> DataFrame:
    """Elements with running numbers of headings, blocks, notes and figures within the book."""
    is_block = F.col("slot") == 0
    return ordered.running_sums(parts, "book_id", ORDER, {
        "heading_no": F.when(F.col("kind") == "h", 1).otherwise(0), "block_no": F.when(is_block, 1).otherwise(0),
        "note_no": F.when(F.col("kind") == "note", 1).otherwise(0), "figure_no": F.when(F.col("kind") == "figure", 1).otherwise(0),
    })
