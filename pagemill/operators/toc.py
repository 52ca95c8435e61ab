"""Tables of contents: heading candidates, their filter, chunks for review, plans, and the nesting of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import ordered
from pagemill.runtime import join_key_row, written

#: Page roles whose headings are no entries; most often a heading may recur in a book; longest heading; chunk size.
SKIP_ROLES = ("cover", "blank", "copyright", "back_cover")
MAX_REPEATS, MAX_LENGTH, CHUNK = 3, 80, 60
#: Parts of a heading's rows where they meet the count of its repeats.
REPEAT_PARTS = 8
KEYS = ["book_id", "page", "block_index"]
#: Block numbers of a page stay below this, so that (page, block) orders as one number.
PAGE_STEP = 100_000


def entry_order(page: Column = None, block: Column = None) -> Column:
    return F.coalesce(F.col("page"), F.lit(0)).cast("bigint") * PAGE_STEP + F.col("block_index")


def candidates(pages: DataFrame) -> DataFrame:
    """Every heading block with text. Null page counts as 0, level 0 or null as 2."""
    rows = pages.select("book_id", F.coalesce("page", F.lit(0)).alias("page"), "page_role", F.col("title").alias("page_title"), "page_continues_previous", F.posexplode("blocks").alias("block_index", "b"))
    return rows.where((F.col("b.type") == "heading") & (tx.strip(tx.text_or_empty(F.col("b.text"))) != "")).select(
        "book_id", "page", "block_index", F.col("b.text").alias("text"),
        F.coalesce(F.nullif(F.col("b.level"), F.lit(0)), F.lit(2)).alias("ocr_level"), "page_role", "page_title", "page_continues_previous",
    )


def filtered(cands: DataFrame) -> DataFrame:
    """Candidates that can be entries; a book of which none is left keeps all.

    Dropped: headings without letters to compare, of skipped roles, repeated more than MAX_REPEATS times in their book,
    longer than MAX_LENGTH, or of digits only. Repeats are counted before anything is dropped.
    """
    keyed = cands.withColumns({"key": tx.heading_key(F.col("text")), "cleaned": tx.cleanup(F.col("text"))})
    # Only keys that recur too often meet the rows, each cut into parts: a heading may stand on any share of a book's pages.
    often = keyed.groupBy("book_id", "key").agg(F.count("*").alias("n")).where(F.col("n") > MAX_REPEATS)
    often = often.select("book_id", "key", F.explode(F.array(*map(F.lit, range(REPEAT_PARTS)))).alias("_part"), F.lit(True).alias("often"))
    parted = keyed.withColumn("_part", F.pmod(F.xxhash64("page", "block_index"), F.lit(REPEAT_PARTS)).cast("int"))
    judged = parted.join(often, ["book_id", "key", "_part"], "left").withColumn(
        "keep",
        (F.col("key") != "") & ~F.coalesce(F.col("page_role").isin(*SKIP_ROLES), F.lit(False)) & F.col("often").isNull()
        & (F.length("cleaned") <= MAX_LENGTH) & ~F.col("key").rlike(r"\A\p{Nd}+\z"),
    )
    judged = written(judged, "judged-headings")
    # Whole books without entries are few: their rows come back beside the kept ones, and no row meets a join on its book.
    bare = judged.groupBy("book_id").agg(F.max("keep").alias("any_kept")).where("NOT any_kept").select("book_id", F.lit(True).alias("_all"))
    back = join_key_row(judged.where("NOT keep"), bare, "book_id", ["page", "block_index"], "bare-books")
    return judged.where("keep").select(*cands.columns).unionByName(back.select(*cands.columns))


def compact(cands: DataFrame) -> DataFrame:
    """The five columns a reviewer needs."""
    return cands.select("book_id", "page", "block_index", tx.cleanup(F.col("text")).alias("text"), "ocr_level", "page_role")


def chunked(cands: DataFrame, size: int = CHUNK) -> DataFrame:
    """Candidates with their ``chunk`` number, in page order, ``size`` to a chunk."""
    n = ordered.numbered(cands, "book_id", ["page", "block_index"], "n")
    return n.withColumn("chunk", F.floor((F.col("n") - 1) / F.lit(max(1, size))).cast("int")).drop("n")


def first_per_key(items: DataFrame, keys: list[str] = KEYS, ord_: str = "ord") -> DataFrame:
    """Of items with equal keys the one that comes first."""
    rest = [c for c in items.columns if c not in keys]
    best = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ord_)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def rule_plan(cands: DataFrame, reason: str = "rule") -> DataFrame:
    """The plan when no reviewer answers: every candidate, levels 1 to 4, first of each key."""
    items = cands.select(*KEYS, tx.cleanup(F.col("text")).alias("label"), tx.clamp(F.col("ocr_level"), 1, 4).alias("level"), F.lit(reason).alias("reason"), entry_order().alias("ord"))
    return first_per_key(items.where("label <> ''"))


def only_asked(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Reply items whose key was among their own chunk's candidates."""
    return items.join(chunks.select(*KEYS, "chunk"), [*KEYS, "chunk"], "left_semi")


def overlay(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Plan items met with the entries found in the text, in plan order: a label replaces the text, levels 1 to 4."""
    e = entries.select(*KEYS, F.col("text").alias("entry_text"), F.col("level").alias("entry_level"))
    joined = items.join(e, KEYS)
    level = F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.nullif(F.col("entry_level"), F.lit(0)), F.lit(1))
    return joined.select(*KEYS, F.coalesce(F.nullif(F.col("label"), F.lit("")), "entry_text").alias("text"), tx.clamp(level, 1, 4).alias("level"), "ord")


def planned_levels(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks with ``planned_level``, null where the plan does not name them; of repeated keys the last item counts."""
    plan = items.groupBy(*KEYS).agg(F.max_by("level", "ord").alias("planned_level"))
    return blocks.join(plan, KEYS, "left")


def without_plan(entries: DataFrame, stop_titles: tuple[str, ...] = ()) -> DataFrame:
    """Entries of a book that has no plan: with text, after the first page, not among ``stop_titles``."""
    out = entries.where((F.coalesce("text", F.lit("")) != "") & (F.coalesce("page", F.lit(0)) > 1))
    return out.where(~F.lower("text").isin([t.lower() for t in stop_titles])) if stop_titles else out


def nested(entries: DataFrame) -> DataFrame:
    """Entries with ``ord`` and the ``parent`` they nest under: the nearest earlier entry of a smaller level (1 to 6)."""
    rows = entries.withColumns({"ord": entry_order(), "nav_level": tx.clamp(F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(2)), 1, 6)})
    return ordered.nearest_smaller(rows, "book_id", "ord", "nav_level", 6)


def navigation(entries: DataFrame, deepest: int = 4) -> DataFrame:
    """Entries up to a level, in play order. With ``id`` and ``file`` also their address."""
    kept = entries.where(F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(2)) <= deepest)
    n = ordered.numbered(kept, "book_id", ["page", "block_index"], "play_order")
    return n.withColumn("href", F.concat("file", F.lit("#"), "id")) if {"id", "file"} <= set(entries.columns) else n


def titled_entries(entries: DataFrame, plan: DataFrame | None, stop_titles: tuple[str, ...] = ()) -> DataFrame:
    """The contents of every book: its plan met with its headings, in plan order, or where it has none the headings by
    rule. Columns of ``entries`` (with book_id, page, block_index, text, level) and ``ord``."""
    if plan is None:
        return without_plan(entries, stop_titles).withColumn("ord", entry_order())
    rest = [c for c in entries.columns if c not in (*KEYS, "text", "level")]
    planned = overlay(entries, plan).join(entries.select(*KEYS, *rest), KEYS)
    books = plan.select("book_id", F.lit(True).alias("_has_plan")).distinct()
    free = join_key_row(entries, books, "book_id", ["page", "block_index"], "planned-books", "left").where("_has_plan IS NULL")
    return planned.unionByName(without_plan(free.drop("_has_plan"), stop_titles).withColumn("ord", entry_order()).select(planned.columns))
