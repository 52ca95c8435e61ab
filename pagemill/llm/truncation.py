"""Texts that were cut at a field limit or in transfer.

Lengths are taken under several encodings of a text; per source and field, a length at which unfinished texts pile up
is a hidden storage limit. Endings are then inspected: a text is cut if it stops without a sentence end and is not an
ending that the corpus shows to be complete, or if it stops so exactly at its source's limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import pagetext
from pagemill.llm.canonical import canonical_column
from pagemill.runtime import checked_small, written

#: A limit holds at least so many unfinished texts, and this share of the unfinished ones of its source and field.
LIMIT_RECORDS, LIMIT_SHARE = 5, 0.2
#: An ending without full stop counts as complete if its last two words end a sentence this often.
FINAL_SHARE, FINAL_SEEN = 0.4, 3
SENTENCE_END = pagetext.SENTENCE_END


def lengths(text: Column) -> dict[str, Column]:
    """Length of a text as stored under each encoding: Unicode characters, UTF-8 bytes, UTF-16 units, HTML with markup signs
    and quotes escaped, JSON with and without characters beyond ASCII as they are, and with line feeds as pairs."""
    chars = F.length(text)
    count = lambda signs: chars - F.length(F.regexp_replace(text, signs, ""))
    astral = count(r"[\x{10000}-\x{10FFFF}]")
    quoted = chars + count(r'["\\\x08\x0c\n\r\t]') + 5 * count(r"[\x00-\x07\x0b\x0e-\x1f]")
    return {
        "characters": chars,
        "utf8": F.octet_length(text),
        "utf16": chars + astral,
        "entities": chars + 4 * count("&") + 3 * count("[<>]") + 5 * count("[\"']"),
        "json": quoted,
        "json_ascii": quoted + 5 * count(r"[^\x00-\x7e]") + 6 * astral,
        "crlf": chars + count(r"(?<!\r)\n"),
    }


def length_under(text: Column, encoding: Column) -> Column:
    """The length of a text under the encoding a column names."""
    out = F.lit(None).cast("int")
    for name, n in lengths(text).items():
        out = F.when(encoding == name, n).otherwise(out)
    return out


def limits(records: DataFrame) -> DataFrame:
    """(field, site, encoding, n_limit, n_at, n_unfinished) of the storage limits that the lengths expose.

    ``records``: field, site, text, unfinished. For each field and site the encoding under which the most unfinished
    texts share one length is the one stored by. Groups are counted by length, so no group is gathered.
    """
    by = F.create_map(*[x for k, v in lengths(F.col("text")).items() for x in (F.lit(k), v)])
    counted = (
        records.where("unfinished AND text IS NOT NULL AND site IS NOT NULL").select("field", "site", F.explode(by).alias("encoding", "n_limit"))
        .groupBy("field", "site", "encoding", "n_limit").agg(F.count("*").alias("n_at"))
    )
    total = counted.where("encoding = 'characters'").groupBy("field", "site").agg(F.sum("n_at").alias("n_unfinished"))
    spikes = counted.join(total, ["field", "site"]).where((F.col("n_at") >= LIMIT_RECORDS) & (F.col("n_at") >= LIMIT_SHARE * F.col("n_unfinished")))
    order = {k: i for i, k in enumerate(lengths(F.lit("")))}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    best = spikes.groupBy("field", "site").agg(F.max_by(F.struct("encoding", "n_limit", "n_at", "n_unfinished"), F.struct("n_at", -F.element_at(rank, F.col("encoding")))).alias("b"))
    return best.select("field", "site", "b.*")


#: Endings that stop without a full stop and are complete by their form: marked headings and chapter numerals.
HEADING_END = r"\A\s*(?:#|Chapter\s[^:]*:|[IVXLC]+\.?\s*\z)"


def page_endings(pages: DataFrame, seen: DataFrame, furniture: DataFrame) -> DataFrame:
    """(result_id, ending, complete) of body pages that end unfinished and that the book's next page does not continue.

    ``ending``: the last line that is no running header and no page number; ``complete``: it is a heading. ``seen``,
    ``furniture``: as of :mod:`pagemill.llm.pagetext`.
    """
    tails = seen.where("what = 'foot'").select("result_id", "book_id", "page", "line_no", F.col("left").alias("line")).join(furniture.select("result_id", "line_no"), ["result_id", "line_no"], "left_anti")
    ends = tails.groupBy("result_id", "book_id", "page").agg(F.max_by("line", "line_no").alias("ending")).where(~F.col("ending").rlike(SENTENCE_END))
    goes_on = pages.where("page_continues_previous").select("book_id", (F.col("page") - 1).alias("page")).distinct()
    return ends.join(goes_on, ["book_id", "page"], "left_anti").select("result_id", "ending", F.col("ending").rlike(HEADING_END).alias("complete"))


def page_records(pages: DataFrame, ends: DataFrame) -> DataFrame:
    """(field, row_id, site, text, unfinished, complete) of the pages of ``ends``, whose texts are read again: few pages end so."""
    few = checked_small(ends.select("result_id", "complete"), "page-ends")
    return pages.where(pagetext.BODY).join(few, "result_id").select(F.lit("page_text").alias("field"), F.col("result_id").alias("row_id"), "site", "text", (~F.col("complete")).alias("unfinished"), "complete").dropDuplicates(["row_id"])


def note_endings(notes: DataFrame) -> DataFrame:
    """(note_id, site, text, form, unfinished, pair): notes with their printed form and the last two words of it."""
    base = notes.where("text IS NOT NULL").select("note_id", "site", "text").dropDuplicates(["note_id"])
    form = F.when(F.col("text").rlike(r"\A[\x20-\x7e]*[.!?]\z"), F.col("text")).otherwise(canonical_column(F.col("text")))
    base = base.withColumn("form", form)
    return base.withColumns({"unfinished": ~F.col("form").rlike(SENTENCE_END) & ~F.col("form").rlike(r"[)\]]\s*\z") & (F.col("form") != ""), "pair": last_pair(F.col("form"))})


def bare_words(text: Column) -> Column:
    """The words of a text: lower-cased, digits as #, other signs gone but for the full stop that ends a word."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+", "#"), r"\s+", " ")
    return F.split(F.regexp_replace(low, r"[.!?](?! |\z)|[^\p{L}# .!?]", ""), " ", -1)


def plain_word(word: Column) -> Column:
    return F.translate(word, ".!?", "")


def word_pairs(text: Column) -> Column:
    """[(pair of words, whether a sentence ends after it)]; the text is cleaned once, not word by word."""
    words = bare_words(text)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(F.concat_ws(" ", plain_word(a), plain_word(b)).alias("pair"), b.rlike(r"[.!?]\z").alias("final")))
    return pairs


def last_pair(text: Column) -> Column:
    words = bare_words(F.rtrim(text))
    return F.concat_ws(" ", plain_word(F.try_element_at(words, F.lit(-2))), plain_word(F.try_element_at(words, F.lit(-1))))


def complete_pairs(endings: DataFrame) -> DataFrame:
    """(pair): last words of unfinished notes that the corpus shows to end sentences."""
    asked = checked_small(endings.where("unfinished").select("pair").distinct(), "note-pairs")
    seen = endings.select(F.explode(word_pairs(F.col("form"))).alias("p")).select("p.*").join(asked, "pair", "left_semi")
    return seen.groupBy("pair").agg(F.count("*").alias("n"), F.count_if("final").alias("f")).where(f"n >= {FINAL_SEEN} AND f >= {FINAL_SHARE} * n").select("pair")


def judged_endings(notes: DataFrame) -> DataFrame:
    """:func:`note_endings`, written, with ``complete``: unfinished by its punctuation, but shown complete by the corpus."""
    endings = written(note_endings(notes), "note-endings")
    complete = complete_pairs(endings).withColumn("complete", F.lit(True))
    return written(endings.join(complete, "pair", "left").withColumn("complete", F.coalesce("complete", F.lit(False))), "judged-endings")


def note_records(endings: DataFrame) -> DataFrame:
    """:func:`judged_endings` in the columns of :func:`page_records`; ``unfinished`` without those the corpus shows complete."""
    return endings.where("unfinished").select(F.lit("note").alias("field"), F.col("note_id").alias("row_id"), "site", "text", F.expr("NOT complete").alias("unfinished"), "complete")


def records(pages: DataFrame, notes: DataFrame, books: DataFrame) -> DataFrame:
    """Texts that stop without a sentence end, of both fields, written: field, row_id, site, text, unfinished, complete."""
    seen = written(pagetext.scan(pages), "page-scan")
    ends = written(page_endings(pages, seen, written(pagetext.furniture(seen, books), "furniture")), "page-endings")
    return written(page_records(pages, ends).unionByName(note_records(judged_endings(notes))), "open-texts")


def found(pages: DataFrame, notes: DataFrame, books: DataFrame) -> DataFrame:
    """(field, row_id): ``page_text`` with result_id, ``note`` with note_id. Null and blank texts are no case.

    A text is cut if it stops without a sentence end and its ending is not complete, or if it is, but the text is exactly
    as long, under the encoding its source stores by, as that source's limit for the field.
    """
    rows = records(pages, notes, books)
    own = checked_small(limits(rows).select("field", "site", "encoding", "n_limit"), "limits")
    return rows.join(own, ["field", "site"], "left").where(F.col("unfinished") | (length_under(F.col("text"), F.col("encoding")) == F.col("n_limit"))).select("field", "row_id").distinct()


def site_shares(pages: DataFrame, notes: DataFrame, cut: DataFrame) -> DataFrame:
    """(field, site, n_records, n_cut, share) over body pages with text and notes with text."""
    records = (
        pages.where(pagetext.BODY).select(F.lit("page_text").alias("field"), F.col("result_id").alias("row_id"), "site")
        .unionByName(notes.where("text IS NOT NULL").select(F.lit("note").alias("field"), F.col("note_id").alias("row_id"), "site"))
        .distinct()
    )
    joined = records.join(cut.withColumn("is_cut", F.lit(1)), ["field", "row_id"], "left")
    out = joined.groupBy("field", "site").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("is_cut"), F.lit(0)).alias("n_cut"))
    return out.withColumn("share", F.round(F.col("n_cut") / F.col("n_records"), 6))
