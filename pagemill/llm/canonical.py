"""One consistent form for text that looks the same but differs in its characters.

A value is decomposed, characters are mapped (default-ignorable characters removed, every kind of blank and of hyphen
made plain, full or half width made normal, look-alike letters of other scripts made Latin), composed again, and its
ends are trimmed. ``compat`` adds full compatibility normalisation and ``fold`` full case folding, for comparisons that
ignore those too. Work is done once per distinct value of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import written

# Code points with the property Default_Ignorable_Code_Point.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Code points with the property White_Space.
BLANKS = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# Signs that print as a hyphen.
HYPHENS = (0x2010, 0x2011, 0x2043, 0xFE63, 0xFF0D)
# Letters of other scripts that print like a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F", "Ү": "Y",
    "а": "a", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "с": "c", "ѕ": "s",
    "у": "y", "х": "x", "ԝ": "w", "ԁ": "d", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "հ": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "ɑ": "a", "ɡ": "g", "ı": "i", "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꮃ": "W", "Ꮋ": "H", "Ꮖ": "I", "Ꮪ": "S", "Ꮓ": "Z",
}
LOOK_ALIKES.pop("З")  # prints like a digit, not a letter


CONTROL_BLANK = re.compile("[\x09-\x0d]")


@cache
def char_map() -> dict[int, str | None]:
    """Code point -> replacement, for :meth:`str.translate` on decomposed text."""
    out: dict[int, str | None] = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for lo, hi in IGNORABLE:
        out.update(dict.fromkeys(range(lo, hi + 1)))
    for cp in (*range(0x3000, 0x3001), *range(0xFF01, 0xFFEF)):
        wide = unicodedata.decomposition(chr(cp)).split()
        if wide and wide[0] in ("<wide>", "<narrow>") and cp not in out:
            out[cp] = "".join(chr(int(x, 16)) for x in wide[1:])
    out.update(dict.fromkeys(BLANKS, " "))
    out.update(dict.fromkeys(HYPHENS, "-"))
    return out


def canonical(text: str | None, compat: bool = False, fold: bool = False) -> str | None:
    """The consistent form of ``text``. Null stays null; text of blanks and invisible characters becomes empty.

    Without options only differences that cannot be seen in print vanish: accents, case, raised digits and other signs
    stay. ``compat`` also folds compatibility forms (ligatures, raised digits, ...), ``fold`` also case.
    """
    if text is None:
        return None
    if text.isascii():
        out = text.translate(char_map()) if CONTROL_BLANK.search(text) else text
        return (out.lower() if fold else out).strip(" ")
    out = unicodedata.normalize("NFKD" if compat else "NFD", text).translate(char_map())
    out = unicodedata.normalize("NFKC" if compat else "NFC", out)
    if fold:
        out = unicodedata.normalize("NFKC" if compat else "NFC", out.casefold())
    return out.strip(" ")


def canonical_column(value: Column, compat: bool = False, fold: bool = False) -> Column:
    """Vectorised :func:`canonical`: each distinct value of an Arrow batch is mapped once."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values, use_na_sentinel=True)
        done = [canonical(x, compat, fold) for x in distinct] + [None]
        return pd.Series([done[c] for c in codes], dtype=object)

    return run(value)


def normalised_notes(notes: DataFrame) -> DataFrame:
    """Notes with ``marker_form`` and ``text_form``; each (note_id) once. Null marker or text counts as empty."""
    empty = F.lit("")
    base = notes.select(
        "note_id", "book_id", F.coalesce("marker", empty).alias("marker"), F.coalesce("text", empty).alias("text")
    ).dropDuplicates(["note_id"])
    return base.withColumns({"marker_form": canonical_column(F.col("marker")), "text_form": canonical_column(F.col("text"))})


FORMS = pa.schema([("note_id", pa.int64()), ("book_id", pa.string()), ("block", pa.binary()), ("look", pa.binary()), ("spelling", pa.binary())])
#: Notes of one look that are paired by one task.
PAIR_SHARD = 2_000


def _digest(marker: str, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{len(marker)}:{marker}{text}".encode("utf-8", "surrogatepass"))


def forms(notes: DataFrame) -> DataFrame:
    """(note_id, book_id, block, look, spelling): 128-bit digests of a note's marker and text, in one Arrow pass.

    ``block``: compatibility normalisation composed, full case folding, mapped blanks, ignorables removed. ``look``: the
    printed form, in which accents, case and signs differ; equal looks lie in one block. ``spelling``: the characters.
    Each distinct pair of a batch is mapped once; null marker or text counts as empty. A note delivered twice comes twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, books, markers, texts = (c.to_pylist() for c in batch.columns)
            done: dict[tuple, tuple[bytes, bytes, bytes]] = {}
            out: list[tuple[bytes, bytes, bytes]] = []
            for key in zip(markers, texts):
                got = done.get(key)
                if got is None:
                    m, t = key[0] or "", key[1] or ""
                    look = canonical(m), canonical(t)
                    got = done[key] = (_digest(*(canonical(x, True, True) for x in look)), _digest(*look), _digest(m, t))
                out.append(got)
            columns = zip(*out) if out else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(books, pa.string()), *(pa.array(c, pa.binary()) for c in columns)], schema=FORMS)

    rows = notes.where("book_id IS NOT NULL AND note_id IS NOT NULL").select(F.col("note_id").cast("bigint").alias("note_id"), "book_id", "marker", "text")
    return rows.mapInArrow(run, "note_id bigint, book_id string, block binary, look binary, spelling binary")


def mixed_notes(notes: DataFrame) -> DataFrame:
    """(note_id, book_id, look, spelling, n) of the notes whose look has several spellings in their book; ``n`` of one look.

    Blocks with a single spelling are dropped by an aggregation with map-side combination, so that only the digests of
    the few others move; looks are then told apart within their block.
    """
    rows = written(forms(notes), "note-forms")
    several = lambda key: rows.groupBy(*key).agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select(*key)
    some = written(rows.join(several(["book_id", "block"]), ["book_id", "block"], "left_semi").groupBy("note_id").agg(F.min_by(F.struct("book_id", "look", "spelling"), "spelling").alias("r")).select("note_id", "r.*"), "mixed-blocks")
    looks = some.groupBy("book_id", "look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    return some.join(looks.select("book_id", "look", "n"), ["book_id", "look"])


def look_alike_pairs(notes: DataFrame) -> DataFrame:
    """(note_id_a, note_id_b), a < b: notes of one book that look the same and differ in their characters.

    Exact copies of one spelling are never paired with each other. A look with many notes is cut into shards of its
    second side, so that no task pairs a whole group. Null ``book_id`` matches nothing.
    """
    some = mixed_notes(notes)
    shards = F.ceil(F.col("n") / PAIR_SHARD).cast("int")
    a = some.select("book_id", "look", F.col("note_id").alias("note_id_a"), F.col("spelling").alias("spelling_a"), F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    b = some.select("book_id", "look", F.col("note_id").alias("note_id_b"), F.col("spelling").alias("spelling_b"), F.pmod(F.xxhash64("note_id"), shards).cast("int").alias("shard"))
    return a.join(b, ["book_id", "look", "shard"]).where("note_id_a < note_id_b AND spelling_a <> spelling_b").select("note_id_a", "note_id_b")


def look_alike_classes(notes: DataFrame) -> DataFrame:
    """(note_id, book_id, class_id, n_links): every note that has a look-alike, once; ``class_id`` is the least note of its
    look in its book, ``n_links`` the number of notes of that look in other characters. Grows with the notes alone."""
    some = mixed_notes(notes)
    per = some.groupBy("book_id", "look", "spelling").agg(F.count("*").alias("same"), F.min("note_id").alias("first"))
    least = per.groupBy("book_id", "look").agg(F.min("first").alias("class_id"))
    return some.join(per.drop("first"), ["book_id", "look", "spelling"]).join(least, ["book_id", "look"]).select("note_id", "book_id", "class_id", (F.col("n") - F.col("same")).alias("n_links"))
