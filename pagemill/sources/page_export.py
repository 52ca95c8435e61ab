"""Loading delimited page exports whose lines may not parse.

Every line is read permissively against an explicit all-string schema that keeps the raw text of rows
with a wrong field count; then rows are classified by quoting, count and cast checks. Valid lines load as
typed rows, all others come out with exactly one reason and their raw text. One scan, no Python; a shuffle by line only
takes out repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("book_id", "page", "page_role", "page_continues_previous", "title", "seconds", "text")
CORRUPT = "_corrupt"
RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS] + [T.StructField(CORRUPT, T.StringType())])

# Fixed values of the record layout.
PAGE_ROLES = ("cover", "front_matter", "toc", "body", "illustration", "blank", "copyright", "unknown")
BOOK_ID = r"\Abk-[0-9]{8}\z"
PAGE_NUMBER = r"\A[0-9]*[1-9][0-9]*\z"
SECONDS = r"\A(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\z"

# A field is quoted text, with inner quotes doubled, or text without quote and comma. Possessive loops: no backtracking
# and no stack growth on long lines.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
FIELD = rf'(?:{QUOTED}|[^",]*+)'
RECORD = rf"\A{FIELD}(?:,{FIELD})*+\z"


def record_text(line: Column) -> Column:
    """The line without the one carriage return that ends it."""
    return F.regexp_replace(line, r"\r\z", "")


def field_count(text: Column) -> Column:
    """Fields of a well-quoted record: separators outside quotes, plus one."""
    bare = F.regexp_replace(text, QUOTED, "")
    return F.length(bare) - F.length(F.regexp_replace(bare, ",", "")) + 1


def load(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``reason`` (null for valid lines), the typed record ``rec`` and ``raw`` (only where invalid).

    Null line: reason ``columns``. Empty line: one empty field, so ``columns``. Extra columns pass through; repeated
    rows stay repeated. ``page`` is a bigint; a whole number beyond it stays valid and loads null beside its raw text.
    """
    text = record_text(F.col(line))
    staged = lines.withColumns({
        "_text": text,
        "_rec": F.from_csv(text, RAW_SCHEMA.simpleString()[7:-1].replace(":", " "), {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"',
            "nullValue": "\u0001", "emptyValue": "", "maxCharsPerColumn": "-1",
        }),
    })
    raw = {f: F.coalesce(F.col(f"_rec.{f}"), F.lit("")) for f in FIELDS}
    bad_value = (
        ~raw["book_id"].rlike(BOOK_ID)
        | ~raw["page"].rlike(PAGE_NUMBER)
        | ~raw["page_role"].isin(*PAGE_ROLES)
        | ~raw["page_continues_previous"].isin("true", "false")
        | ~((raw["seconds"] == "") | raw["seconds"].rlike(SECONDS))
        | ((raw["page_role"] == "body") & (raw["text"] == ""))
    )
    reason = (
        F.when(F.col("_text").isNull(), "columns")
        .when(~F.col("_text").rlike(RECORD), "quoting")
        .when((field_count(F.col("_text")) != len(FIELDS)) | F.col(f"_rec.{CORRUPT}").isNotNull(), "columns")
        .when(bad_value, "value")
    )
    typed = F.struct(
        raw["book_id"].alias("book_id"),
        raw["page"].try_cast("bigint").alias("page"),
        raw["page_role"].alias("page_role"),
        (raw["page_continues_previous"] == "true").alias("page_continues_previous"),
        raw["title"].alias("title"),
        raw["seconds"].try_cast("double").alias("seconds"),
        raw["text"].alias("text"),
    )
    return (
        staged.withColumn("reason", reason)
        .withColumns({"rec": F.when(F.col("reason").isNull(), typed), "raw": F.when(F.col("reason").isNotNull() | F.col("_rec.page").try_cast("bigint").isNull(), F.col(line))})
        .drop("_text", "_rec")
    )


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of every invalid line, each once."""
    return load(lines.select("line_id", "line")).where("reason IS NOT NULL").select("line_id", "reason").distinct()


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, line_no, reason, raw): every invalid line once, with its raw text."""
    keep = [c for c in ("file_name", "line_no") if c in lines.columns]
    bad = load(lines.select("line_id", *keep, "line")).where("reason IS NOT NULL").select("line_id", F.struct(*keep, "reason", "raw").alias("r"))
    return bad.groupBy("line_id").agg(F.first("r").alias("r")).select("line_id", "r.*")


def accepted(lines: DataFrame) -> DataFrame:
    """The valid lines as typed rows, each line_id once."""
    keep = [c for c in ("line_id", "file_name", "line_no") if c in lines.columns]
    good = load(lines.select(*keep, "line")).where("reason IS NULL").select(*keep, "rec.*")
    return good.dropDuplicates(["line_id"])
