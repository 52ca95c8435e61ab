"""Model replies to pages: tolerant parse, normalisation, and the backup tier for replies that cannot be parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import jsonx
from pagemill.functions import text as tx
from pagemill.operators import normalize, resume

_S = "string"
RAW = (
    "struct<text:string,page_continues_previous:string,page_role:string,title:string,has_illustrations:string,"
    "blocks:array<string>,notes:array<string>,illustrations:array<string>>"
)
RAW_BLOCK = "struct<type:string,level:string,text:string,continued_from_previous:string,note_markers:array<string>>"
RAW_NOTE = "struct<marker:string,type:string,text:string,anchor:string>"
RAW_FIGURE = "struct<bbox:array<string>,caption:string,insert_after:string>"


def normalised(replies: DataFrame, reply: str = "response_text") -> DataFrame:
    """Replies with the page schema, ``tier`` (parsed, backup, none) and ``status`` (ok, unusable, invalid_json).

    List elements are kept as text first, so that one odd element never spoils its list. A reply that does not read as
    an object falls back to its text, role, title and flag by pattern; one without usable text is invalid.
    """
    rows = replies.withColumn("_json", jsonx.parse(F.col(reply)))
    rows = rows.withColumn("_is_object", F.coalesce(F.col("_json").startswith("{"), F.lit(False)))
    rows = rows.withColumn("_r", F.from_json(F.when(F.col("_is_object"), F.col("_json")), RAW))
    part = lambda name, kind: F.transform(F.col(f"_r.{name}"), lambda x: F.when(x.startswith("{"), F.from_json(x, kind)))
    read = F.transform("_r.notes", lambda x: F.struct(F.from_json(x, RAW_NOTE).alias("r"), F.when(~x.startswith("{"), x).alias("plain")))  # each note read once
    notes = F.transform(read, lambda z: F.struct(*(z["r"][c].alias(c) for c in ("marker", "type", "text", "anchor")), z["plain"].alias("plain")))
    broken = F.when(~F.col("_is_object"), F.col(reply))  # only what did not read is searched
    back = {k: F.coalesce(jsonx.string_value(broken, k), F.lit("")) for k in ("text", "page_role", "title")}
    rows = rows.withColumns({
        "_text": F.when(F.col("_is_object"), tx.cleanup(F.col("_r.text"))).otherwise(tx.cleanup(back["text"])),
        "raw_blocks": part("blocks", RAW_BLOCK), "_notes": notes, "_figures": part("illustrations", RAW_FIGURE),
        "page_role": F.coalesce(F.nullif(F.when(F.col("_is_object"), F.col("_r.page_role")).otherwise(back["page_role"]), F.lit("")), F.lit("unknown")),
        "title": tx.strip(tx.text_or_empty(F.when(F.col("_is_object"), F.col("_r.title")).otherwise(back["title"]))),
        "page_continues_previous": F.when(F.col("_is_object"), tx.truthy(F.col("_r.page_continues_previous"))).otherwise(jsonx.bool_value(broken, "page_continues_previous")),
    })
    rows = normalize.with_blocks(rows, "raw_blocks", "_text", "blocks")
    rows = rows.withColumns({
        "text": F.when(F.col("_text") != "", F.col("_text")).otherwise(tx.markdown(F.col("blocks"))),
        "notes": normalize.notes(F.col("_notes")), "illustrations": normalize.illustrations(F.col("_figures")),
    })
    rows = rows.withColumns({
        "has_illustrations": tx.truthy(F.col("_r.has_illustrations")) | (F.size("illustrations") > 0),
        "tier": F.when(F.col("_is_object"), "parsed").when(F.col("_text") != "", "backup").otherwise("none"),
    })
    rows = resume.status(rows)
    return rows.withColumn("status", F.when(F.col("tier") == "none", "invalid_json").otherwise(F.col("status"))).drop("_json", "_is_object", "_r", "_text", "raw_blocks", "_notes", "_figures")


# What the server's failures say where it cannot read an image.
VISION_FAILURES = ("Qwen3VLProcessor", "Qwen2VLProcessor")
FAILED_IMAGES = ("Failed to apply", "images")


def is_vision_failure(message: Column) -> Column:
    """Whether a failure's text, raw or labelled, says that the images could not be prepared."""
    named = F.lit(False)
    for name in VISION_FAILURES:
        named = named | message.contains(name)
    apply, images = FAILED_IMAGES
    return F.coalesce(named | (message.contains(apply) & message.contains(images)) | F.lower(message).contains("vision preprocessing failed"), F.lit(False))


def error_class(message: str = "error", finish: str = "finish_reason"):
    """The class of a failed attempt by its message and finish reason."""
    m = F.lower(tx.text_or_empty(F.col(message)))
    return (
        F.when(F.lower(finish).isin("length", "max_tokens"), "truncated")
        .when(is_vision_failure(F.col(message)), "fatal_vision")
        .when(m.contains("repeat"), "repetition")
        .when(m.contains("json"), "invalid_json")
        .when(m != "", "other")
    )
