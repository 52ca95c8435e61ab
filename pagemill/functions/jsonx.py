"""Tolerant reading of JSON replies: repair in expressions, the exact parse and salvage in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as tx

#: A string with its end, or what is left of one, or anything up to the next string.
STRING_OR_REST = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"?+\\?|[^"]++)'
# Fixed value: the key position in which a doubled quote is mended.
DOUBLED_KEY = r'([{\[,]\s*)""([A-Za-z_][A-Za-z0-9_]*)"\s*:'


def escape_controls(text: Column) -> Column:
    """Control characters inside strings escaped (line feed, return, tab) or dropped; outside strings all stays."""
    def fix(token: Column) -> Column:
        for raw, seen in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            token = F.replace(token, F.lit(raw), F.lit(seen))
        return F.regexp_replace(token, r"[\x00-\x1f]", "")

    tokens = F.regexp_extract_all(tx.text_or_empty(text), F.lit(STRING_OR_REST), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"'), fix(t)).otherwise(t)), "")


def repair(text: Column) -> Column:
    """Doubled quotes before a key made one, then :func:`escape_controls`."""
    return escape_controls(F.regexp_replace(tx.text_or_empty(text), DOUBLED_KEY, '$1"$2":'))


def candidates(text: Column) -> Column:
    """What may be the JSON of a reply, in the order to try: all of it without a code fence, and from the first brace to
    the last."""
    bare = tx.strip(tx.text_or_empty(text))
    bare = F.regexp_replace(F.regexp_replace(bare, rf"\A```(?:json)?{tx.WS}*", ""), rf"(?s)\A((?!```).*?){tx.WS}*```\z", "$1")
    return F.transform(F.array(bare), lambda b: F.array(b, F.regexp_extract(b, r"(?s)(\{.*\})", 1)))[0]


def _first_parse(tries: list[str] | None) -> str | None:
    for one in tries if tries is not None else ():
        try:
            value = json.loads(one, parse_constant=lambda _: None)
        except (ValueError, RecursionError):
            continue
        return json.dumps(value, ensure_ascii=False).encode("utf-8", "replace").decode()
    return None


def parse(text: Column) -> Column:
    """The first candidate that reads as JSON, written out again; null if none does.

    Not a number reads as null, and of repeated keys the last counts, so the result is strict JSON whatever the input.
    """
    @F.pandas_udf("string")
    def run(tries: pd.Series) -> pd.Series:
        return tries.map(_first_parse)

    first = run(candidates(text))
    # Only what did not read is repaired and tried again.
    return F.coalesce(first, run(F.when(first.isNull(), F.transform(candidates(text), repair))))


ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|u.{4}|.)|\\$", re.S)


def _unescape(m: re.Match) -> str:
    body = m[1]
    if body is None:
        return "\\"
    if body[0] == "u" and len(body) == 5:
        try:
            char = chr(int(body[1:], 16))
            return "�" if "\ud800" <= char <= "\udfff" else char
        except ValueError:
            return "\\" + body
    return ESCAPES.get(body, body)


def string_value(text: Column, key: str) -> Column:
    """The string under the first such key, read even where the JSON around it is broken or ends inside it; else empty."""
    raw = F.regexp_extract(tx.text_or_empty(text), rf'(?s)\A(?:(?!"{key}"\s*:).)*+"{key}"\s*:{tx.WS}*"([^"\\]*+(?:\\.[^"\\]*+)*+)', 1)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: ESCAPE.sub(_unescape, v) if v and "\\" in v else v)

    return run(raw)


def bool_value(text: Column, key: str, default: bool = False) -> Column:
    """The true or false under the first such key that has one."""
    got = F.lower(F.regexp_extract(tx.text_or_empty(text), rf'(?i)"{key}"\s*:\s*(true|false)', 1))
    return F.when(got == "", F.lit(default)).otherwise(got == "true")


BRACES = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}]', re.S)


def complete_objects(text: str | None) -> Iterator[str]:
    """Every balanced ``{...}`` of a text, inner before outer; braces in strings do not count."""
    opened: list[int] = []
    for m in BRACES.finditer(text or ""):
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}" and opened:
            yield text[opened.pop() : m.end()]


@F.udtf(returnType="ord int, object string")
class JsonObjects:
    """Table function: the complete objects of a text, in the order they close."""

    def eval(self, text: str):
        for i, found in enumerate(complete_objects(text)):
            yield i, found


def salvaged_items(text: Column) -> Column:
    """Items {page, block_index, label, level, reason} of a reply that broke off: those of any complete object that holds
    ``items``, or that is an item itself; of equal keys the first."""
    shape = "array<struct<page:int,block_index:int,label:string,level:int,reason:string>>"

    def whole(value, default=None):
        try:
            return int(value)
        except (TypeError, ValueError):
            return default

    def one(reply: str | None) -> list[dict]:
        out: dict[tuple[int, int], dict] = {}
        for found in complete_objects(reply):
            try:
                data = json.loads(found)
            except ValueError:
                continue
            several = data.get("items") if "items" in data else [data] if {"page", "block_index", "label"} <= data.keys() else []
            for item in several if isinstance(several, list) else []:
                if isinstance(item, dict) and (index := whole(item.get("block_index"))) is not None:
                    page = whole(item.get("page") or 0)
                    level = whole(item.get("level") or 1)
                    if page is not None and level is not None:
                        out.setdefault((page, index), {"page": page, "block_index": index, "label": str(item.get("label") or ""), "level": max(1, min(4, level)), "reason": str(item.get("reason") or "")})
        return list(out.values())

    @F.pandas_udf(shape)
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(one)

    return run(repair(text))
