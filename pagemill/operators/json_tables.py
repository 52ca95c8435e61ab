"""Deeply nested JSON records into flat, linked tables.

A record is parsed as a stream of tokens into (path, ordinals, value) triples: ``path`` names the keys with ``[]`` at
each repeated level, ``ordinals`` holds the position at each of those levels. Paths are then grouped by their nearest
repeated ancestor, and each group is pivoted into one table keyed by the record and its ordinals, so that a child row
carries its parent's key as a prefix of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import written

#: Strict JSON tokens; a string token may not hold raw control characters.
TOKEN = re.compile(
    r'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))'
)
BLANK = re.compile(r"[ \t\r\n]*\Z")
SURROGATE = re.compile("[\ud800-\udfff]")

#: Under these keys a value that is not a list counts as a list of one.
LISTS = frozenset({"results[].blocks", "results[].notes", "results[].illustrations", "results[].blocks[].note_markers"})

#: Signs of a key that would read as part of a path, and how a path names them.
SIGNS = re.compile("[~.\\[\ud800-\udfff]")
SIGN_NAMES = {"~": "~0", ".": "~1", "[": "~2"}

Triple = tuple[str, tuple[int, ...], str, str | None]


def step(key: str) -> str:
    """A key as a path names it: no two keys have one name, and a key that holds dots or brackets is no level."""
    return SIGNS.sub(lambda m: SIGN_NAMES.get(m[0]) or f"~{ord(m[0]):x}", key) or "~"


def triples(text: str, lists: frozenset[str] = LISTS) -> list[Triple] | None:
    """(path, ordinals, kind, value) of one JSON text in document order; None if it is not valid JSON.

    Containers give a triple of kind ``object`` or ``array`` without value, so that empty records keep their row.
    Of a repeated key the last value counts. ``null`` gives kind ``null``. NaN and Infinity are not JSON.
    The parser keeps one open-container stack; it never builds the tree. As nothing of an invalid record may come out, a
    record's triples are held until its end has been read.
    """
    out: list[Triple] = []
    # Each frame: [is_object, path, ordinals, next_index or seen keys, first triple of the current key]
    stack: list[list] = []
    path, ords = "", ()
    state, pos, end, match = "value", 0, len(text), TOKEN.match
    key = ""

    def place() -> tuple[str, tuple[int, ...]]:
        if not stack:
            return "", ()
        frame = stack[-1]
        if frame[0]:
            return f"{frame[1]}.{key}" if frame[1] else key, frame[2]
        frame[3] += 1
        return frame[1] + "[]", (*frame[2], frame[3] - 1)

    while True:
        m = match(text, pos)
        if m is None:
            return out if state == "end" and BLANK.match(text, pos) else None
        if state == "end":
            return None
        pos = m.end()
        sign, string, number, word = m.groups()
        if state in ("value", "first_item"):
            if sign == "]" and state == "first_item":
                stack.pop()
            elif sign in ("{", "["):
                path, ords = place()
                if sign == "{" and path in lists:  # a lone object stands for a list of one
                    path, ords = path + "[]", (*ords, 0)
                out.append((path, ords, "object" if sign == "{" else "array", None))
                stack.append([sign == "{", path, ords, {} if sign == "{" else 0])
                state = "first_key" if sign == "{" else "first_item"
                continue
            elif sign is not None:
                return None
            else:
                path, ords = place()
                if path in lists and word != "null":
                    path, ords = path + "[]", (*ords, 0)
                if string is not None:
                    value = string[1:-1] if "\\" not in string else json.loads(string)
                    if "\\u" in string:
                        value = SURROGATE.sub("�", value)
                    out.append((path, ords, "string", value))
                elif number is not None:
                    out.append((path, ords, "number", number))
                else:
                    out.append((path, ords, "null" if word == "null" else "boolean", None if word == "null" else word))
        elif state in ("first_key", "key"):
            if string is not None:
                key = step(string[1:-1] if "\\" not in string else json.loads(string))
                seen = stack[-1][3]
                if key in seen:  # a repeated key: drop what the earlier one gave
                    at = f"{stack[-1][1]}.{key}" if stack[-1][1] else key
                    first = seen[key]
                    depth = len(stack[-1][2])
                    own = stack[-1][2]
                    out[first:] = [
                        t for t in out[first:]
                        if not (t[1][:depth] == own and (t[0] == at or t[0].startswith((at + ".", at + "["))))
                    ]
                seen[key] = len(out)
                state = "colon"
                continue
            if sign == "}" and state == "first_key":
                stack.pop()
            else:
                return None
        elif state == "colon":
            if sign != ":":
                return None
            state = "value"
            continue
        elif state == "after":
            if sign == ",":
                state = "key" if stack[-1][0] else "value"
                continue
            if sign == ("}" if stack[-1][0] else "]"):
                stack.pop()
            else:
                return None
        state = "after" if stack else "end"
        if state == "end" and pos == end:
            return out


TRIPLE_SCHEMA = pa.schema([
    ("cache_id", pa.int64()), ("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string()),
])


def to_triples(records: DataFrame, id_col: str = "cache_id", json_col: str = "cache_json", root: str | None = "results[]") -> DataFrame:
    """(id, path, ordinals, kind, value) rows of all valid records; ``root`` keeps only paths below it.

    Null, empty and invalid texts give no rows. A record given twice under one id is parsed once.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, ordinals, kinds, values = [], [], [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or rid is None:
                    continue
                for p, o, k, v in triples(text) or ():
                    if root is None or p.startswith(root):
                        ids.append(rid); paths.append(p); ordinals.append(o); kinds.append(k); values.append(v)  # noqa: E702
                if len(ids) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, paths, ordinals, kinds, values), TRIPLE_SCHEMA.types)], schema=TRIPLE_SCHEMA)
                    ids, paths, ordinals, kinds, values = [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, paths, ordinals, kinds, values), TRIPLE_SCHEMA.types)], schema=TRIPLE_SCHEMA)

    rows = records.select(F.col(id_col).cast("bigint").alias("cache_id"), F.col(json_col).alias("j")).dropDuplicates(["cache_id"])
    return rows.mapInArrow(parse, "cache_id bigint, path string, ordinals array<int>, kind string, value string")


#: Table name -> (repeated ancestor, columns pivoted from the leaf paths below it with their types).
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "caches": ("", {"title": "string", "source_pdf": "string", "pdf_fingerprint": "string", "page_count": "int", "cover_page": "int", "completed_pages": "int"}),
    "authors": ("authors[]", {}),
    "pages": ("results[]", {"page": "int", "page_role": "string", "title": "string", "text": "string", "image_path": "string", "page_continues_previous": "boolean", "has_illustrations": "boolean", "seconds": "double"}),
    "blocks": ("results[].blocks[]", {"type": "string", "level": "int", "text": "string", "continued_from_previous": "boolean"}),
    "block_markers": ("results[].blocks[].note_markers[]", {}),
    "notes": ("results[].notes[]", {"marker": "string", "type": "string", "text": "string", "anchor": "string"}),
    "illustrations": ("results[].illustrations[]", {"caption": "string", "insert_after": "string"}),
}
#: Groups that are columns of another table's rows.
FOLDED = ("results[].illustrations[].bbox[]",)
KEY_NAMES = ("result_index", "item_index", "sub_index")


def ancestor_of(path: Column) -> Column:
    """The nearest repeated ancestor of a path, itself if it is one; empty for paths of the record itself."""
    return F.regexp_extract(path, r"(?s)\A(.*\[\])", 1)


def column_of(path: Column, ancestor: Column) -> Column:
    """What a path is called within its group; empty for the element itself."""
    return F.regexp_replace(F.substr(path, F.length(ancestor) + 1), r"\A\.", "")


def keys_of(name: str) -> list[str]:
    depth = TABLES[name][0].count("[]")
    return ["author_index"] if name == "authors" else list(KEY_NAMES[:depth])


def flat_table(parsed: DataFrame, name: str) -> DataFrame:
    """One table of :data:`TABLES`: keys (cache_id[, result_index[, item_index[, sub_index]]]), ``kind`` of the element,
    ``value`` (for elements that are plain strings or numbers), the pivoted columns, and ``other``, every further value of
    the element by its path, so that no field is lost. Null elements give no row; positions count them. The parent's key is
    this key without its last part."""
    ancestor, columns = TABLES[name]
    keys = keys_of(name)
    group = ancestor_of(F.col("path"))
    box = F.lit(FOLDED[0]) if name == "illustrations" else F.lit(None).cast("string")
    rows = parsed.where(F.col("path").startswith(ancestor)).where((group == ancestor) | F.coalesce(F.col("path") == box, F.lit(False)))
    rows = rows.select("cache_id", "path", "kind", "value", "ordinals", column_of(F.col("path"), F.lit(ancestor)).alias("column"), *(F.get("ordinals", F.lit(i)).alias(k) for i, k in enumerate(keys)))
    own = F.col("path") == ancestor
    aggs = [F.max(F.when(own, F.col("kind"))).alias("kind"), F.max(F.when(own, F.col("value"))).alias("value")]
    aggs += [F.max(F.when(F.col("column") == c, F.col("value"))).try_cast(t).alias(c) for c, t in columns.items()]
    if name == "illustrations":
        part = F.when(F.col("path") == box, F.struct(F.get("ordinals", F.lit(2)).alias("i"), F.col("value").try_cast("double").alias("v")))
        aggs.append(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["v"]).alias("bbox"))
    further = ~F.col("column").isin("", *columns) & F.col("value").isNotNull() & (group == ancestor)
    aggs.append(F.map_from_entries(F.collect_list(F.when(further, F.struct("column", "value")))).alias("other"))
    return rows.groupBy("cache_id", *keys).agg(*aggs).where("kind <> 'null'")


def elements(parsed: DataFrame, wanted: Column) -> DataFrame:
    """(cache_id, ancestor, ordinals, kind, value, fields): every element of the repeated groups that ``wanted`` tells by
    ``ancestor``, pivoted into one row with its fields by path. ``ordinals`` is the element's key; without its last part
    it is its parent's. Null elements give no row; positions count them."""
    rows = parsed.withColumn("ancestor", ancestor_of(F.col("path"))).where(wanted)
    rows = rows.withColumn("column", column_of(F.col("path"), F.col("ancestor")))
    own = F.col("column") == ""
    return rows.groupBy("cache_id", "ancestor", "ordinals").agg(
        F.max(F.when(own, F.col("kind"))).alias("kind"), F.max(F.when(own, F.col("value"))).alias("value"),
        F.map_from_entries(F.collect_list(F.when(~own & F.col("value").isNotNull(), F.struct("column", "value")))).alias("fields"),
    ).where("kind <> 'null'")


def further_groups(parsed: DataFrame) -> DataFrame:
    """The :func:`elements` of every repeated group that has no table of its own."""
    return elements(parsed, ~F.col("ancestor").isin(*(a for a, _ in TABLES.values()), *FOLDED))


def every_table(records: DataFrame) -> dict[str, DataFrame]:
    """All tables of the records and ``further``, from triples that are parsed and written once."""
    parsed = written(to_triples(records, root=None), "triples")
    return {name: flat_table(parsed, name) for name in TABLES} | {"further": further_groups(parsed)}


#: Kind of a child record -> its table.
CHILDREN = {"block": "blocks", "note": "notes", "illustration": "illustrations", "marker": "block_markers"}


def children(parsed: DataFrame) -> DataFrame:
    """(cache_id, result_index, kind, item_index, sub_index) of every block, note, illustration and block note marker: the
    keys of their groups' rows, grouped and pivoted in one pass. What the keys do not need of a row is not computed."""
    kinds = {TABLES[t][0]: k for k, t in CHILDREN.items()}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return elements(parsed, F.col("ancestor").isin(*kinds)).select(
        "cache_id", F.get("ordinals", F.lit(0)).alias("result_index"), F.element_at(kind, F.col("ancestor")).alias("kind"),
        F.get("ordinals", F.lit(1)).alias("item_index"), F.coalesce(F.get("ordinals", F.lit(2)), F.lit(-1)).alias("sub_index"),
    )
