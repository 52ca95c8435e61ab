"""Queries of the general training-data operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import json_tables
from pagemill.runtime import Query, table, written
from pagemill.sources import page_export


def p1_found(spark, root):
    return page_export.rejected(table(spark, root, "page_export"))


def p1_loaded(spark, root):
    return page_export.accepted(table(spark, root, "page_export"))


def p1_rejected(spark, root):
    return page_export.rejected_lines(table(spark, root, "page_export"))


def _triples(spark, root, within="results[]"):
    return json_tables.to_triples(table(spark, root, "recovery_caches"), root=within)


def p2_found(spark, root):
    return json_tables.children(_triples(spark, root))


def _flat(name: str) -> Query:
    within = "results[]" if json_tables.TABLES[name][0].startswith("results[]") else None
    return lambda spark, root: json_tables.flat_table(_triples(spark, root, within), name)


def p2_further(spark, root):
    """Elements of all other repeated groups."""
    return json_tables.further_groups(_triples(spark, root, None))


def p2_keys(spark, root):
    """Type and text of every block by its key."""
    return json_tables.flat_table(_triples(spark, root), "blocks").select("cache_id", "result_index", "item_index", "type", "text")


def p2_note_texts(spark, root):
    """The text of every note by its key, whether it is a record or plain text."""
    t = json_tables.flat_table(_triples(spark, root), "notes")
    return t.select("cache_id", "result_index", "item_index", F.coalesce("text", "value").alias("text"))


def p2_page_links(spark, root):
    """Every page with the number of blocks that point to it."""
    t = written(_triples(spark, root), "triples")
    n = json_tables.flat_table(t, "blocks").groupBy("cache_id", "result_index").agg(F.count("*").alias("blocks"))
    return json_tables.flat_table(t, "pages").select("cache_id", "result_index", "page_role", "title").join(n, ["cache_id", "result_index"], "left").fillna(0, ["blocks"])


QUERIES: dict[str, Query] = {
    "p2_keys": p2_keys,
    "p2_note_texts": p2_note_texts,
    "p2_page_links": p2_page_links,
    "p1_found": p1_found,
    "p1_loaded": p1_loaded,
    "p1_rejected": p1_rejected,
    "p2_found": p2_found,
    "p2_further": p2_further,
    **{f"p2_{name}": _flat(name) for name in json_tables.TABLES},
}

_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_LINES = f"""
WITH l AS (SELECT DISTINCT line_id, regexp_replace(line, '\\r$', '') AS t FROM page_export),
c AS (SELECT line_id, t, regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*', 's') AS quoted,
             len(string_split(regexp_replace(t, '"[^"]*(?:""[^"]*)*"', '', 'gs'), ',')) AS n FROM l),
f AS (SELECT *, CASE WHEN quoted AND n = 7 THEN regexp_extract(t, '^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', ['a','b','c','d','e','f','g'], 's') END AS r FROM c),
u AS (SELECT line_id, t, quoted, n, """ + ", ".join(
    f"""CASE WHEN r.{x} LIKE '"%' THEN replace(r.{x}[2:-2], '""', '"') ELSE r.{x} END AS {x}""" for x in "abcdefg"
) + " FROM f)"
_BAD = """(NOT regexp_full_match(a, 'bk-[0-9]{8}') OR NOT regexp_full_match(b, '[0-9]*[1-9][0-9]*')
 OR c NOT IN ('cover','front_matter','toc','body','illustration','blank','copyright','unknown') OR d NOT IN ('true','false')
 OR NOT (f = '' OR regexp_full_match(f, '[0-9]+(\\.[0-9]+)?|\\.[0-9]+')) OR (c = 'body' AND g = ''))"""

_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'NULL' THEN [] ELSE [{0}] END"
_NESTED = f"""
WITH c AS (SELECT DISTINCT cache_id, cache_json AS j FROM recovery_caches WHERE json_valid(cache_json) AND json_type(cache_json) = 'OBJECT'),
e AS (SELECT cache_id, json_extract(j, '$.results[*]') AS e FROM c), r AS (SELECT cache_id, unnest(range(len(e)))::INT AS result_index, unnest(e) AS p FROM e),
k AS (SELECT cache_id, result_index, 'block' AS kind, p->'$.blocks' AS v FROM r UNION ALL SELECT cache_id, result_index, 'note', p->'$.notes' FROM r UNION ALL SELECT cache_id, result_index, 'illustration', p->'$.illustrations' FROM r),
l AS (SELECT cache_id, result_index, kind, {_LIST.format('v')} AS l FROM k WHERE v IS NOT NULL),
i AS (SELECT cache_id, result_index, kind, unnest(range(len(l)))::INT AS item_index, unnest(l) AS x FROM l),
n AS (SELECT cache_id, result_index, item_index, {_LIST.format("(x->'$.note_markers')")} AS l FROM i WHERE kind = 'block' AND json_type(x) = 'OBJECT' AND (x->'$.note_markers') IS NOT NULL),
m AS (SELECT cache_id, result_index, item_index, unnest(range(len(l)))::INT AS sub_index, unnest(l) AS y FROM n)"""


def _field(json: str, name: str, kind: str = "") -> str:
    """SQL of a plain field: text, or cast."""
    value = f"CASE WHEN json_type({json}->'$.{name}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string({json}, '$.{name}') END"
    return f"TRY_CAST({value} AS {kind}) AS {name}" if kind else f"{value} AS {name}"


ORACLES: dict[str, str] = {
    "p2_found": f"""{_NESTED} SELECT cache_id, result_index, kind, item_index, -1 AS sub_index FROM i WHERE json_type(x) <> 'NULL'
 UNION ALL SELECT cache_id, result_index, 'marker', item_index, sub_index FROM m WHERE json_type(y) <> 'NULL'""",
    "p2_keys": f"""{_NESTED} SELECT cache_id, result_index, item_index, {_field('x', 'type')}, {_field('x', 'text')} FROM i WHERE kind = 'block' AND json_type(x) <> 'NULL'""",
    "p2_note_texts": f"""{_NESTED} SELECT cache_id, result_index, item_index, CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.text') WHEN json_type(x) <> 'ARRAY' THEN json_extract_string(x, '$') END AS text FROM i WHERE kind = 'note' AND json_type(x) <> 'NULL'""",
    "p2_page_links": f"""{_NESTED} SELECT cache_id, result_index, {_field('p', 'page_role')}, {_field('p', 'title')}, (SELECT count(*) FROM i WHERE i.cache_id = r.cache_id AND i.result_index = r.result_index AND i.kind = 'block' AND json_type(x) <> 'NULL') AS blocks FROM r WHERE json_type(p) <> 'NULL'""",
    "p1_found": f"""{_LINES} SELECT line_id, reason FROM (SELECT line_id, CASE WHEN t IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting'
 WHEN n <> 7 THEN 'columns' WHEN {_BAD} THEN 'value' END AS reason FROM u) WHERE reason IS NOT NULL""",
    "p1_rejected": f"""{_LINES.replace("DISTINCT line_id,", "DISTINCT line_id, file_name, line_no, line AS raw,").replace("SELECT line_id, t,", "SELECT line_id, file_name, line_no, raw, t,")}
 SELECT line_id, file_name, line_no, reason, raw FROM (SELECT *, CASE WHEN t IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN n <> 7 THEN 'columns' WHEN {_BAD} THEN 'value' END AS reason FROM u) WHERE reason IS NOT NULL""",
    "p1_loaded": _LINES.replace("DISTINCT line_id,", "DISTINCT line_id, file_name, line_no,").replace("SELECT line_id, t,", "SELECT line_id, file_name, line_no, t,")
    + f""" SELECT DISTINCT line_id, file_name, line_no, a AS book_id, TRY_CAST(b AS BIGINT) AS page, c AS page_role, d = 'true' AS page_continues_previous,
 e AS title, TRY_CAST(f AS DOUBLE) AS seconds, g AS text FROM u WHERE t IS NOT NULL AND quoted AND n = 7 AND NOT {_BAD}""",
}
