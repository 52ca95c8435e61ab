"""Queries of the text operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pagemill.llm import boilerplate, canonical, leaks, packing, pagetext, pii, truncation
from pagemill.runtime import Query, table, written


def p3_found(spark, root):
    return pagetext.found_lines(table(spark, root, "page_results"), table(spark, root, "books"))


def p3_paragraphs(spark, root):
    return pagetext.paragraphs(table(spark, root, "page_results"), table(spark, root, "books"))


def p3_blocks(spark, root):
    return pagetext.repaired_blocks(table(spark, root, "page_results"), table(spark, root, "books"))


def p4_found(spark, root):
    return canonical.look_alike_pairs(table(spark, root, "page_notes"))


def p4_notes(spark, root):
    return canonical.normalised_notes(table(spark, root, "page_notes"))


def p4_classes(spark, root):
    return canonical.look_alike_classes(table(spark, root, "page_notes"))


def p5_found(spark, root):
    return boilerplate.blocks(table(spark, root, "page_results")).select("site", "line")


def p5_blocks(spark, root):
    return boilerplate.blocks(table(spark, root, "page_results"))


def p5_cleaned(spark, root):
    from pyspark.sql import functions as F

    pages = table(spark, root, "page_results")
    out = boilerplate.cleaned(pages, boilerplate.blocks(pages))
    return out.withColumn("block_texts", F.transform("blocks", lambda b: b["text"])).drop("blocks")


def p6_found(spark, root):
    return truncation.found(*(table(spark, root, t) for t in ("page_results", "page_notes", "books")))


def p6_sites(spark, root):
    pages, notes, books = (table(spark, root, t) for t in ("page_results", "page_notes", "books"))
    return truncation.site_shares(pages, notes, truncation.found(pages, notes, books))


def p6_limits(spark, root):
    return truncation.limits(truncation.records(*(table(spark, root, t) for t in ("page_results", "page_notes", "books"))))


def p7_packed(spark, root):
    counts = written(packing.token_counts(table(spark, root, "documents")), "token-counts")
    return packing.pack(counts, table(spark, root, "pack_capacities"))


def p7_fill(spark, root):
    return packing.fill_rates(p7_packed(spark, root))


def p8_found(spark, root):
    return leaks.found(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_passages(spark, root):
    return leaks.passages(table(spark, root, "documents"), table(spark, root, "eval_items")).distinct()


def p8_items(spark, root):
    return leaks.leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_found(spark, root):
    return pii.found(table(spark, root, "documents"))


def p9_redacted(spark, root):
    return pii.redacted(table(spark, root, "documents"))


QUERIES: dict[str, Query] = {
    "p3_found": p3_found,
    "p3_paragraphs": p3_paragraphs,
    "p3_blocks": p3_blocks,
    "p4_found": p4_found,
    "p4_notes": p4_notes,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_blocks": p5_blocks,
    "p5_cleaned": p5_cleaned,
    "p6_found": p6_found,
    "p6_sites": p6_sites,
    "p6_limits": p6_limits,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"



def _plain(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{_BLANK}', ' ', 'g'))"


_LINES = f"list_filter(list_transform(flatten(list_transform(list_filter(list_prepend(title, list_transform(coalesce(blocks, []), lambda b: b.text)), lambda t: t IS NOT NULL), lambda t: string_split(t, chr(10)))), lambda l: {_plain('l')}), lambda l: l <> '')"
_BOILER = f"""
WITH RECURSIVE g AS (SELECT DISTINCT site, book_id, page, {_LINES} AS ls FROM page_results WHERE site IS NOT NULL),
n AS (SELECT site, count(*) AS n FROM (SELECT DISTINCT site, book_id, page FROM page_results) GROUP BY site),
u AS (SELECT DISTINCT site, book_id, page, unnest(ls) AS line FROM g),
f AS (SELECT site, line, count(*) AS n_pages, count(DISTINCT book_id) AS n_books FROM u JOIN n USING (site) GROUP BY site, line, n HAVING count(*) >= 0.08 * n AND count(DISTINCT book_id) >= 3),
q AS (SELECT site, book_id, page, ls, unnest(range(1, len(ls))) AS i FROM g), e AS (SELECT DISTINCT site, book_id, page, ls[i] AS a, ls[i + 1] AS b FROM q WHERE ls[i] <> ls[i + 1]),
w AS (SELECT e.site, a, b, count(*) AS w, any_value(fa.n_pages) AS na, any_value(fb.n_pages) AS nb FROM e JOIN f fa ON fa.site = e.site AND fa.line = a JOIN f fb ON fb.site = e.site AND fb.line = b GROUP BY 1, 2, 3),
k AS (SELECT * FROM w WHERE w >= 0.5 * least(na, nb)),
r AS (SELECT site, line AS a, line AS b FROM f UNION SELECT r.site, r.a, CASE WHEN k.a = r.b THEN k.b ELSE k.a END FROM r JOIN k ON k.site = r.site AND r.b IN (k.a, k.b)),
c AS (SELECT site, a AS line, min(b) AS block FROM r GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    "p5_found": f"""
WITH t AS (SELECT site, book_id, page, unnest(list_prepend(title, list_transform(coalesce(blocks, []), lambda b: b.text))) AS t
           FROM page_results WHERE site IS NOT NULL),
s AS (SELECT site, book_id, page, unnest(string_split(t, chr(10))) AS l FROM t),
l AS (SELECT DISTINCT site, book_id, page, trim(regexp_replace(lower(l), '{_BLANK}', ' ', 'g')) AS line FROM s),
n AS (SELECT site, count(*) AS n FROM (SELECT DISTINCT site, book_id, page FROM page_results) GROUP BY site)
SELECT site, line FROM l JOIN n USING (site) WHERE line <> '' GROUP BY site, line, n
HAVING count(*) >= 0.08 * n AND count(DISTINCT book_id) >= 3""",
    "p5_blocks": f"""{_BOILER}, z AS (SELECT c.site, block, max(k.w) AS block_pages FROM c JOIN k ON k.site = c.site AND k.a = c.line GROUP BY 1, 2)
SELECT c.site, c.block, c.line, f.n_pages, f.n_books, count(*) OVER (PARTITION BY c.site, c.block) AS block_lines, coalesce(z.block_pages, f.n_pages) AS block_pages FROM c JOIN f USING (site, line) LEFT JOIN z ON z.site = c.site AND z.block = c.block""",
    "p5_cleaned": f"""{_BOILER}, s AS (SELECT site, map_from_entries(list({{'key': line, 'value': block}})) AS m FROM c GROUP BY site),
p AS (SELECT p.*, coalesce(s.m, MAP {{}}) AS m FROM (SELECT DISTINCT ON (result_id) * FROM page_results) p LEFT JOIN s USING (site)),
x AS (SELECT *, list_transform({_LINES}, lambda l: m[l]) AS o, list_transform(blocks, lambda b: CASE WHEN b.text IS NULL THEN b ELSE {{'type': b.type, 'level': b.level, 'text': array_to_string(list_filter(string_split(b.text, chr(10)), lambda l: m[{_plain('l')}] IS NULL), chr(10)), 'continued_from_previous': b.continued_from_previous, 'note_markers': b.note_markers}} END) AS nb FROM p)
SELECT result_id, site, book_id, page, nullif(array_to_string(list_filter(string_split(title, chr(10)), lambda l: m[{_plain('l')}] IS NULL), chr(10)), '') AS title,
 list_transform(list_filter(range(1, len(nb) + 1), lambda i: nb[i].text IS NULL OR nb[i].text <> '' OR blocks[i].text = ''), lambda i: nb[i].text) AS block_texts, len(list_filter(o, lambda b: b IS NOT NULL))::INT AS removed,
 len(list_filter(range(1, len(o) + 1), lambda i: o[i] IS NOT NULL AND (i = 1 OR o[i] IS DISTINCT FROM o[i - 1])))::INT AS runs FROM x""",
}
