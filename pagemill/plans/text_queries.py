"""Queries of the text functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators.pages import unique_pages
from pagemill.runtime import Query, table

#: Ideographs and full-width signs set into the pages' texts, the same way on both sides, so that the rules have work.
MIXED = (("the ", "第 一 "), (" of ", " 章 7 "), (", ", " ， "), ("and ", "（ x 回 "), (";", " ；"))
WS_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK_SQL = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
PAGES_SQL = "(SELECT DISTINCT ON (result_id) * FROM page_results)"


def mixed(text):
    for a, b in MIXED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def mixed_sql(text: str) -> str:
    for a, b in MIXED:
        text = f"replace({text}, '{a}', '{b}')"
    return text


def strip_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS_SQL}+', ''), '{WS_SQL}+$', '')"


def cleanup_sql(text: str) -> str:
    """The pairwise rules, each twice, as SQL has no look-around."""
    out = strip_sql(f"coalesce({text}, '')")
    for left, right in ((f"[{CJK_SQL}]", f"[{CJK_SQL}]"), (f"[{CJK_SQL}]", "[0-9A-Za-z]"), ("[0-9A-Za-z]", f"[{CJK_SQL}]")) * 2:
        for _ in range(2):
            out = f"regexp_replace({out}, '({left})[ \\t]+({right})', '\\1\\2', 'g')"
    out = f"regexp_replace({out}, '[ \\t]+([，。！？；：、）】》])', '\\1', 'g')"
    return f"regexp_replace({out}, '([（【《])[ \\t]+', '\\1', 'g')"


def escape_sql(text: str) -> str:
    out = f"coalesce({text}, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


HEADING_SQL = "(len({0}) <= 32 AND regexp_matches({0}, '^(第[一二三四五六七八九十百千万零〇\\p{{Nd}}]+[章节回卷部篇]|[一二三四五六七八九十百千万零〇\\p{{Nd}}]+[、.．])'))"


def paragraphs_sql(text: str) -> str:
    parts = f"string_split_regex({strip_sql(f'coalesce({text}, chr(32))')}, '\\n{WS_SQL}*\\n+')"
    joined = f"list_transform({parts}, lambda p: regexp_replace({strip_sql('p')}, '[ \\t]*\\n[ \\t]*', '', 'g'))"
    return f"list_filter({joined}, lambda p: p <> '')"


def pages(spark, root):
    return unique_pages(table(spark, root, "page_results"))


def c1_cleanup(spark, root):
    return pages(spark, root).select("result_id", tx.cleanup(mixed(F.col("text"))).alias("cleaned"))


def c2_keys(spark, root):
    t = mixed(F.col("text"))
    return pages(spark, root).select("result_id", tx.heading_key(F.col("title")).alias("title_key"), tx.text_key(F.col("title")).alias("text_key"), tx.coverage_length(t).alias("coverage"))


def c3_flags(spark, root):
    """Flags given as text in many spellings, one of them a page."""
    n = F.pmod("result_id", F.lit(9)).cast("int")
    spelt = F.element_at(F.array(*map(F.lit, (" yes ", "TRUE", "on", "Y", "1", "no", "false", "0", "true."))), n + 1)
    return pages(spark, root).select("result_id", spelt.alias("flag"), tx.truthy(spelt).alias("is_true"))


def c4_paragraphs(spark, root):
    return pages(spark, root).select("result_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("ord", "paragraph"))


def c5_fallback_blocks(spark, root):
    text = F.replace(mixed(F.col("text")), F.lit("\n\n"), F.lit("\n\n第二章 "))
    return pages(spark, root).select("result_id", F.posexplode(tx.fallback_blocks(text)).alias("ord", "b")).select("result_id", "ord", "b.type", "b.level", "b.text")


def c6_compact_reply(spark, root):
    text = F.concat(F.col("text"), F.repeat(F.lit(" "), 12), F.repeat(F.lit("/n"), 20), F.lit("|"), F.col("text"))
    return pages(spark, root).where("text IS NOT NULL").select("result_id", tx.compact_reply(text, 400).alias("reply"))


def c7_repeated_unit(spark, root):
    """The last word of each message, repeated or not by its number, tested for being a repeated unit."""
    word = F.regexp_extract("text", r"(\w+)\W*$", 1)
    n = F.pmod("doc_id", F.lit(4)).cast("int")
    t = F.concat(F.repeat(word, n + 1), F.when(n == 3, "x").otherwise(""))
    return table(spark, root, "documents").select("doc_id", t.alias("tail"), tx.is_repeated_unit(t).alias("repeated")).distinct()


def c8_escape(spark, root):
    return table(spark, root, "documents").select("doc_id", tx.escape(F.col("text")).alias("html")).distinct()


def c9_block_html(spark, root):
    rows = pages(spark, root).select("result_id", F.posexplode("blocks").alias("block_index", "b"))
    return rows.select("result_id", "block_index", tx.block_html(F.col("b"), tx.slug("block", F.col("block_index") + 1)).alias("html"))


def c10_slugs(spark, root):
    return table(spark, root, "part").select("p_partkey", tx.slug("heading", F.col("p_partkey")).alias("slug"))


def c11_natural_order(spark, root):
    """Image paths of each book in natural order, renumbered from 1."""
    from pagemill.sources import renderer

    rows = pages(spark, root).where("image_path IS NOT NULL").select("book_id", "image_path").distinct()
    return renderer.numbered_images(rows, "image_path").select("book_id", "image_path", "page", "file")


def c12_marker_variants(spark, root):
    return table(spark, root, "page_notes").select("note_id", tx.marker_variants(F.col("marker")).alias("forms")).distinct()


def c13_parsed_notes(spark, root):
    """Notes as plain text with their marker in front, parsed again."""
    n = F.pmod("note_id", F.lit(4)).cast("int")
    mark = F.when(n == 0, F.translate(F.col("note_id").cast("string"), "0123456789", tx.SUPERSCRIPTS)).when(n == 1, F.col("note_id").cast("string")).when(n == 2, F.lit("③")).otherwise("")
    parsed = tx.parsed_note(F.concat(mark, F.lit(" "), F.coalesce("text", F.lit(""))))
    return table(spark, root, "page_notes").select("note_id", parsed.alias("p")).select("note_id", "p.marker", "p.text").distinct()


def c16_markdown(spark, root):
    return pages(spark, root).select("result_id", tx.markdown(F.col("blocks")).alias("markdown"))


def b7_file_names(spark, root):
    odd = F.concat(F.lit(" "), F.col("title"), F.lit(': a/b?  "c" . '))
    return table(spark, root, "books").select("book_id", tx.file_name(F.col("title")).alias("plain"), tx.file_name(odd).alias("odd"), tx.file_name(F.lit(" .. ")).alias("none")).distinct()


def p8_headings_by_look(spark, root):
    line = F.explode(F.split(mixed(F.col("text")), "\n"))
    rows = pages(spark, root).select("result_id", line.alias("line"))
    return rows.select("result_id", tx.looks_like_heading(F.col("line")).alias("h")).groupBy("result_id").agg(F.count_if("h").alias("headings"), F.count("*").alias("lines"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (c1_cleanup, c2_keys, c3_flags, c4_paragraphs, c5_fallback_blocks, c6_compact_reply, c7_repeated_unit, c8_escape, c9_block_html, c10_slugs, c11_natural_order, c12_marker_variants, c13_parsed_notes, c16_markdown, b7_file_names)
} | {"look_headings": p8_headings_by_look}

_MIX = mixed_sql("text")
_CLASS = "CASE WHEN t = '' THEN '' ELSE ' class=\"' || t || '\"' END"
_LEVEL = "greatest(1, least(6, coalesce(nullif(b.level, 0), 2)))"

ORACLES: dict[str, str] = {
    "c1_cleanup": f"SELECT result_id, {cleanup_sql(_MIX)} AS cleaned FROM {PAGES_SQL}",
    "c2_keys": f"""SELECT result_id, regexp_replace({cleanup_sql('title')}, '{WS_SQL}+', '', 'g') AS title_key,
 regexp_replace(coalesce(title, ''), '{WS_SQL}+', '', 'g') AS text_key, len(regexp_replace({cleanup_sql(_MIX)}, '{WS_SQL}+', '', 'g'))::INT AS coverage FROM {PAGES_SQL}""",
    "c3_flags": f"""SELECT result_id, flag, lower(trim(flag)) IN ('1','true','yes','y','on') AS is_true FROM
 (SELECT result_id, [' yes ','TRUE','on','Y','1','no','false','0','true.'][(result_id % 9)::INT + 1] AS flag FROM {PAGES_SQL})""",
    "c4_paragraphs": f"SELECT result_id, (i - 1)::INT AS ord, p[i] AS paragraph FROM (SELECT result_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT result_id, {paragraphs_sql('text')} AS p FROM {PAGES_SQL}))",
    "c5_fallback_blocks": f"""SELECT result_id, (i - 1)::INT AS ord, CASE WHEN {HEADING_SQL.format('p[i]')} THEN 'heading' ELSE 'paragraph' END AS type,
 CASE WHEN {HEADING_SQL.format('p[i]')} THEN 2 ELSE 0 END AS level, p[i] AS text FROM (SELECT result_id, p, unnest(range(1, len(p) + 1)) AS i
 FROM (SELECT result_id, {paragraphs_sql(f"replace({_MIX}, chr(10) || chr(10), chr(10) || chr(10) || '第二章 ')")} AS p FROM {PAGES_SQL}))""",
    "c6_compact_reply": f"""WITH t AS (SELECT result_id, regexp_replace(text || ' [blank run left out] [repeated line breaks left out]|' || text, ' {{9,}}', ' [blank run left out] ', 'g') AS r FROM {PAGES_SQL} WHERE text IS NOT NULL)
 SELECT result_id, CASE WHEN len(r) <= 400 THEN r ELSE r[:200] || chr(10) || '...[middle left out]...' || chr(10) || r[-200:] END AS reply FROM t""",
    "c7_repeated_unit": """WITH w AS (SELECT DISTINCT doc_id, repeat(regexp_extract(text, '([0-9A-Za-z_]+)[^0-9A-Za-z_]*$', 1), (doc_id % 4)::INT + 1) || CASE WHEN doc_id % 4 = 3 THEN 'x' ELSE '' END AS tail FROM documents)
 SELECT doc_id, tail, tail IS NOT NULL AND tail <> '' AND list_bool_or(list_transform(range(1, 9), lambda k: len(tail) % k = 0 AND tail = repeat(tail[1:k], (len(tail) // k)::INT))) AS repeated FROM w""",
    "c8_escape": f"SELECT DISTINCT doc_id, {escape_sql('text')} AS html FROM documents",
    "c9_block_html": f"""WITH x AS (SELECT result_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM {PAGES_SQL}),
 y AS (SELECT result_id, (i - 1)::INT AS block_index, blocks[i] AS b, 'block-' || lpad(i::VARCHAR, greatest(4, len(i::VARCHAR))::INT, '0') AS id FROM x),
 z AS (SELECT *, {strip_sql("coalesce(b.text, '')")} AS s, greatest(2, least(4, coalesce(nullif(b.level, 0), 2) + 1)) AS l FROM y),
 q AS (SELECT *, concat_ws(' ', CASE WHEN b.type = 'quote' THEN 'quote' END, CASE WHEN s LIKE '“%' THEN 'dialogue' END) AS t FROM z)
 SELECT result_id, block_index, CASE WHEN s = '' THEN '' WHEN b.type = 'heading' THEN '<h' || l || ' id="' || id || '" class="section-heading">' || {escape_sql('s')} || '</h' || l || '>'
 ELSE '<p id="' || id || '"' || {_CLASS} || '>' || {escape_sql('s')} || '</p>' END AS html FROM q""",
    "c10_slugs": "SELECT p_partkey, 'heading-' || lpad(p_partkey::VARCHAR, greatest(4, len(p_partkey::VARCHAR))::INT, '0') AS slug FROM part",
    "c11_natural_order": f"""WITH k AS (SELECT DISTINCT book_id, image_path, array_to_string(list_transform(regexp_extract_all(regexp_extract(image_path, '[^/]*$'), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p::BIGINT::VARCHAR, 12, '0') ELSE lower(p) END), '') AS key
 FROM {PAGES_SQL} WHERE image_path IS NOT NULL), n AS (SELECT book_id, image_path, (row_number() OVER (PARTITION BY book_id ORDER BY key, image_path))::INT AS page FROM k)
 SELECT book_id, image_path, page, 'page_' || CASE WHEN page < 10000 THEN lpad(page::VARCHAR, 4, '0') ELSE page::VARCHAR END || '.jpg' AS file FROM n""",
    "c13_parsed_notes": f"""WITH m AS (SELECT DISTINCT note_id, CASE note_id % 4 WHEN 0 THEN translate(note_id::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') WHEN 1 THEN note_id::VARCHAR WHEN 2 THEN '③' ELSE '' END || ' ' || coalesce(text, '') AS t FROM page_notes),
 t AS (SELECT note_id, {strip_sql('t')} AS t FROM m), r AS (SELECT *, regexp_extract(t, '^(\\p{{Nd}}+|[⁰¹²³⁴⁵⁶⁷⁸⁹]+|[①②③④⑤⑥⑦⑧⑨⑩])', 1) AS raw FROM t), x AS (SELECT *, regexp_replace(substr(t, len(raw) + 1), '^{WS_SQL}+', '') AS rest FROM r), h AS (SELECT *, raw <> '' AND NOT contains(rest, chr(10)) AS has FROM x)
 SELECT note_id, CASE WHEN NOT has THEN '' WHEN regexp_matches(raw, '^[⁰¹²³⁴⁵⁶⁷⁸⁹]') THEN translate(raw, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') WHEN regexp_matches(raw, '^[①②③④⑤⑥⑦⑧⑨⑩]') THEN strpos('①②③④⑤⑥⑦⑧⑨⑩', raw)::VARCHAR ELSE raw END AS marker,
 {strip_sql("CASE WHEN has THEN rest ELSE t END")} AS text FROM h""",
    "c12_marker_variants": f"""WITH m AS (SELECT DISTINCT note_id, {strip_sql("coalesce(marker, '')")} AS m FROM page_notes)
 SELECT note_id, CASE WHEN m = '' THEN []::VARCHAR[] ELSE list_filter([CASE WHEN regexp_full_match(m, '[0-9]+') THEN translate(m, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') END,
 CASE WHEN regexp_full_match(m, '[1-9]|10') THEN substr('①②③④⑤⑥⑦⑧⑨⑩', m::INT, 1) END, '[' || m || ']', '〔' || m || '〕', '［' || m || '］', m], lambda f: f IS NOT NULL) END AS forms FROM m""",
    "c16_markdown": f"""SELECT result_id, coalesce(array_to_string(list_transform(list_filter(blocks, lambda b: b.text <> ''),
 lambda b: CASE WHEN b.type = 'heading' THEN repeat('#', {_LEVEL}) || ' ' || b.text WHEN b.type = 'quote' THEN '> ' || b.text ELSE b.text END), chr(10) || chr(10)), '') AS markdown FROM {PAGES_SQL}""",
    "b7_file_names": f"""SELECT DISTINCT book_id, coalesce(nullif(trim(regexp_replace(regexp_replace(trim(coalesce(title, '')), '[\\\\/:*?"<>|]+', '_', 'g'), '{WS_SQL}+', ' ', 'g'), ' .'), ''), 'book') AS plain,
 coalesce(nullif(trim(regexp_replace(regexp_replace(trim(coalesce(' ' || title || ': a/b?  "c" . ', '')), '[\\\\/:*?"<>|]+', '_', 'g'), '{WS_SQL}+', ' ', 'g'), ' .'), ''), 'book') AS odd, 'book' AS "none" FROM books""",
    "look_headings": f"""SELECT result_id, count(*) FILTER (WHERE {HEADING_SQL.format('l')}) AS headings, count(*) AS lines FROM
 (SELECT result_id, {strip_sql('l')} AS l FROM (SELECT result_id, unnest(string_split({_MIX}, chr(10))) AS l FROM {PAGES_SQL} WHERE text IS NOT NULL)) GROUP BY result_id""",
}
