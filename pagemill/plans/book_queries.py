"""Queries of contents, body assembly, joins, aggregations and ordered operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import body, covers, ordered, resume, toc
from pagemill.operators.pages import unique_pages
from pagemill.plans.text_queries import HEADING_SQL, PAGES_SQL, WS_SQL, cleanup_sql, escape_sql, paragraphs_sql, strip_sql
from pagemill.runtime import Query, table


def pages(spark, root):
    return unique_pages(table(spark, root, "page_results"))


def _cands(spark, root):
    return toc.candidates(pages(spark, root))


def _reply(cands):
    """A reviewer's reply by rule: relabelled on some pages, on others with keys outside what was asked."""
    return cands.select(
        *toc.KEYS, "chunk", F.when(F.pmod(F.col("page"), F.lit(3)) == 0, F.concat(F.lit("~ "), F.col("text"))).otherwise("").alias("label"),
        (F.pmod(F.col("block_index"), F.lit(6)) + F.col("page") % 2).cast("int").alias("level"), toc.entry_order().alias("ord"),
    ).withColumn("block_index", F.when(F.pmod(F.col("page"), F.lit(10)) == 0, F.col("block_index") + 1).otherwise(F.col("block_index")))


def toc_candidates(spark, root):
    return _cands(spark, root)


def toc_filtered(spark, root):
    return toc.filtered(_cands(spark, root)).select(*toc.KEYS, "text")


def toc_compact(spark, root):
    return toc.compact(toc.filtered(_cands(spark, root)))


def toc_chunks(spark, root):
    return toc.chunked(toc.filtered(_cands(spark, root)), 4).select(*toc.KEYS, "chunk")


def toc_rule_plan(spark, root):
    return toc.rule_plan(toc.filtered(_cands(spark, root)))


def toc_first_per_key(spark, root):
    """Items of two replies with equal keys: the first counts."""
    c = _cands(spark, root).select("book_id", "page", F.lit(0).alias("block_index"), F.col("text").alias("label"), toc.entry_order().alias("ord"))
    return toc.first_per_key(c)


def toc_asked_items(spark, root):
    chunks = toc.chunked(toc.filtered(_cands(spark, root)), 4)
    return toc.only_asked(_reply(chunks), chunks).select(*toc.KEYS, "chunk")


def _entries(spark, root):
    return _cands(spark, root).select(*toc.KEYS, "text", F.col("ocr_level").alias("level"), toc.entry_order().alias("o"))


def toc_overlay(spark, root):
    chunks = toc.chunked(toc.filtered(_cands(spark, root)), 4)
    return toc.overlay(_entries(spark, root), _reply(chunks))


def toc_planned(spark, root):
    items = toc.rule_plan(toc.filtered(_cands(spark, root)))
    return toc.planned_levels(_entries(spark, root).select(*toc.KEYS, "text"), items)


def toc_without_plan(spark, root):
    return toc.without_plan(_entries(spark, root), ("contents", "notes")).select(*toc.KEYS, "text")


def nav_parents(spark, root):
    return toc.nested(_entries(spark, root)).select(*toc.KEYS, "nav_level", "parent")


def nav_order(spark, root):
    return toc.navigation(_entries(spark, root)).select(*toc.KEYS, "play_order")


def body_kept_blocks(spark, root):
    k = body.kept_blocks(pages(spark, root))
    return k.select("result_id", F.explode("kept").alias("b")).select("result_id", "b.block_index", "b.type", "b.text")


def body_note_match(spark, root):
    return body.matched_notes(body.kept_blocks(pages(spark, root))).select("result_id", "note_index", "block_index")


def body_figures(spark, root):
    return body.placed_figures(body.kept_blocks(pages(spark, root))).select("result_id", "figure_index", "block_index")


def body_merge(spark, root):
    m = body.merged_paragraphs(body.elements(body.kept_blocks(pages(spark, root))))
    return m.select("book_id", "page", "block_index", "slot", "sub", "kind", "piece", "merges")


def body_counters(spark, root):
    c = body.counters(body.elements(body.kept_blocks(pages(spark, root))))
    return c.select("book_id", "page", "block_index", "slot", "sub", "heading_no", "block_no", "note_no", "figure_no")


def body_crop(spark, root):
    rows = pages(spark, root).select("result_id", F.posexplode("illustrations").alias("figure_index", "i"))
    return rows.select("result_id", "figure_index", body.crop(F.col("i.bbox"), 1600, 2400).alias("r")).select("result_id", "figure_index", "r.*")


def blank_pages(spark, root):
    return body.blank_pages(pages(spark, root)).select("result_id")


def page_status(spark, root):
    return resume.status(pages(spark, root)).select("result_id", "status")


def coverage_ratio(spark, root):
    p = pages(spark, root)
    whole = tx.coverage_length(F.col("text"))
    have = F.aggregate("blocks", F.lit(0), lambda n, b: n + tx.coverage_length(b["text"]))
    return p.select("result_id", whole.alias("text_len"), have.alias("block_len"), ((whole > 0) & (F.size("blocks") > 0) & (have < whole * 0.6)).alias("rebuild"))


def book_totals(spark, root):
    return pages(spark, root).groupBy("book_id").agg(
        F.count("*").alias("pages"), F.max("page").alias("last_page"), F.sum(F.length(tx.text_or_empty(F.col("text")))).alias("chars"), F.max(F.size("blocks")).alias("most_blocks"))


def marker_sets(spark, root):
    markers = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("blocks", lambda b: F.coalesce(b["note_markers"], F.array().cast("array<string>")))), lambda m: F.coalesce(F.trim(m) != "", F.lit(False)))))
    captions = F.array_sort(F.array_distinct(F.filter(F.transform("illustrations", lambda i: tx.text_key(i["caption"])), lambda c: c != "")))
    return pages(spark, root).select("result_id", markers.alias("markers"), captions.alias("captions"))


def cover_pages(spark, root):
    return covers.best(covers.verdicts_by_role(pages(spark, root)), 5)


def missing_pages(spark, root):
    return resume.missing_pages(table(spark, root, "books"), pages(spark, root))


def missing_report(spark, root):
    return resume.missing_report(resume.missing_pages(table(spark, root, "books"), pages(spark, root)))


def merged_results(spark, root):
    """Cached and new results of each page; new ones win."""
    p = table(spark, root, "page_results").select("book_id", "page", "result_id", "received_at")
    return resume.newest(p.select("book_id", "page", F.lit(0).alias("is_new"), "result_id"), p.where("page % 3 = 0").select("book_id", "page", F.lit(1).alias("is_new"), (F.col("result_id") + 1000000).alias("result_id")))


def repointed_images(spark, root):
    p = pages(spark, root).select("book_id", "page", "image_path")
    images = p.where("page % 2 = 0").select("book_id", "page", F.concat(F.lit("/new/"), F.col("book_id"), F.lit("/"), F.col("page").cast("string")).alias("path"))
    return resume.repoint(p, images)


def cache_match(spark, root):
    return resume.find_cache(table(spark, root, "recovery_caches"), table(spark, root, "books"))


def hinted_rebuild(spark, root):
    from pagemill.operators import normalize

    return normalize.with_rebuilt(pages(spark, root)).select("result_id", F.posexplode("rebuilt").alias("ord", "b")).select("result_id", "ord", "b.type", "b.level", "b.text", "b.continued_from_previous")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    toc_candidates, toc_filtered, toc_compact, toc_chunks, toc_rule_plan, toc_first_per_key, toc_asked_items, toc_overlay, toc_planned, toc_without_plan,
    nav_parents, nav_order, body_kept_blocks, body_note_match, body_figures, body_merge, body_counters, body_crop, blank_pages, page_status, coverage_ratio,
    book_totals, marker_sets, cover_pages, missing_pages, missing_report, merged_results, repointed_images, cache_match, hinted_rebuild,
)}



class _Key:
    """SQL of a text without white space."""

    @staticmethod
    def format(text: str) -> str:
        return f"regexp_replace({text}, '{WS_SQL}+', '', 'g')"


_KEY = _Key()
_CLEAN = cleanup_sql("text")
_C = f"""p AS {PAGES_SQL}, x AS (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM p),
c AS (SELECT book_id, coalesce(page, 0) AS page, (i - 1)::INT AS block_index, blocks[i].text AS text, coalesce(nullif(blocks[i].level, 0), 2) AS ocr_level, page_role,
 title AS page_title, coalesce(page_continues_previous, false) AS page_continues_previous FROM x WHERE blocks[i].type = 'heading' AND {strip_sql("coalesce(blocks[i].text, '')")} <> '')"""
_F = f"""{_C}, k AS (SELECT *, {_CLEAN} AS cleaned FROM c), k2 AS (SELECT *, {_KEY.format('cleaned')} AS key FROM k),
k3 AS (SELECT *, count(*) OVER (PARTITION BY book_id, key) AS n FROM k2),
k4 AS (SELECT *, key <> '' AND coalesce(page_role, '') NOT IN ('cover','blank','copyright','back_cover') AND n <= 3 AND len(cleaned) <= 80 AND NOT regexp_full_match(key, '\\p{{Nd}}+') AS keep FROM k3),
f AS (SELECT * FROM k4 QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY book_id))"""
_CH = f"{_F}, ch AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY page, block_index) - 1) // 4 AS chunk FROM f)"
_RE = f"""{_CH}, re AS (SELECT book_id, page, CASE WHEN page % 10 = 0 THEN block_index + 1 ELSE block_index END AS block_index, chunk, CASE WHEN page % 3 = 0 THEN '~ ' || text ELSE '' END AS label,
 (block_index % 6 + page % 2)::INT AS level, page * 100000::BIGINT + block_index AS ord FROM ch)"""
_OWN = f"""CASE WHEN len(coalesce(blocks, [])) > 0 THEN blocks ELSE list_transform({paragraphs_sql('text')}, lambda pp: {{'type': CASE WHEN {HEADING_SQL.format('pp')} THEN 'heading' ELSE 'paragraph' END,
 'level': CASE WHEN {HEADING_SQL.format('pp')} THEN 2 ELSE 0 END, 'text': pp, 'continued_from_previous': false, 'note_markers': []::VARCHAR[]}}) END"""
_K = f"""p AS {PAGES_SQL}, q0 AS (SELECT * REPLACE ({_OWN} AS blocks) FROM p), q AS (SELECT *, coalesce(page_continues_previous, false) AS pcp, {_KEY.format("coalesce(title, '')")} AS tkey,
 list_transform(coalesce(illustrations, []), lambda i: {_KEY.format("coalesce(i.caption, '')")}) AS caps FROM q0 WHERE len(blocks) > 0),
b1 AS (SELECT *, unnest(blocks) AS b, unnest(range(len(blocks))) AS bi FROM q), b2 AS (SELECT *, {strip_sql("coalesce(b.text, '')")} AS t FROM b1), b3 AS (SELECT *, {_KEY.format('t')} AS bkey FROM b2),
kept AS (SELECT * FROM b3 WHERE t <> '' AND NOT coalesce(b.type = 'heading' AND ((bkey <> '' AND list_contains(caps, bkey)) OR (bi = 0 AND pcp AND ((tkey <> '' AND bkey = tkey) OR regexp_full_match(bkey, '第[一二三四五六七八九十百千万零〇\\p{{Nd}}]+章')))), false))"""
_M = "trim(coalesce({0}, ''))"
_N = f"""{_K}, marks AS (SELECT result_id, list(DISTINCT trim(m)) AS all_m FROM (SELECT result_id, unnest(b.note_markers) AS m FROM b1) WHERE trim(m) <> '' GROUP BY 1),
n AS (SELECT result_id, book_id, page, unnest(notes) AS n, unnest(range(len(notes))) AS ni FROM p),
nm AS (SELECT n.result_id, n.book_id, n.page, ni, min(bi) AS block_index FROM n LEFT JOIN marks USING (result_id) LEFT JOIN kept ON kept.result_id = n.result_id AND
 CASE WHEN {_M.format('n.n.marker')} <> '' AND coalesce(list_contains(all_m, {_M.format('n.n.marker')}), false) THEN coalesce(list_contains(list_transform(kept.b.note_markers, lambda m: trim(m)), {_M.format('n.n.marker')}), false)
 ELSE {_M.format('n.n.anchor')} <> '' AND contains(kept.t, {_M.format('n.n.anchor')}) END GROUP BY 1, 2, 3, 4),
g AS (SELECT result_id, book_id, page, unnest(illustrations) AS g, unnest(range(len(illustrations))) AS gi FROM p),
gm AS (SELECT g.result_id, g.book_id, g.page, gi, min(bi) AS block_index FROM g LEFT JOIN kept ON kept.result_id = g.result_id AND (coalesce(g.g.insert_after, '') = '' OR contains(kept.t, g.g.insert_after)) GROUP BY 1, 2, 3, 4)"""
_E = f"""{_N}, el AS (SELECT book_id, page, bi AS block_index, 0 AS slot, 0 AS sub, CASE WHEN b.type = 'heading' THEN 'h' ELSE 'p' END AS kind, bi = 0 AND b.type = 'paragraph' AND (pcp OR coalesce(b.continued_from_previous, false)) AS wants FROM kept
 UNION ALL SELECT book_id, page, coalesce(block_index, 1000000), 1, ni, 'note', false FROM nm UNION ALL SELECT book_id, page, coalesce(block_index, 1000000), 2, gi, 'figure', false FROM gm)"""
_W = "(PARTITION BY book_id ORDER BY page, block_index, slot, sub)"

ORACLES: dict[str, str] = {
    "toc_candidates": f"WITH {_C} SELECT * FROM c",
    "toc_filtered": f"WITH {_F} SELECT book_id, page, block_index, text FROM f",
    "toc_compact": f"WITH {_F} SELECT book_id, page, block_index, cleaned AS text, ocr_level, page_role FROM f",
    "toc_chunks": f"WITH {_CH} SELECT book_id, page, block_index, chunk FROM ch",
    "toc_rule_plan": f"WITH {_F} SELECT book_id, page, block_index, cleaned AS label, greatest(1, least(4, ocr_level)) AS level, 'rule' AS reason, page * 100000::BIGINT + block_index AS ord FROM f WHERE cleaned <> ''",
    "toc_first_per_key": f"WITH {_C} SELECT book_id, page, 0 AS block_index, arg_min(text, block_index) AS label, min(page * 100000::BIGINT + block_index) AS ord FROM c GROUP BY 1, 2",
    "toc_asked_items": f"WITH {_RE} SELECT book_id, page, block_index, chunk FROM re SEMI JOIN ch USING (book_id, page, block_index, chunk)",
    "toc_overlay": f"""WITH {_RE} SELECT book_id, page, block_index, coalesce(nullif(re.label, ''), c.text) AS text, greatest(1, least(4, coalesce(nullif(re.level, 0), nullif(c.ocr_level, 0), 1))) AS level, ord
 FROM re JOIN c USING (book_id, page, block_index)""",
    "toc_planned": f"WITH {_F} SELECT c.book_id, c.page, c.block_index, c.text, CASE WHEN f.ocr_level IS NOT NULL THEN greatest(1, least(4, f.ocr_level)) END AS planned_level FROM c LEFT JOIN (SELECT * FROM f WHERE cleaned <> '') f USING (book_id, page, block_index)",
    "toc_without_plan": f"WITH {_C} SELECT book_id, page, block_index, text FROM c WHERE page > 1 AND lower(text) NOT IN ('contents', 'notes')",
    "nav_parents": f"""WITH {_C}, e AS (SELECT *, greatest(1, least(6, ocr_level)) AS nav_level, page * 100000::BIGINT + block_index AS ord FROM c)
 SELECT book_id, page, block_index, nav_level, (SELECT max(o.ord) FROM e o WHERE o.book_id = e.book_id AND o.ord < e.ord AND o.nav_level < e.nav_level) AS parent FROM e""",
    "nav_order": f"WITH {_C} SELECT book_id, page, block_index, row_number() OVER (PARTITION BY book_id ORDER BY page, block_index) AS play_order FROM c WHERE ocr_level <= 4",
    "body_crop": f"""WITH g AS (SELECT result_id, unnest(illustrations) AS g, (unnest(range(len(illustrations))))::INT AS figure_index FROM {PAGES_SQL}),
 h AS (SELECT result_id, figure_index, g.bbox AS b, len(g.bbox) = 4 AND NOT list_bool_or(list_transform(g.bbox, lambda v: v IS NULL)) AS ok FROM g),
 l AS (SELECT *, greatest(0, least(1599, trunc(b[1] * 1600)::INT)) AS l, greatest(0, least(2399, trunc(b[2] * 2400)::INT)) AS t FROM h)
 SELECT result_id, figure_index, CASE WHEN ok THEN l END AS "left", CASE WHEN ok THEN t END AS top, CASE WHEN ok THEN greatest(l + 1, least(1600, trunc(b[3] * 1600)::INT)) END AS "right",
 CASE WHEN ok THEN greatest(t + 1, least(2400, trunc(b[4] * 2400)::INT)) END AS bottom, CASE WHEN ok THEN b[1] < b[3] AND b[2] < b[4] END AS ordered FROM l""",
    "blank_pages": f"SELECT result_id FROM {PAGES_SQL} WHERE page_role = 'blank' AND coalesce(text, '') = '' AND len(coalesce(illustrations, [])) = 0",
    "page_status": f"""SELECT result_id, CASE WHEN {strip_sql("coalesce(text, '')")} <> '' OR len(coalesce(illustrations, [])) > 0 OR coalesce(page_role, 'unknown') IN ('blank','cover','copyright') THEN 'ok' ELSE 'unusable' END AS status FROM {PAGES_SQL}""",
    "coverage_ratio": f"""WITH t AS (SELECT result_id, blocks, len(regexp_replace({_CLEAN}, '{WS_SQL}+', '', 'g'))::INT AS text_len,
 coalesce(list_sum(list_transform(blocks, lambda b: len(regexp_replace({cleanup_sql('b.text')}, '{WS_SQL}+', '', 'g')))), 0)::INT AS block_len FROM {PAGES_SQL})
 SELECT result_id, text_len, block_len, text_len > 0 AND len(coalesce(blocks, [])) > 0 AND block_len < text_len * 0.6 AS rebuild FROM t""",
    "book_totals": f"SELECT book_id, count(*) AS pages, max(page) AS last_page, sum(len(coalesce(text, '')))::BIGINT AS chars, max(len(coalesce(blocks, [])))::INT AS most_blocks FROM {PAGES_SQL} GROUP BY book_id",
    "marker_sets": f"""SELECT result_id, list_sort(list_distinct(list_filter(flatten(list_transform(coalesce(blocks, []), lambda b: coalesce(b.note_markers, []))), lambda m: trim(m) <> ''))) AS markers,
 list_sort(list_distinct(list_filter(list_transform(coalesce(illustrations, []), lambda i: {_KEY.format("coalesce(i.caption, '')")}), lambda c: c <> ''))) AS captions FROM {PAGES_SQL}""",
    "cover_pages": f"""WITH v AS (SELECT book_id, page, coalesce(page_role, '') IN ('cover', 'front_matter') AS is_cover, CASE WHEN page_role = 'cover' AND seconds IS NULL THEN 'NaN'::DOUBLE WHEN page_role = 'cover' THEN 1.0 ELSE 0.5 END AS score FROM {PAGES_SQL} WHERE page <= 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, page) AS n FROM v WHERE is_cover AND NOT isnan(score) AND score > -1)
 SELECT b.book_id, coalesce(r.page, 1) AS cover_page FROM (SELECT DISTINCT book_id FROM page_results) b LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (book_id)""",
    "missing_pages": f"""SELECT book_id, page FROM (SELECT DISTINCT book_id, unnest(range(1, page_count + 1))::INT AS page FROM books WHERE page_count > 0) ANTI JOIN {PAGES_SQL} r USING (book_id, page)""",
    "missing_report": f"""WITH m AS (SELECT book_id, page FROM (SELECT DISTINCT book_id, unnest(range(1, page_count + 1))::INT AS page FROM books WHERE page_count > 0) ANTI JOIN {PAGES_SQL} r USING (book_id, page))
 SELECT book_id, count(*) AS n_missing, list_sort(list(page))[:20] AS first_missing FROM m GROUP BY book_id""",
    "merged_results": "SELECT book_id, page, max(CASE WHEN page % 3 = 0 THEN result_id + 1000000 ELSE result_id END) AS result_id, CASE WHEN page % 3 = 0 THEN 1 ELSE 0 END AS is_new FROM page_results GROUP BY 1, 2",
    "repointed_images": f"SELECT book_id, page, CASE WHEN page % 2 = 0 THEN '/new/' || book_id || '/' || page ELSE image_path END AS image_path FROM {PAGES_SQL}",
    "cache_match": """WITH k AS (SELECT DISTINCT cache_id, json_extract_string(cache_json, '$.pdf_fingerprint') AS fp, json_extract_string(cache_json, '$.source_pdf') AS src FROM (SELECT * FROM recovery_caches WHERE json_valid(cache_json))),
 b AS (SELECT DISTINCT book_id, pdf_fingerprint, source_pdf FROM books),
 m AS (SELECT book_id, cache_id, 0 AS class FROM b JOIN k ON b.pdf_fingerprint = k.fp UNION ALL SELECT book_id, cache_id, 1 FROM b JOIN k ON b.source_pdf = k.src)
 SELECT book_id, arg_min(cache_id, class * 1000000000 + cache_id) AS cache_id, min(class) AS class FROM m GROUP BY book_id""",
    "body_kept_blocks": f"WITH {_K} SELECT result_id, bi::INT AS block_index, b.type AS type, t AS text FROM kept",
    "body_note_match": f"WITH {_N} SELECT result_id, ni::INT AS note_index, block_index::INT AS block_index FROM nm",
    "body_figures": f"WITH {_N} SELECT result_id, gi::INT AS figure_index, block_index::INT AS block_index FROM gm",
    "body_merge": f"""WITH {_E}, w AS (SELECT *, coalesce(wants AND lag(kind) OVER {_W} = 'p', false) AS merges FROM el)
 SELECT book_id, page, block_index::INT AS block_index, slot, sub::INT AS sub, kind, sum(CASE WHEN merges THEN 0 ELSE 1 END) OVER {_W} AS piece, merges FROM w""",
    "body_counters": f"""WITH {_E} SELECT book_id, page, block_index::INT AS block_index, slot, sub::INT AS sub, count(*) FILTER (kind = 'h') OVER {_W} AS heading_no, count(*) FILTER (slot = 0) OVER {_W} AS block_no,
 count(*) FILTER (kind = 'note') OVER {_W} AS note_no, count(*) FILTER (kind = 'figure') OVER {_W} AS figure_no FROM el""",
    "note_refs": f"""WITH {_E}, w AS (SELECT *, count(*) FILTER (kind = 'note') OVER {_W} AS note_no FROM el)
 SELECT w.book_id, w.note_no::INT AS note_no, {escape_sql(f"coalesce(nullif({strip_sql("coalesce(n.n.marker, '')")}, ''), w.note_no::VARCHAR)")} AS label, {escape_sql(strip_sql("coalesce(n.n.text, '')"))} AS text
 FROM w JOIN n ON w.book_id = n.book_id AND w.page = n.page AND w.sub = n.ni WHERE w.kind = 'note'""",
    "toc_driver": f"""WITH {_CH}, n AS (SELECT *, chunk % 6 AS v, count(*) OVER (PARTITION BY book_id, chunk) AS cn, row_number() OVER (PARTITION BY book_id, chunk ORDER BY page, block_index) AS ci FROM ch),
 r AS (SELECT *, v IN (0, 1, 5) OR (v = 2 AND cn > 1) AS reviewed FROM n), l AS (SELECT *, CASE WHEN reviewed THEN {cleanup_sql("('R ' || text)")} ELSE cleaned END AS label FROM r)
 SELECT book_id, page, block_index, label, greatest(1, least(4, ocr_level)) AS level, CASE WHEN reviewed THEN 'seen' ELSE 'rule' END AS reason FROM l WHERE label <> '' AND NOT (v = 2 AND reviewed AND ci = cn)""",
    "toc_chunk_ends": f"""WITH {_CH}, n AS (SELECT book_id, chunk, chunk % 6 AS v, count(*) AS n FROM ch GROUP BY 1, 2)
 SELECT book_id, chunk, CASE v WHEN 0 THEN 1 WHEN 5 THEN 1 WHEN 4 THEN 3 ELSE 2 END AS attempts, CASE WHEN v IN (0, 1, 5) THEN 'parsed' WHEN v = 2 AND n > 1 THEN 'salvaged' ELSE 'fallback' END AS tier FROM n""",
    "nav_items": f"""WITH RECURSIVE {_C}, e AS (SELECT *, greatest(1, least(6, ocr_level)) AS nav_level, page * 100000::BIGINT + block_index AS ord FROM c),
 np AS (SELECT book_id, ord, (SELECT max(o.ord) FROM e o WHERE o.book_id = e.book_id AND o.ord < e.ord AND o.nav_level < e.nav_level) AS parent FROM e),
 d AS (SELECT book_id, ord, 0 AS depth FROM np WHERE parent IS NULL UNION ALL SELECT np.book_id, np.ord, d.depth + 1 FROM d JOIN np ON np.book_id = d.book_id AND np.parent = d.ord) SELECT book_id, ord, depth FROM d""",
}
