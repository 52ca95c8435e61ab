"""Queries of reply parsing, streams, files and sinks, with SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pagemill.functions import jsonx
from pagemill.functions import text as tx
from pagemill.operators import covers, drivers, normalize, replies, toc
from pagemill.operators.pages import unique_pages
from pagemill.plans.text_queries import PAGES_SQL, WS_SQL, cleanup_sql, strip_sql
from pagemill.runtime import Query, shared_dir, table, written
from pagemill.sinks import epub
from pagemill.sources import files, providers
from pagemill.streaming import monitors, repetition, retry


def pages(spark, root):
    return unique_pages(table(spark, root, "page_results"))


def responses(spark, root):
    """Each page as a model reply, in eight states of disrepair by its number."""
    p = pages(spark, root)
    base = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), "page_continues_previous", "page_role", "title", "blocks", "notes", "illustrations"))
    v = F.pmod("result_id", F.lit(8)).cast("int")
    reply = (
        F.when(v == 0, base).when(v == 1, F.concat(F.lit("```json\n"), base, F.lit("\n```"))).when(v == 2, F.concat(F.lit("Here it is: "), base, F.lit(" Done.")))
        .when(v == 3, F.concat(F.lit('{""text"'), F.substring(base, 8, 1 << 30))).when(v == 4, F.replace(base, F.lit("\\n"), F.lit("\n")))
        .when(v == 5, F.left(base, F.length(base) - 20)).when(v == 6, F.concat(F.lit("["), base, F.lit("]"))).otherwise("{}")
    )
    return p.select("result_id", "book_id", "page", v.alias("variant"), reply.alias("response_text"))


def json_parse(spark, root):
    r = responses(spark, root)
    return r.select("result_id", "variant", F.get_json_object(jsonx.parse(F.col("response_text")), "$.text").alias("text"))


def json_repair(spark, root):
    """Replies in all states after the repair, read strictly: raw line feeds and doubled key quotes no longer hinder."""
    r = responses(spark, root)
    return r.select("result_id", F.get_json_object(F.when(F.try_parse_json(jsonx.repair(F.col("response_text"))).isNotNull(), jsonx.repair(F.col("response_text"))), "$.text").alias("text"))


def json_backup_text(spark, root):
    return responses(spark, root).select("result_id", jsonx.string_value(F.col("response_text"), "text").alias("text"))


def json_backup_flag(spark, root):
    return responses(spark, root).select("result_id", jsonx.bool_value(F.col("response_text"), "page_continues_previous").alias("flag"))


def toc_salvage(spark, root):
    """Contents replies of each page, broken off within the last item."""
    heads = F.filter("blocks", lambda b: (b["type"] == "heading") & (tx.cleanup(b["text"]) != ""))
    items = F.transform(heads, lambda b, i: F.struct(F.col("page").alias("page"), i.alias("block_index"), tx.cleanup(b["text"]).alias("label"), F.lit(7).alias("level")))
    whole = F.concat(F.lit('{"items":'), F.to_json(items), F.lit("}"))
    rows = pages(spark, root).where(F.size(heads) > 0).select("result_id", F.left(whole, F.length(whole) - 3).alias("reply"))
    return rows.select("result_id", F.explode(jsonx.salvaged_items(F.col("reply"))).alias("i")).select("result_id", "i.page", "i.block_index", "i.label", "i.level")


def json_objects(spark, root):
    """Number and length of complete objects in each saved state, read as a table function."""
    caches = table(spark, root, "recovery_caches").select("cache_id", "cache_json").dropDuplicates(["cache_id"])
    return caches.lateralJoin(jsonx.JsonObjects(F.col("cache_json").outer())).groupBy("cache_id").agg(F.count("*").alias("objects"), F.max(F.length("object")).alias("longest"))


def normalised_replies(spark, root):
    n = replies.normalised(responses(spark, root))
    return n.select("result_id", "tier", "status", "text", "page_role", "title", "page_continues_previous", "has_illustrations", "blocks", "notes", "illustrations")


def normalised_status(spark, root):
    return replies.normalised(responses(spark, root)).groupBy("variant", "tier", "status").count().withColumnRenamed("count", "n")


def error_classes(spark, root):
    messages = F.element_at(F.array(*map(F.lit, ("Reply is no valid JSON", "stuck: repeats white space", "HTTP 500: Failed to apply Qwen2VLProcessor on data", "timed out", ""))), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    rows = table(spark, root, "events").select("event_id", messages.alias("error"), F.when(F.pmod("event_id", F.lit(7)) == 0, "length").otherwise("stop").alias("finish_reason"))
    return rows.select("event_id", replies.error_class().alias("class"))


def repaired_pages(spark, root):
    """Pages after a repair patch by rule: first block deleted, second flagged, notes of even pages replaced, one added."""
    p = pages(spark, root)
    note = lambda t: F.array(F.struct(F.lit("1").alias("marker"), F.lit("footnote").alias("type"), F.lit(t).alias("text"), F.lit("").alias("anchor")))
    patch = F.struct(F.array(F.lit(0)).alias("delete_block_indices"), F.array(F.struct(F.lit(0).alias("block_index"), F.lit(True).alias("value"))).alias("set_block_continued_from_previous"), F.when(F.pmod("page", F.lit(2)) == 0, note("new")).alias("replace_notes"), note("more").alias("add_notes"))
    new = normalize.patched(F.col("blocks"), F.col("title"), F.col("page_continues_previous"), patch)
    notes = normalize.patched_notes(F.col("notes"), patch)
    return p.select("result_id", F.size(new).alias("n_blocks"), F.try_element_at(new, F.lit(1))["continued_from_previous"].alias("first_flag"), F.size(notes).alias("n_notes"), F.element_at(notes, -1)["text"].alias("last_note"))


def event_lines(spark, root):
    """Each page's text as a stream of events: forty characters a line, keep-alives between, then the end and a stray."""
    p = pages(spark, root).withColumn("text", F.coalesce("text", F.lit("")))
    n = F.greatest(F.ceil(F.length("text") / 40).cast("int"), F.lit(1))
    piece = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit('data: {"choices":[{"delta":'), F.to_json(F.struct(F.substring(F.col("text"), i * 40 + 1, F.lit(40)).alias("content"))), F.lit("}]}")))
    lines = F.concat(piece, F.array(F.lit(""), F.lit('data: {"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"total":7}}'), F.lit("data: [DONE]"), F.lit('data: {"choices":[{"delta":{"content":"late"}}]}')))
    return p.select("result_id", F.posexplode(lines).alias("seq", "line"))


def stream_replies(spark, root):
    r = monitors.replies(monitors.decode_events(event_lines(spark, root), ["result_id"]), ["result_id"])
    return r.select("result_id", "text", "finish_reason", F.col("usage")["total"].alias("total"))


def stuck_texts(spark, root):
    """Messages followed by a run that depends on their number: blanks, line breaks spelt out, a short cycle, or none."""
    n = F.pmod("doc_id", F.lit(5)).cast("int")
    tail = F.when(n == 0, F.repeat(F.lit(" \t"), 600)).when(n == 1, F.repeat(F.lit("/n"), 600)).when(n == 2, F.repeat(F.lit("ab-"), 400)).when(n == 3, F.repeat(F.lit('\\n", '), 400)).otherwise("")
    return table(spark, root, "documents").select("doc_id", repetition.reason(F.concat(F.col("text"), tail)).alias("reason")).distinct()


def watched_stream(spark, root):
    """The stuck-stream rules over a structured stream of deltas, read from the events files to their end."""
    src = spark.readStream.schema(spark.read.parquet(f"{root}/events.parquet").schema).parquet(f"{root}/events.parque*")
    delta = F.when(F.col("event_type") == "error", F.repeat(F.lit(" "), 40)).otherwise(F.concat(F.col("event_type"), F.lit(" ")))
    deltas = src.select(F.lit("b").alias("book_id"), F.col("user_id").cast("int").alias("page"), F.lit(1).alias("attempt"), F.col("event_id").alias("seq"), delta.alias("delta"))
    where = f"{shared_dir(spark)}/watch-{os.urandom(8).hex()}"
    query = repetition.watch(deltas).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{where}/out").groupBy("page").agg(F.count("*").alias("deltas"), F.count_if("forwarded").alias("forwarded"))


def retry_history(spark, root):
    """Events as attempts, seven to a target."""
    kind = F.element_at(F.array(*map(F.lit, ("invalid_json", "other", "ok", "repetition", "other", "invalid_json", "fatal_vision"))), (F.pmod(F.xxhash64("event_id"), F.lit(7)) + 1).cast("int"))
    kind = F.when(F.col("event_type") == "error", "invalid_json").when(F.pmod("event_id", F.lit(11)) == 0, "fatal_vision").when(F.pmod("event_id", F.lit(4)) == 0, "ok").otherwise("other")
    rows = table(spark, root, "events").select(F.floor(F.col("event_id") / 7).alias("target"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return retry.history(rows)


def retry_decisions(spark, root):
    rows = table(spark, root, "events").select("event_id", (F.pmod("event_id", F.lit(5)) - 2).cast("int").alias("code"), (F.pmod("event_id", F.lit(6)) + 1).cast("int").alias("attempt"))
    return rows.select("event_id", retry.decision(F.col("code"), F.col("attempt")).alias("decision"))


def retry_jitter(spark, root):
    p = pages(spark, root).select("result_id", retry.jitter_box(F.coalesce("image_path", F.lit("")), F.col("page"), F.lit(2)).alias("j"))
    return p.select("result_id", "j.*")


def recent_pages(spark, root):
    return monitors.recent(table(spark, root, "events").withColumnRenamed("user_id", "page"), "page", "event_id", 6)


def throttled_reports(spark, root):
    return monitors.throttled(table(spark, root, "events"), "event_type", "event_id", "props", 100).select("event_type", "event_id", "message", "n")


def char_progress(spark, root):
    e = table(spark, root, "events").select("user_id", "event_id", F.length("props").alias("n"))
    return monitors.thresholds(e, "user_id", "event_id", "n", 200)


def event_windows(spark, root):
    return monitors.windowed_counts(table(spark, root, "events")).select("start", "event_type", "n", F.round("total", 2).alias("total"))


def fingerprints(spark, root):
    d = table(spark, root, "documents").select("doc_id", F.encode("text", "utf-8").alias("c")).distinct()
    print_ = files.fingerprint(F.concat(F.lit("/mail/"), F.col("doc_id").cast("string")), F.octet_length("c"), F.col("doc_id") * 10, F.col("c"), 1000)
    return d.select("doc_id", print_.alias("fingerprint"))


def data_urls(spark, root):
    b = table(spark, root, "books").select("book_id", "title", "source_pdf").distinct()
    return b.select("book_id", files.data_url(F.encode(F.coalesce("title", F.lit("")), "utf-8"), F.lit(".PNG")).alias("url")).distinct()


def text_layers(spark, root):
    """Titles written into documents of one plain stream, repeated by the book's number of pages."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"[^A-Za-z ]", "")
    shown = F.repeat(F.concat(F.lit("BT ("), title, F.lit(") Tj ET\n")), F.coalesce("page_count", F.lit(1)))
    b = table(spark, root, "books").select("book_id", F.encode(F.concat(F.lit("1 0 obj <<>> stream\n"), shown, F.lit("endstream")), "utf-8").alias("content")).distinct()
    return files.text_layer(b, "book_id").select("book_id", "text_objects", "text_show_ops", "text_bytes", "streams_scanned", "has_text_layer")


def image_sizes(spark, root):
    e = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("int").alias("w"), F.col("l_suppkey").cast("int").alias("h"))
    return e.select("l_orderkey", "l_linenumber", files.fitted(F.col("w"), F.col("h"), 100).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


def replayed(spark, root):
    """Requests answered from recorded replies; every third page has none."""
    r = responses(spark, root).select("book_id", "page", F.lit(1).alias("attempt"), "response_text", F.lit("stop").alias("finish_reason"), F.lit(1.0).alias("seconds"))
    out = providers.Replay(r.where("page % 3 <> 0")).answer(r.select("book_id", "page", "attempt"))
    return out.select("book_id", "page", F.col("error").isNotNull().alias("failed"))


def retry_prompts(spark, root):
    r = responses(spark, root)
    return r.select("result_id", F.length(providers.retry_prompt(providers.page_prompt(True), F.lit("no JSON"), F.col("response_text"))).alias("n"))


def _recorded_images(p):
    """Images as a replay gives them: the box's place in the page spelt out."""
    from pagemill.sinks import epub

    return epub.figure_requests(p).withColumn("data", F.encode(F.concat_ws(",", F.col("image_path"), F.transform("bbox", lambda v: v.cast("string"))), "utf-8"))


def epub_files(spark, root):
    """Every file of every book's package, with a plan by rule, replayed images and covers."""
    p = pages(spark, root)
    plan = written(toc.rule_plan(toc.filtered(toc.candidates(p))), "plan")
    chosen = covers.best(covers.verdicts_by_role(p))
    images = p.select("book_id", F.col("page").alias("cover_page"), F.encode(F.coalesce("image_path", F.lit("")), "utf-8").alias("data"))
    files_ = epub.package(table(spark, root, "books"), p, plan, _recorded_images(p), chosen.join(images, ["book_id", "cover_page"]).select("book_id", "data"))
    return files_.select("book_id", "path", F.coalesce(F.length("content"), F.length("data")).alias("size"), F.sha2(F.coalesce(F.encode("content", "utf-8"), "data"), 256).alias("digest"))


def note_refs(spark, root):
    """Every note of every book with its reference and its text, read back from the finished body files."""
    p = pages(spark, root)
    text = epub.body_files(p).select("book_id", F.explode(F.regexp_extract_all("content", F.lit('(?s)href="#fn-[0-9]+" data-label="([^"]*)"[^>]*></a><span [^>]*data-wr-footernote="[^"]*"'), F.lit(0))).alias("m"))
    read = lambda pattern: F.regexp_extract("m", pattern, 1)
    return text.select("book_id", read(r'href="#fn-([0-9]+)"').try_cast("int").alias("note_no"), read('(?s)data-label="([^"]*)"').alias("label"), read('(?s)data-wr-footernote="([^"]*)"').alias("text"))


def nav_items(spark, root):
    e = toc.candidates(pages(spark, root)).select(*toc.KEYS, "text", F.col("ocr_level").alias("level"), F.lit("#").alias("href"))
    return epub.navigation_items(e).select("book_id", "ord", "depth")


def _contents(spark, root):
    """Contents of every book by a reviewer whose replies are good, broken once, cut, broken twice, missing, or hold items
    that were not asked for, by the chunk's number."""
    cands = written(toc.filtered(toc.candidates(pages(spark, root))), "headings")
    chunks = toc.chunked(cands, 4)
    v = F.pmod("chunk", F.lit(6))
    item = F.struct("page", "block_index", F.concat(F.lit("R "), F.col("text")).alias("label"), F.col("ocr_level").alias("level"), F.lit("seen").alias("reason"))
    listed = F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items")))
    whole = chunks.groupBy("book_id", "chunk").agg(listed.alias("whole")).withColumn("v", v)
    stray = F.replace("whole", F.lit('{"items":['), F.lit('{"items":[{"page":99999999,"block_index":0,"label":"R no","level":1},{"page":"x","label":""},7,'))
    first = whole.where("v <> 4").select("book_id", "chunk", F.lit(1).alias("attempt"), F.when(F.col("v") == 0, F.col("whole")).when(F.col("v") == 5, stray).otherwise("sorry").alias("response_text"))
    second = whole.where("v IN (1, 2, 3)").select("book_id", "chunk", F.lit(2).alias("attempt"), F.when(F.col("v") == 1, F.col("whole")).when(F.col("v") == 2, F.left("whole", F.length("whole") - 3)).otherwise("no").alias("response_text"))
    return drivers.plan_contents(cands, providers.Replay(written(first.unionByName(second), "recorded")), 4)


def toc_driver(spark, root):
    return _contents(spark, root)[0].select(*toc.KEYS, "label", "level", "reason")


def toc_chunk_ends(spark, root):
    return _contents(spark, root)[1].select("book_id", "chunk", "attempts", "tier")


def _rounds(spark, root):
    """Every page read in rounds from recorded replies that fail in seven ways by the page's number."""
    p = pages(spark, root).dropDuplicates(["book_id", "page"]).where("book_id IS NOT NULL AND page IS NOT NULL")
    base = F.to_json(F.struct("text", "page_continues_previous", "page_role", "title", "blocks", "notes", "illustrations"))
    p = p.select("book_id", "page", "image_path", F.array().cast("array<string>").alias("images"), base.alias("base"), F.pmod("page", F.lit(7)).alias("v"))
    each = p.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("attempt"))
    v, n = F.col("v"), F.col("attempt")
    fine = ((v == 0) & (n == 1)) | ((v == 1) & (n == 2)) | ((v == 6) & (n == 4))
    text = F.when(fine, F.col("base")).when((v == 2) & (n == 1), F.concat(F.lit("oops "), F.left("base", F.lit(9)))).when((v == 3) & (n <= 2), F.left("base", F.length("base") - 20))
    error = F.when((v == 1) & (n == 1), "timed out").when(v == 4, "HTTP 500: Failed to apply Qwen2VLProcessor").when((v == 6) & (n < 4), "stuck: repeats (cycle)")
    kept = fine | ((v == 2) & (n == 1)) | ((v == 3) & (n <= 2)) | error.isNotNull()
    recorded = each.where(kept).select("book_id", "page", "attempt", text.alias("response_text"), F.lit("stop").alias("finish_reason"), error.alias("error"))
    mended = p.where("v = 2").select("book_id", "page", F.lit(1).alias("attempt"), F.lit(1).alias("correction"), F.col("base").alias("response_text"))
    return drivers.read_pages(p, providers.Replay(written(recorded, "recorded")), correct=providers.Replay(written(mended, "recorded-corrections")))


def page_rounds(spark, root):
    results, ends = _rounds(spark, root)
    return ends.join(results.select("book_id", "page", "tier"), ["book_id", "page"], "left").select("book_id", "page", "attempts", "outcome", "tier")


def page_round_texts(spark, root):
    return _rounds(spark, root)[0].select("book_id", "page", "text")


def cover_driver(spark, root):
    """The cover of every book: asked for all first pages at once, refused, failed or answered badly by the book's number,
    then page by page."""
    p = pages(spark, root).where("page BETWEEN 1 AND 5 AND book_id IS NOT NULL").dropDuplicates(["book_id", "page"])
    v = F.pmod(F.regexp_extract("book_id", r"(\d+)\z", 1).cast("bigint"), F.lit(4))
    books = p.select("book_id", v.alias("v")).distinct()
    many = books.select("book_id", F.lit(None).cast("int").alias("page"), F.when(F.col("v") == 0, '{"cover_page": 2, "reason": "title"}').when(F.col("v") == 3, "none of them").alias("response_text"), F.when(F.col("v") == 1, "HTTP 400 BadRequestError").when(F.col("v") == 2, "Failed to apply the processor to images").alias("error"))
    score = F.when(F.col("page_role") == "cover", '{"is_cover": "yes", "cover_quality": 0.9}').when(F.col("page_role") == "front_matter", '{"is_cover": true, "score": 0.5}').otherwise('{"is_cover": false}')
    one = p.select("book_id", "page", score.alias("response_text"), F.lit(None).cast("string").alias("error"))

    class Recorded:
        def answer(self, requests, keys):
            return providers.Replay(many.drop("page") if keys == ["book_id"] else one).answer(requests, keys)

    return drivers.choose_covers(p.select("book_id", "page", F.coalesce("image_path", F.lit("")).alias("image")), Recorded()).select("book_id", "cover_page")


def repaired_in_turn(spark, root):
    """Pages after two patches, of which the second sees what the first left."""
    p = pages(spark, root)
    note = lambda t: F.array(F.struct(F.lit("1").alias("marker"), F.lit("footnote").alias("type"), F.lit(t).alias("text"), F.lit("").alias("anchor")))
    patch = lambda **given: F.struct(*((given[f.split(":")[0]] if f.split(":")[0] in given else F.lit(None)).alias(f.split(":")[0]) for f in ("set_title", "set_page_continues_previous", "delete_block_indices", "set_block_continued_from_previous", "replace_notes", "add_notes"))).cast(normalize.PATCH)
    first = patch(set_title=F.lit("none"), delete_block_indices=F.array(F.lit(0)), replace_notes=note("new"))
    second = patch(delete_block_indices=F.array(F.lit(0)), set_page_continues_previous=F.lit(True), add_notes=note("more"))
    r = normalize.patched_page(F.col("blocks"), F.col("notes"), F.col("title"), F.col("page_continues_previous"), F.array(first, second))
    return p.select("result_id", r.alias("r")).select("result_id", "r.title", F.col("r.continues").alias("continues"), F.size("r.blocks").alias("n_blocks"), F.size("r.notes").alias("n_notes"))


def repair_requests(spark, root):
    """What a repair request shows of each page, read back from its JSON."""
    j = providers.page_for_repair()
    read = pages(spark, root).select("result_id", providers.repair_prompt(F.array(j), F.lit('{"risk":1}')).alias("q"), j.alias("j"))
    shape = "struct<page:int,title:string,page_role:string,page_continues_previous:boolean,blocks:array<struct<index:int,type:string,level:int,text:string>>,notes:array<struct<text:string>>>"
    return read.select("result_id", F.endswith("q", F.concat(F.lit('"pages":['), F.col("j"), F.lit("]}"))).alias("quoted"), F.from_json("j", shape).alias("p")).select("result_id", "quoted", "p.page", "p.title", "p.page_role", "p.page_continues_previous", F.size("p.blocks").alias("n_blocks"), F.get("p.blocks", F.size("p.blocks") - 1)["index"].alias("last_index"), F.size("p.notes").alias("n_notes"))


def flagship(spark, root):
    """Replies to a finished contents list: parse, normalise, candidates, filter, rule plan, nesting."""
    n = written(replies.normalised(responses(spark, root)).where("status = 'ok'"), "pages")
    plan = toc.rule_plan(toc.filtered(toc.candidates(n)))
    return toc.nested(plan.withColumnRenamed("label", "text")).select(*toc.KEYS, "text", "nav_level", "parent")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    json_parse, json_repair, json_backup_text, json_backup_flag, toc_salvage, json_objects, normalised_replies, normalised_status, error_classes, repaired_pages,
    stream_replies, stuck_texts, watched_stream, retry_history, retry_decisions, retry_jitter, recent_pages, throttled_reports, char_progress, event_windows,
    fingerprints, data_urls, text_layers, image_sizes, replayed, retry_prompts, epub_files, note_refs, nav_items, flagship, toc_driver, toc_chunk_ends, page_rounds, page_round_texts, cover_driver, repaired_in_turn, repair_requests,
)}

_R = f"(SELECT * REPLACE (coalesce(text, '') AS text) FROM {PAGES_SQL})"
_HEADS = f"list_filter(coalesce(blocks, []), lambda b: b.type = 'heading' AND {cleanup_sql('b.text')} <> '')"

# Blocks whose texts stand in for a missing one.
_SHOWN = f"len(list_filter(coalesce(blocks, []), lambda b: {cleanup_sql('b.text')} <> '')) > 0"

ORACLES: dict[str, str] = {
    "json_parse": f"SELECT result_id, (result_id % 8)::INT AS variant, CASE WHEN result_id % 8 < 5 THEN text END AS text FROM {_R}",
    "json_repair": f"SELECT result_id, CASE WHEN result_id % 8 IN (0, 3, 4) THEN text END AS text FROM {_R}",
    "json_backup_text": f"SELECT result_id, CASE WHEN result_id % 8 = 7 THEN '' ELSE text END AS text FROM {_R}",
    "json_backup_flag": f"SELECT result_id, result_id % 8 <> 7 AND coalesce(page_continues_previous, false) AS flag FROM {_R}",
    "toc_salvage": f"""WITH h AS (SELECT result_id, page, {_HEADS} AS h FROM {PAGES_SQL}), x AS (SELECT result_id, page, h, unnest(range(1, len(h))) AS i FROM h)
 SELECT result_id, page, (i - 1)::INT AS block_index, {cleanup_sql('h[i].text')} AS label, 4 AS level FROM x""",
    "error_classes": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'truncated' ELSE ['invalid_json', 'repetition', 'fatal_vision', 'other', NULL][(event_id % 5)::INT + 1] END AS class FROM events""",
    "repaired_pages": f"""WITH t AS (SELECT result_id, page, coalesce(blocks, []) AS b, notes, regexp_replace(coalesce(title, ''), '{WS_SQL}+', '', 'g') AS tk, coalesce(page_continues_previous, false) AS pcp FROM {PAGES_SQL}),
 k AS (SELECT *, len(b) > 0 AND NOT (b[1].type = 'heading' AND tk <> '' AND regexp_replace(coalesce(b[1].text, ''), '{WS_SQL}+', '', 'g') = tk AND NOT pcp) AS gone FROM t)
 SELECT result_id, (len(b) - CASE WHEN gone THEN 1 ELSE 0 END)::INT AS n_blocks, CASE WHEN len(b) - CASE WHEN gone THEN 1 ELSE 0 END > 0 THEN true END AS first_flag,
 (1 + CASE WHEN page % 2 = 0 THEN 1 ELSE len(coalesce(notes, [])) END)::INT AS n_notes, 'more' AS last_note FROM k""",
    "stream_replies": f"SELECT result_id, text, 'stop' AS finish_reason, 7::BIGINT AS total FROM {_R}",
    "stuck_texts": """WITH d AS (SELECT DISTINCT doc_id, right(text || CASE doc_id % 5 WHEN 0 THEN repeat(' ' || chr(9), 600) WHEN 1 THEN repeat('/n', 600) WHEN 2 THEN repeat('ab-', 400) WHEN 3 THEN repeat('\\n", ', 400) ELSE '' END, 1024) AS tail, doc_id % 5 AS v FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, CASE v WHEN 0 THEN 'blank' WHEN 1 THEN 'cycle' WHEN 2 THEN CASE WHEN length(tail) % 3 = 0 THEN 'cycle' ELSE '' END WHEN 3 THEN CASE WHEN length(regexp_replace(regexp_replace(tail, '\\s+', '', 'g'), '["'',]+', '', 'g')) % 2 = 0 THEN 'cycle' ELSE '' END ELSE '' END AS reason FROM d""",
    "retry_decisions": "SELECT event_id, CASE WHEN event_id % 5 - 2 <> -2 AND event_id % 6 + 1 <= 3 THEN 'retry' ELSE 'ask' END AS decision FROM events",
    "recent_pages": "SELECT user_id AS page, max(event_id) AS last_seq FROM events GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 6",
    "throttled_reports": """SELECT event_type, event_id, trim(props)[:180] AS message, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE trim(props) <> '') WHERE n % 100 = 0""",
    "char_progress": """WITH RECURSIVE e AS (SELECT user_id, event_id, len(props) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT user_id, event_id, i, n::BIGINT AS total, CASE WHEN n >= 200 THEN 400 ELSE 200 END AS mark, n >= 200 AS report FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, f.total + e.n, CASE WHEN f.total + e.n >= f.mark THEN f.mark + 200 ELSE f.mark END, f.total + e.n >= f.mark FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, event_id, total FROM f WHERE report""",
    "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "fingerprints": """WITH d AS (SELECT DISTINCT doc_id, hex(encode(text)) AS h FROM documents)
 SELECT doc_id, sha256(unhex(hex(encode('/mail/' || doc_id || (len(h) // 2) || (doc_id * 10))) || h[:2000] || CASE WHEN len(h) > 2000 THEN right(h, 2000) ELSE '' END)) AS fingerprint FROM d WHERE h IS NOT NULL""",
    "data_urls": "SELECT DISTINCT book_id, 'data:image/png;base64,' || base64(encode(coalesce(title, ''))) AS url FROM books",
    "text_layers": """WITH b AS (SELECT DISTINCT book_id, regexp_replace(coalesce(title, ''), '[^A-Za-z ]', '', 'g') AS t, coalesce(page_count, 1) AS n FROM books)
 SELECT book_id, 2 * n::BIGINT AS text_objects, 2 * n::BIGINT AS text_show_ops, CASE WHEN len(t) < 2 THEN 0 ELSE 2 * n * (len(t) + 1) END::BIGINT AS text_bytes, 1::BIGINT AS streams_scanned,
 2 * n >= 20 OR CASE WHEN len(t) < 2 THEN 0 ELSE 2 * n * (len(t) + 1) END >= 1200 AS has_text_layer FROM b""",
    "image_sizes": """SELECT l_orderkey, l_linenumber, CASE WHEN greatest(l_partkey, l_suppkey) <= 100 THEN l_partkey ELSE greatest(1, trunc(l_partkey * (100.0::DOUBLE / greatest(l_partkey, l_suppkey)))) END::INT AS width,
 CASE WHEN greatest(l_partkey, l_suppkey) <= 100 THEN l_suppkey ELSE greatest(1, trunc(l_suppkey * (100.0::DOUBLE / greatest(l_partkey, l_suppkey)))) END::INT AS height FROM lineitem""",
    "replayed": f"SELECT book_id, page, page % 3 = 0 AS failed FROM {_R}",
    "retry_history": """WITH e AS (SELECT event_id // 7 AS target, event_id AS seq, CASE WHEN event_type = 'error' THEN 'invalid_json' WHEN event_id % 11 = 0 THEN 'fatal_vision' WHEN event_id % 4 = 0 THEN 'ok' ELSE 'other' END AS kind FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq) AS i FROM e), s AS (SELECT target, coalesce(min(i) FILTER (kind IN ('ok', 'fatal_vision')), 999) AS settled, max(i) AS n FROM n GROUP BY target),
 x AS (SELECT target, least(settled, 4) AS stop, settled, n FROM s)
 SELECT x.target, CASE WHEN x.n >= stop THEN stop ELSE x.n + 1 END::INT AS attempts, CASE WHEN x.n < stop THEN 'open' WHEN settled <= 4 THEN CASE k.kind WHEN 'ok' THEN 'accepted' ELSE 'raised' END ELSE 'asked' END AS outcome, k.kind AS last_kind
 FROM x JOIN n k ON k.target = x.target AND k.i = least(x.stop, x.n)""",
    "page_rounds": f"""WITH p AS (SELECT DISTINCT ON (book_id, page) *, page % 7 AS v, {strip_sql("coalesce(text, list_filter(list_transform(blocks, lambda b: b.text), lambda t: t IS NOT NULL)[1], list_filter(list_transform(notes, lambda n: n.text), lambda t: t IS NOT NULL)[1], '')")} <> '' AS has_text, {strip_sql("coalesce(text, '')")} <> '' OR len(list_filter(coalesce(illustrations, []), lambda i: len(i.bbox) = 4 AND NOT list_bool_or(list_transform(i.bbox, lambda x: x IS NULL)))) > 0 OR {_SHOWN} OR page_role IN ('blank', 'cover', 'copyright') AS usable FROM {PAGES_SQL} WHERE book_id IS NOT NULL AND page IS NOT NULL)
 SELECT book_id, page, CASE WHEN v = 4 THEN 1 WHEN v = 3 THEN CASE WHEN has_text THEN 2 ELSE 4 END WHEN v = 5 OR NOT usable THEN 4 ELSE CASE v WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END END AS attempts,
 CASE WHEN v = 4 THEN 'raised' WHEN v = 3 THEN CASE WHEN has_text THEN 'backup' ELSE 'asked' END WHEN v = 5 OR NOT usable THEN 'asked' ELSE 'accepted' END AS outcome,
 CASE WHEN v IN (4, 5) OR (v = 3 AND NOT has_text) OR (v <> 3 AND NOT usable) THEN NULL ELSE CASE v WHEN 2 THEN 'corrected' WHEN 3 THEN 'backup' ELSE 'parsed' END END AS tier FROM p""",
    "cover_driver": f"""WITH p AS (SELECT DISTINCT ON (book_id, page) * FROM {PAGES_SQL} WHERE page BETWEEN 1 AND 5 AND book_id IS NOT NULL),
 b AS (SELECT book_id, regexp_extract(book_id, '([0-9]+)$', 1)::BIGINT % 4 AS v, count(*) AS n, arg_min(page, CASE page_role WHEN 'cover' THEN 0 WHEN 'front_matter' THEN 10 END + page) FILTER (page_role IN ('cover', 'front_matter')) AS best FROM p GROUP BY 1, 2)
 SELECT book_id, CASE WHEN n > 1 AND v = 0 THEN 2 WHEN n > 1 AND v = 3 THEN 1 ELSE coalesce(best, 1) END::INT AS cover_page FROM b""",
    "repaired_in_turn": f"""SELECT result_id, 'none' AS title, true AS continues, CASE WHEN len(b) = 0 THEN 0 ELSE len(b) - 1 - CASE WHEN len(b) > 1 THEN 1 ELSE 0 END END::INT AS n_blocks, 2 AS n_notes FROM (SELECT result_id, coalesce(blocks, []) AS b FROM {PAGES_SQL})""",
    "repair_requests": f"""SELECT result_id, true AS quoted, coalesce(page, 0) AS page, coalesce(title, '') AS title, coalesce(nullif(page_role, ''), 'unknown') AS page_role, coalesce(page_continues_previous, false) AS page_continues_previous,
 len(coalesce(blocks, []))::INT AS n_blocks, CASE WHEN len(blocks) > 0 THEN len(blocks) - 1 END::INT AS last_index, len(coalesce(notes, []))::INT AS n_notes FROM {PAGES_SQL}""",
}
