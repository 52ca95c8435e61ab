"""Whole jobs against a model: contents chunk by chunk, pages in rounds, covers. Each round is one table of requests, one of
replies, and one of what is still open, written to the shared folder; no state is held on the driver but the round's number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import jsonx
from pagemill.functions import text as tx
from pagemill.operators import covers, replies, resume, toc
from pagemill.runtime import written
from pagemill.sources import providers
from pagemill.streaming import retry

#: Attempts a chunk of contents gets before the rule takes over; characters of a reason that are kept.
CONTENTS_ATTEMPTS, REASON = 3, 1000
CHUNK = ["book_id", "chunk"]
ITEMS = "array<struct<page:string,block_index:string,label:string,level:string,reason:string>>"


# ---- contents -----------------------------------------------------------------------------------------------------------


def contents_items(parsed: Column) -> Column:
    """The items of a parsed contents reply: page 0 where absent, a block number required, level 1 to 4 (absent: 1), label
    cleaned and not empty; odd items go."""
    raw = F.from_json(F.get_json_object(parsed, "$.items"), "array<string>")
    one = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.struct(*(F.get_json_object(x, f"$.{c}").alias(c) for c in ("page", "block_index", "label", "level", "reason"))))
    whole = lambda v, absent: F.when(F.coalesce(v, F.lit("")).isin("", "0"), F.lit(absent)).otherwise(v.try_cast("int"))
    typed = F.transform(one, lambda x: F.struct(whole(x["page"], 0).alias("page"), x["block_index"].try_cast("int").alias("block_index"), tx.cleanup(x["label"]).alias("label"), tx.clamp(whole(x["level"], 1), 1, 4).alias("level"), tx.text_or_empty(x["reason"]).alias("reason")))
    return F.filter(typed, lambda x: x["page"].isNotNull() & x["block_index"].isNotNull() & x["level"].isNotNull() & (x["label"] != ""))


def contents_requests(cands: DataFrame, size: int = toc.CHUNK) -> tuple[DataFrame, DataFrame]:
    """(chunked candidates, one request a chunk): the request holds the chunk's candidates as JSON."""
    chunks = written(toc.chunked(cands, size), "chunks")
    compact = toc.compact(chunks).columns[1:]
    rows = toc.compact(chunks).join(chunks.select(*toc.KEYS, "chunk"), toc.KEYS)
    listed = F.to_json(F.array_sort(F.collect_list(F.struct(*compact))))
    last = chunks.groupBy("book_id").agg((F.max("chunk") + 1).alias("chunks"))
    per = rows.groupBy(*CHUNK).agg(listed.alias("candidates")).join(last, "book_id")
    return chunks, per.select(*CHUNK, "candidates", providers.contents_prompt(F.col("candidates"), F.col("chunk"), F.col("chunks")).alias("prompt"))


def plan_contents(cands: DataFrame, model: providers.ChatModel, size: int = toc.CHUNK) -> tuple[DataFrame, DataFrame]:
    """(plan, chunks): the contents of every book as a model reviews them, and how each chunk came to its items.

    A reply that does not parse is asked for once more with the error; of a second one whatever items are whole are kept;
    a chunk that gives none, or whose calls fail three times, takes every candidate by rule. Only a chunk's own candidates
    count, and of repeated keys the first in order of chunks. ``plan``: book_id, page, block_index, label, level, reason,
    ord, chunk; ``chunks``: book_id, chunk, attempts, tier (parsed, salvaged, fallback), reason.
    """
    chunks, requests = contents_requests(cands, size)
    keys = [*CHUNK, "attempt"]
    open_ = written(requests.withColumns({"attempt": F.lit(1), "corrected": F.lit(False)}), "contents-open")
    done = []
    for attempt in range(1, CONTENTS_ATTEMPTS + 1):
        got = model.answer(open_, keys)
        rows = open_.join(got.select(*keys, "response_text", "error"), keys).withColumn("parsed", jsonx.parse(F.col("response_text")))
        is_object = F.coalesce(F.col("parsed").startswith("{"), F.lit(False))
        salvaged = F.transform(jsonx.salvaged_items(F.when(~is_object & F.col("corrected"), F.col("response_text"))), lambda x: F.struct(x["page"].alias("page"), x["block_index"].alias("block_index"), tx.cleanup(x["label"]).alias("label"), x["level"].alias("level"), x["reason"].alias("reason")))
        failed = F.col("error").isNotNull()
        whole = F.coalesce(F.filter(salvaged, lambda x: x["label"] != ""), F.array())
        tier = F.when(failed, F.when(F.lit(attempt >= CONTENTS_ATTEMPTS), "fallback")).when(is_object, "parsed").when(F.col("corrected"), F.when(F.size("_whole") > 0, "salvaged").otherwise("fallback"))
        rows = rows.withColumns({"_items": contents_items(F.when(is_object, F.col("parsed"))), "_whole": whole}).withColumn("tier", tier)
        rows = written(rows.withColumn("items", F.when(F.col("tier") == "parsed", F.col("_items")).when(F.col("tier") == "salvaged", F.col("_whole"))), "contents-round")
        reason = F.when(F.col("tier") == "fallback", F.substring(F.coalesce("error", F.lit("contents reply is no valid JSON")), 1, REASON)).otherwise("")
        done.append(rows.where("tier IS NOT NULL").select(*CHUNK, F.lit(attempt).alias("attempts"), "tier", reason.alias("reason"), "items"))
        left = rows.where("tier IS NULL")
        if attempt == CONTENTS_ATTEMPTS or left.isEmpty():
            break
        again = F.when(failed, F.col("prompt")).otherwise(providers.contents_correction_prompt(F.col("candidates"), F.lit("not valid JSON"), F.col("response_text")))
        open_ = left.select(*CHUNK, "candidates", again.alias("prompt"), F.lit(attempt + 1).alias("attempt"), (F.col("corrected") | ~failed).alias("corrected"))
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    ended = written(ended, "contents-chunks")
    step = F.col("chunk").cast("bigint") * 1_000_000
    reviewed = ended.where("tier <> 'fallback'").select(*CHUNK, F.posexplode("items").alias("i", "x")).select(*CHUNK, "x.*", (step + F.col("i")).alias("ord"))
    reviewed = toc.only_asked(reviewed, chunks)
    by_rule = chunks.join(ended.where("tier = 'fallback'").select(*CHUNK), CHUNK, "left_semi")
    by_rule = by_rule.select(*CHUNK, "page", "block_index", tx.cleanup(F.col("text")).alias("label"), tx.clamp(F.col("ocr_level"), 1, 4).alias("level"), F.lit("rule").alias("reason"), (step + F.pmod(toc.entry_order(), F.lit(1_000_000))).alias("ord")).where("label <> ''")
    return toc.first_per_key(reviewed.unionByName(by_rule.select(reviewed.columns))), ended.drop("items")


# ---- pages --------------------------------------------------------------------------------------------------------------

PAGE = ["book_id", "page"]
STATE = "attempt int, previous_invalid string, corrected array<string>, backed_up array<string>, error string, response string, repetitions int, exclusive boolean, jitter int, temperature double, outcome string"
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def first_state(requests: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    values = {"attempt": F.lit(1), "previous_invalid": F.lit(None).cast("string"), "corrected": none, "backed_up": none, "error": F.lit(""), "response": F.lit(""), "repetitions": F.lit(0), "exclusive": F.lit(False), "jitter": F.lit(0), "temperature": F.lit(0.0), "outcome": F.lit("")}
    return requests.withColumns(values)


def stepped(rows: DataFrame, workers: int, auto: int) -> DataFrame:
    """Open requests with one attempt's end (kind, reply, message, finish, correction_ok, backup_ok) as their next state;
    the retry rules run a request a row."""
    kinds = dict(rows.dtypes)
    carried = [c for c in rows.columns if c not in (*STATE_COLUMNS, "kind", "reply", "message", "finish", "correction_ok", "backup_ok")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.to_dict("records"):
                before = retry.State(int(r["attempt"]), r["previous_invalid"], frozenset(r["corrected"]), frozenset(r["backed_up"]), r["error"], r["response"], int(r["repetitions"]), bool(r["exclusive"]), int(r["jitter"]), float(r["temperature"]))
                event = retry.Event(r["kind"], r["reply"] or "", r["message"] or "", r["finish"] or "", bool(r["correction_ok"]), bool(r["backup_ok"]))
                s = retry.step(before, event, workers, auto)
                out.append((*(r[c] for c in carried), s.attempt, s.previous_invalid, sorted(s.corrected), sorted(s.backed_up), s.error, s.response, s.repetitions, s.exclusive, s.jitter, s.temperature, s.outcome))
            yield pd.DataFrame(out, columns=[*carried, *STATE_COLUMNS])

    return rows.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), STATE]))


RESULT = ["text", "page_role", "title", "page_continues_previous", "has_illustrations", "blocks", "notes", "illustrations"]


def read_pages(requests: DataFrame, model: providers.ChatModel, prompt: str | None = None, workers: int = 4, auto: int = retry.AUTO_RETRIES, correct: providers.ChatModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, ends): every page read by a model in rounds, with the rules for retries.

    ``requests``: book_id, page, image_path, images. A round asks all open pages, shared ones side by side and those that
    need the model to themselves one at a time. A reply that is no page is asked for once as corrected JSON; one that comes
    twice the same is read by pattern; a stuck one is asked afresh with the image shifted a little; failures of the server
    to read images end a page. After ``auto`` retries a page is left for someone to decide. ``results``: book_id, page,
    tier and the page schema; ``ends``: book_id, page, attempts, outcome (accepted, backup, raised, asked), error.
    """
    base = prompt or providers.page_prompt()
    correct = correct or model
    state = written(first_state(requests.select(*PAGE, "image_path", "images")), "pages-open")
    results, ends = [], []
    keys = providers.KEYS
    while True:
        ask = state.withColumn("prompt", F.when((F.col("attempt") > 1) & ((F.col("error") != "") | (F.col("response") != "")), providers.retry_prompt(base, F.col("error"), F.col("response"))).otherwise(F.lit(base)))
        got = model.answer(ask.where("NOT exclusive"), keys).unionByName(model.exclusive().answer(ask.where("exclusive"), keys))
        got = written(got.select(*keys, "response_text", "finish_reason", F.col("error").alias("failure")), "page-replies")
        read = replies.normalised(got)
        failed = F.col("failure").isNotNull()
        stuck = F.lower("finish_reason").eqNullSafe("repetition") | F.coalesce(F.col("failure").contains("repeat"), F.lit(False))
        kind = F.when(stuck, "repetition").when(replies.is_vision_failure(F.col("failure")), "fatal_vision").when(failed, "other").when((F.col("tier") == "parsed") & (F.col("status") == "ok"), "ok").when(F.col("tier") == "parsed", "other").otherwise("invalid_json")
        message = F.when(failed, F.col("failure")).when(F.col("tier") == "parsed", "the reply holds no usable page").otherwise(F.when(F.lower("finish_reason").isin("length", "max_tokens"), "not valid JSON: cut by the token limit").otherwise("not valid JSON"))
        seen = written(read.withColumns({"kind": kind, "message": message}), "page-read")
        # One correction for each new reply that is no JSON and was not cut.
        wrong = seen.where("kind = 'invalid_json' AND coalesce(response_text, '') <> '' AND coalesce(lower(finish_reason), '') NOT IN ('length', 'max_tokens')")
        fresh = wrong.select(*keys, "response_text", "message").join(state.select(*keys, "corrected"), keys).where(~F.array_contains("corrected", tx.strip(F.col("response_text"))))
        fixed_keys = [*keys, "correction"]
        asked = fresh.select(*keys, F.lit(1).alias("correction"), providers.correction_prompt(F.col("message"), F.col("response_text")).alias("prompt"))
        asked = written(asked, "page-corrections")
        if asked.isEmpty():
            fixed = seen.where("false")
        else:
            fixed = written(replies.normalised(correct.answer(asked, fixed_keys)).where("tier = 'parsed' AND status = 'ok' AND error IS NULL"), "page-corrected")
        rows = state.join(seen.select(*keys, "kind", tx.strip(F.coalesce("response_text", F.lit(""))).alias("reply"), "message", F.lower(F.coalesce("finish_reason", F.lit(""))).alias("finish"), (F.col("tier") == "backup").alias("backup_ok")), keys)
        rows = rows.join(fixed.select(*keys, F.lit(True).alias("correction_ok")), keys, "left").fillna(False, ["correction_ok"])
        after = written(stepped(rows, workers, auto), "pages-after")
        own = lambda outcome, df, tier: df.join(after.where(outcome).select(*PAGE), PAGE, "left_semi").select(*PAGE, F.lit(tier).alias("tier") if tier else "tier", *RESULT)
        accepted = seen.where("kind = 'ok'")
        results += [own("outcome = 'accepted'", accepted, None), own("outcome = 'accepted'", fixed.join(accepted.select(*PAGE), PAGE, "left_anti"), "corrected"), own("outcome = 'backup'", seen.where("tier = 'backup'"), None)]
        ends.append(after.where("outcome <> ''").select(*PAGE, F.col("attempt").alias("attempts"), "outcome", "error"))
        state = after.where("outcome = ''")
        if state.isEmpty():
            break
    out, ended = results[0], ends[0]
    for more in results[1:]:
        out = out.unionByName(more)
    for more in ends[1:]:
        ended = ended.unionByName(more)
    return written(out, "page-results"), ended


def whole_job(requests: DataFrame, model: providers.ChatModel, contents: providers.ChatModel, size: int = toc.CHUNK, cached: DataFrame | None = None) -> dict[str, DataFrame]:
    """From page images to what a package needs: ``results`` (with those ``cached`` from an earlier run), ``ends``,
    ``missing`` pages, and ``plan``. Pages in ``cached`` are not asked again."""
    todo = requests if cached is None else requests.join(cached.select(*PAGE), PAGE, "left_anti")
    results, ends = read_pages(todo, model)
    if cached is not None:
        results = cached.select(results.columns).unionByName(results)
    plan, chunks = plan_contents(toc.filtered(toc.candidates(results)), contents, size)
    missing = requests.select(*PAGE).join(results.select(*PAGE), PAGE, "left_anti")
    return {"results": results, "ends": ends, "missing": missing, "report": resume.missing_report(missing), "plan": plan, "chunks": chunks}


# ---- covers -------------------------------------------------------------------------------------------------------------


def choose_covers(images: DataFrame, model: providers.ChatModel, scan: int = covers.SCAN_PAGES, together: bool = True) -> DataFrame:
    """(book_id, cover_page, reason): ``images``: book_id, page, image. With ``together`` one request shows a book's first
    pages at once; where the server cannot read them so, or refuses the request, the pages are judged one by one and the
    best cover wins, the earliest of ties. A reply that cannot be used gives page 1."""
    few = written(images.where(F.col("page").between(1, max(1, scan))).select("book_id", "page", "image"), "cover-pages")
    shown = few.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "image"))), lambda x: x["image"]).alias("images"), F.count("*").alias("n"))
    key = ["book_id"]
    none = F.lit("no cover found; the first page stands")
    alone = shown.select("book_id")
    settled = None
    if together:
        many = shown.where("n > 1")
        got = written(many.join(model.answer(many.select("book_id", F.lit(providers.COVERS_PROMPT).alias("prompt"), "images"), key), key).withColumn("parsed", jsonx.parse(F.col("response_text"))), "covers-together")
        fatal = replies.is_vision_failure(F.col("error"))
        refused = F.coalesce(F.col("error").contains("400") | F.col("error").contains("BadRequestError"), F.lit(False))
        page = F.get_json_object("parsed", "$.cover_page")
        usable = F.col("error").isNull() & F.coalesce(F.col("parsed").startswith("{"), F.lit(False)) & (F.coalesce(page, F.lit("1")).try_cast("int").isNotNull())
        rest = got.withColumn("again", fatal | refused)
        chosen = F.greatest(F.lit(1), F.least(F.col("n").cast("int"), F.when(F.coalesce(page, F.lit("")).isin("", "0"), 1).otherwise(page.try_cast("int"))))
        settled = rest.where(~F.col("again")).select("book_id", F.when(usable, chosen).otherwise(1).alias("cover_page"), F.when(usable, tx.text_or_empty(F.get_json_object("parsed", "$.reason"))).otherwise("the reply names no cover").alias("reason"))
        alone = shown.where("n <= 1").select("book_id", F.lit("").alias("why")).unionByName(rest.where("again").select("book_id", F.when(fatal, F.concat(F.lit("pages could not be judged together: "), F.substring_index("error", "\n", 1))).otherwise("").alias("why")))
    else:
        alone = shown.select("book_id", F.lit("").alias("why"))
    asked = few.join(alone.select("book_id"), "book_id", "left_semi").select("book_id", "page", F.lit(providers.COVER_PROMPT).alias("prompt"), F.array("image").alias("images"))
    one = model.answer(asked, ["book_id", "page"])
    parsed = jsonx.parse(F.col("response_text"))
    judged = one.where("error IS NULL").withColumn("v", covers.verdict(parsed)).withColumn("why_not", tx.text_or_empty(F.get_json_object(parsed, "$.reason"))).select("book_id", "page", "v.*", "why_not")
    fit = F.col("is_cover") & ~F.isnan("score") & (F.col("score") > -1)
    top = judged.where(fit).groupBy("book_id").agg(F.max_by(F.struct("page", "why_not"), F.struct("score", -F.col("page"))).alias("t"))
    single = alone.join(top, "book_id", "left").select("book_id", F.coalesce("t.page", F.lit(1)).alias("cover_page"), F.coalesce("t.why_not", F.when(F.col("why") != "", F.col("why")).otherwise(none)).alias("reason"))
    return single if settled is None else settled.unionByName(single)
