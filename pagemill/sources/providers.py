"""Model access behind one interface. Replay reads recorded replies; HTTP calls an endpoint, a client a partition."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx

KEYS = ["book_id", "page", "attempt"]
REPLY = "response_text string, finish_reason string, error string, seconds double, usage map<string,bigint>"
REPLY_COLUMNS = [c.split()[0] for c in REPLY.split(", ")]
#: Least tokens a page's reply may have, and the highest temperature it is asked at.
LEAST_TOKENS, HOTTEST = 512, 0.3
#: Tokens of a corrected page and of a cover verdict at most.
CORRECTION_TOKENS, COVER_TOKENS = 8192, 300


def max_tokens(configured: int | None) -> int:
    return max(LEAST_TOKENS, int(configured or 65536))


def temperature(value: float | None) -> float:
    return max(0.0, min(HOTTEST, float(value or 0)))


class ChatModel(Protocol):
    def answer(self, requests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        """Requests (keys, prompt; optionally images array<string>, temperature) to replies (keys, columns of REPLY)."""

    def exclusive(self) -> ChatModel:
        """The same model, asked one request at a time."""


@dataclass(frozen=True)
class Replay:
    """Recorded replies; a request without record gets an error, so that runs are the same every time."""

    recorded: DataFrame

    def answer(self, requests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        have = self.recorded.columns
        own = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
        fields = [f.split(" ", 1) for f in REPLY.split(", ")]
        kinds = dict(requests.dtypes)
        # Records that lack a key answer no request by it.
        r = self.recorded.select(*(own(k, kinds[k]).alias(k) for k in keys), *(own(c, kind).alias(c) for c, kind in fields), F.lit(True).alias("_found"))
        out = requests.select(*keys).join(r, keys, "left")
        return out.withColumn("error", F.when(F.col("_found").isNull(), "no recorded reply").otherwise(F.col("error"))).select(*keys, *REPLY_COLUMNS)

    def exclusive(self) -> Replay:
        return self


def base_url(url: str) -> str:
    """An endpoint without its trailing slash, ending in the version path."""
    url = url.strip().rstrip("/")
    return url if url.endswith("/v1") else url + "/v1"


def failure_text(error: Exception, longest_side: int | None = None) -> str:
    """What a failed call says, with the server's own words; failures to prepare images are labelled as such."""
    if isinstance(error, urllib.error.HTTPError):
        detail = error.read().decode("utf-8", "replace")
        if is_vision_failure(detail):
            return f"vision preprocessing failed: HTTP {error.code}; longest image side {longest_side or 'unlimited'}\n{detail}"
        return f"request failed: HTTP {error.code}\n{detail}"
    if isinstance(error, urllib.error.URLError):
        return f"request failed: {error.reason}"
    return f"{type(error).__name__}: {error}"


def is_vision_failure(detail: str) -> bool:
    from pagemill.operators import replies

    return any(x in detail for x in replies.VISION_FAILURES) or all(x in detail for x in replies.FAILED_IMAGES)


def read_stream(lines: Iterator[bytes]) -> tuple[str, str, dict, str]:
    """(text, finish reason, usage, reason it is stuck) of a streamed reply; reading ends where the stream is stuck."""
    from pagemill.streaming import repetition

    text, finish, usage, blank = "", "", {}, True
    for raw in lines:
        line = raw.decode("utf-8", "replace").strip()
        if not line.startswith("data:"):
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            break
        event = json.loads(data)
        usage = event.get("usage") or usage
        choice = (event.get("choices") or [{}])[0]
        finish = str(choice.get("finish_reason") or finish)
        if delta := (choice.get("delta") or {}).get("content") or "":
            text += delta
            blank = blank and not delta.strip()
            if stuck := repetition.reason_of(len(text), blank, text[-repetition.TAIL :]):
                return text, "repetition", usage, stuck
    return text, finish, usage, ""


@dataclass(frozen=True)
class Http:
    """An OpenAI-compatible endpoint. Failures become rows with an error, never failed tasks. Without ``model`` the first
    one the endpoint lists is used; with ``stream`` replies are read as they come and left where they are stuck."""

    url: str
    model: str = ""
    max_tokens: int = 65536
    timeout: int = 180
    temperature: float = 0.0
    parallel: int = 4
    stream: bool = False
    longest_side: int | None = None

    def exclusive(self) -> Http:
        return replace(self, parallel=1)

    def resolved(self) -> str:
        """The model's name, or the first the endpoint lists."""
        if self.model:
            return self.model
        with urllib.request.urlopen(base_url(self.url) + "/models", timeout=min(self.timeout, 30)) as got:
            listed = json.load(got).get("data") or []
        if not listed or not listed[0].get("id"):
            raise RuntimeError(f"{base_url(self.url)}/models lists no model")
        return listed[0]["id"]

    def call(self, model: str, prompt: str, images: list[str], heat: float) -> tuple:
        """One request's columns of REPLY."""
        content = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": x}} for x in images)] if images else prompt
        body = {"model": model, "temperature": heat, "max_tokens": max_tokens(self.max_tokens), "stream": self.stream, "messages": [{"role": "user", "content": content}]}
        began = time.monotonic()
        try:
            request = urllib.request.Request(base_url(self.url) + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as got:
                if self.stream:
                    text, finish, usage, stuck = read_stream(got)
                    error = f"stuck: repeats ({stuck})" if stuck else None
                else:
                    data = json.load(got)
                    choice = (data.get("choices") or [{}])[0]
                    text, finish, usage, error = (choice.get("message") or {}).get("content") or "", choice.get("finish_reason"), data.get("usage") or {}, None
            counts = {k: int(v) for k, v in usage.items() if isinstance(v, (int, float))}
            return text, finish, error, time.monotonic() - began, counts
        except Exception as e:  # any failure of the endpoint is a row
            return None, None, failure_text(e, self.longest_side)[:4000], time.monotonic() - began, None

    def answer(self, requests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        own, names = self, [*keys, *REPLY_COLUMNS]
        has = set(requests.columns)
        rows = requests.select(*keys, "prompt", F.col("images").alias("images") if "images" in has else F.array().cast("array<string>").alias("images"), F.col("temperature").cast("double").alias("temperature") if "temperature" in has else F.lit(self.temperature).alias("temperature"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = ""
            for part in batches:
                out = []
                for r in part.to_dict("records"):
                    try:
                        model = model or own.resolved()
                        got = own.call(model, r["prompt"], [x for x in (r["images"] if r["images"] is not None else [])], temperature(r["temperature"]))
                    except Exception as e:
                        got = (None, None, failure_text(e)[:4000], 0.0, None)
                    out.append((*(r[k] for k in keys), *got))
                yield pd.DataFrame(out, columns=names)

        kinds = dict(requests.dtypes)
        return rows.repartition(self.parallel).mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), REPLY]))


# ---- requests: the wording is our own -------------------------------------------------------------------------------

PAGE_PROMPT = (
    "Read this scanned page and answer with one JSON object: text, page_continues_previous, page_role, title, blocks "
    "(type, level, text, continued_from_previous, note_markers), has_illustrations, illustrations (bbox, caption, "
    "insert_after), notes (marker, type, text, anchor)."
)
SHORT_PAGE_PROMPT = "Read this scanned page. Answer with JSON: text, page_role, title, page_continues_previous, blocks, notes, illustrations."
SIMPLIFIED_PROMPT = "Write Chinese in simplified characters."
COVER_PROMPT = 'Is this page the front cover of the book? Answer with JSON: {"is_cover": true or false, "cover_quality": 0 to 1, "reason": ""}.'
COVERS_PROMPT = 'Which of these pages, counted from 1, is the front cover? Answer with JSON: {"cover_page": 1, "reason": ""}.'
CONTENTS_PROMPT = (
    "These are headings found in a book. Choose those that belong into its contents, give each a label and a level from 1 to 4, "
    'and answer with JSON only: {"items": [{"page": 1, "block_index": 0, "label": "", "level": 1, "reason": ""}]}. Add nothing that is not listed.'
)
REPAIR_PROMPT = (
    "Some pages below may be wrong in the ways described. Answer with JSON only: "
    '{"repairs": [{"page": 1, "set_title": "", "set_page_continues_previous": false, "delete_block_indices": [], '
    '"set_block_continued_from_previous": [{"block_index": 0, "value": true}], "replace_notes": [], "add_notes": [], "reason": ""}]}.'
)
CORRECTION_PROMPT = "The reply below is not valid JSON. Write the same content as one valid JSON object and nothing else."
#: Characters quoted of an error, and of a failed contents reply.
QUOTED_ERROR, QUOTED_REPLY = 2000, 24000


def page_prompt(simplified: bool = False, illustrations: bool = True, short: bool = False) -> str:
    """The request for a page."""
    parts = [SHORT_PAGE_PROMPT if short else PAGE_PROMPT]
    if not illustrations:
        parts.append("Leave illustrations empty.")
    if simplified:
        parts.append(SIMPLIFIED_PROMPT)
    return "\n".join(parts)


def retry_prompt(base: str, error, previous):
    """The request again, with what was wrong and the start of the reply that was."""
    return F.concat_ws("\n", F.lit(base), F.concat(F.lit("The last reply could not be used: "), F.substring(error, 1, QUOTED_ERROR)), F.concat(F.lit("It was: "), tx.compact_reply(previous)))


def correction_prompt(error: Column, previous: Column) -> Column:
    """A request for the same page as valid JSON, made of text alone."""
    return F.concat_ws("\n", F.lit(CORRECTION_PROMPT), F.concat(F.lit("Error: "), F.substring(error, 1, QUOTED_ERROR)), F.concat(F.lit("Reply: "), tx.text_or_empty(previous)))


def contents_prompt(candidates: Column, chunk: Column, chunks: Column) -> Column:
    """The request for a chunk of heading candidates, given as JSON."""
    part = F.when(chunks > 1, F.concat(F.lit("Part "), (chunk + 1).cast("string"), F.lit(" of "), chunks.cast("string"), F.lit("; choose from this part alone.")))
    return F.concat_ws("\n", F.lit(CONTENTS_PROMPT), part, F.concat(F.lit("Headings: "), candidates))


def contents_correction_prompt(candidates: Column, error: Column, previous: Column) -> Column:
    return F.concat_ws("\n", F.lit(CORRECTION_PROMPT), F.lit(CONTENTS_PROMPT), F.concat(F.lit("Headings: "), candidates), F.concat(F.lit("Error: "), F.substring(error, 1, QUOTED_ERROR)), F.concat(F.lit("Reply: "), F.substring(tx.text_or_empty(previous), 1, QUOTED_REPLY)))


def page_for_repair() -> Column:
    """A page as a repair request shows it, as JSON: its flags, numbered blocks and notes."""
    blocks = F.transform("blocks", lambda b, i: F.struct(i.alias("index"), F.coalesce(b["type"], F.lit("paragraph")).alias("type"), F.coalesce(b["level"], F.lit(0)).alias("level"), tx.text_or_empty(b["text"]).alias("text"), F.coalesce(b["continued_from_previous"], F.lit(False)).alias("continued_from_previous"), F.coalesce(b["note_markers"], F.array().cast("array<string>")).alias("note_markers")))
    return F.to_json(F.struct(F.coalesce("page", F.lit(0)).alias("page"), tx.text_or_empty(F.col("title")).alias("title"), F.coalesce(F.nullif("page_role", F.lit("")), F.lit("unknown")).alias("page_role"), F.coalesce("page_continues_previous", F.lit(False)).alias("page_continues_previous"), blocks.alias("blocks"), F.col("notes")))


def repair_prompt(pages_json: Column, risks: Column) -> Column:
    """The request to repair pages (an array of :func:`page_for_repair`) with the risks seen in them."""
    return F.concat(F.lit(REPAIR_PROMPT), F.lit('\n{"risk_summary":'), F.coalesce(risks, F.lit("null")), F.lit(',"pages":['), F.array_join(pages_json, ","), F.lit("]}"))
