"""Retries of page requests as a fold over an attempts table, and rounds that feed on it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Target codes that are no pages: the cover, the contents, the contents after three attempts.
COVER, CONTENTS, CONTENTS_LATE = 0, -1, -2
AUTO_RETRIES = 3


def decision(code: Column, attempt: Column, auto: int = AUTO_RETRIES, cancelled: Column | None = None) -> Column:
    """``retry`` while attempts are left, else ``ask``; late contents always ask; cancelled work is abandoned."""
    base = F.when((code != CONTENTS_LATE) & (attempt <= auto), "retry").otherwise("ask")
    return base if cancelled is None else F.when(cancelled, "abandon").otherwise(base)


@dataclass(frozen=True)
class State:
    """What a page's next request depends on."""

    attempt: int = 1
    previous_invalid: str | None = None
    corrected: frozenset[str] = frozenset()
    backed_up: frozenset[str] = frozenset()
    error: str = ""
    response: str = ""
    repetitions: int = 0
    exclusive: bool = False
    jitter: int = 0
    temperature: float = 0.0
    outcome: str = ""  # accepted, backup, raised, asked


@dataclass(frozen=True)
class Event:
    """One attempt's end: ok, invalid_json, repetition, fatal_vision or other."""

    kind: str
    response: str = ""
    message: str = ""
    finish_reason: str = ""
    correction_ok: bool = False
    backup_ok: bool = False


def step(state: State, event: Event, workers: int = 4, auto: int = AUTO_RETRIES, code: int = 1) -> State:
    """The state after an attempt. Once there is an outcome it stays."""
    if state.outcome:
        return state
    if event.kind == "ok":
        return replace(state, outcome="accepted")
    if event.kind == "fatal_vision":
        return replace(state, error=event.message, outcome="raised")
    if event.kind == "invalid_json":
        state = replace(state, repetitions=0)
        whole = event.finish_reason not in ("length", "max_tokens")
        if event.response and whole and event.response not in state.corrected:
            if event.correction_ok:
                return replace(state, outcome="accepted")
            state = replace(state, corrected=state.corrected | {event.response})
        if event.response == state.previous_invalid and whole and event.response not in state.backed_up:
            if event.backup_ok:
                return replace(state, outcome="backup")
            state = replace(state, backed_up=state.backed_up | {event.response})
        state = replace(state, previous_invalid=event.response, error=event.message, response=event.response)
    elif event.kind == "repetition":
        n = state.repetitions + 1
        state = replace(state, repetitions=n, error="", response="", exclusive=workers > 1, jitter=n, temperature=0.1 if n >= 3 else 0.0)
    else:
        state = replace(state, error=event.message, response=event.response)
    if code != CONTENTS_LATE and state.attempt <= auto:
        return replace(state, attempt=state.attempt + 1)
    return replace(state, outcome="asked")


def history(attempts: DataFrame, auto: int = AUTO_RETRIES) -> DataFrame:
    """(target, attempts, outcome, last_kind) from rows (target, seq, kind). The fold runs inside one expression; a
    target has at most ``auto`` + 1 attempts before someone is asked."""
    rows = attempts.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("all"))
    start = F.struct(F.lit(1).alias("attempt"), F.lit("").alias("outcome"), F.lit("").alias("last"))

    def fold(acc: Column, x: Column) -> Column:
        ended = acc["outcome"] != ""
        outcome = F.when(ended, acc["outcome"]).when(x["kind"] == "ok", "accepted").when(x["kind"] == "fatal_vision", "raised").when(acc["attempt"] > auto, "asked").otherwise("")
        return F.struct(
            F.when(ended | (outcome != ""), acc["attempt"]).otherwise(acc["attempt"] + 1).alias("attempt"), outcome.alias("outcome"),
            F.when(ended, acc["last"]).otherwise(x["kind"]).alias("last"))

    return rows.select("target", F.aggregate("all", start, fold).alias("s")).select("target", F.col("s.attempt").alias("attempts"), F.when(F.col("s.outcome") == "", "open").otherwise(F.col("s.outcome")).alias("outcome"), F.col("s.last").alias("last_kind"))


def jitter_box(path: Column, page: Column, retry: Column) -> Column:
    """Pixels cut off each side of a retried image, 1 to 4, from the checksum of path, page and retry."""
    seed = F.crc32(F.concat_ws(":", path, page.cast("string"), retry.cast("string")))
    side = lambda shift: (F.lit(1) + F.shiftright(seed, shift) % 4).cast("int")
    return F.struct(side(0).alias("left"), side(4).alias("top"), side(8).alias("right"), side(12).alias("bottom"))
