"""Streams of tokens that are stuck: one rule set as an expression, over batches, and over a stream with small state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions import text as tx

#: Characters of the end that are looked at; least length to judge white space, the text, and its end.
TAIL, ALL_BLANK, LEAST, STUCK = 1024, 64, 256, 128
#: At most so many different characters make a short cycle suspicious.
FEW_SIGNS = 3
# Signs passed over, and units that tell a stuck stream.
FILLER = r"[\"'`,，\[\]{}:：]+"
UNITS = ("/n", "\\n", "/N", "\\N")


def reason(text: Column) -> Column:
    """``blank`` or ``cycle`` where the text so far is stuck, else empty. Null is not stuck.

    What decides is cut out in generated code: the length, whether all is blank, and the last TAIL characters; only these
    go to Python, where a batch is judged by :func:`reason_of`."""
    t = tx.text_or_empty(text)

    @F.pandas_udf("string")
    def judged(length: pd.Series, blank: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series([reason_of(n, b, x) for n, b, x in zip(length.tolist(), blank.tolist(), tail.tolist())], dtype=object)

    return judged(F.length(t), ~t.rlike(rf"[^{tx.WS[1:]}"), F.right(t, F.lit(TAIL)))


def reason_of(length: int, all_blank: bool, tail: str) -> str:
    """:func:`reason` from what a stream keeps: length so far, whether all was blank, and the last TAIL characters."""
    if length >= ALL_BLANK and all_blank:
        return "blank"
    if length < LEAST:
        return ""
    if len(tail) >= STUCK and not tail.strip():
        return "blank"
    compact = "".join(tail.split())
    if len(compact) < STUCK:
        return ""
    bare = re.sub(FILLER, "", compact)
    for c in (compact, bare):
        if len(c) >= STUCK and any(c == u * (len(c) // 2) for u in UNITS):
            return "cycle"
        if len(set(c)) <= FEW_SIGNS and any(len(c) % k == 0 and c and c == c[:k] * (len(c) // k) for k in range(1, 9)):
            return "cycle"
    return ""


OUTPUT = "book_id string, page int, attempt int, seq bigint, forwarded boolean, reason string"
STATE = "length bigint, all_blank boolean, tail string, stuck boolean"


def watch(deltas: DataFrame) -> DataFrame:
    """A stream of (book_id, page, attempt, seq, delta) as (…, forwarded, reason): the delta that trips the rules and all
    after it are not forwarded. State a request: two numbers, a flag and TAIL characters."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, all_blank, tail, stuck = state.get if state.exists else (0, True, "", False)
        for rows in batches:
            out = []
            for seq, delta in rows.sort_values("seq")[["seq", "delta"]].itertuples(index=False):
                delta = delta or ""
                why = ""
                if not stuck:
                    length += len(delta)
                    all_blank = all_blank and not delta.strip()
                    tail = (tail + delta)[-TAIL:]
                    why = reason_of(length, all_blank, tail)
                    stuck = why != ""
                out.append((*key, seq, not stuck, why))
            yield pd.DataFrame(out, columns=["book_id", "page", "attempt", "seq", "forwarded", "reason"])
        state.update((int(length), bool(all_blank), tail, bool(stuck)))

    return deltas.groupBy("book_id", "page", "attempt").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
