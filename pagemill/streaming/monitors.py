"""Event-stream decoding and progress monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from pagemill.functions import text as tx
from pagemill.operators import ordered

DELTA = "struct<choices:array<struct<delta:struct<content:string>,finish_reason:string>>,usage:map<string,bigint>>"


def decode_events(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Server-sent event lines (keys, seq, line) as deltas (keys, seq, content, finish_reason, usage).

    Lines without ``data:`` and those that do not parse are passed over; what follows ``[DONE]`` does not count.
    """
    body = F.when(F.col("line").startswith("data:"), tx.strip(F.substring("line", 6, 1 << 30)))
    rows = lines.select(*keys, "seq", body.alias("body")).where("body IS NOT NULL")
    done = rows.where("body = '[DONE]'").groupBy(*keys).agg(F.min("seq").alias("done"))
    kept = rows.join(done, keys, "left").where("body <> '[DONE]' AND (done IS NULL OR seq < done)")
    d = F.from_json("body", DELTA)
    return kept.withColumn("d", d).select(*keys, "seq", F.try_element_at("d.choices", F.lit(1))["delta"]["content"].alias("content"), F.try_element_at("d.choices", F.lit(1))["finish_reason"].alias("finish_reason"), F.col("d.usage").alias("usage"))


def replies(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas joined to one reply a request: text in order, last finish reason, last usage. A request's text is bounded
    by its token limit."""
    ordered_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("seq", "content")))), lambda x: x["content"]), "")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return deltas.groupBy(*keys).agg(ordered_text.alias("text"), last("finish_reason").alias("finish_reason"), last("usage").alias("usage"))


def recent(touches: DataFrame, item: str, seq: str, n: int = 6) -> DataFrame:
    """The ``n`` most recently touched items with their last touch. A top-k: no global sort."""
    return touches.groupBy(item).agg(F.max(seq).alias("last_seq")).orderBy(F.desc("last_seq"), F.desc(item)).limit(n)


def throttled(lines: DataFrame, key: str, order: str, text: str, every: int = 1000, width: int = 180) -> DataFrame:
    """Every ``every``-th non-empty line of a key's output, cut to ``width``; long outputs are counted in stretches."""
    rows = lines.where(F.coalesce(F.trim(text) != "", F.lit(False))).select(key, order, F.substring(F.trim(text), 1, width).alias("message"))
    n = ordered.numbered(rows, key, [order], "n", page=order, size=100_000)
    return n.where(F.col("n") % every == 0)


#: Deltas of a key that one task folds.
FOLD_ROWS = 100_000


def thresholds(deltas: DataFrame, key: str, order: str, chars: str, step: int = 2000) -> DataFrame:
    """(key, order, total): the deltas that are reported. The first report comes when a key's running count reaches
    ``step``; each report raises the mark by one step only, so a large delta is followed by reports that catch up.

    The count of reports up to a row is the least, over the rows up to it, of what the mark allows: at row j at most
    total_j // step reports can have come, and one more a row since. So reports(i) = min(i, min over j <= i of
    total_j // step + (i - j)), a running minimum of total_j // step - j, over stretches like any running value.
    """
    rows = deltas.select(key, order, F.coalesce(F.col(chars), F.lit(0)).cast("bigint").alias("chars"))
    run = ordered.running_sums(rows, key, [order], {"total": F.col("chars"), "i": F.lit(1)}, page=order, size=FOLD_ROWS)
    run = run.withColumn("slack", -(F.floor(F.col("total") / step).cast("bigint") - F.col("i")))
    least = ordered.running_max(run, key, order, {"s": F.col("slack")}, page=order, size=FOLD_ROWS)
    before = F.least(F.lit(0), -F.coalesce("last_s", F.lit(0)))  # least of total_j // step - j over the rows before
    reports = F.least(before, -F.col("slack")) + F.col("i")
    earlier = before + F.col("i") - 1
    return least.where(reports > earlier).select(key, order, "total")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Events by type and time window; over a stream ``late`` is how late an event may come."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


class Progress(StreamingQueryListener):
    """Rows read and batches done of every running stream, by query id, for reports while a job runs."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows[str(event.id)] = self.batches[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.batches[str(p.id)] = p.batchId + 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception or ""


def page_progress(results: DataFrame, requests: DataFrame) -> DataFrame:
    """(book_id, pages, done, chars, seconds): how far every book is."""
    done = results.groupBy("book_id").agg(F.count("*").alias("done"), F.sum(F.length(tx.text_or_empty(F.col("text")))).alias("chars"), F.sum("seconds").alias("seconds"))
    return requests.groupBy("book_id").agg(F.count("*").alias("pages")).join(done, "book_id", "left").fillna(0, ["done", "chars"]).fillna(0.0, ["seconds"])
