"""Messages, measured in tokens, placed in containers of fixed capacity.

Linear grouping: large pieces are grouped by size into groups of equal cardinality and rounded up to their group's
largest size, which leaves few sizes; configurations of these sizes are optimised on counts alone; actual pieces then
take the slots of their group, and small pieces fill what is left by best fit. Sizes are whole tokens, so the driver
only ever sees a histogram of at most one row per token count up to the capacity. Slots are given by arithmetic from a
piece's number within its group; numbers come from shards of bounded size, and best fit runs in shards, so no group is
gathered whole. Only a message larger than the container is split.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.runtime import written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Groups of large sizes; a piece above this share of the capacity is large.
GROUPS, SMALL = 200, 1 / 16
#: Pieces numbered, or packed by best fit, in one task.
SHARD = 40_000
#: Distinct word pieces whose token count a task remembers.
CACHE = 500_000

# The split pattern of the byte-level vocabularies, and its equal over characters below U+0100.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = re.compile(r"[ ]?[a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[ ]?[0-9²³¹¼-¾]+|'(?:[stmd]|re|ve|ll)|[ ]?[^\s0-9a-zA-Zªµº²³¹¼-¾\xc0-\xd6\xd8-\xf6\xf8-\xff]+|\s+(?!\S)|\s+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")


class TokenCounter(dict):
    """Token counts of texts; the counts of word pieces are kept up to a bound."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) < CACHE:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if BEYOND_LATIN.search(text):
            return len(self.encode(text))
        return sum(map(self.__getitem__, LATIN.findall(text)))


def token_counts(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every message once; null and empty texts have no tokens. The vocabulary file has a fixed size."""
    data = docs.sparkSession.sparkContext.broadcast(Path(tokenizers, vocabulary).read_bytes())
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(counter.count, batch.column(1).to_pylist()), pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, tokens bigint").dropDuplicates(["doc_id"])


def group_limits(histogram: dict[int, int], groups: int = GROUPS) -> list[tuple[int, int]]:
    """(largest size, count) of groups of nearly equal cardinality; pieces of one size stay together."""
    total, out, have = sum(histogram.values()), [], 0
    taken = 0
    for size in sorted(histogram):
        have += histogram[size]
        if (taken + have) * groups >= total * (len(out) + 1) or size == max(histogram):
            out.append((size, have))
            taken += have
            have = 0
    return [x for x in out if x[1]]


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """[(pieces taken of each group, containers filled so)], using up every group exactly.

    Column by column: the fullest configuration that the remaining counts allow is found by a bounded knapsack over
    the few sizes, and used as often as the counts allow. Every use leaves some size with fewer pieces than one
    configuration takes, and a size takes at most capacity / size pieces, so rounds are bounded by the groups alone.
    """
    sizes, left = [s for s, _ in groups], [n for _, n in groups]
    out: list[tuple[list[int], int]] = []
    while any(left):
        take = _fullest(sizes, left, capacity)
        times = min(left[i] // t for i, t in enumerate(take) if t)
        out.append((take, times))
        left = [n - t * times for n, t in zip(left, take)]
    return out


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """The counts that fill most of the capacity; the largest remaining size is always part of it."""
    first = max(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    layers = []
    for i in range(len(sizes) - 1, -1, -1):
        n = min(left[i] - (i == first), room // sizes[i])
        steps = [reach]
        power = 1
        while n > 0:  # bounded counts as powers of two
            k = min(power, n)
            shift = k * sizes[i]
            if shift > room:
                break
            nxt = steps[-1].copy()
            nxt[shift:] |= steps[-1][: room + 1 - shift]
            layers.append((i, k, steps[-1]))
            steps.append(nxt)
            n -= k
            power *= 2
        reach = steps[-1]
    at = int(np.flatnonzero(reach)[-1])
    take = [0] * len(sizes)
    take[first] = 1
    for i, k, before in reversed(layers):
        if not before[at]:
            take[i] += k
            at -= k * sizes[i]
    return take


def best_fit(sizes: np.ndarray, residuals: list[tuple[int, str]], capacity: int, name: str) -> list[str]:
    """A container for each size, in the given order: the fullest one that still takes it, else a new one."""
    rooms: dict[int, list[str]] = {}
    mask = 0
    for room, box in residuals:
        rooms.setdefault(room, []).append(box)
        mask |= 1 << room
    out, opened = [], 0
    for size in sizes.tolist():
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            boxes = rooms[room]
            box = boxes.pop()
            if not boxes:
                mask &= ~(1 << room)
        else:
            room, box = capacity, f"{name}-{opened}"
            opened += 1
        room -= size
        rooms.setdefault(room, []).append(box)
        mask |= 1 << room
        out.append(box)
    return out


def pieces(counts: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(capacity_id, capacity, doc_id, piece, start_token, tokens): a message is split only if it exceeds the capacity,
    into full containers and a rest. ``capacities``: (id, tokens)."""
    each = F.array(*(F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(n).cast("bigint").alias("capacity")) for i, n in capacities))
    all_ = counts.where("tokens > 0").select("doc_id", "tokens", F.explode(each).alias("c")).select("doc_id", "tokens", "c.*")
    n = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    return (
        all_.select("capacity_id", "capacity", "doc_id", F.col("tokens").alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
        .withColumn("start_token", F.col("piece") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("capacity"), F.col("whole") - F.col("start_token")))
        .drop("whole")
    )


#: Containers sizes packed in one pass; more take several passes.
CAPACITY_BLOCK = 64


PACKED = ["capacity_id", "capacity", "container", "doc_id", "piece", "start_token", "tokens"]
PACKED_SCHEMA = "capacity_id int, capacity bigint, container string, doc_id bigint, piece int, start_token bigint, tokens bigint"


def pack(counts: DataFrame, capacities: DataFrame, groups: int = GROUPS, small: float = SMALL, shard: int = SHARD) -> DataFrame:
    """:func:`pieces` with their ``container`` (unique within a capacity). Each capacity packs all messages.

    No container exceeds its capacity; every token of every message is placed once; messages without tokens are not
    placed. ``counts``: (doc_id, tokens).
    """
    sizes = sorted({(r.capacity_id, r.tokens) for r in capacities.where("tokens > 0").select("capacity_id", "tokens").toLocalIterator()})
    blocks = [sizes[i : i + CAPACITY_BLOCK] for i in range(0, len(sizes), CAPACITY_BLOCK)] or [[]]
    return reduce(DataFrame.unionByName, (_pack(counts, b, groups, small, shard) for b in blocks))


def _pack(counts: DataFrame, capacities: list[tuple[int, int]], groups: int, small: float, shard: int) -> DataFrame:
    spark: SparkSession = counts.sparkSession
    if not capacities:
        return spark.createDataFrame([], PACKED_SCHEMA)
    tasks = spark.sparkContext.defaultParallelism
    parts = written(pieces(counts.repartition(tasks, "doc_id"), capacities), "pieces")
    full = parts.where("tokens = capacity").withColumn("container", F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")))
    rest = parts.where("tokens < capacity")
    histogram: dict[tuple[int, int], dict[int, int]] = {}
    small_count: dict[int, int] = {}
    for r in rest.groupBy("capacity_id", "capacity", "tokens").count().collect():  # at most one row per size below a capacity
        if r.tokens > small * r.capacity:
            histogram.setdefault((r.capacity_id, r.capacity), {})[r.tokens] = r["count"]
        else:
            small_count[r.capacity_id] = small_count.get(r.capacity_id, 0) + r["count"]
    limits = {key: group_limits(h, groups) for key, h in histogram.items()}
    plans = {key: configurations(g, key[1]) for key, g in limits.items()}

    # The group and, within shards of bounded size, the number of each large piece.
    uppers = {c: np.array([s for s, _ in g]) for (c, _), g in limits.items()}

    @F.pandas_udf("int")
    def group_of(cap: pd.Series, tokens: pd.Series) -> pd.Series:
        out, caps, sizes = np.zeros(len(cap), np.int32), cap.to_numpy(), tokens.to_numpy()
        for c in np.unique(caps):
            rows = caps == c
            out[rows] = np.searchsorted(uppers[int(c)], sizes[rows])
        return pd.Series(out)

    large = rest.where(F.col("tokens") > F.lit(small) * F.col("capacity")).withColumn("grp", group_of("capacity_id", "tokens"))
    n_large = sum(sum(h.values()) for h in histogram.values())
    shards = max(1, math.ceil(n_large / shard))
    large = large.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    per = large.groupBy("capacity_id", "grp", "shard").count()
    before = per.withColumn("base", F.sum("count").over(Window.partitionBy("capacity_id", "grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["base"]).drop("count")
    own = Window.partitionBy("capacity_id", "grp", "shard").orderBy("doc_id", "piece")
    numbered = large.withColumn("k", F.row_number().over(own) - 1).join(before, ["capacity_id", "grp", "shard"]).withColumn("k", F.col("k") + F.col("base"))

    # Slot k of a group: the configuration that holds it, and the container among those that use it.
    slots: dict[tuple[int, int], tuple[list[int], list[int], list[int]]] = {}
    for (cap_id, _), plan in plans.items():
        first_box = 0
        for take, times in plan:
            for g, t in enumerate(take):
                if t:
                    ends, per_box, boxes = slots.setdefault((cap_id, g), ([0], [], []))
                    ends.append(ends[-1] + t * times)
                    per_box.append(t)
                    boxes.append(first_box)
            first_box += times

    @F.pandas_udf("bigint")
    def container_of(cap: pd.Series, grp: pd.Series, k: pd.Series) -> pd.Series:
        out = np.empty(len(k), np.int64)
        for key, rows in pd.DataFrame({"c": cap, "g": grp}).groupby(["c", "g"]).indices.items():
            ends, per_box, boxes = map(np.asarray, slots[tuple(map(int, key))])
            n = k.to_numpy()[rows]
            at = np.searchsorted(ends, n, side="right") - 1
            out[rows] = boxes[at] + (n - ends[at]) // per_box[at]
        return pd.Series(out)

    placed = numbered.withColumn("container", F.concat(F.lit("c-"), container_of("capacity_id", "grp", "k").cast("string"))).select(*PACKED)
    placed = written(placed, "large-placed")

    # Best fit of the small pieces into what the configurations left, in shards that share containers and pieces alike.
    boxes = placed.groupBy("capacity_id", "capacity", "container").agg(F.sum("tokens").alias("used")).withColumn("room", F.col("capacity") - F.col("used")).where("room > 0")
    n_boxes = {c: sum(times for _, times in plan) for (c, _), plan in plans.items()}
    n_shards = {c: max(1, math.ceil(max(small_count.get(c, 0), n_boxes.get(c, 0)) / shard)) for c in small_count.keys() | n_boxes.keys()}
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (n_shards or {-1: 1}).items() for x in kv]), F.col("capacity_id")), F.lit(1))
    tail = rest.where(F.col("tokens") <= F.lit(small) * F.col("capacity"))
    both = tail.select("capacity_id", "capacity", F.lit(None).cast("string").alias("container"), "doc_id", "piece", "start_token", "tokens", F.pmod(F.xxhash64("doc_id", "piece"), count).cast("int").alias("shard")).unionByName(
        boxes.select("capacity_id", "capacity", "container", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("bigint").alias("start_token"), F.col("room").alias("tokens"), F.pmod(F.xxhash64("container"), count).cast("int").alias("shard")))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        open_ = part[part.doc_id.isna()].sort_values("container")
        items = part[~part.doc_id.isna()].sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True])
        if not len(items):
            return items[PACKED]
        cap, sh = int(part.capacity.iloc[0]), int(part["shard"].iloc[0])
        names = best_fit(items.tokens.to_numpy(), list(zip(open_.tokens.tolist(), open_.container.tolist())), cap, f"s-{sh}")
        return items.assign(container=names)[PACKED]

    filled = both.groupBy("capacity_id", "shard").applyInPandas(fill, PACKED_SCHEMA)
    return full.select(*PACKED).unionByName(placed).unionByName(filled)


def fill_rates(packed: DataFrame) -> DataFrame:
    """(capacity_id, capacity, containers, pieces, tokens, least, fill): ``least`` containers are needed at any rate."""
    per = packed.groupBy("capacity_id", "capacity", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    out = per.groupBy("capacity_id", "capacity").agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"))
    return out.withColumns({"least": F.ceil(F.col("tokens") / F.col("capacity")), "fill": F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)})
