"""Session helpers shared by every operator: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Largest estimated size, in bytes, that an operator may broadcast; beyond it the shuffle form is used.
BROADCAST_BYTES = 64 * 1024 * 1024


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where it lies, whatever the working directory. On a cluster without
    a shared file system the package goes with ``--py-files``."""
    home = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
    return spark


def build_session(app: str = "pagemill", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow)."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (local tests) a temporary folder is chosen and set.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; executors need a shared folder")
        where = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", where)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


_open_stages: list[list[str]] = []


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """The tables that :func:`written` makes within this scope are deleted at its end, through Spark's file system.

    For jobs that save their result inside the scope; a query that returns a table keeps its stages, which the table
    still reads, until the application's :func:`drop_stages`."""
    _open_stages.append([])
    try:
        yield
    finally:
        drop_paths(spark, _open_stages.pop())


def drop_stages(spark: SparkSession) -> int:
    """Deletes every table this application wrote outside a scope; returns their number."""
    n = len(_loose_stages)
    drop_paths(spark, _loose_stages)
    _loose_stages.clear()
    return n


_loose_stages: list[str] = []


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written as a parquet table in the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}.parquet"
    (_open_stages[-1] if _open_stages else _loose_stages).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where Catalyst's size estimate proves ``df`` small; otherwise AQE shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def checked_small(df: DataFrame, label: str = "small", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written to the shared folder, then hinted for broadcast if the written size allows it.

    Parquet is compressed, so the limit is held against eight times the file size."""
    return broadcast_if_small(written(df, label), limit // 8)


#: Parts into which the rows of one key are cut where a join with the key's one row would gather them.
KEY_PARTS = 64


def join_key_row(rows: DataFrame, small: DataFrame, key: str, spread: list[str], label: str = "small", how: str = "inner") -> DataFrame:
    """``rows`` with the one row of their ``key`` in ``small``: by broadcast if the written size allows it, else over
    KEY_PARTS parts of each key, told by a hash of ``spread``, so that a key with any share of the rows is no hot key."""
    from pyspark.sql import functions as F

    held = written(small, label)
    if estimated_bytes(held) <= BROADCAST_BYTES // 8:
        return rows.join(F.broadcast(held), key, how)
    parts = held.withColumn("_part", F.explode(F.array(*map(F.lit, range(KEY_PARTS)))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(KEY_PARTS)).cast("int")).join(parts, [key, "_part"], how).drop("_part")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; of a written table the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started in this scope carry ``tag``; :func:`cancel` ends them from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def table_names(root: str) -> list[str]:
    return sorted(x[: -len(".parquet")] for x in os.listdir(root) if x.endswith(".parquet"))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


Query = Callable[[SparkSession, str], DataFrame]


def merged(parts: Iterable[dict]) -> dict:
    """Union of registries; a name may stand in one only."""
    out: dict = {}
    for part in parts:
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"defined twice: {sorted(clash)}")
        out |= part
    return out
