"""Pages as given: each once, with null flags as no and null lists as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_pages(pages: DataFrame) -> DataFrame:
    """One row a ``result_id``: of repeats the earliest received. Flags and lists are never null."""
    first = pages.dropDuplicates(["result_id"])
    fields = dict(first.dtypes)
    lists = [c for c in ("blocks", "notes", "illustrations") if c in fields]
    flags = [c for c in ("page_continues_previous", "has_illustrations") if c in fields]
    return first.withColumns(
        {c: F.coalesce(c, F.array().cast(fields[c])) for c in lists} | {c: F.coalesce(c, F.lit(False)) for c in flags}
    )
