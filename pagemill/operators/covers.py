"""Choosing the cover page of each book from verdicts on its first pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages looked at.
SCAN_PAGES = 5


def verdict(reply: Column) -> Column:
    """A reply in JSON as (is_cover, score): the quality, else the score, else 1 or 0 by the flag. Broken JSON: no cover."""
    flag = F.lower(F.get_json_object(reply, "$.is_cover"))
    is_cover = F.coalesce(flag.isin("1", "true", "yes", "y", "on"), F.lit(False))
    score = F.coalesce(F.get_json_object(reply, "$.cover_quality").try_cast("double"), F.get_json_object(reply, "$.score").try_cast("double"), F.when(is_cover, 1.0).otherwise(0.0))
    return F.struct(is_cover.alias("is_cover"), score.alias("score"))


def chosen_page(reply: Column, pages: int) -> Column:
    """The page named by one reply on several pages, kept within them; 1 where it names none."""
    return F.greatest(F.lit(1), F.least(F.lit(pages), F.coalesce(F.get_json_object(reply, "$.cover_page").try_cast("int"), F.lit(1))))


def verdicts_by_role(pages: DataFrame) -> DataFrame:
    """Verdicts without a model: covers and front matter are covers, scored by role; a cover without time has no score."""
    nan = F.lit(float("nan"))
    score = F.when((F.col("page_role") == "cover") & F.col("seconds").isNull(), nan).when(F.col("page_role") == "cover", 1.0).otherwise(0.5)
    return pages.select("book_id", "page", F.coalesce(F.col("page_role").isin("cover", "front_matter"), F.lit(False)).alias("is_cover"), score.alias("score"))


def best(verdicts: DataFrame, scan: int = SCAN_PAGES) -> DataFrame:
    """(book_id, cover_page): of the first pages that are covers the one with the highest score, the earliest of ties.

    NaN never wins; a book without cover gets page 1. A plain aggregation with map-side combination.
    """
    fit = F.col("is_cover") & (F.col("page") <= max(1, scan)) & ~F.isnan("score") & (F.col("score") > -1)
    top = F.max(F.when(fit, F.struct(F.col("score"), -F.col("page"))))
    return verdicts.groupBy("book_id").agg(top.alias("t")).select("book_id", F.coalesce(-F.col("t.col2"), F.lit(1)).alias("cover_page"))
