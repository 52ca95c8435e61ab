"""Resuming a partly finished book: what is cached, what is missing, which result of a page counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx

#: Roles whose pages may be without text; missing pages named in a report.
TEXTLESS_ROLES = ("blank", "cover", "copyright")
REPORTED = 20


def status(pages: DataFrame) -> DataFrame:
    """Pages with ``status`` ok or unusable: without text and illustrations only some roles are usable."""
    usable = (tx.strip(tx.text_or_empty(F.col("text"))) != "") | (F.size("illustrations") > 0) | F.coalesce(F.col("page_role"), F.lit("unknown")).isin(*TEXTLESS_ROLES)
    return pages.withColumn("status", F.when(usable, "ok").otherwise("unusable"))


def missing_pages(books: DataFrame, results: DataFrame) -> DataFrame:
    """(book_id, page) of every page 1 to page_count without result. Null page_count: none known."""
    every = books.where("page_count > 0").select("book_id", "page_count").distinct().select("book_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    return every.distinct().join(results.select("book_id", "page"), ["book_id", "page"], "left_anti")


def missing_report(missing: DataFrame, first: int = REPORTED) -> DataFrame:
    """(book_id, n_missing, first_missing): the first pages are found without gathering all of a book's."""
    from pyspark.sql.window import Window

    n = missing.groupBy("book_id").agg(F.count("*").alias("n_missing"))
    part = missing.withColumn("_s", F.floor(F.col("page") / 1024))
    near = part.withColumn("_r", F.row_number().over(Window.partitionBy("book_id", "_s").orderBy("page"))).where(F.col("_r") <= first)
    per = near.groupBy("book_id", "_s").agg(F.array_sort(F.collect_list("page")).alias("p"))
    few = per.withColumn("_r", F.row_number().over(Window.partitionBy("book_id").orderBy("_s"))).where(F.col("_r") <= first)
    best = few.groupBy("book_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, first).alias("first_missing"))
    return n.join(best, "book_id")


def newest(cached: DataFrame, new: DataFrame) -> DataFrame:
    """One result a page: new over cached, then the later id."""
    both = cached.unionByName(new)
    rest = [c for c in both.columns if c not in ("book_id", "page")]
    return both.groupBy("book_id", "page").agg(F.max(F.struct("is_new", *(c for c in rest if c != "is_new"))).alias("b")).select("book_id", "page", *(F.col(f"b.{c}").alias(c) for c in rest))


def repoint(results: DataFrame, images: DataFrame) -> DataFrame:
    """Results with the path of the image at hand, where there is one."""
    return results.join(images, ["book_id", "page"], "left").withColumn("image_path", F.coalesce("path", "image_path")).drop("path")


def find_cache(caches: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, cache_id, class): the cache of each book by fingerprint (class 0), else by source path (1); of several
    the least id. Two equi-joins instead of one with OR. Unreadable caches match nothing."""
    k = caches.where(F.try_parse_json("cache_json").isNotNull()).select("cache_id", F.get_json_object("cache_json", "$.pdf_fingerprint").alias("pdf_fingerprint"), F.get_json_object("cache_json", "$.source_pdf").alias("source_pdf")).distinct()
    b = books.select("book_id", "pdf_fingerprint", "source_pdf").distinct()
    by_print = b.join(k.select("cache_id", "pdf_fingerprint"), "pdf_fingerprint").select("book_id", F.lit(0).alias("class"), "cache_id")
    by_path = b.join(k.select("cache_id", "source_pdf"), "source_pdf").select("book_id", F.lit(1).alias("class"), "cache_id")
    return by_print.unionByName(by_path).groupBy("book_id").agg(F.min(F.struct("class", "cache_id")).alias("m")).select("book_id", "m.cache_id", "m.class")


def loaded_state(caches: DataFrame, images: DataFrame, allow_partial: bool = False) -> DataFrame:
    """(book_id, page, image_path, result, status, message): the saved results of every cache (book_id, results
    array<struct<page, image_path, ...>>) pointed to the images at hand (book_id, page, path).

    Without ``allow_partial`` a cache whose results are not as many as its book's images is an error: it gives one row with
    status ``count_mismatch`` and no result. A cache without results gives none.
    """
    n = images.groupBy("book_id").agg(F.count("*").alias("_n"))
    rows = caches.join(n, "book_id", "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_have": F.coalesce(F.size("results"), F.lit(0))})
    bad = F.lit(False) if allow_partial else F.col("_have") != F.col("_n")
    wrong = rows.where(bad).select("book_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("image_path"), F.get("results", F.lit(-1)).alias("result"), F.lit("count_mismatch").alias("status"), F.concat(F.lit("saved state has "), F.col("_have").cast("string"), F.lit(" pages, the document "), F.col("_n").cast("string")).alias("message"))
    each = rows.where(~bad).select("book_id", F.explode("results").alias("result")).withColumn("page", F.col("result.page").cast("int"))
    good = each.join(images.select("book_id", "page", "path"), ["book_id", "page"], "left").select("book_id", "page", F.coalesce("path", "result.image_path").alias("image_path"), "result", F.lit("ok").alias("status"), F.lit("").alias("message"))
    return good.unionByName(wrong)


def to_migrate(old: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """Saved states of an older root (path within it, content) that the present root does not have."""
    return old.join(new.select(path), path, "left_anti")
