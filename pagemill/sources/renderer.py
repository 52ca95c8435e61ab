"""Page images of documents, behind one interface: recorded folders, read through Spark, or a renderer on the workers."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import ordered

#: Endings of page images.
IMAGES = r"(?i)\.(?:jpe?g|png)\z"


class Renderer(Protocol):
    def images(self, spark: SparkSession, documents: DataFrame) -> DataFrame:
        """Documents (book_id, path) to images (book_id, name, data)."""


@dataclass(frozen=True)
class Folder:
    """Images of an earlier run: ``folder/<book_id>/<name>``, on any file system Spark reads."""

    folder: str

    def images(self, spark: SparkSession, documents: DataFrame) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        part = lambda i: F.element_at(F.split(F.col("path"), "/"), i)
        rows = found.where(F.col("path").rlike(IMAGES)).select(part(-2).alias("book_id"), part(-1).alias("name"), F.col("content").alias("data"))
        return rows.join(documents.select("book_id").distinct(), "book_id", "left_semi")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def numbered_images(images: DataFrame, name: str = "name", drop_covers: bool = False) -> DataFrame:
    """Images with ``page``, 1 to n within their book in natural order of their names, and ``file``, their name by that
    number. With ``drop_covers`` images named as covers are left out before. Equal names get numbers of their own."""
    rows = images.where(~F.lower(file_name(F.col(name))).startswith("cover")) if drop_covers else images
    rows = rows.withColumn("_key", tx.natural_key(file_name(F.col(name))))
    rows = ordered.numbered_by(rows, "book_id", ["_key", name], F.coalesce(F.nullif(F.regexp_extract("_key", r"\A(\D*\d{10})", 1), F.lit("")), F.col("_key")), "page").drop("_key")
    return rows.withColumns({"page": F.col("page").cast("int"), "file": F.concat(F.lit("page_"), F.lpad(F.col("page").cast("string"), F.greatest(F.lit(4), F.length(F.col("page").cast("string"))), F.lit("0")), F.lit(".jpg"))})


def rendered(spark: SparkSession, documents: DataFrame, first: Renderer, second: Renderer | None = None) -> DataFrame:
    """(book_id, page, file, name, data): the images of every document by ``first``; documents of which it gives none come
    from ``second``, without covers."""
    one = numbered_images(first.images(spark, documents))
    if second is None:
        return one
    left = documents.join(one.select("book_id").distinct(), "book_id", "left_anti")
    return one.unionByName(numbered_images(second.images(spark, left), drop_covers=True))


def page_count(report: Column, images: Column) -> Column:
    """Pages of a document: what its information report says, else the number of its images."""
    from pagemill.sources import files

    return F.coalesce(files.page_count(report), images.cast("int"))
