"""Pixels of pages behind one interface: cut illustrations, covers, resized and shifted images. Recorded images, or an
imaging library on the workers where one is installed. Sizes and rectangles are computed by :mod:`sources.files`,
:mod:`operators.body` and :mod:`streaming.retry`; here they meet the bytes."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources import files

#: Largest width and height of a cut illustration and of a cover, and their JPEG qualities.
FIGURE_BOX, COVER_BOX = (1400, 1800), (1600, 2400)
FIGURE_QUALITY, QUALITY = 88, 90


class ImageOps(Protocol):
    def figures(self, requests: DataFrame, pages: DataFrame) -> DataFrame:
        """Requests of :func:`epub.figure_requests` and page images (book_id, page, data) to (result_id, book_id, page,
        figure_index, data); what cannot be cut gives no row."""

    def covers(self, images: DataFrame) -> DataFrame:
        """(book_id, data) to (book_id, data) within COVER_BOX."""


def opened(data: bytes):
    """The image of some bytes in RGB; null without an imaging library or for what is no image."""
    try:
        from PIL import Image

        return Image.open(io.BytesIO(data)).convert("RGB")
    except Exception:  # no library, or no image
        return None


def jpeg(image, quality: int) -> bytes:
    out = io.BytesIO()
    image.save(out, "JPEG", quality=quality)
    return out.getvalue()


@dataclass(frozen=True)
class Recorded:
    """Images of an earlier run: (result_id, figure_index, data), and (book_id, data) of covers."""

    recorded: DataFrame
    recorded_covers: DataFrame | None = None

    def figures(self, requests: DataFrame, pages: DataFrame) -> DataFrame:
        own = self.recorded.select("result_id", "figure_index", "data").dropDuplicates(["result_id", "figure_index"])
        return requests.select("result_id", "book_id", "page", "figure_index").join(own, ["result_id", "figure_index"])

    def covers(self, images: DataFrame) -> DataFrame:
        known = images.select("book_id").distinct()
        return images if self.recorded_covers is None else self.recorded_covers.join(known, "book_id", "left_semi")


@dataclass(frozen=True)
class Library:
    """The imaging library of the workers. Without one no figure is cut, and covers stay as they are."""

    def figures(self, requests: DataFrame, pages: DataFrame) -> DataFrame:
        rows = requests.select("result_id", "book_id", "page", "figure_index", "bbox").join(pages.select("book_id", "page", "data"), ["book_id", "page"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                out = []
                for r in part.itertuples(index=False):
                    if (image := opened(bytes(r.data or b""))) is not None:
                        cut = image.crop(rectangle(list(r.bbox), *image.size))
                        cut.thumbnail(FIGURE_BOX)
                        out.append((r.result_id, r.book_id, r.page, r.figure_index, jpeg(cut, FIGURE_QUALITY)))
                yield pd.DataFrame(out, columns=["result_id", "book_id", "page", "figure_index", "data"])

        return rows.mapInPandas(run, "result_id bigint, book_id string, page int, figure_index int, data binary")

    def covers(self, images: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                yield pd.DataFrame({"book_id": part.book_id, "data": [fitted(bytes(d or b""), COVER_BOX) for d in part["data"]]})

        return images.select("book_id", "data").mapInPandas(run, "book_id string, data binary")


def rectangle(box: list[float], width: int, height: int) -> tuple[int, int, int, int]:
    """The pixels of a box given in shares of a page, at least one wide and high; as :func:`body.crop`."""
    keep = lambda v, low, high: max(low, min(high, int(v)))
    left, top = keep(box[0] * width, 0, width - 1), keep(box[1] * height, 0, height - 1)
    return left, top, keep(box[2] * width, left + 1, width), keep(box[3] * height, top + 1, height)


def fitted(data: bytes, box: tuple[int, int]) -> bytes:
    """An image no larger than a box; bytes that cannot be read stay."""
    image = opened(data)
    if image is None:
        return data
    image.thumbnail(box)
    return jpeg(image, QUALITY)


def data_urls(images: DataFrame, longest: int = 2400, suffix: str = "suffix") -> DataFrame:
    """Images (with data and suffix) with ``url``, a data address of the image with its longer side at most ``longest``.
    What cannot be read or need not shrink goes as it is, under its suffix's media type."""
    @F.pandas_udf("binary")
    def resized(data: pd.Series) -> pd.Series:
        out = []
        for d in data:
            image = opened(bytes(d)) if d is not None and longest > 0 else None
            if image is None or max(image.size) <= longest:
                out.append(None)
                continue
            scale = longest / max(image.size)
            out.append(jpeg(image.resize(tuple(max(1, int(n * scale)) for n in image.size)), QUALITY))
        return pd.Series(out, dtype=object)

    rows = images.withColumn("_small", resized(F.col("data")))
    url = files.data_url(F.coalesce("_small", "data"), F.when(F.col("_small").isNotNull(), ".jpg").otherwise(F.col(suffix)))
    return rows.withColumn("url", url).drop("_small")


def shifted(images: DataFrame) -> DataFrame:
    """Images (with data and box, a struct of :func:`retry.jitter_box`) with their edges cut by the box, for a retry; what
    cannot be read stays."""
    @F.pandas_udf("binary")
    def cut(data: pd.Series, box: pd.DataFrame) -> pd.Series:
        out = []
        for d, b in zip(data, box.itertuples(index=False)):
            image = opened(bytes(d)) if d is not None else None
            out.append(d if image is None or min(image.size) <= 8 else jpeg(image.crop((b.left, b.top, image.size[0] - b.right, image.size[1] - b.bottom)), QUALITY))
        return pd.Series(out, dtype=object)

    return images.withColumn("data", cut("data", "box"))
