"""Lines that one source repeats over many of its pages.

Per source, consecutive lines form a weighted graph: a node is a line with the number of distinct pages and books it
stands on, an edge is "directly followed by". Nodes with high support are kept, edges that hold for most occurrences of
an end are kept, and connected components are boilerplate blocks; occurrences are deleted from the pages, run by run.

Scale: the lines of every page are read and cleaned once, into a written table of 64-bit hashes; nodes and edges are counted
on hashes with map-side combination, and text is read again only from one page a kept line. A source has at most (mean
lines a page / share) such lines, whatever its size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import broadcast_if_small, checked_small, written

#: Share of a source's distinct pages, and number of its books, on which a line must stand.
PAGE_SHARE, MIN_BOOKS = 0.08, 3
#: Parts into which a source's pages are cut where a join would gather them.
PARTS = 64
#: Share of the rarer end's pages on which two lines must be neighbours to be one block.
EDGE_SHARE = 0.5
BLANK_RUN = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def plain_line(line: Column) -> Column:
    """Lower-cased, blank runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), BLANK_RUN, " "))


def page_lines(pages: DataFrame) -> Column:
    """The page's lines in order: those of the title, then of each block. Null title, blocks and texts give none."""
    texts = F.concat(F.array("title"), F.coalesce(F.transform("blocks", lambda b: b["text"]), F.array().cast("array<string>")))
    lines = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.split(t, "\n", -1)))
    return F.filter(F.transform(lines, plain_line), lambda x: x != "")


def lined(pages: DataFrame) -> DataFrame:
    return pages.where("site IS NOT NULL").select("site", "book_id", "page", page_lines(pages).alias("lines"))


def site_pages(pages: DataFrame) -> DataFrame:
    """(site, n_pages): distinct (book_id, page)."""
    return pages.where("site IS NOT NULL").select("site", "book_id", "page").distinct().groupBy("site").agg(F.count("*").alias("n_pages"))


def hashed_lines(pages: DataFrame) -> DataFrame:
    """(site, book_id, page, hs), written: the hashes of a page's lines in order. A page delivered twice comes once."""
    rows = lined(pages).select("site", "book_id", "page", F.transform("lines", lambda x: F.xxhash64(x)).alias("hs"))
    return written(rows, "line-hashes")


def joined_small(rows: DataFrame, small: DataFrame, label: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of their site in ``small``: by broadcast if its size allows, else over parts of a site."""
    held = checked_small(small, label)
    if held.isEmpty():
        return rows.join(held, "site", how)
    parts = held.withColumn("_part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("book_id", "page"), F.lit(PARTS)).cast("int")).join(broadcast_if_small(parts), ["site", "_part"], how).drop("_part")


def frequent_lines(pages: DataFrame, share: float = PAGE_SHARE, min_books: int = MIN_BOOKS, hashed: DataFrame | None = None) -> DataFrame:
    """(site, line, h, n_pages, n_books, site_pages) of lines on at least ``share`` of the pages and in ``min_books`` books.

    Pages delivered twice count once. Null site: no rows. ``hashed``: :func:`hashed_lines` of the pages, if at hand.
    """
    hashed = hashed_lines(pages) if hashed is None else hashed
    totals = written(site_pages(pages), "site-pages")
    each = hashed.select("site", "book_id", "page", F.explode(F.array_distinct("hs")).alias("h"))
    upper = each.groupBy("site", "h").agg(F.count("*").alias("n"))  # repeats only raise it: an upper bound
    maybe = upper.join(F.broadcast(totals), "site").where(F.col("n") >= share * F.col("n_pages")) if _few(totals) else upper.join(totals, "site").where(F.col("n") >= share * F.col("n_pages"))
    wanted = maybe.groupBy("site").agg(F.collect_set("h").alias("wanted"))  # at most lines-a-page / share values a site
    kept = joined_small(hashed, wanted, "wanted-hashes").select("site", "book_id", "page", F.explode(F.array_intersect("hs", "wanted")).alias("h")).distinct()
    per_book = kept.groupBy("site", "h", "book_id").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    counted = per_book.groupBy("site", "h").agg(F.sum("n").alias("n_pages"), F.count("*").alias("n_books"), F.min(F.struct("book_id", "page")).alias("at"))
    frequent = written(
        counted.join(totals.withColumnRenamed("n_pages", "site_pages"), "site").where((F.col("n_pages") >= share * F.col("site_pages")) & (F.col("n_books") >= min_books)),
        "frequent-hashes",
    )
    # The text of a line, from one page that has it.
    spots = checked_small(frequent.select("site", "h", F.col("at.book_id").alias("book_id"), F.col("at.page").alias("page")), "line-spots")
    where = spots.groupBy("site", "book_id", "page").agg(F.collect_set("h").alias("asked"))
    some = pages.join(broadcast_if_small(where), ["site", "book_id", "page"])
    texts = some.select("site", "asked", F.explode(page_lines(some)).alias("line")).withColumn("h", F.xxhash64("line")).where(F.array_contains("asked", F.col("h"))).groupBy("site", "h").agg(F.min("line").alias("line"))
    return texts.join(frequent, ["site", "h"]).select("site", "line", "h", "n_pages", "n_books", "site_pages")


def _few(totals: DataFrame, limit: int = 100_000) -> bool:
    """Whether there are few enough sources to send their totals to every task."""
    return totals.limit(limit + 1).count() <= limit


def edges(pages: DataFrame, frequent: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
    """(site, a, b, weight): frequent lines that directly follow each other, with the number of pages."""
    hashed = hashed_lines(pages) if hashed is None else hashed
    wanted = frequent.groupBy("site").agg(F.collect_set("h").alias("wanted"))
    rows = joined_small(hashed, wanted, "edge-hashes")
    n = F.greatest(F.size("hs") - 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice("hs", 1, n), F.slice("hs", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    near = F.filter(pairs, lambda p: F.array_contains("wanted", p["a"]) & F.array_contains("wanted", p["b"]) & (p["a"] != p["b"]))
    each = rows.select("site", "book_id", "page", F.explode(near).alias("p")).select("site", "book_id", "page", "p.a", "p.b").distinct()
    weights = each.groupBy("site", "a", "b").agg(F.count("*").alias("weight"))
    name = lambda c: frequent.select("site", F.col("h").alias(c), F.col("line").alias(f"line_{c}"))
    return weights.join(name("a"), ["site", "a"]).join(name("b"), ["site", "b"]).select("site", F.col("line_a").alias("a"), F.col("line_b").alias("b"), "weight")


def blocks(pages: DataFrame, share: float = PAGE_SHARE, min_books: int = MIN_BOOKS, edge_share: float = EDGE_SHARE) -> DataFrame:
    """(site, block, line, n_pages, n_books, block_lines, block_pages): frequent lines with the connected component they
    belong to.

    ``block`` is the least line of the component, ``block_lines`` its number of lines, ``block_pages`` the most pages on
    which two of its lines, or its only line, stand. A site's graph has at most lines-a-page / share nodes, so one task
    per site resolves it.
    """
    hashed = hashed_lines(pages)
    frequent = written(frequent_lines(pages, share, min_books, hashed), "frequent-lines")
    kept = edges(pages, frequent, hashed)
    nodes = frequent.select("site", F.col("line").alias("a"), F.lit(None).cast("string").alias("b"), F.col("n_pages").alias("weight"), "n_books")
    graph = nodes.unionByName(kept.withColumn("n_books", F.lit(0).cast("bigint")))

    def components(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part.b.isna()]
        support = dict(zip(own.a, own.weight))
        root = {x: x for x in own.a}

        def top(x: str) -> str:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = [(a, b, w) for a, b, w in part.loc[~part.b.isna(), ["a", "b", "weight"]].itertuples(index=False) if w >= edge_share * min(support[a], support[b])]
        for a, b, _ in links:
            lo, hi = sorted((top(a), top(b)))
            root[hi] = lo
        size: dict[str, int] = {}
        pages_of: dict[str, int] = {}
        for x in own.a:
            size[top(x)] = size.get(top(x), 0) + 1
        for a, _, w in links:
            pages_of[top(a)] = max(pages_of.get(top(a), 0), w)
        of = [top(x) for x in own.a]
        return pd.DataFrame({
            "site": own.site, "block": of, "line": own.a, "n_pages": own.weight, "n_books": own.n_books,
            "block_lines": [size[b] for b in of], "block_pages": [pages_of.get(b, support[x]) for b, x in zip(of, own.a)],
        })

    return graph.groupBy("site").applyInPandas(components, "site string, block string, line string, n_pages bigint, n_books bigint, block_lines bigint, block_pages bigint")


def cleaned(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(result_id, site, book_id, page, title, blocks, removed, runs): every page once, without the lines of ``found``.

    ``runs`` is the number of stretches of consecutive lines of one block that were deleted, ``removed`` that of lines. A
    title made of such lines becomes null; a block left without lines goes. Pages of sites without such lines stay.
    """
    sets = found.groupBy("site").agg(F.map_from_entries(F.collect_set(F.struct("line", "block"))).alias("boiler"))
    base = pages.select("result_id", "site", "book_id", "page", "title", "blocks").dropDuplicates(["result_id"])
    rows = joined_small(base, sets, "line-sets", "left").withColumn("boiler", F.coalesce("boiler", F.create_map().cast("map<string,string>")))
    known = lambda x: F.map_contains_key("boiler", x)
    good = lambda text: F.filter(F.split(text, "\n", -1), lambda x: ~known(plain_line(x)))
    title = F.nullif(F.array_join(good(F.col("title")), "\n"), F.lit(""))
    new = F.transform("blocks", lambda b: F.when(b["text"].isNull(), b).otherwise(b.withField("text", F.array_join(good(b["text"]), "\n"))))
    kept = F.filter(F.arrays_zip(F.col("blocks").alias("old"), new.alias("new")), lambda z: z["new"]["text"].isNull() | (z["new"]["text"] != "") | (z["old"]["text"] == ""))
    rows = rows.withColumn("_of", F.transform(page_lines(rows), lambda x: F.try_element_at("boiler", x)))
    first = F.filter(F.transform("_of", lambda b, i: F.struct(b.alias("b"), F.when(i > 0, F.get("_of", i - 1)).alias("before"))), lambda z: z["b"].isNotNull() & ~z["b"].eqNullSafe(z["before"]))
    return rows.select(
        "result_id", "site", "book_id", "page", title.alias("title"), F.transform(kept, lambda z: z["new"]).alias("blocks"),
        F.size(F.filter("_of", lambda b: b.isNotNull())).alias("removed"), F.size(first).alias("runs"))
