"""Page layout: running heads, body size, headings, contents ranges, tables against text.

Inputs carry explicit ordinals (page, block, line, span), as rows have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import ExtractionConfig
from marlstone.functions.text import boilerplate_key, clean_line, dehyphenate, section_id, strip

ITEM = r"(?i)^item\s+\d+[a-z]?"


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """Lines of text spans: spans joined without separator; size is the largest, bold if any is; blanks go."""
    kept = spans.where(strip(F.col("text")) != "")
    texts = F.array_sort(F.collect_list(F.struct("span", "text")))
    out = kept.groupBy("doc_name", "page", "page_height", "block", "line").agg(
        strip(F.array_join(F.transform(texts, lambda x: x["text"]), "")).alias("text"),
        F.max("size").alias("size"),
        F.bool_or("bold").alias("bold"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return out.where("text <> ''")


def in_margin(y0: Column, height: Column, config: ExtractionConfig = ExtractionConfig()) -> Column:
    return (y0 <= config.boilerplate_margin_pt) | (y0 >= height - config.boilerplate_margin_pt)


def boilerplate_keys(lines: DataFrame, pages: DataFrame, config: ExtractionConfig = ExtractionConfig(), doc: str = "doc_name") -> DataFrame:
    """``doc, key, n`` of margin lines that recur: n >= max(2, floor(ratio * pages)). ``pages`` has ``doc, n_pages``."""
    counted = lines.withColumn("key", boilerplate_key(F.col("text"))).where("key <> ''").groupBy(doc, "key").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(2), F.floor(F.col("n_pages") * config.boilerplate_recurrence_ratio + 1e-9))
    return counted.join(pages, doc).where(F.col("n") >= least).select(doc, "key", "n")


def without_boilerplate(lines: DataFrame, keys: DataFrame, doc: str = "doc_name") -> DataFrame:
    """Lines whose key does not recur, wherever on the page they stand."""
    return lines.withColumn("key", boilerplate_key(F.col("text"))).join(keys.select(doc, "key"), [doc, "key"], "left_anti").drop("key")


def body_size(lines: DataFrame, docs: DataFrame, doc: str = "doc_name", sample_pages: int = 20) -> DataFrame:
    """Median line size of the first pages; documents without lines get 10."""
    found = lines.where(F.col("page") < sample_pages).groupBy(doc).agg(F.median("size").alias("body_size"))
    return docs.select(doc).distinct().join(found, doc, "left").withColumn("body_size", F.coalesce("body_size", F.lit(10.0)))


def is_heading(text: Column, size: Column, bold: Column, body: Column, config: ExtractionConfig = ExtractionConfig()) -> Column:
    styled = (size >= body * config.heading_font_size_ratio) | bold
    return F.rlike(text, F.lit(ITEM)) | (styled & F.length(text).between(3, 90) & ~F.rlike(text, F.lit(r"[.,;]$")))


def carry_sections(lines: DataFrame, heading: Column, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Adds ``section, section_id``: those of the last heading up to the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    title = F.last_value(F.when(heading, F.col(text)), F.lit(True)).over(w)
    return lines.withColumn("section", title).withColumn("section_id", F.when(F.col("section").isNotNull(), section_id(F.col("section"))))


def toc_sections(toc: DataFrame, pages: DataFrame, doc: str = "doc_name") -> DataFrame:
    """Top-level contents entries as page ranges, joined to pages (0-based): ``doc, page, section, section_id``.

    ``toc`` has ``doc, level, title, page`` (1-based) and ``ord``; ``pages`` has ``doc, page``. Of entries on one page the
    last wins, so each page takes the last entry that starts at or before it: an as-of join by a window over the union."""
    starts = toc.where("level = 1 and page >= 1").select(doc, (F.col("page") - 1).alias("page"), F.lit(0).alias("kind"), F.col("ord").alias("ord"), F.col("title").alias("section"))
    asked = pages.select(doc, "page", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("section"))
    w = Window.partitionBy(doc).orderBy("page", "kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    filled = starts.unionByName(asked).withColumn("section", F.last_value("section", F.lit(True)).over(w))
    return filled.where("kind = 1 and section is not null").select(doc, "page", "section", section_id(F.col("section")).alias("section_id"))


def overlap_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area of the intersection by the area of box a (x0, y0, x1, y1); 0 for an empty box a."""
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, width * height / area).otherwise(zero)


#: Blocks of a page to a tile, about, and most tiles along a side of a page.
TILE_BLOCKS, MOST_TILES = 16, 256


def _tiled(boxes: DataFrame, on: list[str], pages: DataFrame) -> DataFrame:
    """boxes once for each tile of their page that they touch, as ``_tile``; ``pages`` says how a page is cut."""

    def along(low: str, high: str, start: str, end: str):
        size = F.greatest((F.col(end) - F.col(start)) / F.col("_tiles"), F.lit(1e-9))
        at = lambda c: F.greatest(F.lit(0), F.least(F.col("_tiles") - 1, F.floor((F.col(c) - F.col(start)) / size))).cast("int")
        return F.explode(F.sequence(at(low), F.greatest(at(low), at(high))))

    placed = boxes.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").join(pages, on)
    placed = placed.withColumn("_tx", along("x0", "x1", "_x0", "_x1")).withColumn("_ty", along("y0", "y1", "_y0", "_y1"))
    return placed.select(*boxes.columns, (F.col("_tx") * F.col("_tiles") + F.col("_ty")).alias("_tile"))


def blocks_outside_tables(blocks: DataFrame, tables: DataFrame, config: ExtractionConfig = ExtractionConfig(), on: tuple[str, ...] = ("doc_name", "page"), block: str = "block") -> DataFrame:
    """Blocks that no table of their page covers by more than the ratio. Each page is cut into tiles, as many as its blocks need, and a block
    is held against tables of its own tiles only; a page of few blocks is one tile."""
    keys = list(on)
    side = F.least(F.lit(MOST_TILES), F.ceil(F.sqrt(F.count(F.lit(1)) / TILE_BLOCKS))).cast("int")
    pages = blocks.groupBy(*keys).agg(F.min("x0").alias("_x0"), F.min("y0").alias("_y0"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"), side.alias("_tiles"))
    pages = pages.join(tables.select(*keys).distinct(), keys, "left_semi")
    sides = ("x0", "y0", "x1", "y1")
    held = _tiled(blocks.select(*keys, block, *sides), keys, pages)
    t = _tiled(tables.select(*keys, *sides), keys, pages).select(*keys, "_tile", *[F.col(k).alias(f"_{k}") for k in sides])
    met = held.join(t, [*keys, "_tile"]).where(overlap_share(tuple(map(F.col, sides)), tuple(F.col(f"_{k}") for k in sides)) > config.table_overlap_ratio)
    return blocks.join(met.select(*keys, block).distinct(), [*keys, block], "left_anti").select(*blocks.columns)


def paragraphs(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``paragraph``: a new one starts where the gap to the line above exceeds 1.5 line heights."""
    w = Window.partitionBy(*by).orderBy(*order)
    gap = F.col("y0") - F.lag("y1").over(w)
    starts = (gap > 1.5 * F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).cast("int")
    return lines.withColumn("_new", F.coalesce(starts, F.lit(0))).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def paragraph_texts(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row a paragraph: its lines cleaned, joined and dehyphenated; empty ones go."""
    texts = F.array_sort(F.collect_list(F.struct(order, "text")))
    joined = F.array_join(F.transform(texts, lambda x: clean_line(x["text"])), "\n")
    return lines.groupBy(*by, "paragraph").agg(F.min(order).alias("first_line"), dehyphenate(joined).alias("text")).where("text <> ''")


def page_items(blocks: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """Blocks and tables of a page in reading order; on equal heights blocks come first."""
    a = blocks.select(*by, "y0", F.lit(0).alias("kind"), F.col("block").alias("ord"))
    b = tables.select(*by, "y0", F.lit(1).alias("kind"), F.col("table_no").alias("ord"))
    return a.unionByName(b).withColumn("item", F.row_number().over(Window.partitionBy(*by).orderBy("y0", "kind", "ord")) - 1)


def scanned(pages: DataFrame, docs: DataFrame, config: ExtractionConfig = ExtractionConfig(), doc: str = "doc_name") -> DataFrame:
    """Adds ``mean_chars`` of the first five pages and ``is_scanned``; documents without pages count as scanned. ``pages`` has ``text``, or its
    length in ``chars``."""
    chars = F.col("chars") if "chars" in pages.columns else F.length(strip(F.col("text")))
    mean = pages.where("page < 5").groupBy(doc).agg(F.avg(chars).alias("mean_chars"))
    out = docs.join(mean, doc, "left").withColumn("mean_chars", F.coalesce("mean_chars", F.lit(0.0)))
    return out.withColumn("is_scanned", F.col("mean_chars") < config.min_chars_per_page)
