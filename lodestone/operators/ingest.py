"""Ingestion of page elements: furniture, headings, tables, coverage, drawing clusters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import box_area, box_gap, box_overlap, center_in
from ..functions.text import norm_key
from . import spatial
from .folds import streamed

# A numeric cell, and how a figure's or table's caption begins.
NUMBER = r"^[~≈<>]?\s*[-+]?\$?\d[\d,]*(\.\d+)?\s*(%|[kKmMbBxX×])?$"
FIGURE_START = r"(?i)^\s*(figure|fig\.)\s*\d"
TABLE_START = r"(?i)^\s*table\s*\d"


def furniture(lines: DataFrame, ratio: float = 0.5, least_pages: int = 3) -> DataFrame:
    """(doc_id, key): normalised lines (doc_id, page, text, margin) in page margins of more than `ratio` of a document's pages."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    keyed = lines.where("margin").select("doc_id", "page", norm_key(F.col("text")).alias("key")).where("key <> ''")
    seen = keyed.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, "doc_id").where(F.col("n") > F.col("pages") * ratio).select("doc_id", "key")


def drop_furniture(lines: DataFrame, **rule) -> DataFrame:
    """lines with skip_reason 'header_footer' where they are furniture."""
    found = furniture(lines, **rule).withColumn("skip_reason", F.lit("header_footer"))
    keyed = lines.withColumn("key", F.when(F.col("margin"), norm_key(F.col("text"))))
    return keyed.join(found, ["doc_id", "key"], "left").drop("key")


def shared_lines(lines: DataFrame, more_than: int = 3) -> DataFrame:
    """(key, n_docs): normalised lines (doc_id, line) that more than so many documents hold."""
    keyed = lines.select("doc_id", norm_key(F.col("line")).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs")).where(F.col("n_docs") > more_than)


def body_size(spans: DataFrame) -> DataFrame:
    """(doc_id, body_size): the median font size of spans (doc_id, size, chars), each weighing its characters."""
    return spans.groupBy("doc_id").agg(F.percentile("size", F.lit(0.5), F.col("chars")).alias("body_size"))


def is_heading(size: Column, body: Column, bold: Column, text: Column) -> Column:
    return ((size >= body + 1.5) | bold) & F.length(F.trim(text)).between(2, 120)


def numeric_columns(tables: DataFrame, share: float = 0.8) -> DataFrame:
    """(table_id, column_no, filled, numeric, is_numeric) of cells (table_id, row_no, column_no, cell)."""
    full = F.trim(F.coalesce("cell", F.lit(""))) != ""
    g = tables.groupBy("table_id", "column_no").agg(F.count_if(full).alias("filled"), F.count_if(full & F.trim("cell").rlike(NUMBER)).alias("numeric"))
    return g.withColumn("is_numeric", (F.col("filled") > 0) & (F.col("numeric") >= share * F.col("filled")))


def table_quality(tables: DataFrame) -> DataFrame:
    """tables (element_id, columns, rows) that have two filled columns and a row, with low_confidence; one-row doubtful ones go."""
    heads, cells = F.transform("columns", lambda c: F.trim(F.coalesce(c, F.lit("")))), F.flatten("rows")
    blank = F.exists(heads, lambda h: h == "") | (F.size(F.array_distinct(heads)) < F.size(heads))
    empty = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")) / F.greatest(F.size(cells), F.lit(1))
    filled = F.size(F.filter(F.sequence(F.lit(0), F.size("columns") - 1), lambda i: (F.get(heads, i) != "") | F.exists("rows", lambda r: F.trim(F.coalesce(F.get(r, i), F.lit(""))) != "")))
    good = tables.where(F.size("columns") >= 2).withColumn("low_confidence", blank | (empty > 0.3)).where((filled >= 2) & (F.size("rows") >= 1))
    return good.where(~(F.col("low_confidence") & (F.size("rows") == 1)))


def page_coverage(pages: DataFrame, elements: DataFrame, skips: DataFrame) -> DataFrame:
    """(doc_id, page, reason 'empty_page') of pages (doc_id, pages) that neither an element nor a skip names."""
    all_pages = pages.select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    named = elements.select("doc_id", "page").union(skips.select("doc_id", "page"))
    return all_pages.join(named, ["doc_id", "page"], "left_anti").withColumn("reason", F.lit("empty_page"))


def textless_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    return pages.where(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) < least)


def page_profile(pages: DataFrame) -> DataFrame:
    """Character, image, drawing and table counts of pages with what they are: textless, vector_heavy."""
    return pages.select("doc_id", "page", "chars", "images", "drawings", "tables", (F.col("chars") < 50).alias("textless"), (F.col("drawings") > 100).alias("vector_heavy"))


def box_union(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, bbox): the box around all boxes of a group."""
    side = lambda f, k: f(F.col("bbox")[k])
    return boxes.groupBy(*by).agg(F.array(side(F.min, 0), side(F.min, 1), side(F.max, 2), side(F.max, 3)).alias("bbox"))


def merge_captioned(regions: DataFrame) -> DataFrame:
    """(doc_id, page, no, bbox, shapes) of regions (doc_id, page, no, bbox, shapes, caption): those of a page with one caption are one
    figure, named by its least number; those without a caption stay."""
    side = lambda f, k: f(F.col("bbox")[k])
    own = F.when(F.col("caption").isNull(), F.col("no"))
    g = regions.groupBy("doc_id", "page", "caption", own.alias("own")).agg(F.min("no").alias("no"), F.array(side(F.min, 0), side(F.min, 1), side(F.max, 2), side(F.max, 3)).alias("bbox"), F.sum("shapes").alias("shapes"))
    return g.select("doc_id", "page", "no", "bbox", "shapes")


def absorb_parts(figures: DataFrame, parts: DataFrame, reach: float = 32.0) -> tuple[DataFrame, DataFrame]:
    """(figures, parts left over): parts (doc_id, page, part, bbox, caption, reason, callout) that lie within reach of a figure (doc_id,
    page, no, bbox, caption), or share its caption, join the first such figure's box; page rules (isolated_shape) and boxes of body
    text (callout) never do. One round: a figure does not reach further for what it has taken in."""
    able = parts.where((F.col("reason") != "isolated_shape") & ~F.col("callout"))
    f = figures.select("doc_id", "page", "no", F.col("bbox").alias("f"), F.col("caption").alias("c"))
    near = able.join(f, ["doc_id", "page"]).where((box_gap(F.col("bbox"), F.col("f")) <= reach) | (F.col("caption") == F.col("c")))
    taken = near.groupBy("doc_id", "page", "part").agg(F.min("no").alias("no"), F.first("bbox").alias("bbox"))
    grown = box_union(figures.select("doc_id", "page", "no", "bbox").union(taken.select("doc_id", "page", "no", "bbox")), ["doc_id", "page", "no"])
    return grown, parts.join(taken.select("doc_id", "page", "part"), ["doc_id", "page", "part"], "left_anti")


def outside(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """blocks (doc_id, page, element_id, bbox) whose middle lies in none of regions (doc_id, page, bbox): text that no table or figure holds."""
    x, y = ((F.col("bbox")[i] + F.col("bbox")[i + 2]) / 2 for i in (0, 1))
    middle = blocks.select("doc_id", "page", "element_id", F.col("bbox").alias("b"), F.array(x, y, x, y).alias("ba"))
    held = spatial.grid_join(middle, regions.select("doc_id", "page", F.col("bbox").alias("bb")), ["doc_id", "page"]).where(center_in(F.col("b"), F.col("bb")))
    return blocks.join(held.select("doc_id", "element_id").distinct(), ["doc_id", "element_id"], "left_anti")


def reading_order(elements: DataFrame) -> DataFrame:
    """elements (doc_id, page, element_id, bbox) with place: from 1 by page, top and left edge, then id."""
    order = Window.partitionBy("doc_id").orderBy("page", F.col("bbox")[1], F.col("bbox")[0], "element_id")
    return elements.withColumn("place", F.row_number().over(order))


def first_images(images: DataFrame) -> DataFrame:
    """images (doc_id, hash, page, no, width, height) with status: later copies and those under 50 pixels are skipped."""
    order = Window.partitionBy("doc_id", "hash").orderBy("page", "no")
    small = F.least("width", "height") < 50
    return images.withColumn("k", F.row_number().over(order)).withColumn("skip_reason", F.when(F.col("k") > 1, "duplicate").when(small, "decorative")).withColumn("status", F.when(F.col("skip_reason").isNull(), "ok").otherwise("skipped")).drop("k")


def nearest_caption(figures: DataFrame, blocks: DataFrame, gap: float = 40.0) -> DataFrame:
    """(element_id, caption) of figures (doc_id, page, element_id, bbox): the nearest caption line just below, else a "Figure N" line just above.

    blocks (doc_id, page, bbox, text, and italic where known). A caption line starts with "Figure N" or is italic and has 20
    characters or more; above a figure only the former counts.
    """
    italic = F.coalesce(F.col("italic"), F.lit(False)) if "italic" in blocks.columns else F.lit(False)
    named = F.col("text").rlike(FIGURE_START)
    f = figures.select("doc_id", "page", "element_id", F.col("bbox").alias("f"))
    b = blocks.select("doc_id", "page", F.col("bbox").alias("b"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), named.alias("named"), (italic & (F.length("text") >= 20)).alias("slanted")).where("named OR slanted")
    pair = f.join(b, ["doc_id", "page"]).where("b[0] < f[2] AND b[2] > f[0]")
    under, over = F.col("b")[1] - F.col("f")[3], F.col("f")[1] - F.col("b")[3]
    below = F.when(under.between(-2, gap), F.struct(F.col("b")[1].alias("y"), "text"))
    above = F.when(F.col("named") & over.between(-2, gap), F.struct((-F.col("b")[3]).alias("y"), "text"))
    g = pair.groupBy("element_id").agg(F.min(below).alias("below"), F.min(above).alias("above"))
    return g.select("element_id", F.coalesce("below.text", "above.text").alias("caption")).where("caption IS NOT NULL")


def table_titles(tables: DataFrame, blocks: DataFrame, gap: float = 40.0, most_chars: int = 120) -> DataFrame:
    """(element_id, title) of tables (doc_id, page, element_id, bbox): the nearest short line above that is bold or starts with "Table N"."""
    t = tables.select("doc_id", "page", "element_id", F.col("bbox").alias("t"))
    b = blocks.where(F.col("bold") | F.col("text").rlike(TABLE_START)).where(F.length("text") <= most_chars).select("doc_id", "page", F.col("bbox").alias("b"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    near = t.join(b, ["doc_id", "page"]).where((F.col("t")[1] - F.col("b")[3]).between(0, gap))
    return near.groupBy("element_id").agg(F.max_by("text", F.struct(F.col("b")[3], "text")).alias("title"))


def wrapped_headings(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, seq, page, bbox, size, heading) with wraps: a heading that goes on from the line before it, of the
    same level (sizes within half a point) on the same page, closer than its size."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    level = F.round(F.col("size") * 2) / 2
    before = F.lag(F.struct("heading", level.alias("level"), "page", F.col("bbox")[3].alias("bottom"))).over(w)
    same = F.col("heading") & before["heading"] & (before["level"] == level) & (before["page"] == F.col("page")) & (F.col("bbox")[1] - before["bottom"] < F.col("size"))
    return blocks.withColumn("wraps", F.coalesce(same, F.lit(False)))


def section_paths(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, seq, text, size, heading) with section_path: a stack of headings, popped while the top is no larger.

    Where blocks have page and bbox, a heading that wraps onto a second line extends the title it continues, also in the
    path of the line before. A fold over one document's blocks in order, of which it holds one.
    """
    known = {"page", "bbox"} <= set(blocks.columns)
    rows = wrapped_headings(blocks) if known else blocks.withColumn("wraps", F.lit(False))
    text, size, heading, wraps = (rows.columns.index(c) for c in ("text", "size", "heading", "wraps"))

    def stacked(block: Iterator[tuple]):
        stack, held = [], None
        for row in block:
            if row[heading]:
                level, title = round(row[size] * 2) / 2, " ".join((row[text] or "").split())
                if row[wraps]:
                    stack[-1] = (level, f"{stack[-1][1]} {title}")
                    held = (held[0], [t for _, t in stack])  # the line before has the whole title too
                else:
                    while stack and stack[-1][0] <= level:
                        stack.pop()
                    stack.append((level, title))
            if held:
                yield (*held[0], held[1])
            held = ((*row[:wraps], *row[wraps + 1 :]), [t for _, t in stack])
        if held:
            yield (*held[0], held[1])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    return streamed(rows, ["doc_id"], ["seq"], stacked, f"{fields}, section_path array<string>")


def drawing_clusters(boxes: DataFrame, gap: float = 12.0) -> DataFrame:
    """boxes (doc_id, page, no, bbox) with cluster: single links of boxes at most `gap` apart, named by their least number."""
    on = ["doc_id", "page"]
    whole, rest = spatial.split_pages(boxes.dropna(subset=[*on, "no"]), on)
    found = spatial.clusters_of_pages(whole, gap)
    if rest is None:
        return found
    root = spatial.components(rest.select(*on, "no"), spatial.linked_boxes(rest, gap), on)
    return found.union(rest.join(root.withColumnRenamed("root", "cluster"), [*on, "no"]).select(*boxes.columns, "cluster"))


def cluster_kind(clusters: DataFrame, blocks: DataFrame, body: DataFrame, least_shapes: int = 3, isolated_items: int = 30, coverage: float = 0.3, callout_chars: int = 100) -> DataFrame:
    """(doc_id, page, cluster, kind): isolated_shape, too_few_shapes, text_callout or keep.

    clusters (doc_id, page, cluster, bbox, items): drawings of a cluster and how many path items each has; blocks (doc_id, page,
    bbox, chars, size, mono): text blocks; body (doc_id, body_size). A callout is a box around text in body size or a fixed
    pitch: half of the characters whose block has its middle inside, or, where text covers the box by `coverage`, half of
    those that touch it or `callout_chars` of any.
    """
    side = lambda f, k: f(F.col("bbox")[k])
    g = clusters.groupBy("doc_id", "page", "cluster").agg(F.count("*").alias("shapes"), F.sum("items").alias("items"), F.array(side(F.min, 0), side(F.min, 1), side(F.max, 2), side(F.max, 3)).alias("box"))
    g = g.withColumn("few", F.when((F.col("shapes") == 1) & (F.col("items") <= isolated_items), "isolated_shape").when((F.col("shapes") < least_shapes) & (F.col("items") <= isolated_items), "too_few_shapes"))
    b = blocks.select("doc_id", "page", F.col("bbox").alias("b"), "chars", "size", F.coalesce("mono", F.lit(False)).alias("mono")).join(body.select("doc_id", "body_size"), "doc_id")
    pair = g.where("few IS NULL").select("doc_id", "page", "cluster", "box").join(b, ["doc_id", "page"])
    plain = F.when(F.col("mono") | (F.col("size") >= F.col("body_size") - 1), F.col("chars")).otherwise(0)
    inside, touches = center_in(F.col("b"), F.col("box")), box_overlap(F.col("b"), F.col("box")) > 0
    add = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    text = pair.groupBy("doc_id", "page", "cluster").agg(
        add(inside, F.col("chars")).alias("chars_in"), add(inside, plain).alias("plain_in"), add(touches, F.col("chars")).alias("chars_at"), add(touches, plain).alias("plain_at"),
        F.coalesce(F.sum(box_overlap(F.col("b"), F.col("box"))), F.lit(0.0)).alias("covered"),
    )
    j = g.join(text, ["doc_id", "page", "cluster"], "left")
    half = lambda part, whole: (F.col(whole) > 0) & (F.col(part) >= 0.5 * F.col(whole))
    dense = F.col("covered") / F.greatest(box_area(F.col("box")), F.lit(1.0)) >= coverage
    callout = half("plain_in", "chars_in") | (dense & (half("plain_at", "chars_at") | (F.col("chars_at") >= callout_chars)))
    kind = F.coalesce("few", F.when(F.coalesce(callout, F.lit(False)), "text_callout").otherwise("keep"))
    return j.select("doc_id", "page", "cluster", kind.alias("kind"))


def touching(a: DataFrame, b: DataFrame, within: float = 0.0) -> DataFrame:
    """Pairs of boxes of the same page at most `within` apart, on a grid."""
    x, y = a.select("doc_id", "page", F.col("element_id").alias("a"), F.col("bbox").alias("ba")), b.select("doc_id", "page", F.col("element_id").alias("b"), F.col("bbox").alias("bb"))
    return spatial.grid_join(x, y, ["doc_id", "page"], within)


def context_words(paragraphs: DataFrame, n: int = 150) -> DataFrame:
    """paragraphs (doc_id, seq, text) with the last n words before each and the first n after, over rows that can hold them."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    w = paragraphs.withColumn("words", words)
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(-n, -1)
    after = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, n)
    a, b = F.flatten(F.collect_list("words").over(before)), F.flatten(F.collect_list("words").over(after))
    out = w.withColumn("a", a).withColumn("b", b)
    last = F.when(F.size("a") > n, F.slice("a", -n, n)).otherwise(F.col("a"))
    return out.withColumn("words_before", F.array_join(last, " ")).withColumn("words_after", F.array_join(F.slice("b", 1, n), " ")).drop("a", "b", "words")


def latest(records: DataFrame, key: str = "element_id", seq: str = "seq") -> DataFrame:
    """The last record of each key."""
    return records.groupBy(key).agg(F.max_by(F.struct("*"), seq).alias("r")).select("r.*")


def arbitrate(tables: DataFrame, figures: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(tables, figures) of a page where they overlap: a doubtful table that touches a figure goes, then a figure mostly on a table.

    Both have doc_id, page, element_id and bbox; tables have low_confidence. Rejected figures carry reject_reason.
    """
    t, f = tables.select("doc_id", "page", F.col("element_id").alias("t_id"), F.col("bbox").alias("tb"), "low_confidence"), figures.select("doc_id", "page", F.col("element_id").alias("f_id"), F.col("bbox").alias("fb"))
    near = spatial.grid_join(t.withColumnRenamed("tb", "ba"), f.withColumnRenamed("fb", "bb"), ["doc_id", "page"]).withColumnsRenamed({"ba": "tb", "bb": "fb"})
    both = near.withColumn("area", box_overlap(F.col("tb"), F.col("fb"))).where("area > 0")
    bad = both.where("low_confidence").select(F.col("t_id").alias("element_id")).distinct()
    kept = tables.join(bad, "element_id", "left_anti")
    on_table = both.where(~F.col("low_confidence") & (F.col("area") >= share * box_area(F.col("fb")))).select(F.col("f_id").alias("element_id"), F.lit("table_region").alias("reject_reason")).distinct()
    return kept, figures.join(on_table, "element_id", "left")


def drawing_furniture(drawings: DataFrame, pages: DataFrame, margin: float = 0.1) -> DataFrame:
    """drawings (doc_id, page, no, bbox) with role: background of half the page or more, thin wide rule, line in a margin; else null."""
    b = F.col("bbox")
    w, h = b[2] - b[0], b[3] - b[1]
    j = drawings.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    aspect = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(0.01))
    in_margin = (b[3] <= margin * F.col("height")) | (b[1] >= (1 - margin) * F.col("height"))
    role = F.when(w * h >= 0.5 * F.col("width") * F.col("height"), "background").when((h <= 2) & (w >= 0.5 * F.col("width")), "rule").when(in_margin & (aspect > 40), "margin_line")
    return j.withColumn("role", role).drop("width", "height")


def block_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, no, text, size, bold) of blocks whose lines are arrays of spans (text, size, bold): the longest span gives the style."""
    spans = F.filter(F.flatten("lines"), lambda s: F.trim(s["text"]) != "")
    lines = F.filter(F.transform("lines", lambda l: F.trim(F.array_join(F.transform(l, lambda s: s["text"]), ""))), lambda x: x != "")
    longest = F.element_at(F.array_sort(F.transform(spans, lambda s: F.struct(F.length(s["text"]).alias("n"), s["size"].alias("size"), s["bold"].alias("bold")))), -1)
    return blocks.where(F.size(spans) > 0).select("doc_id", "page", "no", F.array_join(lines, " ").alias("text"), longest["size"].alias("size"), longest["bold"].alias("bold"))


def grow_regions(regions: DataFrame, labels: DataFrame, reach: float = 32.0, merge: float = 12.0, beside: float = 72.0) -> DataFrame:
    """(doc_id, page, bbox): regions (doc_id, page, bbox) grown by labels within reach or, level with the region, beside it, until none
    attaches, and then merged while two lie within `merge`. Regions without a usable box are left out."""
    on = ["doc_id", "page"]
    order = Window.partitionBy(*on).orderBy(*[F.col("bbox")[i] for i in range(4)])
    named = regions.select(*on, "bbox").withColumn("no", F.row_number().over(order))
    grown = spatial.grown_boxes(named, labels, reach, beside)
    return spatial.merged_boxes(grown, merge).select(*on, "bbox")
