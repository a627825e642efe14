"""Page geometry: statistics of a flow, boxes and points, bands, sparse sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal_margin(items: DataFrame, by: list[str], x: str, seq: str, bucket: float = 0.02) -> DataFrame:
    """``by, margin``: mean of the values in the fullest bucket, the first seen of equals."""
    cut = F.floor(F.col(x) / bucket)
    of = items.groupBy(*by, cut.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_q"), F.avg(x).alias("margin"))
    return of.groupBy(*by).agg(F.min_by("margin", F.struct(-F.col("_n"), F.col("_q"))).alias("margin"))


def at_index(items: DataFrame, by: list[str], x: str, index: Column, name: str) -> DataFrame:
    """``by, name``: the value at a place of the sorted values of each group, ``index`` being of ``_all``, their number.

    Equal values are counted first, map-side; a group's distinct values are then ranked in a sort that may spill.
    """
    counts = items.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias(name)).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(*by).orderBy(name)
    upto = counts.withColumn("_upto", F.sum("_n").over(line)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    return upto.filter((F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)).select(*by, name)


def index_percentile(items: DataFrame, by: list[str], x: str, share: float = 0.95) -> DataFrame:
    """``by, edge``: the value at ``min(n - 1, int(share * n))`` in sorted order."""
    n = F.col("_all")
    return at_index(items, by, x, F.least(n - 1, F.floor(n * share)), "edge")


def upper_median(items: DataFrame, by: list[str], x: str) -> DataFrame:
    """``by, size``: sorted ``[n // 2]``, 12 if that is not positive (A10)."""
    return at_index(items, by, x, F.floor(F.col("_all") / 2), "size").withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(12))


#: Labels of a page's second flow; the least score of a detection, and of a caption; widest caption, as a share of the page.
SECONDARY = ("image", "figure_title", "chart", "table", "formula", "formula_number", "algorithm", "aside_text", "footnote", "footer", "number", "seal")
DETECTED, CAPTION, CAPTION_WIDE = 0.3, 0.6, 0.5
#: A wide item's share of the content's width, the share of wide items of a single column; how near margins and bands are, and how far boxes may overlap, as shares of the page.
WIDE, SINGLE, MARGIN_NEAR, BAND_NEAR, OVERLAP = 0.7, 0.15, 0.05, 0.05, 0.01


def flow(label: Column) -> Column:
    """``main`` or ``secondary``."""
    return F.when(label.isin(*SECONDARY), "secondary").otherwise("main")


def detections(items: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Boxes (``label, score, x0, y0, x1, y1``) of a page (``width``, ``height``): those detected well enough, clipped to the page; what is left of no area goes.

    A caption that is weak or wide is text (P19). ``box`` is the clipped box in whole numbers, halves to the even one.
    """
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(most).cast("double")))
    df = items.filter(F.col("score") >= DETECTED).withColumns({"x0": clip("x0", width), "y0": clip("y0", height), "x1": clip("x1", width), "y1": clip("y1", height)})
    df = df.filter("x1 > x0 and y1 > y0")
    weak = (F.col("label") == "figure_title") & ((F.col("score") < CAPTION) | (F.col("x1") - F.col("x0") > F.col(width) * CAPTION_WIDE))
    return df.withColumn("label", F.when(weak, "text").otherwise(F.col("label"))).withColumn("box", F.array(*[F.bround(c).cast("int") for c in ("x0", "y0", "x1", "y1")]))


def flow_statistics(items: DataFrame, by: list[str], seq: str, x0: str = "x0", x1: str = "x1", bucket: float = 0.02) -> DataFrame:
    """``by, margin, edge, single``: of a document's main items, in shares of the page, the modal left margin (A7), the right edge (A8), and
    whether enough of them are wide for one column (A9). Documents without main items have no row."""
    stats = modal_margin(items, by, x0, seq, bucket).join(index_percentile(items, by, x1), by)
    wide = (F.col(x1) - F.col(x0)) >= (F.col("edge") - F.col("margin")) * WIDE
    share = items.join(stats, by).groupBy(*by).agg((F.count_if(wide) >= F.count(F.lit(1)) * SINGLE).alias("single"))
    return stats.join(share, by)


def lateral(items: DataFrame, references: DataFrame, by: list[str], item: str = "item") -> DataFrame:
    """Main items of a page (``by, item, x0, y0, x1, y1`` in shares of it, ``margin``) that stand beside the column.

    An item off the margin is lateral if it begins where a secondary item (``by, at``) does, or if an item on the margin
    shares some of its height and none of its width. A page's items meet each other only.
    """
    off = F.abs(F.col("x0") - F.col("margin")) > MARGIN_NEAR
    away, on = items.filter(off), items.filter(~off)
    named = references.select(*by, F.col("at").alias("_at"))
    beside = on.select(*by, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    same = lambda other: reduce(lambda a, b: a & b, [away[c] == other[c] for c in by])
    begins = away.join(named, same(named) & (F.abs(F.col("x0") - F.col("_at")) <= BAND_NEAR), "left_semi")
    shares = F.least("y1", "_y1") - F.greatest("y0", "_y0") > 0
    apart = (F.col("_x1") <= F.col("x0") + OVERLAP) | (F.col("x1") <= F.col("_x0") + OVERLAP)
    next_to = away.join(beside, same(beside) & shares & apart, "left_semi")
    return begins.union(next_to).select(*by, item).distinct()


def confirmed_bands(bands_: DataFrame, references: DataFrame, doc: str = "doc", page: str = "page", low: str = "low") -> DataFrame:
    """Bands (``doc, page, low``) that begin near a band of another page of the document, or near a secondary item (``doc, page, at``) of their own.

    Joined on buckets of the range and their neighbours, so that only what is near meets.
    """
    cut = lambda c: F.floor(c / BAND_NEAR)
    own = bands_.withColumn("_cut", F.explode(F.sequence(cut(F.col(low)) - 1, cut(F.col(low)) + 1)))
    others = bands_.select(F.col(doc).alias("_doc"), F.col(page).alias("_page"), F.col(low).alias("_low"), cut(F.col(low)).alias("_c")).distinct()
    near = F.abs(F.col(low) - F.col("_low")) <= BAND_NEAR
    seen = own.join(others, (F.col(doc) == F.col("_doc")) & (F.col("_cut") == F.col("_c")) & (F.col(page) != F.col("_page")) & near, "left_semi")
    items = references.select(F.col(doc).alias("_doc"), F.col(page).alias("_page"), F.col("at").alias("_low"), cut(F.col("at")).alias("_c"))
    named = own.join(items, (F.col(doc) == F.col("_doc")) & (F.col(page) == F.col("_page")) & (F.col("_cut") == F.col("_c")) & near, "left_semi")
    return seen.union(named).drop("_cut").distinct()


def weighted_mode(items: DataFrame, by: list[str], x: str, weight: str, seq: str) -> DataFrame:
    """``by, mode``: the value with most weight, the first seen of equals."""
    of = items.groupBy(*by, x).agg(F.sum(weight).alias("_w"), F.min(seq).alias("_q"))
    return of.groupBy(*by).agg(F.min_by(x, F.struct(-F.col("_w"), F.col("_q"))).alias("mode"))


def assigned(points: DataFrame, boxes: DataFrame, cell: float | None = None) -> DataFrame:
    """Each point (``page, point, x, y``) with the largest box (``page, box, x0, y0, x1, y1``) that holds it, the first of equals.

    Of boxes alike the first stays. Boxes are dealt to the cells of a grid that they touch (``cell`` wide and high; the mean of the boxes' sides
    if not given), points to their cell, so a point meets only the boxes around it.
    """
    alike = boxes.groupBy("page", "x0", "y0", "x1", "y1").agg(F.min("box").alias("box"))
    if cell is None:
        cell = alike.agg(F.avg((F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / 2)).head()[0] or 1.0
    at = lambda c: F.floor(F.col(c) / F.lit(float(cell)))
    spread = alike.filter("x0 <= x1 and y0 <= y1").withColumn("_i", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_j", F.explode(F.sequence(at("y0"), at("y1"))))
    held = points.withColumn("_i", at("x")).withColumn("_j", at("y")).join(spread, ["page", "_i", "_j"]).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return held.groupBy("page", "point").agg(F.min_by("box", F.struct(-area, F.col("box"))).alias("box"))


def bands(spans: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """``by, band, low, high, n``: spans that overlap, as one; spans that only touch are two."""
    line = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(line.rowsBetween(Window.unboundedPreceding, -1))
    df = spans.withColumn("_new", (F.coalesce(F.col(low) >= reach, F.lit(True))).cast("int"))
    df = df.withColumn("band", F.sum("_new").over(line))
    return df.groupBy(*by, "band").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("n"))


def contained(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of box ``a`` that lies in box ``b``."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    own = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(own > 0, wide * high / own).otherwise(0.0)


def masked(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells (``sheet, row, col, text``) blank where a range of their sheet (``sheet, r0, c0, r1, c1``) covers them."""
    hit = cells.join(ranges, "sheet").filter(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    keys = hit.select("sheet", "row", "col").distinct().withColumn("_hit", F.lit(True))
    return cells.join(keys, ["sheet", "row", "col"], "left").withColumn("text", F.when(F.col("_hit"), "").otherwise(F.col("text"))).drop("_hit")


def dense_rows(cells: DataFrame) -> DataFrame:
    """``sheet, row, cells``: sparse cells as an array from column 0, gaps empty, trailing blanks cut."""
    rows = cells.filter(F.col("text") != "").groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_m"), F.max("col").alias("_w"))
    full = F.transform(F.sequence(F.lit(0), F.col("_w").cast("int")), lambda c: F.coalesce(F.try_element_at("_m", c.cast("long")), F.lit("")))
    return rows.select("sheet", "row", full.alias("cells"))


#: Gaps that part columns and rows, as shares of the page; how deep a page is parted; share of a box that counts as contained.
COLUMN_GAP, ROW_GAP, DEPTH, INSIDE = 0.01, 0.005, 24, 0.9


def widest_gap(low, high) -> tuple[float, float]:
    """The widest stretch that no interval covers, and its middle; the first of equals, 0 if there is none."""
    import numpy as np

    order = np.argsort(low, kind="stable")
    gaps = low[order][1:] - np.maximum.accumulate(high[order])[:-1]
    if not len(gaps) or gaps.max() <= 0:
        return 0.0, 0.0
    k = int(gaps.argmax())
    return float(gaps[k]), float(low[order][k + 1] - gaps[k] / 2)


def reading_order(boxes, width: float, height: float):
    """Indexes of ``boxes`` (rows of x0, y0, x1, y1) as they are read: parted at column gaps, then at row gaps, else by (y, x)."""
    import numpy as np

    out, todo = [], [(np.arange(len(boxes)), 0)]
    while todo:
        some, depth = todo.pop()
        b, cut = boxes[some], None
        if len(some) > 1 and depth < DEPTH:
            for axis, least in ((0, width * COLUMN_GAP), (1, height * ROW_GAP)):
                gap, at = widest_gap(b[:, axis], b[:, axis + 2])
                first = b[:, axis + 2] <= at
                if gap >= least and first.any() and not first.all():
                    cut = first
                    break
        if cut is None:
            out += some[np.lexsort((b[:, 0], b[:, 1]))].tolist()
        else:
            todo += [(some[~cut], depth + 1), (some[cut], depth + 1)]
    return out


def arranged(items: DataFrame, by: list[str], width: float, height: float) -> DataFrame:
    """Add ``place`` (from 1) to the items of each page (``x0, y0, x1, y1``, ``seq`` for ties) in reading order."""
    import pandas as pd

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("seq").reset_index(drop=True)
        page["place"] = 0
        page.loc[reading_order(page[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float), width, height), "place"] = range(1, len(page) + 1)
        return page

    schema = items.schema.simpleString()[len("struct<") : -1]
    return items.groupBy(*by).applyInPandas(run, f"{schema},place:bigint")


def uncovered(items: DataFrame, by: list[str]) -> DataFrame:
    """The items of each page less those of which 0.9 lies in another of the same size or larger that is still there, in order of ``seq``."""
    import pandas as pd

    def run(page: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        page = page.sort_values("seq").reset_index(drop=True)
        b = page[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        area = np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])
        there = np.ones(len(b), dtype=bool)
        for i in range(len(b)):
            shared = np.maximum(0, np.minimum(b[:, 2], b[i, 2]) - np.maximum(b[:, 0], b[i, 0])) * np.maximum(0, np.minimum(b[:, 3], b[i, 3]) - np.maximum(b[:, 1], b[i, 1]))
            holds = there & (area >= area[i]) & (shared >= INSIDE * area[i]) & (area[i] > 0)
            holds[i] = False
            there[i] = not holds.any()
        return page[there]

    return items.groupBy(*by).applyInPandas(run, items.schema)


def chosen_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans (``start, stop`` inclusive, ``score``, ``seq``) taken by falling score where they overlap none taken before, by start."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))))
    none = F.array().cast("array<struct<s:double,seq:bigint,start:bigint,stop:bigint>>")
    fold = F.aggregate(listed, none, lambda t, x: F.when(F.exists(t, lambda o: (x["start"] <= o["stop"]) & (o["start"] <= x["stop"])), t).otherwise(F.concat(t, F.array(F.struct(x["s"].cast("double").alias("s"), x["seq"].alias("seq"), x["start"].alias("start"), x["stop"].alias("stop"))))))
    return spans.groupBy(*by).agg(fold.alias("_t")).select(*by, F.explode("_t").alias("t")).select(*by, "t.start", "t.stop", (-F.col("t.s")).alias("score"), "t.seq")
