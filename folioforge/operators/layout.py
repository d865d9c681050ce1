"""Order and shape of boxes on pages. A page is one group: its size is bounded by what fits on a page, not by the corpus.

Boxes are rows (doc_id, ord, x0, y0, x1, y1), doc_id naming the page; a null number counts as 0, pages of null doc_id are
one page, an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of the layout rules, in points or as shares of a page, line or column.
DEPTH, GUTTER, GUTTER_SHARE, PREFERRED_SHARE, BAND, BAND_SHARE = 6, 6.0, 0.03, 0.035, 3.0, 0.65
RULE_TOLERANCE, ROW_HEIGHT, RULES = 1.5, 4.0, 3
# Limits of the search for columns, in points or as shares of boxes, cover, width or height.
SPLITS, FEWEST, NARROWEST, MIDDLE, CROSSING, DIP = 3, 4, 20.0, (0.2, 0.8), 0.15, 0.5
EDGE_HEIGHT, EDGE, BESIDE, SLACK = 0.05, 0.08, 0.45, 0.5
STEP, CROSSING_COLUMNS, LANE, LANE_SHARE, TEXT_WIDTH, COLUMN_WIDTH = 2.0, 0.08, 10.0, 0.008, 40.0, 4.0

Page = dict[str, np.ndarray]


def _widest(start: np.ndarray, end: np.ndarray, tie: np.ndarray, least: float) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(width, boxes before, boxes after) of the first widest empty strip of at least this width along one axis."""
    order = np.lexsort((tie, start))
    gaps = start[order][1:] - np.maximum.accumulate(end[order])[:-1]
    if not len(gaps) or gaps.max() < least:
        return None
    at = int(gaps.argmax()) + 1
    return float(gaps[at - 1]), order[:at], order[at:]


def cut_order(box: np.ndarray, page_width: float) -> tuple[list[int], int]:
    """Reading order of boxes (rows x0, y0, x1, y1) by recursive cuts along empty strips, and the number of columns.

    A strip between columns goes first if it is wide and parts at least two boxes on each side, else the widest strip."""
    order: list[int] = []

    def read(part: np.ndarray, depth: int) -> int:
        x0, y0, x1, y1 = box[part].T
        cut, across = None, False
        if len(part) > 1 and depth < DEPTH:
            height = float(np.median(np.maximum(1.0, y1 - y0)))
            v = _widest(x0, x1, y0, max(GUTTER, GUTTER_SHARE * page_width))
            h = _widest(y0, y1, x0, max(BAND, BAND_SHARE * height))
            clear = v is not None and min(len(v[1]), len(v[2])) > 1 and v[0] >= PREFERRED_SHARE * page_width
            across = v is not None and (clear or h is None or v[0] >= h[0])
            cut = v if across else h
        if cut is None:
            order.extend(part[np.lexsort((x0, np.round(y0, 1)))].tolist())
            return 1
        columns = [read(part[side], depth + 1) for side in cut[1:]]
        return sum(columns) if across else max(columns)

    return order, read(np.arange(len(box)), 0) if len(box) else 0


def _cover(box: np.ndarray, step: float) -> np.ndarray:
    """How many boxes lie on each step of the width, from the leftmost edge."""
    left = box[:, 0].min()
    n = int((box[:, 2].max() - left) / step) + 2
    first, last = ((box[:, c] - left) // step for c in (0, 2))
    real = last >= first
    first, last = first[real].astype(int), last[real].astype(int)
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    at = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return at[::2], at[1::2]


def gutter(box: np.ndarray) -> tuple[float, float] | None:
    """Edges of the strip between two columns: the longest run of least cover in the middle, of equals the most central.

    A few boxes may cross it; it must be covered far less than the rest."""
    if len(box) < FEWEST or box[:, 2].max() - box[:, 0].min() <= NARROWEST:
        return None
    cover = _cover(box, 1.0)
    low = int(len(cover) * MIDDLE[0])
    middle = cover[low : max(low + 1, int(len(cover) * MIDDLE[1]))]
    least = middle.min()
    if len(middle) < 5 or least > max(1.0, CROSSING * len(box)) or least > DIP * np.sort(middle)[len(middle) // 2]:
        return None
    start, end = _runs(middle == least)
    best = np.lexsort((np.abs((start + end) / 2 - len(middle) / 2), start - end))[0]
    left = float(box[:, 0].min()) + low
    return left + int(start[best]), left + int(end[best])


def page_order(box: np.ndarray, page_width: float, depth: int = 0) -> tuple[list[int], int]:
    """Reading order and number of columns: the left column before the right one, between the boxes that span both.

    Low boxes at the upper and lower edge belong to no column. Without two parallel columns the page is cut along
    empty strips (cut_order). A spanning box is read after what ends above it."""
    if len(box) < 3 or depth == SPLITS:
        return np.lexsort((box[:, 0], np.round(box[:, 1], 1))).tolist(), min(1, len(box))
    strip = gutter(box)
    if strip is None:
        return cut_order(box, page_width)
    x0, y0, x1, y1 = box.T
    top, bottom = y0.min(), y1.max()
    high = max(1.0, bottom - top)
    edge = (y1 - y0 <= EDGE_HEIGHT * high) & ((y0 <= top + EDGE * high) | (y1 >= bottom - EDGE * high))
    on_left = ~edge & (x1 <= strip[0] + SLACK)
    on_right = ~edge & ~on_left & (x0 >= strip[1] - SLACK)
    sides = [np.flatnonzero(on_left), np.flatnonzero(on_right)]
    if min(map(len, sides)) < 2:
        return cut_order(box, page_width)
    upper, lower = [y0[s].min() for s in sides], [y1[s].max() for s in sides]
    least = min(b - a for a, b in zip(upper, lower, strict=True))
    if least <= 0 or min(lower) - max(upper) < BESIDE * least:
        return cut_order(box, page_width)
    spanning = np.flatnonzero(~on_left & ~on_right)
    spanning = spanning[np.argsort(y0[spanning], kind="stable")]
    parts, slots, total = [], [], 0
    for side in sides:
        order, columns = page_order(box[side], page_width, depth + 1)
        part = side[order]
        ended = np.searchsorted(np.maximum.accumulate(y1[part]), y0[spanning], "right")  # boxes read before each spanning one
        parts.append(part)
        slots.append(np.searchsorted(ended, np.arange(len(part)), "right"))
        total += columns
    parts.append(spanning)
    slots.append(np.arange(len(spanning)))
    kind = np.repeat(np.arange(3), [len(p) for p in parts])
    return np.concatenate(parts)[np.lexsort((kind, np.concatenate(slots)))].tolist(), total


def columns_of(box: np.ndarray, page_width: float) -> tuple[np.ndarray, int]:
    """The column (from 0) of each box and their number: columns lie between lanes that few boxes cross.

    A box belongs to the column of its centre; a centre in a lane belongs to the column before it."""
    none = np.zeros(len(box), np.int32), 1
    if not len(box):
        return none
    left, right = box[:, 0].min(), box[:, 2].max()
    if right - left <= TEXT_WIDTH:
        return none
    cover = _cover(box, STEP)
    start, end = _runs(cover <= max(1, int(CROSSING_COLUMNS * len(box))))
    lane = ((end - start) * STEP >= max(LANE, LANE_SHARE * page_width)) & (start > 0) & (end < len(cover))
    starts, ends = np.append(left, left + end[lane] * STEP), np.append(left + start[lane] * STEP, right)
    wide = ends - starts > COLUMN_WIDTH
    starts, ends = starts[wide], ends[wide]
    if len(starts) < 2:
        return none
    centre = (box[:, 0] + box[:, 2]) / 2
    at = np.searchsorted(ends, centre, "left")
    inside = (at < len(ends)) & (starts[np.minimum(at, len(ends) - 1)] <= centre)
    return np.maximum(0, at - ~inside).astype(np.int32), len(starts)


def by_page(fn: Callable[[Page], tuple[np.ndarray, Page]], rows: DataFrame, order: list[str], keep: list[str], schema: str, carried: tuple[str, ...] = (), lies: bool = False) -> DataFrame:
    """fn on the columns of each page (doc_id), its rows in this order: one shuffle, pages in sorted Arrow batches.

    fn returns the positions of the rows its results belong to, of which doc_id and the columns to keep are taken, and
    new columns. Columns that are carried along are not given to fn and stay as they are, null too. A task holds a batch and
    a page. The number of partitions is set, so that small pages are not
    gathered in one Python worker. lies: the last step of rows was a window by page, so that a page lies in one partition
    already."""
    spark = rows.sparkSession
    numbers = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    filled = rows.select(*(F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)).alias(c) if c in numbers and c != "doc_id" and c not in carried else F.col(c) for c in rows.columns))
    dealt = filled if lies else filled.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    placed = dealt.sortWithinPartitions("doc_id", *order)
    keep = [*keep, *carried]
    names = [c for c in (*(x.split()[0] for x in schema.split(", ")), *carried) if c != "doc_id"]
    kind = T.StructType([*T.StructType.fromDDL(schema).fields, *(rows.schema[c] for c in carried)])

    def pages(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        code = table["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = np.flatnonzero(np.diff(code, prepend=-1))
        stop = len(code) if last else int(edges[-1])
        arrays = {c: table[c].to_numpy() for c in table.column_names if c != "doc_id" and c not in carried}
        at, out = [np.empty(0, np.int64)], []
        for a, b in zip(edges, [*edges[1:], len(code)], strict=True):
            if b <= stop:
                places, columns = fn({c: v[a:b] for c, v in arrays.items()})
                at.append(places + a)
                out.append(columns)
        rest = table.slice(stop)
        if not out:
            return None, rest
        taken = table.select(["doc_id", *keep]).take(pa.array(np.concatenate(at)))
        fresh = {c: pa.array(np.concatenate([o[c] for o in out])) for c in names if c not in keep}
        return pa.RecordBatch.from_arrays([taken["doc_id"].combine_chunks(), *(taken[c].combine_chunks() if c in keep else fresh[c] for c in names)], ["doc_id", *names]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                fresh = pa.Table.from_batches([batch])
                done, held = pages(fresh if held is None else pa.concat_tables([held, fresh]), False)
                if done is not None:
                    yield done
        if held is not None and held.num_rows:
            done, _ = pages(held, True)
            if done is not None:
                yield done

    return placed.mapInArrow(run, kind)


def _box(page: Page) -> np.ndarray:
    return np.stack([page[c].astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1)


def _with_width(rows: DataFrame, page_width: float | None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Boxes with the width of their page: one for all, or rows' own column page_width."""
    return rows.select("doc_id", "ord", "x0", "y0", "x1", "y1", F.col("page_width") if page_width is None else F.lit(float(page_width)).alias("page_width"), *carried)


def reading_order(rows: DataFrame, page_width: float | None) -> DataFrame:
    """(doc_id, ord, reading_ord, columns): the place of each box in the reading order of its page."""

    def run(page: Page) -> tuple[np.ndarray, Page]:
        order, columns = page_order(_box(page), float(page["page_width"][0]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return np.arange(len(order)), {"reading_ord": place, "columns": np.full(len(order), columns, np.int32)}

    return by_page(run, _with_width(rows, page_width), ["ord"], ["ord"], "doc_id long, ord int, reading_ord int, columns int")


def columns(rows: DataFrame, page_width: float | None) -> DataFrame:
    """(doc_id, ord, column, columns): the column of each box, and their number on the page."""

    def run(page: Page) -> tuple[np.ndarray, Page]:
        column, n = columns_of(_box(page), float(page["page_width"][0]))
        return np.arange(len(column)), {"column": column, "columns": np.full(len(column), n, np.int32)}

    return by_page(run, _with_width(rows, page_width), ["ord"], ["ord"], "doc_id long, ord int, column int, columns int")


def ordered(rows: DataFrame) -> DataFrame:
    """rows (boxes with page_width and any other columns, doc_id a text) with reading_ord, columns and column, in one pass over
    the pages; all other columns go with their boxes, so nothing is joined. The last step of rows is a window by page."""
    carried = tuple(c for c in rows.columns if c not in ("doc_id", "ord", "x0", "y0", "x1", "y1", "page_width"))

    def run(page: Page) -> tuple[np.ndarray, Page]:
        box, width = _box(page), float(page["page_width"][0])
        order, columns = page_order(box, width)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return np.arange(len(order)), {"reading_ord": place, "columns": np.full(len(order), columns, np.int32), "column": columns_of(box, width)[0]}

    box = "x0 double, y0 double, x1 double, y1 double, page_width double"
    return by_page(run, _with_width(rows, None, carried), ["ord"], ["ord", "x0", "y0", "x1", "y1", "page_width"], f"doc_id string, ord int, {box}, reading_ord int, columns int, column int", carried, True)


def aligned(lines: Column) -> Column:
    """left, center, right or justify, of an array of a paragraph's lines (structs with x0 and x1, in order); as alignment()."""
    x0, x1 = F.transform(lines, lambda v: v["x0"]), F.transform(lines, lambda v: v["x1"])
    middle = F.transform(lines, lambda v: (v["x0"] + v["x1"]) / 2)
    spread = lambda v: F.array_max(v) - F.array_min(v)
    n, wide = F.size(lines), F.greatest(F.lit(1.0), F.array_max(x1) - F.array_min(x0))
    reach = F.array_max(x1) - F.greatest(F.lit(2.0), F.lit(0.06) * wide)
    full = F.size(F.filter(F.slice(x1, F.lit(1), F.greatest(F.lit(0), n - 1)), lambda v: v >= reach))
    tol = F.greatest(F.lit(1.5), F.lit(0.03) * wide)
    ragged = spread(x0) > tol
    kind = F.when(n < 2, "left").when(ragged & (spread(middle) <= tol), "center").when(ragged & (spread(x1) <= tol), "right")
    return kind.when((n > 2) & ~ragged & (full >= (n - 1) * 0.8), "justify").otherwise("left")


def merged_paragraphs(rows: DataFrame, key: str = "long", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ord, lead): the first paragraph of the one that each paragraph is a part of.

    rows: doc_id, ord, column, kind, size, color, bold, x0, y0, x1, y1 of paragraphs, first_x0 of their first lines and
    last_x1 of their last. A text goes on where style and column agree, the gap is that of lines, the line before
    reaches the column's right edge and the next starts at its left edge; a merged paragraph has the largest size. key: the
    type of doc_id; carried: further columns that the result has."""

    def run(page: Page) -> tuple[np.ndarray, Page]:
        _, of = np.unique(page["column"], return_inverse=True)
        left, right = np.full(of.max() + 1, np.inf), np.full(of.max() + 1, -np.inf)
        np.minimum.at(left, of, page["x0"])
        np.maximum.at(right, of, page["x1"])
        left, right = left[of], right[of]
        width = np.maximum(1.0, right - left)
        full = page["last_x1"] >= right - np.maximum(8.0, 0.06 * width)
        flush = page["first_x0"] <= left + np.maximum(6.0, 0.05 * width)
        look = list(zip(*(page[c] for c in ("column", "kind", "color", "bold")), strict=True))
        size, top, bottom, ords = (page[c].tolist() for c in ("size", "y0", "y1", "ord"))
        lead, big, low, open_ = [], 0.0, 0.0, False
        for i, (s, y0, y1) in enumerate(zip(size, top, bottom, strict=True)):
            tall = max(big, s)
            same = i > 0 and look[i] == look[i - 1] and look[i][1] == "text" and abs(big - s) <= max(0.6, 0.12 * big)
            if same and -0.5 * tall <= y0 - low <= 0.85 * tall and open_ and flush[i]:
                lead.append(lead[-1])
                open_ = full[i] if y1 > low else open_  # the last line is the lowest, of ties the first
                big, low = tall, max(low, y1)
            else:
                lead.append(ords[i])
                big, low, open_ = s, y1, full[i]
        return np.arange(len(lead)), {"lead": np.array(lead, np.int32)}

    return by_page(run, rows, ["ord"], ["ord"], f"doc_id {key}, ord int, lead int", carried)


def line_spacing(rows: DataFrame) -> DataFrame:
    """(doc_id, spacing): median distance of upper edges that follow each other, 0 where there is none above half a point."""
    order = Window.partitionBy("doc_id").orderBy("y0")
    gaps = rows.select("doc_id", (F.col("y0") - F.lag("y0").over(order)).alias("gap"))
    return gaps.groupBy("doc_id").agg(F.coalesce(F.median(F.when(F.col("gap") > 0.5, F.col("gap"))), F.lit(0.0)).alias("spacing"))


def in_any_region(regions: list[tuple[float, float, float, float]], ratio: float = 0.5) -> Column:
    """Whether a region (of a fixed, short list) covers at least this share of the box's area."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    zero = F.lit(0.0)
    area = F.greatest(zero, x1 - x0) * F.greatest(zero, y1 - y0)
    hit = F.lit(False)
    for a, b, c, d in regions:
        wide = F.greatest(zero, F.least(x1, F.lit(c)) - F.greatest(x0, F.lit(a)))
        high = F.greatest(zero, F.least(y1, F.lit(d)) - F.greatest(y0, F.lit(b)))
        hit = hit | (wide * high >= area * ratio)
    return (area > 0) & hit


def alignment(rows: DataFrame) -> DataFrame:
    """(doc_id, align): left, center, right or justify, of the lines (boxes) of each paragraph (doc_id)."""
    whole = Window.partitionBy("doc_id")
    left, right, last = F.min("x0").over(whole), F.max("x1").over(whole), F.max("ord").over(whole)
    framed = rows.select("*", left.alias("_l"), right.alias("_r"), (F.col("ord") == last).alias("_last")).withColumn("_w", F.greatest(F.lit(1.0), F.col("_r") - F.col("_l")))
    reach = ~F.col("_last") & (F.col("x1") >= F.col("_r") - F.greatest(F.lit(2.0), F.lit(0.06) * F.col("_w")))
    middle = (F.col("x0") + F.col("x1")) / 2
    s = framed.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(reach).alias("full"), F.max("_w").alias("w"), (F.max("x0") - F.min("x0")).alias("l"), (F.max("x1") - F.min("x1")).alias("r"), (F.max(middle) - F.min(middle)).alias("c"))
    tol = F.greatest(F.lit(1.5), F.lit(0.03) * F.col("w"))
    ragged = F.col("l") > tol
    kind = F.when(F.col("n") < 2, "left").when(ragged & (F.col("c") <= tol), "center").when(ragged & (F.col("r") <= tol), "right")
    return s.select("doc_id", kind.when((F.col("n") > 2) & ~ragged & (F.col("full") >= (F.col("n") - 1) * 0.8), "justify").otherwise("left").alias("align"))


def table_rows(rules: DataFrame) -> DataFrame:
    """(doc_id, x0, y0, x1, y1): bands between horizontal rules (doc_id, x0, y, x1) of pages with at least three.

    Rules within a tolerance of the first of their boundary are one boundary; bands lower than ROW_HEIGHT are none."""

    def run(page: Page) -> tuple[np.ndarray, Page]:
        y = page["y"].astype(float)
        starts, at = [], 0
        while at < len(y):
            starts.append(at)
            at = int(np.searchsorted(y, y[at] + RULE_TOLERANCE, "right"))
        if len(y) < RULES:
            starts = starts[:1]
        lo, hi = np.minimum.reduceat(page["x0"].astype(float), starts), np.maximum.reduceat(page["x1"].astype(float), starts)
        edge = y[starts]
        high = np.diff(edge) >= ROW_HEIGHT
        bands = {"x0": np.minimum(lo[:-1], lo[1:]), "y0": edge[:-1], "x1": np.maximum(hi[:-1], hi[1:]), "y1": edge[1:]}
        return np.zeros(int(high.sum()), np.int64), {c: v[high] for c, v in bands.items()}

    return by_page(run, rules.select("doc_id", "x0", "y", "x1"), ["y", "x0", "x1"], [], "doc_id long, x0 double, y0 double, x1 double, y1 double")
