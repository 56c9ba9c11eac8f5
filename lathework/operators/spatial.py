"""Which frame owns a glyph, and how glyphs become lines and blocks. Range joins meet on a page grid first, never on pairs of everything."""

from __future__ import annotations

import bisect
import re
import statistics
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 64.0


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("bigint"), F.floor(high / size).cast("bigint"))


def containing(points: DataFrame, boxes: DataFrame, *, page: Sequence[str], point: str, x: str, y: str, box: str, bounds: str, tolerance: float = 0.0, cell: float = CELL) -> DataFrame:
    """(page, point, box, area): boxes (array left, bottom, right, top) that hold a point, edges and tolerance included.

    Boxes are put into every grid cell they touch, points into one, so that the join is an equi-join on (page, cell).
    """
    t = F.lit(float(tolerance))
    side = lambda i: F.get(F.col(bounds), F.lit(i))
    b = boxes.select(*page, F.col(box).alias("box"), side(0).alias("x0"), side(1).alias("y0"), side(2).alias("x1"), side(3).alias("y1")).where("x1 >= x0 AND y1 >= y0")
    b = b.withColumn("cx", F.explode(_cells(F.col("x0") - t, F.col("x1") + t, cell))).withColumn("cy", F.explode(_cells(F.col("y0") - t, F.col("y1") + t, cell)))
    p = points.select(*page, F.col(point).alias("point"), F.col(x).alias("px"), F.col(y).alias("py")).where("px IS NOT NULL AND py IS NOT NULL")
    p = p.withColumn("cx", F.floor(F.col("px") / cell).cast("bigint")).withColumn("cy", F.floor(F.col("py") / cell).cast("bigint"))
    inside = (F.col("px") >= F.col("x0") - t) & (F.col("px") <= F.col("x1") + t) & (F.col("py") >= F.col("y0") - t) & (F.col("py") <= F.col("y1") + t)
    return p.join(b, [*page, "cx", "cy"]).where(inside).select(*page, "point", "box", "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def smallest_owner(held: DataFrame, *, page: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """(page, point, box): the smallest box that holds the point; none where two are equally small within the tolerance."""
    w = Window.partitionBy(*page, "point")
    d = held.withColumn("_min", F.min("area").over(w))
    d = d.withColumn("_ties", F.sum(F.when(F.col("area") <= F.col("_min") + tolerance, 1).otherwise(0)).over(w))
    return d.where((F.col("area") == F.col("_min")) & (F.col("_ties") == 1)).select(*page, "point", "box")


def innermost_owner(held: DataFrame, *, page: Sequence[str]) -> DataFrame:
    """(page, point, box): the one box that lies within all other boxes that hold the point; none if boxes only overlap."""
    w = Window.partitionBy(*page, "point")
    inner = (F.col("x0") == F.max("x0").over(w)) & (F.col("y0") == F.max("y0").over(w)) & (F.col("x1") == F.min("x1").over(w)) & (F.col("y1") == F.min("y1").over(w))
    d = held.withColumn("_in", inner).where("_in").drop("_in")
    return d.withColumn("_n", F.count("*").over(w)).where("_n = 1").select(*page, "point", "box")


def owner_counts(held: DataFrame, points: DataFrame, *, page: Sequence[str], point: str) -> DataFrame:
    """(page, point, owners) for every point, 0 where none."""
    n = held.groupBy(*page, "point").agg(F.count("*").alias("owners"))
    return points.select(*page, F.col(point).alias("point")).join(n, [*page, "point"], "left").withColumn("owners", F.coalesce("owners", F.lit(0)))


GLYPHS = "text string, x0 double, x1 double, top double, bottom double, size double, font string"
LINES = "line int, text string, x0 double, x1 double, top double, bottom double, size double, font string, peers int"
# fixed values: ligatures that typesetting sets apart from their line, and what they stand for
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# fixed values: reach of a ligature, gap between lines of a band, both in points or shares of size and page width
LIGATURE_RISE, LIGATURE_REACH = 0.45, (12.0, 2.0)
LINE_GAP, ROW_SEGMENT = (12.0, 0.02), (10.0, 0.02)


class _Band:
    """Places of a band in order, with their middle: the median of an even number lies between its two middle ones."""

    def __init__(self) -> None:
        self.tops: list[float] = []
        self.members: list[int] = []

    def add(self, i: int, top: float) -> None:
        bisect.insort(self.tops, top)
        self.members.append(i)

    def middle(self) -> float:
        n = len(self.tops)
        return (self.tops[(n - 1) // 2] + self.tops[n // 2]) / 2


def _bands(tops: Sequence[float], reach: Callable[[int, _Band], float]) -> list[_Band]:
    """Things in the order of their tops, each in the band before it if it lies within ``reach`` of the band's median."""
    bands: list[_Band] = []
    for i, top in enumerate(tops):
        if not bands or abs(top - bands[-1].middle()) > reach(i, bands[-1]):
            bands.append(_Band())
        bands[-1].add(i, top)
    return bands


def _lines(pdf: pd.DataFrame, tolerance: float, page_width: float) -> list[tuple]:
    """Rows of LINES of one page: glyphs in bands, bands cut at wide gaps, lone ligatures put back into the nearest line."""
    g = pdf[pdf["text"].fillna("") != ""].sort_values(["top", "x0"], kind="stable").reset_index(drop=True)
    text, x0, x1, top, bottom = (g[c].tolist() for c in ("text", "x0", "x1", "top", "bottom"))
    size, font = g["size"].fillna(0.0).tolist(), g["font"].fillna("UNKNOWN").tolist()
    ligature = [t in LIGATURES for t in text]

    def reach(i: int, band: _Band) -> float:
        if ligature[i] or any(ligature[m] for m in band.members):
            return max(tolerance, statistics.median([size[i], *[size[m] for m in band.members]]) * LIGATURE_RISE)
        return tolerance

    lines: list[list[int]] = []
    for band in _bands(top, reach):
        right = None
        for i in sorted(band.members, key=lambda i: x0[i]):
            if right is None or x0[i] - right > max(LINE_GAP[0], page_width * LINE_GAP[1]):
                lines.append([])
            lines[-1].append(i)
            right = x1[i] if right is None else max(right, x1[i])
    whole = [line for line in lines if not all(ligature[i] for i in line)]
    for alone in (line for line in lines if all(ligature[i] for i in line)):
        middle, left, end, near = statistics.median(top[i] for i in alone), min(x0[i] for i in alone), max(x1[i] for i in alone), []
        for k, line in enumerate(whole):
            typical = statistics.median(size[i] for i in [*alone, *line])
            rise, aside = abs(middle - statistics.median(top[i] for i in line)), max(min(x0[i] for i in line) - end, left - max(x1[i] for i in line), 0.0)
            if rise <= max(tolerance, typical * LIGATURE_RISE) and aside <= max(LIGATURE_REACH[0], typical * LIGATURE_REACH[1]):
                near.append((rise, aside, k))
        if near:
            whole[min(near)[2]].extend(alone)
        else:
            whole.append(alone)

    records = []
    for line in whole:
        line = sorted(line, key=lambda i: x0[i])
        shown = [i for i in line if text[i].strip()]
        if not shown:
            continue
        words = [text[line[0]]] + [(" " if x0[b] - x1[a] > 1.0 else "") + text[b] for a, b in zip(line, line[1:])]
        fonts = Counter(font[i] for i in shown)
        modal = min(fonts, key=lambda f: (-fonts[f], [font[i] for i in shown].index(f)))
        plain = "".join(words).strip().translate(str.maketrans(LIGATURES))
        records.append((plain, min(x0[i] for i in line), max(x1[i] for i in line), min(top[i] for i in line), max(bottom[i] for i in line), statistics.median(size[i] for i in shown), modal))
    records.sort(key=lambda r: (r[3], r[1]))
    peers = [0] * len(records)
    for band in _bands([r[3] for r in records], lambda i, b: tolerance):
        span = max(records[i][2] for i in band.members) - min(records[i][1] for i in band.members)
        wide = sum(records[i][2] - records[i][1] >= max(ROW_SEGMENT[0], span * ROW_SEGMENT[1]) for i in band.members)
        for i in band.members:
            peers[i] = wide
    return [(n, *r, p) for n, (r, p) in enumerate(zip(records, peers), 1)]


def glyph_lines(glyphs: DataFrame, *, page: Sequence[str], page_width: float = 595.0, tolerance: float = 2.0) -> DataFrame:
    """Lines of each page's glyphs (GLYPHS): (page, LINES). One group is one page. Pages without glyphs give no lines.

    Glyphs are put in bands by the distance of their tops to the band's running median, more loosely where a ligature is among
    them; a band is cut where the gap is wider than 12 points and 2 % of the page. ``peers`` counts the wide segments of the
    line's row: three and more are a table's.
    """
    types = dict(glyphs.dtypes)
    schema = ", ".join([f"{p} {types[p]}" for p in page] + [LINES])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x0", "x1", "top", "bottom"])
        rows = [(*(pdf[p].iloc[0] for p in page), *r) for r in _lines(pdf, tolerance, page_width)] if len(pdf) else []
        return pd.DataFrame(rows, columns=[*page, *[c.split()[0] for c in LINES.split(", ")]])

    return glyphs.groupBy(*page).applyInPandas(build, schema)


# fixed values: what keeps two lines out of one block, in points or shares of size and page width
BLOCK_GAP, OVERLAP, INDENT, SIZE_STEP, ROW_PEERS = 0.85, -2.0, (12.0, 0.025), (1.0, 0.12), 3
_BOLD, _ITALIC = r"bold|semibold|demi|\.b(?:$|\+)", r"italic|oblique|\.i(?:$|\+)"


def _emphasis(font: str | None) -> tuple[bool, bool]:
    name = (font or "").lower()
    return bool(re.search(_BOLD, name)), bool(re.search(_ITALIC, name))


def _fits(line: dict, last: dict, width: float) -> bool:
    """May the line follow the last one of a block?"""
    cell, other = line.get("cell"), last.get("cell")
    cell, other = (None if c is None or c != c else c for c in (cell, other))
    if cell is not None or other is not None:
        if cell != other:
            return False
    elif max(line.get("peers") or 0, last.get("peers") or 0) >= ROW_PEERS:
        return False
    largest = max(line["size"], last["size"])
    gap, shared = line["top"] - last["bottom"], min(line["x1"], last["x1"]) - max(line["x0"], last["x0"])
    column = shared >= min(line["x1"] - line["x0"], last["x1"] - last["x0"]) * 0.5 or abs(line["x0"] + line["x1"] - last["x0"] - last["x1"]) / 2 <= width * 0.08
    indented = abs(line["x0"] - last["x0"]) > max(INDENT[0], width * INDENT[1])
    restyled = abs(line["size"] - last["size"]) > max(SIZE_STEP[0], max(largest, 1.0) * SIZE_STEP[1]) or _emphasis(line["font"]) != _emphasis(last["font"])
    return OVERLAP <= gap <= largest * BLOCK_GAP and column and not indented and not restyled


def line_blocks(lines: DataFrame, *, page: Sequence[str], page_width: float = 595.0) -> DataFrame:
    """Lines with ``block``: each goes on the block whose last line is nearest above it in the same column, with like size, emphasis and indent; else it begins one.

    A column ``cell`` (the table cell that holds the line, see table_cells) keeps cells apart; outside of cells a line in a row of
    three and more segments stands alone. Of equally near blocks the later one. Blocks are numbered from 1 as they begin.
    """
    types = dict(lines.dtypes)
    schema = ", ".join([f"{c} {t}" for c, t in types.items()] + ["block int"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "x0"], kind="stable").reset_index(drop=True)
        last: list[dict] = []
        blocks = []
        for r in pdf.to_dict("records"):
            near = [(r["top"] - b["bottom"], -i) for i, b in enumerate(last) if _fits(r, b, page_width)]
            i = -min(near)[1] if near else len(last)
            last[i:i + 1] = [r]
            blocks.append(i + 1)
        return pdf.assign(block=pd.Series(blocks, dtype="int32"))[[*types, "block"]]

    return lines.groupBy(*page).applyInPandas(build, schema)


def table_cells(lines: DataFrame, cells: DataFrame, *, page: Sequence[str], tolerance: float = 0.5) -> DataFrame:
    """``lines`` with ``cell``: the smallest of the page's table cells (cell, bounds) whose bounds hold the line's middle; null for none. Ties go to the first cell."""
    middle = lines.select(*page, "line", ((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("top") + F.col("bottom")) / 2).alias("_y"))
    held = containing(middle, cells, page=page, point="line", x="_x", y="_y", box="cell", bounds="bounds", tolerance=tolerance)
    best = held.groupBy(*page, F.col("point").alias("line")).agg(F.min_by("box", F.struct("area", "box")).alias("cell"))
    return lines.join(best, [*page, "line"], "left")


def table_candidates(tables: DataFrame, *, page_width: Column) -> DataFrame:
    """Tables (page, table_id, by_text, n_rows, n_columns, x0, x1) that count: of two rows and columns or more; on pages without any such, those found by text alignment with three columns and 35 % of the page's width."""
    ruled = ~F.col("by_text") & (F.col("n_rows") >= 2) & (F.col("n_columns") >= 2)
    aligned = F.col("by_text") & (F.col("n_columns") >= 3) & (F.col("x1") - F.col("x0") >= page_width * 0.35)
    has = F.max(ruled.cast("int")).over(Window.partitionBy("page"))
    return tables.withColumn("_ruled", has).where(ruled | (aligned & (F.col("_ruled") == 0))).drop("_ruled")


def margin_frames(glyphs: DataFrame, *, page: Sequence[str], width: str, share: float = 0.05) -> DataFrame:
    """(page, side, rotation, text, x0, top, x1, bottom): rotated glyphs (``upright`` false, ``turn`` the sine of their matrix) in the outer margins as one identifier per side and rotation."""
    g = glyphs.where(~F.col("upright") & (F.coalesce("text", F.lit("")) != "") & ((F.col("x0") < F.col(width) * share) | (F.col("x1") > F.col(width) * (1 - share))))
    side, rotation = F.when(F.col("x0") < F.col(width) * 0.5, "left").otherwise("right"), F.when(F.col("turn") < 0, 270).otherwise(90)
    d = g.groupBy(*page, side.alias("side"), rotation.alias("rotation")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda t: t["text"]), "").alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")
    )
    return d.withColumn("text", F.btrim("text")).where("text <> ''")


def block_kind(*, top: Column, bottom: Column, page_height: Column, size: Column, body_size: Column, lines: Column, text: Column, bold: Column, in_table: Column) -> Column:
    """Kind of a block by its place and size (one that text_role understands); the first rule that holds. Bold text is a heading if it has two lines at most."""
    short = lines <= 2
    return (
        F.when(in_table, "table_cell").when(bottom < page_height * 0.06, "header").when(top > page_height * 0.94, "footer")
        .when((lines >= 3) & (F.length(text) >= 160), "paragraph").when(size >= F.greatest(F.lit(14.0), body_size * 1.7), "title")
        .when((size >= body_size * 1.15) | (bold & short), "heading").otherwise("paragraph")
    )


def attach_fragments(fragments: DataFrame, lines: DataFrame, *, page: Sequence[str], reach: float = 6.0) -> DataFrame:
    """(page, fragment, line): each isolated fragment with the line nearest by vertical, then horizontal gap, within ``reach``.

    Both sides meet on bands of ``reach`` in height, so a fragment sees three bands only.
    """
    f = fragments.select(*page, "fragment", F.col("x0").alias("fx0"), F.col("x1").alias("fx1"), ((F.col("top") + F.col("bottom")) / 2).alias("fm"))
    f = f.withColumn("band", F.explode(F.sequence(F.floor(F.col("fm") / reach).cast("bigint") - 1, F.floor(F.col("fm") / reach).cast("bigint") + 1)))
    l = lines.select(*page, "line", F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), ((F.col("top") + F.col("bottom")) / 2).alias("lm")).withColumn("band", F.floor(F.col("lm") / reach).cast("bigint"))
    dv = F.abs(F.col("fm") - F.col("lm"))
    dh = F.greatest(F.lit(0.0), F.col("lx0") - F.col("fx1"), F.col("fx0") - F.col("lx1"))
    j = f.join(l, [*page, "band"]).withColumn("dv", dv).withColumn("dh", dh).where(F.col("dv") <= reach)
    return j.groupBy(*page, "fragment").agg(F.min_by("line", F.struct("dv", "dh", "line")).alias("line"))
