"""Boxes on pages: spatial joins over a grid, label transfer, and reading order.

A box has page, x1, y1, x2, y2 (edges included).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels and their priority.
PRIORITY = {"CNIC": 7, "AMOUNT": 6, "DATE": 5, "REGISTRY_NO": 4, "PLOT_NO": 3, "SCHEME_NAME": 2, "PERSON_NAME": 1}
LEAST_IOU = 0.3
CELL = 100
#: Words of a page from which the grid is worth its copies: a large note lies in some thirty cells.
CROWDED = 256


def _cells(df: DataFrame, cell: int, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """A row for each grid cell that a box touches; boxes that end before they begin touch none."""
    at = lambda c: F.floor(F.col(c) / cell)
    cells = F.flatten(F.transform(F.sequence(at(x1), at(x2)), lambda cx: F.transform(F.sequence(at(y1), at(y2)), lambda cy: F.struct(cx.alias("_cx"), cy.alias("_cy")))))
    return df.where((F.col(x1) <= F.col(x2)) & (F.col(y1) <= F.col(y2))).select("*", F.explode(cells).alias("_c")).select(*df.columns, "_c.*")


def _whole(df: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    return df.where((F.col(x1) <= F.col(x2)) & (F.col(y1) <= F.col(y2)))


def _parts(words: DataFrame, notes: DataFrame, cell: int, crowded: int) -> tuple[DataFrame, DataFrame]:
    """touching()'s pairs of pages with few words, and of crowded ones; a page is in one part."""
    many = words.groupBy("page").agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).select("page")
    x, y = F.greatest("x1", "ax1"), F.greatest("y1", "ay1")
    meet = (x <= F.least("x2", "ax2")) & (y <= F.least("y2", "ay2"))
    few = _whole(words, "x1", "y1", "x2", "y2").join(many, "page", "left_anti").join(_whole(notes, "ax1", "ay1", "ax2", "ay2"), "page").where(meet)
    left = _cells(words.join(many, "page", "left_semi"), cell, "x1", "y1", "x2", "y2")
    right = _cells(notes.join(many, "page", "left_semi"), cell, "ax1", "ay1", "ax2", "ay2")
    both = left.join(right, ["page", "_cx", "_cy"])
    return few, both.where(meet & (F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy"))).drop("_cx", "_cy")


def touching(words: DataFrame, notes: DataFrame, cell: int = CELL, crowded: int = CROWDED) -> DataFrame:
    """Pairs of a word (x1..y2) and a note (ax1..ay2) of one page whose boxes touch, each once.

    On pages of up to `crowded` words, notes meet all of them: nothing is
    copied.  On others, both are dealt to the cells of a grid that they touch
    and meet by (page, cell), so no crowded page is compared with itself whole
    and it is split by cell.  A pair that shares several cells is kept in the
    one that holds the upper left corner of what the boxes share.
    """
    few, many = _parts(words, notes, cell, crowded)
    return few.unionByName(many)


def _tier() -> Column:
    """1: IoU of LEAST_IOU or more; 2: the note's centre lies in the word; 3: the word's centre lies in the note."""
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "ax1", "ay1", "ax2", "ay2")}
    wide = F.greatest(F.lit(0), F.least(c["x2"], c["ax2"]) - F.greatest(c["x1"], c["ax1"]))
    high = F.greatest(F.lit(0), F.least(c["y2"], c["ay2"]) - F.greatest(c["y1"], c["ay1"]))
    shared = wide * high
    union = (c["x2"] - c["x1"]) * (c["y2"] - c["y1"]) + (c["ax2"] - c["ax1"]) * (c["ay2"] - c["ay1"]) - shared
    inside = ((c["ax1"] + c["ax2"]) / 2).between(c["x1"], c["x2"]) & ((c["ay1"] + c["ay2"]) / 2).between(c["y1"], c["y2"])
    around = ((c["x1"] + c["x2"]) / 2).between(c["ax1"], c["ax2"]) & ((c["y1"] + c["y2"]) / 2).between(c["ay1"], c["ay2"])
    return F.when((union > 0) & (shared / F.nullif(union, F.lit(0)) >= LEAST_IOU), 1).when(inside, 2).when(around, 3)


def matched(words: DataFrame, notes: DataFrame, cell: int = CELL, crowded: int = CROWDED) -> DataFrame:
    """(columns of words and notes, tier): the words that each note (page, note, label, ax1..ay2) stands for.

    Of the tiers that a note reaches on its page, only the first counts.
    """
    best = F.min("tier").over(Window.partitionBy("page", "note"))
    # Each part by itself, as pairs of the first are dealt by page already.
    few, many = (pairs.withColumn("tier", _tier()).where("tier IS NOT NULL").withColumn("_best", best).where("tier = _best").drop("_best") for pairs in _parts(words, notes, cell, crowded))
    return few.unionByName(many)


def labelled(words: DataFrame, notes: DataFrame, key: list[str], cell: int = CELL) -> DataFrame:
    """(key, tag) of every word: B- or I- and the label of the note of highest priority that stands for it, else O.

    key identifies a word within all pages.  The first of a note's words in
    reading order (y1, x1, key) begins it; of equal priorities the smaller note
    wins; labels without a priority don't count.
    """
    ranked = notes.withColumn("priority", F.element_at(F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv]), F.col("label"))).where("priority IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("page", "note").orderBy("y1", "x1", *key)) == 1
    tagged = matched(words, ranked, cell).withColumn("tag", F.concat(F.when(first, "B-").otherwise("I-"), "label"))
    tags = tagged.groupBy(*key).agg(F.max_by("tag", F.struct("priority", -F.col("note"))).alias("tag"))
    return words.join(tags, key, "left").select(*key, F.coalesce("tag", F.lit("O")).alias("tag"))


LEAST_TOLERANCE, SHARE_OF_HEIGHT = 10, 0.05


def in_reading_order(boxes: DataFrame, order: list[str], rtl: Column) -> DataFrame:
    """boxes (page, x, y, w, h, ...) with row and pos, both from 0 within the page.

    Boxes are taken in the given order; one joins the first row that has any
    box whose vertical centre is within the tolerance (a twentieth of the
    page's mean height, 10 at least), else it opens a row.  So rows depend on
    the order and aren't bins: two boxes on both sides of any line stay
    together if they are near.  Within a row boxes go by y, then by x, from the
    right where `rtl` holds.  A page's boxes are one array, a fold over it
    assigns rows.
    """
    centre = F.col("y") + F.floor(F.col("h") / 2)
    box = F.struct(*[F.col(c) for c in order], F.struct(*[c for c in boxes.columns if c != "page"]).alias("box"), centre.cast("long").alias("c"), rtl.alias("rtl"))
    pages = boxes.groupBy("page").agg(F.sort_array(F.collect_list(box)).alias("boxes"), F.avg("h").alias("height"))
    tolerance = F.greatest(F.lit(LEAST_TOLERANCE).cast("long"), (F.col("height") * SHARE_OF_HEIGHT).cast("long"))

    def place(done: Column, b: Column) -> Column:
        near = F.array_min(F.transform(F.filter(done, lambda d: F.abs(d["c"] - b["c"]) <= F.col("_tolerance")), lambda d: d["row"]))
        fresh = F.coalesce(F.array_max(F.transform(done, lambda d: d["row"])) + 1, F.lit(0))
        return F.array_append(done, F.struct(F.coalesce(near, fresh).cast("int").alias("row"), b["c"].alias("c")))

    none = F.array().cast("array<struct<row:int,c:bigint>>")
    rows = pages.withColumn("_tolerance", tolerance).withColumn("_rows", F.aggregate("boxes", none, place))
    flat = rows.select("page", F.explode(F.arrays_zip("boxes", "_rows")).alias("_z")).select("page", "_z.boxes.box.*", F.col("_z._rows.row").alias("row"), F.col("_z.boxes.rtl").alias("_rtl"))
    along = F.when(F.col("_rtl"), -F.col("x")).otherwise(F.col("x"))
    w = Window.partitionBy("page").orderBy("row", "y", along, *order)
    return flat.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("_rtl")
