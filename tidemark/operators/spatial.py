"""Planar joins by grid cells: an equi-join on cells, then the exact distance.

Nothing here compares all with all.  A cell is as wide as the distance asked
for, so what can be in reach stands in the cells around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import staged


def cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def around(low_x: Column, low_y: Column, high_x: Column, high_y: Column, width: float, reach: float) -> Column:
    """All cells that a box, widened by ``reach``, touches, as an array of (cx, cy)."""
    xs = F.sequence(cell(low_x - reach, width), cell(high_x + reach, width))
    ys = F.sequence(cell(low_y - reach, width), cell(high_y + reach, width))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def along(x0: Column, y0: Column, x1: Column, y1: Column, width: float, reach: float) -> Column:
    """Cells within ``reach`` of a segment, and a few more: those around pieces two cells long, so as many as it is long."""
    count = F.greatest(F.ceil(F.hypot(x1 - x0, y1 - y0) / F.lit(2.0 * width)), F.lit(1)).cast("int")
    at = lambda a, b, k: a + (b - a) * k / count
    ends = lambda a, b, k: (at(a, b, k), at(a, b, k + 1))
    reach = reach + 1e-9 * width  # a piece's rounded end must not fall out of its cell
    piece = lambda k: around(F.least(*ends(x0, x1, k)), F.least(*ends(y0, y1, k)), F.greatest(*ends(x0, x1, k)), F.greatest(*ends(y0, y1, k)), width, reach)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), count - 1), piece)))


def point_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.least(((px - x0) * dx + (py - y0) * dy) / F.nullif(size, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def crossing_at(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """struct(x, y) where two segments cross; null if they do not, or run alongside each other."""
    dax, day, dbx, dby = ax1 - ax0, ay1 - ay0, bx1 - bx0, by1 - by0
    det = dax * dby - day * dbx
    t = ((bx0 - ax0) * dby - (by0 - ay0) * dbx) / F.nullif(det, F.lit(0.0))
    u = ((bx0 - ax0) * day - (by0 - ay0) * dax) / F.nullif(det, F.lit(0.0))
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.struct((ax0 + t * dax).alias("x"), (ay0 + t * day).alias("y")))


def overlap_at(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """struct(x, y, run): the middle and length of what two segments on one line share, ``run`` 0 where that is a point; else null."""
    dx, dy = ax1 - ax0, ay1 - ay0
    size = dx * dx + dy * dy
    on = lambda px, py: ((px - ax0) * dx + (py - ay0) * dy) / F.nullif(size, F.lit(0.0))
    off = lambda px, py: F.abs((px - ax0) * dy - (py - ay0) * dx) <= 1e-9 * size
    low = F.greatest(F.lit(0.0), F.least(on(bx0, by0), on(bx1, by1)))
    high = F.least(F.lit(1.0), F.greatest(on(bx0, by0), on(bx1, by1)))
    middle = (low + high) / 2
    shared = F.struct((ax0 + middle * dx).alias("x"), (ay0 + middle * dy).alias("y"), ((high - low) * F.sqrt(size)).alias("run"))
    return F.when(off(bx0, by0) & off(bx1, by1) & (low <= high), shared)


def segment_segment(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Distance between two segments; 0 where they cross."""
    ends = F.least(
        point_segment(ax0, ay0, bx0, by0, bx1, by1), point_segment(ax1, ay1, bx0, by0, bx1, by1),
        point_segment(bx0, by0, ax0, ay0, ax1, ay1), point_segment(bx1, by1, ax0, ay0, ax1, ay1),
    )
    return F.when(crossing_at(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1).isNotNull(), F.lit(0.0)).otherwise(ends)


def filed(segments: DataFrame, width: float, reach: float) -> DataFrame:
    """``segments`` (x0 to y1), in pieces of at most two cells, once for each cell (cx, cy) of a piece's box widened by ``reach``: with the box, low_x to high_y."""
    count = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.lit(2.0 * width)), F.lit(1)).cast("int")
    pieces = segments.withColumn("__n", count).select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__k"))
    reach = reach + 1e-9 * width  # a piece's rounded end must not fall out of its cell
    box = {}
    for p in "xy":
        one, two = (F.col(f"{p}0") + (F.col(f"{p}1") - F.col(f"{p}0")) * k / F.col("__n") for k in (F.col("__k"), F.col("__k") + 1))
        box |= {f"low_{p}": F.least(one, two) - reach, f"high_{p}": F.greatest(one, two) + reach}
    boxed = pieces.withColumns(box).drop("__n", "__k")
    across = boxed.select("*", F.explode(F.sequence(cell(F.col("low_x"), width), cell(F.col("high_x"), width))).alias("cx"))
    return across.select("*", F.explode(F.sequence(cell(F.col("low_y"), width), cell(F.col("high_y"), width))).alias("cy"))


def meeting(a: DataFrame, b: DataFrame, cells: list[str], width: float) -> DataFrame:
    """Pairs of ``filed`` pieces, the second's columns but ``cells`` after ``o``, whose boxes meet: each pair once, in the cell of the lower corner of what the boxes share."""
    # By cell, in a number of partitions that stays: the work is in the pairs, which the bytes read do not show.
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.repartition(parts, *cells).join(b.select(*[F.col(c) if c in cells else F.col(c).alias(f"o{c}") for c in b.columns]), cells)
    for p in "xy":
        low = F.greatest(f"low_{p}", f"olow_{p}")
        met = met.where((low <= F.least(f"high_{p}", f"ohigh_{p}")) & (cell(low, width) == F.col(f"c{p}")))
    return met


def directed(segments: DataFrame) -> DataFrame:
    """``segments`` with dx, dy and size, the squared length."""
    run = segments.withColumns({"dx": F.col("x1") - F.col("x0"), "dy": F.col("y1") - F.col("y0")})
    return run.withColumn("size", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))


def squared_gaps(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``gap``: the squared distance between two segments, given as x0 to y1, dx, dy and size (squared length), and the same after ``o``.

    The same as ``segment_segment``, in steps: what a step needs twice is a
    column of the one before, and no step grows too large to be compiled.
    """
    ends, col = {}, F.col
    for name, (px, py), o in (("a0", ("x0", "y0"), "o"), ("a1", ("x1", "y1"), "o"), ("b0", ("ox0", "oy0"), ""), ("b1", ("ox1", "oy1"), "")):
        along_it = ((col(px) - col(f"{o}x0")) * col(f"{o}dx") + (col(py) - col(f"{o}y0")) * col(f"{o}dy")) / F.nullif(col(f"{o}size"), F.lit(0.0))
        ends[f"__{name}"] = F.greatest(F.least(along_it, F.lit(1.0)), F.lit(0.0))
    det = col("dx") * col("ody") - col("dy") * col("odx")
    steps = pairs.withColumns(ends | {"__det": F.nullif(det, F.lit(0.0)), "__ex": col("ox0") - col("x0"), "__ey": col("oy0") - col("y0")})
    off = {}
    for name, (px, py), o in (("a0", ("x0", "y0"), "o"), ("a1", ("x1", "y1"), "o"), ("b0", ("ox0", "oy0"), ""), ("b1", ("ox1", "oy1"), "")):
        off[f"__{name}x"] = col(px) - (col(f"{o}x0") + col(f"__{name}") * col(f"{o}dx"))
        off[f"__{name}y"] = col(py) - (col(f"{o}y0") + col(f"__{name}") * col(f"{o}dy"))
    steps = steps.withColumns(off | {"__t": (col("__ex") * col("ody") - col("__ey") * col("odx")) / col("__det"), "__u": (col("__ex") * col("dy") - col("__ey") * col("dx")) / col("__det")})
    least = F.least(*[col(f"__{n}x") * col(f"__{n}x") + col(f"__{n}y") * col(f"__{n}y") for n in ("a0", "a1", "b0", "b1")])
    crosses = col("__t").between(0.0, 1.0) & col("__u").between(0.0, 1.0)
    return steps.select(*keys, F.when(crosses, F.lit(0.0)).otherwise(least).alias("gap"))


def within_segments(points: DataFrame, segments: DataFrame, reach: float, closed: bool = True) -> DataFrame:
    """``points`` (x, y) within ``reach`` of any segment (x0, y0, x1, y1); the rim belongs to it if ``closed``."""
    spread = segments.select("x0", "y0", "x1", "y1", F.explode(along(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), reach, reach)).alias("c"))
    spread = spread.select("x0", "y0", "x1", "y1", F.col("c.cx").alias("__cx"), F.col("c.cy").alias("__cy"))
    own = points.withColumns({"__cx": cell(F.col("x"), reach), "__cy": cell(F.col("y"), reach)})
    away = point_segment(own.x, own.y, spread.x0, spread.y0, spread.x1, spread.y1)
    near = away <= reach if closed else away < reach
    return own.join(spread, (own["__cx"] == spread["__cx"]) & (own["__cy"] == spread["__cy"]) & near, "left_semi").drop("__cx", "__cy")


#: Points that a cell of the tree holds at most, what splits it (in each direction), and the deepest level: a double tells no more places apart.
LEAF, FAN, DEEPEST = 8, 4, 24


def _at(level: Column) -> tuple[Column, Column]:
    """The cell of a place (x, y) of a tree with corner (x0, y0) and width ``span``."""
    width = F.col("span") / F.pow(F.lit(float(FAN)), level)
    return F.floor((F.col("x") - F.col("x0")) / width).cast("long"), F.floor((F.col("y") - F.col("y0")) / width).cast("long")


def cell_tree(points: DataFrame, groups: list[str], leaf: int = LEAF) -> DataFrame:
    """``points`` (x, y) with x0, y0, span and ``level``: that of their cell in a tree whose cells are split while they hold more than ``leaf``.

    One tree for each group.  A full cell goes down as many levels at once as
    its count calls for, so even points need one round and others a few; the
    points of cells that are done are not counted again.
    """
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    extent = points.groupBy(*groups).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.when(span > 0, span * (1 + 1e-9)).otherwise(F.lit(1.0)).alias("span"))
    active, done = points.join(extent, groups).withColumn("level", F.lit(0)), None
    keys = [*groups, "level", "cx", "cy"]
    while True:
        cx, cy = _at(F.col("level"))
        active = staged(active.withColumns({"cx": cx, "cy": cy}))
        down = F.greatest(F.lit(1), F.ceil(F.log(F.col("n") / leaf) / F.log(F.lit(float(FAN * FAN)))).cast("int"))
        full = active.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > leaf) & (F.col("level") < DEEPEST)).withColumn("below", F.least(F.col("level") + down, F.lit(DEEPEST))).drop("n")
        full = staged(full)
        rest = active.join(full, keys, "left_anti").drop("cx", "cy")
        done = rest if done is None else done.unionByName(rest)
        if full.isEmpty():
            return done
        active = active.join(full, keys).withColumn("level", F.col("below")).drop("below", "cx", "cy")


def nearest_other(points: DataFrame, group: str | list[str], key: str, leaf: int = LEAF) -> DataFrame:
    """(group, key, nearest_dist): distance to the nearest other point of the group.

    Points at one place are told first: their distance is 0.  The others look
    in the cells around their leaf of a ``cell_tree``, with all points filed at
    the levels that are asked for.  Who finds none within a cell's width looks
    again in cells ``FAN`` times as wide.  Whoever does is farther than a
    width from everybody, so a cell has only a few of them: a point is compared
    with a bounded number of others on each level, however dense it stands.
    Points alone in their group have none.
    """
    groups = [group] if isinstance(group, str) else list(group)
    known = staged(points.select(*groups, key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL"))
    place = [*groups, "x", "y"]
    places = staged(known.groupBy(*place).agg(F.min(key).alias(key), (F.min(key) != F.max(key)).alias("shared")))
    found = known.join(places.where("shared").select(*place), place).select(*groups, key, F.lit(0.0).alias("nearest_dist"))
    tree = staged(cell_tree(places, groups, leaf))
    left, origin = tree.where("NOT shared"), ["x0", "y0", "span"]
    while True:
        levels = sorted(r.level for r in left.select("level").distinct().collect())  # at most DEEPEST
        if not levels:
            return found.groupBy(*groups, key).agg(F.min("nearest_dist").alias("nearest_dist"))
        cx, cy = _at(F.col("level"))
        around_it = F.array(*[F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        own = left.select(*place, key, "span", "level", F.explode(around_it).alias("c")).select(*place, key, "span", "level", "c.cx", "c.cy")
        filed = tree.select(*place, *origin, F.col(key).alias("other"), F.explode(F.array(*[F.lit(k) for k in levels])).alias("level")).withColumns({"cx": cx, "cy": cy})
        filed = filed.select(*groups, "level", "cx", "cy", "other", F.col("x").alias("ox"), F.col("y").alias("oy"))
        away = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
        near = own.join(filed, [*groups, "level", "cx", "cy"]).where(F.col(key) != F.col("other")).groupBy(*place, key, "span", "level").agg(F.min(away).alias("nearest_dist"))
        sure = staged(near.where((F.col("nearest_dist") <= F.col("span") / F.pow(F.lit(float(FAN)), F.col("level"))) | (F.col("level") == 0)))
        found = found.unionByName(sure.select(*groups, key, "nearest_dist"))
        left = staged(left.where("level > 0").join(sure.select(*place), place, "left_anti").withColumn("level", F.col("level") - 1))


def nearest_segments(lines: DataFrame, keys: list[str], others: DataFrame, columns: list[str], width: float | None = None) -> DataFrame:
    """keys, d and what belongs to it: the nearest pair of a segment of each line (seg, x0 to y1) and one of ``others``.

    ``columns``: those of ``others`` that break ties and are passed on with its
    ends, as ``s`` and the name.  Cells are first twice as wide as segments are
    long (unless ``width`` says how wide), so that few share one.  Neighbours
    within a cell's width settle their lines; the others look in cells four
    times as wide, and so on, until none is left or a cell is as wide as everything.
    """
    ends = ["x0", "y0", "x1", "y1"]
    left, shore = staged(lines.select(*keys, "seg", *ends)), staged(others.select(*columns, *ends))
    both = left.select(*ends).union(shore.select(*ends))
    x, y = (F.greatest(F.max(f"{c}0"), F.max(f"{c}1")) - F.least(F.min(f"{c}0"), F.min(f"{c}1")) for c in "xy")
    span, mean = both.agg(F.greatest(x, y), F.avg(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()
    found, width = None, float(width or 2 * (mean or 0) or 1)
    passed = [*[F.col(f"o{c}").alias(f"s{c}") for c in columns], "seg", *ends, *[F.col(f"o{c}").alias(f"s{c}") for c in ends]]
    while True:
        last = span is None or width > span
        met = meeting(filed(directed(left), width, 0.0), filed(directed(shore), width, width), ["cx", "cy"], width)
        met = squared_gaps(met, [*keys, *passed]).withColumn("d", F.sqrt("gap"))
        met = met if last else met.where(F.col("d") <= width)
        rest = [*[f"s{c}" for c in columns], "seg", *ends, *[f"s{c}" for c in ends]]
        sure = staged(met.groupBy(*keys).agg(F.min(F.struct("d", *rest)).alias("b")).select(*keys, "b.*"))
        found = sure if found is None else found.unionByName(sure)
        if last:
            return found
        left = staged(left.join(sure.select(*keys), keys, "left_anti"))
        if left.isEmpty():
            return found
        width *= 4
