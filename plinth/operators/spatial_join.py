"""Spatial joins as equi-joins on grid cells.

Each box is listed in the cells it covers and the lists meet in an equi-join, so
no pair is tried that shares no cell. A pair that shares several cells is kept in
the one that holds its reference point (the lower corner of the boxes'
overlap), which spares a distinct. Boxes that would cover more than ``most``
cells are listed at a coarser level of the grid instead: every box has a level,
and joins run level against level, so one huge box neither explodes nor needs a
broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.storage import spread

BOX = ("minx", "miny", "maxx", "maxy")
LEVELS = 12
#: Left rows of a cell that one group holds, and pairs that are looked at together.
GROUP, BLOCK = 1024, 1 << 18
#: Pairs of rows, near or not, that a cell's lists may make in one task; the left lists of a cell with more are dealt over several.
CROWD = 1 << 26
MOST_CELLS = 64


def cell_size(cell: float, level: Column) -> Column:
    """Width of a grid cell at a level."""
    return F.lit(float(cell)) * F.pow(F.lit(4.0), level)


def _span(cell: float, level: Column, low: str, high: str) -> Column:
    size = cell_size(cell, level)
    return F.floor(F.col(high) / size) - F.floor(F.col(low) / size) + 1


def own_level(cell: float, most: int) -> Column:
    """The finest level at which the box covers at most ``most`` cells."""
    found = F.lit(LEVELS)
    for level in range(LEVELS - 1, -1, -1):
        found = F.when(_span(cell, F.lit(level), "minx", "maxx") * _span(cell, F.lit(level), "miny", "maxy") <= most, F.lit(level)).otherwise(found)
    return found.cast("int")


def _listed(df: DataFrame, cell: float, levels: Column) -> DataFrame:
    """The rows of ``df`` once for each level and cell they are listed in."""
    rows = df.withColumn("__level", F.explode(levels)).withColumn("__size", cell_size(cell, F.col("__level")))
    for axis in "xy":
        span = F.sequence(F.floor(F.col(f"min{axis}") / F.col("__size")), F.floor(F.col(f"max{axis}") / F.col("__size")))
        rows = rows.withColumn(f"__c{axis}", F.explode(span))
    return rows


def _dealt(a: DataFrame, b: DataFrame, lists: str) -> tuple[DataFrame, DataFrame]:
    """Both sides, listed in cells, with the part (``__part``) of the cell that a row is in: a left row is in one part, a right row in all.

    They come dealt by cell and part, as both need it to be joined.
    """
    at = ["__cx", "__cy"]
    counts = [s.groupBy(*at).agg(F.sum(F.size(f"{n}__{lists}").cast("double")).alias(f"__n{n}"), F.count(F.lit(1)).alias(f"__k{n}")) for s, n in ((a, "l"), (b, "r"))]
    parts = F.least(F.ceil(F.col("__nl") * F.col("__nr") / CROWD), F.col("__kl")).cast("int")
    crowds = counts[0].join(counts[1], at).select(*at, parts.alias("__parts")).where("__parts > 1")  # few cells
    many = F.coalesce("__parts", F.lit(1))
    a = a.join(crowds, at, "left").withColumn("__part", F.pmod(F.xxhash64(f"l__{lists}"), many).cast("int"))
    b = b.join(crowds, at, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1)))
    return tuple(spread(s.drop("__parts"), *at, "__part") for s in (a, b))


def box_join(left: DataFrame, right: DataFrame, cell: float, reach: float = 0.0, most: int = MOST_CELLS, lists: str | None = None) -> DataFrame:
    """Pairs of rows whose boxes come within ``reach`` of each other on both axes.

    Both inputs hold BOX columns; the result has all columns of the left as
    ``l`` and of the right as ``r`` (two structs). Rows with a null in their box
    pair with nothing. Where a row stands for many, ``lists`` names the array of
    them on both sides, and cells are dealt to tasks by the pairs that these make.
    """
    grown = reach / 2
    sides = []
    for df, name in ((left, "l"), (right, "r")):
        row = df.where(" AND ".join(f"{c} IS NOT NULL" for c in BOX))
        row = row.select(*(F.col(f"`{c}`").alias(f"{name}__{c}") for c in df.columns), *((F.col(c) + (-grown if c.startswith("min") else grown)).alias(c) for c in BOX))
        sides.append(row.withColumn("__own", own_level(cell, most)))
    used = {row["__own"] for side in sides for row in side.select("__own").distinct().collect()}  # LEVELS + 1 rows at most
    out = None
    for at in sorted(used):
        # A pair meets at the coarser of its two levels; there both boxes cover few cells.
        a, b = (_listed(s.where(F.col("__own") <= at), cell, F.array(F.lit(at))) for s in sides)
        same = ["__cx", "__cy"]
        if lists:
            a, b = _dealt(a, b, lists)
            same.append("__part")
        a, b = a.alias("a"), b.alias("b")
        met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in same])
        met = met.where((F.greatest("a.__own", "b.__own") == at) & (F.col("a.minx") <= F.col("b.maxx")) & (F.col("b.minx") <= F.col("a.maxx")) & (F.col("a.miny") <= F.col("b.maxy")) & (F.col("b.miny") <= F.col("a.maxy")))
        for axis in "xy":
            met = met.where(F.floor(F.greatest(f"a.min{axis}", f"b.min{axis}") / F.col("a.__size")) == F.col(f"a.__c{axis}"))
        met = met.select(*(F.struct(*(F.col(f"{n}__{c}").alias(c) for c in df.columns)).alias(n) for df, n in ((left, "l"), (right, "r"))))
        out = met if out is None else out.unionByName(met)
    if out is None:
        return left.select(F.struct("*").alias("l")).limit(0).join(right.select(F.struct("*").alias("r")).limit(0))
    return out


def box_groups(left: DataFrame, right: DataFrame, cell: float, found, schema: str, reach: float = 0.0, most: int = MOST_CELLS) -> DataFrame:
    """``box_join`` inside tasks, for crowded cells: what ``found(l, r)`` makes of a group's rows.

    ``found`` gets two Arrow tables and returns a function of pairs (i, j; arrays of places in them), which is called
    with BLOCK pairs at most at a time and once more with None, and returns a table of ``schema`` or None. A group holds
    about GROUP left rows of a cell and the cell's right rows; each pair is in one group.
    """
    grown, sides = reach / 2, []
    for df in (left, right):
        row = df.where(" AND ".join(f"{c} IS NOT NULL" for c in BOX))
        row = row.withColumns({f"__{c}": F.col(c) + (-grown if c.startswith("min") else grown) for c in BOX})
        sides.append(row.withColumn("__own", own_level(cell, most)))
    used = sorted({row["__own"] for side in sides for row in side.select("__own").distinct().collect()})  # LEVELS + 1 rows at most
    if not used:
        return left.sparkSession.createDataFrame([], schema)
    levels = F.filter(F.array(*map(F.lit, used)), lambda x: x >= F.col("__own"))
    # Listed by the grown boxes.
    lists = []
    for side in sides:
        rows = side.withColumn("__level", F.explode(levels)).withColumn("__size", cell_size(cell, F.col("__level")))
        for axis in "xy":
            rows = rows.withColumn(f"__c{axis}", F.explode(F.sequence(F.floor(F.col(f"__min{axis}") / F.col("__size")), F.floor(F.col(f"__max{axis}") / F.col("__size")))))
        lists.append(rows)
    at = ["__level", "__cx", "__cy"]
    cells = lists[0].groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("__parts"))
    asks = lists[0].join(cells, at).withColumn("__part", F.pmod(F.xxhash64(*BOX), F.col("__parts")).cast("int")).drop("__parts")
    held = lists[1].join(cells, at).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    held = held.select(*(F.col(c).alias(f"r{c}") for c in held.columns))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.rename_columns([c[1:] for c in b.column_names])
        out = []
        if a.num_rows and b.num_rows:
            take = found(a, b)
            x, y = ({c: t[c].to_numpy() for c in (*(f"__{c}" for c in BOX), "__own")} for t in (a, b))
            size, level, here = a["__size"][0].as_py(), a["__level"][0].as_py(), [a[f"__c{axis}"][0].as_py() for axis in "xy"]
            step = max(1, BLOCK // b.num_rows)
            for start in range(0, a.num_rows, step):
                l = {c: v[start : start + step, None] for c, v in x.items()}
                met = np.maximum(l["__own"], y["__own"]) == level
                for axis, c in zip("xy", here, strict=True):
                    low, high = f"__min{axis}", f"__max{axis}"
                    met &= (l[low] <= y[high]) & (y[low] <= l[high]) & (np.floor(np.maximum(l[low], y[low]) / size) == c)
                i, j = np.nonzero(met)
                for k in range(0, len(i), BLOCK):  # one left row may have more
                    out.append(take((i[k : k + BLOCK] + start, j[k : k + BLOCK])))
            out.append(take(None))
        out = [t for t in out if t is not None]
        return pa.concat_tables(out) if out else empty

    empty = left.sparkSession.createDataFrame([], schema).toArrow()
    by = [*at, "__part"]
    to = [f"r{c}" for c in by]
    return spread(asks, *by).groupBy(*by).cogroup(spread(held, *to).groupBy(*to)).applyInArrow(run, schema)


def point_band_join(points: DataFrame, radius: float, key: str, x: str = "cx", y: str = "cy") -> DataFrame:
    """Ordered pairs of different rows whose points lie at most ``radius`` apart: l, r (structs) and d.

    Points sit in one cell of the radius's size; only the asking side is listed
    in the nine cells around it.
    """
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = {"__gx": F.floor(F.col(x) / F.lit(float(radius))), "__gy": F.floor(F.col(y) / F.lit(float(radius)))}
    held = rows.select(*(F.col(c).alias(f"r__{c}") for c in rows.columns), *(c.alias(n) for n, c in at.items()))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asks = rows.select(*(F.col(c).alias(f"l__{c}") for c in rows.columns), *(c.alias(n) for n, c in at.items())).withColumn("n", near)
    asks = asks.select(*(f"l__{c}" for c in rows.columns), (F.col("__gx") + F.col("n.i")).alias("__gx"), (F.col("__gy") + F.col("n.j")).alias("__gy"))
    d = F.sqrt(F.pow(F.col(f"l__{x}") - F.col(f"r__{x}"), 2) + F.pow(F.col(f"l__{y}") - F.col(f"r__{y}"), 2))
    met = asks.join(held, ["__gx", "__gy"]).where(F.col(f"l__{key}") != F.col(f"r__{key}"))
    sides = [F.struct(*(F.col(f"{n}__{c}").alias(c) for c in rows.columns)).alias(n) for n in "lr"]
    return met.withColumn("d", d).where(F.col("d") <= radius).select(*sides, "d")
