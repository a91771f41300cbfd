"""Point clouds to polar and range grids, and operators on grids.

Grids are long: one row ``scan_id, row, col, ...`` a filled cell, so that they are plain
hash aggregations which combine before the shuffle; an absent cell is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586


def finite(*cols: str) -> Column:
    """PF-01: all coordinates are numbers."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def bin_of(u: Column, n: int) -> Column:
    """PF-04: the bin of a share in 0 to 1, clipped to the grid."""
    return F.least(F.greatest(F.floor(u * n), F.lit(0)), F.lit(n - 1)).cast("int")


def azimuth(x: Column, y: Column) -> Column:
    """PF-03: angle in 0 to two pi."""
    return F.pmod(F.atan2(y, x) + F.pi(), F.lit(TWO_PI))


def range_image(points: DataFrame, rows: int, cols: int, r_min: float, r_max: float, e_min: float, e_max: float) -> DataFrame:
    """A-01: least range per elevation and azimuth cell, and the largest intensity among the points that attain it.

    ``r_min`` and ``r_max`` are inclusive; elevations in degrees.
    """
    squares = F.least(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"), F.lit(1e10))
    seen = points.where(finite("x", "y", "z")).withColumn("r", F.sqrt(squares)).where((F.col("r") >= r_min) & (F.col("r") <= r_max))
    elevation = F.degrees(F.asin(F.col("z") / F.greatest("r", F.lit(1e-8))))
    cell = seen.select(
        "scan_id",
        bin_of((elevation - e_min) / (e_max - e_min), rows).alias("row"),
        bin_of(azimuth(F.col("x"), F.col("y")) / TWO_PI, cols).alias("col"),
        F.struct(F.col("r").alias("r"), (-F.col("intensity")).alias("minus")).alias("hit"),
    )
    least = cell.groupBy("scan_id", "row", "col").agg(F.min("hit").alias("hit"))
    return least.select("scan_id", "row", "col", F.col("hit.r").alias("range"), (-F.col("hit.minus")).alias("intensity"))


def polar_cells(points: DataFrame, rings: int, sectors: int, r_max: float, r_min: float = 0.0, z_min: float | None = None, open_low: bool = False) -> DataFrame:
    """PF-02 to PF-04: points with their ring and sector; the range is half open, or open if ``open_low``."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    seen = points.where(finite("x", "y", "z")).withColumn("r", r)
    seen = seen.where((F.col("r") > r_min) if open_low else (F.col("r") >= r_min)).where(F.col("r") < r_max)
    if z_min is not None:
        seen = seen.where(F.col("z") > z_min)
    return seen.withColumn("row", bin_of((F.col("r") - (0.0 if open_low else r_min)) / (r_max - (0.0 if open_low else r_min)), rings)).withColumn("col", bin_of(azimuth(F.col("x"), F.col("y")) / TWO_PI, sectors))


def max_height(cells: DataFrame) -> DataFrame:
    """A-02, A-05: largest height per cell."""
    return cells.groupBy("scan_id", "row", "col").agg(F.max("z").alias("val"))


def layer_code(cells: DataFrame, z_min: float, z_max: float, layers: int) -> DataFrame:
    """A-03, A-06: one bit per height layer that has a point."""
    layer = bin_of((F.col("z") - z_min) / (z_max - z_min), layers)
    return cells.groupBy("scan_id", "row", "col").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), layer)).alias("code"))


def physics3(cells: DataFrame, z_min: float, z_max: float, ring_width: float) -> DataFrame:
    """A-04: three channels per cell: normalised height, density scaled by the scan's largest, normalised span."""
    own = cells.groupBy("scan_id", "row", "col").agg(F.max("z").alias("top"), F.min("z").alias("low"), F.count(F.lit(1)).alias("n"))
    radius = (F.col("row") + 0.5) * ring_width
    dense = own.withColumn("d", F.log1p(F.col("n") / radius))
    # at most rows x cols rows a scan
    most = F.max("d").over(Window.partitionBy("scan_id"))
    height = F.least(F.greatest((F.col("top") - z_min) / (z_max - z_min), F.lit(0.0)), F.lit(1.0))
    return dense.select("scan_id", "row", "col", height.alias("height"), (F.col("d") / most).alias("density"), ((F.col("top") - F.col("low")) / (z_max - z_min)).alias("span"))


def cartesian_max(points: DataFrame, side: int, half: float) -> DataFrame:
    """A-07: largest height per square cell over 256."""
    seen = points.where(finite("x", "y", "z") & (F.abs("x") < half) & (F.abs("y") < half))
    cell = seen.select("scan_id", bin_of((F.col("x") + half) / (2 * half), side).alias("row"), bin_of((F.col("y") + half) / (2 * half), side).alias("col"), "z")
    return cell.groupBy("scan_id", "row", "col").agg((F.max("z") / 256).alias("val"))


def ring_key(grid: DataFrame, rings: int, sectors: int) -> DataFrame:
    """A-10: mean over the sectors of each ring (empty cells are 0), scaled to unit length."""
    sums = grid.groupBy("scan_id", "row").agg((F.sum("val") / sectors).alias("m"))
    every = sums.select("scan_id").distinct().select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(rings - 1))).alias("row"))
    full = every.join(sums, ["scan_id", "row"], "left").na.fill(0.0, ["m"])
    keys = full.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "m"))), lambda x: x.m).alias("k"))
    norm = F.sqrt(F.aggregate("k", F.lit(0.0), lambda a, x: a + x * x))
    return keys.select("scan_id", F.transform("k", lambda x: x / F.greatest(norm, F.lit(1e-8))).alias("key"))


def adaptive_windows(n: int, m: int) -> list[tuple[int, int]]:
    """A-09: the window of each of ``m`` outputs over ``n`` inputs; windows overlap where ``m`` doesn't divide ``n``."""
    return [(i * n // m, -(-(i + 1) * n // m)) for i in range(m)]


def channel_windows(n: int, m: int, channels: int) -> list[tuple[int, int]]:
    """A-09: windows that don't reach over the borders of ``channels`` equal parts of the inputs."""
    if n % channels or m % channels:
        raise ValueError(f"{n} inputs and {m} outputs aren't equal parts of {channels} channels")
    own = adaptive_windows(n // channels, m // channels)
    return [(a + c * (n // channels), b + c * (n // channels)) for c in range(channels) for a, b in own]


def pool(grid: DataFrame, axis: str, n: int, m: int, channels: int = 1, how: str = "mean") -> DataFrame:
    """A-09: adaptive average (``mean``) or ``max`` along ``row`` or ``col``, each of ``channels`` equal parts by itself; empty cells are 0."""
    other = "col" if axis == "row" else "row"
    spans = F.array(*[F.struct(F.lit(i).alias("out"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(channel_windows(n, m, channels))])
    mine = F.filter(spans, lambda s: (F.col(axis) >= s.a) & (F.col(axis) < s.b))
    spread = grid.select("scan_id", other, "val", F.explode(mine).alias("s"))
    width = F.first(F.col("s.b") - F.col("s.a"))
    # a window with an empty cell has a 0 in it
    most = F.when(F.count(F.lit(1)) < width, F.greatest(F.max("val"), F.lit(0.0))).otherwise(F.max("val"))
    value = most if how == "max" else F.sum("val") / width
    return spread.groupBy("scan_id", other, F.col("s.out").alias(axis)).agg(value.alias("val")).select("scan_id", "row", "col", "val")


def fill_gaps(grid: DataFrame, cols: int) -> DataFrame:
    """W-09: empty cells of a row that has some value, linear between its circular neighbours.

    Each row's values (at most ``cols`` of them) stand in order; each empty column blends the last value before
    and the first after, wrapping round.
    """
    rows = grid.groupBy("scan_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("have"))
    n = F.size("have")
    nxt = F.transform("have", lambda x, i: F.struct(x.col.alias("c0"), x.val.alias("v0"), F.when(i + 1 < n, F.get("have", i + 1)["col"]).otherwise(F.get("have", F.lit(0))["col"] + cols).alias("c1"), F.when(i + 1 < n, F.get("have", i + 1)["val"]).otherwise(F.get("have", F.lit(0))["val"]).alias("v1")))
    spans = rows.select("scan_id", "row", F.inline(nxt))
    every = spans.select("scan_id", "row", "c0", "c1", "v0", "v1", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("c"))
    share = (F.col("c") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    return every.select("scan_id", "row", (F.col("c") % cols).cast("int").alias("col"), (F.col("v0") + (F.col("v1") - F.col("v0")) * share).alias("val"))


def fill_rows(images: DataFrame, rows: int) -> DataFrame:
    """W-09: copy each all-empty row from the nearest row with values, the upper one first, in place and in order.

    ``images``: ``scan_id, grid`` with ``grid`` an array of row arrays.  Filled rows are sources for later ones, so
    this is a fold over the rows of an image (bounded by its height).
    """

    def empty(r: Column) -> Column:
        return F.coalesce(~F.exists(r, lambda v: v != 0), F.lit(True))

    def step(acc: Column, i: Column) -> Column:
        def pick(out: Column, o: Column) -> Column:
            up, down = i - o, i + o
            a = F.when(up >= 0, F.get(acc, up))
            b = F.when(down < rows, F.get(acc, down))
            return F.coalesce(out, F.when(~empty(a), a), F.when(~empty(b), b))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(rows)), F.lit(None).cast("array<double>"), pick)
        filled = F.when(empty(F.get(acc, i)), F.coalesce(found, F.get(acc, i))).otherwise(F.get(acc, i))
        return F.transform(acc, lambda r, k: F.when(k == i, filled).otherwise(r))

    return images.select("scan_id", F.aggregate(F.sequence(F.lit(0), F.lit(rows - 1)), F.col("grid"), step).alias("grid"))


def unproject(image: DataFrame, rows: int, cols: int, e_min: float, e_max: float) -> DataFrame:
    """PF-05: a point per filled cell, at the lower edge of its bins."""
    el = F.radians(F.lit(e_min) + F.col("row") * ((e_max - e_min) / rows))
    az = F.col("col") * (TWO_PI / cols) - F.pi()
    r = F.col("range")
    return image.where("range > 0").select("scan_id", "row", "col", (r * F.cos(el) * F.cos(az)).alias("x"), (r * F.cos(el) * F.sin(az)).alias("y"), (r * F.sin(el)).alias("z"))


def yaw_rotate(points: DataFrame, radians: float) -> DataFrame:
    """PF-06: turn about the vertical axis."""
    c, s = F.cos(F.lit(radians)), F.sin(F.lit(radians))
    return points.withColumns({"x": c * F.col("x") - s * F.col("y"), "y": s * F.col("x") + c * F.col("y")})


def image_difference(a: DataFrame, b: DataFrame, val: str, relative: float = 0.0) -> DataFrame:
    """F-11: mean difference ratio over cells that both images of a scan fill; 1.0 where none is."""
    both = a.select("scan_id", "row", "col", F.col(val).alias("p")).join(b.select("scan_id", "row", "col", F.col(val).alias("q")), ["scan_id", "row", "col"])
    ratio = F.abs(F.col("p") - F.col("q")) / F.greatest(F.col("p") + F.lit(relative), F.lit(1e-8))
    got = both.where("p > 0 and q > 0").groupBy("scan_id").agg(F.avg(ratio).alias("d"))
    return a.select("scan_id").distinct().join(got, "scan_id", "left").na.fill(1.0, ["d"])


def voxel_iou(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """F-12: intersection over union of occupied voxels; ``a`` and ``b`` have ``pair_id, x, y, z``."""

    def voxels(p: DataFrame, name: str) -> DataFrame:
        keys = [F.floor(F.col(c) / size).alias("v" + c) for c in "xyz"]
        return p.select("pair_id", *keys).distinct().withColumn(name, F.lit(1))

    both = voxels(a, "ina").join(voxels(b, "inb"), ["pair_id", "vx", "vy", "vz"], "full")
    return both.groupBy("pair_id").agg((F.sum(F.coalesce(F.col("ina") * F.col("inb"), F.lit(0))) / F.count(F.lit(1))).alias("iou"))
