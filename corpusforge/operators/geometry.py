"""Vectors in the plane and boxes on pages: PCA maps, intersections, gaps and gutters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    return F.coalesce(w * h / F.nullif(area(a) + area(b) - w * h, F.lit(0.0)), F.lit(0.0))


def union(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Smallest box around each group's boxes (x0, y0, x1, y1), four digits."""
    return boxes.groupBy(*by).agg(F.round(F.min("x0"), 4).alias("x0"), F.round(F.min("y0"), 4).alias("y0"), F.round(F.max("x1"), 4).alias("x1"), F.round(F.max("y1"), 4).alias("y1"))


def decoded_box(raw: Column, rows_first: Column) -> Column:
    """A model's box of four numbers from 0 to 1000 as shares x0, y0, x1, y1 of the page, y before x where rows_first; null where it is no box."""
    part = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(raw, F.lit(i)).cast("double") / 1000))
    at = lambda i, j: F.when(rows_first, part(j)).otherwise(part(i))
    box = F.struct(at(0, 1).alias("x0"), at(1, 0).alias("y0"), at(2, 3).alias("x1"), at(3, 2).alias("y1"))
    whole = (F.size(raw) == 4) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.when(whole & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def largest_gap(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Widest gap between merged intervals (a, z) of each group: by, start, width; none: no row."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    gaps = intervals.withColumn("reach", F.max("z").over(w)).where("a > reach").select(*by, F.col("reach").alias("start"), (F.col("a") - F.col("reach")).alias("width"))
    return gaps.groupBy(*by).agg(F.max(F.struct("width", (-F.col("start")).alias("s"))).alias("m")).select(*by, (-F.col("m.s")).alias("start"), F.col("m.width").alias("width"))


def gutter_is_grid(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, is_grid: whether a gutter parts the columns of one table rather than two columns of prose.

    lines: by, is_left, y0, y1, text.  A grid has two lines a side at least, rows in common (four
    fifths of the shorter side, the left one among equals, within 0.35 of the median height), and
    numbers as half of one side or nothing but cells.  The nearest line across is found in one pass
    over the sorted lines.
    """
    from pyspark.sql import Window

    from .regions import is_number

    w = Window.partitionBy(*by).orderBy("cy")
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    p = lines.withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("num", is_number(F.col("text")))
    p = p.withColumn("cell", F.col("num") | ((F.size(F.split(F.trim("text"), r"\s+")) <= 4) & ~F.rtrim("text").endswith(".")))
    far = lambda side: F.least(F.col("cy") - F.last(F.when(F.col("is_left") == side, F.col("cy")), True).over(before), F.first(F.when(F.col("is_left") == side, F.col("cy")), True).over(after) - F.col("cy"))
    p = p.withColumn("across", F.when(F.col("is_left"), far(False)).otherwise(far(True)))
    heights = lines.groupBy(*by).agg(F.median(F.col("y1") - F.col("y0")).alias("h"))
    g = p.join(heights, by).groupBy(*by)
    of = lambda what, side: F.count_if(what & (F.col("is_left") == side))
    near = F.coalesce(F.col("across") <= F.col("h") * 0.35, F.lit(False))
    g = g.agg(of(F.lit(True), True).alias("nl"), of(F.lit(True), False).alias("nr"), of(F.col("num"), True).alias("ml"), of(F.col("num"), False).alias("mr"), of(near, True).alias("kl"), of(near, False).alias("kr"), F.bool_and("cell").alias("cells"))
    paired = F.when(F.col("nl") <= F.col("nr"), F.col("kl") >= F.col("nl") * 0.8).otherwise(F.col("kr") >= F.col("nr") * 0.8)
    return g.select(*by, ((F.least("nl", "nr") >= 2) & paired & ((F.col("ml") >= F.col("nl") * 0.5) | (F.col("mr") >= F.col("nr") * 0.5) | F.col("cells"))).alias("is_grid"))


def projected(x: Column, y: Column, z: Column, yaw: float, pitch: float, scale: float, centre: tuple[float, float]) -> Column:
    """Struct (x, y, depth): a point turned by yaw, then by pitch, and seen in mild perspective."""
    cy, sy, cp, sp = (F.lit(f(a)) for a in (yaw, pitch) for f in (math.cos, math.sin))
    across, back = x * cy - z * sy, x * sy + z * cy
    depth = y * sp + back * cp
    size = F.lit(float(scale)) / (1.8 - depth * 0.35)
    return F.struct((centre[0] + across * size).alias("x"), (centre[1] - (y * cp - back * sp) * size).alias("y"), depth.alias("depth"))


def pca(vectors: DataFrame, k: int = 3) -> tuple[DataFrame, list[float]]:
    """vec_id, pc array (4 digits) on centred vectors, and each component's share of the variance.

    Sums and cross products are added up by partition and then over partitions (a matrix of the
    vectors' width reaches the driver); a component's largest loading is positive.
    """
    import numpy as np

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, cross = 0, 0.0, 0.0
        for p in parts:
            if len(p):
                x = np.stack(p["embedding"].to_numpy()).astype(np.float64)
                n, total, cross = n + len(x), total + x.sum(0), cross + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tolist()], "cross_": [cross.reshape(-1).tolist()]})

    add = lambda c: F.posexplode(c).alias("i", "v")
    part = vectors.select("embedding").mapInPandas(moments, "n long, total array<double>, cross_ array<double>")
    flat = part.select(F.lit("n").alias("what"), add(F.array(F.col("n").cast("double")))).unionByName(part.select(F.lit("t").alias("what"), add("total"))).unionByName(part.select(F.lit("c").alias("what"), add("cross_")))
    got = {k_: np.array([r.s for r in rows]) for k_, rows in _grouped(flat.groupBy("what", "i").agg(F.sum("v").alias("s")).orderBy("what", "i").collect()).items()}
    n, mean = got["n"][0], got["t"] / got["n"][0]
    cov = (got["c"].reshape(len(mean), -1) / n - np.outer(mean, mean)) * n / max(n - 1, 1)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    share = (values[order] / values.sum()).round(4).tolist()
    centre = F.array(*[F.lit(float(x)) for x in mean])
    centred = F.zip_with("embedding", centre, lambda a, b: a.cast("double") - b)
    parts = [F.round(F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(x)) for x in axes[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 4) for j in range(k)]
    return vectors.select("vec_id", F.array(*parts).alias("pc")), share


def _grouped(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r.what, []).append(r)
    return out


def robust_spread(values: DataFrame, by: list[str], column: str = "m", floor: float = 0.05) -> DataFrame:
    """The value at place floor(0.9 n) (from 0) of each group's sorted magnitudes, `floor` at least.

    Equal magnitudes are one row with a count first, and a running count finds the place, so no
    group is gathered; nulls are left out.
    """
    from pyspark.sql import Window

    own = values.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(group)
    placed = own.withColumn("_upto", upto).withColumn("_at", F.least(total - 1, F.floor(total * 0.9)) + 1)
    return placed.where((F.col("_upto") >= F.col("_at")) & (F.col("_upto") - F.col("_n") < F.col("_at"))).select(*by, F.greatest(F.col(column), F.lit(floor)).alias("spread"))


#: Address blocks that no fetch may reach (fixed values).
BLOCKED = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()


def ipv4(address: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.split(address, r"\.")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("long")
    ok = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*[part(i) for i in range(1, 5)]) <= 255)
    return F.when(ok, ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def blocked_address(address: Column) -> Column:
    """Whether an address is not publicly routable; what cannot be read is blocked."""
    n = ipv4(address)
    inside = F.lit(False)
    for block in BLOCKED:
        base, bits = block.split("/")
        start = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
        inside = inside | n.between(start, start + (1 << (32 - int(bits))) - 1)
    six = F.lower(address)
    private = six.rlike(r"^(::1?$|f[cd]|fe[89ab]|ff|::ffff:|2001:db8|64:ff9b)")
    return F.when(n.isNotNull(), inside).when(six.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"), private).otherwise(True)
