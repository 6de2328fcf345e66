"""The k nearest of each point, by cells whose width grows until enough is found."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geo import haversine_km
from ..session import cut
from .retrieval import top

#: Kilometres of a degree of latitude, a little less than it has, and the most that two places can lie apart.
KM_PER_DEGREE, FARTHEST = 111.19, 20_100.0
#: The first height expects so many times k: a point in a corner of its group sees a quarter of that.
SPARE = 5.0


def k_nearest(points: DataFrame, targets: DataFrame, k: int, by: str = "destination_id") -> DataFrame:
    """by, src, dst, km, rank, total: of each point (by, id, lat, lon) the k nearest targets of its group, all if there are fewer.

    Points meet the targets of their own and the eight cells around, which hold
    everything within a cell's height. That height starts where a group's density
    lets one expect k and doubles for the points that found fewer. Whoever has
    found k within the height is done: any other target lies beyond it. So the
    work follows k and not the size of a group, unless its targets lie in clumps.
    Ties go by the target's id. total is the number of targets of the group.
    """
    box = targets.groupBy(by).agg(F.count("*").alias("total"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    edge = F.least(F.greatest(F.abs("s"), F.abs("n")), F.lit(89.0))
    area = F.greatest((F.col("n") - F.col("s")) * KM_PER_DEGREE, F.lit(0.1)) * F.greatest((F.col("e") - F.col("w")) * KM_PER_DEGREE * F.cos(F.radians(edge)), F.lit(0.1))
    reach = F.greatest(F.sqrt(area * F.lit(SPARE * k / math.pi) / F.col("total")), F.lit(0.05))
    groups = box.select(F.col(by).alias("g"), "total", reach.alias("reach"))
    left = cut(points.select(F.col(by).alias("g"), F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).distinct().join(groups, "g"))
    right = targets.select(F.col(by).alias("g"), F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    step = F.col("reach") / F.lit(KM_PER_DEGREE)

    def column(row, lon):
        # A row's cells are as wide as its end nearer to a pole needs, with one row more for good measure.
        pole = F.least(F.greatest(F.abs(row * step), F.abs((row + 1) * step)) + step, F.lit(89.9))
        return F.floor(F.col(lon) * F.cos(F.radians(pole)) / step)

    # The height is a column, so each round has the same plan, whose code is made once.
    found, factor = None, 1.0
    while True:
        shifts = lambda: F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
        asked = left.withColumn("dy", shifts()).withColumn("row", F.floor(F.col("lat1") / step) + F.col("dy")).withColumn("dx", shifts()).withColumn("col", column(F.col("row"), "lon1") + F.col("dx"))
        have = right.join(left.select("g", "reach").distinct(), "g").withColumn("row", F.floor(F.col("lat2") / step)).withColumn("col", column(F.col("row"), "lon2")).select("g", "row", "col", "dst", "lat2", "lon2")
        km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
        near = asked.join(have, ["g", "row", "col"]).withColumn("km", km).where(F.col("km") <= F.col("reach"))
        best = top(near.select("g", "src", "dst", "km", "total"), ["g", "src"], [F.asc("km"), F.asc("dst")], k)
        enough = F.count("*").over(Window.partitionBy("g", "src")) >= F.least(F.lit(k), F.col("total"))
        # What lies farther apart than any two places can is all that there is.
        part = cut((best if factor * 0.05 > FARTHEST else best.withColumn("enough", enough).where("enough")).select("g", "src", "dst", "km", "rank", "total"))
        found = part if found is None else found.unionByName(part)
        if factor * 0.05 > FARTHEST:
            break
        left = cut(left.join(part.where("rank = 1").select("g", "src"), ["g", "src"], "left_anti").withColumn("reach", F.col("reach") * 2))
        if left.isEmpty():
            break
        factor *= 2
    return found.select(F.col("g").alias(by), "src", "dst", "km", "rank", "total")
