"""Points near points, on the sphere: a join by grid cells, and clusters around the most valuable points.

Cells are bands of latitude as wide as the radius, each cut into as many pieces as its circle has room for, so they are about square
everywhere; a point looks into all pieces that its circle can touch, over the date line and around the poles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acquimetra.functions.geo import EARTH_KM, haversine_km
from acquimetra.sources.tables import checkpointed


def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90) / step).cast("int")


def _pieces(band: Column, step: float) -> Column:
    """Pieces of a band: as many of ``step`` degrees of a great circle as its shorter edge has room for, one at least."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(far)) / step).cast("int"))


def _piece(lon: Column, n: Column) -> Column:
    return F.least(n - 1, F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n).cast("int"))


def cell(lat: Column, lon: Column, km: float) -> Column:
    """The cell of a point in a grid for the radius."""
    step = math.degrees(km / EARTH_KM)
    band = _band(lat, step)
    return F.struct(band.alias("band"), _piece(lon, _pieces(band, step)).alias("piece"))


def cells_within(lat: Column, lon: Column, km: float) -> Column:
    """All cells of that grid that hold a point within the radius of a point."""
    radius = km / EARTH_KM
    step = math.degrees(radius)
    # The half width in longitude of the circle; a circle that holds a pole has all longitudes.
    ratio = F.lit(math.sin(radius)) / F.cos(F.radians(lat))
    half = F.when((F.abs(lat) + step >= 90) | (ratio >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + 1e-9)
    bands = F.sequence(_band(F.greatest(F.lit(-90.0), lat - step - 1e-9), step), _band(F.least(F.lit(90.0), lat + step + 1e-9), step))

    def of(band: Column) -> Column:
        n = _pieces(band, step)
        first = F.floor((lon + 180 - half) / 360 * n).cast("int")
        last = F.least(F.floor((lon + 180 + half) / 360 * n).cast("int"), first + n - 1)
        return F.transform(F.sequence(first, last), lambda i: F.struct(band.alias("band"), F.pmod(i, n).alias("piece")))

    return F.flatten(F.transform(bands, of))


def _near_rows(left: DataFrame, right: DataFrame, km: float, within: Sequence[str] = ()) -> DataFrame:
    """``near`` row by row, for tables whose places are mostly different."""
    placed = "lat between -90 and 90 and lon is not null"
    a = left.where(placed).select(F.struct(*left.columns).alias("a"), F.explode(cells_within(F.col("lat").cast("double"), F.col("lon").cast("double"), km)).alias("_a"))
    b = right.where(placed).select(F.struct(*right.columns).alias("b"), cell(F.col("lat").cast("double"), F.col("lon").cast("double"), km).alias("_b"))
    on = F.col("_a") == F.col("_b")
    for c in within:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    d = haversine_km(F.col("a.lat").cast("double"), F.col("a.lon").cast("double"), F.col("b.lat").cast("double"), F.col("b.lon").cast("double"))
    return a.join(b, on).select("a", "b", d.alias("km")).where(F.col("km") <= km)


def _dealt(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Dealt by place to a fixed number of tasks, with the hash ``_at``: few small rows here become many, so adaptive execution must not put them into one. The hash keeps Spark from taking an earlier exchange for this one."""
    return df.withColumn("_at", F.xxhash64(lat, lon)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_at")


def _placed(df: DataFrame, side: str) -> DataFrame:
    """Rows that have a place, as a struct ``side``, with the place as ``lat_side`` and ``lon_side``."""
    place = [F.col(c).cast("double").alias(f"{c}_{side}") for c in ("lat", "lon")]
    return df.where("lat between -90 and 90 and lon is not null").select(F.struct(*df.columns).alias(side), *place)


def _near_places(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """(lat_a, lon_a, lat_b, lon_b, km) of different places (lat_a, lon_a) and (lat_b, lon_b) near each other: each pair of places is reckoned once, whatever stands there."""
    x = _dealt(a.select("lat_a", "lon_a").distinct(), "lat_a", "lon_a").withColumn("_cell", F.explode(cells_within(F.col("lat_a"), F.col("lon_a"), km)))
    y = b.select("lat_b", "lon_b").distinct().withColumn("_cell", cell(F.col("lat_b"), F.col("lon_b"), km))
    d = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return x.join(y, "_cell").select("lat_a", "lon_a", "lat_b", "lon_b", d.alias("km")).where(F.col("km") <= km)


def near(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of rows of both tables (columns lat and lon; all columns come as structs a and b) at most ``km`` apart, with their distance. Rows without a place, or with a latitude that there isn't, are near none.

    Places meet first, then the rows of the right table, then those of the left: what is shuffled is a row for each place and right row, never a pair of rows.
    """
    a, b = _placed(left, "a"), _placed(right, "b")
    around = _near_places(a, b, km).join(b, ["lat_b", "lon_b"]).select("lat_a", "lon_a", "b", "km")
    return _dealt(around, "lat_a", "lon_a").join(_dealt(a, "lat_a", "lon_a"), ["_at", "lat_a", "lon_a"]).select("a", "b", "km")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float) -> DataFrame:
    """(left_id, right_id, km): of every row the nearest one within the radius, the least id at equal distances; null if there is none.

    Found once for each different place of the left table, among the least ids of the places of the right one.
    """
    a, b = _placed(left.select(left_id, "lat", "lon"), "a"), _placed(right.select(right_id, "lat", "lon"), "b")
    least = b.groupBy("lat_b", "lon_b").agg(F.min(f"b.{right_id}").alias("id"))
    best = _near_places(a, least, km).join(least, ["lat_b", "lon_b"]).groupBy("lat_a", "lon_a").agg(F.min(F.struct("km", "id")).alias("m"))
    found = left.select(left_id, F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"))
    return found.join(best, (F.col("_lat") == F.col("lat_a")) & (F.col("_lon") == F.col("lon_a")), "left").select(left_id, F.col("m.id").alias(right_id), F.col("m.km").alias("km"))


def clusters(df: DataFrame, id_col: str, lat: str, lon: str, value: str, region: str, km: float = 150.0) -> DataFrame:
    """(id, region, cluster, km_to_seed): within a region the free row of the highest value (ties: the least id) seeds a cluster of all free rows within ``km``, again and again; clusters count from 0 in that order.

    A round settles every row that no free row of a higher value is near, everywhere at once. In a cell whose rows are all within the radius only the best can be one, so
    rows are compared with a few bests, not with each other. Rows without a place have no cluster; null values come last.
    """
    c = F.col
    rank = F.struct(F.coalesce(c(value).cast("double"), F.lit(float("-inf"))).alias("v"), (-c(id_col).cast("long")).alias("i"))
    rows = df.select(c(id_col).cast("long").alias("id"), c(region).alias("region"), c(lat).cast("double").alias("lat"), c(lon).cast("double").alias("lon"), rank.alias("rank"))
    free, settled = checkpointed(rows.where("lat between -90 and 90 and lon is not null")), []
    while not free.isEmpty():
        # Cells of three tenths of the radius are less than the radius across, also where few pieces go around a pole.
        best = free.groupBy("region", cell(c("lat"), c("lon"), 0.3 * km).alias("cell")).agg(F.max("rank").alias("m"), F.max_by(F.struct("id", "lat", "lon"), "rank").alias("p"))
        best = best.select("region", "m", "p.*")
        pairs = checkpointed(_near_rows(free, best, km, ["region"]).select(c("a.id").alias("id"), c("a.rank").alias("rank"), c("b.id").alias("seed"), c("b.m").alias("m"), "km"))
        beaten = pairs.where("rank > m").select("seed").distinct()
        taken = pairs.join(beaten, "seed", "left_anti").groupBy("id").agg(F.max(F.struct("m", "seed", "km")).alias("t"))
        settled.append(checkpointed(taken.select("id", "t.m", "t.seed", "t.km")))
        free = checkpointed(free.join(settled[-1].select("id"), "id", "left_anti"))
    out = rows.select("id", "region").join(_union(settled, rows), "id", "left")
    seeds = out.where("seed = id").withColumn("cluster", F.row_number().over(W.partitionBy("region").orderBy(F.desc("m"))) - 1).select(c("seed").alias("_seed"), "cluster")
    return out.join(seeds, c("seed") == c("_seed"), "left").select("id", "region", "cluster", c("km").alias("km_to_seed"))


def _union(parts: list[DataFrame], rows: DataFrame) -> DataFrame:
    out = rows.limit(0).select("id", F.col("rank").alias("m"), F.col("id").alias("seed"), F.lit(0.0).alias("km"))
    for p in parts:
        out = out.union(p)
    return out
