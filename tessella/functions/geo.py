"""Web-Mercator tiles and coordinate conversions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the Chinese coordinate systems.
KRASOVSKY_A, KRASOVSKY_EE, BAIDU_PI = 6378245.0, 0.00669342162296594323, math.pi * 3000.0 / 180.0
WEST, EAST, SOUTH, NORTH = 72.004, 137.8347, 0.8293, 55.8271
KM_PER_DEGREE, MAX_LATITUDE = 111.32, 85.0511


def lonlat_to_tile(lon: Column, lat: Column, zoom: Column) -> Column:
    """Fractional tile coordinates struct(x, y)."""
    n = F.pow(F.lit(2.0), zoom)
    return F.struct(((lon + 180) / 360 * n).alias("x"), ((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n).alias("y"))


def tile_to_lonlat(x: Column, y: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    return F.struct((x / n * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))).alias("lat"))


def tile_bounds(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, zoom: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of whole tiles; the northern edge gives the least y."""
    a, b = lonlat_to_tile(min_lon, max_lat, zoom), lonlat_to_tile(max_lon, min_lat, zoom)
    low = lambda c: F.floor(c).cast("int")
    return F.struct(low(a["x"]).alias("min_x"), low(a["y"]).alias("min_y"), low(b["x"]).alias("max_x"), low(b["y"]).alias("max_y"))


def checked_regions(regions: DataFrame, max_zoom: int = 21) -> DataFrame:
    """``regions`` with zoom capped; a region outside the map or inside out is an error."""
    good = (F.abs("min_lon") <= 180) & (F.abs("max_lon") <= 180) & (F.abs("min_lat") <= MAX_LATITUDE) & (F.abs("max_lat") <= MAX_LATITUDE) & (F.col("min_lon") < F.col("max_lon")) & (F.col("min_lat") < F.col("max_lat"))
    ok = F.when(good, F.least("zoom", F.lit(max_zoom))).otherwise(F.raise_error(F.concat(F.lit("not a region: "), F.col("name"))).cast("int"))
    return regions.withColumn("zoom", ok)


def tile_cover(regions: DataFrame, max_zoom: int = 21) -> DataFrame:
    """Every tile that a region touches, both ends included, with the edges of the covered area."""
    bounded = checked_regions(regions, max_zoom).withColumn("t", tile_bounds(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat", "zoom")]))
    tiles = bounded.withColumn("tile_x", F.explode(F.sequence("t.min_x", "t.max_x"))).withColumn("tile_y", F.explode(F.sequence("t.min_y", "t.max_y")))
    west_north, east_south = tile_to_lonlat(F.col("t.min_x"), F.col("t.min_y"), F.col("zoom")), tile_to_lonlat(F.col("t.max_x") + 1, F.col("t.max_y") + 1, F.col("zoom"))
    return tiles.select("name", "zoom", "tile_x", "tile_y", west_north["lon"].alias("west"), west_north["lat"].alias("north"), east_south["lon"].alias("east"), east_south["lat"].alias("south"))


def patch_grid(regions: DataFrame, available: DataFrame, step: int = 2) -> DataFrame:
    """(name, zoom, patch_x, patch_y): every ``step``-th tile, ends excluded, whose step x step tiles are all in
    ``available`` (zoom, tile_x, tile_y)."""
    t = checked_regions(regions).withColumn("t", tile_bounds(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat", "zoom")]))
    walk = lambda a, b: F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1, F.lit(step)))
    patches = t.withColumn("patch_x", F.explode(walk("t.min_x", "t.max_x"))).withColumn("patch_y", F.explode(walk("t.min_y", "t.max_y")))
    cells = patches.withColumn("d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(step) for j in range(step)])))
    cells = cells.select("name", "zoom", "patch_x", "patch_y", (F.col("patch_x") + F.col("d.i")).alias("tile_x"), (F.col("patch_y") + F.col("d.j")).alias("tile_y"))
    found = cells.join(available.select("zoom", "tile_x", "tile_y").distinct(), ["zoom", "tile_x", "tile_y"])
    return found.groupBy("name", "zoom", "patch_x", "patch_y").agg(F.count("*").alias("n")).where(F.col("n") == step * step).drop("n")


def pad_point_to_bbox(lon: Column, lat: Column, km: float) -> Column:
    dy = F.lit(km / KM_PER_DEGREE)
    dx = km / (KM_PER_DEGREE * F.cos(F.radians(lat)))
    return F.struct((lon - dx).alias("min_lon"), (lat - dy).alias("min_lat"), (lon + dx).alias("max_lon"), (lat + dy).alias("max_lat"))


def bd09_to_gcj02(lon: Column, lat: Column) -> Column:
    x, y = lon - 0.0065, lat - 0.006
    z = F.hypot(x, y) - 0.00002 * F.sin(y * BAIDU_PI)
    theta = F.atan2(y, x) - 0.000003 * F.cos(x * BAIDU_PI)
    return F.struct((z * F.cos(theta)).alias("lon"), (z * F.sin(theta)).alias("lat"))


def gcj02_to_wgs84(lon: Column, lat: Column) -> Column:
    """The standard approximate inverse: twice the point less its forward image; identity outside the region."""
    x, y = lon - 105.0, lat - 35.0
    sin = lambda v: F.sin(v * math.pi)
    # The coefficients of the public formula.
    d_lat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x))
    d_lat += (20.0 * sin(6.0 * x) + 20.0 * sin(2.0 * x) + 20.0 * sin(y) + 40.0 * sin(y / 3.0) + 160.0 * sin(y / 12.0) + 320.0 * sin(y / 30.0)) * 2.0 / 3.0
    d_lon = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x))
    d_lon += (20.0 * sin(6.0 * x) + 20.0 * sin(2.0 * x) + 20.0 * sin(x) + 40.0 * sin(x / 3.0) + 150.0 * sin(x / 12.0) + 300.0 * sin(x / 30.0)) * 2.0 / 3.0
    rad = F.radians(lat)
    magic = 1 - KRASOVSKY_EE * F.sin(rad) * F.sin(rad)
    d_lat = d_lat * 180.0 / (KRASOVSKY_A * (1 - KRASOVSKY_EE) / (magic * F.sqrt(magic)) * math.pi)
    d_lon = d_lon * 180.0 / (KRASOVSKY_A / F.sqrt(magic) * F.cos(rad) * math.pi)
    outside = ~(lon.between(WEST, EAST) & lat.between(SOUTH, NORTH))
    return F.struct(F.when(outside, lon).otherwise(lon - d_lon).alias("lon"), F.when(outside, lat).otherwise(lat - d_lat).alias("lat"))


def ground_sample_distance(rasters: DataFrame) -> DataFrame:
    """(…, gsd_x, gsd_y, non_square): metres for a pixel; degrees count 111320 m."""
    scale = F.when(F.col("is_geographic"), F.lit(KM_PER_DEGREE * 1000)).otherwise(F.lit(1.0))
    out = rasters.withColumn("gsd_x", F.abs("res_x") * scale).withColumn("gsd_y", F.abs("res_y") * scale)
    return out.withColumn("non_square", F.abs(F.col("gsd_x") - F.col("gsd_y")) > 0.01)


def download_success_rate(tiles: DataFrame, low: float = 80.0) -> DataFrame:
    """(region, n_tiles, rate, low): percent of tiles that came."""
    counted = tiles.groupBy("region").agg(F.count("*").alias("n_tiles"), (F.count_if("ok") / F.count("*") * 100).alias("rate"))
    return counted.withColumn("low", F.col("rate") < low)
