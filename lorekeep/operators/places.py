"""The place table: look-ups, administrative and geographic chains, and places inside polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Continents and landmasses by code, what the earth lies in, and the kinds of natural features.
CONTINENTS = {"AF": "africa", "AS": "asia", "EU": "europe", "NA": "north america", "SA": "south america", "OC": "oceania", "AN": "antarctica"}
LANDMASSES = {"EU": "eurasia", "AS": "eurasia", "AF": "africa_phys", "NA": "americas", "SA": "americas", "OC": "oceania_phys", "AN": "antarctica_phys"}
BRIDGE = ["universe", "local group", "milky way", "solar system", "earth"]
FEATURES = {"H": "hydrographic", "T": "terrestrial"}


def _named(values: dict[str, str], code: Column, other: Column | None = None) -> Column:
    chosen = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in values.items()])
    return chosen if other is None else F.coalesce(chosen, other)


def _fields(lines: DataFrame, **at: int) -> DataFrame:
    """Fields of tab-separated lines (value); blank lines and comments are dropped."""
    parts = F.split("value", "\t")
    return lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(*[F.get(parts, F.lit(i)).alias(c) for c, i in at.items()])


def geo_lookup(countries: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((code, name, continent, landmass), (code, name)) of lines of countries and of regions; names in lower case.

    Of a code that is given twice the last name in order counts. Unknown continents give "unknown" and "earth".
    """
    c = _fields(countries, code=0, name=4, continent=8)
    c = c.select("code", F.lower("name").alias("name"), _named(CONTINENTS, F.col("continent"), F.lit("unknown")).alias("continent"), _named(LANDMASSES, F.col("continent"), F.lit("earth")).alias("landmass"))
    r = _fields(regions, code=0, name=2).select("code", F.lower("name").alias("name"))
    return c.groupBy("code").agg(F.max(F.struct("name", "continent", "landmass")).alias("m")).select("code", "m.*"), r.groupBy("code").agg(F.max("name").alias("name"))


def _place(name: Column, kind: Column, category: str, parent: Column, path: Column, landmass: Column, tail: Column | None = None, lon: Column | None = None, lat: Column | None = None) -> list[Column]:
    bridge = F.array(*[F.lit(x) for x in BRIDGE], landmass, *([tail] if tail is not None else []))
    none = F.lit(None).cast("double")
    return [
        name.alias("name"),
        kind.alias("type"),
        F.lit(category).alias("category"),
        parent.alias("parent_admin"),
        path.alias("path_admin"),
        landmass.alias("parent_geo"),
        bridge.alias("path_geo"),
        (none if lon is None else lon).alias("lon"),
        (none if lat is None else lat).alias("lat"),
    ]


def geo_places(cities: DataFrame, regions: DataFrame, countries: DataFrame, features: DataFrame) -> DataFrame:
    """One place table (name, type, category, parent_admin, path_admin, parent_geo, path_geo, lon, lat) from tab-separated lines.

    Continents come from the fixed codes. A missing country gives "unknown" and "earth", a missing region is left out of the
    chain. Cities without coordinates lie at 0; natural features without good ones, or of other classes, are dropped.
    """
    spark = cities.sparkSession
    country, region = geo_lookup(countries, regions)
    continents = spark.createDataFrame([(v, LANDMASSES.get(k, "earth")) for k, v in CONTINENTS.items()], "name string, landmass string")
    name, mass = F.col("name"), F.col("landmass")
    out = [continents.select(*_place(name, F.lit("continent"), "administrative", F.lit("earth"), F.array(name), mass))]
    out.append(country.select(*_place(name, F.lit("country"), "administrative", F.col("continent"), F.array("continent", "name"), mass)))
    known = country.select(F.col("code").alias("country"), F.col("name").alias("country_name"), "continent", mass)

    def placed(rows: DataFrame) -> DataFrame:
        filled = {"country_name": F.coalesce("country_name", F.lit("unknown")), "continent": F.coalesce("continent", F.lit("unknown")), "landmass": F.coalesce("landmass", F.lit("earth"))}
        return rows.join(known, "country", "left").withColumns(filled)

    r = placed(region.withColumn("country", F.split_part("code", F.lit("."), F.lit(1))))
    out.append(r.select(*_place(name, F.lit("region"), "administrative", F.col("country_name"), F.array("continent", "country_name", "name"), mass)))
    c = _fields(cities, name=2, lat=4, lon=5, country=8, admin=10).withColumn("code", F.concat_ws(".", "country", "admin"))
    c = placed(c).join(region.select("code", F.col("name").alias("region_name")), "code", "left").withColumn("name", F.lower("name"))
    chain = F.filter(F.array("continent", "country_name", "region_name", "name"), lambda x: x.isNotNull())
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    out.append(c.select(*_place(name, F.lit("city"), "administrative", F.coalesce("region_name", "country_name"), chain, mass, lon=number("lon"), lat=number("lat"))))
    f = _fields(features, name=2, lat=4, lon=5, klass=6, country=8).withColumns({"name": F.lower("name"), "lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")})
    f = placed(f.where(F.col("klass").isin(*FEATURES) & F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    nowhere = F.array().cast("array<string>")
    out.append(f.select(*_place(name, _named(FEATURES, F.col("klass")), "geographical", F.lit(""), nowhere, mass, tail=name, lon=F.col("lon"), lat=F.col("lat"))))
    return reduce(DataFrame.unionByName, out)


def area(ring: Column) -> Column:
    """Area of a ring array<struct<x,y>>, its last point joined to the first."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)
    return F.abs(twice) / 2


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring: a ray to the right crosses an odd number of its sides."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def spatial_enrich(places: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """places (uid, name, category, lon, lat, parent_geo, path_geo, physical_features) with the polygons (name, ring) that they lie in, larger ones first.

    A geographical place gets the polygons' names before the last element of its path and the smallest one as parent; an
    administrative one gets them in the sorted set of its features; a place of the polygon's own name is left alone. Points meet
    polygons by cells of so many degrees, an equi-join, so no point is tried with a polygon that is not near. Points and rings that are
    told several times meet once; a point's list of polygons is sorted once and goes to all places there.
    """
    low, high = lambda c: F.floor(F.array_min(c) / cell), lambda c: F.floor(F.array_max(c) / cell)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    p = polygons.where("name is not null").groupBy("ring").agg(F.collect_list("name").alias("polygons"))
    p = p.select("polygons", "ring", area(F.col("ring")).alias("area"), F.explode(F.sequence(low(xs), high(xs))).alias("cx"), F.sequence(low(ys), high(ys)).alias("cys"))
    p = p.select("polygons", "ring", "area", "cx", F.explode("cys").alias("cy"))
    at = places.select("lon", "lat").distinct().withColumns({"cx": F.floor(F.col("lon") / cell), "cy": F.floor(F.col("lat") / cell)})
    hits = at.join(p, ["cx", "cy"]).where(inside(F.col("lon"), F.col("lat"), F.col("ring")))
    each = F.transform("polygons", lambda n: F.struct((-F.col("area")).alias("a"), n.alias("p")))
    found = hits.select("lon", "lat", each.alias("each")).groupBy("lon", "lat").agg(F.array_sort(F.flatten(F.collect_list("each"))).alias("s")).select("lon", "lat", F.transform("s", lambda s: s["p"]).alias("found"))
    none = F.array().cast("array<string>")
    rows = places.withColumn("geo", F.coalesce(F.col("category") == "geographical", F.lit(False))).withColumn("features", F.coalesce("physical_features", none))
    # One list for each kind of place at a point; a place of a polygon's own name leaves it out below.
    kinds = rows.select("lon", "lat", "geo", F.when(~F.col("geo"), F.col("features")).otherwise(none).alias("kind"))
    lists = kinds.distinct().join(found, ["lon", "lat"]).withColumn("found", F.when(F.col("geo"), F.col("found")).otherwise(F.array_sort(F.array_distinct(F.concat("kind", "found")))))
    rows = rows.withColumn("kind", F.when(~F.col("geo"), F.col("features")).otherwise(none)).join(lists, ["lon", "lat", "geo", "kind"], "left")
    geo = F.col("geo")
    kept = F.when(~geo & F.array_contains("features", F.col("name")), F.col("found")).otherwise(F.array_remove("found", F.col("name")))
    rows = rows.withColumn("found", F.coalesce(kept, F.when(geo, none).otherwise(F.array_sort(F.array_distinct("features")))))
    path = F.concat(F.slice("path_geo", 1, F.greatest(F.size("path_geo") - 1, F.lit(0))), F.col("found"), F.slice("path_geo", F.greatest(F.size("path_geo"), F.lit(1)), 1))
    return rows.select(
        "uid",
        "name",
        "category",
        F.when(geo & (F.size("found") > 0), F.element_at("found", -1)).otherwise(F.col("parent_geo")).alias("parent_geo"),
        F.when(geo, path).otherwise(F.col("path_geo")).alias("path_geo"),
        F.when(geo, F.col("features")).otherwise(F.col("found")).alias("physical_features"),
    )
