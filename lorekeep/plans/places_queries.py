"""Queries of the place table, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import places as P
from lorekeep.plans import bindings as B

_CODES = ["AF", "NA", "AS", "EU", "ZZ"]


def _tabs(*parts):
    return F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(c):
    return F.col(c).cast("string")


def lines(s, d):
    """Customers as cities, suppliers as regions, nations as countries and parts as natural features, in lines of text."""
    comment = s.createDataFrame([("#a comment",), ("",), ("   ",)], "value string")
    n, sup, c, p = (B.table(s, d, t) for t in ("nation", "supplier", "customer", "part"))
    code = F.element_at(F.array(*[F.lit(x) for x in _CODES]), (F.col("n_regionkey") % 5 + 1).cast("int"))
    country = lambda k: F.concat(F.lit("C"), k.cast("string"))
    countries = n.select(_tabs(country(F.col("n_nationkey")), "", "", "", F.col("n_name"), "", "", "", code).alias("value")).unionByName(comment)
    regions = sup.select(_tabs(F.concat(country(F.col("s_nationkey")), F.lit("."), _text("s_suppkey")), "", F.col("s_name")).alias("value")).unionByName(comment)
    k = F.col("c_custkey")
    lat, lon = F.when(k % 11 == 0, F.lit("")).otherwise(_text("c_custkey")), F.concat(F.lit("-"), _text("c_custkey"), F.lit(".5"))
    home = F.when(k % 13 == 0, F.lit("XX")).otherwise(country(F.col("c_nationkey")))
    cities = c.select(_tabs("", "", F.col("c_name"), "", lat, lon, "", "", home, "", (k % 97).cast("string")).alias("value")).unionByName(comment)
    k = F.col("p_partkey")
    klass = F.element_at(F.array(*[F.lit(x) for x in "HTAP"]), (F.col("p_size") % 4 + 1).cast("int"))
    features = p.select(_tabs("", "", F.upper(F.concat("p_name", _text("p_partkey"))), "", F.when(k % 7 == 0, F.lit("bad")).otherwise(_text("p_size")), _text("p_partkey"), klass, "", country(k % 30)).alias("value"))
    return cities, regions, countries, features


def _geo(s, d):
    rows = P.geo_places(*lines(s, d))
    return rows.withColumns({c: F.array_join(c, "/") for c in ("path_admin", "path_geo")})


def _lookups(s, d):
    _, regions, countries, _ = lines(s, d)
    c, r = P.geo_lookup(countries, regions)
    return c.unionByName(r, allowMissingColumns=True)


_LAND = "CASE n_regionkey % 5 WHEN 0 THEN 'africa_phys' WHEN 1 THEN 'americas' WHEN 2 THEN 'eurasia' WHEN 3 THEN 'eurasia' ELSE 'earth' END"
_CONT = "CASE n_regionkey % 5 WHEN 0 THEN 'africa' WHEN 1 THEN 'north america' WHEN 2 THEN 'asia' WHEN 3 THEN 'europe' ELSE 'unknown' END"
_COUNTRY = f"country AS (SELECT 'C' || n_nationkey AS code, lower(n_name) AS name, {_CONT} AS continent, {_LAND} AS landmass FROM nation)"
_REGION = "region_ AS (SELECT 'C' || s_nationkey || '.' || s_suppkey AS code, 'C' || s_nationkey AS country, lower(s_name) AS name FROM supplier)"
_ROAD = "'universe/local group/milky way/solar system/earth/'"

LOOKUP_SQL = f"WITH {_COUNTRY}, {_REGION} SELECT code, name, continent, landmass FROM country UNION ALL SELECT code, name, NULL, NULL FROM region_"
PLACES_SQL = f"""WITH {_COUNTRY}, {_REGION},
cont AS (SELECT * FROM (VALUES ('africa', 'africa_phys'), ('asia', 'eurasia'), ('europe', 'eurasia'), ('north america', 'americas'), ('south america', 'americas'), ('oceania', 'oceania_phys'), ('antarctica', 'antarctica_phys')) t(name, mass)),
city AS (SELECT lower(c_name) AS name, CASE WHEN c_custkey % 11 = 0 THEN 0.0 ELSE c_custkey END::DOUBLE AS lat, -(c_custkey + 0.5)::DOUBLE AS lon, CASE WHEN c_custkey % 13 = 0 THEN 'XX' ELSE 'C' || c_nationkey END AS country, c_custkey % 97 AS admin FROM customer),
placed AS (SELECT city.*, coalesce(k.name, 'unknown') AS cn, coalesce(k.continent, 'unknown') AS co, coalesce(k.landmass, 'earth') AS mass, r.name AS rn FROM city LEFT JOIN country k ON k.code = city.country LEFT JOIN region_ r ON r.code = city.country || '.' || city.admin)
SELECT name, 'continent' AS type, 'administrative' AS category, 'earth' AS parent_admin, name AS path_admin, mass AS parent_geo, {_ROAD} || mass AS path_geo, NULL::DOUBLE AS lon, NULL::DOUBLE AS lat FROM cont
UNION ALL SELECT name, 'country', 'administrative', continent, continent || '/' || name, landmass, {_ROAD} || landmass, NULL, NULL FROM country
UNION ALL SELECT r.name, 'region', 'administrative', k.name, k.continent || '/' || k.name || '/' || r.name, k.landmass, {_ROAD} || k.landmass, NULL, NULL FROM region_ r JOIN country k ON k.code = r.country
UNION ALL SELECT name, 'city', 'administrative', coalesce(rn, cn), concat_ws('/', co, cn, rn, name), mass, {_ROAD} || mass, lon, lat FROM placed
UNION ALL SELECT lower(p_name) || p_partkey, CASE p_size % 4 WHEN 0 THEN 'hydrographic' ELSE 'terrestrial' END, 'geographical', '', '', coalesce(k.landmass, 'earth'), {_ROAD} || coalesce(k.landmass, 'earth') || '/' || lower(p_name) || p_partkey, p_partkey::DOUBLE, p_size::DOUBLE
 FROM part LEFT JOIN country k ON k.code = 'C' || (p_partkey % 30) WHERE p_size % 4 < 2 AND p_partkey % 7 > 0"""


def _enrich(s, d):
    """Customers as points; suppliers as four-sided polygons of many sizes, some of which hold others."""
    k, z = F.col("c_custkey"), F.col("s_suppkey")
    name = F.when(k % 50 == 0, F.concat(F.lit("poly"), (k % 40).cast("string"))).otherwise(F.concat(F.lit("c"), k.cast("string")))
    places = B.table(s, d, "customer").select(
        k.alias("uid"), name.alias("name"), F.when(k % 2 == 0, "geographical").otherwise("administrative").alias("category"), (k * 37 % 800 / 8).alias("lon"), (k * 91 % 640 / 8).alias("lat"), F.lit("land").alias("parent_geo"),
        F.array(F.lit("earth"), F.lit("land"), F.concat(F.lit("c"), k.cast("string"))).alias("path_geo"), F.when(k % 3 == 0, F.array(F.lit("old"))).alias("physical_features"),
    )
    x, y, w = z * 29 % 80, z * 17 % 60, z % 23 + 2
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(point(x, y), point(x + w, y + 1), point(x + w - 1, y + w), point(x - 1, y + w - 1))
    polygons = B.table(s, d, "supplier").select(F.concat(F.lit("poly"), z.cast("string")).alias("name"), ring.alias("ring"))
    rows = P.spatial_enrich(places, polygons, cell=4.0)
    return rows.select("uid", "parent_geo", F.array_join("path_geo", "/").alias("path_geo"), F.array_join("physical_features", "/").alias("features"))


ENRICH_SQL = """WITH p AS (SELECT c_custkey AS uid, CASE WHEN c_custkey % 50 = 0 THEN 'poly' || (c_custkey % 40) ELSE 'c' || c_custkey END AS name, c_custkey % 2 = 0 AS geo, (c_custkey * 37 % 800) / 8.0::DOUBLE AS lon, (c_custkey * 91 % 640) / 8.0::DOUBLE AS lat FROM customer),
q AS (SELECT 'poly' || s_suppkey AS polygon, (s_suppkey * 29 % 80)::DOUBLE AS x, (s_suppkey * 17 % 60)::DOUBLE AS y, (s_suppkey % 23 + 2)::DOUBLE AS w FROM supplier),
sides AS (SELECT polygon, w, unnest([[x, y, x + w, y + 1], [x + w, y + 1, x + w - 1, y + w], [x + w - 1, y + w, x - 1, y + w - 1], [x - 1, y + w - 1, x, y]]) AS e FROM q),
areas AS (SELECT polygon, abs(sum(e[1] * e[4] - e[3] * e[2])) / 2 AS area FROM sides GROUP BY 1),
hit AS (SELECT uid, polygon FROM p JOIN sides ON name <> polygon GROUP BY uid, lon, lat, polygon HAVING count(*) FILTER (WHERE (e[2] > lat) <> (e[4] > lat) AND lon < (e[3] - e[1]) * (lat - e[2]) / (e[4] - e[2]) + e[1]) % 2 = 1),
found AS (SELECT uid, string_agg(polygon, '/' ORDER BY area DESC, polygon) AS names, list(polygon) AS every, arg_min(polygon, (area, -1)) AS least, min(area) AS small FROM hit JOIN areas USING (polygon) GROUP BY 1),
last_ AS (SELECT uid, max(polygon) AS parent FROM hit JOIN areas USING (polygon) JOIN found USING (uid) WHERE area = small GROUP BY 1)
SELECT uid, CASE WHEN geo AND parent IS NOT NULL THEN parent ELSE 'land' END AS parent_geo, CASE WHEN geo THEN concat_ws('/', 'earth/land', names, 'c' || uid) ELSE 'earth/land/c' || uid END AS path_geo,
 CASE WHEN geo THEN CASE WHEN uid % 3 = 0 THEN 'old' ELSE '' END ELSE array_to_string(list_sort(list_concat(coalesce(every, []), CASE WHEN uid % 3 = 0 THEN ['old'] ELSE [] END)), '/') END AS features
FROM p LEFT JOIN found USING (uid) LEFT JOIN last_ USING (uid)"""

QUERIES = {"geo_lookup": _lookups, "geo_places": _geo, "spatial_enrich": _enrich}
ORACLES = {"geo_lookup": LOOKUP_SQL, "geo_places": PLACES_SQL, "spatial_enrich": ENRICH_SQL}
