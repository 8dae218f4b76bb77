"""Queries of the graph operators, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.plans import bindings as B

R_SQL = "WITH RECURSIVE " + B.closure_sql()


def _closure(s, d, deep=False):
    return G.ancestors(B.edges(s, d, deep))


def _cust(s, d):
    return B.table(s, d, "customer").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("c"), F.col("c_custkey").alias("k"))


_P = {
    "world": lambda k: F.concat(F.lit("R:"), (k % 5).cast("string")),
    "supp": lambda k: F.concat(F.lit("S:"), (k % 10).cast("string")),
    "nation": lambda k: F.concat(F.lit("N:"), (k % 25).cast("string")),
}


def tiers(s):
    return s.createDataFrame([(1, f"R:{i}") for i in range(5)] + [(2, "N:0"), (2, "N:1"), (2, "N:2"), (2, "N:3")], "tier int, anchor string")


TIERS = "tiers AS (SELECT 1 AS tier, 'R:' || i AS anchor FROM range(5) x(i) UNION ALL SELECT 2, 'N:' || i FROM range(4) y(i))"


def _tier_parts(s, d):
    e = B.edges(s, d).withColumn("k", F.xxhash64("child") * 0 + F.length("child"))
    return e.where("child like 'C:%' and k % 2 = 0"), e.where("child like 'C:%'"), e.where("child like 'S:%' or k % 3 = 0")


TIER_SQL = B.edges_sql() + """, parts AS (SELECT child, parent, 0 AS tier FROM edges WHERE child LIKE 'C:%' AND length(child) % 2 = 0 UNION ALL SELECT child, parent, 1 FROM edges WHERE child LIKE 'C:%'
 UNION ALL SELECT child, parent, 2 FROM edges WHERE child LIKE 'S:%' OR length(child) % 3 = 0), tiered AS (SELECT child, parent, min(tier)::INT AS tier FROM parts GROUP BY 1, 2)"""


def _places(s, d):
    r = B.table(s, d, "region").select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")).alias("uid"), F.lit("world").alias("parent_admin"), F.array(F.lit("world")).alias("path_admin"))
    reg = F.concat(F.lit("R:"), F.col("n_regionkey").cast("string"))
    n = B.table(s, d, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("uid"), F.col("n_nationkey").alias("nk"), reg.alias("parent_admin"), F.array(F.lit("world"), reg).alias("path_admin"))
    c = B.table(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("nk")).select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("cu"), F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("uid")).alias("parent_admin"), F.concat("path_admin", F.array("uid")).alias("path_admin")).withColumnRenamed("cu", "uid")
    out = r.unionByName(n.drop("nk")).unionByName(c)
    return out.select("uid", "parent_admin", F.when(F.col("uid").like("C:%"), F.lit("sea")).otherwise(F.lit("")).alias("parent_geo"), "path_admin", F.array().cast("array<string>").alias("path_geo"), F.array().cast("array<string>").alias("physical_features"))


def _place_pairs(s, d):
    c = _cust(s, d)
    return c.select(F.col("c").alias("inner"), _P["nation"](F.col("k")).alias("outer")).unionByName(c.select(_P["nation"](F.col("k")).alias("inner"), F.col("c").alias("outer"))).unionByName(c.select(F.col("c").alias("inner"), F.lit("atlantis").alias("outer")))


def theorems(s, d):
    """Orders as theorems: premises are the customer and the customer's previous order."""
    o = B.table(s, d, "orders")
    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    c = F.concat(F.lit("C:"), F.col("o_custkey").cast("string"))
    row = o.withColumn("prev", prev)
    premises = F.when(F.col("prev").isNotNull(), F.array(c, F.concat(F.lit("O:"), F.col("prev").cast("string")))).otherwise(F.array(c))
    return row.select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("id"), (F.col("o_orderstatus") == "F").alias("archived"), (F.col("o_orderkey") % 97 != 0).alias("postable"), premises.alias("premises"), F.least(F.lit(0.9), F.floor("o_totalprice") / 500000).alias("trusted"), F.col("o_orderpriority").alias("original"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"))


THEOREMS = """seq AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
theorems AS (SELECT 'O:' || o_orderkey AS id, o_orderstatus = 'F' AS archived, o_orderkey % 97 <> 0 AS postable, CASE WHEN prev IS NULL THEN ['C:' || o_custkey] ELSE ['C:' || o_custkey, 'O:' || prev] END AS premises,
 least(0.9::DOUBLE, floor(o_totalprice) / 500000) AS trusted, o_orderpriority AS original, CAST(epoch(o_orderdate) AS BIGINT) AS created FROM seq)"""


def _cascade(s, d):
    ids = _cust(s, d).where("k % 10 = 3").select(F.col("c").alias("id"))
    return G.revoke_cascade(theorems(s, d), ids)


def _edge_trust(s, d):
    e = B.edges(s, d).select(G.edge_key(F.col("child"), F.col("parent")).alias("key"), F.length("child").alias("n"))
    a = e.select("key", (F.col("n") / 10).alias("trust"), F.lit(0).alias("precedence"), (F.col("n") % 2 == 0).alias("generic"))
    return G.edge_trust(a.unionByName(e.where("n % 3 = 0").select("key", F.lit(0.9).alias("trust"), F.lit(1).alias("precedence"), F.lit(True).alias("generic"))))


def _edge_sources(s, d):
    e = B.edges(s, d).withColumn("source_id", F.explode(F.array(F.col("parent"), F.lit("doc"))))
    docs = e.select(F.col("source_id").alias("id"), F.lit("axiom").alias("kind"), (F.col("source_id") == "doc").alias("readonly")).distinct()
    return G.edge_sources(e, docs).select("key", F.size("sources").alias("n"), F.col("sources")[0]["id"].alias("first"))


def _premises(s, d):
    sources = G.edge_source(G.union_tiers(*_tier_parts(s, d)))
    paths = _closure(s, d)
    return G.path_premises(paths, sources).select("node", "ancestor", F.array_join("premises", ",").alias("premises"))


def _antonyms(s, d):
    p = B.table(s, d, "part")
    relation = F.when(F.col("p_partkey") % 3 == 0, "similar_to").otherwise("antonym")
    return G.antonyms(p.select(relation.alias("relation"), F.col("p_name").alias("subject"), F.concat(F.lit("anti "), "p_brand").alias("object")))


def _relation_union(s, d):
    e = B.edges(s, d).select(F.col("child").alias("subject"), F.col("parent").alias("object"))
    return G.relation_union(e.where("subject like 'C:%'"), e.where("subject not like 'S:%'"))


def _charitable(s, d):
    """Customers, with the next three customers as siblings, against nations and their next two."""
    c = B.table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    n = c.agg(F.count("*").alias("n"))
    near = c.join(F.broadcast(n)).select("k", "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"))
    sib = near.select(text("C:", F.col("k")).alias("sense"), text("C:", (F.col("k") + F.col("rank")) % F.col("n")).alias("sibling"), "rank")
    z = B.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("rank"))
    sib = sib.unionByName(z.select(text("N:", F.col("k")).alias("sense"), text("N:", (F.col("k") + F.col("rank")) % 25).alias("sibling"), "rank"))
    pairs = c.select(text("C:", F.col("k")).alias("child"), text("N:", F.col("k") % 25).alias("parent"))
    return G.charitable_subsumes(pairs, sib, _closure(s, d))


QUERIES = {
    "ancestors": lambda s, d: _closure(s, d, deep=True).select("node", "ancestor", "depth", F.array_join("path", ">").alias("path")),
    "subsumes": lambda s, d: G.subsumes(_cust(s, d).select(F.col("c").alias("child"), _P["world"](F.col("k")).alias("parent")), _closure(s, d)).withColumn("path", F.array_join("path", ">")),
    "part_of": lambda s, d: G.part_of(_cust(s, d).select(F.col("c").alias("part"), _P["world"](F.col("k")).alias("whole")).unionByName(_cust(s, d).select(_P["world"](F.col("k")).alias("part"), F.col("c").alias("whole"))), _closure(s, d)),
    "disjoint": lambda s, d: G.disjoint(_cust(s, d).select(F.col("c").alias("a"), _P["supp"](F.col("k")).alias("b")), _closure(s, d), tiers(s)),
    "union_tiers": lambda s, d: G.union_tiers(*_tier_parts(s, d)),
    "edge_source": lambda s, d: G.edge_source(G.union_tiers(*_tier_parts(s, d))),
    "edge_trust": _edge_trust,
    "edge_sources": _edge_sources,
    "path_premises": _premises,
    "place_contains": lambda s, d: G.place_contains(_place_pairs(s, d), _places(s, d)),
    "place_parent": lambda s, d: G.place_parent(_places(s, d)),
    "antonyms": _antonyms,
    "relation_union": _relation_union,
    "charitable_subsumes": _charitable,
    "revoke_cascade": _cascade,
    "postable_taint": lambda s, d: G.postable_taint(theorems(s, d)),
}

_PLACES = """places AS (SELECT 'R:' || r_regionkey AS uid, 'world' AS parent_admin, '' AS parent_geo, ['world'] AS path_admin FROM region
 UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, '', ['world', 'R:' || n_regionkey] FROM nation
 UNION ALL SELECT 'C:' || c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'N:' || c_nationkey END, 'sea', ['world', 'R:' || n_regionkey, 'N:' || c_nationkey] FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORACLES = {
    "ancestors": f"WITH RECURSIVE {B.closure_sql(deep=True)} SELECT node, ancestor, depth, array_to_string(path, '>') AS path FROM closure",
    "subsumes": f"{R_SQL} SELECT 'C:' || c_custkey AS child, 'R:' || (c_custkey % 5) AS parent, array_to_string(path, '>') AS path FROM customer LEFT JOIN closure ON node = 'C:' || c_custkey AND ancestor = 'R:' || (c_custkey % 5)",
    "part_of": f"""{R_SQL} SELECT 'C:' || c_custkey AS part, 'R:' || (c_custkey % 5) AS whole, CASE WHEN node IS NOT NULL THEN true END AS holds FROM customer LEFT JOIN closure ON node = 'C:' || c_custkey AND ancestor = 'R:' || (c_custkey % 5)
UNION ALL SELECT 'R:' || (c_custkey % 5), 'C:' || c_custkey, CASE WHEN node IS NOT NULL THEN false END FROM customer LEFT JOIN closure ON node = 'C:' || c_custkey AND ancestor = 'R:' || (c_custkey % 5)""",
    "disjoint": f"""{R_SQL}, {TIERS}, near AS (SELECT node, tier, arg_min(anchor, depth) AS anchor FROM closure JOIN tiers ON ancestor = anchor GROUP BY 1, 2), p AS (SELECT 'C:' || c_custkey AS a, 'S:' || (c_custkey % 10) AS b FROM customer),
m AS (SELECT p.a, p.b, arg_max(x.anchor <> y.anchor, x.tier) AS apart, max(x.tier) AS tier FROM p JOIN near x ON x.node = p.a JOIN near y ON y.node = p.b AND x.tier = y.tier GROUP BY 1, 2)
SELECT a, b, coalesce(apart, false) AS disjoint, CASE WHEN apart THEN tier END AS tier FROM p LEFT JOIN m USING (a, b)""",
    "union_tiers": f"WITH {TIER_SQL} SELECT * FROM tiered",
    "edge_source": f"WITH {TIER_SQL} SELECT *, CASE WHEN tier > 0 THEN child || '|is_a|' || parent END AS source FROM tiered",
    "edge_trust": f"""WITH {B.edges_sql()} SELECT child || '|is_a|' || parent AS key, CASE WHEN length(child) % 3 = 0 THEN 0.7 WHEN length(child) % 2 = 0 THEN least(0.7, length(child) / 10.0) ELSE length(child) / 10.0 END::DOUBLE AS trust FROM edges""",
    "edge_sources": f"WITH {B.edges_sql()} SELECT child || '|is_a|' || parent AS key, 2 AS n, least(parent, 'doc') AS first FROM edges",
    "path_premises": f"""WITH RECURSIVE {B.closure_sql()}, {TIER_SQL[len(B.edges_sql()) + 2:]}, steps AS (SELECT node, ancestor, unnest(list_zip(path[1:len(path) - 1], path[2:])) AS e FROM closure),
k AS (SELECT DISTINCT node, ancestor, e[1] || '|is_a|' || e[2] AS key FROM steps JOIN tiered ON child = e[1] AND parent = e[2] AND tier > 0)
SELECT c.node, c.ancestor, coalesce(string_agg(key, ',' ORDER BY key), '') AS premises FROM closure c LEFT JOIN k ON k.node = c.node AND k.ancestor = c.ancestor GROUP BY 1, 2""",
    "place_contains": f"""WITH {_PLACES}, p AS (SELECT 'C:' || c_custkey AS inner_, 'N:' || (c_custkey % 25) AS outer_ FROM customer UNION ALL SELECT 'N:' || (c_custkey % 25), 'C:' || c_custkey FROM customer UNION ALL SELECT 'C:' || c_custkey, 'atlantis' FROM customer)
SELECT inner_ AS "inner", outer_ AS "outer", CASE WHEN i.uid IS NULL OR o.uid IS NULL THEN NULL ELSE inner_ = outer_ OR list_contains(i.path_admin, outer_) OR i.parent_admin = outer_ END AS contains FROM p LEFT JOIN places i ON i.uid = inner_ LEFT JOIN places o ON o.uid = outer_""",
    "place_parent": f"WITH {_PLACES} SELECT uid, coalesce(nullif(parent_admin, ''), nullif(parent_geo, '')) AS parent, CASE WHEN parent_admin <> '' THEN 'admin' WHEN parent_geo <> '' THEN 'geo' END AS chain FROM places",
    "antonyms": "SELECT p_name AS a, 'anti ' || p_brand AS b FROM part WHERE p_partkey % 3 > 0 UNION SELECT 'anti ' || p_brand, p_name FROM part WHERE p_partkey % 3 > 0",
    "relation_union": f"WITH {B.edges_sql()} SELECT DISTINCT child AS subject, parent AS object FROM edges WHERE child NOT LIKE 'S:%'",
    "charitable_subsumes": f"""{R_SQL}, sib AS (SELECT 'C:' || c_custkey AS sense, 'C:' || ((c_custkey + r) % (SELECT count(*) FROM customer)) AS sibling, r AS rank FROM customer, range(0, 4) x(r)
 UNION ALL SELECT 'N:' || n_nationkey, 'N:' || ((n_nationkey + r) % 25), r FROM nation, range(0, 3) y(r)),
p AS (SELECT 'C:' || c_custkey AS child, 'N:' || (c_custkey % 25) AS parent FROM customer),
h AS (SELECT child, parent, a.sibling AS c, b.sibling AS q, row_number() OVER (PARTITION BY child, parent ORDER BY (a.rank + b.rank > 0), a.rank, b.rank) AS n FROM p JOIN sib a ON a.sense = child JOIN sib b ON b.sense = parent JOIN closure ON node = a.sibling AND ancestor = b.sibling)
SELECT p.child, p.parent, c AS child_sense, q AS parent_sense FROM p LEFT JOIN h ON h.child = p.child AND h.parent = p.parent AND n = 1""",
    "revoke_cascade": f"""WITH RECURSIVE {THEOREMS}, needs AS (SELECT id, unnest(premises) AS premise FROM theorems WHERE NOT archived),
casc AS (SELECT DISTINCT id, 1 AS round, [id] AS path FROM needs JOIN customer ON premise = 'C:' || c_custkey AND c_custkey % 10 = 3 UNION SELECT n.id, round + 1, list_append(path, n.id) FROM casc JOIN needs n ON n.premise = casc.id WHERE NOT list_contains(path, n.id))
SELECT id, min(round)::INT AS round FROM casc GROUP BY 1""",
    "postable_taint": f"""WITH RECURSIVE {THEOREMS}, needs AS (SELECT id, unnest(premises) AS premise FROM theorems), bad AS (SELECT id FROM theorems WHERE NOT postable UNION SELECT n.id FROM bad JOIN needs n ON n.premise = bad.id)
SELECT id, id NOT IN (SELECT id FROM bad) AS postable FROM theorems""",
}
