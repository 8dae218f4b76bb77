"""Queries of corrections, repairs, sinks and public rows, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorekeep.operators import extraction as X
from lorekeep.operators import graph as G
from lorekeep.operators import revision as R
from lorekeep.plans import bindings as B
from lorekeep.plans.extraction_queries import _CAND, leaves, sql
from lorekeep.plans.graph_queries import _PLACES, R_SQL, THEOREMS, _closure, _place_pairs, _places, theorems
from lorekeep.runtime import cut
from lorekeep.sources import tables as S


def _folder(s):
    """A new folder beside the checkpoints, which all executors share."""
    cut(s.range(1))
    return f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"


def _append(s, d):
    log, path = B.log(s, d), _folder(s)
    S.append_log(log.where("channel < 5"), path)
    S.append_log(log.where("channel >= 5"), path)
    return s.read.parquet(path).select("id", F.date_format("event_date", "yyyy-MM-dd").alias("day"))


def _rebuild(s, d):
    e, path = B.edges(s, d), _folder(s)
    S.rebuild_tier(e.withColumn("method", F.substring("child", 1, 1)), path)
    S.rebuild_tier(e.where("child like 'C:%'").select("child", F.lit("moved").alias("parent"), F.lit("C").alias("method")), path)
    return s.read.parquet(path).select("child", "parent", "method")


def _claims(s, d):
    o = B.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("speaker"), F.concat(F.lit("s"), (F.col("o_custkey") % 8).cast("string")).alias("subject"), F.col("o_orderpriority").alias("predicate"), F.element_at(F.array(F.lit("O"), F.lit("A"), F.lit("E")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("corner"))


def _targets(s, d):
    li = B.table(s, d, "part")
    rules = li.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.concat(F.lit("s"), (F.col("p_partkey") % 8).cast("string")).alias("subject"), F.element_at(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), (F.col("p_size") % 2 + 1).cast("int")).alias("predicate"), (F.col("p_partkey") % 5 == 0).alias("negated")).where("length(rule_id) < 4")
    src = li.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_name").alias("doc"), (F.col("p_size") / 50).alias("trust"), (F.col("p_partkey") % 7 == 0).alias("readonly"))
    return R.correction_target(_claims(s, d), rules, src)


_TARGET = """claims AS (SELECT o_orderkey AS claim_id, o_custkey AS speaker, 's' || (o_custkey % 8) AS subject, o_orderpriority AS predicate FROM orders WHERE o_orderkey % 3 <> 1),
target AS (SELECT claim_id, speaker, 'r' || p_partkey AS rule_id, p_size / 50 AS belief_trust FROM claims JOIN part ON subject = 's' || (p_partkey % 8) AND predicate = CASE WHEN p_size % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND length('r' || p_partkey) < 4)"""


def _accept(s, d):
    trust = B.table(s, d, "customer").select(F.col("c_custkey").alias("speaker"), (F.col("c_custkey") % 10 / 10).alias("trust"))
    return R.accept_correction(_targets(s, d), _claims(s, d), trust)


def _differentia(s, d):
    rows = leaves(s, d)
    genus = X.candidate_edges(rows).select("doc_id", F.col("subject").alias("klass"), F.col("object").alias("genus"), F.col("object").endswith("3").alias("abstract"))
    return R.differentia_rules(rows, genus)


def _sense_fix(s, d):
    n = B.table(s, d, "nation")
    r = B.table(s, d, "region").select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")).alias("sense"), "r_regionkey")
    sib = r.select("sense", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), "r_regionkey").select("sense", F.concat(F.lit("R:"), ((F.col("r_regionkey") + F.col("rank")) % 5).cast("string")).alias("sibling"), "rank")
    return R.graph_sense_fix(n.select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R:"), (F.col("n_nationkey") % 5).cast("string")).alias("parent")), sib, _closure(s, d))


def _place(s, d):
    pairs = _place_pairs(s, d)
    claims = pairs.select(F.concat_ws(">", "inner", "outer").alias("claim_id"), F.col("inner").alias("subject"), F.col("outer").alias("object"), F.col("outer").endswith("1").alias("negated")).distinct()
    return R.ground_place(claims, G.place_contains(pairs, _places(s, d)))


def _definition(s, d):
    e = B.events(s, d)
    return R.ground_definition(e.select(F.col("user_id").alias("claim_id"), (F.col("user_id") % 2 == 0).alias("negated"), (F.col("user_id") % 7 == 0).alias("unknown"), (F.col("value") / 1000).alias("sim"))).withColumn("truth", F.round("truth", 6))


def _marker(s, d):
    v = B.vectors(s, d).withColumn("word", F.concat(F.lit("w"), (F.col("vec_id") % 150).cast("string")))
    markers = v.groupBy("label").agg(F.min(F.struct("vec_id", "word", "vector")).alias("m")).select("m.*")
    return R.nearest_marker(v.where("vec_id % 100 = 0"), markers, 0.3)


def _requeue(s, d):
    log = B.log(s, d)
    return R.requeue(log, log.where("id % 100 = 0").select(F.col("senses")[1].alias("sense")).distinct())


def _posts(s, d):
    """Theorems about customers, who have names of one and of two words; the label of every 50th gives somebody away."""
    t, k = theorems(s, d), F.col("c_custkey")
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    label = F.when(k % 50 == 0, "a pal of ann 2").when(k % 3 == 0, "somebody $1").otherwise("a friend")
    people = B.table(s, d, "customer").select(text("C:", k, ";").alias("uid"), F.when(k % 2 == 0, text("Ann ", k)).otherwise(text("C++", k)).alias("name"), label.alias("label"), (k % 7 == 0).alias("is_me"))
    number = F.substring(F.col("premises")[0], 3, 20).cast("long")
    name = F.when(number % 2 == 0, text("aNN ", number)).otherwise(text("c++", number))
    said = text("said by ", name, " (c:", number, ";) to Annabel")
    t = t.withColumn("premises", F.concat(F.array(said), F.slice("premises", 2, F.greatest(F.size("premises") - 1, F.lit(0)))))
    t = t.withColumn("id", F.when(F.length("id") % 2 == 0, F.col("id"))).withColumn("original", F.when(F.size("premises") > 1, F.col("original"))).withColumn("derived_by", F.when(F.col("archived"), "taught"))
    return R.post_rows(t, people)


def _routes(s, d):
    routes = s.createDataFrame([("speak", "error", "apology"), ("speak", None, "remark"), ("nod", None, "gesture")], "action string, trigger string, category string")
    return R.route_category(B.events(s, d).select(F.col("event_id").alias("id"), F.element_at(F.array(F.lit("speak"), F.lit("nod"), F.lit("ask")), (F.col("k") % 3 + 1).cast("int")).alias("action"), F.col("event_type").alias("trigger")), routes)


QUERIES = {
    "append_log": _append,
    "rebuild_tier": _rebuild,
    "correction_target": lambda s, d: _targets(s, d).select("claim_id", "rule_id", "belief_trust", F.size("docs").alias("docs")),
    "accept_correction": _accept,
    "differentia_rules": _differentia,
    "graph_sense_fix": _sense_fix,
    "ground_place": lambda s, d: _place(s, d).select("claim_id", "holds"),
    "ground_definition": _definition,
    "nearest_marker": _marker,
    "requeue": _requeue,
    "post_rows": _posts,
    "route_category": _routes,
}

ORACLES = {
    "nearest_marker": f"""WITH {B.VECTORS}, m AS (SELECT label, min(vec_id) AS mid FROM vecs GROUP BY 1), mk AS (SELECT mid, 'w' || (mid % 150) AS word, vector AS mv FROM m JOIN vecs ON vec_id = mid), q AS (SELECT vec_id, 'w' || (vec_id % 150) AS word, vector FROM vecs WHERE vec_id % 100 = 0),
e AS (SELECT vec_id, mid FROM q JOIN mk USING (word)), n AS (SELECT vec_id, mid, round(list_cosine_similarity(vector, mv), 6) AS s FROM q, mk WHERE vec_id NOT IN (SELECT vec_id FROM e)), b AS (SELECT vec_id, arg_min(mid, (-s, mid)) AS near, max(s) AS s FROM n GROUP BY 1)
SELECT vec_id, mid AS marker, 'exact' AS how FROM e UNION ALL SELECT vec_id, CASE WHEN s >= 0.3 THEN near END, CASE WHEN s >= 0.3 THEN 'near' ELSE 'new' END FROM b""",
    "append_log": "SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "rebuild_tier": f"WITH {B.edges_sql()} SELECT child, CASE WHEN child LIKE 'C:%' THEN 'moved' ELSE parent END AS parent, substr(child, 1, 1) AS method FROM edges",
    "correction_target": f"WITH {_TARGET} SELECT claim_id, rule_id, belief_trust, 1 AS docs FROM target",
    "accept_correction": f"WITH {_TARGET} SELECT claim_id, rule_id FROM target WHERE speaker IN (SELECT c_custkey FROM customer) AND speaker % 10 / 10 >= belief_trust",
    "differentia_rules": f"{sql()}, {_CAND} SELECT l.doc_id, l.pos, CASE WHEN c.object LIKE '%3' THEN 'abstract' WHEN substr(split_part(l.predicate, '.', 1), 1, 4) = substr(split_part(c.subject, '.', 1), 1, 4) THEN 'circular' WHEN l.predicate LIKE '%.n.%' THEN 'noun' WHEN l.object IS NULL THEN 'no object' ELSE 'accept' END AS verdict FROM leaves l JOIN cand c USING (doc_id) WHERE l.predicate IS NOT NULL AND l.predicate <> c.object",
    "graph_sense_fix": f"{R_SQL}, t AS (SELECT 'N:' || n_nationkey AS child, 'R:' || (n_nationkey % 5) AS parent, 'R:' || ((n_nationkey + r) % 5) AS s, r FROM nation, range(3) x(r)), b AS (SELECT child, arg_min(s, r) AS fixed FROM t JOIN closure ON node = child AND ancestor = s GROUP BY 1) SELECT DISTINCT t.child, parent, coalesce(fixed, parent) AS fixed FROM t LEFT JOIN b USING (child)",
    "ground_place": f"""WITH {_PLACES}, p AS (SELECT 'C:' || c_custkey AS i_, 'N:' || (c_custkey % 25) AS o_ FROM customer UNION SELECT 'N:' || (c_custkey % 25), 'C:' || c_custkey FROM customer)
SELECT i_ || '>' || o_ AS claim_id, (list_contains(i.path_admin, o_) OR i.parent_admin = o_) <> (o_ LIKE '%1') AS holds FROM p JOIN places i ON i.uid = i_ JOIN places o ON o.uid = o_""",
    "ground_definition": f"WITH {B.EVENTS}, b AS (SELECT user_id, arg_max(value / 1000, (abs(value / 1000 - 0.5), value)) AS s FROM ev GROUP BY 1) SELECT user_id AS claim_id, round(CASE WHEN user_id % 7 = 0 THEN 0.5 WHEN user_id % 2 = 0 THEN 1 - s ELSE s END, 6) AS truth FROM b",
    "requeue": f"WITH {B.LOG}, n AS (SELECT DISTINCT senses[2] AS sense FROM log WHERE id % 100 = 0) SELECT id, 'sense' AS why FROM log WHERE senses[1] IN (SELECT sense FROM n) OR senses[2] IN (SELECT sense FROM n) ORDER BY us DESC, id LIMIT 256",
    "post_rows": f"""WITH {THEOREMS}, said AS (SELECT *, substr(premises[1], 3)::BIGINT AS k FROM theorems WHERE postable AND len(premises) > 1),
shown AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'said by ' || CASE WHEN k % 2 = 0 THEN 'aNN ' ELSE 'c++' END || k || ' (c:' || k || ';) to Annabel' WHEN k % 50 > 0 THEN 'said by ' || CASE WHEN k % 3 = 0 THEN 'somebody $1' ELSE 'a friend' END || ' to Annabel' END AS line FROM said)
SELECT CASE WHEN length(id) % 2 = 0 THEN id ELSE substr(sha1(original), 1, 12) END AS slug, CASE WHEN archived THEN 'taught' ELSE 'chain' END AS kind, false AS multi_hop, CASE WHEN line IS NULL THEN '1. ' ELSE '1. ' || line || chr(10) || '2. ' END || premises[2] AS proof FROM shown""",
    "route_category": f"WITH {B.EVENTS} SELECT event_id AS id, CASE k % 3 WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'apology' ELSE 'remark' END WHEN 1 THEN 'gesture' ELSE 'plain' END AS category FROM ev",
}
