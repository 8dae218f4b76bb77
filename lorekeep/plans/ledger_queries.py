"""Queries of the ledger and report operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import ledger as L
from lorekeep.operators.clauses import verdict_token
from lorekeep.operators.graph import edge_key
from lorekeep.plans import bindings as B
from lorekeep.plans.graph_queries import THEOREMS, theorems

E_SQL = f"WITH {B.EPISODES}, d AS (SELECT *, CASE kind WHEN 'agreement' THEN 0.02 WHEN 'kicker' THEN 0.1 WHEN 'correction' THEN 0.08 WHEN 'disagreement' THEN -0.15 * coalesce(belief_trust, 0.5) WHEN 'logic_violation' THEN -0.15 END::DOUBLE AS delta FROM episodes)"
FOLD = "list_reduce(list_prepend(0.5::DOUBLE, list(delta ORDER BY us, id)), lambda a, x: greatest(0::DOUBLE, least(1::DOUBLE, a + x)))"


def with_delta(s, d):
    return B.episodes(s, d).withColumn("delta", L.episode_delta(F.col("kind"), F.col("belief_trust")))


def _trust(s, d):
    own = B.table(s, d, "events").select(F.col("user_id").alias("stakeholder")).where("stakeholder % 40 = 0").distinct()
    return L.trust_fold(with_delta(s, d), own)


def _echo(s, d):
    e = B.events(s, d)
    token = verdict_token(F.when(F.col("k") % 13 == 0, "inconsistent").otherwise("resolved"), F.col("value") / 100)
    return e.select("event_id", L.trust_echo(token, F.col("k") % 3 == 0, F.col("k") % 31 == 0).alias("episode"))


def _fingerprint(s, d):
    t = theorems(s, d)
    return L.kb_fingerprint({"theorems": t, "axioms": t.where("postable")})


def _metrics(s, d):
    t = B.table
    return L.snapshot_metrics({"dictionary": (t(s, d, "part"), F.lit(True)), "active_theorems": (theorems(s, d), ~F.col("archived")), "others": (t(s, d, "customer"), F.col("c_custkey") != 0), "episodes": (B.episodes(s, d), F.lit(True))})


def _funnel(s, d):
    doc = B.table(s, d, "documents").join(B.table(s, d, "labels"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("accept")
    return L.funnel(doc.select(F.col("lang").alias("step"), verdict.alias("verdict")))


def _integrity(s, d):
    t = theorems(s, d)
    docs = t.where("not archived").select("id").unionByName(B.table(s, d, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("id")))
    return L.integrity(t, docs).groupBy("problem").agg(F.count("*").alias("n"))


def _diff(s, d):
    p = B.table(s, d, "part")
    old = p.where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("digest"), F.array("p_brand").alias("senses"))
    new = p.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("digest"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array("p_brand")).alias("senses"))
    return L.version_diff(old, new)


def _coverage(s, d):
    c = B.table(s, d, "customer").select(F.col("c_custkey").alias("item"))
    o = B.table(s, d, "orders").select(F.col("o_custkey").alias("item")).where("item % 3 > 0")
    return L.coverage(c.where("item % 2 = 0"), o)


def _sources(s, d):
    c = B.table(s, d, "customer").select(F.col("c_name").alias("subject"), F.col("c_mktsegment").alias("klass"))
    n = B.table(s, d, "nation").select(F.col("n_name").alias("subject"), F.lit(0.3).alias("trust"))
    return L.net_sources([c, n])


def _spawn(s, d):
    e = B.events(s, d)
    cand = e.select(F.col("event_id").alias("id"), F.when(F.col("k") % 5 > 0, F.col("user_id")).alias("source"), F.col("event_type").alias("trigger"), (F.col("k") % 3).alias("action"))
    return L.spawn_dedup(cand.where("id % 2 = 0"), cand.where("id % 2 = 1"))


def _groups(s, d):
    o = B.table(s, d, "orders")
    rows = o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("subject"), F.col("o_orderpriority").alias("predicate"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("object"), F.array((F.col("o_orderkey") % 37).cast("string"), (F.col("o_orderkey") % 11).cast("string")).alias("premises"))
    return L.conflict_groups(rows)


GROUPS = """conf AS (SELECT 'c' || (o_custkey % 50) || '|' || o_orderpriority || '|' || CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END AS signature, unnest([(o_orderkey % 37)::VARCHAR, (o_orderkey % 11)::VARCHAR]) AS p FROM orders)"""


def _docs(s):
    return s.range(60).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 17 == 0, "hypothesis").otherwise("theorem").alias("kind"), (F.col("id") % 4 > 0).alias("readonly")).where("id % 5 > 0")


def _convict(s, d):
    return L.convict(_groups(s, d), _docs(s)).withColumn("convicted", F.array_join("convicted", ","))


def _fallen(s, d):
    """Each customer's first order rests on the customer, later ones on the one before; convicted documents are customers."""
    verdicts = L.convict(_groups(s, d), _docs(s)).withColumn("convicted", F.transform("convicted", lambda x: F.concat(F.lit("C:"), x)))
    chains = theorems(s, d).withColumn("archived", F.col("archived") & F.endswith("id", F.lit("7"))).withColumn("premises", F.slice("premises", -1, 1))
    return L.convict_dependents(verdicts, chains)


def _ledger(s, d):
    g = _groups(s, d)
    old = g.where("length(signature) % 2 = 0").select("signature", F.when(F.length("signature") % 3 == 0, "resolved").otherwise("open").alias("status"), (F.length("signature") % 4).alias("generation"))
    return L.reductio_ledger(old, g.where("size(premises) > 2"))


def _retreat(s, d):
    o = B.table(s, d, "orders")
    docs = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("archived"), (F.col("o_orderkey") % 3 == 0).alias("readonly"))
    return L.apply_retreat(docs, o.where("o_custkey % 4 = 0").select(F.col("o_orderkey").alias("id")), docs.where("id % 50 = 0").select((F.col("id") + 10000000).alias("id"), F.lit(False).alias("archived"), F.lit(False).alias("readonly")))


def _retreat_cascade(s, d):
    docs = theorems(s, d).select("id", "archived", (F.length("id") % 2 == 0).alias("readonly"), "premises")
    accepted = docs.select("id").where("id like '%7'")
    return L.apply_retreat(docs, accepted, docs.limit(0)).select("id", "archived")


def _concl_trust(s, d):
    t = theorems(s, d)
    known = t.select(F.col("id").alias("key"), F.col("trusted").alias("trust"))
    bar = F.when(F.col("archived"), F.concat("premises", F.array(edge_key(F.lit("a"), F.lit("b"))))).otherwise(F.col("premises"))
    return L.conclusion_trust(t.select("id", bar.alias("premises")), known).withColumn("trust", F.round("trust", 6))


def _bands(s, d):
    t = _trust(s, d)
    return t.select("stakeholder", L.trust_bands(F.col("trust"), F.col("stakeholder") % 40 == 0, F.col("stakeholder") == 7, F.when(F.col("stakeholder") % 3 == 0, "chat")).alias("band"))


def _confidence(s, d):
    e = B.events(s, d)
    truth = F.col("value") / 100
    c = L.verdict_confidence(verdict_token(F.when(F.col("k") % 13 == 0, "inconsistent").otherwise("resolved"), truth), truth, F.lit(0.7))
    return e.select("event_id", F.round(c, 6).alias("confidence"), L.hedge(c).alias("hedge"))


QUERIES = {
    "episode_delta": lambda s, d: with_delta(s, d).select("id", "delta"),
    "trust_fold": lambda s, d: _trust(s, d).withColumn("trust", F.round("trust", 6)),
    "trust_bands": _bands,
    "trust_echo": _echo,
    "kb_fingerprint": _fingerprint,
    "snapshot_metrics": _metrics,
    "funnel": _funnel,
    "phase_counts": lambda s, d: L.phase_counts(B.events(s, d).select(F.col("event_type").alias("phase"), (F.col("k") > 80).alias("error"), "us")),
    "churn": lambda s, d: L.churn(B.table(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("conclusion"))),
    "integrity": _integrity,
    "version_diff": _diff,
    "active_mimics": lambda s, d: L.active_mimics(B.events(s, d).select(F.col("user_id").alias("scope"), (F.col("k") % 9 == 0).alias("enabled"))),
    "coverage": _coverage,
    "net_sources": _sources,
    "dedup_anti": lambda s, d: L.dedup_anti(B.table(s, d, "customer").select("c_custkey"), B.table(s, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]),
    "spawn_dedup": _spawn,
    "conflict_groups": lambda s, d: _groups(s, d).withColumn("premises", F.array_join("premises", ",")),
    "convict": _convict,
    "convict_dependents": _fallen,
    "reductio_ledger": _ledger,
    "apply_retreat": _retreat,
    "apply_retreat_cascade": _retreat_cascade,
    "conclusion_trust": _concl_trust,
    "significance": lambda s, d: B.events(s, d).select("event_id", F.round(L.significance(F.col("k") % 2 == 0, F.col("k") % 3 == 0, F.col("k") % 5 == 0), 6).alias("significance")),
    "verdict_confidence": _confidence,
}

_TRUST = f"t AS (SELECT stakeholder, CASE WHEN stakeholder % 40 = 0 THEN 1.0::DOUBLE ELSE {FOLD} END AS trust FROM d GROUP BY stakeholder)"
_TOKEN = "CASE WHEN k % 13 = 0 THEN 'inconsistent' WHEN value / 100 > 0.85 THEN 'true' WHEN value / 100 < 0.15 THEN 'false' END"
_CONF = f"CASE {_TOKEN} WHEN 'inconsistent' THEN 1.0 WHEN 'true' THEN value / 100 * 0.7 WHEN 'false' THEN (1 - value / 100) * 0.7 END::DOUBLE"

_CONVICT = f"""WITH {GROUPS}, u AS (SELECT DISTINCT * FROM conf), docs AS (SELECT i::VARCHAR AS id, CASE WHEN i % 17 = 0 THEN 'hypothesis' ELSE 'theorem' END AS kind, i % 4 > 0 AS readonly FROM range(60) x(i) WHERE i % 5 > 0),
j AS (SELECT signature, id, kind, readonly FROM u LEFT JOIN docs ON id = p), g AS (SELECT signature, count(*) FILTER (kind = 'hypothesis') AS h, string_agg(CASE WHEN kind = 'hypothesis' THEN id END, ',' ORDER BY id) AS hyp, count(*) FILTER (kind <> 'hypothesis' AND NOT readonly) AS s, string_agg(CASE WHEN kind <> 'hypothesis' AND NOT readonly THEN id END, ',' ORDER BY id) AS soft, count(kind) AS docs FROM j GROUP BY 1)
SELECT signature, CASE WHEN h > 0 OR s = 1 THEN 'convicted' WHEN s > 1 THEN 'asked' WHEN docs = 0 THEN 'unresolvable' ELSE 'constitution' END AS verdict, CASE WHEN h > 0 THEN hyp WHEN s = 1 THEN soft ELSE '' END AS convicted FROM g"""
_FALLEN = f"""WITH RECURSIVE {THEOREMS}, verdict AS ({_CONVICT}),
root AS (SELECT DISTINCT signature, 'C:' || unnest(string_split(convicted, ',')) AS premise FROM verdict WHERE convicted <> ''),
needs AS (SELECT id, premises[-1] AS premise FROM theorems WHERE NOT (archived AND id LIKE '%7')),
dep AS (SELECT signature, id FROM needs JOIN root USING (premise) UNION SELECT signature, n.id FROM dep JOIN needs n ON n.premise = dep.id) SELECT * FROM dep"""

ORACLES = {
    "episode_delta": f"{E_SQL} SELECT id, delta FROM d",
    "trust_fold": f"{E_SQL}, {_TRUST} SELECT stakeholder, round(trust, 6) AS trust FROM t",
    "trust_bands": f"{E_SQL}, {_TRUST} SELECT stakeholder, CASE WHEN stakeholder = 7 THEN 'self' WHEN stakeholder % 40 = 0 THEN 'maker' ELSE CASE WHEN round(trust, 6) >= 0.65 THEN 'trusted' WHEN round(trust, 6) >= 0.45 THEN 'neutral' ELSE 'wary' END || CASE WHEN stakeholder % 3 = 0 THEN '@chat' ELSE '' END END AS band FROM t",
    "trust_echo": f"WITH {B.EVENTS}, t AS (SELECT *, {_TOKEN} AS token FROM ev) SELECT event_id, CASE WHEN k % 31 = 0 THEN 'self_inconsistency' WHEN token = 'inconsistent' THEN 'logic_violation' WHEN token = 'true' AND k % 3 = 0 THEN 'kicker' WHEN token = 'true' THEN 'agreement' WHEN token = 'false' THEN 'disagreement' END AS episode FROM t",
    "kb_fingerprint": f"WITH {THEOREMS} SELECT 'axioms:' || (SELECT count(*) || ':' || max(created) FROM theorems WHERE NOT archived AND postable) || ';theorems:' || (SELECT count(*) || ':' || max(created) FROM theorems WHERE NOT archived) AS fingerprint",
    "snapshot_metrics": "SELECT 'dictionary' AS metric, count(*) AS value FROM part UNION ALL SELECT 'active_theorems', count(*) FILTER (o_orderstatus <> 'F') FROM orders UNION ALL SELECT 'others', count(*) FILTER (c_custkey <> 0) FROM customer UNION ALL SELECT 'episodes', count(*) FROM events",
    "funnel": "WITH v AS (SELECT lang AS step, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'accept' END AS verdict FROM documents JOIN labels USING (doc_id)) SELECT step, verdict, count(*) AS n FROM v GROUP BY ROLLUP (step, verdict) HAVING step IS NOT NULL",
    "phase_counts": f"WITH {B.EVENTS} SELECT event_type AS phase, count(*) AS n, count(*) FILTER (k > 80) AS errors, min(us) AS first, max(us) AS last FROM ev GROUP BY 1",
    "churn": "SELECT l_orderkey || '-' || l_linenumber AS conclusion, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "integrity": f"WITH {THEOREMS}, p AS (SELECT id, unnest(premises) AS premise FROM theorems), docs AS (SELECT id FROM theorems WHERE NOT archived UNION ALL SELECT 'C:' || c_custkey FROM customer WHERE c_custkey % 3 > 0) SELECT 'unresolved ' || premise AS problem, count(*) AS n FROM p WHERE premise NOT IN (SELECT id FROM docs) GROUP BY 1",
    "version_diff": """WITH o AS (SELECT p_partkey AS id, p_name AS od FROM part WHERE p_partkey % 7 > 0), n AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_name || '!' ELSE p_name END AS nd, p_size % 2 = 0 AS more FROM part WHERE p_partkey % 5 > 0)
SELECT count(*) AS total, count(*) FILTER (od <> nd) AS changed, count(*) FILTER (od IS NULL) AS gained, count(*) FILTER (nd IS NULL) AS lost, count(*) FILTER (od IS NOT NULL AND more) AS gained_senses FROM o FULL JOIN n USING (id)""",
    "active_mimics": f"WITH {B.EVENTS} SELECT user_id AS scope, count(*) AS n, greatest(0, 8 - count(*)) AS room FROM ev WHERE k % 9 = 0 GROUP BY 1",
    "coverage": "WITH e AS (SELECT DISTINCT c_custkey AS item FROM customer WHERE c_custkey % 2 = 0), g AS (SELECT DISTINCT o_custkey AS item FROM orders WHERE o_custkey % 3 > 0) SELECT CASE WHEN e.item IS NULL THEN 'extra' WHEN g.item IS NULL THEN 'missing' ELSE 'found' END AS status, coalesce(e.item, g.item) AS item FROM e FULL JOIN g ON e.item = g.item",
    "net_sources": "SELECT c_name AS subject, c_mktsegment AS klass, NULL::DOUBLE AS trust FROM customer UNION ALL SELECT n_name, NULL, 0.3 FROM nation",
    "dedup_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)",
    "spawn_dedup": f"""WITH {B.EVENTS}, c AS (SELECT event_id AS id, CASE WHEN k % 5 > 0 THEN user_id END AS source, event_type AS "trigger", k % 3 AS action FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY source, "trigger", action ORDER BY id) AS r FROM c WHERE id % 2 = 0)
SELECT id, source, "trigger", action FROM n WHERE source IS NULL OR (r = 1 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.id % 2 = 1 AND x.source = n.source AND x."trigger" = n."trigger" AND x.action = n.action))""",
    "conflict_groups": f"WITH {GROUPS}, u AS (SELECT DISTINCT * FROM conf) SELECT signature, string_agg(p, ',' ORDER BY p) AS premises FROM u GROUP BY 1",
    "convict": _CONVICT,
    "convict_dependents": _FALLEN,
    "reductio_ledger": f"""WITH {GROUPS}, g AS (SELECT signature, count(DISTINCT p) AS n FROM conf GROUP BY 1), o AS (SELECT signature, CASE WHEN length(signature) % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, length(signature) % 4 AS generation FROM g WHERE length(signature) % 2 = 0), w AS (SELECT signature, true AS now FROM g WHERE n > 2)
SELECT signature, CASE WHEN now THEN 'open' WHEN status = 'open' THEN 'resolved' ELSE status END AS status, CASE WHEN generation IS NULL THEN 0 WHEN now AND status = 'resolved' THEN generation + 1 ELSE generation END AS generation FROM o FULL JOIN w USING (signature)""",
    "apply_retreat": "SELECT o_orderkey AS id, o_orderstatus = 'F' OR (o_custkey % 4 = 0 AND o_orderkey % 3 <> 0) AS archived, o_orderkey % 3 = 0 AS readonly FROM orders UNION ALL SELECT o_orderkey + 10000000, false, false FROM orders WHERE o_orderkey % 50 = 0",
    "apply_retreat_cascade": f"""WITH RECURSIVE {THEOREMS}, d AS (SELECT id, archived, length(id) % 2 = 0 AS readonly, premises FROM theorems), needs AS (SELECT id, unnest(premises) AS premise FROM d WHERE NOT archived),
gone AS (SELECT id FROM d WHERE id LIKE '%7' AND NOT readonly UNION SELECT n.id FROM gone g JOIN needs n ON n.premise = g.id) SELECT id, archived OR (NOT readonly AND id IN (SELECT id FROM gone)) AS archived FROM d""",
    "conclusion_trust": f"""WITH {THEOREMS}, p AS (SELECT id, unnest(CASE WHEN archived THEN list_append(premises, 'a|is_a|b') ELSE premises END) AS key FROM theorems)
SELECT p.id, round(least(0.9, min(coalesce(t.trusted, CASE WHEN contains(key, '|') THEN 0.3 END, 0.9))), 6)::DOUBLE AS trust FROM p LEFT JOIN theorems t ON t.id = key GROUP BY 1""",
    "significance": f"WITH {B.EVENTS} SELECT event_id, round(least(1.0, 0.7 + CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS significance FROM ev",
    "verdict_confidence": f"WITH {B.EVENTS} SELECT event_id, round({_CONF}, 6) AS confidence, CASE WHEN {_CONF} < 0.45 THEN 'maybe' WHEN {_CONF} < 0.7 THEN 'probably' END AS hedge FROM ev",
}
