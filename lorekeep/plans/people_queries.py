"""Queries of the operators on people and documents, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lorekeep.functions import fuzzy
from lorekeep.operators import clauses as C
from lorekeep.operators import graph as G
from lorekeep.operators import people as P
from lorekeep.plans import bindings as B
from lorekeep.plans.meaning_queries import ASSOCIATION, association
from lorekeep.plans.clause_queries import _FUZZY
from lorekeep.plans.graph_queries import _P, R_SQL, _closure, _cust
from lorekeep.plans.ledger_queries import GROUPS, _groups


def people(s, d):
    c = B.table(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("u"), k.cast("string")).alias("uid"), k.cast("string").alias("row_id"), F.when(k % 4 == 0, "individual").otherwise("person").alias("kind"), F.concat(F.lit("chat:"), k.cast("string")).alias("context_key"), F.when(k % 3 == 0, F.concat(F.lit("u"), (k + 40).cast("string"))).alias("canonical_uid"), (k % 10 == 0).alias("imprint"), (k % 100 / 100).alias("trust"))


PEOPLE = "people AS (SELECT 'u' || c_custkey AS uid, c_custkey::VARCHAR AS row_id, CASE WHEN c_custkey % 4 = 0 THEN 'individual' ELSE 'person' END AS kind, 'chat:' || c_custkey AS context_key, CASE WHEN c_custkey % 3 = 0 THEN 'u' || (c_custkey + 40) END AS canonical_uid, c_custkey % 10 = 0 AS imprint, c_custkey % 100 / 100 AS trust FROM customer)"


def _refs(s, d):
    o = B.table(s, d, "orders")
    k, n = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    return o.select(F.when(n == 0, F.concat(F.lit("u"), k)).when(n == 1, k).otherwise(F.concat(F.lit("chat:"), k)).alias("ref"))


def _verdicts(s, d):
    o = B.table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), F.col("o_custkey").alias("speaker"), F.array(F.lit("a|is_a|b"), (k % 40).cast("string"), (k % 7).cast("string")).alias("premises"), F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("unknown")), (k % 3 + 1).cast("int")).alias("token"), F.array(F.when(k % 5 == 0, "chain: x").otherwise("fact")).alias("derivation"), F.concat("o_orderpriority", F.lit("-"), (k % 20011).cast("string")).alias("text"))


VERDICTS = "verd AS (SELECT o_orderkey AS id, o_custkey AS speaker, list_extract(['true', 'false', 'unknown'], (o_orderkey % 3 + 1)::INT) AS token, o_orderkey % 5 = 0 AS chained, o_orderpriority || '-' || (o_orderkey % 20011) AS text FROM orders)"


def _docs(s, d):
    return B.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "axiom").otherwise("theorem").alias("kind"), F.col("n_name").alias("original"))


def _held(s, d):
    return B.table(s, d, "orders").where("o_orderkey % 11 = 0").select(F.concat("o_orderpriority", F.lit("-"), (F.col("o_orderkey") % 20011).cast("string")).alias("text")).distinct()


def _fuzzy(s, d):
    e = B.events(s, d).select("event_id", (F.col("k") / 100).alias("a"), F.least(F.lit(1.0), F.col("value") / 100).alias("b"))
    return e.select("event_id", *[F.round(f(F.col("a"), F.col("b")), 6).alias(n.lower()) for n, f in fuzzy.OPERATORS.items()])


def _glossary(s, d):
    dic = reduce(lambda a, b: a.unionByName(b), [B.table(s, d, "nation").select(F.concat(F.lit(x), F.col("n_nationkey").cast("string"), F.lit(".n.01")).alias("sense"), F.col("n_name").alias("definition")) for x in ("s", "d")])
    return P.sense_glossary(C.statement_senses(B.clauses(s, d)), dic).select("stmt_id", F.array_join("glossary", "; ").alias("glossary"))


def _morning(s, d):
    g = _groups(s, d)
    ledger = g.select("signature", F.when(F.length("signature") % 2 == 0, "open").otherwise("resolved").alias("status"))
    return P.morning_questions(g, ledger, _docs(s, d).withColumn("archived", F.col("kind") == "axiom"))


def _target(s, d):
    src = B.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("u"), (F.col("n_nationkey") * 3).cast("string")).alias("uid"))
    return P.reductio_target(_groups(s, d), src, people(s, d))


def _taught(s, d):
    return P.taught(_verdicts(s, d).select("id", "text", "token", (F.col("id") % 2 == 0).alias("sound"), (F.col("id") % 100 / 100).alias("teacher_trust")), _held(s, d), 0.5)


def _hypotheses(s, d):
    v = _verdicts(s, d)
    return P.hypotheses(v.select("id", "token", (F.col("id") % 2 == 0).alias("sound"), (F.col("id") % 10 / 10).alias("likeness"), (F.col("id") % 100 / 100).alias("speaker_trust")))


def _part(s, d):
    pairs = _cust(s, d).select(F.col("c").alias("part"), _P["world"](F.col("k")).alias("whole"))
    claims = _cust(s, d).select(F.col("k").alias("claim_id"), F.col("c").alias("subject"), _P["world"](F.col("k")).alias("object"), (F.col("k") % 2 == 0).alias("negated"))
    return P.ground_part(claims, G.part_of(pairs, _closure(s, d)))


QUERIES = {
    "resolve_canonical": lambda s, d: P.resolve_canonical(_refs(s, d), people(s, d)),
    "detect_renames": lambda s, d: P.detect_renames(B.events(s, d).select(F.col("user_id").alias("context_key"), F.concat(F.lit("n"), (F.col("k") % 4).cast("string")).alias("name"), "us")).withColumn("aliases", F.array_join("aliases", ",")),
    "premise_docs": lambda s, d: P.premise_docs(_verdicts(s, d), _docs(s, d)),
    "refuting_belief": lambda s, d: P.refuting_belief(_verdicts(s, d), _docs(s, d)),
    "sense_glossary": _glossary,
    "resolve_route": lambda s, d: P.resolve_route(B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), (F.col("o_custkey") * 2).cast("string")).alias("target"), F.when(F.col("o_orderkey") % 4 == 0, "room").alias("destination")), people(s, d)),
    "trace_join": lambda s, d: P.trace_join(B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("inconsistent")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("expected")), _verdicts(s, d).where("id % 6 > 0")),
    "reductio_target": _target,
    "morning_questions": _morning,
    "taught": _taught,
    "hypotheses": _hypotheses,
    "observations": lambda s, d: P.observations(_verdicts(s, d)),
    "derived_theorems": lambda s, d: P.derived_theorems(_verdicts(s, d), _held(s, d)),
    "personal": lambda s, d: P.personal(B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, "I am").otherwise("It is").alias("original")), B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), (F.col("o_custkey") * 3).cast("string")).alias("uid")), people(s, d)),
    "dream_digest": lambda s, d: P.dream_digest(_verdicts(s, d).select(F.col("id").cast("string").alias("id"), F.col("text").alias("original"), (F.col("id") % 2 == 0).alias("postable"), F.col("token").alias("reason"))).select("n"),
    "momentum_pick": lambda s, d: P.momentum_pick(B.log(s, d).select("id", "source_id", F.col("channel").alias("depth"), F.col("original").alias("text")), B.log(s, d).select("source_id", (F.col("source_id") % 10 / 10).alias("trust")).distinct(), B.log(s, d).where("id % 5 = 0").select(F.col("original").alias("text")).distinct()),
    "consolidate": lambda s, d: P.consolidate(B.events(s, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("stakeholder"), (F.col("k") % 3 == 0).alias("used")), B.events(s, d).where("k % 4 = 0").select(F.col("event_id").alias("id")), B.events(s, d).select(F.col("user_id").alias("stakeholder")).distinct().withColumn("trust", F.col("stakeholder") % 11 / 10)),
    "quiet_band": lambda s, d: P.quiet_band(B.log(s, d).join(association(s, d), "channel"), F.col("proximity")).withColumn("urge", F.round("urge", 6)),
    "place_type_sense": lambda s, d: P.place_type_sense(B.table(s, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("type")), B.table(s, d, "part").where("p_size > 48").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"), F.lit("n").alias("pos"), F.col("p_partkey").alias("nr"), F.col("p_brand").alias("sense"))),
    "ground_part": lambda s, d: _part(s, d).select("claim_id", "holds"),
    "best_match": lambda s, d: P.best_match(B.events(s, d).select(F.col("user_id").alias("stmt_id"), (F.col("k") % 20 / 20).alias("score"), F.when(F.col("k") % 2 == 0, "axiom").otherwise("theorem").alias("kind"), F.col("event_id").alias("ordinal"))),
    "fuzzy_ops": _fuzzy,
}

_PD = f"{VERDICTS}, prem AS (SELECT id, 1 AS pos, (id % 40)::VARCHAR AS doc FROM verd UNION ALL SELECT id, 2, (id % 7)::VARCHAR FROM verd), pd AS (SELECT id, pos, doc, CASE WHEN n_nationkey % 2 = 0 THEN 'axiom' ELSE 'theorem' END AS kind, n_name AS original FROM prem JOIN nation ON doc = n_nationkey::VARCHAR)"
_HELD = "held AS (SELECT DISTINCT o_orderpriority || '-' || (o_orderkey % 20011) AS text FROM orders WHERE o_orderkey % 11 = 0)"

ORACLES = {
    "resolve_canonical": f"""WITH {PEOPLE}, refs AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'u' || o_custkey WHEN 1 THEN o_custkey::VARCHAR ELSE 'chat:' || o_custkey END AS ref FROM orders), f AS (SELECT ref, coalesce(u.uid, r.uid, k.uid) AS uid FROM refs LEFT JOIN people u ON u.uid = ref LEFT JOIN people r ON r.row_id = ref LEFT JOIN people k ON k.context_key = ref AND k.kind <> 'individual')
SELECT ref, coalesce(c.uid, f.uid) AS uid FROM f LEFT JOIN people p ON p.uid = f.uid LEFT JOIN people c ON c.uid = p.canonical_uid""",
    "detect_renames": f"WITH {B.EVENTS}, l AS (SELECT user_id, 'n' || arg_max(k % 4, us) AS name FROM ev GROUP BY 1), a AS (SELECT DISTINCT e.user_id, 'n' || (k % 4) AS n FROM ev e) SELECT l.user_id AS context_key, name, coalesce(string_agg(n, ',' ORDER BY n) FILTER (n <> name), '') AS aliases FROM l JOIN a USING (user_id) GROUP BY 1, 2",
    "premise_docs": f"WITH {_PD} SELECT * FROM pd",
    "refuting_belief": f"WITH {_PD} SELECT id, arg_min(original, pos) AS original FROM pd GROUP BY 1",
    "sense_glossary": f"""WITH {B.clauses_sql()}, x AS (SELECT DISTINCT stmt_id, sense FROM (SELECT stmt_id, unnest([s_subject, s_predicate, s_direct]) AS sense FROM clauses) WHERE sense IS NOT NULL), d AS (SELECT p || n_nationkey || '.n.01' AS sense, n_name AS definition FROM nation, (SELECT unnest(['s', 'd']) AS p))
SELECT stmt_id, string_agg(sense || ': ' || coalesce(definition, '?'), '; ' ORDER BY sense) AS glossary FROM x LEFT JOIN d USING (sense) GROUP BY 1""",
    "resolve_route": f"WITH {PEOPLE} SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'room' ELSE row_id END AS route FROM orders LEFT JOIN people ON uid = 'u' || (o_custkey * 2)",
    "trace_join": f"WITH {VERDICTS}, t AS (SELECT o_orderkey AS id, list_extract(['true', 'false', 'inconsistent'], (o_custkey % 3 + 1)::INT) AS expected, token AS got FROM orders LEFT JOIN verd ON verd.id = o_orderkey AND verd.id % 6 > 0) SELECT *, CASE WHEN expected = 'false' AND got = 'true' THEN 'accepted false' WHEN expected = 'inconsistent' THEN 'missed contradiction' END AS breach FROM t",
    "reductio_target": f"WITH {GROUPS}, {PEOPLE} SELECT signature, arg_max(uid, (imprint, trust, uid)) AS uid FROM conf JOIN nation ON p = n_nationkey::VARCHAR JOIN people ON uid = 'u' || (n_nationkey * 3) GROUP BY 1",
    "morning_questions": f"WITH {GROUPS} SELECT DISTINCT signature FROM conf JOIN nation ON p = n_nationkey::VARCHAR WHERE length(signature) % 2 = 0 AND n_nationkey % 2 = 1",
    "taught": f"WITH {VERDICTS}, {_HELD} SELECT min(id) AS id, text, least(0.9, arg_min(id % 100 / 100, id))::DOUBLE AS trust FROM verd WHERE token = 'unknown' AND id % 2 = 0 AND id % 100 / 100 >= 0.5 AND text NOT IN (SELECT text FROM held) GROUP BY 2",
    "hypotheses": f"WITH {VERDICTS}, r AS (SELECT id, CASE WHEN token <> 'unknown' THEN 'decided' WHEN id % 2 = 1 THEN 'unsound' WHEN id % 10 < 6 THEN 'unlike' WHEN id % 100 >= 90 THEN 'taught' END AS reason FROM verd) SELECT id, reason, CASE WHEN reason IS NULL THEN least(0.3, id % 100 / 100) END::DOUBLE AS trust FROM r",
    "observations": f"WITH {VERDICTS} SELECT speaker, min(id) AS id FROM verd WHERE token = 'false' GROUP BY 1",
    "derived_theorems": f"WITH {VERDICTS}, {_HELD} SELECT min(id) AS id, text FROM verd WHERE token = 'true' AND chained AND text NOT IN (SELECT text FROM held) GROUP BY 2",
    "personal": f"WITH {PEOPLE} SELECT o_orderkey AS id, o_orderkey % 9 = 0 OR uid IS NOT NULL AS personal FROM orders LEFT JOIN people ON uid = 'u' || (o_custkey * 3)",
    "dream_digest": f"WITH {VERDICTS} SELECT count(DISTINCT text) AS n FROM verd WHERE id % 2 = 0",
    "momentum_pick": f"WITH {B.LOG}, f AS (SELECT source_id, original AS text, min(id) AS id FROM log WHERE source_id % 10 >= 6 AND channel >= 3 AND original NOT IN (SELECT original FROM log WHERE id % 5 = 0) GROUP BY 1, 2) SELECT source_id, text FROM f QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id) <= 8",
    "consolidate": f"WITH {B.EVENTS} SELECT event_id AS id, user_id % 11 >= 9 AND (k % 3 = 0 OR k % 4 = 0) AS enabled FROM ev",
    "quiet_band": f"WITH {ASSOCIATION} SELECT id, round(directedness * (1 + proximity) / 2, 6)::DOUBLE AS urge FROM log JOIN assoc USING (channel) WHERE directedness < 0.9 AND directedness >= 0.15",
    "place_type_sense": "WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS type FROM part), d AS (SELECT split_part(p_name, ' ', 2) AS type, arg_min(p_brand, p_partkey) AS sense FROM part WHERE p_size > 48 GROUP BY 1) SELECT type, coalesce(sense, 'location.n.01') AS sense FROM t LEFT JOIN d USING (type)",
    "ground_part": f"{R_SQL} SELECT c_custkey AS claim_id, c_custkey % 2 <> 0 AS holds FROM customer JOIN closure ON node = 'C:' || c_custkey AND ancestor = 'R:' || (c_custkey % 5)",
    "best_match": f"WITH {B.EVENTS}, r AS (SELECT user_id AS stmt_id, CASE WHEN k % 2 = 0 THEN 'axiom' ELSE 'theorem' END AS kind, event_id AS ordinal, k % 20 AS s FROM ev) SELECT stmt_id, kind, ordinal FROM r QUALIFY row_number() OVER (PARTITION BY stmt_id ORDER BY s DESC, kind, ordinal) = 1",
    "fuzzy_ops": f"WITH {B.EVENTS}, x AS (SELECT event_id, k / 100 AS a, least(1.0::DOUBLE, value / 100) AS b FROM ev) SELECT event_id, " + ", ".join(f"round(({e})::DOUBLE, 6) AS \"{n.lower()}\"" for n, e in _FUZZY.items()) + " FROM x",
}
