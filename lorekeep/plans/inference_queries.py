"""Queries of forward chaining, evaluation and answers, with SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from lorekeep.operators import clauses as C
from lorekeep.operators import consistency as K
from lorekeep.operators import graph as G
from lorekeep.operators import inference as I
from lorekeep.operators import people as P
from lorekeep.operators import revision as R
from lorekeep.plans import bindings as B
from lorekeep.runtime import store

# The class graph above market segments, the rules, and their SQL.
_EDGES = [("BUILDING", "construction", None), ("FURNITURE", "construction", "FURNITURE|is_a|construction"), ("MACHINERY", "machine", None), ("AUTOMOBILE", "vehicle", None), ("vehicle", "machine", None), ("HOUSEHOLD", "home", None), ("construction", "industry", None), ("machine", "industry", "machine|is_a|industry")]
_RULES = [
    ("r1", "membership", "industry", "payer", None, False, []), ("r2", "membership", "home", "guest", None, False, [("5-LOW", None)]), ("r3", "membership", "vehicle", "guest", None, True, []),
    ("r4", "property", "payer", "pay.v.01", None, False, []), ("r5", "property", "guest", "rest.v.01", None, False, []), ("r6", "property", "vehicle", "rest.v.01", None, True, []), ("r7", "property", "home", "pay.v.01", None, True, [("1-URGENT", "F")]), ("r8", "membership", "machine", "guest", None, False, [("2-HIGH", "O")]),
]
_SUFF = [("s1", "industry", "urgent_payer", [("1-URGENT", "F"), ("2-HIGH", None)]), ("s2", "urgent_payer", "priority", [("3-MEDIUM", None)])]
_COND = [
    ("c1", None, "1-URGENT", "P", [], "worry.v.01", None, False), ("c2", "industry", "worry.v.01", None, [], "pay.v.01", None, True), ("c3", None, "pay.v.01", None, [], "spend.v.01", None, False),
    ("c4", None, "spend.v.01", None, [("worry.v.01", None), ("2-HIGH", "O")], "regret.v.01", None, False), ("c5", "industry", "5-LOW", "F", [("regret.v.01", None)], "save.v.01", "money.n.01", False),
]


def kb(s, d):
    cust, o = B.table(s, d, "customer"), B.table(s, d, "orders")
    name = lambda c: F.concat(F.lit("C:"), F.col(c).cast("string"))
    facts = cust.select(name("c_custkey").alias("seed"), F.col("c_mktsegment").alias("klass"), (F.col("c_custkey") % 17 == 0).alias("negated"), F.concat(F.lit("m:"), F.col("c_custkey").cast("string")).alias("fact_id"))
    props = o.select(name("o_custkey").alias("seed"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), (F.col("o_orderkey") % 13 == 0).alias("negated"), F.concat(F.lit("p:"), F.col("o_orderkey").cast("string")).alias("fact_id"))
    cond = "array<struct<predicate:string,object:string>>"
    return {
        "facts": facts, "properties": props, "edges": s.createDataFrame(_EDGES, "child string, parent string, source string"),
        "rules": s.createDataFrame(_RULES, f"rule_id string, kind string, subject string, predicate string, object string, negated boolean, conds {cond}"),
        "sufficient": s.createDataFrame(_SUFF, f"rule_id string, genus string, klass string, conds {cond}"),
        "conditional": s.createDataFrame(_COND, f"rule_id string, cond_class string, cond_pred string, cond_obj string, cond_extra {cond}, concl_pred string, concl_obj string, concl_negated boolean"),
    }


def _lit(x):
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"


def _values(rows):
    return ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows)


_NEEDS = [(r[0], i, p, o) for r in [*_RULES, *_SUFF] for i, (p, o) in enumerate(r[-1])]
KB = f"""facts AS (SELECT 'C:' || c_custkey AS seed, c_mktsegment AS klass, c_custkey % 17 = 0 AS negated, 'm:' || c_custkey AS fact_id FROM customer),
props AS (SELECT 'C:' || o_custkey AS seed, o_orderpriority AS predicate, o_orderstatus AS object, o_orderkey % 13 = 0 AS negated, 'p:' || o_orderkey AS fact_id FROM orders),
edge AS (SELECT * FROM (VALUES {_values(_EDGES)}) t(child, parent, source)), rules AS (SELECT * FROM (VALUES {_values([r[:6] + (len(r[6]),) for r in _RULES])}) t(rule_id, kind, subject, predicate, object, negated, conds)),
needs AS (SELECT * FROM (VALUES {_values(_NEEDS)}) t(rule_id, i, cp, co)),
met AS (SELECT seed, n.rule_id FROM needs n JOIN props p ON NOT negated AND p.predicate = cp AND (co IS NULL OR co = p.object) GROUP BY 1, 2 HAVING count(DISTINCT i) = (SELECT count(*) FROM needs m WHERE m.rule_id = n.rule_id))"""


def _reach(sufficient=True):
    suff = f" UNION ALL SELECT * FROM (VALUES {_values([(r[1], r[2], r[0]) for r in _SUFF])}) t(a, b, c)" if sufficient else ""
    return f"""WITH RECURSIVE {KB}, step AS (SELECT child AS klass, parent AS nxt, NULL::VARCHAR AS needs FROM edge UNION ALL SELECT subject, predicate, CASE WHEN conds::INT > 0 THEN rule_id END FROM rules WHERE kind = 'membership' AND NOT negated{suff}),
open AS (SELECT seed, klass, nxt FROM step, (SELECT DISTINCT seed FROM facts) WHERE needs IS NULL UNION ALL SELECT seed, klass, nxt FROM step JOIN met ON met.rule_id = needs),
reach AS (SELECT seed, klass FROM facts WHERE NOT negated UNION SELECT r.seed, o.nxt FROM reach r JOIN open o ON o.seed = r.seed AND o.klass = r.klass)"""


DERIVED = (
    _reach()
    + f""", direct AS (SELECT DISTINCT r.seed, u.predicate, u.object::VARCHAR AS object, u.negated FROM reach r JOIN rules u ON u.subject = r.klass AND (kind = 'property' OR u.negated) WHERE conds::INT = 0 OR EXISTS (SELECT 1 FROM met WHERE met.seed = r.seed AND met.rule_id = u.rule_id)),
cond AS (SELECT * FROM (VALUES {_values([r[:4] + r[5:] for r in _COND])}) t(rule_id, cc, cp, co, np, nobj, nn)),
told AS (SELECT seed, predicate, object, negated FROM props WHERE NOT negated UNION SELECT seed, predicate, object, negated FROM direct WHERE NOT negated),
more AS (SELECT seed, predicate, object, negated, 0 AS new FROM told UNION SELECT m.seed, np, nobj, nn, 1 FROM more m JOIN cond ON rule_id IN ('c1', 'c2', 'c3') AND NOT m.negated AND m.predicate = cp AND (co IS NULL OR co = m.object) WHERE cc IS NULL OR EXISTS (SELECT 1 FROM reach r WHERE r.seed = m.seed AND r.klass = cc)),
regret AS (SELECT DISTINCT s.seed FROM more s WHERE NOT negated AND predicate = 'spend.v.01' AND EXISTS (SELECT 1 FROM more w WHERE w.seed = s.seed AND NOT w.negated AND w.predicate = 'worry.v.01') AND EXISTS (SELECT 1 FROM more h WHERE h.seed = s.seed AND NOT h.negated AND h.predicate = '2-HIGH' AND h.object = 'O')),
saving AS (SELECT seed FROM regret g WHERE EXISTS (SELECT 1 FROM more l WHERE l.seed = g.seed AND NOT l.negated AND l.predicate = '5-LOW' AND l.object = 'F') AND EXISTS (SELECT 1 FROM reach r WHERE r.seed = g.seed AND r.klass = 'industry')),
every AS (SELECT * FROM more UNION ALL SELECT seed, 'regret.v.01', NULL, false, 1 FROM regret UNION ALL SELECT seed, 'save.v.01', 'money.n.01', false, 1 FROM saving),
added AS (SELECT DISTINCT m.seed, m.predicate, m.object, m.negated FROM every m WHERE new = 1 AND NOT EXISTS (SELECT 1 FROM told t WHERE t.seed = m.seed AND t.predicate = m.predicate AND t.object IS NOT DISTINCT FROM m.object AND t.negated = m.negated)),
alls AS (SELECT * FROM direct UNION ALL SELECT * FROM added), derived AS (SELECT *, count(DISTINCT negated) OVER (PARTITION BY seed, predicate, object) = 2 OR (negated AND object IS NULL AND EXISTS (SELECT 1 FROM reach r WHERE r.seed = alls.seed AND r.klass = alls.predicate)) AS conflict FROM alls)"""
)


def _closure(s, d):
    k = kb(s, d)
    return I.class_fixpoint(k["facts"], k["edges"], k["rules"], k["sufficient"], k["properties"])


def _members(s, d):
    k = kb(s, d)
    return I.membership_fixpoint(k["facts"], k["edges"], k["rules"], k["properties"]).select("seed", "klass")


def _direct(s, d):
    k = kb(s, d)
    return I.derive_properties(_closure(s, d), k["rules"], k["properties"]).select(*I.KEY)


def _conditional(s, d):
    k = kb(s, d)
    c = _closure(s, d)
    told = k["properties"].select("seed", "predicate", "object", "negated", F.array("fact_id").alias("premises"))
    return I.derive_conditional(I.derive_properties(c, k["rules"], k["properties"]).drop("origin").unionByName(told), k["conditional"], c).select(*I.KEY)


def _ablation(s, d):
    k = kb(s, d)
    return I.tier_ablation(k, k["edges"].where("source is null")).select(*I.KEY)


def claims(s, d):
    """Claims: customers pay or rest (by key), about half of them negated, and whether an order of theirs is urgent."""
    c = B.table(s, d, "customer")
    k = F.col("c_custkey")
    pred = F.element_at(F.array(F.lit("pay.v.01"), F.lit("rest.v.01"), F.lit("1-URGENT"), F.lit("industry")), (k % 4 + 1).cast("int"))
    return c.select(k.alias("claim_id"), F.concat(F.lit("C:"), k.cast("string")).alias("subject"), pred.alias("predicate"), F.when(k % 4 == 2, F.when(k % 3 == 0, "F")).alias("object"), (k % 5 < 2).alias("negated"), F.when(k % 37 == 0, "can").alias("modal"), (k % 29 == 0).alias("unknown"))


CLAIMS = "claims AS (SELECT c_custkey AS claim_id, 'C:' || c_custkey AS subject, list_extract(['pay.v.01', 'rest.v.01', '1-URGENT', 'industry'], (c_custkey % 4 + 1)::INT) AS predicate, CASE WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 0 THEN 'F' END AS object, c_custkey % 5 < 2 AS negated FROM customer)"


def _places_of(s, d):
    """Every 19th claim is about a place, every 23rd about a part: is the customer in that nation?"""
    c = B.table(s, d, "customer")
    k = F.col("c_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    row = lambda n: c.where(k % n == 0).select(k.alias("claim_id"), text("C:", k).alias("subject"), text("N:", k % 25).alias("object"), (k % 5 < 2).alias("negated"))
    near, part = row(19), row(23)
    n = B.table(s, d, "nation").select(text("N:", F.col("n_nationkey")).alias("uid"), F.lit("world").alias("parent_admin"), F.array(F.lit("world")).alias("path_admin"))
    home = text("N:", F.col("c_nationkey"))
    places = n.unionByName(c.select(text("C:", k).alias("uid"), home.alias("parent_admin"), F.array(F.lit("world"), home).alias("path_admin")))
    none = F.array().cast("array<string>")
    places = places.select("*", F.lit("").alias("parent_geo"), none.alias("path_geo"), none.alias("physical_features"))
    inside = G.place_contains(near.select(F.col("subject").alias("inner"), F.col("object").alias("outer")), places)
    edges = c.select(text("C:", k).alias("node"), home.alias("ancestor"))
    whole = G.part_of(part.select(F.col("subject").alias("part"), F.col("object").alias("whole")), edges)
    return R.ground_place(near, inside), P.ground_part(part, whole)


def _rungs(s, d, lines=True):
    """Claims, and by name how each rung is made: a query that asks for one makes no other. lines: with those of proofs over classes and rules."""
    k, c = kb(s, d), claims(s, d)
    met = cache(lambda: I.rules_met(k))
    closure = cache(lambda: store(I.class_fixpoint(k["facts"], k["edges"], k["rules"], k["sufficient"], k["properties"], met())))
    places = cache(lambda: _places_of(s, d))
    told = lambda: closure() if lines else None

    def isa():
        up = closure().select(F.col("seed").alias("subject"), F.col("klass").alias("object"), "premises")
        apart = k["facts"].where("klass = 'HOUSEHOLD' and not negated").select(F.col("seed").alias("subject"), F.lit("industry").alias("object"))
        return I.ground_isa(c, up, apart, told())

    sims = c.select("claim_id", (F.col("claim_id") % 100 / 100).alias("sim"))
    return c, {
        "place": lambda: places()[0], "part_of": lambda: places()[1], "is_a": isa, "rules": lambda: I.chain_ground(c, store(I.forward_chain(k, closure(), met())), closure=told()),
        "fact": lambda: I.individual_fact(c, k["facts"], k["properties"]), "direct": lambda: _direct_fact(s, d), "definition": lambda: I.definition_rung(c, sims),
    }


def _rung(name):
    return lambda s, d: _rungs(s, d, lines=False)[1][name]().select("claim_id", "holds")


RUNGS = f"""{DERIVED}, {CLAIMS}, isa AS (SELECT claim_id, coalesce(r.klass IS NOT NULL, false) <> c.negated AS holds FROM claims c LEFT JOIN reach r ON r.seed = subject AND r.klass = predicate LEFT JOIN facts f ON f.seed = subject AND f.klass = 'HOUSEHOLD' AND NOT f.negated AND predicate = 'industry' WHERE r.klass IS NOT NULL OR f.klass IS NOT NULL),
chained AS (SELECT claim_id, bool_and(c.negated = x.negated) AS holds FROM claims c JOIN derived x ON x.seed = subject AND x.predicate = c.predicate AND (x.object IS NULL OR x.object = c.object) GROUP BY 1 HAVING NOT bool_or(conflict) AND min(x.negated) = max(x.negated)),
hits AS (SELECT claim_id, c.negated AS cn, f.negated AS fn, fact_id, 0 AS p FROM claims c JOIN facts f ON f.seed = subject AND f.klass = predicate AND c.object IS NULL UNION ALL SELECT claim_id, c.negated, f.negated, fact_id, 1 FROM claims c JOIN props f ON f.seed = subject AND f.predicate = c.predicate AND (c.object IS NULL OR f.object IS NULL OR c.object = f.object)),
fact AS (SELECT claim_id, arg_min(cn = fn, (p, fact_id)) AS holds FROM hits GROUP BY 1)"""


def _evaluate(s, d, lines=True):
    """Every 41st claim contradicts itself."""
    c, rungs = _rungs(s, d, lines)
    said = c.where("claim_id % 41 = 0").select(F.col("claim_id").alias("stmt_id"), "subject", "predicate", F.col("object").alias("direct"), F.explode(F.array(F.lit(False), F.lit(True))).alias("negated"))
    leaves = said.select("*", F.col("negated").cast("int").alias("pos"), F.lit("AND").alias("op"), F.lit(None).cast("double").alias("attitude"), F.lit("CRISP").alias("corner"), F.lit(False).alias("unknown"), F.lit(False).alias("reflexive"))
    return I.evaluate(c, [(name, rung()) for name, rung in rungs.items()], K.contradictions(leaves).select(F.col("stmt_id").alias("claim_id")))


def _questions(s, d):
    return claims(s, d).withColumnRenamed("claim_id", "question_id").select("question_id", "subject", "predicate")


def _what(s, d):
    q = s.createDataFrame([(i, e[0]) for i, e in enumerate(_EDGES)], "question_id long, subject string").unionByName(_questions(s, d).select((F.col("question_id") + 100).alias("question_id"), "subject"))
    k = kb(s, d)
    return I.answer_what(q, k["edges"], k["facts"])


def _where(s, d):
    k = kb(s, d)
    parents = s.createDataFrame([("C:1", "N:1"), ("C:2", "N:2")], "uid string, parent string")
    props = k["properties"].withColumn("object", F.when(F.col("object") == "F", F.concat("object", F.lit("@place"))).otherwise(F.col("object")))
    return I.answer_where(_questions(s, d), parents, props)


def _direct_fact(s, d):
    o = B.table(s, d, "orders")
    facts = o.select(F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), (F.col("o_orderkey") % 3 == 0).alias("negated"), F.lit("axiom").alias("kind"), F.col("o_orderkey").alias("ordinal"))
    return I.direct_fact(claims(s, d).withColumn("object", F.lit("F")), facts)


def _verdicts(s, d):
    """Verdicts with what they rest on and, for those that a stored fact decides, the fact."""
    v = _evaluate(s, d)
    fact = F.when(F.col("rung").isin("fact", "direct", "place", "part_of"), F.array_join("derivation", "; "))
    return v.select("claim_id", "truth", "status", "rung", "missing", F.array_join("premises", "; ").alias("premises"), fact.alias("derivation"))


def _contra_leaves(s, d, conjoined):
    c = B.clauses(s, d, conjoined=conjoined)
    predicate = F.split_part(F.element_at("senses", "predicate"), F.lit("."), F.lit(1))
    return c.select("stmt_id", "pos", "op", "attitude", C.role_key("subject").alias("subject"), predicate.alias("predicate"), F.lit(None).cast("string").alias("direct"), C.corner().alias("corner"), "negated", "unknown", (F.col("event_id") % 47 == 0).alias("reflexive"))


def _antonyms(s):
    return s.createDataFrame([("view", "click"), ("error", "purchase")], "a string, b string")


def _cross(s, d):
    """Two events in a row are one statement of one of 40 speakers."""
    e, k = B.events(s, d), F.col("k")
    corner = F.element_at(F.array(*[F.lit(x) for x in ("A", "E", "I", "O", "CRISP", "CRISP", "MODAL")]), (k % 7 + 1).cast("int"))
    number = F.floor(F.col("event_id") / 2)
    rows = e.select(number.alias("id"), (number % 40).alias("speaker"), number.alias("us"), F.col("event_type").alias("subject"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("predicate"), F.lit(None).cast("string").alias("direct"), corner.alias("corner"), (k % 2 == 0).alias("negated"), (k % 13 == 0).alias("unknown"))
    return K.cross_item_conflict(rows, antonyms=s.createDataFrame([("p0", "p1")], "a string, b string"))


def _cross_mixed(s, d):
    """Two events in a row are one statement of one of 40 speakers, of any operators."""
    e, k = B.events(s, d), F.col("k")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), i.cast("int"))
    number = F.floor(F.col("event_id") / 2)
    rows = e.select(
        number.alias("id"), (number % 40).alias("speaker"), number.alias("us"), (F.col("event_id") % 2).cast("int").alias("pos"), pick(_MIXED, F.floor(k / 2) % 5 + 1).alias("op"),
        F.when(k % 23 == 0, (k % 10) / 10.0).alias("attitude"), F.col("event_type").alias("subject"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("predicate"), F.lit(None).cast("string").alias("direct"),
        pick(("A", "E", "I", "O", "CRISP", "CRISP", "MODAL"), k % 7 + 1).alias("corner"), (k % 2 == 0).alias("negated"), (k % 13 == 0).alias("unknown"), (k % 47 == 0).alias("reflexive"),
    )
    return K.cross_item_mixed(rows, antonyms=s.createDataFrame([("p0", "p1")], "a string, b string"))


_MIXED = ["AND", "OR", "AND", "NOT", "IMPLY"]

# All pairs of a speaker's statements within reach, and every assignment of 0 and 1 to the atoms of both; -1: a statement alone.
_CROSS_MIXED = f"""WITH {B.EVENTS}, r AS (SELECT event_id // 2 AS id, (event_id // 2) % 40 AS speaker, event_id % 2 AS pos, list_extract({_MIXED!r}, ((k // 2) % 5 + 1)::INT) AS op, CASE WHEN k % 23 = 0 THEN (k % 10) / 10.0::DOUBLE END AS attitude,
 event_type AS subject, k % 3 AS p, k % 2 = 0 AS negated, k % 47 = 0 AS refl, CASE WHEN k % 13 > 0 THEN CASE k % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'E' WHEN 2 THEN 'I' WHEN 3 THEN 'O' WHEN 6 THEN NULL ELSE CASE WHEN k % 2 = 0 THEN 'F' ELSE 'T' END END END AS code FROM ev),
named AS (SELECT *, CASE WHEN code IS NULL THEN '@' || id || '-' || pos WHEN code IN ('T', 'F') THEN subject || p ELSE subject || p || code END AS atom FROM r),
num AS (SELECT id, speaker, row_number() OVER (PARTITION BY speaker ORDER BY id) AS n FROM (SELECT DISTINCT id, speaker FROM r)),
pair AS (SELECT x.id AS a, y.id AS b, y.n FROM num x JOIN num y ON x.speaker = y.speaker AND y.n < x.n AND y.n >= x.n - 25 UNION ALL SELECT id, -1, 0 FROM num),
l AS (SELECT a, b, part, part * 2 + pos AS seq, pos, op, attitude, subject, p, negated, refl, code, atom FROM (SELECT a, b, a AS id, 0 AS part FROM pair UNION ALL SELECT a, b, b, 1 FROM pair WHERE b >= 0) JOIN named USING (id)),
shape AS (SELECT a, b, bool_and(op = 'AND' AND attitude IS NULL) AS plain, bool_or(refl AND negated) AS denied FROM l GROUP BY ALL),
rep AS (SELECT a, b, atom, min(seq) AS fp, arg_min(negated, seq) AS rn, row_number() OVER (PARTITION BY a, b ORDER BY min(seq)) - 1 AS i FROM l WHERE NOT refl GROUP BY a, b, atom),
clash AS (SELECT x.a, x.b, x.seq AS f, y.seq AS g FROM l x JOIN l y ON x.a = y.a AND x.b = y.b AND x.subject = y.subject AND NOT x.refl AND NOT y.refl
 WHERE (x.p = y.p AND x.code || y.code IN ('AO', 'OA', 'AE', 'EA', 'EI', 'IE', 'TF', 'FT')) OR (x.p + y.p = 1 AND NOT x.negated AND NOT y.negated AND x.code IN ('A', 'E', 'T') AND y.code IN ('A', 'E', 'T'))),
mutex AS (SELECT DISTINCT c.a, c.b, ((1 << x.i::INT) | (1 << y.i::INT)) AS both_ FROM clash c JOIN rep x ON x.a = c.a AND x.b = c.b AND x.fp = f JOIN rep y ON y.a = c.a AND y.b = c.b AND y.fp = g WHERE x.i < y.i),
mask AS (SELECT a, b, m FROM shape JOIN (SELECT unnest(range(16)) AS m) ON NOT plain LEFT JOIN mutex x USING (a, b) GROUP BY ALL HAVING coalesce(bool_and((m & both_) <> both_), true)),
told AS (SELECT l.a, l.b, m, part, pos, op, CASE WHEN refl THEN CASE WHEN negated THEN 0.0 ELSE 1.0 END WHEN code IN ('T', 'F') AND negated <> rn THEN 1.0 - ((m >> i::INT) & 1) ELSE (m >> i::INT) & 1 END::DOUBLE AS raw, attitude
 FROM mask JOIN l USING (a, b) LEFT JOIN rep ON rep.a = l.a AND rep.b = l.b AND rep.atom = l.atom AND NOT refl),
leaf AS (SELECT a, b, m, part, pos, op, CASE WHEN attitude IS NULL THEN raw ELSE 0.5 + (raw - 0.5) * attitude END AS x FROM told),
two AS (SELECT a, b, m, part, max(CASE WHEN pos = 0 THEN CASE WHEN op = 'NOT' THEN 1 - x ELSE x END END) AS t, max(CASE WHEN pos = 1 THEN x END) AS x, max(CASE WHEN pos = 1 THEN op END) AS op FROM leaf GROUP BY ALL),
fold AS (SELECT a, b, m, bool_and(CASE WHEN op IS NULL THEN t WHEN t IS NULL THEN CASE WHEN op = 'NOT' THEN 1 - x ELSE x END WHEN op = 'OR' THEN greatest(t, x) WHEN op = 'IMPLY' THEN CASE WHEN t <= x THEN 1.0 ELSE x END WHEN op = 'NOT' THEN least(t, 1 - x) ELSE least(t, x) END > 1e-9) AS true_ FROM two GROUP BY ALL),
bad AS (SELECT a, b FROM shape WHERE plain AND (denied OR EXISTS (SELECT 1 FROM clash c WHERE c.a = shape.a AND c.b = shape.b)) UNION ALL SELECT a, b FROM shape s WHERE NOT plain AND NOT EXISTS (SELECT 1 FROM fold f WHERE f.a = s.a AND f.b = s.b AND true_)),
own AS (SELECT a FROM bad WHERE b = -1)
SELECT a AS id, max(b) AS other FROM bad WHERE b >= 0 AND a NOT IN (SELECT a FROM own) AND b NOT IN (SELECT a FROM own) GROUP BY 1"""


def _reductio(s, d):
    """Is each customer of a class of the graph, or not? Every third claim is a denial."""
    c, k = B.table(s, d, "customer"), F.col("c_custkey")
    klass = F.element_at(F.array(*[F.lit(x) for x in _ASSUMED]), (k % len(_ASSUMED) + 1).cast("int"))
    claimed = c.select(k.alias("claim_id"), F.concat(F.lit("C:"), k.cast("string")).alias("seed"), klass.alias("predicate"), (k % 3 == 0).alias("negated"))
    return I.reductio_prove(claimed, kb(s, d)).select("claim_id", "proved")


_ASSUMED = ["vehicle", "home", "construction", "guest", "machine"]


QUERIES = {
    "seeds": lambda s, d: I.seeds(kb(s, d)["facts"], kb(s, d)["rules"], kb(s, d)["edges"].select(F.col("child").alias("seed"))),
    "seed_closure": lambda s, d: _closure(s, d).where("klass = 'industry'").select("seed", F.array_contains("premises", "machine|is_a|industry").alias("by_tier")),
    "cond_match": lambda s, d: B.clauses(s, d).select("stmt_id", "pos", I.cond_match(F.lit("purchases.v.01"), F.element_at("senses", "predicate")).alias("match")),
    "membership_fixpoint": _members,
    "sufficient_fixpoint": lambda s, d: _closure(s, d).select("seed", "klass"),
    "derive_properties": _direct,
    "derive_conditional": _conditional,
    "mark_conflicts": lambda s, d: I.forward_chain(kb(s, d)).where("conflict").select(*I.KEY),
    "forward_chain": lambda s, d: I.forward_chain(kb(s, d)).select(*I.KEY, "conflict"),
    "novel_conclusions": lambda s, d: I.novel_conclusions(I.forward_chain(kb(s, d))).select(*I.KEY),
    "saturate": lambda s, d: I.saturate(kb(s, d)).select(*I.KEY, "trust"),
    "tier_ablation": _ablation,
    "reductio_prove": _reductio,
    "ground_isa": _rung("is_a"),
    "chain_ground": _rung("rules"),
    "individual_fact": _rung("fact"),
    "direct_fact": lambda s, d: _direct_fact(s, d).select("claim_id", "holds"),
    "evaluate": _verdicts,
    "answer_polar": lambda s, d: I.answer_polar(_evaluate(s, d, lines=False), 0.9),
    "answer_what": _what,
    "answer_who": lambda s, d: I.answer_who(_questions(s, d), kb(s, d)["properties"]),
    "answer_object": lambda s, d: I.answer_object(_questions(s, d), kb(s, d)["properties"]),
    "answer_why": lambda s, d: I.answer_why(_questions(s, d), I.forward_chain(kb(s, d))),
    "answer_where": _where,
    "contradictions": lambda s, d: K.contradictions(_contra_leaves(s, d, True), _antonyms(s)),
    "contradictions_mixed": lambda s, d: K.contradictions(_contra_leaves(s, d, False), _antonyms(s)),
    "cross_item_conflict": _cross,
    "cross_item_mixed": _cross_mixed,
}

_TRUST_OF = "CASE WHEN machine THEN 0.3 ELSE 0.9 END"
_DIRECT = "direct_ AS (SELECT claim_id, arg_min((o_orderkey % 3 = 0) = negated, o_orderkey) AS holds FROM claims JOIN orders ON subject = 'C:' || o_custkey AND predicate = o_orderpriority AND o_orderstatus = 'F' GROUP BY 1)"
_EVAL = f"""{RUNGS}, {_DIRECT}, v AS (SELECT c.claim_id, c.claim_id % 41 = 0 AS bad, c.claim_id % 37 = 0 AS modal, c.claim_id % 29 = 0 AS unknown, CASE WHEN c.claim_id % 19 = 0 THEN (c_nationkey = c.claim_id % 25) <> c.negated END AS r1,
 CASE WHEN c.claim_id % 23 = 0 AND c_nationkey = c.claim_id % 25 THEN NOT c.negated END AS r2, a.holds AS r3, b.holds AS r4, f.holds AS r5, d.holds AS r6, CASE WHEN NOT c.negated AND c.claim_id % 100 >= 85 THEN true END AS r7
 FROM claims c JOIN customer ON c_custkey = c.claim_id LEFT JOIN isa a USING (claim_id) LEFT JOIN chained b USING (claim_id) LEFT JOIN fact f USING (claim_id) LEFT JOIN direct_ d USING (claim_id)),
w AS (SELECT *, CASE WHEN NOT modal THEN coalesce(r1, r2, r3, r4, r5, r6, r7) END AS holds, CASE WHEN NOT modal AND NOT bad THEN CASE WHEN r1 IS NOT NULL THEN 'place' WHEN r2 IS NOT NULL THEN 'part_of' WHEN r3 IS NOT NULL THEN 'is_a' WHEN r4 IS NOT NULL THEN 'rules' WHEN r5 IS NOT NULL THEN 'fact' WHEN r6 IS NOT NULL THEN 'direct' WHEN r7 IS NOT NULL THEN 'definition' END END AS rung FROM v),
ev AS (SELECT claim_id, CASE WHEN bad THEN 0.0 WHEN holds THEN 1.0 WHEN NOT holds THEN 0.0 ELSE 0.5 END::DOUBLE AS truth, CASE WHEN bad THEN 'inconsistent' WHEN holds IS NULL THEN 'insufficient' ELSE 'resolved' END AS status, rung, CASE WHEN NOT bad AND holds IS NULL THEN CASE WHEN modal THEN 'modal' WHEN unknown THEN 'unknown words' ELSE 'no ground' END END AS missing FROM w)"""
_CONTRA = f"""leaf AS (SELECT stmt_id, pos, op, attitude, subject, split_part(s_predicate, '.', 1) AS predicate, negated, event_id % 47 = 0 AS refl, CASE WHEN unknown OR modal IS NOT NULL THEN NULL WHEN quantifier = 'universal' THEN CASE WHEN negated THEN 'O' ELSE 'A' END WHEN quantifier = 'negated_universal' THEN CASE WHEN negated THEN 'I' ELSE 'O' END
 WHEN quantifier = 'negative' THEN CASE WHEN negated THEN 'I' ELSE 'E' END WHEN quantifier IN ('existential', 'indefinite') THEN CASE WHEN negated THEN 'O' ELSE 'I' END WHEN negated THEN 'F' ELSE 'T' END AS code FROM clauses),
named AS (SELECT *, CASE WHEN code IS NULL THEN '@' || pos WHEN code IN ('T', 'F') THEN subject || '|' || predicate ELSE subject || '|' || predicate || '#' || code END AS atom FROM leaf),
few AS (SELECT stmt_id, count(DISTINCT CASE WHEN NOT refl THEN atom END) AS k, bool_and(op = 'AND' AND attitude IS NULL) AS plain FROM named GROUP BY 1),
clash AS (SELECT a.stmt_id, a.pos AS p, b.pos AS q, a.atom AS a, b.atom AS b FROM named a JOIN named b ON a.stmt_id = b.stmt_id AND a.subject = b.subject AND NOT a.refl AND NOT b.refl WHERE (a.predicate = b.predicate AND a.code || b.code IN ('AO', 'OA', 'AE', 'EA', 'EI', 'IE', 'TF', 'FT'))
 OR (a.predicate || ' ' || b.predicate IN ('view click', 'click view', 'error purchase', 'purchase error') AND NOT a.negated AND NOT b.negated AND a.code IN ('A', 'E', 'T') AND b.code IN ('A', 'E', 'T')))"""


def _contra_sql(conjoined):
    """Every assignment of 0 and 1 to the atoms of a statement, folded leaf by leaf."""
    return f"""WITH RECURSIVE {B.clauses_sql(conjoined)}, {_CONTRA}, firsts AS (SELECT stmt_id, atom, min(pos) AS fp FROM named WHERE NOT refl GROUP BY ALL), rep AS (SELECT f.stmt_id, f.atom, fp, negated AS rn, row_number() OVER (PARTITION BY f.stmt_id ORDER BY fp) - 1 AS i FROM firsts f JOIN named n ON n.stmt_id = f.stmt_id AND n.pos = fp),
mx AS (SELECT DISTINCT c.stmt_id, x.i AS i, y.i AS j FROM clash c JOIN rep x ON x.stmt_id = c.stmt_id AND x.fp = p JOIN rep y ON y.stmt_id = c.stmt_id AND y.fp = q WHERE x.i < y.i),
mask AS (SELECT stmt_id, unnest(range(1 << k::INT)) AS m FROM few WHERE NOT plain AND k <= 16), good AS (SELECT * FROM mask WHERE NOT EXISTS (SELECT 1 FROM mx WHERE mx.stmt_id = mask.stmt_id AND (m >> i::INT) & 1 = 1 AND (m >> j::INT) & 1 = 1)),
val AS (SELECT g.stmt_id, g.m, n.pos, n.op, n.attitude, CASE WHEN refl THEN CASE WHEN n.negated THEN 0.0 ELSE 1.0 END WHEN code IN ('T', 'F') AND n.negated <> rn THEN 1.0 - ((m >> i::INT) & 1) ELSE (m >> i::INT) & 1 END::DOUBLE AS raw FROM good g JOIN named n ON n.stmt_id = g.stmt_id LEFT JOIN rep r ON r.stmt_id = n.stmt_id AND r.atom = n.atom AND NOT n.refl),
v AS (SELECT stmt_id, m, pos, op, CASE WHEN attitude IS NOT NULL THEN 0.5 + (raw - 0.5) * attitude ELSE raw END AS x FROM val),
walk AS (SELECT stmt_id, m, pos, CASE WHEN op = 'NOT' THEN 1 - x ELSE x END AS t FROM v WHERE pos = 0 UNION ALL
 SELECT w.stmt_id, w.m, v.pos, CASE v.op WHEN 'OR' THEN greatest(t, x) WHEN 'IMPLY' THEN CASE WHEN t <= x THEN 1.0 ELSE x END WHEN 'NOT' THEN least(t, 1 - x) ELSE least(t, x) END FROM walk w JOIN v ON v.stmt_id = w.stmt_id AND v.m = w.m AND v.pos = w.pos + 1),
last_ AS (SELECT stmt_id, max(pos) AS n FROM named GROUP BY 1) SELECT f.stmt_id FROM few f WHERE k <= 16 AND NOT plain AND NOT EXISTS (SELECT 1 FROM walk w JOIN last_ l ON l.stmt_id = w.stmt_id AND l.n = w.pos WHERE w.stmt_id = f.stmt_id AND t > 1e-9)
UNION ALL SELECT stmt_id FROM few WHERE k <= 16 AND plain AND (stmt_id IN (SELECT stmt_id FROM clash) OR stmt_id IN (SELECT stmt_id FROM named WHERE refl AND negated))"""


_COLS = "seed, predicate, object, negated"

_BEDROCK = DERIVED.replace("SELECT child AS klass, parent AS nxt, NULL::VARCHAR AS needs FROM edge", "SELECT child AS klass, parent AS nxt, NULL::VARCHAR AS needs FROM edge WHERE source IS NULL")

# Everything again in two contexts for each customer: as is ("a"), and with the membership assumed ("b").
_CONTEXT = (
    DERIVED.replace("WITH RECURSIVE facts AS (", "WITH RECURSIVE facts0 AS (").replace("props AS (SELECT 'C:'", "props0 AS (SELECT 'C:'")
    .replace("edge AS (SELECT * FROM (VALUES", f"""context AS (SELECT c_custkey AS claim_id, p || ':' || c_custkey AS ctx, p, list_extract({_ASSUMED!r}, (c_custkey % {len(_ASSUMED)} + 1)::INT) AS claimed FROM customer, (VALUES ('a'), ('b')) t(p)),
facts AS (SELECT ctx AS seed, klass, negated, fact_id FROM facts0 JOIN context ON seed = 'C:' || claim_id UNION ALL SELECT ctx, claimed, false, 'hypothesis' FROM context WHERE p = 'b'),
props AS (SELECT ctx AS seed, predicate, object, negated, fact_id FROM props0 JOIN context ON seed = 'C:' || claim_id),
edge AS (SELECT * FROM (VALUES""", 1)
)
_REDUCTIO = f"""{_CONTEXT}, both_ AS (SELECT seed, predicate, object, negated FROM alls UNION SELECT seed, predicate, object, negated FROM props),
clash AS (SELECT seed, predicate, object, negated FROM (SELECT *, count(DISTINCT negated) OVER (PARTITION BY seed, predicate, object) AS n FROM both_) x WHERE n = 2 OR (negated AND object IS NULL AND EXISTS (SELECT 1 FROM reach r WHERE r.seed = x.seed AND r.klass = x.predicate))),
fresh AS (SELECT DISTINCT substr(seed, 3)::BIGINT AS claim_id FROM clash b WHERE seed LIKE 'b:%' AND NOT EXISTS (SELECT 1 FROM clash a WHERE a.seed = 'a:' || substr(b.seed, 3) AND a.predicate = b.predicate AND a.object IS NOT DISTINCT FROM b.object AND a.negated = b.negated))
SELECT c_custkey AS claim_id, CASE WHEN f.claim_id IS NOT NULL THEN c_custkey % 3 = 0 END AS proved FROM customer LEFT JOIN fresh f ON f.claim_id = c_custkey"""


def _sorted_set(*lists):
    return f"list_sort(list_distinct(list_concat({', '.join(lists)})))" if len(lists) > 1 else f"list_sort(list_distinct({lists[0]}))"


# Premises: of the routes to a class those of the first round, of these the shortest list and then the smallest; a rule's
# conditions rest on the smallest fact each; conditional rules fire in the round after their last condition, c1 and c3 in the
# first, c4 in the second, c5 in the third (c2 concludes a denial, which is no condition).
_WHY = (
    DERIVED
    + f""", prem AS (SELECT seed, rule_id, list_sort(list(DISTINCT f)) AS ps FROM (SELECT seed, n.rule_id, i, min(fact_id) AS f FROM needs n JOIN props p ON NOT negated AND p.predicate = cp AND (co IS NULL OR co = p.object) GROUP BY ALL) GROUP BY ALL),
hop AS (SELECT child AS klass, parent AS nxt, source AS premise, NULL::VARCHAR AS rule_id FROM edge UNION ALL SELECT subject, predicate, rule_id, CASE WHEN conds::INT > 0 THEN rule_id END FROM rules WHERE kind = 'membership' AND NOT negated UNION ALL SELECT a, b, c, c FROM (VALUES {_values([(r[1], r[2], r[0]) for r in _SUFF])}) t(a, b, c)),
route AS (SELECT seed, klass, 0 AS round, [fact_id] AS ps FROM facts WHERE NOT negated UNION ALL
 SELECT r.seed, h.nxt, round + 1, {_sorted_set("r.ps", "CASE WHEN premise IS NULL THEN [] ELSE [premise] END", "coalesce(m.ps, [])")} FROM route r JOIN hop h ON h.klass = r.klass LEFT JOIN prem m ON m.seed = r.seed AND m.rule_id = h.rule_id WHERE h.rule_id IS NULL OR m.ps IS NOT NULL),
held AS (SELECT seed, klass, arg_min(ps, (round, len(ps), ps)) AS ps FROM route GROUP BY ALL),
straight AS (SELECT seed, predicate, object, negated, arg_min(ps, (len(ps), ps)) AS ps FROM (SELECT h.seed, u.predicate, u.object::VARCHAR AS object, u.negated, {_sorted_set("h.ps", "[u.rule_id]", "coalesce(m.ps, [])")} AS ps FROM held h JOIN rules u ON u.subject = h.klass AND (kind = 'property' OR u.negated) LEFT JOIN prem m ON m.seed = h.seed AND m.rule_id = u.rule_id WHERE conds::INT = 0 OR m.ps IS NOT NULL) GROUP BY ALL),
now_ AS (SELECT seed, predicate, object, ps FROM straight WHERE NOT negated UNION ALL SELECT seed, predicate, object, [fact_id] FROM props WHERE NOT negated),
best AS (SELECT seed, predicate, object, arg_min(ps, (len(ps), ps)) AS ps FROM now_ GROUP BY ALL),
w1 AS (SELECT seed, 'worry.v.01' AS predicate, NULL::VARCHAR AS object, false AS negated, {_sorted_set("ps", "['c1']")} AS ps FROM best WHERE predicate = '1-URGENT' AND object = 'P'),
w2 AS (SELECT w.seed, 'pay.v.01', NULL::VARCHAR, true, {_sorted_set("w.ps", "['c2']", "h.ps")} FROM w1 w JOIN held h ON h.seed = w.seed AND h.klass = 'industry'),
w3 AS (SELECT seed, 'spend.v.01' AS predicate, NULL::VARCHAR AS object, false AS negated, {_sorted_set("ps", "['c3']")} AS ps FROM best WHERE predicate = 'pay.v.01'),
w4 AS (SELECT s.seed, 'regret.v.01' AS predicate, NULL::VARCHAR AS object, false AS negated, {_sorted_set("s.ps", "w.ps", "h.ps", "['c4']")} AS ps FROM w3 s JOIN w1 w USING (seed) JOIN best h ON h.seed = s.seed AND h.predicate = '2-HIGH' AND h.object = 'O'),
w5 AS (SELECT g.seed, 'save.v.01', 'money.n.01', false, {_sorted_set("g.ps", "l.ps", "h.ps", "['c5']")} FROM w4 g JOIN best l ON l.seed = g.seed AND l.predicate = '5-LOW' AND l.object = 'F' JOIN held h ON h.seed = g.seed AND h.klass = 'industry'),
why0 AS (SELECT * FROM straight UNION ALL (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4 UNION ALL SELECT * FROM w5)),
why1 AS (SELECT seed, predicate, object, negated, arg_min(ps, (len(ps), ps)) AS ps FROM why0 w WHERE EXISTS (SELECT 1 FROM derived d WHERE d.seed = w.seed AND d.predicate = w.predicate AND d.object IS NOT DISTINCT FROM w.object AND d.negated = w.negated) GROUP BY ALL),
why2 AS (SELECT *, count(DISTINCT negated) OVER (PARTITION BY seed, predicate, object) AS sides FROM why1),
why3 AS (SELECT w.seed, w.predicate, w.object, w.negated, CASE WHEN sides = 2 THEN list_sort(list_distinct(flatten(list(ps) OVER (PARTITION BY seed, predicate, object)))) ELSE ps END AS ps FROM why2 w),
why AS (SELECT w.seed, w.predicate, w.object, w.negated, CASE WHEN w.negated AND w.object IS NULL AND h.ps IS NOT NULL THEN {_sorted_set("w.ps", "h.ps")} ELSE w.ps END AS ps FROM why3 w LEFT JOIN held h ON h.seed = w.seed AND h.klass = w.predicate)"""
)


ORACLES = {
    "seeds": f"WITH {KB} SELECT seed, min(p)::INT AS priority FROM (SELECT seed, 0 AS p FROM facts UNION ALL SELECT subject, 1 FROM rules UNION ALL SELECT child, 2 FROM edge) GROUP BY 1",
    "seed_closure": f"{_reach()} SELECT r.seed, f.klass IN ('MACHINERY', 'AUTOMOBILE') AS by_tier FROM reach r JOIN facts f ON f.seed = r.seed WHERE r.klass = 'industry'",
    "cond_match": f"WITH {B.clauses_sql()} SELECT stmt_id, pos, s_predicate LIKE 'purchase.%' AS match FROM clauses",
    "membership_fixpoint": f"{_reach(False)} SELECT seed, klass FROM reach",
    "sufficient_fixpoint": f"{_reach()} SELECT seed, klass FROM reach",
    "derive_properties": f"{DERIVED} SELECT {_COLS} FROM direct",
    "derive_conditional": f"{DERIVED} SELECT {_COLS} FROM added",
    "mark_conflicts": f"{DERIVED} SELECT {_COLS} FROM derived WHERE conflict",
    "forward_chain": f"{DERIVED} SELECT {_COLS}, conflict FROM derived",
    "novel_conclusions": f"{DERIVED} SELECT {_COLS} FROM derived WHERE NOT conflict",
    # What the bedrock alone derives is trusted as derived; the rest rests on an edge of a tier.
    "saturate": f"SELECT a.*, CASE WHEN b.seed IS NULL THEN 0.3 ELSE 0.9 END::DOUBLE AS trust FROM ({DERIVED} SELECT {_COLS} FROM derived WHERE NOT conflict) a LEFT JOIN ({_BEDROCK} SELECT {_COLS} FROM derived) b ON a.seed = b.seed AND a.predicate = b.predicate AND a.object IS NOT DISTINCT FROM b.object AND a.negated = b.negated",
    "tier_ablation": f"SELECT * FROM ({DERIVED} SELECT {_COLS} FROM derived WHERE NOT conflict) EXCEPT SELECT * FROM ({_BEDROCK} SELECT {_COLS} FROM derived WHERE NOT conflict)",
    "direct_fact": f"WITH {CLAIMS} SELECT claim_id, arg_min((o_orderkey % 3 = 0) = negated, o_orderkey) AS holds FROM claims JOIN orders ON subject = 'C:' || o_custkey AND predicate = o_orderpriority AND o_orderstatus = 'F' GROUP BY 1",
    "ground_isa": f"{RUNGS} SELECT * FROM isa",
    "chain_ground": f"{RUNGS} SELECT * FROM chained",
    "individual_fact": f"{RUNGS} SELECT * FROM fact",
    "evaluate": f"""{_EVAL.replace(DERIVED, _WHY)},
by_rule AS (SELECT c.claim_id, arg_min(ps, (len(ps), ps)) AS ps FROM claims c JOIN why x ON x.seed = c.subject AND x.predicate = c.predicate AND (x.object IS NULL OR x.object = c.object) GROUP BY 1),
by_fact AS (SELECT claim_id, arg_min(fact_id, (p, fact_id)) AS id, arg_min(CASE WHEN p = 0 THEN 'is ' ELSE '' END || CASE WHEN fn THEN 'not ' ELSE '' END, (p, fact_id)) AS how, arg_min(fo, (p, fact_id)) AS fo FROM (
 SELECT h.*, o.object AS fo FROM hits h LEFT JOIN props o ON h.p = 1 AND o.fact_id = h.fact_id) GROUP BY 1),
by_order AS (SELECT claim_id, arg_min(o_orderkey % 3 = 0, o_orderkey) AS fn FROM claims JOIN orders ON subject = 'C:' || o_custkey AND predicate = o_orderpriority AND o_orderstatus = 'F' GROUP BY 1)
SELECT e.claim_id, truth, status, rung, missing, CASE rung WHEN 'is_a' THEN coalesce(array_to_string(h.ps, '; '), '') WHEN 'rules' THEN array_to_string(r.ps, '; ') WHEN 'fact' THEN f.id ELSE '' END AS premises,
 CASE rung WHEN 'place' THEN c.subject || CASE WHEN c_nationkey = e.claim_id % 25 THEN ' is in ' ELSE ' is not in ' END || 'N:' || e.claim_id % 25 WHEN 'part_of' THEN c.subject || ' is part of N:' || e.claim_id % 25
  WHEN 'fact' THEN 'fact: ' || c.subject || ' ' || f.how || c.predicate || coalesce(' ' || f.fo, '') WHEN 'direct' THEN 'direct fact ' || CASE WHEN truth = 1 THEN 'confirms' ELSE 'refutes' END || ': stored axiom ' || c.subject || CASE WHEN o.fn THEN ' not ' ELSE ' ' END || c.predicate || ' F' END AS derivation
FROM ev e JOIN claims c USING (claim_id) JOIN customer ON c_custkey = claim_id LEFT JOIN held h ON h.seed = c.subject AND h.klass = c.predicate LEFT JOIN by_rule r USING (claim_id) LEFT JOIN by_fact f USING (claim_id) LEFT JOIN by_order o USING (claim_id)""",
    "answer_polar": f"{_EVAL} SELECT claim_id, CASE WHEN status = 'inconsistent' THEN 'no' WHEN truth > 0.85 THEN 'yes' WHEN truth < 0.15 THEN 'no' ELSE 'unknown' END AS answer, CASE WHEN status = 'inconsistent' THEN 1.0 WHEN status = 'insufficient' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM ev",
    "answer_what": f"WITH {KB}, {CLAIMS}, e AS (SELECT child, min(parent) AS a FROM edge GROUP BY 1), q AS (SELECT i AS question_id, s AS subject FROM (VALUES {_values([(i, e[0]) for i, e in enumerate(_EDGES)])}) t(i, s) UNION ALL SELECT (claim_id + 100)::VARCHAR, subject FROM claims) SELECT question_id::BIGINT AS question_id, coalesce(a, klass, 'unknown') AS answer, CASE WHEN a IS NOT NULL THEN 0.9 WHEN klass IS NOT NULL THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM q LEFT JOIN e ON child = subject LEFT JOIN facts f ON f.seed = subject AND NOT negated",
    "answer_who": f"WITH {KB}, {CLAIMS}, f AS (SELECT predicate, arg_min(seed, fact_id) AS answer FROM props WHERE NOT negated GROUP BY 1) SELECT claim_id AS question_id, answer FROM claims LEFT JOIN f USING (predicate)",
    "answer_object": f"WITH {KB}, {CLAIMS}, f AS (SELECT seed, predicate, arg_min(object, fact_id) AS answer FROM props WHERE NOT negated GROUP BY 1, 2) SELECT claim_id AS question_id, answer FROM claims c LEFT JOIN f ON f.seed = subject AND f.predicate = c.predicate",
    "answer_why": f"{_WHY}, {CLAIMS} SELECT claim_id AS question_id, min(array_to_string(ps, '; ')) AS answer FROM claims c LEFT JOIN why x ON x.seed = subject AND x.predicate = c.predicate GROUP BY 1",
    "reductio_prove": _REDUCTIO,
    "answer_where": f"WITH {KB}, {CLAIMS}, f AS (SELECT seed, min(object || '@place') AS b FROM props WHERE object = 'F' GROUP BY 1) SELECT claim_id AS question_id, CASE claim_id WHEN 1 THEN 'N:1' WHEN 2 THEN 'N:2' ELSE b END AS answer, CASE WHEN claim_id IN (1, 2) THEN 0.9 WHEN b IS NOT NULL THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM claims LEFT JOIN f ON seed = subject",
    "contradictions": _contra_sql(True),
    "contradictions_mixed": _contra_sql(False),
    "cross_item_mixed": _CROSS_MIXED,
    "cross_item_conflict": f"""WITH {B.EVENTS}, r AS (SELECT event_id // 2 AS id, (event_id // 2) % 40 AS speaker, event_type AS subject, k % 3 AS p, k % 2 = 0 AS negated, CASE WHEN k % 13 > 0 THEN CASE k % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'E' WHEN 2 THEN 'I' WHEN 3 THEN 'O' WHEN 6 THEN NULL ELSE CASE WHEN k % 2 = 0 THEN 'F' ELSE 'T' END END END AS code FROM ev),
hit AS (SELECT DISTINCT a.id, a.speaker, b.id AS other FROM r a JOIN r b ON a.speaker = b.speaker AND a.subject = b.subject AND b.id <= a.id WHERE (a.p = b.p AND a.code || b.code IN ('AO', 'OA', 'AE', 'EA', 'EI', 'IE', 'TF', 'FT')) OR (a.p + b.p = 1 AND NOT a.negated AND NOT b.negated AND a.code IN ('A', 'E', 'T') AND b.code IN ('A', 'E', 'T'))),
own AS (SELECT id FROM hit WHERE id = other), n AS (SELECT id, row_number() OVER (PARTITION BY speaker ORDER BY id) AS n FROM (SELECT DISTINCT id, speaker FROM r))
SELECT h.id, max(h.other) AS other FROM hit h JOIN n a ON a.id = h.id JOIN n b ON b.id = h.other WHERE h.other < h.id AND b.n >= a.n - 25 AND h.id NOT IN (SELECT id FROM own) AND h.other NOT IN (SELECT id FROM own) GROUP BY 1""",
}
