"""Queries of the extraction operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import extraction as X
from lorekeep.plans import bindings as B


def leaves(s, d, conjoined=False):
    """The bound clauses as leaves: nouns for purchases and signups, verbs for the rest."""
    c = B.clauses(s, d, conjoined)
    kind = F.split_part(F.element_at("senses", "predicate"), F.lit("."), F.lit(1))
    number = F.substring(F.element_at("senses", "predicate"), -1, 1)
    predicate = F.when(F.col("unknown"), F.lit(None)).when(kind.isin("purchase", "signup"), F.concat(kind, F.lit(".n.0"), number)).otherwise(F.concat(kind, F.lit(".v.0"), number))
    subject = F.when(F.col("contrast"), F.lit(None)).otherwise(F.element_at("senses", "subject"))
    obj = F.try_element_at("senses", F.lit("direct"))
    return c.select(F.col("stmt_id").alias("doc_id"), "pos", "op", "attitude", "modal", "quantifier", "negated", "dubitative", "wh_role", subject.alias("subject"), predicate.alias("predicate"), F.when(F.col("event_id") % 2 == 0, obj).alias("object"), F.try_element_at("identities", F.lit("subject")).alias("identity"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("mods"))


def sql(conjoined=False):
    return f"""WITH {B.clauses_sql(conjoined)}, leaves AS (SELECT stmt_id AS doc_id, pos, op, attitude, modal, quantifier, negated, dubitative, wh_role, CASE WHEN NOT contrast THEN s_subject END AS subject,
 CASE WHEN unknown THEN NULL WHEN s_predicate LIKE 'purchase%' OR s_predicate LIKE 'signup%' THEN replace(s_predicate, '.v.', '.n.') ELSE s_predicate END AS predicate, CASE WHEN event_id % 2 = 0 THEN s_direct END AS object, i_subject AS identity, event_id % 3 = 0 AS modified FROM clauses),
plain AS (SELECT * FROM leaves QUALIFY bool_and(op = 'AND' AND attitude IS NULL) OVER (PARTITION BY doc_id))"""


_CAND = "cand AS (SELECT doc_id, arg_min(subject, pos) AS subject, arg_min(predicate, pos) AS object FROM leaves WHERE modal IS NULL AND subject IS NOT NULL AND predicate LIKE '%.n.%' GROUP BY 1)"
_CLOSURE = [("s1.n.01", "purchase.n.01"), ("s2.n.01", "signup.n.02")]
_DOWN = [("purchase.n.02", "s3.n.01")]
_APART = [("s4.n.01", "signup.n.01"), ("s0.n.01", "purchase.n.03")]


def _gate(s, d):
    closure = s.createDataFrame(_CLOSURE + _DOWN, "node string, ancestor string")
    return X.candidate_edges(leaves(s, d)), closure, s.createDataFrame(_APART, "subject string, object string")


def _definitions(s, d):
    """The leaves, some about the class again or the genus, so that branches of every verdict occur."""
    rows = leaves(s, d)
    genus = X.genera(rows)
    named = rows.join(genus, "doc_id", "left").withColumn("k", F.col("doc_id") + F.col("pos"))
    subject = F.when(F.col("k") % 5 < 2, F.col("klass")).when(F.col("k") % 5 == 2, F.col("genus")).when(F.col("k") % 5 == 3, F.lit(None)).otherwise(F.col("subject"))
    predicate = F.when(F.col("k") % 11 == 0, F.col("genus")).when(F.col("k") % 11 == 1, F.concat(F.lit("s1"), F.lit(".a.01"))).when(F.col("k") % 11 == 2, F.lit("red.a.01")).otherwise(F.col("predicate"))
    first = F.col("pos") == F.col("genus_pos")
    changed = named.withColumns({"subject": F.when(first, F.col("subject")).otherwise(subject), "predicate": F.when(first, F.col("predicate")).otherwise(predicate), "negated": F.col("negated") & (F.col("k") % 3 == 0)})
    return changed.withColumn("op", F.when(F.col("k") % 4 == 0, F.col("op")).when(F.col("k") % 2 == 0, F.lit("AND")).otherwise("OR")).select(*rows.columns), genus


def _sufficient(s, d):
    rows, genus = _definitions(s, d)
    out = X.sufficient_rules(X.dnf_branches(rows), rows, genus)
    text = F.array_join(F.transform("conds", lambda c: F.concat(c["predicate"], F.lit("("), F.coalesce(c["object"], F.lit("")), F.lit(")"))), ",")
    return out.select("doc_id", "branch", "verdict", F.when(F.col("verdict") == "accept", text).alias("conds"))


def reports(s, d):
    """Orders as documents of two to four leaves: conditions, reasons and reports, with one flaw or none each."""
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("k"), F.posexplode(F.sequence(F.lit(0), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("pos", "_n"))
    k, p = F.col("k"), F.col("pos")
    shape, flaw = k % 4, F.floor(k / 4) % 13
    at = lambda n, i: (flaw == n) & (p == i)
    op = F.when((shape == 0) & (p == 1), "CONV").when((shape == 0) & (p > 1), F.when(flaw == 1, "AND").otherwise("THAT")).when((shape == 2) & (p > 0), "THAT").when((shape == 3) & (p == 1) & (flaw < 6), "OR").otherwise("AND")
    subject = F.when((shape == 2) & ~at(2, 1), F.lit(None)).when(at(3, 0), F.lit("b.n.01")).when(at(4, 0), F.lit(None)).otherwise(F.lit("a.n.01"))
    return o.select(
        "doc_id", "pos", op.alias("op"), F.when((shape == 2) & (p > 0), 0.8).alias("attitude"), F.when((shape == 2) & (p > 0), F.when(at(5, 1), "belief").otherwise("reportative")).alias("attitude_class"),
        F.when((shape == 1) & (p == k % 2) & (flaw != 6), F.when(k % 8 < 4, "reason").otherwise("result")).alias("cause"), F.when(at(7, 1), "can").alias("modal"),
        F.when((shape == 2) & ~at(8, 1), F.lit("me")).when(at(9, 0), F.lit("me")).alias("identity"), F.when(at(10, 0), 0.9).otherwise(0.1).alias("dubitative"), F.lit(None).cast("string").alias("wh_role"),
        F.when(flaw == 11, F.when(p == 0, "universal").otherwise("existential")).when(k % 5 == 0, "universal").otherwise("generic").alias("quantifier"), ((p == 1) & (flaw == 12)).alias("negated"), subject.alias("subject"),
        F.when(F.col("k") % 31 > 0, F.concat(F.lit("p"), p.cast("string"), F.lit(".v.01"))).alias("predicate"), F.when(k % 2 == 0, F.concat(F.lit("o"), p.cast("string"))).alias("object"),
    )


REPORTS = """rep AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, unnest(range(0, o_orderkey % 3 + 2)) AS pos FROM orders), shaped AS (SELECT *, k % 4 AS shape, (k // 4) % 13 AS flaw FROM rep),
lf AS (SELECT doc_id, k, pos, shape, flaw, CASE WHEN shape = 0 AND pos = 1 THEN 'CONV' WHEN shape = 0 AND pos > 1 THEN CASE WHEN flaw = 1 THEN 'AND' ELSE 'THAT' END WHEN shape = 2 AND pos > 0 THEN 'THAT' WHEN shape = 3 AND pos = 1 AND flaw < 6 THEN 'OR' ELSE 'AND' END AS op,
 CASE WHEN shape = 2 AND pos > 0 THEN CASE WHEN flaw = 5 AND pos = 1 THEN 'belief' ELSE 'reportative' END END AS klass, CASE WHEN shape = 1 AND pos = k % 2 AND flaw <> 6 THEN CASE WHEN k % 8 < 4 THEN 'reason' ELSE 'result' END END AS cause, flaw = 7 AND pos = 1 AS modal,
 CASE WHEN shape = 2 AND NOT (flaw = 8 AND pos = 1) THEN 'me' WHEN flaw = 9 AND pos = 0 THEN 'me' END AS identity, flaw = 10 AND pos = 0 AS asks, CASE WHEN flaw = 11 THEN CASE WHEN pos = 0 THEN 'universal' ELSE 'existential' END WHEN k % 5 = 0 THEN 'universal' ELSE 'generic' END AS q, pos = 1 AND flaw = 12 AS negated,
 CASE WHEN shape = 2 AND NOT (flaw = 2 AND pos = 1) THEN NULL WHEN flaw = 3 AND pos = 0 THEN 'b.n.01' WHEN flaw = 4 AND pos = 0 THEN NULL ELSE 'a.n.01' END AS subject, CASE WHEN k % 31 > 0 THEN 'p' || pos || '.v.01' END AS predicate, CASE WHEN k % 2 = 0 THEN 'o' || pos END AS object FROM shaped)"""

# One document at a time, by its positions: the condition and the conclusion are known from the shape.
CLASS_COND = f"""WITH {REPORTS}, doc AS (SELECT doc_id, any_value(k) AS k, any_value(shape) AS shape, any_value(flaw) AS flaw, count(*) AS n, bool_or(identity IS NOT NULL OR modal OR asks) AS bad FROM lf GROUP BY 1),
pick AS (SELECT *, CASE WHEN shape = 0 THEN 1 WHEN k % 8 < 4 THEN k % 2 ELSE 1 - k % 2 END AS cp FROM doc WHERE NOT bad AND ((shape = 0 AND NOT (flaw = 1 AND n > 2)) OR (shape = 1 AND flaw <> 6 AND n = 2))),
pair AS (SELECT a.doc_id, a.subject AS cond_class, a.predicate AS cond_pred, a.object AS cond_obj, c.predicate AS concl_pred, c.object AS concl_obj, c.negated AS concl_negated, CASE WHEN c.q = 'universal' THEN 'law' ELSE 'defeasible' END AS strength FROM pick JOIN lf a ON a.doc_id = pick.doc_id AND a.pos = cp JOIN lf c ON c.doc_id = pick.doc_id AND c.pos = 1 - cp
 WHERE a.subject IS NOT NULL AND coalesce(c.subject, a.subject) = a.subject AND a.predicate IS NOT NULL AND c.predicate IS NOT NULL AND NOT a.negated AND a.q <> 'existential' AND c.q <> 'existential'),
ex AS (SELECT doc_id, string_agg(predicate || '(' || coalesce(object, '') || ')', ',' ORDER BY pos) AS extra, bool_or(subject <> 'a.n.01' OR negated) AS bad FROM lf WHERE shape = 0 AND pos > 1 GROUP BY 1)
SELECT b.doc_id, cond_class, cond_pred, cond_obj, coalesce(extra, '') AS cond_extra, concl_pred, concl_obj, concl_negated, strength FROM pair b LEFT JOIN ex ON ex.doc_id = b.doc_id WHERE NOT coalesce(bad, false)"""
REPORTED = f"""WITH {REPORTS} SELECT doc_id, pos, 'me' AS seed, predicate, object FROM lf WHERE doc_id IN (SELECT doc_id FROM lf WHERE shape = 2 GROUP BY 1
 HAVING bool_and(identity IS NOT NULL AND predicate IS NOT NULL AND NOT modal AND NOT asks AND NOT negated AND q <> 'universal' AND subject IS NULL AND coalesce(klass, 'reportative') = 'reportative'))"""


def _class_conditional(s, d):
    out = X.class_conditional_rules(reports(s, d))
    return out.withColumn("cond_extra", F.array_join(F.transform("cond_extra", lambda c: F.concat(c["predicate"], F.lit("("), F.coalesce(c["object"], F.lit("")), F.lit(")"))), ","))


def _known(s):
    return s.createDataFrame(_CLOSURE + _DOWN, "node string, ancestor string")


def _joined(df, column):
    return df.withColumn(column, F.array_join(column, ","))


_V = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
_GATED = f"""{_CAND}, up AS (SELECT * FROM (VALUES {_V(_CLOSURE + _DOWN)}) t(node, ancestor)), apart AS (SELECT * FROM (VALUES {_V(_APART)}) t(x, y)),
gated AS (SELECT doc_id, subject, object, CASE WHEN EXISTS (SELECT 1 FROM up WHERE node = subject AND ancestor = object) THEN 'redundant' WHEN EXISTS (SELECT 1 FROM up WHERE node = object AND ancestor = subject) THEN 'cycle' WHEN EXISTS (SELECT 1 FROM apart WHERE x = subject AND y = object) THEN 'disjoint' ELSE 'accept' END AS verdict FROM cand)"""
_REASON = "CASE WHEN op <> 'AND' THEN 'operator' WHEN attitude IS NOT NULL THEN 'attitude' WHEN modal IS NOT NULL THEN 'modal' WHEN dubitative >= 0.75 OR wh_role IS NOT NULL THEN 'question' WHEN negated THEN 'negated' WHEN identity IS NOT NULL THEN 'individual' WHEN quantifier NOT IN ('generic', 'indefinite') THEN 'quantifier' WHEN modified THEN 'modified' WHEN NOT coalesce(subject LIKE '%.n.%' AND predicate LIKE '%.n.%', false) THEN 'not nouns' END"
_KIND = "CASE WHEN predicate LIKE '%.n.%' AND object IS NULL THEN 'membership' ELSE 'property' END"
_RULES = """rules AS (SELECT doc_id, pos, CASE WHEN predicate LIKE '%.n.%' THEN 'membership' ELSE 'property' END AS kind, subject, predicate, object, negated <> (quantifier = 'negative') AS negated, CASE WHEN quantifier IN ('universal', 'negative') THEN 'law' ELSE 'defeasible' END AS strength, CASE WHEN modified THEN 'm' ELSE '' END AS conds, quantifier
 FROM plain WHERE modal IS NULL AND subject IS NOT NULL AND predicate IS NOT NULL AND (quantifier = 'universal' OR (quantifier IN ('negative', 'generic', 'indefinite') AND identity IS NULL AND dubitative < 0.75 AND wh_role IS NULL))),
rule AS (SELECT * EXCLUDE (quantifier) FROM rules WHERE quantifier = 'universal' OR NOT (kind = 'membership' AND object IS NULL AND NOT negated AND conds = ''))"""
_FACTS = f"fact AS (SELECT doc_id, pos, {_KIND} AS kind, identity AS seed, predicate, object, negated, CASE WHEN modified AND predicate LIKE '%.n.%' AND object IS NULL THEN 'm' ELSE '' END AS mods FROM plain WHERE modal IS NULL AND identity IS NOT NULL AND predicate IS NOT NULL AND quantifier <> 'universal')"
_COND = "pre AS (SELECT *, lag(quantifier) OVER w AS bq, lag(subject) OVER w AS bs, lag(predicate) OVER w AS bp, lag(object) OVER w AS bo FROM leaves WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), cond AS (SELECT doc_id, bp AS cond_pred, bo AS cond_obj, predicate AS concl_pred, object AS concl_obj, negated AS concl_negated FROM pre WHERE op = 'IMPLY' AND bq = 'universal' AND bs IS NULL AND bp IS NOT NULL AND predicate IS NOT NULL)"

QUERIES = {
    "candidate_edges": lambda s, d: X.candidate_edges(leaves(s, d)),
    "gate_edges": lambda s, d: X.gate_edges(*_gate(s, d)),
    "isa_edges": lambda s, d: X.isa_edges(*_gate(s, d)),
    "generic_isa_edges": lambda s, d: X.generic_isa_edges(leaves(s, d, True), _known(s)),
    "class_rules": lambda s, d: _joined(X.class_rules(leaves(s, d, True)), "conds"),
    "facts": lambda s, d: _joined(X.facts(leaves(s, d, True)), "mods"),
    "class_conditional_rules": _class_conditional,
    "reportative_facts": lambda s, d: X.reportative_facts(reports(s, d)),
    "conditional_rules": lambda s, d: X.conditional_rules(leaves(s, d).withColumn("subject", F.when(F.col("pos") % 2 == 1, F.col("subject")))),
    "dnf_branches": lambda s, d: X.dnf_branches(leaves(s, d)).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ",")),
    "sufficient_rules": _sufficient,
    "leaf_fates": lambda s, d: X.leaf_fates(leaves(s, d)),
    "extract_logic": lambda s, d: X.extract_logic(leaves(s, d, True)),
    "definition_profile": lambda s, d: X.definition_profile(leaves(s, d), _known(s)),
}

ORACLES = {
    "candidate_edges": f"{sql()}, {_CAND} SELECT * FROM cand",
    "gate_edges": f"{sql()}, {_GATED} SELECT * FROM gated",
    "isa_edges": f"{sql()}, {_GATED} SELECT subject, object, min(doc_id) AS doc_id FROM gated WHERE verdict = 'accept' GROUP BY 1, 2",
    "generic_isa_edges": f"{sql(True)} SELECT doc_id, pos, coalesce({_REASON}, CASE WHEN subject || predicate IN ('s1.n.01purchase.n.01', 's2.n.01signup.n.02') THEN 'redundant' WHEN subject || predicate = 's3.n.01purchase.n.02' THEN 'cycle' END) AS reason FROM leaves",
    "class_rules": f"{sql(True)}, {_RULES} SELECT doc_id, pos, kind, subject, predicate, object, negated, strength, conds FROM rule",
    "facts": f"{sql(True)}, {_FACTS} SELECT * FROM fact",
    "conditional_rules": f"{sql()}, {_COND.replace('FROM leaves WINDOW', 'FROM (SELECT * REPLACE (CASE WHEN pos % 2 = 1 THEN subject END AS subject) FROM leaves) WINDOW')} SELECT * FROM cond",
    "class_conditional_rules": CLASS_COND,
    "reportative_facts": REPORTED,
    "sufficient_rules": f"""{sql()}, gen AS (SELECT doc_id, arg_min(subject, pos) AS klass, arg_min(predicate, pos) AS genus, min(pos) AS gp FROM leaves WHERE modal IS NULL AND subject IS NOT NULL AND predicate LIKE '%.n.%' GROUP BY 1),
chg AS (SELECT l.doc_id, pos, l.doc_id + pos AS k, gp, klass, genus, CASE WHEN (l.doc_id + pos) % 4 = 0 THEN op WHEN (l.doc_id + pos) % 2 = 0 THEN 'AND' ELSE 'OR' END AS op, negated AND (l.doc_id + pos) % 3 = 0 AS negated, object,
 CASE WHEN pos = gp THEN subject WHEN (l.doc_id + pos) % 5 < 2 THEN klass WHEN (l.doc_id + pos) % 5 = 2 THEN genus WHEN (l.doc_id + pos) % 5 = 3 THEN NULL ELSE subject END AS subject,
 CASE WHEN pos = gp THEN predicate WHEN (l.doc_id + pos) % 11 = 0 THEN genus WHEN (l.doc_id + pos) % 11 = 1 THEN 's1.a.01' WHEN (l.doc_id + pos) % 11 = 2 THEN 'red.a.01' ELSE predicate END AS predicate FROM leaves l LEFT JOIN gen g ON g.doc_id = l.doc_id),
tainted AS (SELECT doc_id, bool_or(pos > 0 AND op NOT IN ('AND', 'OR')) AS t FROM chg GROUP BY 1), starts AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS branch FROM chg WHERE pos = 0 OR op = 'OR'),
mem AS (SELECT s.doc_id, CAST(branch AS INT) AS branch, l.* EXCLUDE (doc_id), CASE WHEN l.pos = gp THEN NULL WHEN predicate IS NULL THEN 'no_pred' WHEN subject IS NOT NULL AND subject <> klass AND subject <> genus THEN 'foreign_subj' WHEN negated THEN 'negated_cond' WHEN predicate = genus THEN NULL WHEN predicate LIKE '%.n.%' THEN 'noun_cond'
 WHEN predicate LIKE '%.v.%' AND object IS NULL THEN 'verb_noobj' WHEN left(split_part(predicate, '.', 1), 4) = left(split_part(klass, '.', 1), 4) THEN 'circular' END AS fault FROM starts s JOIN tainted t ON t.doc_id = s.doc_id AND NOT t.t JOIN chg l ON l.doc_id = s.doc_id AND (l.pos = s.pos OR (l.pos > s.pos AND l.op = 'AND')) WHERE klass IS NOT NULL),
firsts AS (SELECT doc_id, branch, predicate || '(' || coalesce(object, '') || ')' AS c, min(pos) AS p FROM mem WHERE pos <> gp AND predicate IS NOT NULL AND predicate <> genus GROUP BY ALL),
listed AS (SELECT doc_id, branch, string_agg(c, ',' ORDER BY p) AS conds FROM firsts GROUP BY ALL), told AS (SELECT doc_id, branch, arg_min(fault, pos) FILTER (fault IS NOT NULL) AS f FROM mem GROUP BY ALL),
out_ AS (SELECT t.doc_id, t.branch, coalesce(f, CASE WHEN conds IS NULL THEN 'bare' ELSE 'accept' END) AS verdict, conds FROM told t LEFT JOIN listed USING (doc_id, branch) UNION ALL SELECT doc_id, 0, 'taint', NULL FROM tainted JOIN gen USING (doc_id) WHERE t)
SELECT doc_id, branch, verdict, CASE WHEN verdict = 'accept' THEN conds END AS conds FROM out_""",
    "leaf_fates": f"{sql()} SELECT CASE WHEN predicate IS NULL THEN 'dropped' WHEN op = 'IMPLY' THEN 'conditional' WHEN identity IS NOT NULL THEN 'fact' WHEN quantifier = 'universal' THEN 'law' WHEN quantifier = 'negative' THEN 'disjointness' WHEN quantifier IN ('generic', 'indefinite') AND predicate LIKE '%.n.%' AND NOT negated THEN 'edge' WHEN quantifier IN ('generic', 'indefinite') THEN 'generic' ELSE 'dropped' END AS fate, count(*) AS n FROM leaves GROUP BY 1",
    "extract_logic": f"{sql(True)}, {_RULES}, {_FACTS}, {_COND} SELECT 'rule' AS shape, kind AS verdict, count(*) AS n FROM rule GROUP BY 1, 2 UNION ALL SELECT 'fact', kind, count(*) FROM fact GROUP BY 1, 2 UNION ALL SELECT 'conditional', 'property', count(*) FROM cond HAVING count(*) > 0 UNION ALL SELECT 'edge', coalesce({_REASON}, 'accept'), count(*) FROM leaves GROUP BY 1, 2",
    "definition_profile": f"""{sql()}, {_CAND}, c AS (SELECT doc_id, count(*) AS leaves FROM leaves GROUP BY 1) SELECT 'leaves' AS what, leaves::VARCHAR AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'quantifier', quantifier, count(*) FROM leaves GROUP BY ALL
 UNION ALL SELECT 'class', split_part(predicate, '.', 2), count(*) FROM leaves GROUP BY ALL UNION ALL SELECT 'edge', CASE WHEN subject || object IN ('s1.n.01purchase.n.01', 's2.n.01signup.n.02') THEN 'redundant' WHEN subject IN ('s1.n.01', 's2.n.01') THEN 'new' ELSE 'off the graph' END, count(*) FROM cand GROUP BY ALL""",
    "dnf_branches": f"""{sql()}, tainted AS (SELECT doc_id, bool_or(pos > 0 AND op NOT IN ('AND', 'OR')) AS t FROM leaves GROUP BY 1), starts AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS branch FROM leaves WHERE pos = 0 OR op = 'OR')
SELECT s.doc_id, CAST(branch AS INT) AS branch, string_agg(l.pos::VARCHAR, ',' ORDER BY l.pos) AS members FROM starts s JOIN tainted t ON t.doc_id = s.doc_id AND NOT t.t JOIN leaves l ON l.doc_id = s.doc_id AND (l.pos = s.pos OR (l.pos > s.pos AND l.op = 'AND')) GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, NULL FROM tainted WHERE t""",
}
