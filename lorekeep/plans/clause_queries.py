"""Queries of the clause operators over the bound clause table, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators import clauses as C
from lorekeep.plans import bindings as B

C_SQL = "WITH " + B.clauses_sql()
A_SQL = "WITH " + B.clauses_sql(conjoined=True)
_NEG = "coalesce(quantifier IN ('negative', 'negated_universal'), false)"
_ID = "stmt_id, pos"


def _keep(*extra):
    """Query that adds columns to (stmt_id, pos)."""
    return lambda s, d: B.clauses(s, d).select("stmt_id", "pos", *[f().alias(n) for n, f in extra])


def _leaves(s, d):
    c = B.clauses(s, d)
    packed = c.groupBy("stmt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "op", F.map_values("senses")[0].alias("first"), "quantifier"))).alias("leaves"))
    packed = packed.select("stmt_id", F.transform("leaves", lambda x: F.struct(x["op"].alias("op"), x["quantifier"].alias("quantifier"))).alias("leaves"))
    return C.explode_leaves(packed)


def _sense_parts(s, d):
    return B.clauses(s, d).select("stmt_id", "pos", C.sense_parts(F.element_at("senses", "predicate")).alias("p")).select("stmt_id", "pos", F.col("p.lemma").alias("lemma"), F.col("p.pos").alias("word_class"), F.col("p.nr").alias("nr"))


def _mods(s, d):
    c = B.events(s, d)
    k = F.col("k")
    mods = F.map_filter(F.create_map(F.lit("mod0"), F.when(k % 3 > 0, F.concat(F.lit("a"), k.cast("string"))), F.lit("mod1"), F.when(k % 3 > 1, F.lit("b")), F.lit("mod3"), F.lit("gap")), lambda _, v: v.isNotNull())
    return c.select("event_id", mods.alias("senses")).select("event_id", F.array_join(C.mod_senses("mod"), ",").alias("mods"))


def _quantifier(s, d):
    """The words of all documents and, with each region, every word that tells something."""
    told = "all every each everything everyone everybody always some any several something someone somebody sometimes occasionally a an no none neither nothing nobody never the this that these those usually often normally generally typically who whom which whose what where when how why mind"
    words = B.table(s, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    words = words.unionByName(B.table(s, d, "region").select(F.explode(F.split(F.lit(told), " ")).alias("word")))
    return C.quantifier_of(words).groupBy("quantifier", "asks").agg(F.count("*").alias("n"))


def _verdict(s, d):
    c = B.clauses(s, d)
    status = F.when(F.col("unknown"), "insufficient").when(F.col("contrast"), "inconsistent").otherwise("resolved")
    return c.select("stmt_id", "pos", C.verdict_token(status, F.col("truth")).alias("token"))


def _op_similarity(s, d):
    """How like each clause's operator is to the one before it, on average over a statement."""
    before = F.lag("op").over(Window.partitionBy("stmt_id").orderBy("pos"))
    pairs = B.clauses(s, d).select("stmt_id", F.col("op").alias("op_b"), before.alias("op_a")).where("op_a is not null")
    return pairs.join(F.broadcast(C.operator_similarity(s)), ["op_a", "op_b"]).groupBy("stmt_id").agg(F.round(F.avg("similarity"), 6).alias("similarity"))


QUERIES = {
    "explode_leaves": _leaves,
    "is_asserted": lambda s, d: C.is_asserted(B.clauses(s, d, conjoined=True)),
    "is_crisp": _keep(("crisp", C.is_crisp)),
    "is_question": lambda s, d: B.clauses(s, d).select("stmt_id", "pos", C.is_question().alias("strict"), C.is_question(0.75).alias("loose")),
    "is_private": lambda s, d: B.log(s, d).select("id", C.is_private(F.col("channel") < 5).alias("private")),
    "role_key": lambda s, d: B.clauses(s, d).select("stmt_id", "pos", C.role_key("subject").alias("subject"), C.role_key("direct").alias("direct")),
    "claim_key": lambda s, d: B.clauses(s, d).select("stmt_id", "pos", C.claim_key().alias("k")).select("stmt_id", "pos", "k.*"),
    "net_key": lambda s, d: C.net_key(B.clauses(s, d)),
    "conclusion_key": lambda s, d: C.conclusion_key(B.clauses(s, d)),
    "statement_senses": lambda s, d: C.statement_senses(B.clauses(s, d)).select("stmt_id", F.array_join("senses", ",").alias("senses")),
    "statement_digest": lambda s, d: C.statement_digest(B.clauses(s, d)),
    "leaf_sound": lambda s, d: C.stumbles(B.clauses(s, d)).join(B.clauses(s, d).groupBy("stmt_id").agg(F.count_if(C.leaf_sound()).alias("sound")), "stmt_id"),
    "sense_parts": _sense_parts,
    "mod_senses": _mods,
    "role_pairs": lambda s, d: C.role_pairs(B.clauses(s, d)),
    "corner": _keep(("corner", C.corner)),
    "split_conjuncts": lambda s, d: C.split_conjuncts(B.clauses(s, d, conjoined=True)),
    "verdict_token": _verdict,
    "quantifier_of": _quantifier,
    "fold_truth": lambda s, d: C.fold_truth(B.clauses(s, d)).select("stmt_id", F.round("truth", 6).alias("truth")),
    "operator_similarity": _op_similarity,
}

_IMPLY = lambda a, b: f"(CASE WHEN {a} <= {b} THEN 1.0::DOUBLE ELSE {b} END)"
_STEP = f"""CASE x.op WHEN 'NOT' THEN least(a, 1 - x.t) WHEN 'THAT' THEN least(a, x.t) WHEN 'AND' THEN least(a, x.t) WHEN 'OR' THEN greatest(a, x.t) WHEN 'IMPLY' THEN {_IMPLY("a", "x.t")} END"""
_FUZZY = {
    "NOT": "1 - a", "AND": "least(a, b)", "OR": "greatest(a, b)", "XOR": "greatest(least(a, 1 - b), least(1 - a, b))", "XNOR": "1 - greatest(least(a, 1 - b), least(1 - a, b))",
    "IMPLY": _IMPLY("a", "b"), "CONV": _IMPLY("b", "a"), "EQ": f"least({_IMPLY('a', 'b')}, {_IMPLY('b', 'a')})", "ANDNOT": "least(a, 1 - b)", "ORNOT": "greatest(a, 1 - b)",
    "NOTIMPLY": f"1 - {_IMPLY('a', 'b')}", "NOTCONV": f"1 - {_IMPLY('b', 'a')}", "NOTEQ": f"1 - least({_IMPLY('a', 'b')}, {_IMPLY('b', 'a')})",
}

ORACLES = {
    "explode_leaves": f"{C_SQL} SELECT {_ID}, op, quantifier FROM clauses",
    "is_asserted": f"{A_SQL} SELECT stmt_id, bool_and(op = 'AND' AND attitude IS NULL) AS asserted FROM clauses GROUP BY 1",
    "is_crisp": f"{C_SQL} SELECT {_ID}, modal IS NULL AS crisp FROM clauses",
    "is_question": f"{C_SQL} SELECT {_ID}, dubitative >= 0.999 OR wh_role IS NOT NULL AS strict, dubitative >= 0.75 OR wh_role IS NOT NULL AS loose FROM clauses",
    "is_private": f"WITH {B.LOG} SELECT id, channel < 5 AND directedness >= 0.95 AS private FROM log",
    "role_key": f"{C_SQL} SELECT {_ID}, subject, s_direct AS direct FROM clauses",
    "claim_key": f"{C_SQL} SELECT {_ID}, subject, s_predicate AS predicate, s_direct AS direct FROM clauses",
    "net_key": f"{C_SQL} SELECT {_ID}, subject, s_predicate AS predicate, s_direct AS direct, negated <> {_NEG} AS net FROM clauses",
    "conclusion_key": f"""{C_SQL}, p AS (SELECT DISTINCT stmt_id, concat_ws('|', subject, s_predicate, coalesce(s_direct, '~'), negated::VARCHAR, (quantifier = 'negated_universal')::VARCHAR) AS part FROM clauses)
SELECT stmt_id, md5(string_agg(part, ';' ORDER BY part)) AS key FROM p GROUP BY 1""",
    "statement_senses": f"""{C_SQL}, x AS (SELECT stmt_id, unnest([s_subject, s_predicate, s_direct]) AS sense FROM clauses), y AS (SELECT DISTINCT * FROM x WHERE sense IS NOT NULL)
SELECT stmt_id, string_agg(sense, ',' ORDER BY sense) AS senses FROM y GROUP BY 1""",
    "statement_digest": f"""{C_SQL} SELECT stmt_id, string_agg(concat_ws(' ', op, CASE WHEN negated THEN 'not' END, quantifier, subject, s_predicate, coalesce(s_direct, '-')), ' / ' ORDER BY pos) AS digest FROM clauses GROUP BY 1""",
    "leaf_sound": f"{C_SQL} SELECT stmt_id, NOT bool_and(NOT unknown) AS stumbles, count(*) FILTER (NOT unknown) AS sound FROM clauses GROUP BY 1",
    "sense_parts": f"{C_SQL} SELECT {_ID}, split_part(s_predicate, '.', 1) AS lemma, split_part(s_predicate, '.', 2) AS word_class, split_part(s_predicate, '.', 3)::INT AS nr FROM clauses",
    "mod_senses": f"WITH {B.EVENTS} SELECT event_id, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || k ELSE 'a' || k || ',b' END AS mods FROM ev",
    "role_pairs": f"{C_SQL} SELECT {_ID}, 'place' AS frame, subject, s_direct AS object FROM clauses WHERE m_direct = 'in' AND s_direct IS NOT NULL",
    "corner": f"""{C_SQL} SELECT {_ID}, CASE WHEN modal IS NOT NULL THEN 'MODAL' WHEN quantifier = 'universal' THEN CASE WHEN negated THEN 'O' ELSE 'A' END
 WHEN quantifier = 'negated_universal' THEN CASE WHEN negated THEN 'I' ELSE 'O' END WHEN quantifier = 'negative' THEN CASE WHEN negated THEN 'I' ELSE 'E' END
 WHEN quantifier IN ('existential', 'indefinite') THEN CASE WHEN negated THEN 'O' ELSE 'I' END ELSE 'CRISP' END AS corner FROM clauses""",
    "split_conjuncts": f"""{A_SQL}, w AS (SELECT stmt_id, bool_and(op = 'AND' AND attitude IS NULL AND NOT contrast AND dubitative < 0.999 AND wh_role IS NULL) AS plain, count(DISTINCT CASE WHEN cause IS NULL THEN subject END) AS n FROM clauses GROUP BY 1),
g AS (SELECT stmt_id, subject, row_number() OVER (PARTITION BY stmt_id ORDER BY min(pos)) - 1 AS part FROM clauses WHERE cause IS NULL GROUP BY 1, 2)
SELECT c.stmt_id, 0 AS part, c.pos FROM clauses c JOIN w USING (stmt_id) WHERE NOT (plain AND n >= 2)
UNION ALL SELECT c.stmt_id, CAST(g.part AS INT), c.pos FROM clauses c JOIN w USING (stmt_id) JOIN g ON g.stmt_id = c.stmt_id AND (c.cause IS NOT NULL OR g.subject = c.subject) WHERE plain AND n >= 2""",
    "verdict_token": f"{C_SQL} SELECT {_ID}, CASE WHEN unknown THEN 'unknown' WHEN contrast THEN 'inconsistent' WHEN truth > 0.85 THEN 'true' WHEN truth < 0.15 THEN 'false' END AS token FROM clauses",
    # Written out by hand: the operator's own table must not be its judge.
    "quantifier_of": r"""WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents UNION ALL SELECT unnest(string_split('all every each everything everyone everybody always some any several something someone somebody sometimes occasionally a an no none neither nothing nobody never the this that these those usually often normally generally typically who whom which whose what where when how why mind', ' ')) FROM region)
SELECT CASE WHEN word IN ('all', 'every', 'each', 'everything', 'everyone', 'everybody', 'always') THEN 'universal' WHEN word IN ('some', 'any', 'several', 'something', 'someone', 'somebody', 'sometimes', 'occasionally') THEN 'existential' WHEN word IN ('a', 'an') THEN 'indefinite'
 WHEN word IN ('no', 'none', 'neither', 'nothing', 'nobody', 'never') THEN 'negative' WHEN word IN ('the', 'this', 'that', 'these', 'those') THEN 'definite' ELSE 'generic' END AS quantifier,
 CASE WHEN word IN ('who', 'whom', 'which', 'whose') THEN 'subject' WHEN word = 'what' THEN 'predicate' WHEN word = 'where' THEN 'location' WHEN word = 'when' THEN 'time' WHEN word = 'how' THEN 'manner' WHEN word = 'why' THEN 'cause' END AS asks, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2""",
    "fold_truth": f"""{C_SQL}, x AS (SELECT stmt_id, pos, op, CASE WHEN attitude IS NOT NULL THEN 0.5 + (truth - 0.5) * attitude ELSE truth END AS t FROM clauses),
l AS (SELECT stmt_id, list(struct_pack(op := op, t := CASE WHEN pos = 0 AND op = 'NOT' THEN 1 - t ELSE t END) ORDER BY pos) AS v FROM x GROUP BY 1)
SELECT stmt_id, round(list_reduce(list_transform(v, lambda x: struct_pack(op := x.op, t := x.t)), lambda p, x: struct_pack(op := x.op, t := {_STEP.replace("least(a", "least(p.t").replace("greatest(a", "greatest(p.t").replace("WHEN a <=", "WHEN p.t <=")})).t, 6) AS truth FROM l""",
    "operator_similarity": C_SQL + ", g AS (SELECT i / 20.0::DOUBLE AS a, j / 20.0::DOUBLE AS b, i, j FROM range(21) x(i), range(21) y(j)), v AS ("
    + " UNION ALL ".join(f"SELECT i, j, '{n}' AS op, ({e})::DOUBLE AS v FROM g" for n, e in _FUZZY.items())
    + """), m AS (SELECT x.op AS op_a, y.op AS op_b, round(1 - avg(abs(x.v - y.v)), 6) AS similarity FROM v x JOIN v y USING (i, j) GROUP BY 1, 2
UNION ALL SELECT DISTINCT op, 'THAT', 0.0 FROM v UNION ALL SELECT DISTINCT 'THAT', op, 0.0 FROM v UNION ALL SELECT 'THAT', 'THAT', 1.0),
p AS (SELECT stmt_id, op AS op_b, lag(op) OVER (PARTITION BY stmt_id ORDER BY pos) AS op_a FROM clauses) SELECT stmt_id, round(avg(similarity), 6) AS similarity FROM p JOIN m USING (op_a, op_b) GROUP BY 1""",
}
