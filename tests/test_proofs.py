"""Proofs: derivations and premises of verdicts, proof by contradiction, places with one answer."""

from pyspark.sql import functions as F

from lorekeep.operators import inference as I
from lorekeep.operators import revision as R
from test_reasoning import kb

CLAIM = "claim_id long, subject string, predicate string, object string, negated boolean"


def proved(spark, k, claims):
    df = spark.createDataFrame(claims, "claim_id long, seed string, predicate string, negated boolean")
    return {r.claim_id: (r.proved, r.derivation, r.premises) for r in I.reductio_prove(df, k).collect()}


def test_reductio_assumes_memberships_in_contexts(spark):
    k = kb(
        spark,
        edges=[("k", "m", "k|is_a|m"), ("dog", "animal", None)],
        rules=[("r1", "property", "m", "q", None, True, []), ("r2", "property", "animal", "breathe.v.01", None, False, []), ("r3", "property", "stone", "breathe.v.01", None, True, [])],
        facts=[("u", "a", False, "f2")],
        properties=[("s", "q", None, False, "f1"), ("u", "q", None, True, "f3")],
    )
    got = proved(spark, k, [(1, "s", "k", False), (2, "s", "k", True), (3, "u", "k", False), (4, "dog", "stone", False), (5, "dog", "stone", True), (6, "dog", "animal", True), (7, "s", "unheard", False), (8, "dog", "animal", False)])
    assert got[1] == (False, ["assume s is k", "s is k —is_a→ m -> r1 -> s not q", "the assumption is false"], ["f1", "k|is_a|m", "r1"])
    assert got[2][0] is True and got[2][2] == ["f1", "k|is_a|m", "r1"]
    assert got[3] == (None, None, None)  # nothing says that u does q
    assert got[4][0] is False and got[4][2] == ["r2", "r3"]
    assert got[5][0] is True
    assert got[6] == (False, ["assume dog is not animal", "the assumption is false"], [])  # the class chain is bedrock
    assert got[7] == (None, None, None)
    assert got[8][0] is True


def test_reductio_does_not_use_old_conflicts(spark):
    k = kb(
        spark,
        facts=[("s", "c", False, "f0")],
        properties=[("s", "q", None, False, "f1"), ("s", "q", None, True, "f2"), ("t", "q", None, True, "f3")],
        conditional=[("c1", "c", "p", None, [], "q", None, False)],
    )
    got = proved(spark, k, [(1, "s", "p", False), (2, "s", "c", False)])
    assert got == {1: (None, None, None), 2: (None, None, None)}
    k["facts"] = k["facts"].unionByName(spark.createDataFrame([("t", "c", False, "f4")], k["facts"].schema))
    got = proved(spark, k, [(1, "t", "p", False), (2, "t", "p", True)])
    assert got[1] == (False, ["assume t p", "t is c and t p -> c1 -> t q", "the assumption is false"], ["c1", "f3", "f4"])
    assert got[2][0] is True


def test_reductio_without_claims_or_knowledge(spark):
    assert proved(spark, kb(spark), [(1, "s", "k", False)]) == {1: (None, None, None)}
    assert I.reductio_prove(spark.createDataFrame([], "claim_id long, seed string, predicate string"), kb(spark)).count() == 0


def test_verdicts_carry_the_lines_of_their_proof(spark):
    k = kb(
        spark,
        edges=[("cat", "mammal", None), ("mammal", "animal", "mammal|is_a|animal"), ("animal", "cat", None)],
        rules=[("r1", "membership", "animal", "eater", None, False, []), ("r2", "property", "eater", "eat.v.01", None, False, [])],
        facts=[("tom", "cat", False, "f1")],
        properties=[("tom", "hunt.v.01", "mouse", False, "p1"), ("tom", "sing.v.01", None, True, "p2")],
        conditional=[("c1", "mammal", "eat.v.01", None, [("hunt.v.01", "mouse")], "grow.v.01", None, False), ("c2", None, "grow.v.01", None, [], "age.v.01", None, False)],
    )
    closure = I.class_fixpoint(k["facts"], k["edges"], k["rules"], k["sufficient"], k["properties"])
    derived = I.forward_chain(k, closure)
    claims = spark.createDataFrame([(1, "tom", "age.v.01", None, False), (2, "tom", "animal", None, True), (3, "tom", "sing.v.01", None, False), (4, "tom", "fly.v.01", None, False), (5, "rex", "bark.v.01", None, False), (6, "rex", "near.v.01", None, False), (7, "tom", "eat.v.01", None, True)], CLAIM)
    up = closure.select(F.col("seed").alias("subject"), F.col("klass").alias("object"), "premises")
    none = spark.createDataFrame([], "subject string, object string")
    facts = spark.createDataFrame([("rex", "bark.v.01", None, True, "axiom", 1)], "subject string, predicate string, object string, negated boolean, kind string, ordinal long")
    near = spark.createDataFrame([(6, 0.8), (6, 0.91), (5, 0.99)], "claim_id long, sim double")
    rungs = [("is_a", I.ground_isa(claims, up, none, closure)), ("rules", I.chain_ground(claims, derived, closure=closure)), ("fact", I.individual_fact(claims, k["facts"], k["properties"])), ("direct", I.direct_fact(claims, facts)), ("definition", I.definition_rung(claims, near))]
    got = {r.claim_id: r for r in I.evaluate(claims, rungs).collect()}
    cat = "tom is cat —is_a→ mammal"
    eats = f"{cat} —is_a→ animal -> all animal are eater -> r2 -> tom eat.v.01"
    assert got[1].derivation == [eats, f"{cat} and tom eat.v.01 and hunt.v.01 mouse -> c1 -> tom grow.v.01", "tom grow.v.01 -> c2 -> tom age.v.01"]
    assert got[1].premises == ["c1", "c2", "f1", "mammal|is_a|animal", "p1", "r1", "r2"]
    assert (got[2].truth, got[2].derivation, got[2].premises) == (0.0, [f"subsumed: {cat} —is_a→ animal"], ["f1", "mammal|is_a|animal"])
    assert (got[3].truth, got[3].derivation, got[3].premises) == (0.0, ["fact: tom not sing.v.01"], ["p2"])
    assert (got[4].truth, got[4].status, got[4].derivation, got[4].premises) == (0.5, "insufficient", [], [])
    assert (got[5].rung, got[5].derivation, got[5].premises) == ("direct", ["direct fact refutes: stored axiom rex not bark.v.01"], [])
    assert (got[6].rung, got[6].derivation) == ("definition", ["as near as 0.91 to a definition"])
    assert (got[7].truth, got[7].derivation) == (0.0, [eats])
    again = I.evaluate(claims, rungs, spark.createDataFrame([(1,)], "claim_id long"))
    assert {r.claim_id: (r.status, r.derivation) for r in again.collect()}[1] == ("inconsistent", [])


def test_a_claim_of_place_has_one_answer(spark):
    claims = spark.createDataFrame([(1, "japan", "asia", False), (2, "japan", "country", True), (3, "japan", "europe", False)], "claim_id long, subject string, object string, negated boolean")
    inside = spark.createDataFrame([("japan", "asia", True), ("japan", "asia", True), ("japan", "country", False), ("japan", "europe", None)], "inner string, outer string, contains boolean")
    types = spark.createDataFrame([("japan", "country"), ("japan", "europe")], "uid string, sense string")
    up = spark.createDataFrame([("x", "y")], "node string, ancestor string")
    got = sorted((r.claim_id, r.holds, r.derivation) for r in R.ground_place(claims, inside, types, up).collect())
    assert got == [(1, True, ["japan is in asia"]), (2, True, ["japan is not in country"]), (3, True, ["japan is of the type europe and so europe"])]
