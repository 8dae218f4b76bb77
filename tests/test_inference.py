"""Hand-made cases of chaining, conflicts and retraction."""

from lorekeep.operators import graph as G
from lorekeep.operators import inference as I
from lorekeep.operators import ledger as L

COND = "array<struct<predicate:string,object:string>>"


def kb(spark, facts, props=(), edges=(), rules=(), sufficient=(), conditional=()):
    return {
        "facts": spark.createDataFrame(list(facts), "seed string, klass string, negated boolean, fact_id string"),
        "properties": spark.createDataFrame(list(props), "seed string, predicate string, object string, negated boolean, fact_id string"),
        "edges": spark.createDataFrame(list(edges), "child string, parent string, source string"),
        "rules": spark.createDataFrame(list(rules), f"rule_id string, kind string, subject string, predicate string, object string, negated boolean, conds {COND}"),
        "sufficient": spark.createDataFrame(list(sufficient), f"rule_id string, genus string, klass string, conds {COND}"),
        "conditional": spark.createDataFrame(list(conditional), "rule_id string, cond_class string, cond_pred string, cond_obj string, concl_pred string, concl_obj string, concl_negated boolean"),
    }


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_recognition_needs_every_condition_and_the_object(spark):
    k = kb(spark, [("ann", "animal", False, "f1"), ("bob", "animal", False, "f2")], [("ann", "speak.v.01", "word", False, "p1"), ("bob", "speak.v.01", "noise", False, "p2")], sufficient=[("s1", "animal", "person", [("speak.v.01", "word")])])
    c = I.class_fixpoint(k["facts"], k["edges"], k["rules"], k["sufficient"], k["properties"])
    assert rows(c, "seed", "klass") == [("ann", "animal"), ("ann", "person"), ("bob", "animal")]
    assert [r.premises for r in c.where("klass = 'person'").collect()] == [["f1", "p1", "s1"]]


def test_negated_membership_never_seeds_and_long_chains_end(spark):
    edges = [(f"c{i}", f"c{i + 1}", None) for i in range(9)] + [("c9", "c0", None)]
    k = kb(spark, [("ann", "c0", False, "f"), ("bob", "c0", True, "g")], edges=edges)
    c = I.membership_fixpoint(k["facts"], k["edges"], k["rules"], k["properties"])
    assert rows(c, "seed", "klass") == sorted(("ann", f"c{i}") for i in range(10))


def test_conflicts_cite_both_arms_and_are_not_novel(spark):
    k = kb(spark, [("ann", "a", False, "f")], edges=[("a", "b", None)], rules=[("r1", "property", "a", "run.v.01", None, False, []), ("r2", "property", "b", "run.v.01", None, True, []), ("r3", "property", "b", "eat.v.01", None, False, [])])
    chained = I.forward_chain(k)
    assert {r.predicate: r.premises for r in chained.where("conflict").collect()} == {"run.v.01": ["f", "r1", "r2"]}
    made = I.saturate(k).collect()
    assert [(r.predicate, r.premises, r.trust) for r in made] == [("eat.v.01", ["f", "r3"], 0.9)]


def test_reductio_decides_by_the_arm_that_conflicts(spark):
    k = kb(spark, [("ann", "a", False, "f")], rules=[("r1", "property", "a", "run.v.01", None, False, [])])
    claims = spark.createDataFrame([(1, "ann", "run.v.01", None), (2, "ann", "fly.v.01", None)], "claim_id long, seed string, predicate string, object string")
    assert rows(I.reductio_prove(claims, k), "claim_id", "proved") == [(1, True), (2, None)]


def test_cascade_of_three_generations_is_cycle_safe(spark):
    t = spark.createDataFrame([("t1", False, ["x"]), ("t2", False, ["t1", "t3"]), ("t3", False, ["t2"]), ("t4", True, ["t1"]), ("t5", False, ["y"])], "id string, archived boolean, premises array<string>")
    hit = G.revoke_cascade(t, spark.createDataFrame([("x",)], "id string"))
    assert rows(hit, "id", "round") == [("t1", 1), ("t2", 2), ("t3", 3)]


def test_conviction_ladder(spark):
    docs = spark.createDataFrame([("h", "hypothesis", False), ("a", "axiom", True), ("t", "theorem", False), ("u", "theorem", False)], "id string, kind string, readonly boolean")
    groups = spark.createDataFrame([("1", ["h", "t"]), ("2", ["a", "t"]), ("3", ["t", "u"]), ("4", ["a"]), ("5", ["k|is_a|l"])], "signature string, premises array<string>")
    assert rows(L.convict(groups, docs), "signature", "verdict") == [("1", "convicted"), ("2", "convicted"), ("3", "asked"), ("4", "constitution"), ("5", "unresolvable")]


def test_trust_clamps_at_each_step(spark):
    e = spark.createDataFrame([("p", i, i, d) for i, d in enumerate([0.4, 0.4, -0.1])] + [("q", 1, 1, -0.9), ("q", 2, 2, 0.2)], "stakeholder string, us long, id long, delta double")
    assert [(s, round(t, 6)) for s, t in rows(L.trust_fold(e), "stakeholder", "trust")] == [("p", 0.9), ("q", 0.2)]


def test_closure_takes_the_shortest_then_smallest_path(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a")], "child string, parent string")
    c = {(r.node, r.ancestor): r.path for r in G.ancestors(e).collect()}
    assert c["a", "d"] == ["a", "b", "d"]
    assert ("a", "a") not in c
