"""Branches of operators that the bound tables do not reach, on rows made by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorekeep.operators import consistency as K
from lorekeep.operators import extraction as X
from lorekeep.operators import inference as I
from lorekeep.operators import ledger as L
from lorekeep.operators import people as P
from lorekeep.operators import revision as R
from lorekeep.operators import timeline as T
from lorekeep.operators import vectors as V
from lorekeep.streaming import log as S

COND = "array<struct<predicate:string,object:string>>"


def kb(spark, edges=(), rules=(), facts=(), properties=(), conditional=()):
    return {
        "facts": spark.createDataFrame(list(facts), "seed string, klass string, negated boolean, fact_id string"),
        "properties": spark.createDataFrame(list(properties), "seed string, predicate string, object string, negated boolean, fact_id string"),
        "edges": spark.createDataFrame(list(edges), "child string, parent string, source string"),
        "rules": spark.createDataFrame(list(rules), f"rule_id string, kind string, subject string, predicate string, object string, negated boolean, conds {COND}"),
        "sufficient": spark.createDataFrame([], f"rule_id string, genus string, klass string, conds {COND}"),
        "conditional": spark.createDataFrame(list(conditional), f"rule_id string, cond_class string, cond_pred string, cond_obj string, cond_extra {COND}, concl_pred string, concl_obj string, concl_negated boolean"),
    }


def test_fixpoints_go_on_until_nothing_is_new(spark):
    n = 28
    chain = kb(
        spark,
        edges=[(f"k{i}", f"k{i + 1}", None) for i in range(n)] + [(f"k{n}", "k0", None)],
        rules=[("r", "property", f"k{n}", "p0", None, False, [])],
        facts=[("me", "k0", False, "f")],
        conditional=[(f"c{i}", None, f"p{i}", None, [], f"p{i + 1}", None, False) for i in range(26)],
    )
    assert {r.predicate for r in I.forward_chain(chain).collect()} == {f"p{i}" for i in range(27)}


def test_conditional_rules_wait_for_their_last_condition(spark):
    k = kb(
        spark,
        properties=[("me", "a", None, False, "f1"), ("me", "d", "x", False, "f2"), ("you", "a", None, False, "f3")],
        conditional=[("c1", None, "a", None, [("c", None), ("d", "x")], "e", None, False), ("c2", None, "a", None, [], "b", None, False), ("c3", None, "b", None, [], "c", None, False)],
    )
    got = {(r.seed, r.predicate): sorted(r.premises) for r in I.forward_chain(k).collect()}
    assert got[("me", "e")] == ["c1", "c2", "c3", "f1", "f2"]
    assert ("you", "e") not in got and ("you", "c") in got


def test_saturation_and_its_ablation(spark):
    k = kb(spark, edges=[("a", "b", None), ("b", "c", "b|is_a|c")], rules=[("r1", "property", "b", "low", None, False, []), ("r2", "property", "c", "high", None, False, [])], facts=[("me", "a", False, "f")])
    assert {(r.predicate, r.trust) for r in I.saturate(k).collect()} == {("low", 0.9), ("high", 0.3)}
    assert [r.predicate for r in I.tier_ablation(k, k["edges"].where("source is null")).collect()] == ["high"]


def test_siblings_decide_only_if_they_agree(spark):
    claims = spark.createDataFrame([(1, "x", "p", None, False), (2, "y", "p", None, False), (3, "z", "p", None, True)], "claim_id long, subject string, predicate string, object string, negated boolean")
    derived = spark.createDataFrame([("x1", "p", None, False, False), ("x2", "p", None, False, False), ("y1", "p", None, False, False), ("y2", "p", None, True, False), ("z", "p", None, True, False), ("z1", "p", None, False, False)], "seed string, predicate string, object string, negated boolean, conflict boolean")
    siblings = spark.createDataFrame([("x", "x1"), ("x", "x2"), ("y", "y1"), ("y", "y2"), ("z", "z1")], "sense string, sibling string")
    assert {r.claim_id: r.holds for r in I.chain_ground(claims, derived, siblings).collect()} == {1: True, 3: True}


def test_polar_answers_fall_back(spark):
    v = spark.createDataFrame([(1, 0.9, "resolved"), (2, 0.5, "insufficient"), (3, 0.5, "insufficient"), (4, 0.5, "insufficient"), (5, 0.0, "inconsistent")], "claim_id long, truth double, status string")
    direct = spark.createDataFrame([(1, False, 0.2), (2, False, 0.6)], "claim_id long, holds boolean, trust double")
    proved = spark.createDataFrame([(2, True), (3, True)], "claim_id long, proved boolean")
    got = {r.claim_id: (r.answer, r.confidence) for r in I.answer_polar(v, 0.8, direct=direct, proved=proved).collect()}
    assert got == {1: ("yes", 0.8), 2: ("no", 0.6), 3: ("yes", 0.8), 4: ("unknown", 0.5), 5: ("no", 1.0)}


def leaves(spark, rows):
    return spark.createDataFrame(rows, "stmt_id long, pos int, op string, attitude double, subject string, predicate string, direct string, corner string, negated boolean, unknown boolean, reflexive boolean")


def test_contradictions_of_each_source(spark):
    leaf = lambda s, p, pred, corner="CRISP", neg=False, op="AND", unknown=False, reflexive=False: (s, p, op, None, "x", pred, None, corner, neg, unknown, reflexive)
    rows = [
        leaf(1, 0, "a"), leaf(1, 1, "a", neg=True), leaf(2, 0, "a"), leaf(2, 1, "a", neg=True, op="OR"), leaf(3, 0, "a", "A"), leaf(3, 1, "a", "O", neg=True), leaf(4, 0, "a", "I"), leaf(4, 1, "a", "O", neg=True),
        leaf(5, 0, "alive"), leaf(5, 1, "dead"), leaf(6, 0, "alive", "I"), leaf(6, 1, "dead", "I"), leaf(7, 0, "a", neg=True, reflexive=True), leaf(8, 0, "a", unknown=True), leaf(8, 1, "a", neg=True, unknown=True),
        leaf(9, 0, "a"), leaf(9, 1, "b", op="OR"), leaf(9, 2, "a", neg=True), leaf(9, 3, "b", neg=True), leaf(10, 0, "a", op="NOT"), leaf(10, 1, "a"),
    ] + [leaf(11, i, f"p{i}") for i in range(17)] + [leaf(11, 17, "p0", neg=True)]
    found = K.contradictions(leaves(spark, rows), spark.createDataFrame([("dead", "alive")], "a string, b string"))
    assert sorted(r.stmt_id for r in found.collect()) == [1, 3, 5, 7, 9, 10]


def test_statements_of_one_speaker_at_odds(spark):
    leaf = lambda i, p, pred, neg=False, op="AND", who="me", unknown=False: (i, who, i, p, op, None, "x", pred, None, "CRISP", neg, unknown, False)
    rows = [
        leaf(1, 0, "a"), leaf(1, 1, "b", op="OR"), leaf(2, 0, "a", True), leaf(3, 0, "b", True), leaf(3, 1, "a", True),  # a or b; not a (fits); neither (at odds with the first)
        leaf(4, 0, "c"), leaf(4, 1, "d", op="IMPLY"), leaf(5, 0, "c"), leaf(5, 1, "d", True),  # c implies d; c and not d
        leaf(6, 0, "e", op="NOT"), leaf(7, 0, "e"), leaf(8, 0, "e"), leaf(8, 1, "e", True), leaf(9, 0, "e", True),  # not e; e; both; not e again
        leaf(10, 0, "f", unknown=True), leaf(11, 0, "f", True, unknown=True), leaf(12, 0, "a", True, who="you"), leaf(13, 0, "a", who=None), leaf(14, 0, "a", True, who=None),
        leaf(15, 0, "dead"), leaf(15, 1, "q", op="ANDNOT"), leaf(16, 0, "alive"), leaf(16, 1, "r", op="THAT"),  # antonyms
    ] + [leaf(20, i, f"p{i}", op="OR") for i in range(17)] + [leaf(21, i, f"p{i}", True) for i in range(17)]
    df = spark.createDataFrame(rows, "id long, speaker string, us long, pos int, op string, attitude double, subject string, predicate string, direct string, corner string, negated boolean, unknown boolean, reflexive boolean")
    opposite = spark.createDataFrame([("dead", "alive")], "a string, b string")
    got = {r.id: r.other for r in K.cross_item_mixed(df, antonyms=opposite).collect()}
    assert got == {3: 1, 5: 4, 7: 6, 9: 7, 16: 15}
    assert {r.id: r.other for r in K.cross_item_mixed(df, k=1, antonyms=opposite).collect()} == {5: 4, 7: 6, 16: 15}
    assert K.cross_item_mixed(df.limit(0)).count() == 0


def test_sufficient_rules_of_each_fault(spark):
    def leaf(doc, pos, subject, predicate, obj=None, negated=False, op="AND"):
        return (doc, pos, op, None, None, negated, subject, predicate, obj)

    named = {1: ("vehicle.n.01", "carry.v.01", "goods.n.01"), 2: ("vehicle.n.01", "carry.v.01", None), 3: ("other.n.01", "carry.v.01", "goods.n.01"), 4: ("genus.n.01", "red.a.01", None), 5: (None, "vehicular.a.01", None), 6: (None, "thing.n.01", None), 7: (None, None, None)}
    rows = [leaf(d, 0, "vehicle.n.01", "genus.n.01") for d in range(1, 10)] + [leaf(d, 1, *v) for d, v in named.items()]
    rows += [leaf(8, 1, None, "red.a.01", negated=True), leaf(9, 1, None, "genus.n.01")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, op string, attitude double, modal string, negated boolean, subject string, predicate string, object string")
    got = {r.doc_id: r.verdict for r in X.sufficient_rules(X.dnf_branches(df), df, X.genera(df)).collect()}
    assert got == {1: "accept", 2: "verb_noobj", 3: "foreign_subj", 4: "accept", 5: "circular", 6: "noun_cond", 7: "no_pred", 8: "negated_cond", 9: "bare"}


def test_denials_of_those_who_were_asked(spark):
    targets = spark.createDataFrame([(1, "r", 0.5)], "claim_id long, rule_id string, belief_trust double")
    claims = spark.createDataFrame([(1, "low", "s", "p", True), (2, "ann", "s", "p", False), (3, "bob", "s", "p", False), (4, "ann", "s", "p", True)], "claim_id long, speaker string, subject string, predicate string, net boolean")
    trust = spark.createDataFrame([("low", 0.4), ("ann", 0.1)], "speaker string, trust double")
    asked = spark.createDataFrame([("q", "ann", "s", "p", True)], "rule_id string, speaker string, subject string, predicate string, net boolean")
    assert [(r.claim_id, r.rule_id) for r in R.accept_correction(targets, claims, trust, asked).collect()] == [(2, "q")]


def test_public_rows_hide_names(spark):
    t = spark.createDataFrame([("t1", "x", True, ["Ann Lee met Ann", "it rains"], None), ("t2", "x", True, ["Annabel sang"], "taught")], "id string, original string, postable boolean, premises array<string>, derived_by string")
    people = spark.createDataFrame([("Ann", "a friend"), ("Lee", "someone")], "name string, label string")
    assert {r.slug: r.proof for r in R.post_rows(t, people).collect()} == {"t1": "1. a friend someone met a friend\n2. it rains", "t2": "1. Annabel sang"}


def test_places_of_a_class(spark):
    claims = spark.createDataFrame([(1, "japan", "country.n.01", False), (2, "japan", "region.n.01", True), (3, "japan", "fish.n.01", False)], "claim_id long, subject string, object string, negated boolean")
    none = spark.createDataFrame([], "inner string, outer string, contains boolean")
    types = spark.createDataFrame([("japan", "country.n.01")], "uid string, sense string")
    up = spark.createDataFrame([("country.n.01", "region.n.01")], "node string, ancestor string")
    assert {r.claim_id: r.holds for r in R.ground_place(claims, none, types, up).collect()} == {1: True, 2: False}


def test_anchors_by_word_and_against_antonyms(spark):
    items = spark.createDataFrame([(1, "good", [0.0, 1.0]), (2, "nice", [1.0, 0.1]), (3, "odd", [1.0, 1.0])], "vec_id long, word string, vector array<double>")
    anchors = spark.createDataFrame([("a", "+", "good", [1.0, 0.0]), ("b", "-", "bad", [0.0, 1.0])], "anchor_id string, value string, word string, vector array<double>")
    assert {r.vec_id: r.value for r in V.anchor_classify(items, anchors, 0.5, 0.1).collect()} == {1: "+", 2: "+", 3: "none"}
    against = spark.createDataFrame([("good", "bad")], "a string, b string")
    assert {r.vec_id: r.value for r in V.anchor_classify(items, anchors, 0.5, 0.1, antonyms=against).collect()} == {1: "+", 2: "none", 3: "none"}


def test_templates_by_bands(spark):
    requests = spark.createDataFrame([(1, "c", ["who"], "u", 0.9), (2, "c", ["who"], "u", 0.5)], "request long, category string, data array<string>, target string, confidence double")
    shelf = spark.createDataFrame([("c", "sure", ["who"], 1.0, "global", True, 0.8, None), ("c", "shy", ["who"], 1.0, "global", True, None, 0.2)], "category string, template string, slots array<string>, weight double, scope string, enabled boolean, confidence_low double, confidence_high double")
    got = {r.request: r.template for r in V.pick_template(requests, shelf).collect()}
    assert got[1] == "sure" and got[2] in ("sure", "shy")


def test_versions_are_carried_across_blocks(spark):
    rows = [(h, "v" + str(h) if h in (3, 17, 400) else "") for h in range(0, 500, 2)] + [(3, "v3"), (17, "v17")]
    got = {r.hour: r.version for r in T.sticky_version(spark.createDataFrame(rows, "hour long, version string"), block=4).collect()}
    want, last = {}, None
    for h, v in sorted(rows):
        last = v or last
        want[h] = last
    assert got == want


def test_trust_folds_alike_however_time_is_cut(spark):
    rows = [(1, t * 1000000, t, (-1) ** (t % 3) * 0.01 * (t % 37)) for t in range(300)]
    df = spark.createDataFrame(rows, "stakeholder long, us long, id long, delta double")
    trust = 0.5
    for *_, d in rows:
        trust = max(0.0, min(1.0, trust + d))
    for span in (1, 7, 1000):
        assert abs(L.trust_fold(df, span=span).first().trust - trust) < 1e-9


def test_a_repeated_batch_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1, 0.25)], "stakeholder long, us long, id long, delta double")
    seen = []
    for _ in range(2):
        S.trust_refold(df, 0, str(tmp_path / "trail"), lambda x: seen.append(x.first().trust))
    assert seen == [0.75, 0.75]


def test_open_exchange_as_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0, 5, 0, 1, 0.95), (2, t0 + timedelta(seconds=60), 5, 1, 1, 0.2), (3, t0 + timedelta(seconds=90), 0, 6, 1, 0.2), (4, t0 + timedelta(seconds=120), 6, 1, 1, 0.2), (5, t0 + timedelta(seconds=5000), 5, 1, 1, 0.2), (6, t0 + timedelta(seconds=100), 6, 1, 2, 0.2)]
    ddl = "id long, ts timestamp, source_id long, target_id long, channel int, directedness double"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: S.stream_turns(spark, str(tmp_path / "in"), ddl)
    out = str(tmp_path / "out")
    S.open_exchange(read(), read()).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).select("id").distinct().collect()) == [2, 4]
    batch = spark.createDataFrame(rows, ddl).withColumn("us", F.unix_micros("ts"))
    assert sorted(r.id for r in T.open_exchange(batch).where("open").collect()) == [2, 4]


def test_cursors_start_at_the_newest_row(spark):
    log = spark.createDataFrame([(1, 10, 5), (2, 20, 5), (3, 30, 6)], "id long, us long, source_id long")
    none = spark.createDataFrame([], "source_id long, us long, id long")
    first = T.next_cursors(log, none)
    assert T.new_turns(log, none).count() == 0 == T.new_turns(log, first).count()
    more = log.unionByName(spark.createDataFrame([(4, 20, 5), (5, 40, 5)], "id long, us long, source_id long"))
    assert sorted(r.id for r in T.new_turns(more, first).collect()) == [4, 5]


def test_quiet_rows_are_ambient(spark):
    log = spark.createDataFrame([(1, 0.95, 0.9), (2, 0.5, 0.7), (3, 0.1, 0.9), (4, 0.5, 0.5)], "id long, directedness double, p double")
    assert [(r.id, round(r.urge, 4)) for r in P.quiet_band(log, F.col("p")).collect()] == [(2, 0.425)]
