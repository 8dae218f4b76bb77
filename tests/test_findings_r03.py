"""Cases that the third round's findings named."""

import random

import pytest

import test_queries as Q
from pyspark.sql import functions as F

from lorekeep.operators import anonymity as A
from lorekeep.operators import consistency as K
from lorekeep.operators import inference as I
from lorekeep.operators import ledger as L
from lorekeep.operators import meaning as M
from lorekeep.operators import places as P
from lorekeep.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = Q.duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def agrees(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(Q.plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(registry.ORACLES[name])
    at = [[x[0] for x in result.description].index(c) for c in columns]
    assert got == sorted((tuple(Q.plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got


def test_derive_conditional_joins_told_and_derived_properties(spark, sf, duck):
    agrees(spark, sf, duck, "derive_conditional")


def test_trust_just_at_a_border_is_in_the_upper_band(spark):
    rows = spark.createDataFrame([(0.6499999999999999,), (0.65,), (0.44999999999999996,), (0.6499,)], "trust double")
    band = L.trust_bands(F.col("trust"), F.lit(False), F.lit(False))
    assert [r.b for r in rows.select(band.alias("b")).collect()] == ["trusted", "trusted", "neutral", "neutral"]


def test_a_cosine_just_at_the_floor_does_not_drift(spark):
    schema = "doc_id long, pos int, sound boolean, subject string, predicate string, direct string, negated boolean, quantifier string, modal string, question boolean, vector array<double>"
    leaf = lambda doc, vector: (doc, 0, True, "s", "p", "d", False, "q", "m", False, vector)
    before = spark.createDataFrame([leaf(1, [-1.0, 0.0, 2.0]), leaf(2, [-1.0, 0.0, 2.0])], schema)
    after = spark.createDataFrame([leaf(1, [1.0, 0.0, 2.0]), leaf(2, [1.01, 0.0, 2.0])], schema)
    assert sorted(tuple(r) for r in M.preserves(before, after).collect()) == [(1, True, None), (2, False, "drifts")]


def test_places_and_rings_that_repeat_meet_once(spark):
    """2500 places at one point in 2500 polygons of one ring: 6.25 million pairs, but one point and one ring that meet."""
    point = lambda x, y: F.struct((F.col("id") * 0 + x).alias("x"), (F.col("id") * 0 + y).alias("y"))
    ring = F.array(point(0.0, 0.0), point(3.0, 0.0), point(3.0, 3.0), point(0.0, 3.0))
    polygons = spark.range(2500).select(F.concat(F.lit("p"), F.col("id")).alias("name"), ring.alias("ring"))
    none = F.lit(None).cast("array<string>")
    category = F.when(F.col("id") % 2 == 0, "geographical").otherwise("administrative")
    features = F.when(F.col("id") == 3, F.array(F.lit("p3"), F.lit("old"))).otherwise(none)
    places = spark.range(2500).select(F.col("id").alias("uid"), F.when(F.col("id") < 5, F.concat(F.lit("p"), F.col("id"))).otherwise("c").alias("name"), category.alias("category"), (F.col("id") * 0 + 1.0).alias("lon"), (F.col("id") * 0 + 1.0).alias("lat"), F.lit("land").alias("parent_geo"), F.array(F.lit("land"), F.lit("c")).alias("path_geo"), features.alias("physical_features"))
    rows = P.spatial_enrich(places, polygons)
    names = sorted(f"p{i}" for i in range(2500))
    got = {r.uid: r for r in rows.where("uid < 8").collect()}
    assert got[6].path_geo == ["land", *names, "c"] and got[6].parent_geo == names[-1] and got[6].physical_features == []
    assert got[4].path_geo == ["land", *[n for n in names if n != "p4"], "c"]
    assert got[7].physical_features == names and got[7].path_geo == ["land", "c"]
    assert got[1].physical_features == [n for n in names if n != "p1"]
    assert got[3].physical_features == sorted(["old", *names])


def test_only_people_whose_whole_uid_ends_somewhere_are_compared(spark):
    """1000 uids share their last four characters; before, each was compared with every line that has these."""
    people = spark.range(1000).select(F.concat(F.lit("C:"), F.col("id"), F.lit("345;")).alias("uid"), F.concat(F.lit("Ann "), F.col("id")).alias("name"), F.lit("a friend").alias("label"))
    lines = spark.createDataFrame([(1, "aNN 12 (c:12345;) went"), (2, "c:2000345;"), (3, "Ann"), (4, None)], "id long, text string")
    met = {r.id: sorted(x.literal for x in r.named) for r in A.mentions(lines, A._wanted(people)).collect()}
    assert met == {1: ["Ann 12", "C:12345;"]}
    assert {r.id: r.text for r in A.hide_people(lines, people).collect()} == {1: "a friend went", 2: "c:2000345;", 3: "Ann", 4: None}


def test_a_uid_that_grows_in_lower_case_is_hidden(spark):
    people = spark.createDataFrame([("abİz", "Bo", "somebody")], "uid string, name string, label string")
    assert A.hide_people(spark.createDataFrame([(1, "by abİz")], "id long, text string"), people).first().text == "by somebody"


def test_ablation_matches_conditions_once(spark, sf, monkeypatch):
    asked = []
    conds_met = I.conds_met
    monkeypatch.setattr(I, "conds_met", lambda *x: asked.append(1) or conds_met(*x))
    assert registry.QUERIES["tier_ablation"](spark, sf).columns == I.KEY
    assert len(asked) == 1


def test_individual_fact_chains_no_rules(spark, sf, duck, monkeypatch):
    monkeypatch.setattr(I, "forward_chain", None)
    monkeypatch.setattr(I, "class_fixpoint", None)
    agrees(spark, sf, duck, "individual_fact")


def test_a_channel_that_mentioned_much_holds_one_notion(spark, monkeypatch):
    """Channel 1 mentioned its 3000 nearest notions; before, it asked for 4096."""
    asked = []
    knn = M.knn
    monkeypatch.setattr(M, "knn", lambda q, v, k, **more: asked.append(k) or knn(q, v, k, **more))
    vector = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    topics = spark.range(1, 4).select(F.col("id").alias("channel"), vector(1, 0).alias("vector"))
    notions = spark.range(3002).select(F.col("id").alias("notion_id"), F.when(F.col("id") < 3000, vector(1, 0)).otherwise(vector(3, 1)).alias("vector"))
    mentioned = spark.range(3000).select(F.lit(1).cast("long").alias("channel"), F.col("id").alias("notion_id"))
    got = {r.channel: (r.notion_id, r.proximity) for r in M.association(topics, notions, mentioned, spark.createDataFrame([(3,)], "channel long")).collect()}
    assert got == {1: (3000, 0.948683), 2: (0, 1.0)}
    assert asked == [1]


def test_word_similarity_is_decided_between_classes(spark):
    rng = random.Random(5)
    up = {f"n{i}": f"n{(i - 1) // 2}" for i in range(1, 40)}
    chain = lambda n: [n, *chain(up[n])] if n in up else [n]
    targets = sorted({(f"w{rng.randrange(9)}", f"n{rng.randrange(44)}", rng.choice("nv"), 0) for _ in range(60)})
    base = sorted({(f"w{rng.randrange(14)}", f"n{rng.randrange(44)}", rng.choice("nv"), i) for i in range(40)})
    anti, der = [[(f"n{rng.randrange(44)}", f"n{rng.randrange(44)}") for _ in range(12)] for _ in range(2)]
    keys = [f"n{i}" for i in range(44)] + [f"w{i}" for i in range(14)]
    glosses = [(k, rng.choices(["of", "a", "b", "c", "d", "e", None], k=rng.randrange(1, 6))) for k in keys] + [("n3", ["of", "x"]), ("n3", ["of", "y"])]
    closure = [(n, a, i) for n in up for i, a in enumerate(chain(n)) if i]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    df = M.semantic_matrix(
        frame(targets, "word string, synset string, pos string, rank int"), frame(base, "word string, synset string, pos string, rank int"), frame(anti, "synset string, other string"),
        frame(der, "synset string, other string"), frame(closure, "node string, ancestor string, depth int"), frame(glosses, "key string, tokens array<string>"),
    )
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()  # pairs are listed, not gathered and grouped
    level, gloss, want = {n: len(chain(n)) for n in up}, {}, {}
    for k, tokens in glosses:
        gloss.setdefault(k, set()).update(tokens)
    for word, synset, _, _ in targets:
        for other in {x[0] for x in base}:
            own = [x for x in base if x[0] == other]
            top = [x for p in "nv" for x in sorted([x for x in own if x[2] == p], key=lambda x: (x[3], x[1]))[:3]]
            sims = [2 * level.get(a, 1) / (2 * level.get(a, 1) + chain(synset).index(a) + chain(x[1]).index(a)) for x in top if (word, synset, x[2], 0) in targets for a in set(chain(synset)) & set(chain(x[1]))]
            both = (gloss[synset] & gloss[other]) - {None}
            n = len(gloss[synset]) + len(gloss[other]) - len(both)
            rule = (
                (1, 1.0) if word == other else (2, 1.0) if synset in {x[1] for x in own} else (3, -1.0) if any((synset, x[1]) in anti for x in own)
                else (4, 0.9) if any((synset, x[1]) in der for x in own) else (5, round(max(sims), 3)) if sims and max(sims) > 0.65 else (6, min(0.5, round(5 * len(both) / n, 3))) if len(both) > 1 else None
            )
            if rule:
                want[word, synset, other] = rule
    rows = [((r.word, r.synset, r.base), (r.rule, r.value)) for r in df.collect()]
    assert dict(rows) == want and len(rows) == len(want)
    assert {r for r, _ in want.values()} == {1, 2, 3, 4, 5, 6}


def test_a_gloss_in_two_rows_counts_a_word_once(spark):
    senses = spark.createDataFrame([("w", "s", "n", 0)], "word string, synset string, pos string, rank int")
    base = spark.createDataFrame([("x", "t", "n", 0), ("y", "t", "n", 0)], "word string, synset string, pos string, rank int")
    none = spark.createDataFrame([], "synset string, other string")
    glosses = spark.createDataFrame([("s", ["of", "p"]), ("s", ["of", "q"]), ("x", ["of", "r"]), ("y", ["p", "q"])], "key string, tokens array<string>")
    df = M.semantic_matrix(senses, base, none, none, spark.createDataFrame([], "node string, ancestor string, depth int"), glosses)
    assert [tuple(r) for r in df.collect()] == [("w", "s", "y", 6, 0.5)]


MIXED = "id long, speaker string, us long, pos int, op string, attitude double, subject string, predicate string, direct string, corner string, negated boolean, unknown boolean, reflexive boolean"


def decided(monkeypatch, leaves, **kw):
    """The rows of cross_item_mixed, and how many statements and unions it folded."""
    folds, inner = [], K._never_true
    monkeypatch.setattr(K, "_never_true", lambda packed, keys: (folds.append(packed.count()), inner(packed, keys))[1])
    got = {r.id: r.other for r in K.cross_item_mixed(leaves, **kw).collect()}
    monkeypatch.undo()
    return got, folds


def test_one_pair_of_each_pattern_is_decided(spark, monkeypatch):
    leaf = lambda i, p, s, neg=False, op="AND": (i, f"me{i % 3}", i, p, op, None, s, "p", None, "CRISP", neg, False, False)
    # x or y; not x and not y: each couple of statements about things of its own
    rows = [x for i in range(0, 600, 6) for j in range(3) for x in (leaf(i + j, 0, f"x{i + j}"), leaf(i + j, 1, f"y{i + j}", op="OR"), leaf(i + j + 3, 0, f"x{i + j}", True), leaf(i + j + 3, 1, f"y{i + j}", True))]
    got, folds = decided(monkeypatch, spark.createDataFrame(rows, MIXED))
    assert got == {i + j + 3: i + j for i in range(0, 600, 6) for j in range(3)}
    assert max(folds) <= 2


def test_patterns_tell_what_all_pairs_tell(spark, monkeypatch):
    rng = random.Random(11)
    leaf = lambda i, p: (
        i, rng.choice("ab"), i, p, rng.choice(["AND", "AND", "AND", "OR", "NOT", "IMPLY", "ANDNOT", "XOR"]), rng.choice([None, None, None, 0.0, 0.5, 1.0]), rng.choice(["x", "@y", "z#"]), rng.choice(["p", "q", "r"]), None,
        rng.choice(["A", "E", "I", "O", "CRISP", "CRISP", "MODAL"]), rng.random() < 0.5, rng.random() < 0.1, rng.random() < 0.05,
    )
    rows = [leaf(i, p) for i in range(240) for p in range(rng.choice([1, 1, 2, 2, 3]))]
    rows = [(*r[:1], "ab"[r[0] % 2], *r[2:]) for r in rows]
    rows = [(*r[:4], "AND", None, *r[6:]) if r[0] % 3 == 0 else r for r in rows]
    df, opposite = spark.createDataFrame(rows, MIXED), spark.createDataFrame([("p", "q")], "a string, b string")
    packed = K._leaves(K._atoms(K.coded(df, opposite), F.concat_ws("-", F.col("id").cast("string"), F.col("pos").cast("string"))), "id").withColumn("n", F.floor(F.col("id") / 2)).localCheckpoint()
    own = {r.id for r in K._never_true(packed.select("id", F.array("l").alias("statements")), ["id"]).collect()}
    pairs = packed.join(packed.select(F.col("id").alias("other"), F.col("l").alias("_l"), F.col("n").alias("m")), (F.col("m") < F.col("n")) & (F.col("m") >= F.col("n") - 7) & (F.col("id") % 2 == F.col("other") % 2))
    odd = K._never_true(pairs.select("id", "other", F.array("l", "_l").alias("statements")), ["id", "other"]).collect()
    want = {}
    for r in odd:
        if r.id not in own and r.other not in own:
            want[r.id] = max(want.get(r.id, -1), r.other)
    got, _ = decided(monkeypatch, df, k=7, antonyms=opposite)
    assert got == want and len(want) > 30
