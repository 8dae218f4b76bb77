import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import meaning as M


@pytest.fixture
def stored(monkeypatch):
    rows = []
    store = G.store

    def counting(df):
        df = store(df)
        rows.append(df.count())
        return df

    monkeypatch.setattr(G, "store", counting)
    return rows


def test_paths_of_nodes_at_the_bottom_are_not_stored(spark, stored):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(8)]
    edges = chain + [(f"leaf{i}", p) for i in range(500) for p in ("c0", "c1")]
    got = {(r.node, r.ancestor): r.path for r in G.ancestors(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert len(got) == 36 + 500 * 9
    assert got["leaf7", "c8"] == ["leaf7", *[f"c{i}" for i in range(1, 9)]] and got["leaf7", "c0"] == ["leaf7", "c0"]
    assert sum(stored) <= 1200  # edges and the chain's paths, not the 4536 rows


def test_layers_meet_cycles_ties_depth_and_repeats(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("y", "b"), ("x", "x"), *[(f"l{i}", p) for i in range(30) for p in ("y", "x", "x")]]
    edges += [("l0", "a"), (None, "a"), ("l1", None)]
    frame = spark.createDataFrame(edges, "child string, parent string")
    got = {(r.node, r.ancestor): (r.path, r.depth) for r in G.ancestors(frame).collect()}
    assert got["l5", "b"] == (["l5", "y", "b"], 2) and got["l5", "c"] == (["l5", "x", "c"], 2) and got["l5", "a"] == (["l5", "x", "c", "a"], 3)
    assert got["l0", "a"] == (["l0", "a"], 1) and got["l0", "b"] == (["l0", "a", "b"], 2) and got["l0", "c"] == (["l0", "x", "c"], 2)
    assert ("a", "a") not in got and len(got) == 6 + 2 * 3 + 30 * 5 and len(got) == G.ancestors(frame).count()
    short = {(r.node, r.ancestor) for r in G.ancestors(frame, 2).collect()}
    assert short == {k for k, (_, d) in got.items() if d <= 2}


def test_pairs_of_a_large_class_are_listed_by_several_tasks(spark):
    senses = spark.range(20000).select(F.concat(F.lit("w"), F.col("id") % 40).alias("word"), F.concat(F.lit("s"), "id").alias("synset"), F.lit("n").alias("pos"), F.lit(0).alias("rank"))
    base = spark.range(10).select(F.concat(F.lit("b"), "id").alias("word"), F.concat(F.lit("z"), "id").alias("synset"), F.lit("n").alias("pos"), F.lit(0).alias("rank"))
    none = spark.createDataFrame([], "synset string, other string")
    keys = senses.select(F.col("synset").alias("key")).union(base.select("word")).withColumn("tokens", F.array(F.lit("red"), F.lit("round")))
    above = senses.union(base).select(F.col("synset").alias("node")).withColumn("depth", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("node", F.concat(F.lit("t"), "depth").alias("ancestor"), "depth")
    above = above.union(spark.createDataFrame([("t1", "t2", 1), ("t1", "t3", 2), ("t2", "t3", 1)], "node string, ancestor string, depth int"))
    closure = spark.createDataFrame([], "node string, ancestor string, depth int")
    for tree, glosses, rule in ((above, keys.limit(0), 5), (closure, keys, 6)):
        rows = M.semantic_matrix(senses, base, none, none, tree, glosses).groupBy("rule", F.spark_partition_id().alias("task")).count().collect()
        assert {r["rule"] for r in rows} == {rule} and sum(r["count"] for r in rows) == 200000
        assert max(r["count"] for r in rows) <= 150000


def test_blocks_of_a_key_give_each_pair_once(spark):
    many = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    others = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (7, "c")], "k long, name string")
    got = M._meet(many, others, "k", 50)
    assert got.columns == ["k", "id", "name"] and got.count() == 334 * 2 + 333 and got.distinct().count() == 334 + 333
    assert sorted(got.collect()) == sorted(many.join(others, "k").collect())
