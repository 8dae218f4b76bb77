"""Cascades of any length, against a plain walk."""

import random

from lorekeep.operators import graph as G

THEOREM = "id string, archived boolean, postable boolean, premises array<string>"


def walk(theorems, seeds):
    found, frontier, n = {}, set(seeds), 0
    while frontier:
        n += 1
        frontier = {i for i, archived, _, premises in theorems if not archived and i not in found and frontier & set(premises)}
        found |= dict.fromkeys(frontier, n)
    return found


def cascade(spark, theorems, seeds):
    rows = G.revoke_cascade(spark.createDataFrame(theorems, THEOREM), spark.createDataFrame([(x,) for x in seeds], "id string")).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r["round"] for r in rows}


def test_a_chain_longer_than_64_is_revoked_and_tainted_to_its_end(spark):
    chain = [(f"t{i}", False, i > 0, [f"t{i - 1}"] if i else ["x"]) for i in range(300)]
    assert cascade(spark, chain, ["x"]) == walk(chain, ["x"]) == {f"t{i}": i + 1 for i in range(300)}
    assert not any(r.postable for r in G.postable_taint(spark.createDataFrame(chain, THEOREM)).collect())


def test_cycles_joins_and_archived_theorems_give_least_distances(spark):
    rng = random.Random(7)
    theorems = [(f"t{i}", rng.random() < 0.05, True, [rng.choice(["x", "y"])] * (rng.random() < 0.04) + [f"t{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))]) for i in range(60)]
    theorems += [("a", False, True, ["b"]), ("b", False, True, ["a"]), ("c", False, True, ["b", "t0"]), ("s", False, True, ["s"])]
    for seeds in (["x"], ["t3", "t4"], ["a"], ["nothing"]):
        assert cascade(spark, theorems, seeds) == walk(theorems, seeds)


def test_dependents_of_many_roots_equal_a_walk(spark):

    r = random.Random(4)
    rows = [(f"t{i}", r.random() < 0.1, sorted({f"t{r.randrange(200)}" if r.random() < 0.7 else f"x{r.randrange(12)}" for _ in range(r.choice([1, 1, 1, 2, 3]))})) for i in range(200)]
    rows += [(f"c{i}", False, [f"c{i - 1}" if i else "x0"]) for i in range(100)] + [("loop", False, ["loop"]), ("a", False, ["b"]), ("b", False, ["a", "x1"])]
    roots = [(f"g{i}", f"x{r.randrange(12)}") for i in range(6)] + [("g0", "t3"), ("g1", "x1"), ("g7", "nothing"), ("g8", "a"), ("g1", "x1")]
    got = {tuple(x) for x in G.dependents(spark.createDataFrame(rows, "id string, archived boolean, premises array<string>"), spark.createDataFrame(roots, "root string, id string")).collect()}
    want = set()
    for g in {g for g, _ in roots}:
        start = {i for h, i in roots if h == g}
        held = set(start)
        while True:
            new = {i for i, archived, ps in rows if not archived and i not in held and held & set(ps)}
            if not new:
                break
            held |= new
        want |= {(g, i) for i in held - start}
    assert got == want and len(want) > 300


def test_what_falls_with_the_convicted(spark):
    from lorekeep.operators import ledger as L

    v = spark.createDataFrame([("s1", ["h"]), ("s2", []), ("s3", ["h", "k"])], "signature string, convicted array<string>")
    t = spark.createDataFrame([("t1", False, ["h"]), ("t2", False, ["t1"]), ("t3", True, ["t1"]), ("t4", False, ["t3", "k"])], "id string, archived boolean, premises array<string>")
    assert sorted(tuple(r) for r in L.convict_dependents(v, t).collect()) == [("s1", "t1"), ("s1", "t2"), ("s3", "t1"), ("s3", "t2"), ("s3", "t4")]
    assert L.convict_dependents(v.limit(0), t).count() == L.convict_dependents(v, t.limit(0)).count() == 0
