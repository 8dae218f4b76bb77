"""Nearest neighbours against plain code: ties, copies, odd rows, cells with and without widening."""

import numpy as np

from lorekeep.operators import neighbours as N

DDL = "vec_id {}, vector array<double>"


def clustered(n=400, dims=8, copies=60):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, dims))
    rows = centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dims))
    rows[:copies] = rows[0]  # a group of copies, so that ties go by id
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows)]


def brute(queries, vectors, k, keep_self=False):
    out = set()
    for q, a in queries:
        found = []
        for v, b in vectors:
            if a is None or b is None or len(a) != len(b) or np.isnan(b).any() or q == v and not keep_self:
                continue
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            found.append((-round(float(np.dot(a, b) / (na * nb)) if na * nb else 0.0, 6) + 0.0, v))
        out |= {(q, v, -s + 0.0) for s, v in sorted(found)[:k]}
    return out


def rows(df):
    return {(r.query_id, r.vec_id, round(r.score, 6) + 0.0) for r in df.collect()}


def close(a, b):
    """The same pairs, and scores that differ by no more than rounding."""
    left, right = ({(q, v): s for q, v, s in x} for x in (a, b))
    assert left.keys() == right.keys()
    assert all(abs(left[p] - right[p]) < 2e-6 for p in left)


def test_knn_with_ties_and_odd_rows(spark):
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, 2.0]), (1003, [float("nan")] * 8), (None, [1.0] * 8)]
    vectors = clustered() + odd
    queries = [v for v in vectors if v[0] is not None and v[0] % 40 == 0 and v[1] is not None] + [(1001, [0.0] * 8), (1002, [1.0, 2.0]), (1000, None)]
    table = spark.createDataFrame(vectors, DDL.format("long")).repartition(3)
    asked = spark.createDataFrame(queries, DDL.format("long"))
    known = [v for v in vectors if v[0] is not None]
    for k in (1, 5, 100):
        close(rows(N.knn(asked, table, k)), brute(queries, known, k))
    close(rows(N.knn(asked, table, 3, keep_self=True)), brute(queries, known, 3, True))
    assert N.knn(asked.limit(0), table, 3).count() == 0 and N.knn(asked, table.limit(0), 3).count() == 0


def test_knn_with_many_queries_and_ids_of_letters(spark, monkeypatch):
    monkeypatch.setattr(N, "PASS_BYTES", 8 * 8 * 150)
    vectors = [(f"v{i}", x) for i, x in clustered(700)]
    table = spark.createDataFrame(vectors, DDL.format("string")).repartition(4)
    close(rows(N.knn(table, table, 4)), brute(vectors, vectors, 4))


def test_cells_prove_or_widen(spark):
    vectors = clustered(900) + [(2000, [0.0] * 8), (2001, None), (2002, [1.0])]
    queries = [v for v in vectors if v[0] % 30 == 0 and v[1] is not None] + [(2002, [1.0])]
    table, asked = spark.createDataFrame(vectors, DDL.format("long")), spark.createDataFrame(queries, DDL.format("long"))
    around = N.pivots(table, cells=40)
    index = N.vector_index(table, around)
    assert index.count() == 901
    fits = [q for q in queries if len(q[1]) == 8]
    want = brute(fits, vectors, 5)
    whole = N.knn_cells(asked, index, around, 5, probe=2)
    close(rows(whole), want)
    assert {r.proved for r in whole.collect()} == {True}
    part = N.knn_cells(asked, index, around, 5, probe=2, widen=False).collect()
    proved = {r.query_id for r in part if r.proved}
    assert proved
    close({(r.query_id, r.vec_id, r.score) for r in part if r.proved}, {x for x in want if x[0] in proved})
    recall = []
    for probe in (2, 4, 8):  # of 40 cells; two find less than 0.9 here
        found = {(r.query_id, r.vec_id) for r in N.knn_cells(asked, index, around, 5, probe=probe, widen=False).collect()}
        recall.append(len(found & {x[:2] for x in want}) / len(want))
    assert recall == sorted(recall) and recall[0] > 0.8 and recall[1] >= 0.9, recall
    assert N.knn_cells(asked, N.vector_index(table.limit(0), N.pivots(table.limit(0))), N.pivots(table.limit(0)), 5).count() == 0
